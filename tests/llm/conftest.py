import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture
def docs(spark):
    """Builds a table of (doc_id, text) with an extra column named like a result."""

    def build(rows, **extra):
        table = spark.createDataFrame(rows, "doc_id long, text string")
        for name, value in extra.items():
            from pyspark.sql import functions as F

            table = table.withColumn(name, F.lit(value))
        return table

    return build
