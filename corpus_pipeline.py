"""Training-data pipeline: quality, deduplication and packing of ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All stages but the last return
the columns of documents, further ones included, whatever their names. Stages that drop
rows number them in a table written first, so repeated rows and null ids are told apart.
Null and empty texts are judged like others and fall to the base rules; very long texts
are worked on whole; an empty table gives no sequences. Without labels of both classes
the classifier accepts everything and no cutoff is certified.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoscope.llm import exact_dedup, minhash, packing, quality_classifier, quality_rules
from kairoscope.llm.queries import vocabulary_path
from kairoscope.session import prepare
from kairoscope.staging import stage

#: Dropped rows that are broadcast at most (8 bytes each); beyond it an ordinary join is used.
BROADCAST_ROWS = 1_000_000


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows and their numbers, written once: another scan may be split, and so numbered,
    otherwise. The number's name is one that no column has."""
    row = quality_classifier.free_name("_row", docs.columns)
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _without(numbered: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """The rows of ``numbered`` that are not in ``dropped``, without their numbers."""
    dropped = stage(dropped.select(row), "dropped")
    dropped = F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped
    return numbered.join(dropped, row, "left_anti").drop(row)


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(quality_classifier.remainder() != 2)
    model = quality_classifier.fit(docs, labels)
    score = quality_classifier.free_name("score", docs.columns)
    predicted = quality_classifier.free_name("predicted", docs.columns)
    scored = quality_classifier.score(docs, model, names=(score, predicted))
    return scored.filter(F.col(predicted) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs; texts are counted once."""
    prepare(spark)
    numbered, row = _numbered(docs)
    measured = stage(quality_rules.measure(numbered.select(row, "doc_id", "lang", "text")).drop("text"), "measured")
    cutoffs = stage(quality_rules.certify(measured, spark.read.parquet(f"{sf_dir}/labels.parquet")), "cutoffs")
    return _without(numbered, row, quality_rules.judge(measured, cutoffs).filter("not kept"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    prepare(spark)
    numbered, row = _numbered(docs)
    found = exact_dedup.exact_dedup(numbered.select(row, "text"), key=row)
    return _without(numbered, row, found.filter(~F.col("kept")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    prepare(spark)
    numbered, row = _numbered(docs)
    found = minhash.near_classes(numbered.select(row, "text"), key=row)
    return _without(numbered, row, found.filter(F.col(row) != F.col("class_key")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    prepare(spark)
    pieces = packing.pack(docs, vocabulary_path(), keep=["doc_id"])
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality classifier", judge_quality),
    ("quality rules", apply_rules),
    ("exact dedup", drop_copies),
    ("minhash near-dedup", drop_near_copies),
    ("packing", pack),
]

#: SQL can neither compress, sketch nor tokenize; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
