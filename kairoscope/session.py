"""Session settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession, package: str = "kairoscope") -> None:
    """Send a package's sources to the Python workers, once per context."""
    context = spark.sparkContext
    sent = context.__dict__.setdefault("_shipped_packages", set())
    if package in sent:
        return
    fd, path = tempfile.mkstemp(prefix=f"{package}-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, files in os.walk(os.path.join(_ROOT, package)):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, _ROOT))
    context.addPyFile(path)
    sent.add(package)


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options that change results or skew handling.

    Sizing options (shuffle partitions, memory, split size) stay with the cluster.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Above 8000 bytes of bytecode HotSpot interprets a method; wide text projections
    # then run several times faster split up than fused into one stage method.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # Rows to Python come in batches bounded by bytes: ten thousand long texts are no small batch.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    ship(spark)
    return spark


def local_session(cores: str = "8", app: str = "kairoscope", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())
