"""What a session and its Python workers need."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package when the driver found it through sys.path alone. On a cluster it must be
    installed on the executors, or shipped with addPyFile."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH")) if x)


#: Bytes of an Arrow batch, where the session has Spark's default of 64 MB: workers hold a few batches at once.
BATCH_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of Python workers by bytes; a limit that the session was given stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b") in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def joins_in_place(spark: SparkSession) -> None:
    """Lets a join whose sides are both dealt out by some of its keys use them as they are; Spark's default deals both out
    again by all keys. It holds for all joins that the session plans from then on."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def python_json(spark: SparkSession) -> None:
    """Of a key that a JSON object repeats, the last one counts, as in Python; Spark's own rule is that such a text is
    invalid. It holds for all of the session's parsing into VARIANT."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
