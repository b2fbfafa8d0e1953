"""Report files that keep arriving, merged into a verse index that is rewritten by buckets.

The index is split by a hash of (chapter, verse) into a fixed number of buckets, each sorted by its key. A batch rewrites
the buckets that it touches, once and into files of its own, and a manifest of a few hundred bytes says which files hold
each bucket. Readers see a batch when its manifest is there, whole; a batch that is run again writes the same files and the
same manifest again, from the manifest before it. Files that neither of the last two manifests names are deleted.

A bucket is read and written by one task, so choose buckets for the index's final size (64 MB each, say)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators import views
from lectern.schemas import REPORT, SEGMENT
from lectern.sources.sinks import materialise

BUCKETS = 64
INDEX = f"chapter int, verse int, segment {SEGMENT.simpleString()}"


def bucket_of(chapter: Column | str, verse: Column | str, buckets: int) -> Column:
    return F.pmod(F.hash(chapter, verse), F.lit(buckets)).alias("bucket")


class _Folder:
    """Files that the driver reads, writes and deletes by name, in whatever store path is in."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self.at(name))] if self.fs.exists(self.at(name)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Under another name first, so that nobody reads half of it."""
        stream = self.fs.create(self.at(f".{name}"), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.delete(name)
        self.fs.rename(self.at(f".{name}"), self.at(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _manifest(batch: int) -> str:
    return f"manifest-{batch:019d}.json"


def manifest(spark: SparkSession, path: str, before: int | None = None) -> dict | None:
    """batch, buckets and files (the folder of each bucket) of the last batch, or the last one before the given batch."""
    folder = _Folder(spark, path)
    found = [x for x in folder.names() if x.startswith("manifest-") and (before is None or x < _manifest(before))]
    return json.loads(folder.read(max(found))) if found else None


def _read(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    return spark.read.schema(INDEX).parquet(*[f"{path}/{x}" for x in files]) if files else spark.createDataFrame([], INDEX)


def snapshot(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """chapter, verse, segment of the last batch, or the last one before the given batch; None without any."""
    said = manifest(spark, path, before)
    return _read(spark, path, sorted(set(said["files"].values()))) if said else None


def segment_of(spark: SparkSession, path: str, chapter: int, verse: int) -> DataFrame:
    """The index's row of one verse: one bucket's files are read, of these the row groups that may hold the key."""
    said = manifest(spark, path)
    if not said:
        return _read(spark, path, [])
    bucket = spark.range(1).select(bucket_of(F.lit(chapter), F.lit(verse), said["buckets"])).first()[0]
    files = [said["files"][str(bucket)]] if str(bucket) in said["files"] else []
    return _read(spark, path, files).filter((F.col("chapter") == chapter) & (F.col("verse") == verse))


def merge(spark: SparkSession, path: str, reports: DataFrame, batch: int, buckets: int = BUCKETS) -> list[int]:
    """Merges reports (with file_ord) into the index at path as the given batch, the latest segment winning; the buckets
    that were rewritten. An index keeps the number of buckets that it began with."""
    old = manifest(spark, path, batch)
    buckets = old["buckets"] if old else buckets
    found = materialise(views.index(reports).withColumn("bucket", bucket_of("chapter", "verse", buckets)), "arrived")
    touched = sorted(r.bucket for r in found.select("bucket").distinct().collect())
    held = _read(spark, path, [old["files"][str(b)] for b in touched if str(b) in old["files"]] if old else [])
    both = held.select("*", bucket_of("chapter", "verse", buckets), F.lit(0).alias("age")).unionByName(found.withColumn("age", F.lit(1)))
    merged = both.repartition(max(1, len(touched)), "bucket").groupBy("bucket", "chapter", "verse").agg(F.max_by("segment", "age").alias("segment"))
    if touched:
        merged.sortWithinPartitions("bucket", "chapter", "verse").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/batch={batch}")
    files = (old["files"] if old else {}) | {str(b): f"batch={batch}/bucket={b}" for b in touched}
    folder = _Folder(spark, path)
    folder.write(_manifest(batch), json.dumps({"batch": batch, "buckets": buckets, "files": files}))
    _clear(folder, {*files.values(), *(old["files"].values() if old else ())}, {_manifest(batch), *([_manifest(old["batch"])] if old else [])})
    return touched


def _clear(folder: _Folder, files: set[str], manifests: set[str]) -> None:
    """Deletes what no manifest of the last two names."""
    for name in folder.names():
        if name.startswith("manifest-") and name not in manifests and name < max(manifests):
            folder.delete(name)
        if name.startswith("batch="):
            inside = [f"{name}/{x}" for x in folder.names(name) if x.startswith("bucket=")]
            for x in inside if any(y in files for y in inside) else [name]:
                if x not in files:
                    folder.delete(x)


def start(spark: SparkSession, source: str, index_path: str, checkpoint: str, buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """Follows the folder source; the index is at index_path."""
    stream = spark.readStream.schema(REPORT).option("multiLine", True).json(source)
    stream = stream.withColumn("file_ord", F.struct(F.unix_micros("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_name").alias("name")))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        merge(spark, index_path, batch, batch_id, buckets)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
