"""Writers: CSV tables, report documents, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from lectern.session import importable


def csv(df: DataFrame, path: str, order: str | None = "row_ord", single: bool = False) -> None:
    """A table as CSV with doubled quotes and no index column, in row order: as parts whose names are in order, or as one
    file, which one task writes."""
    if order and order in df.columns:
        df = df.orderBy(order).drop(order)
    (df.coalesce(1) if single else df).write.csv(path, header=True, quote='"', escape='"', mode="overwrite")


def json_documents(documents: DataFrame, path: str, column: str = "json", order: str | None = None) -> None:
    """One document a line, as UTF-8; missing values are null. With order, one document a file, names in that order."""
    rows = documents.orderBy(order) if order else documents
    out = rows.select(column).write.mode("overwrite")
    (out.option("maxRecordsPerFile", 1) if order else out).text(path)


def ordered_text(rows: DataFrame, path: str, *order: str, column: str = "text", parts: int | None = None) -> None:
    """Lines as files whose names are in order: read one after the other, they are the whole text. Rows are dealt out by
    ranges of order, so no task holds more than its range. parts: how many ranges, and files, there are."""
    rows.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order).select(column).write.mode("overwrite").text(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; in a local one only where that is unset and the master
    is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; set it to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lectern-")
    return f"{where}/lectern-{name}-{uuid.uuid4().hex}"


def gone_at_end(spark: SparkSession, path: str) -> None:
    """Has a written folder deleted when the session ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df, written in the folder that spark.checkpoint.dir names and read back: model calls behind it are made once,
    whichever executors are lost later. Compressed by zstd, whose window also meets a text that is repeated."""
    spark = df.sparkSession
    path = scratch(spark, name)
    importable(spark)
    df.write.option("compression", "zstd").parquet(path)
    gone_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, path: str | None = None) -> DataFrame:
    """df as a table that is bucketed and sorted by keys, with bloom filters on them: joins of such tables by the keys move
    nothing, and a lookup reads the row groups that may hold its key. Each bucket is one file. path: where it is to stay; without it, it
    goes with the session."""
    spark = df.sparkSession
    importable(spark)
    table = f"lectern_{name}_{uuid.uuid4().hex}"
    where = path or scratch(spark, name)
    out = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", where)
    for k in keys:
        out = out.option(f"parquet.bloom.filter.enabled#{k}", "true")
    out.saveAsTable(table)
    if not path:
        gone_at_end(spark, where)
    return spark.table(table)


def markdown(df: DataFrame, rows: int = 20) -> str:
    """The first rows as a Markdown table, for a console; the rest is counted nowhere and read by no one."""
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *([cell(x) for x in r] for r in df.limit(rows).collect())]
    return "\n".join(f"| {' | '.join(x)} |" for x in lines)
