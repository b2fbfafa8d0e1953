"""Token counts from an exact histogram of encoded lengths.

Documents are counted by length within each task, so one row for each length leaves it. Suffix sums over the
lengths answer every question about a context limit: how many tokens there are in all, at which length a share of
the documents or tokens is reached, and how many tokens stay if each document is cut at the limit.

Suffix sums run within ranges of 1024 lengths and over the ranges. Cases: a null or empty text has length 0;
repeated rows count each; an empty table has an empty histogram and zero answers; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common
from lectern.llm.coder import coder, vocabulary_path
from lectern.llm.words import Words

RANGE = 1024


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.hold("coder", coder.cache_clear)
        seen: dict[int, int] = {}
        for rows, data, offsets in common.slices(batches):
            words = Words(data, offsets)
            sums = np.append(0, np.cumsum(coder(path).lengths(words)))
            for length, n in zip(*np.unique(np.diff(sums[words.bounds]), return_counts=True), strict=True):
                seen[int(length)] = seen.get(int(length), 0) + int(n)
            if len(seen) > 100_000:
                yield pa.record_batch([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["length", "n"])
                seen = {}
        yield pa.record_batch([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["length", "n"])

    return run


def histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """length, n_docs: how many documents (text) have that many token ids."""
    common.session_paths(docs.sparkSession)
    counted = docs.select(common.text_or_empty()).mapInArrow(_count(vocabulary or vocabulary_path()), "length long, n long")
    return counted.groupBy("length").agg(F.sum("n").alias("n_docs"))


def answers(lengths: DataFrame) -> DataFrame:
    """For each length as a context limit: n_docs of that length, docs_at_least and tokens_at_least of it and above,
    share_at_most (of documents within the limit), truncated_total (tokens left when each document is cut there) and
    total_tokens."""
    lengths = common.table(lengths.withColumn("range", F.floor(F.col("length") / RANGE)), "lengths")
    ranges = lengths.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    above = "over (order by range desc rows between unbounded preceding and current row)"
    ranges = ranges.selectExpr("range", f"sum(d) {above} - d as d_above", f"sum(t) {above} - t as t_above", "sum(d) over () as all_docs", "sum(t) over () as all_tokens")
    within = "over (partition by range order by length desc rows between unbounded preceding and current row)"
    out = lengths.join(ranges, "range").selectExpr("length", "n_docs", f"d_above + sum(n_docs) {within} as docs_at_least", f"t_above + sum(n_docs * length) {within} as tokens_at_least", "all_docs", "all_tokens")
    return out.selectExpr(
        "length", "n_docs", "docs_at_least", "tokens_at_least", "(all_docs - docs_at_least + n_docs) / all_docs as share_at_most", "all_tokens - tokens_at_least + length * docs_at_least as truncated_total", "all_tokens as total_tokens"
    )


def limits(table: DataFrame, at: list[int]) -> DataFrame:
    """limit, truncated_total, total_tokens for any limits, from answers(): one aggregation over the lengths."""
    up = "min_by(struct(docs_at_least as d, tokens_at_least as t), length) filter (where length > {})".format
    found = table.selectExpr("coalesce(max(total_tokens), 0) as total_tokens", f"array({', '.join(f'struct({int(x)}L as limit, {up(int(x))} as m)' for x in at)}) as asked")
    return found.selectExpr("inline(asked)", "total_tokens").selectExpr("limit", "total_tokens - coalesce(m.t, 0) + limit * coalesce(m.d, 0) as truncated_total", "total_tokens")


def quantiles(table: DataFrame, at: list[float]) -> DataFrame:
    """share, length: the smallest length that at least this share of the documents doesn't exceed."""
    asked = ", ".join(f"struct({float(x)!r}D as share, min(length) filter (where share_at_most >= {float(x)!r}D) as length)" for x in at)
    return table.selectExpr(f"array({asked}) as asked").selectExpr("inline(asked)")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")))
