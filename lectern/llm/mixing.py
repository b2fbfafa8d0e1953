"""Mixing sources to target weights by systematic sampling.

A source's documents, in order of size and doc_id, each expect target / size-of-source copies. The running sum of
expected copies, moved by one random offset of the source, emits a document once for each integer that it crosses.
As neighbours are of about one size, a source's taken words stay within its largest document of the target.

Ranks come from one range partitioning of (source, size, doc_id) and the counts of its partitions, so the hot
source is spread over many tasks and no window holds its rows. The table of sources has one row for each source.

Cases: a null text has size 0; null is a source, the last one; of a source of size 0 nothing is taken; rows that
repeat a doc_id are sized and weighed one by one; an empty table gives an empty result. In mix(), rows that share
doc_id, source and text are numbered and share their copies out, so that the words taken are those of copies(); a row
that a third of the table repeats is numbered in as many pieces as tasks read it; other columns pass untouched, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2
SEED = 20240101
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: str = "source") -> Column:
    """Null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def _at() -> Column:
    """A hash of doc_id, source and text. Rows that it can't tell apart are dealt their copies together."""
    return F.xxhash64("doc_id", _key(), F.col("text"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT, seed: int = SEED) -> DataFrame:
    """key, source_size, target, expected (copies of each document), offset: a row for each source of (key, source, size).

    A source is full where the common level times its weight reaches limit times its size. In order of size by
    weight, the level with the first k sources full is (budget - what they hold) / (weights of the others); the first
    source that this level doesn't fill settles it."""
    sums = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    listed = ",".join(map(str, weights))
    ranked = sums.selectExpr("*", f"array({listed})[int((row_number() over (order by source asc nulls last) - 1) % {len(weights)})] as weight")
    span = "over (order by source_size / weight, key rows between unbounded preceding and 1 preceding)"
    rest = "over (order by source_size / weight, key rows between current row and unbounded following)"
    level = ranked.selectExpr("*", f"({share}D * sum(source_size) over () - {limit} * coalesce(sum(source_size) {span}, 0)) / sum(weight) {rest} as level")
    settled = level.selectExpr("*", f"min_by(if(level * weight <= {limit} * source_size, level, null), if(level * weight <= {limit} * source_size, source_size / weight, null)) over () as final")
    target = f"if(source_size = 0, 0D, least(double({limit} * source_size), final * weight))"
    offset = f"cast(conv(substr(md5(concat('{seed}:', key)), 1, 8), 16, 10) as long) / 4294967296D"
    return settled.selectExpr("key", "source_size", f"{target} as target", f"if(source_size = 0, 0D, {target} / source_size) as expected", f"{offset} as offset")


def copies(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, source, key, size, at, source_size, target, copies of every document (doc_id, text, source). at: what mix()
    tells rows apart by."""
    sized = common.table(docs.select("doc_id", "source", _key().alias("key"), size_of().alias("size"), _at().alias("at")), "sized")  # texts are read once, not also for the ranges' bounds
    sized = sized.repartitionByRange("key", "size", "doc_id").sortWithinPartitions("key", "size", "doc_id").withColumn("row", F.monotonically_increasing_id())
    sized = common.table(sized, "placed")
    plan = targets(sized, **settings)
    part = F.shiftrightunsigned("row", 33)
    runs = sized.groupBy("key", part.alias("part")).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    runs = runs.selectExpr("key", "part", "first", "coalesce(sum(n) over (partition by key order by part rows between unbounded preceding and 1 preceding), 0) as before")
    runs = common.table(runs.join(plan, "key"), "runs")
    placed = sized.withColumn("part", part).join(runs, ["key", "part"]).withColumn("rank", F.expr("before + row - first + 1"))
    crossed = "cast(floor(rank * expected + offset) - floor((rank - 1) * expected + offset) as long)"
    return placed.selectExpr("doc_id", "source", "key", "size", "at", "source_size", "target", f"{crossed} as copies")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (x_row, x_at, ...) with x_k: from 1 on within x_at, in order of a hash of the row. Rows of one hash are taken as
    the same, so it doesn't matter which task numbers which of them: each numbers its own, behind those of tasks before
    it. Only counts are put in order, and no window holds more of an x_at than one task or range does."""
    rows = common.table(rows.withColumns({"x_hash": F.xxhash64("x_row"), "x_task": F.spark_partition_id()}), "repeated")
    keys = ["x_at", "x_hash", "x_task"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("x_n"))
    counts = common.table(counts.repartitionByRange(*keys).withColumn("x_part", F.spark_partition_id()), "repeated-counts")
    parts = counts.groupBy("x_at", "x_part").agg(F.sum("x_n").alias("x_n")).selectExpr("x_at", "x_part", "sum(x_n) over (partition by x_at order by x_part) - x_n as x_base")
    inside = counts.withColumn("x_inside", F.expr("sum(x_n) over (partition by x_at, x_part order by x_hash, x_task) - x_n"))
    before = inside.join(parts, ["x_at", "x_part"]).selectExpr(*keys, "x_base + x_inside as x_before")
    return rows.join(before, keys).withColumn("x_k", F.expr(f"x_before + row_number() over (partition by {', '.join(keys)} order by x_hash)"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The documents, each row as often as the mix takes it. Texts aren't moved, but those of repeated rows; what is
    broadcast has three numbers a row and BROADCAST_IDS rows at most."""
    dealt = copies(docs, **settings).groupBy(F.col("at").alias("x_at")).agg(F.sum("copies").alias("x_copies"), F.count(F.lit(1)).alias("x_rows"))
    dealt, n = common.table_n(dealt.filter("x_copies > 0"), "copies")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("x_row"), _at().alias("x_at"))
    held = held.join(F.broadcast(dealt) if n <= common.BROADCAST_IDS else dealt, "x_at")
    once = held.filter("x_rows = 1").select("x_row", "x_copies")
    if dealt.filter("x_rows > 1").head(1):
        numbered = _numbered(held.filter("x_rows > 1"))
        share = "cast(floor(x_k * x_copies / x_rows) - floor((x_k - 1) * x_copies / x_rows) as long) as x_copies"
        once = once.unionByName(numbered.selectExpr("x_row", share).filter("x_copies > 0"))
    taken = once.select("x_row", F.explode(F.sequence(F.lit(1), F.col("x_copies").cast("int"))))
    return taken.select(*[F.col(f"x_row.`{c}`").alias(c) for c in docs.columns])


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP9_SQL = rf"""
with sized as (
  select doc_id, source, coalesce('s' || source, 'n') as key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), sums as (select key, source, sum(size)::bigint as source_size from sized group by key, source
), ranked as (
  select *, ([3, 1, 2])[((row_number() over (order by encode(source) asc nulls last) - 1) % 3 + 1)::int] as weight from sums
), level as (
  select *, (1.5::double * (sum(source_size) over ())::double - 2 * coalesce(sum(source_size) over (order by source_size::double / weight, key rows between unbounded preceding and 1 preceding), 0)::double)
    / (sum(weight) over (order by source_size::double / weight, key rows between current row and unbounded following))::double as lev from ranked
), final as (
  select arg_min(lev, source_size::double / weight) as final from level where lev * weight <= 2 * source_size
), plan as (
  select key, source_size, case when source_size = 0 then 0::double else least((2 * source_size)::double, final * weight) end as target,
    ('0x' || substr(md5('{SEED}:' || key), 1, 8))::bigint / 4294967296.0::double as shift from level, final
), placed as (
  select s.doc_id, s.size, p.*, case when p.source_size = 0 then 0::double else p.target / p.source_size end as expected,
    row_number() over (partition by s.key order by s.size, s.doc_id) as r
  from sized s join plan p on s.key = p.key
)
select doc_id, size, source_size, target, (size * (floor(r * expected + shift) - floor((r - 1) * expected + shift)))::bigint as taken from placed
"""
