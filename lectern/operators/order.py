"""Global order without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.sources.sinks import materialise

_IN_PART = (1 << 33) - 1


def numbered(rows: DataFrame, *keys: Column | str, name: str = "place", first: int = 0) -> DataFrame:
    """rows with a dense ordinal by keys: 0, 1, 2 and so on. Rows are dealt out by ranges of the keys and sorted within
    them; a part's first ordinal is how many rows the parts before it have, of which the driver holds a number a part. Rows
    that tie in all keys are numbered in any order."""
    row = f"x_{name}_row"
    parts = materialise(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(row, F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned(row, 33).cast("int")
    counts = {r.part: r.n for r in parts.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, held = [], first
    for k in range(max(counts, default=-1) + 1):
        before.append(held)
        held += counts.get(k, 0)
    offset = F.element_at(F.lit(before).cast("array<long>"), part + 1) if before else F.lit(first)
    return parts.withColumn(name, offset + F.col(row).bitwiseAND(_IN_PART)).drop(row)
