"""Violations of the report's schema, as rows.

breaches() checks report documents as they are in files: types, bounds, unions and names, by the schema document.
violations() checks reports that were read with their types, of which only what is missing or out of bounds is left to say.
Both are one pass over the reports, without an exchange."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import jsonschema
from lectern.schemas import REPORT_SCHEMA


def breaches(documents: DataFrame, content: str = "content", schema: dict = REPORT_SCHEMA) -> DataFrame:
    """documents without content, with pointer, rule, detail and part (the schema's title, L1 to L6) for each breach of its
    JSON text. A text that is no JSON is one breach of rule json."""
    others = [c for c in documents.columns if c != content]
    parsed = documents.select(*others, F.col(content).alias("x_text"), F.try_parse_json(content).alias("x_json"))
    broken = F.expr("array(named_struct('pointer', '', 'rule', 'json', 'detail', left(x_text, 50), 'part', ''))")
    found = F.when(F.col("x_json").isNull(), F.when(F.col("x_text").isNotNull(), broken)).otherwise(jsonschema.breaches("x_json", schema))
    return parsed.select(*others, F.inline(found))


_VIOLATION = "array<struct<rule: string, verse: int, detail: string>>"


def _if(bad: Column, rule: str, verse: Column, detail: Column) -> Column:
    row = F.struct(F.lit(rule).alias("rule"), verse.cast("int").alias("verse"), detail.cast("string").alias("detail"))
    return F.when(F.coalesce(bad, F.lit(True)), F.array(row)).otherwise(F.lit(None).cast(_VIOLATION))


def _all(*found: Column) -> Column:
    return F.concat(*[F.coalesce(x, F.expr(f"cast(array() as {_VIOLATION})")) for x in found])


def _each(items: Column, of: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(items, of))


def _missing(at: Callable[[str], Column], rule: str, verse: Column, *fields: str) -> Column:
    names = F.array_compact(F.array(*[F.when(at(f).isNull(), F.lit(f)) for f in fields]))
    return _if(F.size(names) > 0, rule, verse, F.array_join(names, ","))


def violations(reports: DataFrame, low: int = 1, high: int = 10) -> DataFrame:
    """rule, chapter, verse, detail. Reports have the report's columns. L1 report fields, L2 segment fields, L3 individual
    entries and the bounds of their score, L4 debate entries, L5 turns, L6 closing statements."""

    def turn(verse: Column) -> Callable[[Column], Column]:
        known = lambda t: F.coalesce(t["role"].isin("linguist", "moderator"), F.lit(False)) & t["agent"].isNotNull()
        return lambda t: _all(_if(~known(t), "L5", verse, F.concat_ws(" ", F.lit("turn of"), F.coalesce(t["role"], F.lit("no role")))))

    def entry(verse: Column) -> Callable[[Column], Column]:
        def of(e: Column) -> Column:
            at = lambda f: e[f]
            bounds = _if((e["score"] < low) | (e["score"] > high), "L3", verse, F.concat(F.lit("score "), e["score"].cast("string")))
            individual = _all(_missing(at, "L3", verse, "model", "score", "reasoning"), F.when(e["score"].isNotNull(), bounds))
            closing = lambda c: _all(_missing(lambda f: c[f], "L6", verse, "agent", "statement", "score"))
            debate = _all(_missing(at, "L4", verse, "score", "debate_transcript", "closing_statements"), _each(e["debate_transcript"], turn(verse)), _each(e["closing_statements"], closing))
            return _all(F.when(e["type"] == "individual", individual), F.when(e["type"] == "debate", debate))

        return of

    def segment(s: Column) -> Column:
        return _all(_missing(lambda f: s[f], "L2", s["verse"], "verse", "greek", "translation", "annotation", "analysis"), _each(s["analysis"], entry(s["verse"])))

    own = _missing(F.col, "L1", F.lit(None), "book", "chapter", "category", "analysis")
    return reports.select("chapter", F.inline(_all(own, _each(F.col("analysis"), segment)))).select("rule", "chapter", "verse", "detail")
