"""Annotated source segments and their translations: strict and lenient lookups, fan-out, groups of reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import fail_if, reference_key, strict_keys  # noqa: F401


def with_translation(truth: DataFrame, verses: DataFrame, on_missing: str = "error", book: str = "PHM") -> DataFrame:
    """Ground truth with the translation of its verse. A verse without one fails the job ('error') or leaves the
    result ('skip'). The smaller side is broadcast where Spark's statistics allow it."""
    known = verses.select("chapter", "verse", F.col("text").alias("translation"))
    if on_missing == "skip":
        return truth.join(known, ["chapter", "verse"])
    joined = truth.join(known, ["chapter", "verse"], "left")
    return joined.filter(fail_if(F.col("translation").isNull(), F.concat(F.lit("no translation of "), reference_key(book, "chapter", "verse"))))


def translated(truth: DataFrame, verses: DataFrame) -> DataFrame:
    """Ground truth whose verse has a translation."""
    return truth.join(verses.select("chapter", "verse"), ["chapter", "verse"], "left_semi")


def fan_out(rows: DataFrame, agents: list[dict[str, str]]) -> DataFrame:
    """Each row once for each agent (name, model), in the agents' order: agent_idx, agent_name, model. The list is
    part of the plan, so this is a projection and no join."""
    each = F.array(*[F.struct(F.lit(i).alias("agent_idx"), F.lit(a["name"]).alias("agent_name"), F.lit(a["model"]).alias("model")) for i, a in enumerate(agents)])
    return rows.select("*", F.inline(each))


def review_groups(individual: DataFrame) -> DataFrame:
    """chapter, verse, n, first: how many reviews each verse has, and its first row. Null keys have no group."""
    first = F.min_by(F.struct("face_annotation", "greek_text", "translation"), "row_ord").alias("first")
    return individual.filter("chapter is not null and verse is not null").groupBy("chapter", "verse").agg(F.count(F.lit(1)).alias("n"), first)


def debatable(individual: DataFrame, expected: int = 2) -> DataFrame:
    """Groups with exactly the expected number of reviews."""
    return review_groups(individual).filter(F.col("n") == expected)


def skipped(individual: DataFrame, expected: int = 2) -> DataFrame:
    """The other groups."""
    return review_groups(individual).filter(F.col("n") != expected)


# Fixed value: the line of a review in a debate's context; agent, score, analysis.
OPENING = "- **{}** (Initial Score: {}): {}"
#: What stands above and below these lines: source text, translation, annotation; the task.
CONTEXT = ("Source: {}", "Translation: {}", "Annotation: {}")
TASK = "Argue for or against these scores from the wording alone, and try to agree on one."


def debate_context(individual: DataFrame, heads: tuple[str, ...] = CONTEXT, template: str = OPENING, task: str = TASK) -> DataFrame:
    """chapter, verse, context: what a debate begins with. The first review's source text, translation and annotation, a
    line for each review in row order, the task. Null cells are empty."""
    first = F.min_by(F.struct("greek_text", "translation", "face_annotation"), "row_ord").alias("first")
    firsts = individual.filter("chapter is not null and verse is not null").groupBy("chapter", "verse").agg(first, F.array_sort(F.collect_list(F.struct("row_ord", _line(template).alias("line")))).alias("lines"))
    parts = [F.concat(F.lit(h.split("{}")[0]), F.coalesce(f"first.{c}", F.lit("")), F.lit(h.split("{}")[1])) for h, c in zip(heads, ("greek_text", "translation", "face_annotation"), strict=True)]
    return firsts.select("chapter", "verse", F.concat_ws("\n", *parts, F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit(task)).alias("context"))


def _line(template: str) -> Column:
    head, mid, tail, end = (*template.split("{}"), "")[:4]
    return F.concat(F.lit(head), "agent_name", F.lit(mid), F.col("score").cast("string"), F.lit(tail), F.coalesce("model_analysis", F.lit("")), F.lit(end))


def trace(individual: DataFrame, expected: int = 2) -> DataFrame:
    """chapter, verse, said: what a run does with each verse."""
    said = F.when(F.col("n") == expected, "debated").otherwise(F.format_string("skipped: %d of %d reviews", F.col("n"), F.lit(expected)))
    return review_groups(individual).select("chapter", "verse", said.alias("said"))


def opening_context(individual: DataFrame, template: str = OPENING) -> DataFrame:
    """chapter, verse, context: the reviews of each verse, a line each, in row order."""
    lines = F.array_sort(F.collect_list(F.struct("row_ord", _line(template).alias("line"))))
    grouped = individual.filter("chapter is not null and verse is not null").groupBy("chapter", "verse").agg(lines.alias("lines"))
    return grouped.select("chapter", "verse", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("context"))
