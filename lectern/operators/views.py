"""What a reader of reports looks at: verses with scores, one verse's detail, visible turns, and the index of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import bands


def valid_reports(reports: DataFrame) -> DataFrame:
    """Reports with a chapter other than 0 and a list of segments; the rest are rejected whole."""
    return reports.filter((F.coalesce("chapter", F.lit(0)) != 0) & F.col("analysis").isNotNull())


def index(reports: DataFrame, file_ord: str = "file_ord") -> DataFrame:
    """chapter, verse, segment: of each verse the last segment of the last report, whatever its book. Segments without
    a verse, or with verse 0, are not indexed."""
    items = valid_reports(reports).select("chapter", F.col(file_ord).alias("file_ord"), F.posexplode("analysis").alias("item_ord", "segment"))
    items = items.filter(F.coalesce("segment.verse", F.lit(0)) != 0).withColumn("verse", F.col("segment.verse"))
    return items.groupBy("chapter", "verse").agg(F.max_by("segment", F.struct("file_ord", "item_ord")).alias("segment"))


def first_debate(analysis: Column | str) -> Column:
    """Null where no entry is a debate."""
    return F.get(F.filter(analysis, lambda x: x["type"] == "debate"), F.lit(0))


def individuals(analysis: Column | str) -> Column:
    return F.filter(analysis, lambda x: x["type"] == "individual")


def scoreboard(verses: DataFrame, scores: DataFrame) -> DataFrame:
    """chapter, verse, text, debate_score, and how they show: score (null for 0), band, badge, width. scores has
    chapter, verse, debate_score."""
    out = verses.select("chapter", "verse", "text").join(scores.select("chapter", "verse", "debate_score"), ["chapter", "verse"], "left")
    return out.select("*", bands.shown("debate_score").alias("score"), bands.verse_band("debate_score").alias("band"), bands.badge_band("debate_score").alias("badge"), bands.bar_width(bands.shown("debate_score")).alias("width"))


def index_scores(found: DataFrame) -> DataFrame:
    """chapter, verse, debate_score of index(), for scoreboard()."""
    return found.select("chapter", "verse", first_debate("segment.analysis")["score"].alias("debate_score"))


def detail(verses: DataFrame, found: DataFrame, chapter: int | None = None, verse: int | None = None, chosen: int = 0) -> DataFrame:
    """A verse's text, its debate entry, its individual entries with their labels, and the chosen one of these (by index,
    null where there are fewer); all verses where none is named."""
    if chapter is not None:
        verses, found = (x.filter((F.col("chapter") == chapter) & (F.col("verse") == verse)) for x in (verses, found))
    own = individuals("segment.analysis")
    label = F.transform(own, lambda x: F.format_string("%s (Score: %s)", x["model"], x["score"].cast("string")))
    out = verses.select("chapter", "verse", "text").join(found, ["chapter", "verse"], "left")
    return out.select("chapter", "verse", "text", first_debate("segment.analysis").alias("debate"), own.alias("individuals"), label.alias("labels"), F.get(own, F.lit(chosen)).alias("chosen"))


def visible_turns(turns: DataFrame) -> DataFrame:
    """Turns that show: all but the moderator's without an intervention. Columns initial, body, shown_score and
    violations are what shows. turns has role, agent, argument, proposed_score, violators, intervened, feedback."""
    seen = turns.filter(~F.col("role").eqNullSafe("moderator") | F.col("intervened").eqNullSafe(True))
    return seen.select(
        "*",
        F.when(F.col("role") == "moderator", "M").otherwise(F.left("agent", F.lit(1))).alias("initial"),
        F.coalesce(F.nullif("argument", F.lit("")), "feedback").alias("body"),
        bands.shown("proposed_score").alias("shown_score"),
        F.when(F.size("violators") > 0, F.array_join("violators", ", ")).alias("violations"),
    )


def chapters(verses: DataFrame) -> DataFrame:
    """chapter, n_verses, first_verse, in no order: numbered() gives it, and sinks sort by it."""
    return verses.groupBy("chapter").agg(F.count(F.lit(1)).alias("n_verses"), F.min("verse").alias("first_verse"))


def numbered(verses: DataFrame) -> DataFrame:
    """Verses with place: 1 for the first of its chapter, by number."""
    return verses.withColumn("place", F.row_number().over(Window.partitionBy("chapter").orderBy("verse")))


def first_chapter(verses: DataFrame) -> DataFrame:
    """chapter: the one that shows first, null without verses."""
    return verses.agg(F.min("chapter").alias("chapter"))
