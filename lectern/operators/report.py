"""Reviews and debates to report segments and documents.

A segment is one (verse, source text, annotation) of the reviews, in order of first appearance. The debate that
belongs to it has the same verse and, white space at the ends aside, the same source text and annotation; of several
the first is taken. Both sides are reduced by key before the one equi-join, so it has a row a segment on each side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import session
from lectern.functions import jsonx
from lectern.functions.text import py_strip

# Fixed value: the annotation of a review that has none.
NO_ANNOTATION = "Uncategorized"


def consensus(closings: Column | str) -> Column:
    """The lowest score that closing statements propose; 0 if none does."""
    return F.coalesce(F.array_min(F.transform(closings, lambda x: x["score"])), F.lit(0))


def decoded_debates(debates: DataFrame) -> DataFrame:
    """Debates with closings, turns and consensus in place of their JSON."""
    out = debates.withColumn("closings", jsonx.closings("closing_statements")).withColumn("turns", jsonx.turns("debate"))
    return out.withColumn("consensus", consensus("closings")).drop("closing_statements", "debate")


def filled(individual: DataFrame) -> DataFrame:
    return individual.withColumn("face_annotation", F.coalesce("face_annotation", F.lit(NO_ANNOTATION)))


def segments(individual: DataFrame, by_chapter: bool = False) -> DataFrame:
    """verse, greek_text, face_annotation, ord (of first appearance), first (translation, notes), entries (ordered
    model, score, reasoning), n. Reviews without verse or source text have no segment. A segment's list holds its own
    reviews, one for each agent and annotated row."""
    keys = [*(["chapter"] if by_chapter else []), "verse", "greek_text", "face_annotation"]
    entry = F.struct("row_ord", "model", "score", F.col("model_analysis").alias("reasoning"))
    return (
        filled(individual)
        .filter("verse is not null and greek_text is not null")
        .groupBy(*keys)
        .agg(F.min("row_ord").alias("ord"), F.min_by(F.struct("translation", "notes"), "row_ord").alias("first"), F.array_sort(F.collect_list(entry)).alias("entries"), F.count(F.lit(1)).alias("n"))
    )


def first_debates(debates: DataFrame, by_chapter: bool = False) -> DataFrame:
    """The first debate of each trimmed key, as d_key and d (a struct, so that a match with nulls is still a match)."""
    keyed = debates.select("*", py_strip("greek_text").alias("d_greek"), py_strip("face_annotation").alias("d_face"), F.col("verse").alias("d_verse"), F.col("chapter").alias("d_chapter"))
    keys = [*(["d_chapter"] if by_chapter else []), "d_verse", "d_greek", "d_face"]
    return keyed.groupBy(*keys).agg(F.min_by(F.struct("debate", "closing_statements"), "row_ord").alias("d"))


def joined(individual: DataFrame, debates: DataFrame, by_chapter: bool = False) -> DataFrame:
    """segments() with has_debate, closings, turns and consensus (null without a debate). Only the debates that are
    met are decoded."""
    left = segments(individual, by_chapter)
    right = first_debates(debates, by_chapter)
    on = (F.col("verse") == F.col("d_verse")) & (py_strip("greek_text") == F.col("d_greek")) & (py_strip("face_annotation") == F.col("d_face"))
    on = on & (F.col("chapter") == F.col("d_chapter")) if by_chapter else on
    out = left.join(right, on, "left").withColumns({"has_debate": F.col("d").isNotNull(), "debate": F.col("d.debate"), "closing_statements": F.col("d.closing_statements")})
    out = decoded_debates(out)
    there = lambda c: F.when(F.col("has_debate"), F.col(c)).alias(c)
    return out.select(*left.columns, "has_debate", there("closings"), there("turns"), there("consensus"))


def _turn_json(x: Column) -> Column:
    linguist = jsonx.json_text(F.struct(x["role"].alias("role"), x["agent"].alias("agent"), x["argument"].alias("argument"), x["proposed_score"].alias("proposed_score")))
    moderator = jsonx.json_text(F.struct(x["role"].alias("role"), x["agent"].alias("agent"), x["violators"].alias("violators"), x["intervened"].alias("intervened"), x["feedback"].alias("feedback")))
    return F.when(x["role"] == "linguist", linguist).otherwise(moderator)


def _list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def segment_json(rows: DataFrame) -> DataFrame:
    """ord, json: each segment of joined() as JSON. Entries of either type have their own fields and no others."""
    individual = F.transform("entries", lambda x: jsonx.json_text(F.struct(F.lit("individual").alias("type"), x["model"].alias("model"), x["score"].alias("score"), x["reasoning"].alias("reasoning"))))
    debate = F.concat(
        F.lit('{"type":"debate","score":'), F.col("consensus").cast("string"), F.lit(',"debate_transcript":'), _list(F.transform("turns", _turn_json)), F.lit(',"closing_statements":'), jsonx.json_text(F.col("closings")), F.lit("}")
    )
    entries = _list(F.concat(individual, F.when(F.col("has_debate"), F.array(debate)).otherwise(F.expr("cast(array() as array<string>)"))))
    head = jsonx.json_text(F.struct("verse", F.col("greek_text").alias("greek"), F.col("first.translation").alias("translation"), F.col("face_annotation").alias("annotation"), F.col("first.notes").alias("notes")))
    return rows.select("ord", *[c for c in ("chapter",) if c in rows.columns], F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"analysis":'), entries, F.lit("}")).alias("json"))


def document_parts(individual: DataFrame, debates: DataFrame, book: str, category: str) -> DataFrame:
    """part, ord, text: one report as lines that make up its JSON when they follow one another by (part, ord): a head, a
    segment a line, an end. Its chapter is the first review's, 1 without reviews. Rows stay as small as a segment, so a
    report may be larger than a row or a task; sinks.ordered_text() writes it. Segments after the first carry the comma
    that parts them, which their place alone decides."""
    has = F.col("verse").isNotNull() & F.col("greek_text").isNotNull()
    chapter, first = individual.agg(F.coalesce(F.min_by("chapter", "row_ord"), F.lit(1)), F.min(F.when(has, F.col("row_ord")))).first()
    head = jsonx.json_text(F.struct(F.lit(book).alias("book"), F.lit(chapter).alias("chapter"), F.lit(category).alias("category")))
    ends = individual.sparkSession.range(2).select((F.col("id") * 2).cast("int").alias("part"), F.lit(0).cast("long").alias("ord"), F.when(F.col("id") == 0, F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"analysis":['))).otherwise("]}").alias("text"))
    comma = F.when(F.col("ord") == F.lit(first), "").otherwise(",")
    segments_ = segment_json(joined(individual, debates)).select(F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"), F.concat(comma, "json").alias("text"))
    return ends.unionByName(segments_)


def document(individual: DataFrame, debates: DataFrame, book: str, category: str) -> DataFrame:
    """One row, json: a report that fits one; larger ones are written from document_parts()."""
    parts = document_parts(individual, debates, book, category).agg(F.array_sort(F.collect_list(F.struct("part", "ord", "text"))).alias("parts"))
    return parts.select(F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("json"))


def documents(individual: DataFrame, debates: DataFrame, book: str, category: str) -> DataFrame:
    """A report for each chapter: chapter, json. Both tables are dealt out by chapter once; segments, their join and the
    documents are made where their chapter is."""
    session.joins_in_place(individual.sparkSession)
    parts = segment_json(joined(individual.repartition("chapter"), debates.repartition("chapter"), by_chapter=True)).groupBy("chapter").agg(F.array_sort(F.collect_list(F.struct("ord", "json"))).alias("parts"))
    return parts.select("chapter", _document("chapter", book, category))


def _document(chapter: str, book: str, category: str) -> Column:
    head = jsonx.json_text(F.struct(F.lit(book).alias("book"), F.col(chapter).alias("chapter"), F.lit(category).alias("category")))
    return F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"analysis":'), _list(F.transform("parts", lambda x: x["json"])), F.lit("}")).alias("json")
