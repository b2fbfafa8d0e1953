"""The test tables as domain tables: projections only, the same as DOMAIN_SQL has them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import usfm
from lectern.functions.jsonx import json_text
from lectern.operators.workflow import CLOSING_TASK
from lectern.plans.batch import AGENTS
from lectern.schemas import SEGMENT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def truth(spark: SparkSession, sf_dir: str, multi: bool = False) -> DataFrame:
    """Every document is an annotated segment, 50 to a chapter; with multi some verses have two segments."""
    verse = "(doc_id % 50) % 37 + 1" if multi else "doc_id % 50 + 1"
    return table(spark, sf_dir, "documents").selectExpr("cast(doc_id div 50 + 1 as int) as chapter", f"cast({verse} as int) as verse", "text as greek_text", "if(lang = 'de', null, source) as face", "lang as notes", "doc_id as row_ord", "n_chars")


def scripture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as USFM text: file, content, a file for each chapter."""
    rows = truth(spark, sf_dir).select(F.lit("PHM").alias("book"), "chapter", "verse", F.col("greek_text").alias("text"), F.col("chapter").alias("file"))
    return usfm.render(rows, ["file"])


def verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' USFM files, parsed again."""
    return usfm.parse(scripture(spark, sf_dir), ["file"]).drop("file")


def individual(spark: SparkSession, sf_dir: str, multi: bool = False) -> DataFrame:
    agents = F.inline(F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(a["name"]).alias("agent_name"), F.lit(a["model"]).alias("model")) for i, a in enumerate(AGENTS)]))
    rows = truth(spark, sf_dir, multi).select("*", agents)
    return rows.selectExpr(
        "model", "agent_name", "chapter", "verse", "greek_text", "concat('tr ', row_ord) as translation", "face as face_annotation", "notes", "cast(1 + (n_chars + 3 * idx) % 10 as int) as score", "concat(agent_name, ' on ', row_ord) as model_analysis", "row_ord * 2 + idx as row_ord"
    )


def debates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A debate for each labelled document, double-encoded, with white space around its source text."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    rows = rows.selectExpr("*", "cast(1 + n_chars % 10 as int) as a", "cast(1 + (n_chars + 3 * quality) % 10 as int) as b")
    speak = lambda agent, score: json_text(F.struct(F.lit(agent).alias("agent_name"), F.lit("holds").alias("argument"), F.col(score).alias("proposed_score")))
    moderate = json_text(F.struct((F.col("toxic") == 1).alias("intervene"), F.array(F.lit("A")).alias("violators"), F.lit("stay with the text").alias("feedback")))
    return rows.select(
        F.expr("cast(doc_id div 50 + 1 as int)").alias("chapter"),
        F.expr("cast(doc_id % 50 + 1 as int)").alias("verse"),
        F.expr("if(lang = 'de', null, concat(source, ' '))").alias("face_annotation"),
        F.concat(F.lit(" \n"), "text", F.lit("\t")).alias("greek_text"),
        F.lit("").alias("translation"),
        F.to_json(F.array(speak("A", "a"), speak("B", "b"), moderate)).alias("debate"),
        F.to_json(F.array(F.lit(CLOSING_TASK), speak("A", "a"), speak("B", "b"))).alias("closing_statements"),
        F.col("doc_id").alias("row_ord"),
    )


def conversation_debates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """verse (the conversation), debate, closing_statements: users and assistants are linguists, the system moderates."""
    score = F.expr("cast(1 + length(text) % 10 as int)")
    linguist = json_text(F.struct(F.col("role").alias("agent_name"), F.col("text").alias("argument"), score.alias("proposed_score")))
    moderator = json_text(F.struct((F.col("conv_id") % 2 == 0).alias("intervene"), F.array("role").alias("violators"), F.col("text").alias("feedback")))
    said = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.when(F.col("role") == "system", moderator).otherwise(linguist).alias("json"), (F.col("role") != "system").alias("closes")).alias("t"))
    grouped = said.groupBy(F.col("conv_id").alias("verse")).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    closing = F.concat(F.array(F.lit(CLOSING_TASK)), F.transform(F.filter("ts", lambda x: x["closes"]), lambda x: x["json"]))
    return grouped.select("verse", F.to_json(F.transform("ts", lambda x: x["json"])).alias("debate"), F.to_json(closing).alias("closing_statements"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of 60 documents each with file_ord; verses come again in later items and reports. Report 3 has chapter 0."""
    individual = "named_struct('type', 'individual', 'model', source, 'score', cast(n_chars % 12 as int), 'reasoning', lang)"
    debate = "named_struct('type', 'debate', 'score', cast(n_chars % 11 as int), 'debate_transcript', array(), 'closing_statements', array(named_struct('agent', 'A', 'statement', source, 'score', if(n_chars % 5 = 0, null, 4))))"
    kind = SEGMENT["analysis"].dataType.simpleString()
    entries = f"if(doc_id % 3 = 0, from_json(to_json(array({individual})), '{kind}'), concat(from_json(to_json(array({individual})), '{kind}'), from_json(to_json(array({debate})), '{kind}')))"
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id div 60 as file_ord", f"named_struct('verse', cast(doc_id % 25 as int), 'greek', md5(text), 'translation', concat('tr ', doc_id), 'annotation', if(lang = 'de', null, source), 'notes', lang, 'analysis', {entries}) as segment")
    grouped = rows.groupBy("file_ord").agg(F.array_sort(F.collect_list(F.struct("doc_id", "segment"))).alias("items"))
    return grouped.select("file_ord", F.lit("Philemon").alias("book"), F.expr("cast(if(file_ord = 3, 0, file_ord % 7 + 1) as int)").alias("chapter"), F.lit("Letters").alias("category"), F.transform("items", lambda x: x["segment"]).alias("analysis"))


_AGENTS_SQL = ", ".join(f"({i}, '{a['name']}', '{a['model']}')" for i, a in enumerate(AGENTS))
#: White space of the verse text, for RE2.
SPACE_SQL = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
DOMAIN_SQL = rf"""
agents(idx, agent_name, model) as (values {_AGENTS_SQL}),
gt as (select (doc_id // 50 + 1)::int as chapter, (doc_id % 50 + 1)::int as verse, text as greek_text, case when lang = 'de' then null else source end as face, lang as notes, doc_id as row_ord, n_chars from documents),
gt_multi as (select chapter, ((row_ord % 50) % 37 + 1)::int as verse, greek_text, face, notes, row_ord, n_chars from gt),
verses as (select chapter, verse, text from (select chapter, verse, trim(regexp_replace(replace(greek_text, '\', ' '), '{SPACE_SQL}+', ' ', 'g')) as text from gt) where text <> ''),
individual as (select model, agent_name, chapter, verse, greek_text, 'tr ' || row_ord as translation, face as face_annotation, notes, (1 + (n_chars + 3 * idx) % 10)::int as score, agent_name || ' on ' || row_ord as model_analysis, row_ord * 2 + idx as row_ord from gt, agents),
individual_multi as (select model, agent_name, chapter, verse, greek_text, 'tr ' || row_ord as translation, face as face_annotation, notes, (1 + (n_chars + 3 * idx) % 10)::int as score, agent_name || ' on ' || row_ord as model_analysis, row_ord * 2 + idx as row_ord from gt_multi, agents),
debated as (select d.doc_id, (d.doc_id % 50 + 1)::int as verse, d.text as greek, case when d.lang = 'de' then null else d.source end as face, (1 + n_chars % 10)::int as a, (1 + (n_chars + 3 * quality) % 10)::int as b, toxic from labels l join documents d on l.doc_id = d.doc_id)
"""
