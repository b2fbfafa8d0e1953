"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

A text, its white space normalised, is cut into chunks of 512 to 8192 characters that end where the characters say
so, not where a count does, so an insertion moves few cuts. Each distinct chunk text moves once from each task to
the chunk dictionary, which verifies that a chunk's 64-bit identifier belongs to one text only; identifiers that
don't get the rank of the text among those that share them. Whole texts are never shuffled: two documents are equal
when their lists of verified identifiers are.

Cases: a null text is the empty text, whose recipe is empty; rows without a doc_id never displace others, and are
kept where all of their group are such rows; rows that repeat doc_id and text count in group_size and share kept; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common

SPACE = r"[\x20\x09-\x0D]+"
#: About half of the characters of digits, hexadecimal and base64 text, of nucleotides and of scripts without spaces.
HALF = r"0-4a-ch-pA-CH-P\u0E01-\u0E1F\u0E81-\u0E9F\u1000-\u1018\u1780-\u1798\u3041-\u3068\u30A1-\u30C8\u4E00-\u65FF\uAC00-\uC0FF"
#: A cut follows a letter or digit, a space or stop and a character outside e-s, at 512 characters or more; in text that
#: went on for 32 characters without a space or stop, three characters of HALF and three others. Without either before
#: 8192 characters it is there.
CHUNK = rf"(?s).{{512,8192}}?(?:(?<=[\p{{L}}\p{{N}}][ .,;:!?][^e-s])|(?<=[^ .,;:!?]{{26}}[{HALF}]{{3}}[^ .,;:!?{HALF}]{{3}})|\z)|.{{1,8192}}"


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE, " ")


def _identifier(chunk: Column, bits: int) -> Column:
    return F.xxhash64(chunk) if bits == 64 else F.xxhash64(chunk).bitwiseAND(F.lit((1 << bits) - 1))


def _chunks(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.regexp_extract_all(normalised(), F.lit(CHUNK), F.lit(0)).alias("chunks"))


def dictionary(docs: DataFrame, bits: int = 64) -> DataFrame:
    """id, rank, chunk, copies: one row for each distinct chunk text. (id, rank) identifies it."""
    distinct = _distinct(docs, bits)
    several = distinct.groupBy("id").count().filter("count > 1").select("id")
    ranked = distinct.join(several, "id", "left_semi").withColumn("rank", F.expr("row_number() over (partition by id order by chunk)"))
    return distinct.join(several, "id", "left_anti").withColumn("rank", F.lit(1)).unionByName(ranked).select("id", "rank", "chunk", "copies")


def _distinct(docs: DataFrame, bits: int) -> DataFrame:
    pieces = _chunks(docs).select(F.explode("chunks").alias("chunk"))
    return pieces.groupBy(_identifier(F.col("chunk"), bits).alias("id"), "chunk").agg(F.count(F.lit(1)).alias("copies"))


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, recipe (ordered ids), ranks (of those chunks whose id several texts share, by position; else empty) and
    text_sha256, a row for each document."""
    docs = docs.select("doc_id", "text")
    shared = common.table(_distinct(docs, bits).groupBy("id").count().filter("count > 1").select("id"), "shared")
    both = docs.select("doc_id", normalised().alias("text"))
    both = both.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.regexp_extract_all("text", F.lit(CHUNK), F.lit(0)).alias("chunks"))
    plain = both.select("doc_id", "text_sha256", F.transform("chunks", lambda c: _identifier(c, bits)).alias("recipe"))
    if not shared.head(1):
        return common.table(plain.select("doc_id", "recipe", F.expr("cast(array() as array<string>)").alias("ranks"), "text_sha256"), "recipes")
    # Identifiers that several texts share: their chunks' ranks complete the recipes of the documents that hold them.
    ranks = dictionary(docs, bits).filter("rank > 1").select("id", "rank", "chunk")
    pieces = both.select("doc_id", "text_sha256", F.posexplode("chunks").alias("pos", "chunk")).withColumn("id", _identifier(F.col("chunk"), bits))
    fixes = pieces.join(ranks, ["id", "chunk"]).dropDuplicates(["doc_id", "text_sha256", "pos"]).groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_list(F.struct("pos", "rank"))).alias("fix"))
    fixes = fixes.select("doc_id", "text_sha256", F.transform("fix", lambda x: F.concat_ws(":", x["pos"], x["rank"])).alias("ranks"))
    same = plain["doc_id"].eqNullSafe(fixes["doc_id"]) & (plain["text_sha256"] == fixes["text_sha256"])
    joined = plain.join(fixes, same, "left").select(plain["doc_id"], "recipe", F.coalesce("ranks", F.expr("cast(array() as array<string>)")).alias("ranks"), plain["text_sha256"])
    return common.table(joined, "recipes")


def dedup_exact(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document (doc_id, text)."""
    listed = recipes(docs, bits)
    groups = listed.groupBy("recipe", "ranks").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    groups = common.table(groups, "groups")  # read back, so that the join can split a hot group
    out = listed.join(groups, ["recipe", "ranks"], "left")
    keep = F.coalesce("keep_id", "doc_id")
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as x from documents),
g as (select x, min(doc_id) as keep_id, count(*) as n from t group by x)
select t.doc_id, g.keep_id, g.n as group_size, t.doc_id = g.keep_id as kept, sha256(t.x) as text_sha256
from t join g on t.x = g.x
"""
