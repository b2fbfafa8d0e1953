"""A training corpus from the documents: five stages, each an operator of lectern.llm applied to all that the stage
before it kept.

Each stage reads the table that the last one wrote, so a lost executor costs no more than tasks of one stage. All stages
but the last return the columns that they were given, whatever else these are called (columns beside doc_id, text, lang,
source and n_chars pass untouched), and an empty table stays empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import common, decontaminate, langid, mixing, near_dedup, token_output


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language. Null and empty texts and texts without a letter have none, and none has one where no
    language can be learned; repeated rows stay or go together, rows without doc_id or lang are judged by their text."""
    return langid.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id. Words and threshold are the
    pipeline's defaults for shingles: five words, 0.8. Texts without words and rows without a doc_id stay, repeated rows
    stay or go together."""
    return near_dedup.keep(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; documents that are mostly such passages go. A null text stays null, repeated rows are
    cut alike, an empty benchmark cuts nothing, items without words or an item_id are no reason to fail."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's share asks for. Null is a source; null and empty texts have size 0 and are taken
    as their place among the sizes asks; repeated rows and rows without a doc_id share their copies out."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and from them doc_id, start, n_tokens, ids_crc32. A null or empty text is the end id alone, rows without
    a doc_id come first, repeated rows follow one another."""
    return token_output.write_and_digest(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_free", benchmark_free), ("mixture", mixture), ("tokens", tokens)]

#: SQL can express neither the context trees nor the tokenizer: tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.table(docs, f"stage-{name}")
    return docs
