"""Registered queries beside their SQL, and the pipeline beside its plain version."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import langid, registry, token_output
from lectern.llm.coder import vocabulary_path
from tests.llm import plain
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf, name):
    same(registry.QUERIES[name](spark, sf), registry.SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_is_whole(spark, sf, name):
    got = registry.QUERIES[name](spark, sf)
    if name != "op5_token_counts":
        table = "pages" if name.startswith(("op6", "op12")) else "documents"
        assert got.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_token_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = token_output.op10_token_output(spark, sf)
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == plain.tokens(docs, vocabulary_path())


def test_pipeline(spark, sf, documents):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(2).select(F.lit(10**6).cast("long").alias("doc_id"), F.lit("12 !").alias("text"), "lang", "source", "n_chars")
    docs = docs.unionByName(odd)
    stage = dict(corpus_pipeline.STAGES)
    spoken = stage["language"](spark, docs, sf)
    assert spoken.columns == docs.columns and spoken.count() == docs.count() - 2
    kept = stage["near_duplicates"](spark, spoken, sf)
    want = sorted(i for i, _, _, stays in plain.near([(r.doc_id, r.text) for r in spoken.collect()], 5, 80) if stays)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want
    clean = stage["benchmark_free"](spark, kept, sf)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = {i: n_hit / n for i, n, n_hit, *_ in plain.contaminated([(r.doc_id, r.text) for r in kept.collect()], bench) if n}
    got = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == docs.columns and set(got) == {i for i in want if hits.get(i, 0) <= 0.5}
    before = {r.doc_id: r.text for r in kept.collect()}
    assert all((got[i] == before[i]) == (hits.get(i, 0) == 0) for i in got)
    mixed = stage["mixture"](spark, clean, sf)
    assert mixed.columns == docs.columns and mixed.count() > 0
    ids = stage["tokens"](spark, mixed, sf)
    assert [tuple(r) for r in ids.orderBy("start").collect()] == plain.tokens([(r.doc_id, r.text) for r in mixed.collect()], vocabulary_path())


def test_learns_only_from_its_part(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    turned = docs.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert langid.train(docs, 10**9) is not None
    langs = {r.lang_pred for r in langid.identify(turned).collect()}
    assert "zz" not in langs
