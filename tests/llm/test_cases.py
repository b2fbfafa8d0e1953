"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, in every stage and operator."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import decontaminate, exact_dedup, html_extract, langid, mixing, near_dedup, pii, substring_dedup, token_counts, token_output
from lectern.llm.coder import vocabulary_path
from tests.llm import plain

CLASHING = "x_id x_at x_row x_text x_copies x_rows x_k x_lang x_marks bucket payload at label key size part row rank copies words hit_words low host".split()
STAGES = dict(corpus_pipeline.STAGES)


def table(spark, rows):
    df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(5))
    rows = [(i, " ".join(word("abcd" if i % 2 else "wxyz") for _ in range(30)), "aa" if i % 2 else "ww", rng.choice(["s", "t", None])) for i in range(40)]
    rows += [rows[0], rows[0], rows[3], (None, rows[5][1], None, None), (None, rows[5][1], None, None), (50, None, "aa", "s"), (51, "", "ww", None), (52, " \n", None, "t"), (53, "12 !", "aa", "s"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, sf, odd, name):
    docs, stage = table(spark, odd), STAGES[name]
    out = stage(spark, docs, sf)
    empty = stage(spark, docs.limit(0), sf)
    assert empty.count() == 0
    if name == "tokens":
        want = plain.tokens([(i, t) for i, t, _, _ in odd], vocabulary_path())
        assert [tuple(r) for r in out.orderBy("start").collect()] == want
        return
    assert out.columns == docs.columns == empty.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got = out.collect()
    assert got and all(r[c] == f"own {c}" for r in got for c in CLASHING)
    said = sorted((str(r.doc_id), str(r.text)) for r in got)
    rows = [(i, t) for i, t, _, _ in odd]
    if name == "language":
        assert said == sorted((str(i), str(t)) for i, t in rows if t and any(c.isalpha() for c in t))
    if name == "near_duplicates":
        firsts = {i for i, _, _, kept in plain.near([(i, t) for i, t in dict(rows).items() if i is not None], 5, 80) if kept}
        assert said == sorted((str(i), str(t)) for i, t in rows if i is None or i in firsts)
    if name == "benchmark_free":
        assert said == sorted((str(i), str(t)) for i, t in rows)
    if name == "mixture":
        took = mixing.copies(docs).select(F.sum("copies"), F.sum(F.col("copies") * F.col("size"))).first()
        assert (len(got), sum(len(plain.words(r.text)) for r in got)) == tuple(took)


def test_operators_leave_clashing_columns_alone(spark, odd):
    docs = table(spark, odd)
    bench = spark.createDataFrame([(1, odd[0][1], "x", "y")], "item_id long, text string, x_text string, doc_id string")
    n = len(odd)
    for out in (substring_dedup.dedup_substrings(docs), exact_dedup.dedup_exact(docs), decontaminate.contamination(docs, bench), langid.identify(docs), pii.find(docs), near_dedup.near_components(docs), mixing.copies(docs), token_output.write_and_digest(docs)):
        assert out.count() == n
    assert token_counts.histogram(docs).agg(F.sum("n_docs")).first()[0] == n
    assert decontaminate.clean(docs, bench).count() == n - 3  # the item itself, three times


def test_very_long_texts(spark):
    """Texts of some megabytes: words, one word without an end, one word over and over, one long page."""
    rng = random.Random(5)
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(50000)}" for _ in range(300_000)]
    long = " ".join(words)
    rows = [(1, long, "aa", "s"), (2, f"{long} end", "aa", "s"), (3, "x" * 3_000_000, "xx", "s"), (4, "so " * 700_000, "xx", None), (5, "so " * 1000, "xx", None), (6, "0a1" * 700_000, "xx", None)]
    docs, plain_rows = table(spark, rows), [(i, t) for i, t, _, _ in rows]
    found = lambda df, *columns: sorted(tuple(r) for r in df.select(*columns).collect())
    assert found(substring_dedup.dedup_substrings(docs), "doc_id", "n_words", "n_removed") == [(1, 300000, 0), (2, 300001, 300000), (3, 1, 0), (4, 700000, 0), (5, 1000, 1000), (6, 1, 0)]
    assert found(exact_dedup.dedup_exact(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == plain.exact(plain_rows)
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_components(docs).collect()}
    assert near == {1: (len(plain.shingles(long, 5)), 1), 2: (len(plain.shingles(long, 5)) + 1, 1), 3: (1, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6)}
    item = " ".join(words[200_000:200_030])
    hits = {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert hits == {1: 30, 2: 30, 3: 0, 4: 0, 5: 0, 6: 0}
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}.keys() == {1, 2, 3, 4, 5, 6}
    assert {r.doc_id: r.n_email + r.n_card + r.n_phone for r in pii.find(docs).collect()} == dict.fromkeys(range(1, 7), 0)
    want = plain.tokens([r for r in plain_rows if r[0] != 6], vocabulary_path())
    assert [tuple(r) for r in token_output.write_and_digest(docs.filter("doc_id <> 6")).orderBy("doc_id").collect()] == want
    assert {r.length for r in token_counts.histogram(docs.filter("doc_id <> 6")).collect()} == {n - 1 for _, _, n, _ in want}
    html = f"<body><nav>menu</nav><article><p>{'</p><p>'.join(words)}</p></article></body>"
    got = html_extract.extract(spark.createDataFrame([(1, "http://a.example", html)], "page_id long, url string, html string")).first()
    assert got.text == "\n".join(words)


@pytest.mark.parametrize("few", [0, 10**6])
def test_near_dedup_with_and_without_broadcasts(spark, documents, monkeypatch, few):
    """However many edges and ids one task or a broadcast may hold."""
    from lectern.llm import common
    from tests.llm.test_operators import edited

    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(common, "BROADCAST_IDS", few)
    docs = edited(4, 90, 9)
    got = near_dedup.near_components(documents(*docs), 85, 3)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == plain.near(docs, 3, 85)
    assert sorted(r.doc_id for r in near_dedup.keep(documents(*docs), 85, 3).collect()) == [i for i, _, _, kept in plain.near(docs, 3, 85) if kept]
