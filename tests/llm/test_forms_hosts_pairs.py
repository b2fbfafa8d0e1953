"""Fill-in-middle, URL filters and cross-tokenizer alignment beside their plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import common, cross_tokens, fill_middle, url_filters
from lectern.llm.coder import vocabulary_path
from tests.llm import plain
from tests.llm.test_cases import CLASHING, table

A, B = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", "é", "a é\u00a0b", "x<P>y", "<S>", "tail <", "M> head", "日本語 text 12", "a  b   c ", " lead", "tab\tand\nline\r\n", "\u3000 wide \u2028", "we'll it's '", "<s> </s> <unk> <|endoftext|>", "a\u2581b plain", "\u2581", "emoji 🎉🎉 👩‍👩‍👧", "e\u0301 n\u0303", "\x00 nul \x1c\x1f", "Привет мир", "हिन्दी पाठ", "123456 7,8.9", "x" * 5000, "ab " * 3000, "a\xa0 b", "\u200b zero", "ends in space "]


def made(rng, n):
    letters = "abcXYZ 012 .,éß日\u00a0\u3000\n\t<>PSM'🎉"
    return [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(60)))) for i in range(100, 100 + n)]


def odd_docs(n=150):
    rows = [*enumerate(ODD), *made(random.Random(4), n), (5, "again"), (5, "again"), (None, "no id"), (None, None)]
    return [(i, t, "aa", "s") for i, t in rows]


def found(df, *columns):
    return sorted(((r if isinstance(r, tuple) else tuple(r)) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("block, limit", [(1 << 20, 1 << 18), (7, 100)])
def test_fill_middle(spark, monkeypatch, block, limit):
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    monkeypatch.setattr(common, "SLICE_BYTES", limit)
    rows = odd_docs()
    docs = table(spark, rows).repartition(3)
    out = fill_middle.fill_in_middle(docs)
    want = plain.fill_middle([(i, t) for i, t, _, _ in rows])
    assert found(out, "row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output") == sorted(want, key=str)
    assert {f for _, _, f, *_ in want} == {"plain", "psm", "spm"}
    back = docs.select("doc_id", F.coalesce("text", F.lit("")))
    assert found(out, "row.doc_id", fill_middle.restored()) == found(back, "*")
    again = fill_middle.rewrite(docs)
    assert again.columns == docs.columns and all(r[c] == f"own {c}" for r in again.collect() for c in CLASHING)
    assert found(again, "doc_id", "text") == sorted(((i, o) for i, *_, o in want), key=str)
    assert fill_middle.rewrite(docs.limit(0)).count() == 0


def test_fill_middle_settings(spark, documents):
    rows = made(random.Random(8), 60)
    marks = ("[pre]", "[suf]", "[mid]")
    out = fill_middle.fill_in_middle(documents(*rows), marks=marks, rate=100, suffix_first=50)
    assert found(out, "row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output") == sorted(plain.fill_middle(rows, marks, 100, 50), key=str)
    assert found(out, "row.doc_id", fill_middle.restored(marks=marks)) == sorted(rows, key=str)
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "bc", "x"), ("aba", "c", "d"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(documents(*rows), marks=bad)


def test_fill_middle_long_text(spark, documents):
    text = "some words, é " * 300_000
    rows = [(i, text) for i in range(4)]
    out = fill_middle.fill_in_middle(documents(*rows))
    got = out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("o"), F.sha2(fill_middle.restored(), 256).alias("r")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(*x[:5], plain.sha(x[5]), plain.sha(text)) for x in plain.fill_middle(rows)]


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "deep.a.example.org", ""), ("allow", "a.example.org", "/x")]


def urls(seed=3, n=900):
    rng = random.Random(seed)
    hosts = [f"{x}{d}.{s}" for x in ("", "www.", "a.", "deep.a.") for d in ("example", "other", "third") for s in ("net", "com", "org", "co.uk")] + ["net", "1.2.3.4", "[::1]:80", "localhost", "user@a.example.org", "b.example.net:8080", "notexample.net", "x" * 300]
    paths = ["", "/", "/en/1", "/de/2?x=/en/", "/fr", "/fr/#a", "/x/y", "//", "/de/é"]
    rows = [(i, f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice([h, h.upper()])}{rng.choice(paths)}") for i, h in enumerate(rng.choices(hosts, [1 + k % 7 for k in range(len(hosts))], k=n))]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "no scheme/en/"), (n + 3, "http:/one"), (n + 4, "http://a://b/c"), (n + 5, "x\n://Line.example.NET/en/\nb"), (n + 6, "://"), (None, "http://example.net/en/"), (1, rows[1][1])]


@pytest.mark.parametrize("few", [0, None])
def test_url_filters(spark, monkeypatch, few):
    if few is not None:
        monkeypatch.setattr(common, "BROADCAST_IDS", few)
    rng = random.Random(6)
    rows = urls()
    bad_hosts = {"third.com": 0.9, "other.co.uk": 0.7}
    outcomes = {i: rng.random() < max([r for h, r in bad_hosts.items() if h in (u or "").lower()], default=0.05) for i, u in rows if i is not None and rng.random() < 0.6}
    pages = spark.createDataFrame(rows, "page_id long, url string").select("*", *[F.lit("own").alias(c) for c in ("host", "path", "bad", "n", "rule", "verdict", "rules", "mean")])
    labels = spark.createDataFrame([*outcomes.items(), (None, True), (10**9, True)], "label_key long, bad boolean")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    want = plain.verdicts(rows, outcomes, RULES)
    got = url_filters.judge(pages, labels, rules)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"] and found(got, "*") == sorted(want, key=str)
    assert {v for *_, r, v in want if r is None} == {"allow", "block"} and {r for *_, r, _ in want} == {None, *(h + p for _, h, p in RULES)}
    none = url_filters.judge(pages, labels.limit(0), url_filters.rule_table(spark, ()))
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "allow")} and none.count() == len(rows)
    assert url_filters.judge(pages.limit(0), labels, rules).count() == 0


def test_reputation(spark):
    """A host of few pages is near its domain's share, one of many near its own; bounds lie below means."""
    hosts = [(f"h{i}.bad.com", 20, 18) for i in range(8)] + [(f"h{i}.good.com", 20, 1) for i in range(8)] + [("new.bad.com", 0, 0), ("one.good.com", 1, 1), ("big.good.com", 5000, 4500)]
    got = {r.host: r for r in url_filters.reputation(spark.createDataFrame(hosts, "host string, n long, bad long")).collect()}
    assert got["new.bad.com"].mean > 0.6 and got["one.good.com"].mean < 0.9 and abs(got["big.good.com"].mean - 0.9) < 0.01
    assert all(0 <= r.low < r.mean for r in got.values()) and got["new.bad.com"].low < got["h1.bad.com"].low < got["big.good.com"].low
    assert got["h1.bad.com"].suffix == "com" and got["h1.bad.com"].domain == "bad.com"


def test_url_filters_native(spark, sf):
    """No Python in the plan."""
    from lectern.llm import registry

    plan = registry.QUERIES["op12_url_filters"](spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))


@pytest.mark.parametrize("pairs, limit, stretch, kept, large", [(10**7, 1 << 18, 1 << 20, 10**6, 4096), (0, 300, 1 << 20, 10**6, 0), (10**7, 60, 100, 5, 3), (0, 60, 100, 40, 4096)])
def test_cross_tokens(spark, monkeypatch, pairs, limit, stretch, kept, large):
    """With and without tables of counts in tasks, short and long slices, few and many chunks kept."""
    for name, value in (("PAIRS", pairs), ("STRETCH", stretch), ("KEPT", kept), ("LARGE", large), ("FLUSH", limit)):
        monkeypatch.setattr(cross_tokens, name, value)
    monkeypatch.setattr(cross_tokens, "SLICE", limit)
    rows = odd_docs(60)
    got = cross_tokens.align(table(spark, rows).repartition(2))
    want = plain.cross([(i, t) for i, t, _, _ in rows], A, B)
    assert found(got, "*") == sorted(want, key=str)
    assert sum(w[1] == 0 for w in want) >= 5 and sum(w[1] for w in want) > 5000


def test_cross_tokens_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(cross_tokens.op13_cross_tokens(spark, sf), "*") == sorted(plain.cross(docs, A, B), key=str)


def test_cross_tokens_empty(spark, documents):
    assert cross_tokens.align(documents((1, "x")).limit(0)).count() == 0
    assert [tuple(r) for r in cross_tokens.align(documents((1, None), (2, ""))).orderBy("doc_id").collect()] == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_groups():
    last_a, last_b = cross_tokens.groups(np.array([2, 3, 7, 9]), np.array([3, 5, 9]))
    assert last_a.tolist() == [1, 3] and last_b.tolist() == [0, 2]
