"""Words made to clash, and hashes cut to 8 bits: results stay those of the words. Workers are other processes and don't
see what a test patches, so patched cases run the operators' functions of batches in this one."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import common, near_dedup, substring_dedup, token_counts, token_output
from lectern.llm.coder import Coder, vocabulary_path
from lectern.llm.words import Digests, Known, Words
from tests.llm import plain


def thue_morse(n, letters="ab"):
    """A word of n letters and its complement, which sums of powers modulo 2**64 can't tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


PAIRS = [thue_morse(1024), thue_morse(4096), thue_morse(1024, "xé")]


@pytest.fixture(params=["hash", "8 bits"])
def hashes(request, monkeypatch):
    if request.param == "8 bits":
        whole = Words.hashes
        monkeypatch.setattr(Words, "hashes", lambda self, seed=0: whole(self, seed) & np.uint64(255))


def text_words(texts):
    return Words(*common.buffers(pa.array(texts, pa.string())))


def test_hashes_of_made_words():
    words = text_words([w for pair in PAIRS for w in pair])
    for seed in (0, 1):
        assert len(set(words.hashes(seed).tolist())) == len(words)


def test_known_words(hashes):
    texts = [" ".join(f"w{i % 700}" for i in range(2000)), " ".join(w for pair in PAIRS for w in pair), "a\x00 a b a\x00\x00 b"]
    known, named = Known(), {}
    for text in (*texts, *reversed(texts)):
        words = text_words([text])
        place, new = known.places(words)
        for k in range(len(words)):
            assert named.setdefault(words.word(k), place[k]) == place[k]
        assert len(set(named.values())) == len(named) == len(known)
        assert [place[i] for i in new] == list(range(len(known) - len(new), len(known)))


def test_ids_of_made_words(hashes):
    from tokenizers import Tokenizer

    texts = [*(w for pair in PAIRS for w in pair), " ".join(f"{i * i} so{i % 300}" for i in range(900)), "", "don't stop"]
    coder, want = Coder(vocabulary_path()), Tokenizer.from_file(vocabulary_path())
    for _ in range(2):
        words = text_words(texts)
        ids, counts = coder.encode(words)
        run = np.append(0, np.cumsum(counts))
        assert [ids[run[a] : run[b]].tolist() for a, b in zip(words.bounds[:-1], words.bounds[1:])] == [want.encode(t, add_special_tokens=False).ids for t in texts]
        assert coder.lengths(words).tolist() == counts.tolist()


def test_shingles_of_made_words(hashes):
    texts = [f"one {w} two three {w}" for pair in PAIRS for w in pair] + [" ".join(f"w{i % 40}" for i in range(300))] * 2
    value, bounds = near_dedup.shingle_sets(*common.buffers(pa.array(texts)), 3)
    sets = [set(value[bounds[i] : bounds[i + 1]].tolist()) for i in range(len(texts))]
    for x, a in zip(texts, sets, strict=True):
        for y, b in zip(texts, sets, strict=True):
            assert len(a & b) == len(plain.shingles(x, 3) & plain.shingles(y, 3))


def test_digests_start_afresh():
    digests = Digests(limit=3)
    for texts in (["a b c d"], ["e a"], ["a b c d"]):
        words = text_words(texts)
        assert digests.of(words).tolist() == Digests().of(words).tolist()


def removed(docs, window=50, batch=7, buckets=4):
    """The operator's functions one after the other, as Spark runs them."""

    def grouped(rows):
        out = defaultdict(list)
        for r in rows:
            out[r["doc_id"]].append(r["at"])
        return out

    def exchanged(sent, meet):
        held = defaultdict(list)
        for r in sent:
            held[r["bucket"]].append(r)
        return grouped(m for rows in held.values() for m in meet(pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("payload", pa.binary())]))).to_pylist())

    def mapped(run, rows, schema):
        tasks = [rows[k : k + batch] for k in range(0, len(rows), batch)]
        return [r for t in tasks for b in run(iter([pa.RecordBatch.from_pylist(t, schema)])) for r in b.to_pylist()]

    text = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    rows = [{"doc_id": i, "text": t or ""} for i, t in docs]
    near = exchanged(mapped(substring_dedup._probes(buckets, window), rows, text), substring_dedup._meet(False))
    marked = text.append(pa.field("at", pa.list_(pa.binary())))
    found = exchanged(mapped(substring_dedup._windows(buckets, window), [r | {"at": near[r["doc_id"]]} for r in rows if r["doc_id"] in near], marked), substring_dedup._meet(True))
    cut = mapped(substring_dedup._cut(window), [r | {"at": found.get(r["doc_id"], [])} for r in rows], marked)
    listed = mapped(substring_dedup._listed(window), [r | {"at": found[r["doc_id"]]} for r in rows if r["doc_id"] in found], marked)
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], plain.sha(r["kept_text"])) for r in cut), listed


@pytest.mark.parametrize("flush", [10**6, 300])
def test_repeats_of_made_words(hashes, monkeypatch, flush):
    from tests.llm.test_operators import corpus

    monkeypatch.setattr(substring_dedup, "FLUSH", flush)
    monkeypatch.setattr(common, "SLICE_BYTES", 2000)
    around = " ".join(f"n{i}" for i in range(49))
    docs = [(1000 + k, f"{around} {w} end") for k, w in enumerate(w for pair in PAIRS for w in pair)]
    docs += [(2000, "so " * 400), (2001, "so " * 333 + "la " * 120), (2002, "ti ta " * 90), (2003, "x " + "ti ta " * 70 + "la " * 60)]
    docs += [(i, t) for i, t in corpus(3, 80)]
    got, listed = removed(docs)
    assert got == plain.substrings(docs)
    words = {i: plain.words(t) for i, t in docs}
    assert len(listed) > 10
    for r in listed:
        mine, source = words[r["doc_id"]], words[r["source_id"]]
        windows = {tuple(source[k : k + 50]) for k in range(len(source) - 49)}
        assert r["source_id"] < r["doc_id"] and r["length"] >= 50
        assert all(tuple(mine[k : k + 50]) in windows for k in range(r["start"], r["start"] + r["length"] - 49))


def test_operators_on_made_words(spark, documents):
    around = " ".join(f"n{i}" for i in range(60))
    docs = [(k, f"{around} {w} {around[:9]}") for k, w in enumerate(w for pair in PAIRS for w in pair)]
    docs += [(50 + k, w) for k, w in enumerate(w for pair in PAIRS for w in pair)]
    df = documents(*docs)
    found = lambda df, *columns: sorted(tuple(r) for r in df.select(*columns).collect())
    assert found(substring_dedup.dedup_substrings(df), "doc_id", "n_words", "n_removed", "kept_sha256") == plain.substrings(docs)
    assert found(near_dedup.near_components(df, 85, 3), "doc_id", "n_shingles", "component_id", "kept") == plain.near(docs)
    want = plain.tokens(docs, vocabulary_path())
    assert [tuple(r) for r in token_output.write_and_digest(df).orderBy("doc_id").collect()] == want
    lengths = [n - 1 for _, _, n, _ in want]
    assert {r.length: r.n_docs for r in token_counts.histogram(df).collect()} == {k: lengths.count(k) for k in lengths}
