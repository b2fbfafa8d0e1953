"""Properties of the pure parts, over generated inputs."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import common, decontaminate, near_dedup, pii, token_output
from lectern.llm.coder import Coder, vocabulary_path
from lectern.llm.words import PLAIN, Words, from_planes, planes
from tests.llm import plain

many = settings(max_examples=300, deadline=None)
personal = st.text(alphabet="ab@.-_%+ 0123456789()é\n", max_size=80)


@many
@given(personal)
def test_spans_are_the_patterns(text):
    raw = text.encode()
    points = np.append(0, np.cumsum([(b & 0xC0) != 0x80 for b in raw])).astype(int)
    assert [f"{pii.KINDS[k]}:{points[s]}:{points[e]}" for s, k, e in pii.base_spans(raw)] == plain.personal(text)


@many
@given(st.lists(st.integers(0, 2**32 - 1), max_size=2000))
def test_codes_come_back(ids):
    ids = np.array(ids, np.uint32)
    assert (token_output.Segment(token_output.encode(ids)).all() == ids).all()


@many
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=50))
def test_planes_come_back(values):
    x = np.array(values, np.int64)
    assert (from_planes(np.frombuffer(planes(x), np.uint8), len(x), np.int64) == x).all()


small_words = st.lists(st.sampled_from(["a", "b", "c", "d"]), max_size=30)


@many
@given(st.lists(small_words, max_size=4), small_words, st.integers(1, 5))
def test_automaton_finds_windows(items, doc, window):
    named = [(str(i), " ".join(w)) for i, w in enumerate(items)]
    automaton = decontaminate.Automaton([(n, decontaminate.folded_words(t)) for n, t in named], window)
    got, found = automaton.stream([w.encode() for w in doc])
    (_, n, hits, _, names, _), = plain.contaminated([(0, " ".join(doc))], named, window)
    assert (len(got), int(got.sum()), plain.sha(",".join(sorted(found)))) == (n, hits, names)
    words = Words(*common.buffers(pa.array([" ".join(doc)])), decontaminate.FOLDED, lower=True)
    block = decontaminate.Block(tuple(named), window)
    inside = np.zeros(len(doc), bool)
    for _, lo, hi in block.stretches(words, *decontaminate._grams(words, block.gram)) if block.least else ():
        inside[lo:hi] = True
    assert not (got & ~inside).any()


@many
@given(st.lists(st.text(alphabet="aB \t\n\x0b  é日", max_size=30), max_size=6))
def test_words_are_split(texts):
    data, offsets = common.buffers(pa.array(texts, pa.string()))
    words = Words(data, offsets, PLAIN)
    assert [[words.word(k).decode() for k in range(words.bounds[i], words.bounds[i + 1])] for i in range(len(texts))] == [plain.words(t) for t in texts]


@many
@given(st.lists(st.lists(st.sampled_from(["a", "B", "b", "c"]), max_size=12), min_size=1, max_size=5), st.integers(1, 5))
def test_shingle_sets(docs, n):
    texts = [" ".join(d) for d in docs]
    value, bounds = near_dedup.shingle_sets(*common.buffers(pa.array(texts)), n)
    assert np.diff(bounds).tolist() == [len(plain.shingles(t, n)) for t in texts]
    sets = [set(value[bounds[i] : bounds[i + 1]].tolist()) for i in range(len(texts))]
    for x, a in zip(texts, sets, strict=True):
        for y, b in zip(texts, sets, strict=True):
            assert len(a & b) == len(plain.shingles(x, n) & plain.shingles(y, n))


_coder = []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=8))
def test_word_ids_are_text_ids(texts):
    from tokenizers import Tokenizer

    if not _coder:
        _coder.extend([Coder(vocabulary_path()), Tokenizer.from_file(vocabulary_path())])
    texts = [t for t in texts if all(not 0xD800 <= ord(c) < 0xE000 for c in t)] or ["x"]
    words = Words(*common.buffers(pa.array(texts)))
    ids, counts = _coder[0].encode(words)
    run = np.append(0, np.cumsum(counts))
    got = [ids[run[words.bounds[i]] : run[words.bounds[i + 1]]].tolist() for i in range(len(texts))]
    assert got == [_coder[1].encode(t, add_special_tokens=False).ids for t in texts]
