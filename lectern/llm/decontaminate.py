"""Benchmark decontamination by a generalised suffix automaton of the test items.

Items and documents are cut into the same normalised words. One automaton holds every word sequence of a block of
items; a document's words stream through it, and the length of the longest match that ends at each word tells which
windows occur there. Only stretches of words that can hold a window reach the automaton: each of their word triples
must have the hash of some item's triple, which numpy sees over whole slices of text; the automaton itself compares words.

Nothing is shuffled. A task's one worker holds the triples of all blocks of items (of BLOCK_WORDS words, short items
together) and the automaton of one block at a time, which it builds when some of the texts before it may hold a window of
that block. A pass over the documents takes PASS_WORDS words of items, and the driver holds those of one pass at a
time; where there are more, each pass is written and the next one reads it, so the number of items has no bound.

Cases: null and empty texts have no words and no hits; items without words are no windows; items without an item_id
still mark words but are not named; repeated items count once; an empty benchmark hits nothing; columns of the
documents other than doc_id and text pass through clean() untouched and are not read elsewhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import common
from lectern.llm.words import FOLDED, Words, positions, window_hashes

WINDOW = 10
#: Words of the items that one automaton holds, and that one pass over the documents looks for.
BLOCK_WORDS = 100_000
PASS_WORDS = 5_000_000
#: Slices of text that wait for the automaton of a block.
WAITING = 16
#: clean() drops a document with more than this share of its words hit, and removes the hit words of the others.
MAX_COVERAGE = 0.5


def folded_words(text: str) -> list[bytes]:
    raw = np.frombuffer(text.encode(), np.uint8)
    words = Words(raw, np.array([0, len(raw)]), FOLDED, lower=True)
    return [words.word(i) for i in range(len(words))]


class Automaton:
    """All word sequences of the items; which items hold the one that a state's length-window suffix is."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for name, words in items:
            coded.append((name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.base = [0] * len(order)  # the state of the suffix of window words
        for v in order:
            if self.length[v] >= window:
                self.base[v] = v if self.length[self.link[v]] < window else self.base[self.link[v]]
        self.items: dict[int, set[str]] = {}
        own: dict[int, list[tuple[int, str | None]]] = {}
        for name, codes in coded:
            v = 0
            for i, c in enumerate(codes):
                v = self.next[v][c]
                if i + 1 >= window:
                    found = self.items.setdefault(self._up(v), set())
                    if name is not None:
                        found.add(name)
            if 0 < len(codes) < window:
                own.setdefault(v, []).append((len(codes), name))
        self.short: dict[int, list[tuple[int, str | None]]] = {}  # whole items shorter than a window, of a state and those it links to
        if own:
            for v in order[1:]:
                if both := own.get(v, []) + self.short.get(self.link[v], []):
                    self.short[v] = both
        lengths = [len(codes) for _, codes in coded if codes]
        self.least = min([window, *lengths]) if lengths else 0

    def _up(self, v: int) -> int:
        while self.length[self.link[v]] >= self.window:
            v = self.link[v]
        return v

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        cur = self._state({}, 0, self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        new = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _state(self, after: dict[int, int], link: int, length: int) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def stream(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """(for each word: does an occurring window cover it, the items that have such windows)."""
        hit, found = np.zeros(len(words) + 1, np.int64), set()
        v = n = 0
        for i, w in enumerate(words):
            c = self.vocabulary.get(w, -1)
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if c in self.next[v]:
                v, n = self.next[v][c], n + 1
            else:
                v = n = 0
            if n >= self.window:
                hit[i + 1 - self.window] += 1
                hit[i + 1] -= 1
                found |= self.items[self.base[v]]
            for m, name in self.short.get(v, ()):
                if m <= n:
                    hit[i + 1 - m] += 1
                    hit[i + 1] -= 1
                    if name is not None:
                        found.add(name)
        return np.cumsum(hit)[:-1] > 0, found


class Block:
    """Some of the items: the hashes of their word grams, and on demand their automaton."""

    def __init__(self, items: tuple, window: int):
        self.items, self.window = items, window
        data, offsets = common.buffers(pa.array([text for _, text in items], pa.string()))
        words = Words(data, offsets, FOLDED, lower=True)
        some = words.counts[words.counts > 0]
        self.least = min(window, int(some.min())) if len(some) else 0  # words of the shortest window
        self.gram = min(3, self.least)
        self.grams = np.unique(_grams(words, self.gram)[1]) if self.least else np.zeros(0, np.uint64)

    def automaton(self) -> Automaton:
        return Automaton([(name, folded_words(text)) for name, text in self.items], self.window)

    def stretches(self, words: Words, spots: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, first word, end) of all stretches that may hold a window. spots: words where some grams (keys) begin."""
        spots = spots[_among(keys, self.grams)]
        if not len(spots):
            return
        text = np.searchsorted(words.bounds, spots, "right") - 1
        new = np.append(True, (np.diff(spots) > 1) | (np.diff(text) > 0))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(spots)) - 1
        long = spots[last] - spots[first] >= self.least - self.gram
        for lo, hi in zip(first[long], last[long], strict=True):
            yield int(text[lo]), int(spots[lo]), int(spots[hi]) + self.gram


def _grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, hashes) of the grams of n words inside one text."""
    at, _ = positions(words.bounds, n)
    return at, window_hashes(words.hashes(), n, at)


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


_held: dict = {}


def _blocks(name: str, listed: list[tuple], window: int) -> list[Block]:
    """The blocks of a pass; a worker keeps those of the last one."""
    if _held.get("name") != name:
        _held.clear()
        _held.update(name=name, blocks=[Block(x, window) for x in listed])
    return _held["blocks"]


def _built(blocks: list[Block], k: int) -> Automaton:
    if _held.get("built") != k:
        _held.update(built=k, automaton=blocks[k].automaton())
    return _held["automaton"]


def _scan(name: str, listed: list[tuple], window: int):
    """Adds n_words, hit_words and hit_items; joins them to those of an earlier pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.hold("items", _held.clear)
        blocks = _blocks(name, listed, window)
        every = {n: np.unique(np.concatenate([b.grams for b in blocks if b.gram == n])) for n in {b.gram for b in blocks if b.least}}
        slices = common.slices(batches, "x_text")
        while some := list(islice(slices, WAITING if len(blocks) > 1 else 1)):
            texts = [Words(data, offsets, FOLDED, lower=True) for _, data, offsets in some]
            asked: dict[int, list] = {}
            for i, words in enumerate(texts):
                for n, known in every.items():
                    at, keys = _grams(words, n)
                    met = _among(keys, known)
                    for k, block in enumerate(blocks if met.any() else ()):
                        if block.gram == n and (found := list(block.stretches(words, at[met], keys[met]))):
                            asked.setdefault(k, []).append((i, found))
            hits: list[dict[int, list[np.ndarray]]] = [{} for _ in some]
            names: list[dict[int, set[str]]] = [{} for _ in some]
            for k, parts in asked.items():
                automaton = _built(blocks, k)
                for i, found in parts:
                    words = texts[i]
                    for text, lo, hi in found:
                        covered, said = automaton.stream([words.word(j) for j in range(lo, hi)])
                        if covered.any():
                            hits[i].setdefault(text, []).append(np.flatnonzero(covered) + lo - words.bounds[text])
                            names[i].setdefault(text, set()).update(said)
            for (rows, _, _), words, hit, said in zip(some, texts, hits, names, strict=True):
                yield _with_hits(rows, words, hit, said)

    return run


def _with_hits(rows: pa.RecordBatch, words: Words, hits: dict, names: dict) -> pa.RecordBatch:
    old_hits, old_names = rows.column("x_hits"), rows.column("x_items")
    all_hits, all_names = [], []
    for i in range(rows.num_rows):
        before = old_hits[i].as_py() or []
        all_hits.append(np.unique(np.concatenate([np.array(before, np.int64), *hits[i]])).astype(np.int32) if i in hits else before)
        all_names.append(sorted({*(old_names[i].as_py() or []), *names.get(i, ())}))
    out = {n: rows.column(n) for n in rows.schema.names} | {"x_words": pa.array(words.counts, pa.int64()), "x_hits": pa.array(all_hits, pa.list_(pa.int32())), "x_items": pa.array(all_names, pa.list_(pa.string()))}
    return pa.record_batch(list(out.values()), list(out))


def _passes(items: DataFrame) -> Iterator[list[tuple]]:
    """Blocks of items (item_id, text), shortest items first, a list of them for each pass."""
    blocks: list[tuple] = []
    block: dict[tuple, None] = {}
    n = total = 0
    listed = items.select(F.col("item_id").cast("string"), common.text_or_empty()).distinct()
    for name, text in listed.orderBy(F.length("text"), "item_id", "text").toLocalIterator():
        size = len(text.split()) + 1
        block[name, text] = None
        n, total = n + size, total + size
        if n >= BLOCK_WORDS:
            blocks.append(tuple(block))
            block, n = {}, 0
        if total >= PASS_WORDS:
            yield [*blocks, tuple(block)] if block else blocks
            blocks, block, n, total = [], {}, 0, 0
    if block:
        blocks.append(tuple(block))
    yield blocks


def scan(docs: DataFrame, items: DataFrame, keep: list[str], window: int = WINDOW, then: Callable | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """A struct x_row of the columns keep of docs, and x_text, x_words (how many), x_hits (indices of hit words,
    ascending), x_items (ids of items with occurring windows, as sorted strings). then, a function of batches that
    leaves columns of these, runs in the worker of the last pass, so that a task needs one worker."""
    common.session_paths(docs.sparkSession)
    held = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("x_row")
    out = docs.select(held, F.col("text").alias("x_text"), F.lit(0).cast("long").alias("x_words"), F.expr("cast(array() as array<int>)").alias("x_hits"), F.expr("cast(array() as array<string>)").alias("x_items"))
    schema = out.schema
    last = None
    for blocks in _passes(items):
        if last is not None:
            out = common.table(out.mapInArrow(_scan(uuid.uuid4().hex, last, window), schema), "scanned")
        last = blocks
    run = _scan(uuid.uuid4().hex, last, window)
    if then is None:
        return out.mapInArrow(run, schema)
    return out.mapInArrow(lambda batches: then(run(batches)), T.StructType([schema[c] for c in columns]))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and hit_words of every document."""
    out = scan(docs, items, ["doc_id"], window)
    return out.select(
        F.col("x_row.doc_id").alias("doc_id"),
        F.col("x_words").alias("n_words"),
        F.size("x_hits").cast("long").alias("n_hit"),
        F.size("x_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("x_items", ","), 256).alias("items_sha256"),
        (F.size("x_hits") > 0).alias("contaminated"),
        F.col("x_hits").alias("hit_words"),
    )


def _clean(max_coverage: float):
    """Drops texts with more than max_coverage of their words hit. Removes each run of hit words from the others,
    from the first's first byte to the last's last one: items shorter than a window make short runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = lambda b: pc.less_equal(pc.list_value_length(b.column("x_hits")).cast(pa.float64()), pc.multiply(b.column("x_words").cast(pa.float64()), max_coverage))
        for rows, data, offsets in common.slices((b.filter(share(b)) for b in batches), "x_text"):
            words = Words(data, offsets, FOLDED, lower=True) if pc.any(pc.greater(pc.list_value_length(rows.column("x_hits")), 0)).as_py() else None
            texts = []
            for i, (text, hits) in enumerate(zip(rows.column("x_text"), rows.column("x_hits"), strict=True)):
                if not len(hits):
                    texts.append(text.as_py())
                    continue
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                at = np.array(hits.as_py(), np.int64)
                parts, done = [], 0
                for one in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                    k = words.bounds[i] + one
                    parts.append(raw[done : words.starts[k[0]] - offsets[i]])
                    done = int(words.ends[k[-1]] - offsets[i])
                texts.append((b"".join(parts) + raw[done:]).decode())
            yield pa.record_batch([rows.column("x_row"), pa.array(texts, pa.string())], ["x_row", "x_text"])

    return run


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """The documents, with their own columns: those with more than max_coverage of their words hit are dropped, all
    hit words are cut out of the others' texts, n_chars (where there is one) follows the text.
    A null text stays null."""
    cut = scan(docs, items, [c for c in docs.columns if c != "text"], window, _clean(max_coverage), ("x_row", "x_text"))
    own = {"text": F.col("x_text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("x_text").isNotNull(), F.length("x_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("x_row.n_chars"))
    return cut.select(*[own.get(c, F.col(f"x_row.`{c}`")).alias(c) for c in docs.columns])


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).drop("hit_words")


_FOLD = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP3_SQL = rf"""
with items as (select item_id::varchar as item_id, {_FOLD} as w from benchmark
), item_windows as (
  select distinct item_id, array_to_string(w[i:i + 9], ' ') as s, least(len(w), 10) as n
  from (select item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) as i from items where len(w) > 0)
), docs as materialized (select doc_id, {_FOLD} as w from documents
), lengths as (select distinct n from item_windows
), starts as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, lengths where len(w) >= n)
), met as materialized (
  select t.doc_id, t.i, t.n, x.item_id from starts t join item_windows x on t.s = x.s and t.n = x.n
), hit as (
  select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from met) group by doc_id
), named as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from met) group by doc_id
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(n.n_items, 0)::bigint as n_items,
       sha256(coalesce(n.ids, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from docs d left join hit h on h.doc_id = d.doc_id left join named n on n.doc_id = d.doc_id
"""
