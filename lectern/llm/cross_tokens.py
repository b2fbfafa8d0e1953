"""Cross-tokenizer alignment by elementary intervals.

Both tokenizers part a text at a single space behind a character that is no white space: no token of either spans that
place, and what stands on one side doesn't change the ids of the other. A text is taken in such stretches (chunks, each led
by a space); the distinct ones of a batch are encoded and aligned together, and those seen lately are kept.

Aligning: the ends of both tokenizers' tokens are byte offsets on one axis. union1d of the two arrays gives the elementary
intervals, searchsorted the token of either side that owns each; an interval is one overlap, an end that both arrays have
closes a group, and the pairs of a group are the product of its tokens. A chunk's end is an end of both, so groups don't
leave chunks.

Counts: each task counts in how many of its documents an id pair is linked, Spark adds up, and a second pass over the
texts meets them as two sorted arrays of at most PAIRS entries (17 bytes each; pairs are bounded by the product of the
vocabularies, not by documents). Beyond PAIRS, each document's pairs are joined to the counts instead.

Cases: null and empty texts and texts that a tokenizer doesn't give back byte by byte have no tokens: zeros and an empty
hash; rows without a doc_id and repeated rows are documents like any other; a long text is taken stretch by stretch; a
group with many tokens is expanded by its distinct ids; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import common
from lectern.llm.coder import vocabulary_path
from lectern.llm.words import Known, Words

#: Rows of the table of counts that tasks hold.
PAIRS = 4_000_000
#: Chunks that a worker keeps.
KEPT = 500_000
#: Bytes of chunks that one call of a tokenizer gets, and of a long text that are looked at at once.
CALL_BYTES, STRETCH = 1 << 15, 1 << 20
#: Bytes of text of a pass.
SLICE = 1 << 20
#: Pairs of a group above which its ids are counted first.
LARGE = 4096
#: Pairs and counts that a task holds before it hands them on.
FLUSH = 1_000_000

_plain = np.zeros(256, bool)
_plain[0x21:0x7F] = True
_two, _three = np.zeros(256, bool), np.zeros(256, bool)
_two[0xC3:0xE0] = True  # leads of two bytes without white space, which begins at C2, E1, E2 and E3
_three[0xE0] = _three[0xE4:0xF0] = True


def _solid(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the byte before each of at surely ends a character that is no white space."""
    one = data[at - 1]
    return _plain[one] | ((at > 1) & (one >= 0x80) & _two[data[at - 2]]) | ((at > 2) & (one >= 0x80) & (data[at - 2] >= 0x80) & (data[at - 2] < 0xC0) & _three[data[at - 3]])


class Chunks(Words):
    """The texts' chunks without the space that leads each; the space before a text's first is implied."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        at = np.flatnonzero(data == 0x20)
        text = np.searchsorted(offsets, at, "right") - 1
        at = at[(at > offsets[text]) & (at < offsets[text + 1] - 1)]
        at = at[_solid(data, at)]
        filled = np.diff(offsets) > 0
        self.starts = np.sort(np.concatenate([offsets[:-1][filled], at + 1]))
        self.ends = np.sort(np.concatenate([offsets[1:][filled], at]))
        self.bounds = np.searchsorted(self.starts, offsets)
        self.bounds[-1] = len(self.starts)
        self.counts = np.diff(self.bounds)
        self._blocks = None


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices of ranges one after the other."""
    last = np.cumsum(counts)
    return np.arange(int(last[-1]) if len(last) else 0) + np.repeat(first - (last - counts), counts)


class Side:
    """One tokenizer: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
            self._many = lambda texts: model.encode(texts, num_threads=1)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            coder = Tokenizer.from_file(path)
            coder.encode_special_tokens = True
            names = coder.get_vocab()
            byte = _byte_letters()
            raw = [b""] * (max(names.values()) + 1)
            for name, i in names.items():
                raw[i] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
            self._many = lambda texts: [x.ids for x in coder.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        self.size = np.array([len(x) for x in raw], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def encode(self, chunks: Chunks, which: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the chunks which, how many each has). The tokens of chunks that aren't alone are found in those of many
        chunks joined by spaces, by the bytes at which chunks end."""
        counts, parts, order = np.zeros(len(which), np.int64), [], []
        together, apart = np.flatnonzero(~alone), [np.flatnonzero(alone)]
        sizes = (chunks.ends - chunks.starts)[which] + 1
        call = np.cumsum(sizes[together]) // CALL_BYTES
        runs = np.split(together, np.flatnonzero(np.diff(call)) + 1) if len(together) else []
        texts = [_joined(chunks, which[run])[1:].tobytes().decode() for run in runs]
        for run, ids in zip(runs, self._many(texts), strict=True):
            ids, wanted = np.array(ids, np.int64), np.cumsum(sizes[run])
            ends = np.cumsum(self.size[ids])
            at = np.searchsorted(ends, wanted)
            if len(ends) and ends[-1] == wanted[-1] and np.array_equal(ends[at], wanted):
                counts[run] = np.diff(at, prepend=-1)
                parts.append(ids)
                order.append(run)
            else:
                apart.append(run)
        last = np.concatenate(apart)
        for i, ids in zip(last.tolist(), self._many([chunks.word(k).decode() for k in which[last].tolist()]), strict=True):
            counts[i] = len(ids)
            parts.append(np.array(ids, np.int64))
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        if not len(last):
            return flat, counts
        order = np.concatenate([*order, last])
        begin = np.empty(len(which), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        return flat[_ranges(begin, counts)], counts

    def gives_back(self, ids: np.ndarray, counts: np.ndarray, chunks: Chunks, which: np.ndarray) -> np.ndarray:
        """Whether the bytes of each chunk's tokens are a space and the chunk."""
        edges = np.append(0, np.cumsum(counts))
        made = np.append(0, np.cumsum(self.size[ids]))[edges]
        sizes = (chunks.ends - chunks.starts)[which] + 1
        same = np.diff(made) == sizes
        some = np.flatnonzero(same)
        if len(some):
            raw = self.bytes[_ranges(self.first[ids], self.size[ids])]
            raw = raw if len(some) == len(which) else raw[_ranges(made[:-1][some], sizes[some])]
            same[some] = np.logical_and.reduceat(raw == _joined(chunks, which[some]), np.cumsum(sizes[some]) - sizes[some])
        return same


def _joined(chunks: Chunks, which: np.ndarray) -> np.ndarray:
    """The bytes of chunks, each after a space."""
    sizes = (chunks.ends - chunks.starts)[which] + 1
    first = np.cumsum(sizes) - sizes
    out = chunks.data[np.maximum(_ranges(chunks.starts[which] - 1, sizes), 0)]
    out[first] = 0x20
    return out


class Rows:
    """An array that grows at its end."""

    def __init__(self, kind: type, *shape: int):
        self.held, self.n = np.zeros((1024, *shape), kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            held = np.zeros((max(2 * len(self.held), self.n + len(values)), *self.held.shape[1:]), self.held.dtype)
            held[: self.n] = self.held[: self.n]
            self.held = held
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)

    def all(self) -> np.ndarray:
        return self.held[: self.n]


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the other
    bytes in order for the letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last a token, last b token) of each group, of the ascending byte ends of both sides' tokens."""
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    closes = (ends_a[a] == ends) & (ends_b[b] == ends)
    return a[closes], b[closes]


class Aligned:
    """Chunks seen lately: of each whether both sides give it back, its tokens on either side, groups, links, what its
    groups read like, and its distinct id pairs (a * size of b's vocabulary + b) with how many links are of each."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Side(path_a), Side(path_b)
        self.width = len(self.b.size)
        digits = [str(i).encode() for i in range(max(len(self.a.size), self.width))]
        self.digits = np.frombuffer(b"".join(x + b"," for x in digits), np.uint8)
        self.n_digits = np.array([len(x) + 1 for x in digits], np.int64)
        self.first_digit = np.cumsum(self.n_digits) - self.n_digits
        self._clear()

    def _clear(self) -> None:
        self.known = Known()
        self._rows = {"sums": Rows(np.int64, 4), "good": Rows(bool), "said": Rows(np.uint8), "said_ends": Rows(np.int64), "pairs": Rows(np.int64), "links": Rows(np.int64), "pair_ends": Rows(np.int64)}
        for name in ("said_ends", "pair_ends"):
            self._rows[name].add(np.zeros(1, np.int64))
        self.counts_of, self.rated = None, Rows(np.int64, 2)

    def __getattr__(self, name: str) -> np.ndarray:
        """sums (tokens of a and b, groups, links), good, said, said_ends, pairs, links, pair_ends."""
        return self.__dict__["_rows"][name].all()

    def places(self, chunks: Chunks) -> np.ndarray:
        if len(self.known) > KEPT:
            self._clear()
        place, new = self.known.places(chunks)
        if len(new):
            self._add(chunks, new)
        return place

    def _add(self, chunks: Chunks, which: np.ndarray) -> None:
        data = chunks.data
        marks = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))  # what stands for a space in b
        marked = np.searchsorted(marks, chunks.ends[which]) > np.searchsorted(marks, chunks.starts[which])
        alone = ~_solid(data, chunks.ends[which]) | marked
        (a, n_a), (b, n_b) = self.a.encode(chunks, which, alone), self.b.encode(chunks, which, alone)
        good = self.a.gives_back(a, n_a, chunks, which) & self.b.gives_back(b, n_b, chunks, which)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b = n_a * good, n_b * good
        last_a, last_b = groups(np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b]))
        in_a, in_b = np.diff(np.append(-1, last_a)), np.diff(np.append(-1, last_b))
        group_ends = np.searchsorted(last_a, np.cumsum(n_a) - 1, "right")  # groups of a chunk and of those before it
        chunk = np.repeat(np.arange(len(which)), np.diff(np.append(0, group_ends)))
        n_links = np.bincount(chunk, in_a * in_b, len(which)).astype(np.int64)
        said, said_ends = self._say(a, b, in_a, in_b, last_a, last_b)
        pair, of, links = self._expand(a, b, in_a, in_b, last_a, last_b, chunk)
        new = {
            "sums": np.stack([n_a, n_b, np.diff(np.append(0, group_ends)), n_links], axis=1),
            "good": good,
            "said": said,
            "said_ends": self.said_ends[-1] + np.append(0, said_ends)[group_ends],
            "pairs": pair,
            "links": links,
            "pair_ends": self.pair_ends[-1] + np.cumsum(np.bincount(of, minlength=len(which))),
        }
        for name, values in new.items():
            self._rows[name].add(values)

    def rate(self, name: str, counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Of each chunk, its links whose count is the highest of their a, and the sum of its links' counts. counts: (pair, n,
        best) by pair, known by their name."""
        if self.counts_of != name:
            self.counts_of, self.rated = name, Rows(np.int64, 2)
        lo = int(self.pair_ends[self.rated.n])
        pair, links, ends = self.pairs[lo:], self.links[lo:], self.pair_ends[self.rated.n :] - lo
        if len(counts[0]):
            at = np.minimum(np.searchsorted(counts[0], pair), len(counts[0]) - 1)
            self.rated.add(_per_text(np.stack([links * counts[2][at], links * counts[1][at]], axis=1), ends))
        else:
            self.rated.add(np.zeros((len(ends) - 1, 2), np.int64))
        return self.rated.all()

    def _say(self, a, b, in_a, in_b, last_a, last_b) -> tuple[np.ndarray, np.ndarray]:
        """(the groups as text, each closed by a semicolon; where each ends)."""
        total = in_a + in_b
        first = np.cumsum(total) - total
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[_ranges(first, in_a)], ids[_ranges(first + in_a, in_b)] = a, b
        mark[first + in_a - 1], mark[first + total - 1] = ord("|"), ord(";")
        size = self.n_digits[ids]
        out = self.digits[_ranges(self.first_digit[ids], size)]
        ends = np.cumsum(size)
        out[ends - 1] = mark
        return out, ends[first + total - 1]

    def _expand(self, a, b, in_a, in_b, last_a, last_b, chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, its chunk, links): the distinct pairs of each chunk, by chunk."""
        small = in_a * in_b <= LARGE
        s_a, s_b = in_a[small], in_b[small]
        tokens = _ranges((last_a - in_a + 1)[small], s_a)
        of = np.repeat(np.arange(len(s_a)), s_a)
        each = s_b[of]
        left = np.repeat(a[tokens], each)
        right = b[_ranges((last_b - in_b + 1)[small][of], each)]
        pair, where, links = left * self.width + right, np.repeat(chunk[small][of], each), np.ones(len(left), np.int64)
        for g in np.flatnonzero(~small).tolist():
            x, n_x = np.unique(a[last_a[g] - in_a[g] + 1 : last_a[g] + 1], return_counts=True)
            y, n_y = np.unique(b[last_b[g] - in_b[g] + 1 : last_b[g] + 1], return_counts=True)
            pair = np.append(pair, (x[:, None] * self.width + y).ravel())
            where, links = np.append(where, np.full(len(x) * len(y), chunk[g])), np.append(links, (n_x[:, None] * n_y).ravel())
        where, pair, links = _summed(where, pair, links)
        return pair, where, links


def _summed(row: np.ndarray, pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, sum of n), ascending and distinct."""
    order = np.lexsort((pair, row))
    row, pair, n = row[order], pair[order], n[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (pair[1:] != pair[:-1]))) if len(row) else np.zeros(0, np.int64)
    return row[first], pair[first], np.add.reduceat(n, first) if len(first) else n


def _distinct(row: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, pair), ascending and distinct; pairs are below 2**32."""
    both = np.sort((row << 32) | pair)
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return both >> 32, both & 0xFFFFFFFF


def _stretches(data: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of a long text, without the spaces that part them."""
    out, lo = [], 0
    while len(data) - lo > 2 * STRETCH:
        at = lo + STRETCH
        while at < len(data) - 1:
            spaces = at + np.flatnonzero(data[at : min(at + STRETCH, len(data) - 1)] == 0x20)
            spaces = spaces[_solid(data, spaces)]
            if len(spaces):
                break
            at += STRETCH
        if at >= len(data) - 1:
            break
        out.append((lo, int(spaces[0])))
        lo = int(spaces[0]) + 1
    return [*out, (lo, len(data))]


@lru_cache(1)
def aligned(path_a: str, path_b: str) -> Aligned:
    return Aligned(path_a, path_b)


def _read(table: Aligned, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """(which texts both sides give back, parts) of a slice. A part is (place of each chunk, bounds of the texts among
    them); a long text, which is a slice of its own, comes in several. The places hold until the next part."""
    filled = np.diff(offsets) > 0
    ranges = _stretches(data) if len(offsets) == 2 else [(0, len(data))]
    if len(ranges) == 1:
        chunks = Chunks(data, offsets)
        place = table.places(chunks)
        return filled & (_per_text(~table.good[place], chunks.bounds) == 0), iter([(place, chunks.bounds)])

    def parts():
        for lo, hi in ranges:
            chunks = Chunks(data[lo:hi], np.array([0, hi - lo]))
            yield table.places(chunks), chunks.bounds

    return filled & all(table.good[place].all() for place, _ in parts()), parts()


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the chunks' values for each text."""
    run = np.zeros((len(values) + 1, *values.shape[1:]), np.int64)
    np.cumsum(values, axis=0, out=run[1:])
    return run[bounds[1:]] - run[bounds[:-1]]


def _pairs_of(table: Aligned, place: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, links) of each chunk's pairs."""
    counts = np.diff(table.pair_ends)[place]
    at = _ranges(table.pair_ends[place], counts)
    return np.repeat(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), counts), table.pairs[at], table.links[at]


def _count(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.hold("cross", aligned.cache_clear)
        table = aligned(path_a, path_b)
        pairs, n, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged():
            every, place = np.unique(np.concatenate([pairs, *waiting]), return_inverse=True)
            return every, np.bincount(place, np.concatenate([n, np.ones(len(place) - len(n), np.int64)]), len(every)).astype(np.int64)

        for _, data, offsets in common.slices(batches, limit=SLICE):
            good, parts = _read(table, data, offsets)
            found = [np.zeros(0, np.int64)]
            for place, bounds in parts:
                row, pair, _ = _pairs_of(table, place, bounds)
                found.append(_distinct(row[good[row]], pair[good[row]])[1])
            waiting.append(np.concatenate(found) if len(found) <= 2 else np.unique(np.concatenate(found)))
            size += len(waiting[-1])
            if size > FLUSH:
                pairs, n = merged()
                waiting, size = [], 0
                if len(pairs) > FLUSH:
                    yield pa.record_batch([pa.array(pairs), pa.array(n)], ["pair", "n"])
                    pairs, n = pairs[:0], n[:0]
        pairs, n = merged()
        yield pa.record_batch([pa.array(pairs), pa.array(n)], ["pair", "n"])

    return run


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """pair (a * size of b's vocabulary + b), n (documents that hold it linked), best (n is the highest of its a)."""
    counted = docs.select(common.text_or_empty()).mapInArrow(_count(path_a, path_b), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    width = len(Side(path_b).size)
    highest = F.max("n").over(Window.partitionBy(F.expr(f"pair div {width}")))
    return counted.select("pair", "n", (F.col("n") == highest).alias("best"))


DIGEST = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _digest(path_a: str, path_b: str, counts: tuple[np.ndarray, np.ndarray, np.ndarray] | None):
    """counts: (pair, n, best) by pair; None: each text brings its pairs and links for a join, and counts are 0."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.hold("cross", aligned.cache_clear)
        table = aligned(path_a, path_b)
        for rows, data, offsets in common.slices(batches, limit=SLICE):
            good, parts = _read(table, data, offsets)
            sums, hashes, held = np.zeros((len(good), 6), np.int64), [hashlib.sha256() for _ in range(len(good))], []
            for k, (place, bounds) in enumerate(parts):
                sums[:, :4] += _per_text(table.sums[place], bounds)
                if counts is None:
                    held.append(_pairs_of(table, place, bounds))
                else:
                    sums[:, 4:] += _per_text(table.rate(name, counts)[place], bounds)
                sizes = np.diff(table.said_ends)[place]
                said, ends = table.said[_ranges(table.said_ends[place], sizes)], np.append(0, np.cumsum(sizes))
                for i in np.flatnonzero(good).tolist():
                    mine = said[ends[bounds[i]] : ends[bounds[i + 1]]]
                    hashes[i].update((b";" if k else b"") + mine[:-1].tobytes())
            sums[~good] = 0
            columns = [pa.array(c) for c in sums.T] + [pa.array([h.hexdigest() if g else "" for h, g in zip(hashes, good.tolist(), strict=True)])]
            names = [x.split()[0] for x in DIGEST.split(", ")]
            if counts is None:
                row, pair, links = _summed(*(np.concatenate([x[i] for x in held]) for i in range(3)))
                row, pair, links = row[good[row]], pair[good[row]], links[good[row]]
                edges = pa.array(np.searchsorted(row, np.arange(len(good) + 1)).astype(np.int32))
                columns += [pa.ListArray.from_arrays(edges, pa.array(pair)), pa.ListArray.from_arrays(edges, pa.array(links))]
                names += ["pairs", "links"]
            yield pa.record_batch([rows.column("doc_id"), *columns], ["doc_id", *names])

    return run


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id and DIGEST of every document (doc_id, text)."""
    path_a, path_b = path_a or vocabulary_path("byte_bpe_50k.json"), path_b or vocabulary_path("piece_bpe_32k.model")
    common.session_paths(docs.sparkSession)
    docs = docs.select("doc_id", common.text_or_empty())
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts, n = common.table_n(pair_counts(docs, path_a, path_b), "pairs")
    if n <= PAIRS:
        got = counts.toArrow()
        order = np.argsort(got.column("pair").to_numpy())
        known = tuple(got.column(c).to_numpy()[order] for c in ("pair", "n", "best"))
        return docs.mapInArrow(_digest(path_a, path_b, known), f"doc_id {kind}, {DIGEST}")
    held = docs.mapInArrow(_digest(path_a, path_b, None), f"doc_id {kind}, {DIGEST}, pairs array<long>, links array<long>")
    held = common.table(held.withColumn("row", F.monotonically_increasing_id()), "aligned")
    met = held.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("links").alias("links")))).toDF("row", "pair", "links").join(counts, "pair")
    met = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("best"), F.sum(F.col("links") * F.col("n")).alias("count"))
    out = held.drop("pairs", "links", "n_best", "count_sum").join(met, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("best", F.lit(0)).alias("n_best"), F.coalesce("count", F.lit(0)).alias("count_sum"), "groups_sha256")


def op13_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
