"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow column, with no Python loop over words.

A word's hash is a sum over its 8-byte blocks, each mixed with its place in the word before it is added, so no pattern
of bytes cancels; a window's hash mixes the hashes of its halves. Both depend on the words alone, not on where they
stand or on the white space between them. Hashes only say where to look: what must be exact compares the blocks
themselves (Known), or a BLAKE2b digest of the bytes (Digests, window_digests).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd

U = np.uint64
_SEEDS = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
#: `[^\x20\x09-\x0D]+`
PLAIN = ~_space
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, of text whose A-Z are lower case
FOLDED = np.zeros(256, bool)
FOLDED[0x30:0x3A] = FOLDED[0x61:0x7B] = FOLDED[0x80:] = True
#: A-Z to a-z, other bytes unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]: byte ranges starts and ends, and bounds: text i has the
    words bounds[i] to bounds[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray = PLAIN, lower: bool = False):
        self.data = LOWER[data] if lower else data
        inside = member[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        at = edges[(edges > 0) & (edges < len(data))]  # a text's edge ends a word
        first[at] = inside[at]
        last[at - 1] = inside[at - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self._blocks = None

    def __len__(self) -> int:
        return len(self.starts)

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(8-byte blocks of all words, the last of each filled with zeros; the first block and the number of blocks of
        each word; each block's place in its word)."""
        if self._blocks is None:
            counts = (self.ends - self.starts + 7) >> 3
            first = np.cumsum(counts) - counts
            inner = np.arange(int(counts.sum())) - np.repeat(first, counts)
            at = np.repeat(self.starts, counts) + 8 * inner
            padded = np.append(self.data, np.zeros(8, np.uint8))
            value = np.ndarray((len(self.data) + 1,), "<u8", padded, 0, (1,))[at]
            left = np.repeat(self.ends, counts) - at
            value &= np.where(left < 8, (U(1) << (U(8) * np.minimum(left, 7).astype(np.uint64))) - U(1), ~U(0))
            self._blocks = value, first, counts, inner
        return self._blocks

    def hashes(self, seed: int = 0) -> np.ndarray:
        if not len(self):
            return np.zeros(0, np.uint64)
        value, first, _, inner = self.blocks()
        mixed = mix(value + (inner + 1).astype(np.uint64) * _SEEDS[seed])
        return mix(np.add.reduceat(mixed, first) ^ (self.ends - self.starts).astype(np.uint64) * U(0x9FB21C651E98DF25))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def positions(bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(window's first word, its text) for every window of n words inside one text."""
    counts = np.maximum(np.diff(bounds) - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    skipped = np.cumsum(counts) - counts
    return np.arange(len(text)) + (bounds[:-1] - skipped)[text], text


class Known:
    """Distinct words and the number (place) of each, told apart by their bytes: a hash finds the place, the blocks kept
    there confirm it, and a word whose hash belongs to another one gets a place of its own."""

    def __init__(self):
        self.keys, self.of_key = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.blocks, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.others: dict[bytes, int] = {}  # those whose hash is another one's

    def __len__(self) -> int:
        return len(self.size)

    def places(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(place of each word, the words that are new in order of their places, which follow those known before)."""
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, distinct = pd.factorize(words.hashes())
        at = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        known = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        place = np.empty(len(distinct), np.int64)
        place[known] = self.of_key[at[known]]
        new = np.flatnonzero(~known)
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        place[new] = np.arange(len(new)) + len(self)
        fresh = first[new]
        order = np.argsort(distinct[new])
        into = np.searchsorted(self.keys, distinct[new][order])
        self.keys, self.of_key = np.insert(self.keys, into, distinct[new][order]), np.insert(self.of_key, into, place[new][order])
        self._add(words, fresh)
        place = place[codes]
        other = np.flatnonzero(~self._same(words, place))
        if len(other):
            firsts = []
            for i in other.tolist():
                word = words.word(i)
                if word not in self.others:
                    self.others[word] = len(self) + len(firsts)
                    firsts.append(i)
                place[i] = self.others[word]
            self._add(words, np.array(firsts, np.int64))
            fresh = np.append(fresh, np.array(firsts, np.int64))
        return place, fresh

    def _add(self, words: Words, which: np.ndarray) -> None:
        value, first, counts, _ = words.blocks()
        n = counts[which]
        ends = np.cumsum(n)
        at = np.arange(int(n.sum())) + np.repeat(first[which] - (ends - n), n)
        self.at = np.append(self.at, ends - n + len(self.blocks))
        self.size = np.append(self.size, (words.ends - words.starts)[which])
        self.blocks = np.append(self.blocks, value[at])

    def _same(self, words: Words, place: np.ndarray) -> np.ndarray:
        value, first, counts, inner = words.blocks()
        same = self.size[place] == words.ends - words.starts
        at = np.minimum(np.repeat(self.at[place], counts) + inner, len(self.blocks) - 1)
        return same & np.logical_and.reduceat(self.blocks[at] == value, first)


class Digests:
    """64 bits of the BLAKE2b of each word; those of words seen lately are kept."""

    def __init__(self, limit: int = 150_000):
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.known, self.held = Known(), np.zeros(0, np.uint64)

    def of(self, words: Words) -> np.ndarray:
        if len(self.known) > self.limit:
            self._clear()
        place, new = self.known.places(words)
        if len(new):
            raw = b"".join(hashlib.blake2b(words.word(i), digest_size=8).digest() for i in new.tolist())
            self.held = np.append(self.held, np.frombuffer(raw, np.uint64))
        return self.held[place]


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in this order."""
    return mix((x ^ (x >> U(29))) * U(0xA24BAED4963EE407) + y)


def window_hashes(words: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows of n words that start at the words at, from the words' hashes: windows of 1, 2, 4 words
    and so on are joined from the left."""
    size, run, held, out = 1, words, 0, None
    while True:
        if n & size:
            part = run[at + held]
            out = part if out is None else _join(out, part)
            held += size
        if held == n:
            return mix(out + U(n))
        run = _join(run[: len(run) - size], run[size:]) if len(run) > size else run[:0]
        size *= 2


def window_digests(words: Words, n: int, at: np.ndarray) -> np.ndarray:
    """128 bits of the BLAKE2b of the windows' words, joined by a space, as rows of two integers."""
    out = []
    for run in np.split(at, np.flatnonzero((np.diff(at) > n) | (np.diff(at) < 1)) + 1):  # windows close together share one copy of their words
        if len(run):
            lo = int(run[0])
            joined = [words.word(k) for k in range(lo, int(run[-1]) + n)]
            edges = np.append(0, np.cumsum([len(x) + 1 for x in joined])).tolist()
            raw = b" ".join(joined)
            out += [hashlib.blake2b(raw[edges[i] : edges[i + n] - 1], digest_size=16).digest() for i in (run - lo).tolist()]
    return np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2)


def planes(x: np.ndarray) -> bytes:
    """An integer array as bytes, all lowest bytes first: the high ones, mostly zero, shrink in a compressed shuffle."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(raw: np.ndarray, n: int, kind: type) -> np.ndarray:
    return np.ascontiguousarray(raw[: n * np.dtype(kind).itemsize].reshape(np.dtype(kind).itemsize, n).T).view(kind).reshape(n)
