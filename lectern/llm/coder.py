"""Token ids of many texts at once, with the tokenizers library run on distinct words only.

A tokenizer that drops white space (its pre-tokenizer splits there and no token spans it) gives a text the ids of its
words, one after the other; a word is what stands between ASCII white space. The ids of words seen lately are kept
in arrays that start afresh at a bound; a word takes kept ids only where all of its bytes are the kept word's.

New words are encoded joined by spaces. Where their ids part is known from the tokens that end a pre-token and from
how many pre-tokens each word has, which is counted for words of ASCII and Latin-1 letters, digits and marks; other
words, and all words should the counts not add up, are encoded one by one.
"""

from __future__ import annotations

import json
import os
from functools import cache

import numpy as np

from lectern.llm.words import Known, Words

#: Words kept by a worker.
KEPT = 600_000
#: Bytes of words that one call of the library gets.
CALL_BYTES = 1 << 15


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Classes of bytes: letter, digit, mark, and what the pre-token count is not known for.
_LETTER, _DIGIT, _MARK, _OTHER = 0, 1, 2, 3
_kind = np.full(256, _OTHER, np.uint8)
_kind[0x21:0x7F] = _MARK
_kind[0x30:0x3A] = _DIGIT
_kind[0x41:0x5B] = _kind[0x61:0x7B] = _LETTER
_kind[0x27] = _kind[0x3C] = _OTHER  # ' starts contractions, < special tokens


def _kinds(data: np.ndarray) -> np.ndarray:
    """Class of each byte; both bytes of a Latin-1 letter are letters."""
    kinds = _kind[data]
    at = np.flatnonzero(data[:-1] == 0xC3)
    at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]
    kinds[at] = kinds[at + 1] = _LETTER
    return kinds


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ranges with a space after each, where each begins)."""
    sizes = ends - starts + 1
    first = np.cumsum(sizes) - sizes
    out = data[np.minimum(np.arange(sizes.sum()) + np.repeat(starts - first, sizes), len(data) - 1)]
    out[first + sizes - 1] = 32
    return out, first


class Coder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = (json.loads(self.tokenizer.to_str())["model"]).get("end_of_word_suffix")
        self.closes = None
        if suffix:
            names = self.tokenizer.get_vocab(with_added_tokens=False)
            self.closes = np.zeros(max(names.values()) + 1, bool)
            self.closes[[i for name, i in names.items() if name.endswith(suffix)]] = True
        self._clear()

    def _clear(self) -> None:
        self.known = Known()
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each word has)."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        place = self._places(words)
        starts = self.ends[place]
        counts = self.ends[place + 1] - starts
        total = np.cumsum(counts)
        at = np.repeat((starts - (total - counts)).astype(np.int32), counts)
        at += np.arange(total[-1], dtype=np.int32)
        return self.ids[at], counts

    def lengths(self, words: Words) -> np.ndarray:
        if not len(words):
            return np.zeros(0, np.int64)
        place = self._places(words)
        return self.ends[place + 1] - self.ends[place]

    def _places(self, words: Words) -> np.ndarray:
        if len(self.known) > KEPT:
            self._clear()
        place, new = self.known.places(words)
        if len(new):
            ids, counts = self._encode_new(words, new)
            self.ids = np.concatenate([self.ids, ids])
            self.ends = np.concatenate([self.ends, np.cumsum(counts) + self.ends[-1]])
        return place

    def _encode_new(self, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text, first = _gather(words.data, words.starts[which], words.ends[which])
        if self.closes is None:
            return self._one_by_one(text, first, np.arange(len(which)))
        kinds = _kinds(text)
        kinds[text == 32] = _MARK
        odd = np.logical_or.reduceat(kinds == _OTHER, first)
        new = np.ones(len(text), bool)
        new[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
        new[first] = True
        new[text == 32] = False
        pretokens = np.add.reduceat(new, first, dtype=np.int64)
        plain = np.flatnonzero(~odd)
        lists, counts = [None] * 2, np.zeros(len(which), np.int64)
        order = []
        if len(plain):
            ids, n = self._joined(text, first, plain, pretokens[plain])
            lists[0], counts[plain] = ids, n
            order.append(plain)
        rest = np.flatnonzero(odd)
        if len(rest):
            ids, n = self._one_by_one(text, first, rest)
            lists[1], counts[rest] = ids, n
            order.append(rest)
        flat = np.concatenate([x for x in lists if x is not None])
        if len(order) == 1:
            return flat, counts
        order = np.concatenate(order)
        held = counts[order]
        begin = np.empty(len(which), np.int64)
        begin[order] = np.cumsum(held) - held
        total = np.cumsum(counts)
        return flat[np.arange(total[-1]) + np.repeat(begin - (total - counts), counts)], counts

    def _joined(self, text: np.ndarray, first: np.ndarray, which: np.ndarray, pretokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.append(first[1:], len(text)) - 1
        joined, begin = _gather(text, first[which], ends[which])
        raw = joined.tobytes()
        cuts = [0]
        while cuts[-1] < len(which):
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(begin, begin[cuts[-1]] + CALL_BYTES))))
        edges = [*(int(begin[c]) for c in cuts[:-1]), len(raw)]
        coded = self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(edges[:-1], edges[1:], strict=True)], add_special_tokens=False)
        ids, counts = [], []
        for lo, hi, one in zip(cuts[:-1], cuts[1:], coded, strict=True):
            got = np.array(one.ids, np.uint32)
            closing = np.flatnonzero(self.closes[np.minimum(got, len(self.closes) - 1)]) + 1
            last = np.cumsum(pretokens[lo:hi])
            if len(closing) == last[-1] and closing[-1] == len(got):
                ids.append(got)
                counts.append(np.diff(np.append(0, closing[last - 1])))
            else:
                some, n = self._one_by_one(text, first, which[lo:hi])
                ids.append(some)
                counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)

    def _one_by_one(self, text: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.append(first[1:], len(text)) - 1
        raw = text.tobytes()
        coded = self.tokenizer.encode_batch([raw[first[i] : ends[i]].decode() for i in which.tolist()], add_special_tokens=False)
        lists = [x.ids for x in coded]
        return np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists], np.int64)


@cache
def coder(path: str) -> Coder:
    return Coder(path)
