"""Language ID by prediction by partial matching.

For each language a byte context tree of orders 0 to 4 is counted from labelled text. A byte's probability in its
longest known context is n / (N + D) (N bytes seen there, D distinct ones); the escape D / (N + D) passes to the next
shorter context, and below order 0 all 256 bytes are equally likely. Counts are frozen before scoring, so a text has
one exact code length in each language; the shortest names the language.

The stream is the text's words, A-Z in lower case, each led and closed by a space; a context reaches back to the
leading space and no further. So a word's code length is the same wherever it stands, and is looked up once for each
distinct word of a stretch of text.

Training takes documents by the hash of their doc_id until about SAMPLE_BYTES of each language, and TOTAL_BYTES in
all, are expected, and the first one with a word in any case, so that no language is lost; these bounds on labelled text
are the only ones. Counts that leave the cluster are those of this sample. Scoring reads every whole text and nothing but the text.

Cases: null and empty texts and texts without a letter are `und` with score 0, as is every text when no language is
learned; rows without a label or a doc_id aren't learned from; ties go to the smaller language code; repeated rows
get the same answer; an empty table gives an empty result; other columns are not read, or pass untouched in keep().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common
from lectern.llm.words import Known, Words

ORDER = 4
#: Expected bytes of text that each language's tree is counted from.
SAMPLE_BYTES = 1_500_000
FOLDS = 5
UNKNOWN = "und"
#: Expected bytes of text that all trees together are counted from: beyond TOTAL_BYTES / SAMPLE_BYTES languages each has
#: fewer, and its first document in any case.
TOTAL_BYTES = 48_000_000
#: keep() rejects a text that no language codes in fewer bits a byte. A byte that a language never had costs 8 and its
#: escapes, some 12 to 18 in all; running text of a learned language costs 1 to 4, noise in its letters 5 to 8.
MAX_BITS = 12.0
#: Words whose code lengths a worker keeps, of four languages; of more languages fewer words.
KEPT = 150_000
#: Numbers of code lengths that are worked on at once.
BLOCK = 1 << 21
UNIT = 1 << 20
GRAMS = "lang string, depth int, gram long, n long"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _grams(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, gram of the last ORDER + 1 bytes with the current one lowest, bytes of context) for each byte of the
    words which, and for the space that closes each."""
    lengths = words.ends[which] - words.starts[which] + 1
    word = np.repeat(np.arange(len(which)), lengths)
    inside = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    padded = np.append(words.data, np.uint8(32))
    current = padded[np.minimum(words.starts[which][word] + inside, len(padded) - 1)]
    current[inside == lengths[word] - 1] = 32
    gram = current.astype(np.uint64)
    for k in range(1, ORDER + 1):
        back = np.zeros(len(word), np.uint64)
        back[k:] = current[:-k]
        back[inside == k - 1] = 32
        back[inside < k - 1] = 0
        gram |= back << np.uint64(8 * k)
    return word, gram, np.minimum(inside + 1, ORDER)


def _low(gram: np.ndarray, depth: int) -> np.ndarray:
    return gram & np.uint64((1 << (8 * (depth + 1))) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in common.slices(batches):
        words = Words(data, offsets, lower=True)
        langs = rows.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            mine = np.array([x == lang for x in langs])
            at = np.flatnonzero(np.repeat(mine, words.counts))
            if not len(at):
                continue
            _, gram, context = _grams(words, at)
            depths, grams, counts = [], [], []
            for depth in range(ORDER + 1):
                value, n = np.unique(_low(gram[context >= depth], depth), return_counts=True)
                depths.append(np.full(len(value), depth))
                grams.append(value)
                counts.append(n)
            total = sum(map(len, grams))
            yield pa.record_batch([pa.array([lang] * total, pa.string()), pa.array(np.concatenate(depths), pa.int32()), pa.array(np.concatenate(grams).astype(np.int64), pa.int64()), pa.array(np.concatenate(counts), pa.int64())], ["lang", "depth", "gram", "n"])


class Sparse:
    """Values of (key, language) pairs: the keys ascending, and of each its languages and values in a row."""

    def __init__(self, key: np.ndarray, lang: np.ndarray, value: np.ndarray):
        order = np.lexsort((lang, key))
        key, self.lang, self.value = key[order], lang[order].astype(np.int32), value[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.keys, self.ends = key[first], np.append(first, len(key))

    def rows(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of the asked, language, value) of all pairs whose key is asked."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        known = np.flatnonzero(self.keys[at] == asked)
        lo = self.ends[at[known]]
        n = self.ends[at[known] + 1] - lo
        last = np.cumsum(n)
        pick = np.arange(int(last[-1]) if len(last) else 0) + np.repeat(lo - (last - n), n)
        return np.repeat(known, n), self.lang[pick], self.value[pick]


class Trees:
    """Frozen trees: for each depth and language, the bits of a gram in its context, and of the escape from a context that
    it knows. What a language doesn't know takes no room, so trees grow with the sample and not with the languages."""

    def __init__(self, counted: pd.DataFrame):
        self.langs = sorted(counted["lang"].unique())
        number = counted["lang"].map({x: i for i, x in enumerate(self.langs)}).to_numpy(np.int64)
        self.depths: list[tuple[Sparse, Sparse]] = []
        for depth in range(ORDER + 1):
            mine = counted["depth"].to_numpy() == depth
            gram, lang, n = counted["gram"].to_numpy(np.int64)[mine].view(np.uint64), number[mine], counted["n"].to_numpy(np.float64)[mine]
            order = np.lexsort((gram, lang, gram >> np.uint64(8)))
            gram, lang, n = gram[order], lang[order], n[order]
            context = gram >> np.uint64(8)
            first = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (lang[1:] != lang[:-1]))) if len(gram) else np.zeros(0, np.int64)
            kinds = np.diff(np.append(first, len(gram)))
            total = np.add.reduceat(n, first) if len(first) else n
            all_ = np.log2(total + kinds)
            escape = all_ - np.log2(kinds)
            bits = np.repeat(all_, kinds) - np.log2(n)
            # A gram's row says by how much it is cheaper than the escape, which is added for every known context.
            self.depths.append((Sparse(gram, lang, bits - np.repeat(escape, kinds)), Sparse(context[first], lang[first], escape)))

    def word_bits(self, words: Words, which: np.ndarray) -> np.ndarray:
        """Code length of each of the words, by language, in units of 2**-20 bit: sums of integers are the same in any
        order, so a text's code length doesn't depend on what it is read with. At most BLOCK numbers are held at once, and
        those of one word."""
        out = np.zeros((len(which), len(self.langs)), np.int64)
        ends = np.cumsum(words.ends[which] - words.starts[which] + 1)
        lo = 0
        while lo < len(which):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK // len(self.langs), "right")))
            out[lo:hi] = self._some_bits(words, which[lo:hi])
            lo = hi
        return out

    def _some_bits(self, words: Words, which: np.ndarray) -> np.ndarray:
        word, gram, context = _grams(words, which)
        bits = np.zeros((len(word), len(self.langs)))
        open_ = np.ones((len(word), len(self.langs)), bool)
        todo = np.arange(len(word))
        for depth in range(ORDER, -1, -1):
            grams, contexts = self.depths[depth]
            mine = todo[context[todo] >= depth]
            value = _low(gram[mine], depth)
            for held, key, closes in ((contexts, value >> np.uint64(8), False), (grams, value, True)):
                at, lang, cost = held.rows(key)
                at = mine[at]
                still = open_[at, lang]
                at, lang = at[still], lang[still]
                bits[at, lang] += cost[still]
                if closes:
                    open_[at, lang] = False
            todo = todo[open_[todo].any(axis=1)]
        bits += np.where(open_, 8.0, 0.0)
        starts = np.searchsorted(word, np.arange(len(which)))
        return np.add.reduceat(np.rint(bits * UNIT).astype(np.int64), starts, axis=0)


class Scorer:
    def __init__(self, counted: pd.DataFrame):
        self.trees = Trees(counted)
        self._clear()

    def _clear(self) -> None:
        self.known = Known()
        self.bits = np.zeros((0, len(self.trees.langs)), np.int64)

    def bits_of(self, words: Words) -> np.ndarray:
        """Code length in bits of each text, by language."""
        if len(self.known) * len(self.trees.langs) > KEPT * 4:
            self._clear()
        place, new = self.known.places(words)
        if len(new):
            self.bits = np.concatenate([self.bits, self.trees.word_bits(words, new)])
        run = np.zeros((len(place) + 1, len(self.trees.langs)), np.int64)
        np.cumsum(self.bits[place], axis=0, out=run[1:])
        return (run[words.bounds[1:]] - run[words.bounds[:-1]]) / UNIT


_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True


def _has_letter(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.append(0, np.cumsum(_ASCII[data]))
    out = run[offsets[1:]] > run[offsets[:-1]]
    texts = rows.column("x_text")
    for i in np.flatnonzero(~out):
        out[i] = any(map(str.isalpha, texts[i].as_py() or ""))
    return out


@lru_cache(1)
def _scorer(raw: bytes) -> Scorer:
    return Scorer(pa.ipc.open_stream(raw).read_pandas())


def _score(raw: bytes, with_text: bool):
    """Adds x_lang, x_score and x_bits (bits a byte in the language named)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.hold("langid", _scorer.cache_clear)
        scorer = _scorer(raw)
        langs = np.array([*scorer.trees.langs, UNKNOWN], object)
        for rows, data, offsets in common.slices(batches, "x_text"):
            good = _has_letter(rows, data, offsets)
            n = len(good)
            if len(langs) > 1:
                words = Words(data, offsets, lower=True)
                bits = scorer.bits_of(words)
                best = bits.argmin(axis=1)
                least = bits[np.arange(n), best]
                score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                coded = np.add.reduceat(np.append(words.ends - words.starts + 1, 0), np.minimum(words.bounds[:-1], len(words))) * (words.counts > 0)
                rate = least / np.maximum(coded, 1)
                best, score, rate = np.where(good, best, len(langs) - 1), np.where(good, score, 0.0), np.where(good, rate, 0.0)
            else:
                best, score, rate = np.zeros(n, int), np.zeros(n), np.zeros(n)
            out = {c: rows.column(c) for c in (("x_row", "x_text") if with_text else ("x_row",))}
            yield pa.record_batch([*out.values(), pa.array(langs[best], pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], [*out, "x_lang", "x_score", "x_bits"])

    return run


def train(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """Counts of all trees, as an Arrow stream. Learns from the text and label of documents (doc_id, text, lang) that
    aren't held out."""
    common.session_paths(docs.sparkSession)
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    least = F.min(F.when(F.col("text").rlike(r"\S"), place)).alias("least")
    share, n = common.table_n(usable.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), least), "share")
    sample_bytes = min(sample_bytes, TOTAL_BYTES / max(n, 1))
    share = F.broadcast(share) if n <= common.BROADCAST_IDS else share
    draw = (place * F.col("bytes") < float(sample_bytes) * (1 << 20)) | (place == F.col("least"))
    sample = usable.join(share, "lang").filter(draw).select("text", "lang")
    counted = sample.mapInArrow(_count, GRAMS).groupBy("lang", "depth", "gram").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, got.schema) as out:
        out.write_table(got)
    return sink.getvalue().to_pybytes()


def score(docs: DataFrame, trees: bytes, keep: list[str], with_text: bool = False) -> DataFrame:
    """A struct x_row of the columns keep of docs, x_text where asked for, and x_lang, x_score, x_bits."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("x_row"), F.col("text").alias("x_text"))
    row = held.schema["x_row"].dataType.simpleString()
    return held.mapInArrow(_score(trees, with_text), f"x_row {row}, {'x_text string, ' * with_text}x_lang string, x_score double, x_bits double")


def identify(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document (doc_id, text; lang for training)."""
    out = score(docs, train(docs, sample_bytes), ["doc_id"])
    return out.select("x_row.doc_id", held_out("x_row.doc_id").alias("held_out"), F.col("x_lang").alias("lang_pred"), F.col("x_score").alias("score"), F.col("x_bits").alias("bits_per_byte"))


def keep(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, max_bits: float = MAX_BITS) -> DataFrame:
    """The documents with a language: not `und`, and coded in at most max_bits a byte."""
    others = [c for c in docs.columns if c != "text"]
    out = score(docs, train(docs, sample_bytes), others, with_text=True).filter((F.col("x_lang") != UNKNOWN) & (F.col("x_bits") <= max_bits))
    return out.select(*[F.col("x_text" if c == "text" else f"x_row.`{c}`").alias(c) for c in docs.columns])


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("bits_per_byte")
