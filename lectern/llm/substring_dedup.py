"""Substring dedup by fixed-block anchors.

A window of 50 words that stands in an earlier document contains one whole block of that document's non-overlapping
blocks of 25 words. So the blocks of all documents are the index, every rolling 25-word window of every document is
a probe, and a probe that meets a block of a smaller doc_id is an anchor. Around anchors and the blocks they met
the 50-word windows themselves are compared, by 128 bits of BLAKE2b over their words; hits that follow one another are
extended to maximal exact repeats (maximal_repeats()), and the words of those are removed. A clash of the hashes that
find anchors only adds windows to compare.

Nothing is paired: a bucket of hashes keeps the smallest doc_id of each hash. A task first settles what it can
among its own rows, so a passage that a third of the documents share leaves each task about once, and windows that
repeat one after the other in a document (one word, over and over) travel as one entry with their number.

Buckets grow with the input, a task's memory doesn't. Beyond SPREAD buckets a task sends to ranges of buckets, at most
SPREAD of them, and a second step, sorted by range, settles and sends each range's entries to its buckets: payloads hold
hundreds of entries on either way, where a single step over tens of millions of buckets would send them one by one.

Cases: a null or empty text has no words, keeps the empty text and is never an anchor; texts of fewer than 50 words
stay whole; of repeated doc_ids the rows count as one document's texts of which none is smaller, so they don't
remove from each other; rows without a doc_id stay whole and remove nothing; an empty table gives an empty result; other
columns are not read. An exact copy is found by the SHA-256 of its words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common
from lectern.llm.words import Words, from_planes, planes, positions, window_digests, window_hashes

WINDOW = 50
#: Entries a task holds before it settles and sends them.
FLUSH = 1_000_000
#: Words that one bucket should hold over the whole input.
BUCKET_WORDS = 500_000
#: Buckets, or ranges of buckets, that one flush sends to.
SPREAD = 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

SIGNED = "doc_id long, n_words long, sha string"
SENT = "bucket int, payload binary"
MARKS = "doc_id long, at binary"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sha = [], []
        for text in batch.column("text").to_pylist():
            words = text.encode().split()
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "sha"])


class Sender:
    """Collects (hash, check, document, position, run), settles repeats within the task, sends the rest by bucket. An
    entry stands for run windows of one hash, from position on.

    Entries with anchor are what others may repeat (all of them, where wide). An entry whose hash has an anchor in a
    smaller document is settled here: it becomes a mark, and so does that anchor unless wide; of the others, all go
    out, but a settled hash sends no more than the entries up to that smallest document. With per above 1 they are sent
    to ranges of per buckets, with all bits of their hash."""

    def __init__(self, buckets: int, wide: bool, per: int = 1):
        self.buckets, self.wide, self.per, self.held, self.n = buckets, wide, per, [], 0

    def add(self, key, check, doc, pos, run, anchor) -> Iterator[pa.RecordBatch]:
        self.held.append((key, check, doc, pos.astype(np.uint32), run.astype(np.uint32), anchor))
        self.n += len(key)
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        key, check, doc, pos, run, anchor = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        later, least, first = _settle(key, check, doc, anchor)
        marks = np.flatnonzero(later if self.wide else later | least)
        if len(marks):
            yield _sent(_marks(doc[marks], pos[marks], run[marks], first[marks]), self.buckets)
        rest = np.flatnonzero(~later)
        bucket = (((key[rest] >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)) // np.uint64(self.per)
        by = np.argsort(bucket.astype(np.uint16) if self.buckets // self.per <= 65536 else bucket, kind="stable")
        rest, bucket = rest[by], bucket[by]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        payloads, of = [], []
        for lo, hi in zip([0, *cuts], [*cuts, len(rest)], strict=True):
            if hi > lo:
                i = rest[lo:hi]
                payloads.append(_pack(key[i], check[i], doc[i], pos[i], run[i], anchor[i], self.wide, self.per > 1))
                of.append(int(bucket[lo]))
        if payloads:
            yield pa.record_batch([pa.array(of, pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "payload"])


def _runs(key: np.ndarray, check: np.ndarray, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, how many) of windows of the same words that follow one another in a text."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1]) | (text[1:] != text[:-1]) | (np.diff(at) != 1)
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(key)))


def _settle(key, check, doc, anchor) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries with an anchor of the same hash in a smaller document, the anchors of the smallest one that they met,
    and that smallest document."""
    n = len(key)
    order = np.lexsort((check, key))
    key, check, doc, anchor = key[order], check[order], doc[order], anchor[order]
    later, least, first = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int64)
    same = (key[1:] == key[:-1]) & (check[1:] == check[:-1])
    twin = np.zeros(n, bool)
    twin[1:] |= same
    twin[:-1] |= same
    at = np.flatnonzero(twin)
    if len(at):
        new = np.ones(len(at), bool)
        new[1:] = ~same[at[1:] - 1] | (np.diff(at) > 1)
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        smallest = np.minimum.reduceat(np.where(anchor[at], doc[at], np.iinfo(np.int64).max), starts)[group]
        later[at] = doc[at] > smallest
        met = np.logical_or.reduceat(later[at], starts)
        least[at] = anchor[at] & met[group] & ~later[at]
        first[at] = smallest
    out = np.empty(n, np.int64)
    out[order] = np.arange(n)
    return later[out], least[out], first[out]


def _pack(key, check, doc, pos, run, anchor, wide: bool, ranged: bool = False) -> bytes:
    """Entries as bytes: documents once, positions as steps within a document, the hash's bits below the bucket's (all of
    them where ranged)."""
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(doc))).astype(np.uint32)
    step = pos.copy()
    step[1:] = np.where(new[1:], pos[1:], pos[1:] - pos[:-1])
    ids = doc[starts]
    head = np.array([len(doc), len(starts)], np.int64).tobytes()
    ids = np.concatenate([ids[:1], np.diff(ids)]).astype(np.int64)
    body = planes(ids) + planes(counts) + planes(step) + planes(run)
    key = key if wide or ranged else key.astype(np.uint32)
    return head + body + key.tobytes() + (check.tobytes() if wide else np.packbits(anchor).tobytes())


def _unpack(payload: bytes, wide: bool, ranged: bool = False):
    raw = np.frombuffer(payload, np.uint8)
    n, m = np.frombuffer(payload[:16], np.int64)
    raw = raw[16:]
    ids = np.cumsum(from_planes(raw, m, np.int64))
    raw = raw[8 * m :]
    counts = from_planes(raw, m, np.uint32).astype(np.int64)
    raw = raw[4 * m :]
    step = from_planes(raw, n, np.uint32).astype(np.int64)
    raw = raw[4 * n :]
    runs = from_planes(raw, n, np.uint32)
    raw = raw[4 * n :]
    run = np.cumsum(step)
    starts = np.cumsum(counts) - counts
    before = run[starts] - step[starts]
    pos = (run - np.repeat(before, counts)).astype(np.uint32)
    doc = np.repeat(ids, counts)
    if wide:
        return raw[: 8 * n].copy().view(np.uint64), raw[8 * n : 16 * n].copy().view(np.uint64), doc, pos, runs, np.ones(n, bool)
    bits = np.uint64 if ranged else np.uint32
    size = np.dtype(bits).itemsize * n
    return raw[:size].copy().view(bits), np.zeros(n, np.uint32), doc, pos, runs, np.unpackbits(raw[size:], count=n).astype(bool)


def _marks(doc, pos, run, first) -> pa.RecordBatch:
    """One row for each document: n, and the positions, runs and first documents of its marks as bytes."""
    order = np.argsort(doc, kind="stable")
    doc, pos, run, first = doc[order], pos[order], run[order].astype(np.uint32), first[order]
    cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    ends = np.append(cuts[1:], len(doc))
    packed = [planes(pos[a:b]) + planes(run[a:b]) + planes(first[a:b]) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
    return pa.record_batch([pa.array(doc[cuts], pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "at"])


def _unmarked(marks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, runs, first documents) of a document's marks."""
    out = [(np.zeros(0, np.int64),) * 3]
    for one in marks:
        raw, n = np.frombuffer(one, np.uint8), len(one) // 16
        out.append((from_planes(raw, n, np.uint32).astype(np.int64), from_planes(raw[4 * n :], n, np.uint32).astype(np.int64), from_planes(raw[8 * n :], n, np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sent(marks: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    """Marks that travel beside the buckets: a bucket below 0 (at least as many as buckets, dealt by content), their rows as
    one Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, marks.schema) as out:
        out.write_batch(marks)
    raw = sink.getvalue().to_pybytes()
    return pa.record_batch([pa.array([-1 - zlib.crc32(raw) % max(buckets, 1024)], pa.int32()), pa.array([raw], pa.binary())], ["bucket", "payload"])


def _probes(buckets: int, window: int, per: int = 1):
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(buckets, False, per)
        for rows, data, offsets in common.slices(batches):
            words = Words(data, offsets)
            at, text = positions(words.bounds, block)
            long = words.counts[text] >= window
            at, text = at[long], text[long]
            if len(at):
                key, none = window_hashes(words.hashes(), block, at), np.zeros(len(at), np.uint32)
                pos = at - words.bounds[text]
                starts, n = _runs(key, none, text, at)
                anchor = np.logical_or.reduceat(pos % block == 0, starts)
                yield from sender.add(key[starts], none[starts], rows.column("doc_id").to_numpy()[text[starts]], pos[starts], n, anchor)
        yield from sender.flush()

    return run


def _windows(buckets: int, window: int, per: int = 1):
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(buckets, True, per)
        for rows, data, offsets in common.slices(batches):
            words = Words(data, offsets)
            ids, marks = rows.column("doc_id").to_numpy(), rows.column("at")
            firsts, text = [], []
            for i in range(len(ids)):
                near = np.zeros(max(words.counts[i] - window + 1, 0) + 1, np.int64)
                hit, n, _ = _unmarked(marks[i].as_py())
                np.add.at(near, np.clip(hit - block, 0, len(near) - 1), 1)
                np.add.at(near, np.minimum(hit + n, len(near) - 1), -1)
                found = np.flatnonzero(np.cumsum(near)[:-1] > 0)
                firsts.append(found + words.bounds[i])
                text.append(np.full(len(found), i))
            at, text = np.concatenate(firsts), np.concatenate(text)
            if len(at):
                digest = window_digests(words, window, at)
                starts, n = _runs(digest[:, 0], digest[:, 1], text, at)
                yield from sender.add(digest[starts, 0], digest[starts, 1], ids[text[starts]], (at - words.bounds[text])[starts], n, np.ones(len(starts), bool))
        yield from sender.flush()

    return run


def _spread(words: int) -> tuple[int, int]:
    """(buckets, how many of them a range has) for so many words."""
    buckets = max(48, words // BUCKET_WORDS)
    per = -(-buckets // SPREAD)
    return (buckets, 1) if per == 1 else (per * SPREAD, per)


def _ranges(buckets: int, wide: bool):
    """Sends the entries of ranges of buckets, a range after the other, to their buckets. Marks pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, held = Sender(buckets, wide), None
        for batch in batches:
            for i, of in enumerate(batch.column("bucket").to_pylist()):
                if of < 0:
                    yield batch.slice(i, 1)
                    continue
                if of != held:
                    yield from sender.flush()
                    held = of
                yield from sender.add(*_unpack(batch.column("payload")[i].as_py(), wide, ranged=True))
        yield from sender.flush()

    return run


def _met(sent: DataFrame, buckets: int, per: int, wide: bool) -> DataFrame:
    """Marks of all that was sent. A range that holds many rows may be split between tasks: each sends its own part on."""
    if per > 1:
        sent = sent.hint("rebalance", "bucket").sortWithinPartitions("bucket").mapInArrow(_ranges(buckets, wide), SENT)
    return sent.groupBy("bucket").applyInArrow(_meet(wide), MARKS)


def _meet(wide: bool):
    """One bucket: the entries with an anchor in a smaller document, and what they met unless wide."""

    def run(rows: pa.Table) -> pa.Table:
        empty = pa.table({"doc_id": pa.array([], pa.int64()), "at": pa.array([], pa.binary())})
        if not rows.num_rows:
            return empty
        if rows.column("bucket")[0].as_py() < 0:
            return pa.concat_tables([pa.ipc.open_stream(x.as_py()).read_all() for x in rows.column("payload")])
        key, check, doc, pos, runs, anchor = (np.concatenate(x) for x in zip(*(_unpack(x.as_py(), wide) for x in rows.column("payload")), strict=True))
        later, least, first = _settle(key, check, doc, anchor)
        found = np.flatnonzero(later if wide else later | least)
        return pa.Table.from_batches([_marks(doc[found], pos[found], runs[found], first[found])]) if len(found) else empty

    return run


def _extended(marks: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, earlier document) of the maximal repeats of a document: windows that follow one another and
    stand in the same earlier document are one."""
    pos, run, first = _unmarked(marks)
    order = np.lexsort((first, pos))
    pos, run, first = pos[order], run[order], first[order]
    new = np.ones(len(pos), bool)
    new[1:] = (first[1:] != first[:-1]) | (pos[1:] > pos[:-1] + run[:-1])
    starts = np.flatnonzero(new)
    ends = np.maximum.reduceat(pos + run, starts) if len(starts) else pos
    return pos[starts], ends - pos[starts] + window - 1, first[starts]


def _cut(window: int):
    """Takes the words of the repeats out of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept = [], [], []
            for text, marks in zip(batch.column("text"), batch.column("at"), strict=True):
                words = text.as_py().encode().split()
                start, length, _ = _extended(marks.as_py(), window)
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + length, -1)
                stays = np.cumsum(cover)[:-1] == 0
                n.append(len(words))
                removed.append(len(words) - int(stays.sum()))
                kept.append(b" ".join(words[i] for i in np.flatnonzero(stays)).decode())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def _listed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_extended(x.as_py(), window) for x in batch.column("at")]
            ids = np.repeat(batch.column("doc_id").to_numpy(), [len(x[0]) for x in found])
            yield pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True))] if found else [pa.array([], pa.int64())] * 4, ["doc_id", "start", "length", "source_id"])

    return run


def maximal_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, source_id: stretches of a document's words (length of them from the word start on, 0 the
    first) whose windows all stand in the earlier document source_id (one of those that have them; which one may
    depend on how rows are dealt). Exact copies have no rows here: repeats() names them."""
    return repeats(docs, window)[2].mapInArrow(_listed(window), "doc_id long, start long, length long, source_id long")


def repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures, exact copies, removed windows) of documents (doc_id, text).

    Signatures: doc_id, n_words, sha of the words joined by a space. Copies: doc_id of those of at least window words
    whose words are all a smaller doc_id's. Removed windows: doc_id, at (marks, see _marks), of the documents that are
    no copies."""
    if window % 2:
        raise ValueError("window must be even")
    spark = docs.sparkSession
    common.session_paths(spark)
    docs = docs.select("doc_id", common.text_or_empty())
    signed = common.table(docs.mapInArrow(_signatures, SIGNED), "signed")
    total = signed.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    buckets, per = _spread(total)
    long = signed.filter(F.col("n_words") >= window)
    firsts = long.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = common.table(firsts.select("sha", "first"), "firsts")  # read back, so that the join can split a hot group
    copies = long.join(firsts, "sha").filter(F.col("doc_id") > F.col("first")).select("doc_id").distinct()
    docs = docs.filter("doc_id is not null")
    met = _met(docs.mapInArrow(_probes(buckets, window, per), SENT), buckets, per, False)
    anchors = common.table(met.groupBy("doc_id").agg(F.collect_list("at").alias("at")).join(copies, "doc_id", "left_anti"), "anchors")
    near = common.only_ids(docs, anchors, anchors.count()).join(anchors, "doc_id")
    cut = _met(near.mapInArrow(_windows(buckets, window, per), SENT), buckets, per, True)
    removed = common.table(cut.groupBy("doc_id").agg(F.collect_list("at").alias("at")), "removed")
    return signed, copies, removed


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (null where nothing is removed: the text's words stay as they are) and
    kept_sha256 of every document. Order of words is kept; windows are judged on the input."""
    signed, copies, removed = repeats(docs, window)
    docs = docs.select("doc_id", common.text_or_empty())
    cut = common.only_ids(docs, removed, removed.count()).join(removed, "doc_id").mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_text string")
    cut = cut.withColumn("kept_sha256", F.sha2("kept_text", 256))
    copy = copies.withColumn("copy", F.lit(True))
    gone = removed.select("doc_id").withColumn("cut", F.lit(True))
    rest = signed.join(copy, "doc_id", "left").join(gone, "doc_id", "left").filter("cut is null")
    whole = rest.select("doc_id", "n_words", F.expr("if(copy, n_words, 0L)").alias("n_removed"), F.expr("if(copy, '', null)").alias("kept_text"), F.expr(f"if(copy, '{EMPTY_SHA}', sha)").alias("kept_sha256"))
    return whole.unionByName(cut)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP1_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), starts as (
  select doc_id, w, unnest(range(1, len(w) - 48)) as i from words where len(w) >= 50
), windows as (
  select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from starts
), repeated as (
  select doc_id, i from (select doc_id, i, min(doc_id) over (partition by h) as first from windows) where doc_id > first
), gone as (
  select distinct doc_id, unnest(range(i, i + 50)) as k from repeated
), each as (
  select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from words
), kept as (
  select e.doc_id, string_agg(e.word, ' ' order by e.k) as t, count(*) as n
  from each e left join gone g on e.doc_id = g.doc_id and e.k = g.k where g.k is null group by e.doc_id
)
select w.doc_id, len(w.w)::bigint as n_words, (len(w.w) - coalesce(k.n, 0))::bigint as n_removed,
       sha256(coalesce(k.t, '')) as kept_sha256
from words w left join kept k on w.doc_id = k.doc_id
"""
