"""Token-ID output as directly addressable codes.

A segment holds the ids of consecutive documents. Level 0 has the lowest 8 bits of every id, level 1 the next 8 bits
of the ids that need them, and so on; each level but the last has a bitmap that says which of its entries go on, and
a directory of the ones before every 512 bits of it. Entry i of a level goes on at entry rank(i) of the next, so any
id is read with one look into each level and no other id is decoded.

Segment (all integers little-endian): `DAC1`, uint32 levels, uint64 ids; for each level uint64 entries, the entries
(a byte each), and but for the last level the bitmap (ceil(entries / 8) bytes, low bit first) and the directory
(ceil(entries / 512) uint32).

Files: a Parquet table of segments in order (part, segment), with first (ids before it in its part), doc_ids, counts
and payload, neither compressed nor dictionary-coded, so that a payload's bytes lie in the file as they are: Spark's
writer commits whole tasks, on any store that the session can reach. Documents are range-partitioned by doc_id and
how their text begins, so part and segment follow doc_id, and many rows without one don't meet in one task; where a
document starts is the sum of the parts and segments before it. tokens_at() finds
the segments of asked positions by these sums, reads no other payload, and looks once into each level of a code.

Cases: a null or empty text has the end id alone; rows without a doc_id come first; rows that repeat a doc_id follow
one another by text; a very long document has a segment of its own; an empty table writes no segment; other columns
are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common
from lectern.llm.coder import coder, vocabulary_path
from lectern.llm.words import Words

END_ID = 2
#: Ids of a segment, so that payloads stay well under a megabyte; a document isn't split.
SEGMENT_IDS = 1 << 17
BLOCK = 512
#: Characters of a text that ranges tell rows of one doc_id apart by.
BEGINS = 32
#: Bytes of text encoded at once: distinct words are fewer over longer slices.
SLICE = 1 << 20
SEGMENTS = "part int, segment int, first long, doc_ids array<long>, counts array<long>, n_ids long, payload binary"
MAGIC = b"DAC1"


def encode(ids: np.ndarray) -> bytes:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        entries = (rest & np.uint32(255)).astype(np.uint8)
        more = rest > 255
        head = np.uint64(len(entries)).tobytes() + entries.tobytes()
        if not more.any():
            levels.append(head)
            break
        sums = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64)
        before = (np.cumsum(sums) - sums).astype(np.uint32)
        levels.append(head + np.packbits(more, bitorder="little").tobytes() + before.tobytes())
        rest = rest[more] >> np.uint32(8)
    return MAGIC + np.uint32(len(levels)).tobytes() + np.uint64(len(ids)).tobytes() + b"".join(levels)


class Segment:
    """Reads one segment's payload."""

    def __init__(self, payload: bytes | pa.Buffer):
        if bytes(payload[:4]) != MAGIC:
            raise ValueError("not a segment")
        raw = np.frombuffer(payload, np.uint8)
        n = int(raw[4:8].copy().view(np.uint32)[0])
        self.size = int(raw[8:16].copy().view(np.uint64)[0])
        self.levels, at = [], 16
        for level in range(n):
            m = int(raw[at : at + 8].copy().view(np.uint64)[0])
            entries = raw[at + 8 : at + 8 + m]
            at += 8 + m
            bits = before = None
            if level < n - 1:
                bits = raw[at : at + -(-m // 8)]
                at += -(-m // 8)
                before = raw[at : at + 4 * -(-m // BLOCK)].copy().view(np.uint32)
                at += 4 * -(-m // BLOCK)
            self.levels.append((entries, bits, before))

    def __getitem__(self, i: int) -> int:
        out = 0
        for k, (entries, bits, before) in enumerate(self.levels):
            out |= int(entries[i]) << (8 * k)
            if bits is None or not bits[i // 8] >> (i % 8) & 1:
                return out
            block = i // BLOCK
            inside = np.unpackbits(bits[block * BLOCK // 8 : i // 8 + 1], bitorder="little")[: i - block * BLOCK]
            i = int(before[block]) + int(inside.sum())
        return out

    def all(self) -> np.ndarray:
        out = np.zeros(self.size, np.uint32)
        at = None
        for k, (entries, bits, _) in enumerate(self.levels):
            value = entries.astype(np.uint32) << np.uint32(8 * k)
            if at is None:
                out |= value
                at = np.arange(self.size) if bits is None else np.flatnonzero(np.unpackbits(bits, count=len(entries), bitorder="little"))
            else:
                out[at] |= value
                if bits is not None:
                    at = at[np.unpackbits(bits, count=len(entries), bitorder="little").astype(bool)]
        return out


def token_ids(words: Words, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts with the end id after each, how many each text has)."""
    ids, per_word = coder(path).encode(words)
    run = np.append(0, np.cumsum(per_word))
    ends = run[words.bounds[1:]]
    return np.insert(ids, ends, np.uint32(end)), np.diff(np.append(0, ends)) + 1


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.hold("coder", coder.cache_clear)
        segment, part, first, names, counts, ids, n = 0, 0, 0, [], [], [], 0

        def out():
            nonlocal segment, first, names, counts, ids, n
            flat = np.concatenate(ids)
            columns = [[part], [segment], [first], [[x for some in names for x in some]], [np.concatenate(counts)], [len(flat)], [encode(flat)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            batch = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "segment", "first", "doc_ids", "counts", "n_ids", "payload"])
            segment, first, names, counts, ids, n = segment + 1, first + len(flat), [], [], [], 0
            return batch

        for rows, data, offsets in common.slices(batches, limit=SLICE):
            part = rows.column("part")[0].as_py()
            flat, per_text = token_ids(Words(data, offsets), path, end)
            names.append(rows.column("doc_id").to_pylist())
            counts.append(per_text)
            ids.append(flat)
            n += len(flat)
            if n >= SEGMENT_IDS:
                yield out()
        if n:
            yield out()

    return run


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = Segment(batch.column("payload")[i].as_py()).all().astype("<u4")
            counts = np.array(batch.column("counts")[i].as_py(), np.int64)
            ends = np.cumsum(counts)
            starts = ends - counts + batch.column("before")[i].as_py()
            sums = [zlib.crc32(ids[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.record_batch([batch.column("doc_ids")[i].values, pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END_ID) -> None:
    """Writes the documents (doc_id, text) as segments under path."""
    common.session_paths(docs.sparkSession)
    placed = docs.select("doc_id", common.text_or_empty()).repartitionByRange("doc_id", F.left("text", F.lit(BEGINS)))
    placed = placed.sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    placed.mapInArrow(_encode(vocabulary or vocabulary_path(), end), SEGMENTS).write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The segments under path and before, the ids of all segments before each. Only sums of whole parts are joined,
    and the one window without a key has a row for each part."""
    listed = spark.read.schema(SEGMENTS).parquet(path)
    parts = listed.groupBy("part").agg(F.sum("n_ids").alias("n")).selectExpr("part", "sum(n) over (order by part) - n as base")
    parts = F.broadcast(parts) if parts.count() <= common.BROADCAST_IDS else parts
    return listed.join(parts, "part").withColumn("before", F.col("base") + F.col("first"))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    common.session_paths(spark)
    return read(spark, path).select("doc_ids", "counts", "payload", "before").mapInArrow(_decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, ids = [], []
        for payload, before, asked in zip(batch.column("payload"), batch.column("before").to_pylist(), batch.column("asked").to_pylist(), strict=True):
            segment = Segment(payload.as_buffer())
            at += asked
            ids += [segment[i - before] for i in asked]
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(ids, pa.int64())], ["position", "id"])


def tokens_at(spark: SparkSession, path: str, positions: list[int]) -> DataFrame:
    """position, id of the asked positions (0 is the first id of the first document); those beyond the end have no row."""
    common.session_paths(spark)
    held = read(spark, path)
    asked = F.lit(sorted({int(x) for x in positions})).cast("array<long>")
    here = F.filter(asked, lambda x: (x >= F.col("before")) & (x < F.col("before") + F.col("n_ids")))
    found = common.table(held.select("part", "segment", "before", here.alias("asked")).filter(F.size("asked") > 0), "asked")
    segments = spark.read.schema(SEGMENTS).parquet(path).select("part", "segment", "payload")
    return segments.join(F.broadcast(found), ["part", "segment"]).select("payload", "before", "asked").mapInArrow(_looked_up, "position long, id long")


def write_and_digest(docs: DataFrame) -> DataFrame:
    """Token files in the shared folder, until the session ends, and their digest."""
    spark = docs.sparkSession
    path = f"{common.shared_folder(spark)}/lectern-tokens-{uuid.uuid4().hex}"
    write(docs, path)
    common.gone_at_end(spark, path)
    return digest(spark, path)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
