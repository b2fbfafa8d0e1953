"""Fill-in-middle by one numpy kernel over the UTF-8 buffers of a batch of texts.

A text's units are runs of ASCII letters and single other characters. Each byte is looked up in a table of classes
(letter, continuation byte, other); a unit begins at each byte that is no continuation and doesn't carry on a run of
letters, which the classes of adjacent bytes tell. Running sums of these marks, less what stands before a document, number
the units within it, and one searchsorted finds the two cuts of all rows. Prefix, middle and suffix are then ranges of the
one buffer, and Arrow joins them with the marks of the form.

Draws come from the SHA-256 of doc_id, so a repeated task makes the same cuts.

Cases: a null or empty text is empty and plain, as is one that holds a mark already; a null doc_id draws as the empty
one; repeated rows are cut alike; a long text is a batch of its own, whose sums are kept by blocks; an empty table gives
an empty result; other columns pass untouched, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts, those that are transformed; of 100 transformed ones, those with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
SEED = "1"
#: Bytes whose running sums are held at once.
BLOCK = 1 << 20

LETTER, FOLLOWS = 1, 2
_class = np.zeros(256, np.uint8)
_class[65:91] = _class[97:123] = LETTER
_class[0x80:0xC0] = FOLLOWS

MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: str = "doc_id", seed: str = SEED) -> list[Column]:
    """Four integers of 32 bits: the first 8-digit groups of the hex SHA-256 of seed, a colon and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each byte, whether a unit begins there."""
    kind = _class[data]
    starts = kind != FOLLOWS
    letter = kind == LETTER
    starts[1:] &= ~(letter[1:] & letter[:-1])
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    return starts


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of mask are true in each of the ranges between offsets, which cover it."""
    out = np.zeros(len(offsets) - 1, np.int64)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.add.reduceat(mask, offsets[some], dtype=np.int64)
    return out


def _places(mask: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each of the wanted (counted from 0) true ones of mask stands."""
    edges = np.arange(0, len(mask), BLOCK)
    total = np.cumsum(np.add.reduceat(mask, edges, dtype=np.int64))
    block = np.searchsorted(total, wanted, "right")
    out = np.empty(len(wanted), np.int64)
    for b in np.unique(block).tolist():
        mine = block == b
        run = np.cumsum(mask[edges[b] : edges[b] + BLOCK], dtype=np.int32)
        out[mine] = edges[b] + np.searchsorted(run, wanted[mine] - (total[b - 1] if b else 0), "right")
    return out


def cuts(data: np.ndarray, offsets: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units of each text, bytes at which its prefix and its middle end). one and two are draws: modulo the units and
    one, they say after how many units."""
    starts = unit_starts(data, offsets)
    n = _sums(starts, offsets)
    before = np.cumsum(n) - n
    ends = []
    for units in (np.minimum(one % (n + 1), two % (n + 1)), np.maximum(one % (n + 1), two % (n + 1))):
        at = offsets[1:].copy()
        inner = np.flatnonzero(units < n)
        if len(inner):
            at[inner] = _places(starts, (before + units)[inner])
        ends.append(at)
    return n, ends[0], ends[1]


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return common.binary_array(data, offsets)


def _as_text(x: pa.Array | pa.ChunkedArray) -> pa.Array:
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return pa.Array.from_buffers(pa.string(), len(x), x.buffers(), x.null_count, x.offset)


def _arrange(marks: tuple[bytes, ...], rate: int, suffix_first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = (pa.scalar(x, pa.binary()) for x in marks)
        for rows, data, offsets in common.slices(batches, "x_text"):
            one, two, three, four = (rows.column(f"x_{k}").to_numpy() for k in range(4))
            texts = _binary(data, offsets)
            marked = np.zeros(len(texts), bool)
            for mark in marks:
                marked |= pc.match_substring(_as_text(texts), mark.decode()).to_numpy(zero_copy_only=False)
            plain = (np.diff(offsets) == 0) | marked | (three % 100 >= rate)
            spm = pa.array(four % 100 < suffix_first)
            n, low, high = cuts(data, offsets, one, two)
            edges = np.empty(3 * len(n) + 1, np.int64)
            edges[:-1:3], edges[1::3], edges[2::3], edges[-1] = offsets[:-1], low, high, offsets[-1]
            parts = _binary(data, edges)
            prefix, middle, suffix = (parts.take(pa.array(np.arange(k, len(parts), 3))) for k in range(3))
            joined = pc.binary_join_element_wise(pc.if_else(spm, s, p), pc.if_else(spm, suffix, prefix), pc.if_else(spm, p, s), pc.if_else(spm, prefix, suffix), m, middle, pa.scalar(b"", pa.binary()))
            output = _as_text(pc.if_else(pa.array(plain), texts, joined))
            chars = _sums(_class[data] != FOLLOWS, edges)
            form = pc.if_else(pa.array(plain), "plain", pc.if_else(spm, "spm", "psm"))
            made = [pa.array(n), form, pa.array(chars[0::3], mask=plain), pa.array(chars[1::3], mask=plain), output]
            yield pa.record_batch([rows.column("x_row"), *made], ["row", *(x.split()[0] for x in MADE.split(", "))])

    return run


def _distinct_marks(marks: tuple[str, ...]) -> None:
    """Fails where marks and text beside them could be read as other marks: none may hold or overlap another or itself."""
    for a, b in product(marks, repeat=2):
        if not a or (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))) or marks.count(a) > 1:
            raise ValueError(f"marks {a!r} and {b!r} can't be told apart")


def fill_in_middle(docs: DataFrame, marks: tuple[str, str, str] = MARKS, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """row (a struct of docs' columns without text), n (units), form (plain, psm or spm), prefix_chars, middle_chars (null
    where plain), output; of docs (doc_id, text)."""
    _distinct_marks(marks)
    common.session_paths(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("x_row")
    held = docs.select(row, common.text_or_empty().alias("x_text"), *[x.alias(f"x_{k}") for k, x in enumerate(draws(seed=seed))])
    return held.mapInArrow(_arrange(tuple(x.encode() for x in marks), rate, suffix_first), f"row {held.schema['x_row'].dataType.simpleString()}, {MADE}")


def restored(output: str = "output", form: str = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of: each mark stands in it once, and parts the three pieces."""
    pieces = F.split(output, "|".join(re.escape(x) for x in marks))
    first, second, middle = (F.get(pieces, F.lit(k)) for k in (1, 2, 3))
    return F.when(F.col(form) == "psm", F.concat(first, middle, second)).when(F.col(form) == "spm", F.concat(second, middle, first)).otherwise(F.col(output))


def rewrite(docs: DataFrame, **settings) -> DataFrame:
    """docs with each text in its form."""
    made = fill_in_middle(docs, **settings)
    return made.select(*[F.col("output" if c == "text" else f"row.`{c}`").alias(c) for c in docs.columns])


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return made.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


OP11_SQL = """
with drawn as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents
), split as (
  select doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as w, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from drawn
), placed as (
  select *, len(w) as n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) as a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) as b from split
), parts as (
  select doc_id, text, n, array_to_string(w[1:a], '') as p, array_to_string(w[a + 1:b], '') as m, array_to_string(w[b + 1:n], '') as s,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from placed
)
select doc_id, n::bigint as n, form, (case when form <> 'plain' then length(p) end)::bigint as prefix_chars, (case when form <> 'plain' then length(m) end)::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256 from parts
"""
