"""PII by information-theoretic sanitisation.

Protected entities are email addresses, IP addresses, card numbers and phone numbers, found by pattern, and secrets: runs
of 16 and more ASCII letters and digits that carry MIN_SECRET bits in all, and MIN_RATE bits a byte (LETTERS_RATE without
a digit), under the corpus' own statistics of byte pairs. Words of any language are cheap there, keys are not.

The corpus then says which terms reveal them. What may be revealed is an entity (this address) or a kind of entity (a
secret). For each of these and each word within SPAN words of a mention, the mentions and their different contexts are
counted; the probability of the entity or kind given the word comes from the word's occurrences in the whole corpus.
A term is disclosing when it stands with it in at least MIN_CONTEXTS different contexts, MIN_POSTERIOR of its
occurrences are near it, and it makes it MIN_BITS bits likelier than it is anyhow. Terms that disclose an entity are
spans of kind `term` wherever they occur and are removed; terms that disclose a kind are spans where an entity of that
kind is within SPAN words, and are generalised to the kind, as entities are ([email], [secret]).

Copies of one passage are no evidence, edited ones neither: of a term's contexts, MIN_CONTEXTS must
differ from each other: of any two, at least MIN_DIVERSITY of the longer one's words are not in both. This doesn't
fall with the number of mentions. Contexts are taken in the order of their hashes; where likeness is not transitive (a like b,
b like c, a unlike c) the order decides which count. All patterns read ASCII only, so they run over UTF-8 bytes, in time linear in the text; offsets are
given in code points.

Cases: null and empty texts have no spans and the hash of the empty string; rows without a doc_id and repeated rows
are judged each like any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common
from lectern.llm.words import FOLDED, Words, mix

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
SECRET = len(BASE)
SPAN = 8
MIN_CONTEXTS = 4
MIN_POSTERIOR = 0.5
MIN_BITS = 5.0
#: Least share of the longer of two contexts' words that is not in both, where they are no copies of each other.
MIN_DIVERSITY = 0.4
#: Bytes that a term has at least.
TERM_BYTES = 3
#: Bytes, bits and bits a byte that a secret has at least.
SECRET_BYTES = 16
MIN_SECRET = 64.0
MIN_RATE = 4.5
LETTERS_RATE = 6.5

_local = np.zeros(256, bool)
_local[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"]] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True
ALNUM = _digit.copy()
ALNUM[65:91] = ALNUM[97:123] = True
LOCAL = frozenset(np.flatnonzero(_local).tolist())
_domain = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_card = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_digits = re.compile(rb"[^0-9]+")


def emails(raw: bytes) -> list[tuple[int, int]]:
    """As the leftmost matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`: each @ ends one run of local
    characters, so it is looked at once."""
    out, end, at = [], 0, raw.find(b"@")
    while at >= 0:
        start = at
        while start > end and raw[start - 1] in LOCAL:
            start -= 1
        if start < at and (found := _domain.match(raw, at + 1)):
            end = found.end()
            out.append((start, end))
        at = raw.find(b"@", max(at + 1, end))
    return out


def luhn(digits: bytes) -> bool:
    values = [d - 48 for d in digits[::-1]]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def base_spans(raw: bytes, at: bool = True, plus: bool = True, digit: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) in bytes, ascending. at, plus, digit: may raw hold such a character."""
    out = [(s, 0, e) for s, e in emails(raw)] if at else []
    if digit:
        for m in _ip.finditer(raw):
            parts = [x.lstrip(b"0") for x in m[0].split(b".")]
            if all(len(x) < 4 and int(x or b"0") <= 255 for x in parts):
                out.append((m.start(), 1, m.end()))
        for m in _card.finditer(raw):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits.sub(b"", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if plus:
        for m in _phone.finditer(raw):
            if 10 <= len(_digits.sub(b"", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _found(data: np.ndarray, offsets: np.ndarray, pairs: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Spans of the texts that have any. pairs: bits of each byte after each other byte."""

    def has(mask):
        run = np.append(0, np.cumsum(mask))
        return run[offsets[1:]] > run[offsets[:-1]]

    at, plus, digit = has(data == 64), has(data == 43), has(_digit[data])
    out = {}
    for i in np.flatnonzero(at | digit):
        if spans := base_spans(data[offsets[i] : offsets[i + 1]].tobytes(), at[i], plus[i] and digit[i], digit[i]):
            out[int(i)] = spans
    for i, mine in groupby(secrets(data, offsets, pairs), lambda x: x[0]):
        _, starts, ends = zip(*mine, strict=True)
        known = out.get(i, [])
        free = ~_covered(known, np.array(starts), np.array(ends))  # runs don't overlap each other
        out[i] = sorted([*known, *((s, SECRET, e) for s, e, good in zip(starts, ends, free.tolist(), strict=True) if good)])
    return {i: spans for i, spans in out.items() if spans}


def secrets(data: np.ndarray, offsets: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, start, end) of runs of letters and digits that the corpus finds unlikely."""
    runs = Words(data, offsets, ALNUM)
    size = runs.ends - runs.starts
    digits = np.append(0, np.cumsum(_digit[data]))
    n = digits[runs.ends] - digits[runs.starts]
    out = []
    for k in np.flatnonzero((size >= SECRET_BYTES) & (size - n >= 2)).tolist():
        raw = data[runs.starts[k] : runs.ends[k]]
        bits = float(pairs[raw[:-1], raw[1:]].sum(dtype=np.float64))
        if bits >= MIN_SECRET and bits >= (MIN_RATE if n[k] else LETTERS_RATE) * (len(raw) - 1):
            i = int(np.searchsorted(runs.bounds, k, "right") - 1)
            out.append((i, int(runs.starts[k] - offsets[i]), int(runs.ends[k] - offsets[i])))
    return out


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pair, n: how often two bytes follow one another in a text; pair -1: how many words there are."""
    seen, words = np.zeros(1 << 16, np.int64), 0
    for _, data, offsets in common.slices(batches):
        words += len(Words(data, offsets, FOLDED, lower=True))
        both = (data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:]
        inside = np.ones(len(both), bool)
        edges = offsets[1:-1]
        inside[edges[(edges > 0) & (edges < len(data))] - 1] = False
        seen += np.bincount(both[inside], minlength=1 << 16)
    at = np.flatnonzero(seen)
    yield pa.record_batch([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], words), pa.int64())], ["pair", "n"])


def byte_pairs(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(bits of each byte after each other byte, one added to each count; number of words) in the whole corpus. At most
    65537 rows reach the driver, whatever the corpus."""
    got = docs.mapInArrow(_count_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pair, n = got.column("pair").to_numpy(), got.column("n").to_numpy()
    counts = np.ones(1 << 16)
    counts[pair[pair >= 0]] += n[pair >= 0]
    counts = counts.reshape(256, 256)
    return (np.log2(counts.sum(axis=1, keepdims=True)) - np.log2(counts)).astype(np.float32), int(n[pair < 0].sum())


def _entity(raw: bytes, kind: int) -> int:
    """Its hash; kinds themselves are the integers from 0 on, which no entity has."""
    name = raw.lower() if kind < 2 else raw if kind == SECRET else _digits.sub(b"", raw)
    return int.from_bytes(hashlib.blake2b(bytes([kind]) + name, digest_size=8).digest(), "little", signed=True)


def _near(words: Words, i: int, start: int, spans: list[tuple[int, int, int]]) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
    """Each span of text i and the words (of the slice) within SPAN words of it that are in no span."""
    lo, hi = words.bounds[i], words.bounds[i + 1]
    starts, ends = words.starts[lo:hi] - start, words.ends[lo:hi] - start
    inside = np.zeros(hi - lo, bool)
    for s, _, e in spans:
        inside[np.searchsorted(ends, s, "right") : np.searchsorted(starts, e)] = True
    free = np.flatnonzero(~inside)
    left, right = np.searchsorted(starts[free], [s for s, _, _ in spans]), np.searchsorted(starts[free], [e for _, _, e in spans])
    for span, a, b in zip(spans, left.tolist(), right.tolist(), strict=True):
        yield span, free[max(0, a - SPAN) : b + SPAN] + lo


CONTEXTS = "entity long, kind int, context long, terms array<long>, n long, counts array<long>"


def _contexts(pairs: np.ndarray):
    """entity, kind, context, terms (ascending), n: the words near each mention, copies of a context once with n. And,
    in a row without an entity, how often (counts) the terms near any mention occur in a slice of texts that has one:
    what they occur at least, so that most of the common words need no count over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in common.slices(batches):
            found = _found(data, offsets, pairs)
            if not found:
                continue
            words = Words(data, offsets, FOLDED, lower=True)
            hashes, long = words.hashes(), words.ends - words.starts >= TERM_BYTES
            seen: dict[tuple[int, int, int], list] = {}
            for i, spans in found.items():
                raw = data[offsets[i] : offsets[i + 1]]
                for (s, kind, e), near in _near(words, i, offsets[i], spans):
                    terms = np.unique(hashes[near[long[near]]].view(np.int64))
                    if len(terms):
                        window = hashes[near]
                        context = int(mix(np.add.reduce(mix(window) * np.arange(1, len(window) + 1, dtype=np.uint64), keepdims=True)).view(np.int64)[0])
                        seen.setdefault((_entity(raw[s:e].tobytes(), kind), kind, context), [terms.tolist(), 0])[1] += 1
            if seen:
                terms, n = zip(*seen.values(), strict=True)
                entity, kind, context = zip(*seen, strict=True)
                close = np.unique(np.concatenate([np.array(t, np.int64) for t in terms]).view(np.uint64))
                at = np.searchsorted(close, hashes[_among(hashes, close)])
                rows = [*zip(entity, kind, context, terms, n, [None] * len(n), strict=True), (None, None, None, close.view(np.int64).tolist(), None, np.bincount(at, minlength=len(close)).tolist())]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["entity", "kind", "context", "terms", "n", "counts"])

    return run


def _differ(kept: list[set], terms: set) -> bool:
    """Is terms no copy of any of kept."""
    return all(max(len(terms), len(k)) - len(terms & k) >= MIN_DIVERSITY * max(len(terms), len(k)) for k in kept)


def _different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ordered by subject and term: for each pair up to MIN_CONTEXTS contexts that differ from each other."""
    pair, kept = None, []
    for batch in batches:
        out = []
        for subject, term, terms in zip(*(batch.column(c).to_pylist() for c in ("subject", "term", "terms")), strict=True):
            if pair != (subject, term):
                pair, kept = (subject, term), []
            if len(kept) < MIN_CONTEXTS and _differ(kept, set(terms)):
                kept.append(set(terms))
                out.append((subject, term, terms))
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.list_(pa.int64())], strict=True)], ["subject", "term", "terms"])


def _occurrences(asked: np.ndarray | None):
    """term, word, n: how often the words of the asked terms (ascending; None: all words) occur."""

    def out(seen):
        term, word = zip(*seen, strict=True)
        return pa.record_batch([pa.array(term, pa.int64()), pa.array(word, pa.binary()), pa.array(list(seen.values()), pa.int64())], ["term", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, bytes], int] = {}
        for _, data, offsets in common.slices(batches):
            words = Words(data, offsets, FOLDED, lower=True)
            hashes = words.hashes()
            which = np.arange(len(words)) if asked is None else np.flatnonzero(_among(hashes, asked))
            for k, term in zip(which.tolist(), hashes[which].view(np.int64).tolist(), strict=True):
                key = term, words.word(k)
                seen[key] = seen.get(key, 0) + 1
            if len(seen) > 200_000:
                yield out(seen)
                seen = {}
        if seen:
            yield out(seen)

    return run


def _among(hashes: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(asked):
        return np.zeros(len(hashes), bool)
    return asked[np.minimum(np.searchsorted(asked, hashes), len(asked) - 1)] == hashes


#: What a mention is evidence for: its entity, and its kind (as 0 to 4).
SUBJECTS = "explode(array(entity, cast(kind as long))) as subject"


def disclosing_terms(docs: DataFrame, pairs: np.ndarray, total: int) -> DataFrame:
    """term (hash), word (UTF-8, lower case), subject (an entity, or a kind as 0 to 4), contexts, posterior, bits. pairs
    and total are those of byte_pairs()."""
    docs = docs.select(common.text_or_empty())
    found = common.table(docs.mapInArrow(_contexts(pairs), CONTEXTS), "found")
    contexts = common.table(found.filter("entity is not null").groupBy("entity", "kind", "context", "terms").agg(F.sum("n").alias("n")), "contexts")
    least = found.filter("entity is null").select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("n")))).toDF("term", "n").groupBy("term").agg(F.sum("n").alias("least"))
    seen = contexts.selectExpr(SUBJECTS, "terms", "n").select("subject", F.explode("terms").alias("term"), "n")
    seen = seen.groupBy("subject", "term").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("n")).filter(F.col("contexts") >= MIN_CONTEXTS)
    mentions = contexts.selectExpr(SUBJECTS, "n").groupBy("subject").agg(F.sum("n").alias("mentions"))
    likely = seen.join(least, "term").filter(F.col("n") >= MIN_POSTERIOR * F.col("least")).drop("least")
    likely = common.table(likely.join(mentions, "subject"), "likely")
    terms, n = common.table_n(likely.select("term").distinct(), "terms")
    if n <= common.BROADCAST_IDS:
        asked = np.sort(terms.toArrow().column("term").to_numpy().astype(np.int64).view(np.uint64))
        counted = docs.mapInArrow(_occurrences(asked), "term long, word binary, n long")
    else:
        counted = docs.mapInArrow(_occurrences(None), "term long, word binary, n long").join(terms, "term", "left_semi")
    counted = counted.groupBy("term", "word").agg(F.sum("n").alias("all"))
    rated = likely.join(counted, "term").withColumn("posterior", F.col("n") / F.greatest("all", "n"))
    prior = F.least(F.lit(1.0), F.col("mentions") * (2 * SPAN + 1) / F.lit(float(max(total, 1))))
    rated = rated.withColumn("bits", F.log2(F.col("posterior") / prior))
    rated = rated.filter((F.col("posterior") >= MIN_POSTERIOR) & (F.col("bits") >= MIN_BITS)).select("term", "word", "subject", "contexts", "posterior", "bits")
    rated, n = common.table_n(rated, "rated")
    return rated.join(_evident(contexts, rated.select("subject", "term").distinct(), n), ["subject", "term"], "left_semi").select(rated.columns)


def _evident(contexts: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """subject, term: those of the n pairs with MIN_CONTEXTS contexts that differ from each other. Each task thins out
    its contexts of a pair before they meet."""
    held = contexts.selectExpr(SUBJECTS, "context", "terms").select("subject", "context", "terms", F.explode("terms").alias("term"))
    held = held.join(F.broadcast(pairs) if n <= common.BROADCAST_IDS else pairs, ["subject", "term"], "left_semi")
    some = held.repartition("context").sortWithinPartitions("subject", "term", "context").select("subject", "term", "terms")
    few = some.mapInArrow(_different, "subject long, term long, terms array<long>").repartition("subject", "term").sortWithinPartitions("subject", "term", "terms")
    few = few.mapInArrow(_different, "subject long, term long, terms array<long>")
    return few.groupBy("subject", "term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_CONTEXTS).select("subject", "term")


#: What a term discloses: bit k for kind k, this bit for an entity.
ENTITY = 1 << len(KINDS)


def _mark(terms: dict[bytes, int], pairs: np.ndarray):
    """Adds to x_marks (start, what it discloses, end; in bytes) the terms of each text that are spans."""
    asked = np.zeros(0, np.uint64)
    if terms:
        raw = np.frombuffer(b" ".join(terms), np.uint8)
        asked = np.unique(Words(raw, np.array([0, len(raw)]), FOLDED).hashes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.slices(batches):
            words = Words(data, offsets, FOLDED, lower=True)
            which = np.flatnonzero(_among(words.hashes(), asked))
            text = np.searchsorted(words.bounds, which, "right") - 1
            marks = [x or [] for x in rows.column("x_marks").to_pylist()]
            found = _found(data, offsets, pairs) if len(which) else {}
            for i in np.unique(text).tolist():
                mine = which[text == i]
                tells = np.array([terms.get(words.word(k), 0) for k in mine.tolist()])
                spans, near = found.get(i, []), dict.fromkeys(mine.tolist(), ENTITY)
                for (_, kind, _), close in _near(words, i, offsets[i], spans):
                    for k in close[_among(close, mine)].tolist():
                        near[k] |= 1 << kind
                tells &= np.array([near[k] for k in mine.tolist()])
                s, e = words.starts[mine] - offsets[i], words.ends[mine] - offsets[i]
                good = (tells > 0) & ~_covered(spans, s, e)
                marks[i] = marks[i] + [[int(a), int(t), int(b)] for a, t, b in zip(s[good], tells[good], e[good], strict=True)]
            yield pa.record_batch([rows.column("doc_id"), rows.column("text"), pa.array(marks, pa.list_(pa.list_(pa.int64())))], ["doc_id", "text", "x_marks"])

    return run


def _covered(spans: list[tuple[int, int, int]], s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Which of the ranges from s to e overlap a span."""
    if not spans:
        return np.zeros(len(s), bool)
    starts = np.array([a for a, _, _ in spans])
    ends = np.maximum.accumulate(np.array([b for _, _, b in spans]))
    before = np.searchsorted(starts, e) - 1  # the last span that begins before the range ends
    return (before >= 0) & (ends[np.maximum(before, 0)] > s)


def _spans(pairs: np.ndarray, with_text: bool):
    """All spans of each text and its sanitised form, from its entities and x_marks."""
    names = (*KINDS, "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.slices(batches):
            found = _found(data, offsets, pairs)
            marked = rows.column("x_marks").to_pylist()
            n = rows.num_rows
            counts = np.zeros((len(names), n), np.int64)
            base, both, clean, spans = [""] * n, [""] * n, [], []
            for i in range(n):
                raw = data[offsets[i] : offsets[i + 1]]
                mine = [(s, k, e, f"[{KINDS[k]}]") for s, k, e in found.get(i, ())]
                mine += [(s, len(KINDS), e, _general(tells)) for s, tells, e in marked[i] or ()]
                mine.sort()
                spans.append([])
                if mine:
                    points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
                    said = [f"{names[k]}:{points[s]}:{points[e]}" for s, k, e, _ in mine]
                    base[i] = ",".join(x for x, (_, k, _, _) in zip(said, mine, strict=True) if k < len(BASE))
                    both[i] = ",".join(said)
                    spans[i] = [{"kind": names[k], "start": int(points[s]), "end": int(points[e])} for s, k, e, _ in mine]
                    for _, k, _, _ in mine:
                        counts[k, i] += 1
                out = _replaced(raw.tobytes(), mine)
                clean.append(out.decode() if with_text else hashlib.sha256(out).hexdigest())
            struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            columns = [rows.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(both, pa.string()), pa.array(spans, struct), pa.array(clean, pa.string())]
            yield pa.record_batch(columns, [x.split()[0] for x in _FOUND])

    return run


def _general(tells: int) -> str:
    """What replaces a term: nothing where it discloses an entity, else the kind that it discloses."""
    return "" if tells & ENTITY else f"[{KINDS[(tells & -tells).bit_length() - 1]}]"


def _replaced(raw: bytes, spans: list[tuple[int, int, int, str]]) -> bytes:
    """raw with each span replaced; of overlapping ones the first, up to the end of the last."""
    parts, done = [], 0
    for s, _, e, put in spans:
        if s >= done:
            parts += [raw[done:s], put.encode()]
        done = max(done, e)
    return b"".join(parts) + raw[done:]


_FOUND = ("doc_id long", *(f"n_{k} long" for k in KINDS), "n_term long", "base string", "spans string", "listed array<struct<kind: string, start: long, end: long>>", "sanitised string")
FOUND = ", ".join(_FOUND)


def _blocks(terms: DataFrame) -> Iterator[dict[bytes, int]]:
    """Words and what they disclose, BROADCAST_IDS at a time."""
    block: dict[bytes, int] = {}
    for r in terms.toLocalIterator():
        block[bytes(r.word)] = r.tells
        if len(block) >= common.BROADCAST_IDS:
            yield block
            block = {}
    if block:
        yield block


def find(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """FOUND for every document (doc_id, text): counts of spans by kind, base and all spans as text, all spans, and the
    sanitised text (its SHA-256 unless with_text). Documents are read once more for each BROADCAST_IDS disclosing
    words."""
    common.session_paths(docs.sparkSession)
    docs = docs.select("doc_id", common.text_or_empty())
    pairs, total = byte_pairs(docs)
    tells = F.when(F.col("subject").between(0, len(KINDS) - 1), F.expr("shiftleft(1, cast(subject as int))")).otherwise(ENTITY)
    terms = disclosing_terms(docs, pairs, total).withColumn("tells", tells).groupBy("word").agg(F.bit_or("tells").alias("tells"))
    terms = common.table(terms, "disclosing")
    out = docs.withColumn("x_marks", F.expr("cast(array() as array<array<long>>)"))
    last = None
    for block in _blocks(terms):
        if last is not None:
            out = common.table(out.mapInArrow(_mark(last, pairs), out.schema), "marked")
        last = block
    out = out if last is None else out.mapInArrow(_mark(last, pairs), out.schema)
    return out.mapInArrow(_spans(pairs, with_text), FOUND)


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and text with each entity generalised to its kind, as in [email], terms that disclose a kind generalised
    to it, and terms that disclose an entity removed."""
    return find(docs, with_text=True).select("doc_id", F.col("sanitised").alias("text"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n_spans = F.size("listed").cast("long").alias("n_spans")
    return found.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2("base", 256).alias("base_sha256"), "spans", n_spans, "n_secret", "n_term", F.col("sanitised").alias("sanitised_sha256"))
