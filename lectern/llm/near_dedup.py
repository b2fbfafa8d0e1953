"""MinHash near-dedup with b-bit signatures.

A document's set holds its distinct shingles of a few words, each as 64 bits made of the BLAKE2b of its words, so that
no two shingles can be made to clash by their bytes. Documents with equal sets are one vertex.
Of each set come 160 minima: bands of a few whole minima make the buckets, and the low 2 bits of each minimum, packed
into five 64-bit words, make the signature. A pair from a bucket is first judged by its signatures (equal lanes by bit
count, corrected for chance collisions); pairs that may reach the threshold are confirmed on their full sets.

A bucket never emits all of its pairs. Its centre, the document that meets the most others, is paired with the rest,
and what is linked with it is done. Each document is first tried with the one of its buckets' centres that meets the most;
a bucket then takes the best centre that one of its documents is linked with, so that the many buckets of a large
group share a centre. Let A be a document around a centre C that is not linked with it, and B another
one. If A and B reach the threshold t, then either
(1) they share a shingle that C lacks, and one among the first |A| - ceil(t |A|) + 1 of those of each, in one order; or
(2) all that they share is in C, so |A & C| >= t / (1 + t) (|A| + |B|), which bounds the size of B.
Both hold for any set C; here it is the centre's with the shingles that a quarter of its documents have and it lacks.
So where a centre's documents still span components they are grouped by (1) those shingles and (2) sizes. An edited
copy that fails its centre has its own words there, so the groups are small; in each, documents outside its main
component are centres in turn, against other components only, until every cross-component pair that may be a link has
had a centre in it. No link between documents that share a bucket is lost, n similar documents cost about n pairs,
and nothing is capped. A pair at the threshold shares no bucket at all with a probability under 1e-8: there are 32
bands of five minima from 0.85 on, 40 bands of four below.

Cases: null, empty and blank texts have the empty set, size 0, and are their own component; fewer words than a
shingle's make one shingle; rows without a doc_id have a null component_id and are kept; repeated rows share their component;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common
from lectern.llm.words import PLAIN, Digests, Words, mix, positions, window_hashes

SHINGLE = 5
LANES = 160
#: Edges that one task may sort.
FEW = 50_000
#: Similarity in hundredths that a link needs.
THRESHOLD = 80
#: The signatures' estimate is off by 0.033 (one standard deviation) at 0.85; pairs six of them below are dropped.
SLACK = 0.2
_ODD = int.from_bytes(bytes([0x55] * 8), "big")
SIGNATURE = [f"s{i}" for i in range(LANES // 32)]
SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, " + ", ".join(f"{s} long" for s in SIGNATURE)


_digests = [Digests()]


def _forget() -> None:
    _digests[0] = Digests()


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): text i's set is hashes[bounds[i]:bounds[i + 1]], ascending and distinct."""
    words = Words(data, offsets, PLAIN, lower=True)
    common.hold("digests", _forget)
    hashes, counts = _digests[0].of(words), words.counts
    at, text = positions(words.bounds, n)
    parts, owners = [window_hashes(hashes, n, at)], [text]
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        parts.append(window_hashes(hashes, k, words.bounds[short]))
        owners.append(short)
    if any(len(x) for x in parts[1:]):
        value, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    else:
        value, owner = parts[0], owners[0]
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        value[lo:hi].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(offsets)))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(8))
    return rng.integers(0, 2**31, LANES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, LANES, dtype=np.uint32)


def _sign(shingle: int, threshold: int):
    per_band = 5 if threshold >= 85 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.slices(batches):
            yield _signed(rows, *shingle_sets(data, offsets, shingle), per_band)

    return run


def _signed(rows: pa.RecordBatch, value: np.ndarray, bounds: np.ndarray, per_band: int) -> pa.RecordBatch:
    odd, plus = _multipliers()
    count = LANES // per_band
    n = np.diff(bounds)
    some = np.flatnonzero(n)
    lanes = np.zeros((LANES, len(n)), np.uint32)
    set_a, set_b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(some):
        starts = bounds[:-1][some]
        half = (value >> np.uint64(32)).astype(np.uint32)
        for k in range(LANES):
            lanes[k, some] = np.minimum.reduceat(half * odd[k] + plus[k], starts)
        set_a[some] = np.add.reduceat(mix(value), starts)
        set_b[some] = np.add.reduceat(mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
    bands = np.zeros((len(n), count), np.uint64)
    for band in range(count):
        key = np.full(len(n), band + 1, np.uint64)
        for row in range(per_band):
            key = mix(key ^ lanes[band * per_band + row].astype(np.uint64)) + np.uint64(band)
        bands[:, band] = key
    low = (lanes & np.uint32(3)).astype(np.uint64)
    signature = []
    for w in range(LANES // 32):
        word = np.zeros(len(n), np.uint64)
        for k in range(32):
            word |= low[w * 32 + k] << np.uint64(2 * k)
        signature.append(word)
    long = lambda x: pa.array(x.view(np.int64), pa.int64())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * count, pa.int32()), long(bands.reshape(-1)))
    return pa.record_batch([rows.column("doc_id"), pa.array(n, pa.int64()), long(set_a), long(set_b), lists, *map(long, signature)], ["doc_id", "n_shingles", "set_a", "set_b", "bands", *SIGNATURE])


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.slices(batches):
            value, bounds = shingle_sets(data, offsets, shingle)
            yield pa.record_batch([rows.column("doc_id"), common.binary_array(value, 8 * bounds)], ["doc_id", "shingles"])

    return run


def _confirm(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("set_x"), batch.column("set_y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common_n = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common_n >= threshold * (len(both) - common_n))
            linked = pa.array(linked, pa.bool_())
            yield pa.record_batch([batch.column("a").filter(linked), batch.column("b").filter(linked)], ["a", "b"])

    return run


def components(edges: DataFrame, n: int) -> DataFrame:
    """(doc_id, label), a written table: the smallest vertex that each vertex of n edges (a, b) reaches. Labels sink along edges and are
    then replaced by their own labels, so a chain of n vertices takes about log(n) rounds; each round is written. Up
    to FEW edges one task does each round without a shuffle; beyond, Spark deals them out."""
    few = (lambda df: df.coalesce(1)) if n <= FEW else (lambda df: df)
    with common.passing() as keep_:
        edges = few(edges)
        both = few(common.table(few(edges.select("a", "b").union(edges.select("b", "a"))).distinct(), "edges"))
        labels = common.table(both.groupBy(F.col("a").alias("doc_id")).agg(F.least("doc_id", F.min("b")).alias("label")), "labels")
        while True:
            known = few(labels).select("doc_id", "label")
            sunk = both.join(known.withColumnRenamed("doc_id", "b"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("label").alias("near"))
            sunk = known.join(sunk, "doc_id").select("doc_id", F.col("label").alias("old"), F.least("label", "near").alias("via"))
            up = known.select(F.col("doc_id").alias("via"), F.col("label").alias("top"))
            now = sunk.join(up, "via", "left").select("doc_id", F.least("via", "top").alias("label"), "old")
            changed = Observation()
            labels = common.table(now.observe(changed, F.count_if(F.col("old") != F.col("label")).alias("n")), "labels")
            if not changed.get["n"]:
                keep_(labels)
                return labels


def _likely(pairs: DataFrame, signed: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose sizes and signatures allow the threshold."""
    columns = ["n_shingles", *SIGNATURE]
    x = signed.select(F.col("doc_id").alias("a"), *[F.col(c).alias(f"x_{c}") for c in columns])
    y = signed.select(F.col("doc_id").alias("b"), *[F.col(c).alias(f"y_{c}") for c in columns])
    sizes = f"100 * least(x_n_shingles, y_n_shingles) >= {threshold} * greatest(x_n_shingles, y_n_shingles)"
    return pairs.join(y, "b").join(x, "a").filter(sizes).filter(_alike("x_", "y_", threshold)).select("a", "b")


def _alike(x: str, y: str, threshold: int) -> str:
    """SQL: do the signatures in columns with these prefixes allow the threshold."""
    differ = " + ".join(f"bit_count((({x}{s} ^ {y}{s}) | shiftrightunsigned({x}{s} ^ {y}{s}, 1)) & {_ODD}L)" for s in SIGNATURE)
    return f"((1 - ({differ}) / {LANES}D) - 0.25D) / 0.75D >= {threshold / 100 - SLACK}"


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_y"))
    return pairs.join(y, "b").join(x, "a")


def _links(pairs: DataFrame, signed: DataFrame, sets: DataFrame, threshold: int) -> tuple[DataFrame, int]:
    """The pairs (a, b) that reach the threshold on their full sets, and their number."""
    with common.passing() as keep_:
        likely = common.table(_likely(pairs, signed, threshold), "likely")
        found, n = common.table_n(_with_sets(likely, sets).mapInArrow(common.released(_confirm(threshold)), "a long, b long"), "links")
        keep_(found)
    return found, n


REGROUPED = "key long, doc_id long, seeks boolean, offers boolean, low int, high int, size int, shared int"


def _own(threshold: int):
    """(a, shingle): the first shingles, as many as a prefix has, that a document has and its centre a lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, parts = batch.column("a").to_numpy(), []
            for x, y in zip(batch.column("set_x"), batch.column("set_y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                parts.append(y[x[np.minimum(np.searchsorted(x, y), len(x) - 1)] != y][: len(y) + (threshold * len(y) // -100) + 1])
            own = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.record_batch([pa.array(np.repeat(centres, [len(p) for p in parts])), pa.array(own.view(np.int64), pa.int64())], ["a", "shingle"])

    return run


def _regroup(threshold: int):
    """Keys under which a document b meets those around its centre a that it may still be linked with (see the module's
    text): for (1) its own shingles, where it seeks and offers; for (2) sizes, offering its own and, where it isn't
    linked with the centre, seeking those between low and high."""
    step = np.log(1.05)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, seeks, offers, lows, highs, sizes, commons = [], [], [], [], [], [], [], []
            salts = mix(batch.column("a").to_numpy().view(np.uint64))
            for salt, b, x, y, common_own in zip(salts, batch.column("b").to_pylist(), batch.column("set_x"), batch.column("set_y"), batch.column("common").to_pylist(), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
                n, linked = len(y), int(shared.sum())
                linked = 100 * linked >= threshold * (len(x) + n - linked)
                if common_own:
                    shared |= np.isin(y, np.array(common_own, np.int64).view(np.uint64))
                both = int(shared.sum())
                own = y[~shared][: n + (threshold * n // -100) + 1]
                classes = [int(np.log(n) / step)]
                low, high = max(-(threshold * n // -100), 1), both * (100 + threshold) // threshold - n
                if not linked and high >= low:
                    classes += range(int(np.log(low) / step), int(np.log(high) / step) + 1)
                k, m = len(own), len(classes)
                keys.append(mix(np.concatenate([own, np.array(classes, np.uint64)]) ^ salt))
                ids += [b] * (k + m)
                seeks += [True] * k + [False] + [True] * (m - 1)
                offers += [True] * (k + 1) + [False] * (m - 1)
                lows += [0] * (k + 1) + [low] * (m - 1)
                highs += [2**31 - 1] * (k + 1) + [high] * (m - 1)
                sizes += [n] * (k + m)
                commons += [n] * k + [both] * m
            keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.record_batch([pa.array(keys.view(np.int64), pa.int64()), pa.array(ids, pa.int64()), pa.array(seeks, pa.bool_()), pa.array(offers, pa.bool_()), pa.array(lows, pa.int32()), pa.array(highs, pa.int32()), pa.array(sizes, pa.int32()), pa.array(commons, pa.int32())], [x.split()[0] for x in REGROUPED.split(", ")])

    return run


def _merged(labels: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """Labels after more links: components of the labels that the links tie, put through to the documents."""
    tie = lambda side: labels.select(F.col("doc_id").alias(side), F.col("label").alias(f"{side}_label"))
    raised = links.join(tie("a"), "a", "left").join(tie("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).filter("a <> b")
    with common.passing() as keep_:
        top = components(raised, n).select(F.col("doc_id").alias("label"), F.col("label").alias("new"))
        joined = labels.select("doc_id", "label").union(top.select("label", "label")).distinct()
        out = common.table(joined.join(top, "label", "left").select("doc_id", F.coalesce("new", "label").alias("label")), "labels")
        keep_(out)
    return out


def _labels(docs: DataFrame, signed: DataFrame, threshold: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(groups of equal sets with the document that stands for each, the label of each such document that is linked)."""
    docs = docs.filter("doc_id is not null")
    filled = signed.filter("n_shingles > 0 and doc_id is not null")
    groups = common.table(filled.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")), "groups")
    reps = filled.join(groups.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    members = reps.select(F.explode("bands").alias("key"), "doc_id")
    shared = common.table(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")  # read back, so that the join can split a hot bucket
    bucket = common.table(members.join(shared, "key"), "bucket")
    slim = signed.select("doc_id", "n_shingles", *SIGNATURE)
    degree, n = common.table_n(bucket.groupBy("doc_id").agg(F.sum("n").alias("degree")), "degree")
    sets = common.table(common.only_ids(docs, degree, n).mapInArrow(_sets(shingle), "doc_id long, shingles binary"), "sets")
    rows = bucket.select("key", "doc_id").join(degree, "doc_id")
    rows = common.table(rows, "rows")
    centres = common.table(rows.groupBy("key").agg(F.max(F.struct("degree", (-F.col("doc_id")).alias("neg"))).alias("c")), "first")
    met = rows.select("key", "doc_id").join(centres, "key").filter("doc_id <> -c.neg").groupBy(F.col("doc_id").alias("b")).agg(F.max("c").alias("c"))
    tried = common.table(met.select((-F.col("c.neg")).alias("a"), "b"), "tried")
    first, n = _links(tried, slim, sets, threshold)
    # Buckets with a document that is linked with the centre of a larger one take that centre: overlapping buckets share one.
    home = first.join(degree.withColumnRenamed("doc_id", "a"), "a").select(F.col("b").alias("doc_id"), F.struct("degree", (-F.col("a")).alias("neg")).alias("h"))
    better = rows.select("key", "doc_id").join(home, "doc_id").groupBy("key").agg(F.max("h").alias("h"))
    centres = centres.join(better, "key", "left").select("key", (-F.greatest("c", "h")["neg"]).alias("a"))
    pairs = common.table(rows.select("key", "doc_id").join(centres, "key").filter("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct(), "pairs")
    links, more = _links(pairs.join(tried, ["a", "b"], "left_anti"), slim, sets, threshold)
    links, n, pairs = links.union(first), n + more, common.table(pairs.union(tried).distinct(), "pairs")
    labels = components(links, n)
    around = pairs.join(labels.select(F.col("doc_id").alias("b"), "label"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    apart = around.groupBy("a").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("a")
    near = common.table(pairs.join(apart, "a", "left_semi"), "near")
    own = _with_sets(near, sets).mapInArrow(common.released(_own(threshold)), "a long, shingle long").groupBy("a", "shingle").count()
    own = own.join(near.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a").filter("count >= greatest(8, n / 4)")
    own = common.table(own.groupBy("a").agg(F.collect_list("shingle").alias("common")), "common")
    bucket, n = common.table_n(_with_sets(near.join(own, "a", "left"), sets).mapInArrow(common.released(_regroup(threshold)), REGROUPED).withColumn("used", F.lit(False)), "bucket")
    if n:
        bucket = common.table(bucket.join(slim.drop("n_shingles"), "doc_id"), "bucket")  # the join below looks at signatures, so that unlikely pairs are never rows
    tested, width = pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")), 64
    while n:
        placed = bucket.join(labels.select("doc_id", "label"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        spans = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.expr("min(if(offers, label, null))").alias("main"), F.expr("count_if(seeks and not used)").alias("open")).filter("lo < hi and open > 0 and main is not null")
        bucket = common.table(placed.join(spans.select("key", "main"), "key"), "bucket")
        # A document of the main component that both seeks and offers is met by those of the others.
        free = bucket.filter("seeks and not used and not (offers and label = main)").withColumn("part", F.expr(f"pmod(xxhash64(doc_id, {width}L), {width})"))
        chosen = free.groupBy("key", "part").agg(F.expr(f"min(struct(doc_id, label, low, high, size, shared, {', '.join(SIGNATURE)}))").alias("c"))
        centres, n = common.table_n(chosen.select("key", F.col("c.doc_id").alias("c"), F.col("c.label").alias("c_label"), *[F.col(f"c.{x}").alias(f"c_{x}") for x in ("low", "high", "size", "shared", *SIGNATURE)]), "centres")
        if not n:
            break
        met = bucket.filter("offers").join(centres, "key").filter(f"label <> c_label and size between c_low and c_high and {100 + threshold} * least(shared, c_shared) >= {threshold} * (size + c_size) and {_alike('', 'c_', threshold)}")
        met = met.select(F.least("doc_id", "c").alias("low"), F.greatest("doc_id", "c").alias("high")).distinct()
        pairs, n = common.table_n(met.join(tested, ["low", "high"], "left_anti"), "pairs")
        taken = centres.select("key", F.col("c").alias("doc_id"), F.lit(True).alias("now"))
        bucket = bucket.drop("label", "main").join(taken, ["key", "doc_id"], "left").withColumn("used", F.expr("used or coalesce(now and seeks, false)")).drop("now")
        if n:
            tested = tested.union(pairs)
            links, n = _links(pairs.select(F.col("low").alias("a"), F.col("high").alias("b")), slim, sets, threshold)
            labels = _merged(labels, links, n) if n else labels
        n, width = 1, width * 8
    return groups, labels


def near_components(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document (doc_id, text)."""
    common.session_paths(docs.sparkSession)
    docs = docs.select("doc_id", common.text_or_empty())
    with common.passing() as keep_:
        signed = common.table(docs.mapInArrow(_sign(shingle, threshold), SIGNED), "signed")
        groups, labels = _labels(docs, signed, threshold, shingle)
        keep_(signed, groups, labels)
    named = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(groups, ["set_a", "set_b", "n_shingles"], "left")
    named = named.join(labels.select(F.col("doc_id").alias("rep"), "label"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """The documents that are the smallest of their component, with their own columns. Those without words or without
    a doc_id stay, repeated rows stay or go together."""
    gone, n = common.table_n(near_components(docs, threshold, shingle).filter("not kept").select(F.col("doc_id").alias("x_id")).distinct(), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("x_row"))
    left = rows.join(F.broadcast(gone) if n <= common.BROADCAST_IDS else gone, F.col("x_row.doc_id") == F.col("x_id"), "left_anti")
    return left.select(*[F.col(f"x_row.`{c}`").alias(c) for c in docs.columns])


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), threshold=85, shingle=3)


OP8_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
  select doc_id, array_to_string(w[i:i + 2], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from words where len(w) > 0)
), sets as materialized (select distinct doc_id, s from shingles
), sizes as materialized (select doc_id, count(*) as n from sets group by doc_id
), common as (
  select x.doc_id as a, y.doc_id as b, count(*) as c from sets x join sets y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2
), links as materialized (
  select a, b from common join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * c >= 85 * (p.n + q.n - c)
), reach(doc_id, top) as (
  select doc_id, doc_id from documents union select l.b, r.top from reach r join links l on l.a = r.doc_id
), low as (select doc_id, min(top) as component_id from reach group by doc_id)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, l.component_id, d.doc_id = l.component_id as kept
from documents d left join sizes s on s.doc_id = d.doc_id left join low l on l.doc_id = d.doc_id
"""
