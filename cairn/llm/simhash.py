"""Near-duplicate detection: SimHash fingerprints joined by Golay-code keys.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. The perfect
(23,12,7) Golay code decodes each word of a segment (padded by zeros) to the
one codeword within 3 bits. Decoding a segment and its one-bit neighbours gives
a handful of codeword indices, and two segments that differ in 2 bits or fewer
share one: that of the word halfway.

Pigeonhole over 6 differing bits: either two segments differ in 2 bits or fewer
each (pairs (a, b) of indices are the keys, 24 bits wide), or the bits fall 0, 3
and 3, and one segment is equal (its bits are the key). So all links at 6 bits
or fewer share a key; the join on keys verifies the distance.

All of this runs over distinct fingerprints with their counts, so copies are
never expanded. Keys meet by one shuffle and a sort; fingerprints of a key are
compared in numpy. A key with more than GROUP of them is only cut in blocks
there, and each pair of blocks is compared in a group of its own. Components
grow by alternating large-star and small-star steps, each written to the shared
folder; a hub's edges meet its least neighbour by a broadcast.

Defined cases: a null or blank text has fingerprint zero and links like any
other. Rows repeat as documents of their own. A component's id is the smallest
non-null doc_id in it, null if there is none. A bit set in exactly half of the
shingles is 0. Texts of any length count whole; those of one word have one
shingle. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Neutral, join_by_key, numbered, sized, stored, table, text_bytes

MAX_BITS = 6
SEED = 42
#: Seeds of the fingerprints by which documents are dropped.
SEEDS = (42, 43, 44)
#: Fingerprints of a key that one task compares with each other.
GROUP = 4096
#: (first bit, width) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def _remainder(v: int) -> int:
    for i in range(22, 10, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - 11)
    return v


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    high = np.array([_remainder(i << 12) for i in range(2048)], np.uint32)
    low = np.array([_remainder(i) for i in range(4096)], np.uint32)
    errors = np.zeros(2048, np.uint32)
    one = [1 << i for i in range(23)]
    for i in range(23):
        for j in range(i, 23):
            for k in range(j, 23):
                e = one[i] | one[j] | one[k]
                errors[high[e >> 12] ^ low[e & 4095]] = e
    return high, low, errors


_HIGH, _LOW, _ERRORS = _tables()


def decode(v: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within 3 bits of each 23-bit word."""
    v = v.astype(np.uint32)
    return (v ^ _ERRORS[_HIGH[v >> 12] ^ _LOW[v & 4095]]) >> 11


def indices(segment: np.ndarray, width: int) -> np.ndarray:
    """Codeword indices of each segment value and its one-bit neighbours,
    sorted, each once; the rest of a row is -1."""
    flips = np.array([0, *(1 << i for i in range(width))], np.uint32)
    found = np.sort(decode(segment.astype(np.uint32)[:, None] ^ flips).astype(np.int32), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = 1 << 20
    found.sort(axis=1)
    most = int((found < 1 << 20).sum(axis=1).max(initial=0))
    found = found[:, :most]
    found[found == 1 << 20] = -1
    return found


def link_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of unsigned 64-bit fingerprints."""
    rows, keys = [], []
    parts = [(fp >> np.uint64(at)) & np.uint64((1 << w) - 1) for at, w in SEGMENTS]
    idx = [indices(p, w) for p, (_, w) in zip(parts, SEGMENTS)]
    for f, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        a, b = idx[i][:, :, None], idx[j][:, None, :]
        both = ((a >= 0) & (b >= 0)).reshape(len(fp), -1)
        key = ((a.astype(np.int64) << 12) | b | (f << 32)).reshape(len(fp), -1)
        rows.append(np.nonzero(both)[0])
        keys.append(key[both])
    for f, p in enumerate(parts, 3):
        rows.append(np.arange(len(fp)))
        keys.append(p.astype(np.int64) | (f << 32))
    return np.concatenate(rows), np.concatenate(keys)


_SPREAD = np.array([sum((b >> j & 1) << (8 * j) for j in range(8)) for b in range(256)], np.uint64)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set; byte counters hold 255 rows a step."""
    total = np.zeros(64, np.int64)
    lanes = _SPREAD[h.view(np.uint8).reshape(-1, 8)]
    for i in range(0, len(lanes), 255):
        total += lanes[i : i + 255].sum(axis=0).view(np.uint8)
    return total


def fingerprints(text: bytes, width: int = 2, seeds: tuple[int, ...] = (SEED,)) -> list[int]:
    """SimHash of the lower-cased text's ``width``-word shingles, for each seed."""
    words = text.lower().split()
    if not words:
        return [0] * len(seeds)
    n = max(1, len(words) - width + 1)
    if width == 2 and n > 1:
        shingles = list(map(b" ".join, zip(words, words[1:])))
    else:
        shingles = [b" ".join(words[i : i + width]) for i in range(n)]
    digest, out = xxhash.xxh64_intdigest, []
    for seed in seeds:
        bits = _bit_counts(np.fromiter([digest(s, seed) for s in shingles], "<u8", n)) * 2 > n
        out.append(int(np.packbits(bits, bitorder="little").view("<u8")[0]))
    return out


def fingerprint(text: bytes, width: int = 2) -> int:
    return fingerprints(text, width)[0]


def _fingerprints(width: int, seeds: tuple[int, ...]):
    names = ["fp", *[f"fp{i}" for i in range(1, len(seeds))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprints(t, width, seeds) for t in batch.column(3).to_pylist()], np.uint64).reshape(-1, len(seeds))
            yield pa.record_batch([*batch.columns[:3], *[pa.array(np.ascontiguousarray(fp[:, i]).view(np.int64)) for i in range(len(seeds))]], ["doc", "row", "th", *names])

    return run


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, row_col: str | None = None, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """doc, row (``row_col``, or null), th (64-bit hash of the text) and fp (the
    fingerprint's bits); fp1, fp2, ... for more seeds."""
    text = text_bytes(text_col)
    row = F.col(row_col) if row_col else F.lit(None).cast("long")
    schema = "doc long, row long, th long, fp long" + "".join(f", fp{i} long" for i in range(1, len(seeds)))
    return docs.select(F.col(id_col).cast("long").alias("doc"), row.alias("row"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(_fingerprints(width, seeds), schema)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sized(batches, 0, 1 << 17):
        fp = batch.column(0).to_numpy()
        rows, keys = link_keys(fp.view(np.uint64))
        for i in range(0, len(rows), 100_000):
            yield pa.record_batch([pa.array(keys[i : i + 100_000]), pa.array(fp[rows[i : i + 100_000]])], ["key", "fp"])


def _near(key: np.ndarray, fp: np.ndarray, max_bits: int) -> np.ndarray:
    """Pairs (a, b) of close fingerprints with equal keys; both columns are
    sorted by key, then fingerprint."""
    out, d = [], 1
    i = np.flatnonzero(key[1:] == key[:-1])
    while len(i):
        hit = i[np.bitwise_count((fp[i] ^ fp[i + d]).view(np.uint64)) <= max_bits]
        out.append(np.stack([fp[hit], fp[hit + d]], axis=1))
        d += 1
        i = i[i + d < len(key)]
        i = i[key[i] == key[i + d]]
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def _compare(max_bits: int, group: int):
    """Of rows (key, fp), sorted: pairs (a, b) of keys that a task compares, and
    of longer ones the fingerprints (key, block, a)."""

    def pairs(found: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(found), pa.int64())
        return pa.record_batch([none, none, pa.array(found[:, 0]), pa.array(found[:, 1])], ["key", "block", "a", "b"])

    def blocks(key: int, fp: np.ndarray, before: int) -> pa.RecordBatch:
        at = (before + np.arange(len(fp))) // group
        return pa.record_batch([pa.array(np.full(len(fp), key)), pa.array(at), pa.array(fp), pa.nulls(len(fp), pa.int64())], ["key", "block", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        long, sent = None, 0  # a key that goes in blocks, and what went
        for batch in sized(batches, 0, 1 << 19):
            key, fp = np.append(key, batch.column(0).to_numpy()), np.append(fp, batch.column(1).to_numpy())
            if long is not None:
                n = int(np.searchsorted(key, long, side="right"))
                yield blocks(long, fp[:n], sent)
                sent += n
                key, fp = key[n:], fp[n:]
                if not len(key):
                    continue
                long = None
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(starts, len(key)))
            for s, n in zip(starts[sizes > group].tolist(), sizes[sizes > group].tolist()):
                yield blocks(int(key[s]), fp[s : s + n], 0)
                if s + n == len(key):
                    long, sent = int(key[s]), n
            short = np.repeat(sizes <= group, sizes)
            end = len(key) if long is not None else int(starts[-1])  # the last key may go on
            short[end:] = False
            yield pairs(_near(key[short], fp[short], max_bits))
            key, fp = key[end:], fp[end:]
        if len(key):
            yield pairs(_near(key, fp, max_bits))

    return run


def _cross(max_bits: int, group: int):
    """Of rows (key, lo, hi, block, fp), sorted: close pairs between the blocks
    ``lo`` and ``hi`` of a key."""

    def compare(rows: list[np.ndarray]) -> np.ndarray:
        lo, hi, block, fp = (np.concatenate(x) for x in zip(*rows))
        a, b = fp[block == lo], fp[block == hi]
        out = []
        for i in range(0, len(a), 512):
            x, y = np.nonzero(np.bitwise_count((a[i : i + 512, None] ^ b[None, :]).view(np.uint64)) <= max_bits)
            out.append(np.stack([a[x + i], b[y]], axis=1))
        both = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        both = both[both[:, 0] != both[:, 1]]
        return np.stack([both.min(axis=1), both.max(axis=1)], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out():
            found = np.unique(compare(held), axis=0)
            return pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            new = np.append(True, (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) if batch.num_rows else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            for s, e in zip(starts.tolist(), np.append(starts[1:], batch.num_rows).tolist()):
                mark = tuple(int(c[s]) for c in cols[:3])
                if mark != now and held:
                    yield out()
                    held.clear()
                now = mark
                held.append([c[s:e] for c in cols[1:]])
        if held:
            yield out()

    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column ``fp``) that differ in
    ``max_bits`` (6 at most) bits or fewer, each once."""
    if max_bits > MAX_BITS:
        raise ValueError(f"max_bits is {MAX_BITS} at most")
    keyed = fps.select("fp").mapInArrow(_keys, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = stored(keyed.mapInArrow(_compare(max_bits, group), "key long, block long, a long, b long"), "near")
    pairs = found.where("key IS NULL").select("a", "b")
    long = found.where("key IS NOT NULL").select("key", "block", F.col("a").alias("fp"))
    if not long.isEmpty():
        sizes = long.groupBy("key").agg(F.max("block").alias("last"))
        each = long.join(sizes, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
        each = each.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "fp")
        each = each.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
        pairs = pairs.unionByName(each.mapInArrow(_cross(max_bits, group), "a long, b long"))
    return pairs.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b); a root is its component's
    smallest node."""
    def sign(e: DataFrame):
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return (r[0], r[1])

    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    was = None
    while (state := sign(now)) != was and state[0]:
        was = state
        # large star: each neighbour above a node goes to the least around it
        up = now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = now.unionByName(up).groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).where("n > 0")
        least = least.select("u", F.least("m", "u").alias("m"), "n")
        large = stored(join_by_key(up, least, "u", "n", state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        # small star: each node and those below it go to the least of them
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        low = join_by_key(large, least, "u", "n", state[0])
        small = least.select("u", F.col("m").alias("v")).unionByName(low.where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = stored(small.distinct(), "edges")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, width: int = 2, max_bits: int = MAX_BITS) -> DataFrame:
    """A row for each document: id, row (``row_col``, or null), fp, n_near
    (others linked directly), component_id (smallest id reachable) and keep (one
    row of each component, the smallest by id, text hash and row, ids before null)."""
    sig = stored(signatures(docs, id_col, text_col, width, row_col), "signatures")
    total = sig.count()
    first = F.min(F.struct(F.col("doc").isNull(), F.col("doc"), F.col("th"), F.col("row")))
    fps = stored(sig.groupBy("fp").agg(F.count("*").alias("n"), first.alias("first")), "fingerprints")
    pairs = stored(links(fps, max_bits), "links")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(fps.select(F.col("fp").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("linked"))
    comp = components(pairs)
    owner = comp.join(fps, comp.node == fps.fp).groupBy("root").agg(F.min("first").alias("winner"), F.count("*").alias("__m"))
    place = join_by_key(comp, stored(owner, "owners"), "root", "__m", total).select("node", "winner")
    facts = (
        fps.join(near.withColumnRenamed("a", "fp"), "fp", "left")
        .join(place.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "n", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_near"), F.coalesce("winner", "first").alias("winner"))
    )
    out = join_by_key(sig, stored(facts, "facts"), "fp", "n", total)
    keep = F.col("doc").eqNullSafe(F.col("winner.doc")) & (F.col("th") == F.col("winner.th")) & F.col("row").eqNullSafe(F.col("winner.row"))
    return out.select(F.col("doc").alias(id_col), "row", "fp", "n_near", F.col("winner.doc").alias("component_id"), keep.alias("keep"))


def text_components(sig: DataFrame, fps: list[str]) -> DataFrame:
    """Of signatures (th, a column for each of ``fps``): th and root, for the
    texts that are linked to any other by one of their fingerprints."""
    edges = None
    for fp in fps:
        # texts of one fingerprint hang on the least of them, which its links join
        texts = sig.groupBy(F.col(fp).alias("fp"), "th").agg(F.count("*").alias("rows"))
        own = stored(texts.groupBy("fp").agg(F.min("th").alias("first"), F.count("*").alias("n")), "fingerprints")
        total = own.agg(F.sum("n")).first()[0] or 0
        same = join_by_key(texts.select("fp", "th"), own, "fp", "n", total).where("th <> first").select(F.col("first").alias("a"), F.col("th").alias("b"))
        pairs = stored(links(own), "links")
        name = lambda c: own.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}"))
        near = pairs.join(name("a"), "a").join(name("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
        found = same.unionByName(near.where("a <> b"))
        edges = found if edges is None else edges.unionByName(found)
    return components(stored(edges.distinct(), "edges")).withColumnRenamed("node", "th")


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """The documents without near-duplicates: one row of each component, with
    all columns: the smallest by id (null last), text hash and row. Documents
    are linked if their fingerprints of any seed are; each seed is another try
    for copies whose difference happens to flip a bit too many. Rows are
    numbered and written first, so that of equal rows one is named, and no join
    key is hot."""
    n = Neutral(docs)
    rows = stored(numbered(n.df), "rows")
    fps = ["fp", *[f"fp{i}" for i in range(1, len(seeds))]]
    sig = stored(signatures(rows, n[id_col], n[text_col], row_col="row", seeds=seeds), "signatures")
    first = F.min(F.struct(F.col("doc").isNull(), F.col("doc"), F.col("th"), F.col("row"))).alias("first")
    texts = stored(sig.groupBy("th").agg(first), "texts")
    comp = text_components(sig, fps)
    best = texts.join(comp, "th", "left").groupBy(F.coalesce("root", "th").alias("root")).agg(F.min("first").alias("first"))
    return n.restore(rows.join(best.select("first.row"), "row", "left_semi"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("n_near").cast("long").alias("n_near"), "component_id")
