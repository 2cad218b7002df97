"""Line deduplication with a pair of Bloom filters.

One pass fills two filters: hashes seen in at least one document, and hashes
seen in at least two. Each task sends its filters as compressed segments, and
segments merge by ``twice = t1 | t2 | (o1 & o2)``. The second filter, of bounded
size, goes to all tasks: only lines that it knows can be repeats, so only they
are counted exactly (by their whole key) and, if asked, have their first
occurrence chosen. A filter too full to tell lines apart only makes more lines
be counted; results never depend on it. Its size follows from the bytes of the
input's files, without a pass over them.

The keys to drop are broadcast while they are few. If they aren't, the second
filter's suspects among the lines shuffle to them, hot keys by broadcast, and
the numbers of the lines that go are joined to their documents.

Defined cases: a null or empty text is one empty line. Each row is a document
of its own, also if rows repeat. A line's key is the line without white space
(U+0020, U+0009 to U+000D) at its ends and with A-Z in lower case. Texts and
lines of any length are taken whole; bytes that are no UTF-8 stay as they are.
Of first occurrences in rows of equal id and line number each one is kept. Other
columns are ignored or carried, so their names can't clash. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import input_bytes, join_by_key, stored, text_bytes

SEGMENT_BITS = 1 << 20
PROBES = 3
BYTES_A_BIT = 6
#: Map-side counts are sent on once they hold so many keys.
FLUSH_KEYS = 100_000


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    """Whether the key has ``min_chars`` code points at least."""
    if len(key) < min_chars:
        return False
    return min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars


def doc_keys(text: bytes, min_chars: int) -> set[bytes]:
    keys = {line.strip().lower() for line in text.split(b"\n")}
    keys.discard(b"")
    return keys if min_chars <= 1 else {k for k in keys if _long_enough(k, min_chars)}


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """Rows of PROBES bit positions for 64-bit hashes (double hashing)."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    i = np.arange(PROBES, dtype=np.uint64)
    return (h[:, None] + step[:, None] * i[None, :]) & np.uint64(bits - 1)


def _segments(h: np.ndarray, bits: int) -> dict[int, bytes]:
    """Filter segments that hold the hashes, compressed."""
    at = np.unique(_positions(h, bits).ravel())
    cut = (at // np.uint64(SEGMENT_BITS)).astype(np.int64)
    out = {}
    for s in np.unique(cut):
        own = (at[cut == s] % np.uint64(SEGMENT_BITS)).astype(np.int64)
        flags = np.zeros(min(SEGMENT_BITS, bits), np.uint8)
        flags[own] = 1
        out[int(s)] = zlib.compress(np.packbits(flags, bitorder="little").tobytes(), 1)
    return out


def _fill(bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []

        def flush():
            h, n = np.unique(np.array(held, np.uint64), return_counts=True)
            held.clear()
            once, twice = _segments(h, bits), _segments(h[n > 1], bits)
            ids = list(once)
            return pa.record_batch([pa.array(ids, pa.int32()), pa.array([once[s] for s in ids], pa.binary()), pa.array([twice.get(s) for s in ids], pa.binary())], ["seg", "once", "twice"])

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.extend(map(digest, doc_keys(text, min_chars)))
            if len(held) > 2_000_000:
                yield flush()
        if held:
            yield flush()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}
    for batch in batches:
        for seg, o, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
            a = np.frombuffer(zlib.decompress(o), np.uint8)
            b = np.frombuffer(zlib.decompress(t), np.uint8) if t else np.zeros_like(a)
            if seg in once:
                twice[seg] = twice[seg] | b | (once[seg] & a)
                once[seg] = once[seg] | a
            else:
                once[seg], twice[seg] = a, b
    for seg in once:
        yield pa.record_batch([pa.array([seg], pa.int32()), pa.array([zlib.compress(twice[seg].tobytes(), 1)], pa.binary())], ["seg", "twice"])


def repeat_filter(texts: DataFrame, min_chars: int, max_bits: int) -> np.ndarray:
    """The second filter (``max_bits / 8`` bytes at most), of a frame whose
    first column is ``text`` as bytes. It has a bit for each BYTES_A_BIT bytes
    of input, which is about 12 bits a line of common length."""
    size = input_bytes(texts)
    if size is None:  # not from files
        size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = 1 << 16
    while bits * BYTES_A_BIT < size and bits < max_bits:
        bits *= 2
    parts = texts.mapInArrow(_fill(bits, min_chars), "seg int, once binary, twice binary")
    rows = parts.repartition("seg").mapInArrow(_merge, "seg int, twice binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        piece = np.frombuffer(zlib.decompress(r.twice), np.uint8)
        start = r.seg * SEGMENT_BITS // 8
        out[start : start + len(piece)] = piece
    return out


def _suspects(keys: list[bytes], bloom: np.ndarray) -> list[bytes]:
    if not keys:
        return []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    at = _positions(h, len(bloom) * 8).astype(np.int64)
    hit = ((bloom[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
    return [keys[i] for i in np.flatnonzero(hit)]


def _count(shared, min_chars: int, first: bool):
    """Rows (key, n, first_id, first_line) of suspected repeats, summed in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, held = shared.value, {}

        def flush():
            keys = list(held)
            out = pa.record_batch([pa.array(keys, pa.binary()), pa.array([held[k][0] for k in keys], pa.int64()), pa.array([held[k][1] for k in keys], pa.int64()), pa.array([held[k][2] for k in keys], pa.int64())], ["key", "n", "first_id", "first_line"])
            held.clear()
            return out

        for batch in batches:
            ids = batch.column(1).to_pylist()
            keys = [doc_keys(t, min_chars) for t in batch.column(0).to_pylist()]
            maybe = set(_suspects(list(set().union(*keys)), bloom))
            for i, own in enumerate(keys):
                own &= maybe
                if not own:
                    continue
                at: dict[bytes, int] = {}
                if first:
                    for n, line in enumerate(batch.column(0)[i].as_py().split(b"\n")):
                        at.setdefault(line_key(line), n)
                for k in own:
                    here = (ids[i], at.get(k)) if first and ids[i] is not None else (None, None)
                    if (was := held.get(k)) is None:
                        held[k] = (1, *here)
                    else:
                        best = min((x for x in (was[1:], here) if x[0] is not None), default=(None, None))
                        held[k] = (was[0] + 1, *best)
            if len(held) > FLUSH_KEYS:
                yield flush()
        if held:
            yield flush()

    return run


def repeated_lines(texts: DataFrame, bloom, *, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Keys found in ``min_docs`` documents (text, id) or more: key (bytes), n,
    and the first occurrence by id and line (null unless ``keep_first``)."""
    counted = texts.mapInArrow(_count(bloom, min_chars, keep_first), "key binary, n long, first_id long, first_line long")
    first = F.min(F.when(F.col("first_id").isNotNull(), F.struct("first_id", "first_line")))
    return counted.groupBy("key").agg(F.sum("n").alias("n"), first.alias("f")).where(F.col("n") >= min_docs).select("key", "n", "f.first_id", "f.first_line")


def _emit(shared, min_chars: int):
    """Rows (key, id, h, line) of the lines that the filter knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, hs, ns = [], [], [], []
            docs = [[line_key(x) for x in t.split(b"\n")] for t in batch.column(0).to_pylist()]
            known = set(_suspects([k for k in set().union(*docs) if _long_enough(k, max(1, min_chars))], shared.value))
            for own, doc, h in zip(docs, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for n, k in enumerate(own):
                    if k in known:
                        keys.append(k)
                        ids.append(doc)
                        hs.append(h)
                        ns.append(n)
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(ns, pa.int64())], ["key", "id", "h", "line"])

    return run


def _rewrite(drop_lines, digest: bool):
    """``drop_lines(i, id, lines, batch)`` gives a flag for each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_pylist()
            n_lines, n_dropped, kept = [], [], []
            for i, text in enumerate(batch.column(0).to_pylist()):
                lines = text.split(b"\n")
                gone = drop_lines(i, ids[i], lines, batch)
                left = [x for x, g in zip(lines, gone) if not g]
                body = b"\n".join(left)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
                kept.append(hashlib.sha256(body).hexdigest().encode() if digest else body)
            cols = [batch.column(1), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary())]
            names = ["id", "n_lines", "n_dropped", "kept"]
            for i in range(2, batch.num_columns):
                if batch.schema.names[i] != "__gone":
                    cols.append(batch.column(i))
                    names.append(batch.schema.names[i])
            yield pa.record_batch(cols, names)

    return run


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, digest: bool = False, carry: tuple[str, ...] = (), max_bits: int = 1 << 29, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Remove lines whose key occurs in ``min_docs`` documents or more.

    Returns id, n_lines (before), n_dropped and ``kept``: the remaining lines
    joined by ``\\n``, or their SHA-256 in hex with ``digest``; then the columns
    ``carry``. With ``keep_first`` the first line by (id, line number) with the
    key stays. Rows with a null id never hold a first occurrence; if a key has
    no other rows, all its lines go.

    The keys to drop are broadcast while they take ``broadcast_bytes`` at most.
    """
    spark = docs.sparkSession
    texts = docs.select(text_bytes(text_col).alias("text"), F.col(id_col).cast("long").alias("id"))
    bloom = spark.sparkContext.broadcast(repeat_filter(texts, min_chars, max_bits))
    bad = stored(repeated_lines(texts, bloom, min_docs=min_docs, min_chars=min_chars, keep_first=keep_first), "lines")
    size = bad.agg(F.sum(F.length("key") + 100)).first()[0] or 0
    texts = docs.select(text_bytes(text_col).alias("text"), F.col(id_col).cast("long").alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    extra = "".join(f", c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    schema = "id long, n_lines long, n_dropped long, kept binary" + extra
    if size <= broadcast_bytes:
        known = spark.sparkContext.broadcast({bytes(r.key): (r.first_id, r.first_line) for r in bad.collect()})

        def flags(i, doc, lines, batch):
            table = known.value
            keys = [x.strip().lower() for x in lines]
            if keep_first:
                return [k in table and (doc is None or table[k] != (doc, n)) for n, k in enumerate(keys)]
            return [k in table for k in keys]

        out = texts.mapInArrow(_rewrite(flags, digest), schema)
    else:
        # rows of equal id and text lose the same lines: one hash names them
        hashed = texts.withColumn("h", F.xxhash64("id", "text"))
        lines = hashed.select("text", "id", "h").mapInArrow(_emit(bloom, min_chars), "key binary, id long, h long, line long")
        # a line that stands often in a document has more rows than "n" says; the bound then only is a little higher
        total = bad.agg(F.sum("n")).first()[0] or 0
        gone = join_by_key(lines, bad, "key", "n", total)
        if keep_first:
            gone = gone.where(~(F.col("id").eqNullSafe(F.col("first_id")) & F.col("line").eqNullSafe(F.col("first_line"))) | F.col("id").isNull())
        gone = gone.groupBy("h", "line").agg(F.count("*").alias("n")).groupBy("h").agg(F.collect_list("line").alias("__gone"), F.max("n").alias("n"))
        gone = stored(gone, "gone")
        joined = join_by_key(hashed, gone, "h", "n", docs.count(), how="left").drop("h")

        def flags(i, doc, lines, batch):
            out = [False] * len(lines)
            for n in batch.column("__gone")[i].as_py() or ():
                out[n] = True
            return out

        out = joined.mapInArrow(_rewrite(flags, digest), schema)
    own = [] if id_col in carry else [F.col("id").alias(id_col)]
    return out.select(*own, "n_lines", "n_dropped", F.col("kept").cast("string").alias("kept"), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .base import table

    out = drop_repeated_lines(table(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.col("kept").alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT r, doc_id, i, string_split(text, chr(10))[i] AS line
  FROM d, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), bad AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE b.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE b.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN bad b ON k.key = b.key
GROUP BY r, doc_id
"""
