"""Exact top-k by inner product over a vector-approximation file.

Components become integers. The approximation file has, for each vector, the
number of the cell of each component (2^CELL_BITS cells between the least and
the greatest value that any vector has there, each of several values). A scan of
the cells bounds every inner product from both sides; the k-th greatest lower
bound of a query is a threshold that only candidates with a greater upper bound
can pass. A second scan reads exact vectors of those in the order of their
bounds, a few at a time, and stops once the k-th exact score so far is above all
bounds that are left. Each task does so over its own rows, beginning with the
threshold of all, and sends its k best; the best of those are the result.

A cell's middle and half its width bound a component, so one matrix product of
the queries with the middles, and one number for each query, bound all inner
products. Middles are doubled to stay integers.

Of rows with one vector, only the k of each id and the k + 1 least ids can be
results; where a vector has more, the others leave before the scans. So copies,
however many, aren't scored again and again.

Queries go in blocks of ``query_block`` to all rows; only a block is ever
broadcast. All that is computed is exact: in floats or doubles while they hold
every integer that may occur, else in 64-bit integers, which inner products must fit.

Defined cases: vectors that are null or empty, or hold a null or a non-finite
component, take no part. A shorter vector counts as having zeros at the end. A
query's own rows are all rows of its id; of repeated query rows each distinct
vector answers, with its ranks. Repeated rows are candidates of their own, each
with a rank. Null ids take no part. Ties go to the smaller id. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import numbered, stored, table

CELL_BITS = 6
QUERY_BLOCK = 4096
#: Exact vectors that a query reads of a batch before its bound is tightened.
READS = 4
BATCH = 1024


def integers(col: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component, computed in doubles."""
    return F.transform(F.col(col), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(col: str) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.col(col).isNotNull() & (F.size(col) > 0) & ~F.exists(F.col(col), bad)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of integers, zeros at the end of shorter ones."""
    offsets = col.offsets.to_numpy()
    values = col.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = values
    return out


def _rows(col: pa.Array, kind: str, dim: int) -> np.ndarray:
    """Rows of a binary column, each ``dim`` numbers."""
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(-1, dim)


def _least_int(lo: np.ndarray, hi: np.ndarray) -> str:
    for kind in ("<i2", "<i4"):
        if np.iinfo(kind).min <= lo.min(initial=0) and hi.max(initial=0) <= np.iinfo(kind).max:
            return kind
    return "<i8"


def _ranges(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo = hi = None
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(0), dim)
                a, b = m.min(axis=0), m.max(axis=0)
                lo, hi = (a, b) if lo is None else (np.minimum(lo, a), np.maximum(hi, b))
        if lo is not None:
            yield pa.record_batch([pa.array(np.arange(dim), pa.int32()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["pos", "lo", "hi"])

    return run


class Cells:
    """Cells of equal width for each component."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, bits: int = CELL_BITS):
        self.lo, self.span, self.n = lo, hi - lo + 1, 1 << bits
        c = np.arange(self.n + 1, dtype=np.int64)[:, None]
        edges = lo + -(-(c * self.span) // self.n)
        self.least, self.most = edges[:-1], np.maximum(edges[:-1], edges[1:] - 1)

    def encode(self, m: np.ndarray) -> np.ndarray:
        return ((m - self.lo) * self.n // self.span).astype(np.uint8)

    def middles(self, codes: np.ndarray) -> np.ndarray:
        """Twice the middle of each component's cell."""
        return (self.least + self.most)[codes, np.arange(codes.shape[1])]

    @property
    def widths(self) -> np.ndarray:
        """Twice the most that a component is off its cell's middle."""
        return (self.most - self.least).max(axis=0)


def _approximate(cells: Cells, dim: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(2), dim)
            codes, exact = cells.encode(m), [r.tobytes() for r in m.astype(kind)]
            same = np.array([xxhash.xxh3_64_intdigest(x) for x in exact], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(exact, pa.binary()), pa.array(same), batch.column(3)], ["row", "vec_id", "cells", "v", "same", "is_query"])

    return run


def without_copies(exact: DataFrame, k: int) -> DataFrame:
    """``exact`` without rows that can be nobody's result, as enough rows of
    smaller ids have the same vector (hash ``same``). A query leaves out the
    rows of its own id, so k + 1 ids stay, with k rows each at most. Rows meet by
    their number, and limits apply before the shuffle: no group meets in a task."""
    often = stored(exact.groupBy("same").agg(F.count("*").alias("n")).where(F.col("n") > k).select("same"), "often")
    if often.isEmpty():
        return exact
    rows = stored(exact.select("row", "vec_id", "same").join(often, "same", "left_semi"), "copies")
    own = F.row_number().over(Window.partitionBy("same", "vec_id").orderBy("row"))
    ids = F.dense_rank().over(Window.partitionBy("same").orderBy("vec_id"))
    kept = rows.withColumn("r", own).where(F.col("r") <= k).withColumn("i", ids).where(F.col("i") <= k + 1)
    gone = rows.select("row").join(kept.select("row"), "row", "left_anti")
    return stored(exact.join(gone, "row", "left_anti"), "cells")


def _number_kind(most: float):
    """The fastest type that holds sums up to ``most`` exactly."""
    return np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else np.int64


class Scan:
    """Bounds of a block of queries, twice as great as the inner products."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, cells: Cells):
        self.ids, self.cells = ids, cells
        most = float(np.abs(q).sum(axis=1).max(initial=0)) * 2.0 * float(max(np.abs(cells.lo).max(), np.abs(cells.lo + cells.span).max()))
        self.kind = _number_kind(most)
        self.q = q.astype(self.kind)
        self.off = np.abs(q) @ cells.widths

    def middles(self, codes: np.ndarray) -> np.ndarray:
        return self.q @ self.cells.middles(codes).astype(self.kind).T


def _code_batches(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, BATCH):
            part = batch.slice(i, BATCH)
            yield part.column(0).to_numpy(), _rows(part.column(1), "u1", dim)


def _thresholds(shared, k: int, dim: int):
    """The task's k greatest lower bounds of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = shared.value
        low = np.iinfo(np.int64).min
        best = np.full((len(scan.ids), k), low, np.int64)
        for vec, codes in _code_batches(batches, dim):
            mid = scan.middles(codes)
            # only what beats a query's k-th so far is looked at
            kth = best.min(axis=1)
            rows, cols = np.nonzero(mid > np.where(kth == low, low, kth + scan.off)[:, None])
            other = scan.ids[rows] != vec[cols]
            rows, lower = rows[other], mid[rows[other], cols[other]].astype(np.int64) - scan.off[rows[other]]
            if not len(rows):
                continue
            order = np.lexsort((-lower, rows))
            rows, lower = rows[order], lower[order]
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
            top = place < k
            new = np.full((len(scan.ids), k), low, np.int64)
            new[rows[top], place[top]] = lower[top]
            best = np.sort(np.concatenate([best, new], axis=1), axis=1)[:, : -k - 1 : -1]
        rows, cols = np.nonzero(best != low)
        yield pa.record_batch([pa.array(rows.astype(np.int32)), pa.array(best[rows, cols])], ["q", "bound"])

    return run


class Best:
    """The k best (score, vec_id) of each query so far; empty places are at the
    end, with the least score."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), np.iinfo(np.int64).min, np.int64)
        self.vec = np.full((queries, k), np.iinfo(np.int64).max, np.int64)

    def add(self, q: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        k = self.score.shape[1]
        own = np.unique(q)
        at = np.concatenate([np.repeat(own, k), q])
        s, v = np.concatenate([self.score[own].ravel(), score]), np.concatenate([self.vec[own].ravel(), vec])
        order = np.lexsort((v, ~s, at))  # ~ turns the order of integers round
        at, s, v = at[order], s[order], v[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        top = place < k
        self.score[at[top], place[top]], self.vec[at[top], place[top]] = s[top], v[top]


def _read_in_order(scan: Scan, q: np.ndarray, best: Best, edge: np.ndarray, mid: np.ndarray, vec: np.ndarray, exact: np.ndarray) -> int:
    """Exact scores of a batch's vectors in the order of their upper bounds,
    until no bound left reaches the k-th score (``edge``: twice the threshold
    that holds for all). Returns how many were read."""
    low = np.iinfo(np.int64).min

    def bar():
        """What a doubled middle must reach, so that its upper bound does."""
        kth = best.score[:, -1]
        most = np.maximum(edge, np.where(kth == low, low, 2 * np.maximum(kth, low // 2)))
        return np.where(most == low, low, most - scan.off)

    rows, cols = np.nonzero(mid >= bar()[:, None])
    other = scan.ids[rows] != vec[cols]
    rows, cols = rows[other], cols[other]
    upper = mid[rows, cols].astype(np.int64)
    order = np.lexsort((vec[cols], -upper, rows))
    rows, cols, upper = rows[order], cols[order], upper[order]
    read, step = 0, READS
    while len(rows):
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        now = place < step
        r, c = rows[now], cols[now]
        for i in range(0, len(r), 65_536):
            x, y = r[i : i + 65_536], c[i : i + 65_536]
            best.add(x, np.einsum("ij,ij->i", q[x], exact[y].astype(np.int64)), vec[y])
        read += len(r)
        rows, cols, upper = rows[~now], cols[~now], upper[~now]
        left = upper >= bar()[rows]  # ties at the bar may have smaller ids
        rows, cols, upper = rows[left], cols[left], upper[left]
        step *= 2
    return read


def _search(shared, k: int, dim: int, kind: str, reads=None):
    """The task's k best of each query. ``reads`` counts exact vectors read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, q, least = shared.value
        best = Best(len(scan.ids), k)
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                mid = scan.middles(_rows(part.column(1), "u1", dim))
                n = _read_in_order(scan, q, best, least, mid, part.column(0).to_numpy(), _rows(part.column(2), kind, dim))
                if reads is not None:
                    reads.add(n)
        rows, cols = np.nonzero(best.score != np.iinfo(np.int64).min)
        yield pa.record_batch([pa.array(rows.astype(np.int32)), pa.array(best.vec[rows, cols]), pa.array(best.score[rows, cols])], ["q", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, query_block: int = QUERY_BLOCK, bits: int = CELL_BITS, reads=None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query row's ``k``
    greatest inner products over all other rows. ``reads``, an accumulator, gets
    the number of exact vectors read."""
    spark = vectors.sparkSession
    raw = stored(numbered(vectors.where(F.col(id_col).isNotNull() & usable(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), is_query.alias("is_query"), integers(vector_col, scale).alias("v"))), "vectors")
    schema = "query_id long, rank int, vec_id long, score long"
    empty = spark.createDataFrame([], schema)
    dim = raw.agg(F.max(F.size("v"))).first()[0]
    if not dim:
        return empty
    ranges = raw.select("v").mapInArrow(_ranges(dim), "pos int, lo long, hi long").groupBy("pos").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("pos").collect()
    lo, hi = np.array([r.lo for r in ranges]), np.array([r.hi for r in ranges])
    cells, kind = Cells(lo, hi, bits), _least_int(lo, hi)
    # columns lie apart in the file: a scan of cells reads no vector
    exact = stored(raw.select("row", "vec_id", "v", "is_query").mapInArrow(_approximate(cells, dim, kind), "row long, vec_id long, cells binary, v binary, same long, is_query boolean"), "cells")
    rows = without_copies(exact, k)
    results = []
    block: list = []

    def answer():
        ids = np.array([r.vec_id for r in block], np.int64)
        q = np.frombuffer(b"".join(bytes(r.v) for r in block), kind).reshape(-1, dim).astype(np.int64)
        scan = Scan(ids, q, cells)
        shared = spark.sparkContext.broadcast(scan)
        order = Window.partitionBy("q").orderBy(F.col("bound").desc())
        found = rows.select("vec_id", "cells").mapInArrow(_thresholds(shared, k, dim), "q int, bound long").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
        least = np.full(len(ids), np.iinfo(np.int64).min, np.int64)
        for r in found.groupBy("q").agg(F.min("bound").alias("bound"), F.count("*").alias("n")).where(F.col("n") >= k).collect():
            least[r.q] = r.bound
        second = spark.sparkContext.broadcast((scan, q, least))
        near = rows.select("vec_id", "cells", "v").mapInArrow(_search(second, k, dim, kind, reads), "q int, vec_id long, score long")
        by_score = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
        top = near.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
        names = F.broadcast(spark.createDataFrame(list(enumerate(ids.tolist())), "q int, query_id long"))
        results.append(stored(top.join(names, "q").select("query_id", F.col("rank").cast("int"), "vec_id", "score"), "top"))

    for row in exact.where("is_query").select("vec_id", "v").distinct().toLocalIterator():
        block.append(row)
        if len(block) >= query_block:
            answer()
            block.clear()
    if block:
        answer()
    out = empty
    for r in results:
        out = out.unionByName(r)
    return out


def op3_vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
