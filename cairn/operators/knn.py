"""Nearest neighbours by cosine distance: exact for a frame of queries, and an
inverted-file index whose recall is measured against it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import StorageError
from ..functions.vectors import norm
from ..sources.scratch import stored
from .best import Best

#: Queries of one pass over the vectors; only a block is ever broadcast.
QUERY_BLOCK = 4096
#: Vectors and queries that are compared at once, and products of vectors and
#: centroids held at once.
TILE_ROWS, TILE_QUERIES, PRODUCTS = 4096, 256, 1 << 22


def _unit(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension as unit rows."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _by_id(batch: pa.RecordBatch, dim: int) -> pa.RecordBatch:
    """Rows of vectors of ``dim`` components, in the order of ids."""
    part = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), dim)) if batch.num_rows else batch
    return part.take(pc.sort_indices(part.column(0), null_placement="at_start")) if part.num_rows else part


def _compare(best: Best, asks: np.ndarray, q: np.ndarray, ids: pa.Array, unit: np.ndarray) -> None:
    """Offers the distances of the queries ``asks`` (their vectors ``q``) to
    vectors in the order of their ids, a tile at a time."""
    for x in range(0, len(unit), TILE_ROWS):
        own, some = unit[x : x + TILE_ROWS].T, ids[x : x + TILE_ROWS]
        for y in range(0, len(asks), TILE_QUERIES):
            best.offer(asks[y : y + TILE_QUERIES], np.round(1.0 - q[y : y + TILE_QUERIES] @ own, 9), some)


def _nearest(shared, k: int):
    """Each task's k nearest of each query; ties by the rounded distance and
    the id's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        best, asks = Best(qids, k), np.arange(len(qids))
        for batch in batches:
            part = _by_id(batch, q.shape[1])
            if part.num_rows:
                _compare(best, asks, q, part.column(0), _unit(part.column(1)))
        yield from best.result()

    return run


def _answered(asked: DataFrame, schema: str, block: int, answer) -> DataFrame:
    """The union of ``answer(qids, unit queries)`` over blocks of queries of one
    dimension; only a block is ever held or broadcast."""
    spark = asked.sparkSession
    out, held = spark.createDataFrame([], schema), []
    kind = to_arrow_type(asked.schema["qid"].dataType)

    def flush(out: DataFrame) -> DataFrame:
        for dim in {len(v) for _, v in held}:
            own = [(i, v) for i, v in held if len(v) == dim]
            q = np.array([v for _, v in own], np.float64)
            found = answer(pa.array([i for i, _ in own], kind), q / np.linalg.norm(q, axis=1, keepdims=True))
            out = out if found is None else out.unionByName(found)
        held.clear()
        return out

    for r in asked.toLocalIterator():
        held.append((r.qid, list(r.embedding)))
        if len(held) >= block:
            out = flush(out)
    return flush(out)


def _directed(vectors: DataFrame) -> DataFrame:
    return vectors.where((F.size("embedding") > 0) & (norm(F.col("embedding")) > 0))


def _schema(vectors: DataFrame, queries: DataFrame) -> str:
    return f"qid {queries.schema['qid'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, distance double"


def exact_knn(vectors: DataFrame, queries: DataFrame, k: int, *, query_block: int = QUERY_BLOCK) -> DataFrame:
    """qid, rank, id, distance. ``vectors`` has id and embedding, ``queries``
    qid and embedding; vectors without a direction or of another dimension take
    no part. Ties go to the smaller id."""
    live = _directed(vectors.select("id", "embedding"))
    schema = _schema(vectors, queries)

    def answer(qids: pa.Array, q: np.ndarray) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast((qids, q))
        return live.mapInArrow(_nearest(shared, k), schema)

    asked = _directed(queries.select("qid", "embedding"))
    out = _answered(asked if k > 0 else asked.limit(0), schema, query_block, answer)
    order = Window.partitionBy("qid").orderBy("distance", "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "distance")


def _nearest_in_cells(shared, k: int):
    """Each task's nearest of each query among the cells that it probes. A
    vector may be there in several cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, probed = shared.value
        best = Best(qids, k, distinct=True)
        for batch in batches:
            part = _by_id(batch, q.shape[1])
            if not part.num_rows:
                continue
            cell, unit = part.column(2).to_numpy(), _unit(part.column(1))
            for c in np.unique(cell).tolist():
                own, asks = np.flatnonzero(cell == c), np.flatnonzero(probed[c])
                if len(asks):
                    _compare(best, asks, q if len(asks) == len(q) else q[asks], part.column(0).take(pa.array(own)), unit[own])
        yield from best.result()

    return run


class IvfIndex:
    """Cells around centroids fitted on a bounded sample. Every vector is in its
    COPIES nearest cells, and a query reads the nearest cells: a share of
    ``ef`` / FULL_EF of them, so that FULL_EF reads all."""

    VERSION = 2
    COPIES = 2
    FULL_EF = 400

    def __init__(self, centroids: np.ndarray, cells: DataFrame | None, fitted_rows: int = 0):
        self.centroids, self.cells, self.fitted_rows = centroids, cells, fitted_rows

    @classmethod
    def fit(cls, vectors: DataFrame, *, n_cells: int | None = None, sample_rows: int = 100_000, seed: int = 7, rounds: int = 10) -> IvfIndex | None:
        """Centroids alone; None without vectors. Four times the root of the
        rows is the number of cells, up to a 16th of the sample."""
        live = _directed(vectors.select("id", "embedding"))
        n = live.count()
        if not n:
            return None
        n_cells = max(1, min(n, n_cells or int(4 * np.sqrt(n)), sample_rows // 16))
        # the sample: the least hashes, so that it doesn't depend on partitions
        sample = live.orderBy(F.xxhash64(F.lit(seed), "id")).limit(min(sample_rows, 256 * n_cells))
        x = _unit(sample.select("embedding").toArrow().column(0).combine_chunks())
        rng = np.random.default_rng(seed)
        c = x[rng.permutation(len(x))[:n_cells]]
        for _ in range(rounds):
            own = np.concatenate([(part @ c.T).argmax(axis=1) for part in np.array_split(x, len(x) * n_cells // PRODUCTS + 1)])
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            filled = np.bincount(own, minlength=len(c)) > 0
            c[filled] = sums[filled]
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        return cls(c, None, n)

    def assign(self, vectors: DataFrame) -> DataFrame:
        """id, embedding and cell, COPIES rows for each vector."""
        live = _directed(vectors.select("id", "embedding"))
        shared = vectors.sparkSession.sparkContext.broadcast(self.centroids)
        copies = min(self.COPIES, len(self.centroids))

        def run(batches):
            for b in batches:
                b = b.filter(pc.equal(pc.list_value_length(b.column(1)), shared.value.shape[1])) if b.num_rows else b
                if b.num_rows:
                    parts = np.array_split(_unit(b.column(1)), b.num_rows * len(shared.value) // PRODUCTS + 1)
                    near = np.concatenate([np.argpartition(-(u @ shared.value.T), copies - 1, axis=1)[:, :copies] for u in parts])
                    rows = pa.array(np.repeat(np.arange(b.num_rows), copies))
                    yield pa.record_batch([b.column(0).take(rows), b.column(1).take(rows), pa.array(near.ravel().astype(np.int32))], ["id", "embedding", "cell"])

        kind = vectors.schema["id"].dataType.simpleString()
        return live.mapInArrow(run, f"id {kind}, embedding array<float>, cell int")

    @classmethod
    def build(cls, vectors: DataFrame, **options) -> IvfIndex:
        """Fitted, with its cells written to the shared folder, each in one
        stretch, so that a batch of rows has few of them."""
        index = cls.fit(vectors, **options) or cls(np.zeros((1, 1)), None)
        index.cells = stored(index.assign(vectors).repartition("cell").sortWithinPartitions("cell"), "cells")
        return index

    def save(self, path: str) -> None:
        """Cells as Parquet, partitioned by cell so that a probe reads only its
        own; centroids and version beside them."""
        spark = self.cells.sparkSession
        self.cells.write.mode("errorifexists").partitionBy("cell").parquet(f"{path}/cells")
        head = json.dumps({"version": self.VERSION, "centroids": self.centroids.tolist()})
        spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IvfIndex:
        head = json.loads(spark.read.text(f"{path}/head", wholetext=True).first()[0])
        if head.get("version") != cls.VERSION:
            raise StorageError(f"unsupported index version: {head.get('version')}")
        return cls(np.array(head["centroids"]), spark.read.parquet(f"{path}/cells"))

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None, *, ef: int = 100, query_block: int = QUERY_BLOCK) -> DataFrame:
        """qid, rank, id, distance from the probed cells: ``nprobe`` of them, or
        as many as ``ef`` says."""
        n = len(self.centroids)
        nprobe = max(1, min(n, nprobe or -(-n * ef // self.FULL_EF)))
        cells = self.cells.select("id", "embedding", "cell")
        schema = _schema(cells, queries)

        def answer(qids: pa.Array, q: np.ndarray) -> DataFrame | None:
            if q.shape[1] != self.centroids.shape[1]:
                return None
            probed = np.zeros((n, len(q)), bool)
            for at in np.array_split(np.arange(len(q)), len(q) * n // PRODUCTS + 1):
                probed[np.argpartition(-(q[at] @ self.centroids.T), nprobe - 1, axis=1)[:, :nprobe], at[:, None]] = True
            shared = queries.sparkSession.sparkContext.broadcast((qids, q, probed))
            some = cells.where(F.col("cell").isin(np.flatnonzero(probed.any(axis=1)).tolist())) if not probed.any(axis=1).all() else cells
            return some.mapInArrow(_nearest_in_cells(shared, k), schema)

        pairs = _answered(_directed(queries.select("qid", "embedding")), schema, query_block, answer)
        pairs = pairs.groupBy("qid", "id").agg(F.min("distance").alias("distance"))
        order = Window.partitionBy("qid").orderBy("distance", "id")
        return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "distance")


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: n_queries and recall, the mean over queries of the true
    neighbours found, of min(k, their number)."""
    t = truth.where(F.col("rank") <= k).select("qid", "id")
    hit = found.where(F.col("rank") <= k).select("qid", "id", F.lit(1).alias("hit"))
    each = t.join(hit, ["qid", "id"], "left").groupBy("qid").agg(F.count("hit").alias("h"), F.count("*").alias("n"))
    return each.agg(F.count("*").alias("n_queries"), F.avg(F.col("h") / F.least("n", F.lit(k))).alias("recall"))


def percentiles(values: list[float], at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> list[float]:
    """Of measured latencies: the sorted value at place int(n * q), the last at
    most."""
    ordered = sorted(values)
    return [ordered[min(int(len(ordered) * q), len(ordered) - 1)] for q in at] if ordered else [0.0] * len(at)
