"""Hybrid retrieval: vector and keyword branches, blended and ranked for a
frame of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BadRequest
from ..functions.text import preview
from ..sources.scratch import stored
from .bm25 import TextIndex
from .filters import SearchFilter
from .knn import exact_knn
from .request import mode_of


def best_chunks(chunk_hits: DataFrame) -> DataFrame:
    """Chunk hits (qid, id, chunk_index, distance) as parents: the least
    distance, and the chunk that has it (the first of ties)."""
    first = F.min_by("chunk_index", F.struct("distance", "chunk_index"))
    return chunk_hits.groupBy("qid", "id").agg(F.min("distance").alias("distance"), first.alias("chunk_index"))


def blend(distance: Column, score: Column, dmin: Column, dmax: Column, smax: Column, alpha: float) -> Column:
    """alpha times the scaled similarity plus the rest times the scaled score."""
    scaled = F.when(dmax > dmin, 1.0 - (distance - dmin) / (dmax - dmin)).otherwise(1.0 - distance)
    vec = F.when(distance.isNull(), 0.0).otherwise(scaled)
    bm = F.when(score.isNull() | (smax <= 0), 0.0).otherwise(score / smax)
    return F.lit(alpha) * vec + F.lit(1.0 - alpha) * bm


def search(records: DataFrame, queries: DataFrame, *, k: int = 5, alpha: float = 0.7, filter: SearchFilter | None = None, index: TextIndex | None = None, chunks: DataFrame | None = None, prefilter: bool = False, nearest: Callable[[DataFrame, int], DataFrame | None] | None = None, text_col: str = "text") -> DataFrame:
    """Hits of each query: qid, rank, id, type, distance, bm25_score,
    hybrid_score, title, source, tags, and best_chunk where there are chunks.

    ``records`` are live rows (id, ``text_col``, embedding, title, source, tags,
    updated_at); ``queries`` has qid, text and embedding (either may be null).
    Branches are cut to max(4k, 100) candidates first, and scales are taken
    from those; then the filter applies, unless ``prefilter``. ``nearest``, of
    the queries and a number, stands in for exact neighbours. Without any text
    among the queries the keyword branch isn't run.
    """
    mode = mode_of(alpha)
    if prefilter and filter is not None:
        records = records.where(filter.column())
        if chunks is not None:
            chunks = chunks.join(records.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    found, best = _candidates(records, queries, mode, max(4 * k, 100), index, chunks, nearest, text_col)
    return _ranked(_described(found, records), mode, alpha, k, None if prefilter else filter, best, chunks)


def sweep(records: DataFrame, queries: DataFrame, alphas: tuple[float, ...], *, k: int = 5, index: TextIndex | None = None, text_col: str = "text") -> DataFrame:
    """alpha and the hits of a search with each of the weights between 0 and 1:
    the branches run once for all of them."""
    found, _ = _candidates(records, queries, "hybrid", max(4 * k, 100), index, None, None, text_col)
    rows, out = stored(_described(found, records), "candidates"), None
    for a in alphas:
        if mode_of(a) != "hybrid":
            raise BadRequest(f"alpha {a} has a branch of its own")
        part = _ranked(rows, "hybrid", a, k, None, None, None).select(F.lit(a).alias("alpha"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def _candidates(records: DataFrame, queries: DataFrame, mode: str, budget: int, index: TextIndex | None, chunks: DataFrame | None, nearest: Callable[[DataFrame, int], DataFrame | None] | None, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """qid, id, distance and score of both branches' ``budget`` best, and the
    best chunks where there are chunks."""
    vec = bm = best = None
    if mode != "bm25_only":
        if chunks is None:
            vec = nearest(queries, budget) if nearest else None
            if vec is None:
                vec = exact_knn(records.where(F.col("embedding").isNotNull()), queries, budget)
            vec = vec.select("qid", "id", "distance")
        else:
            rows = chunks.where(~F.coalesce("deleted", F.lit(False))).select(F.struct("parent_id", "chunk_index").alias("key"), "embedding")
            rows = rows.withColumn("id", F.concat_ws("\0", F.col("key.parent_id"), F.lpad(F.col("key.chunk_index").cast("string"), 19, "0")))
            near = exact_knn(rows.select("id", "embedding"), queries, budget)
            at = F.split("id", "\0")
            near = near.select("qid", at[0].alias("id"), at[1].cast("long").alias("chunk_index"), "distance")
            best = best_chunks(near.join(records.select("id"), "id", "left_semi"))
            vec = best.select("qid", "id", "distance")
    if mode == "bm25_only" or mode == "hybrid" and not queries.where(F.col("text").isNotNull()).isEmpty():
        index = index or TextIndex.build(records, "id", text_col)
        bm = index.top_k(queries.where(F.col("text").isNotNull()), budget).select("qid", "id", F.round("score", 9).alias("score"))
    if vec is None:
        found = bm.withColumn("distance", F.lit(None).cast("double"))
    elif bm is None:
        found = vec.withColumn("score", F.lit(None).cast("double"))
    else:
        found = vec.join(bm, ["qid", "id"], "full_outer")
    return found, best


def _described(found: DataFrame, records: DataFrame) -> DataFrame:
    """Candidates with their scales and the fields of their records."""
    over = Window.partitionBy("qid")
    scales = {"dmin": F.min("distance").over(over), "dmax": F.greatest(F.lit(0.0), F.max("distance").over(over)), "smax": F.greatest(F.lit(0.0), F.max("score").over(over))}
    return found.withColumns(scales).join(records.select("id", "title", "source", "tags", "updated_at"), "id")


def _ranked(rows: DataFrame, mode: str, alpha: float, k: int, filter: SearchFilter | None, best: DataFrame | None, chunks: DataFrame | None) -> DataFrame:
    hybrid = blend(F.col("distance"), F.col("score"), F.col("dmin"), F.col("dmax"), F.col("smax"), alpha) if mode == "hybrid" else F.lit(None).cast("double")
    rows = rows.withColumn("hybrid", hybrid)
    if filter is not None:
        rows = rows.where(filter.column())
    worth = {"vector_only": -F.col("distance"), "bm25_only": F.col("score"), "hybrid": F.col("hybrid")}[mode]
    order = Window.partitionBy("qid").orderBy(F.round(worth, 9).desc(), "id")
    top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if best is not None:
        text = chunks.select(F.col("parent_id").alias("id"), "chunk_index", preview(F.col("text")).alias("text_preview"))
        with_chunk = top.join(best.select("qid", "id", "chunk_index"), ["qid", "id"], "left").join(text, ["id", "chunk_index"], "left")
        top = with_chunk.withColumn("best_chunk", F.when(F.col("chunk_index").isNotNull(), F.struct("chunk_index", "text_preview")))
    cols = [F.col("qid"), F.col("rank"), F.col("id"), F.lit(mode).alias("type"), F.col("distance"), F.col("score").alias("bm25_score"), F.col("hybrid").alias("hybrid_score"), F.col("title"), F.col("source"), F.col("tags")]
    return top.select(*cols, *(["best_chunk"] if best is not None else []))
