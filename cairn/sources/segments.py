"""Indexes of an engine's live rows, kept as segments.

A segment is a Parquet folder written whole. A pointer file lists the segments
in use, the version of the records that they cover, and what else a reader needs;
the newest pointer counts. Rows that were deleted or replaced since stay in their
segments until a rebuild; a list of them, by id and number, goes with the pointer.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.bm25 import TextIndex
from ..operators.knn import IvfIndex
from .store import _fs, delete


class Segments:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _pointers(self) -> list[str]:
        fs, p = _fs(self.spark, f"{self.path}/_current")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def state(self) -> dict | None:
        found = self._pointers()
        return json.loads(self.spark.read.text(f"{self.path}/_current/{found[-1]}", wholetext=True).first()[0]) if found else None

    def commit(self, state: dict) -> None:
        """Make ``state`` the current one, and delete segments that neither it
        nor the one before names."""
        before = self._pointers()
        n = int(before[-1].split(".")[0]) + 1 if before else 0
        old = self.state() or {"segments": []}
        fs, p = _fs(self.spark, f"{self.path}/_current/{n:012d}.json")
        out = fs.create(p, False)  # fails if another writer took the number
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        for pointer in before[:-1]:
            delete(self.spark, f"{self.path}/_current/{pointer}")
        keep = {*state["segments"], *old["segments"], state.get("gone"), old.get("gone")}
        fs, root = _fs(self.spark, self.path)
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            if name.startswith("s-") and name not in keep:
                delete(self.spark, f"{self.path}/{name}")

    def new_name(self) -> str:
        return f"s-{uuid.uuid4().hex[:12]}"

    def covers(self, version: str | None) -> bool:
        state = self.state()
        return state is not None and state["covers"] == version

    def read(self, state: dict, part: str) -> DataFrame:
        paths = [f"{self.path}/{s}/{part}" for s in state["segments"]]
        out = self.spark.read.parquet(paths[0])
        for p in paths[1:]:  # one by one, so that each keeps its partition column
            out = out.unionByName(self.spark.read.parquet(p))
        return out

    def gone(self, segments: list[str], live: DataFrame) -> str | None:
        """The name of the list of rows (id, number) that aren't live any more."""
        key = live.select("id", F.coalesce("index_id", F.lit(-1)).alias("number"))
        name = self.new_name()
        self.read({"segments": segments}, "ids").select("id", "number").join(key, ["id", "number"], "left_anti").write.parquet(f"{self.path}/{name}/gone")
        return None if self.spark.read.parquet(f"{self.path}/{name}/gone").isEmpty() else name

    def kept(self, state: dict, rows: DataFrame) -> DataFrame:
        """``rows`` (id, number, ...) without those that are gone; the list is
        broadcast while Spark finds it small."""
        if not state.get("gone"):
            return rows
        return rows.join(self.spark.read.parquet(f"{self.path}/{state['gone']}/gone"), ["id", "number"], "left_anti")


class KeywordIndex(Segments):
    """Postings (id, number, dl, term, tf) in folders by the term's bucket, and
    the lengths of documents; the pointer has the statistics of live ones."""

    BUCKETS = 64

    def _write(self, rows: DataFrame, name: str) -> None:
        """A segment of rows (id, index_id, text): each text is tokenised once,
        and only counted terms shuffle."""
        toks = rows.select("id", F.coalesce("index_id", F.lit(-1)).alias("number"), tokens(F.coalesce("text", F.lit(""))).alias("t"))
        words = toks.select("id", "number", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term"))
        postings = words.groupBy("id", "number", "dl", "term").agg(F.count("*").alias("tf")).withColumn("bucket", self.bucket())
        spread = F.pmod(F.xxhash64("id"), F.lit(8))
        postings.repartition("bucket", spread).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.path}/{name}/postings")
        whole = self.spark.read.parquet(f"{self.path}/{name}/postings")
        whole.groupBy("id", "number").agg(F.first("dl").alias("dl")).write.parquet(f"{self.path}/{name}/ids")

    @classmethod
    def bucket(cls):
        return F.pmod(F.xxhash64("term"), F.lit(cls.BUCKETS)).cast("int")

    def _commit(self, segments: list[str], live: DataFrame, covers: str | None) -> None:
        state = {"segments": segments, "gone": self.gone(segments, live), "covers": covers}
        r = self.kept(state, self.read(state, "ids")).agg(F.count("*").alias("n"), F.sum("dl").alias("total")).first()
        self.commit({**state, "n": r.n, "total_len": r.total or 0})

    def rebuild(self, live: DataFrame, covers: str | None) -> None:
        name = self.new_name()
        self._write(live, name)
        self._commit([name], live, covers)

    def add(self, new: DataFrame, live: DataFrame, covers: str | None, before: str | None) -> None:
        """Take in new rows; without an index of the version ``before``, rebuild."""
        state = self.state()
        if state is None or state["covers"] != before:
            self.rebuild(live, covers)
            return
        name = self.new_name()
        self._write(new, name)
        self._commit([*state["segments"], name], live, covers)

    def removed(self, live: DataFrame, covers: str | None, before: str | None) -> None:
        """Rows were deleted: only the statistics change."""
        state = self.state()
        if state is None or state["covers"] != before:
            self.rebuild(live, covers)
        else:
            self._commit(state["segments"], live, covers)

    def index(self) -> TextIndex:
        state = self.state()
        n, total = state["n"], state["total_len"]
        stats = self.spark.createDataFrame([(n, total, total / n if n else 0.0)], "n long, total_len long, avgdl double")
        return TextIndex(postings=self.read(state, "postings"), stats=stats, bucket=self.bucket(), keep=lambda hits: self.kept(state, hits))


class VectorIndex(Segments):
    """An inverted file over live vectors: centroids in the pointer's head,
    vectors in folders by cell. New rows join the cells there are; once there
    are ``grow`` times the rows that it was fitted for, it is fitted again."""

    GROW = 2.0

    def _head(self, state: dict) -> np.ndarray:
        return np.array(json.loads(self.spark.read.text(f"{self.path}/{state['head']}/head", wholetext=True).first()[0]))

    def _write(self, index: IvfIndex, rows: DataFrame, name: str) -> None:
        keyed = rows.select(F.struct("id", F.coalesce("index_id", F.lit(-1)).alias("number")).alias("id"), "embedding")
        index.assign(keyed).select("id.id", "id.number", "embedding", "cell").write.partitionBy("cell").parquet(f"{self.path}/{name}/cells")
        keyed.select("id.id", "id.number").write.parquet(f"{self.path}/{name}/ids")

    def rebuild(self, live: DataFrame, covers: str | None) -> None:
        index = IvfIndex.fit(live.select("id", "embedding"))
        if index is None:
            self.commit({"segments": [], "covers": covers, "head": None, "n": 0})
            return
        name = self.new_name()
        self._write(index, live, name)
        self.spark.createDataFrame([(json.dumps(index.centroids.tolist()),)], "value string").coalesce(1).write.text(f"{self.path}/{name}/head")
        self.commit({"segments": [name], "covers": covers, "head": name, "n": index.fitted_rows})

    def add(self, new: DataFrame, live: DataFrame, covers: str | None, before: str | None) -> None:
        state = self.state()
        if state is None or state["covers"] != before or not state["segments"] or live.count() > self.GROW * state["n"]:
            self.rebuild(live, covers)
            return
        name = self.new_name()
        self._write(IvfIndex(self._head(state), None), new, name)
        segments = [*state["segments"], name]
        self.commit({**state, "segments": segments, "gone": self.gone(segments, live), "covers": covers})

    def removed(self, live: DataFrame, covers: str | None, before: str | None) -> None:
        state = self.state()
        if state is None or state["covers"] != before:
            self.rebuild(live, covers)
        else:
            self.commit({**state, "gone": self.gone(state["segments"], live) if state["segments"] else None, "covers": covers})

    def nearest(self, queries: DataFrame, k: int, ef: int) -> DataFrame | None:
        """qid, rank, id, distance of live rows; None without vectors."""
        state = self.state()
        if not state["segments"]:
            return None
        return IvfIndex(self._head(state), self.kept(state, self.read(state, "cells"))).search(queries, k, ef=ef)
