"""The engine: a folder of versioned tables with batch insert, sync, search,
deletion and compaction."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .errors import BadRequest, StorageError
from .functions.text import build_text, tokens
from .jobs import Job, JobStore
from .operators import compaction, hybrid, ingest
from .operators.chunking import chunk_frame
from .operators.embedding import Embedder, embed_frame, embed_single
from .operators.request import SearchRequest, validate
from .schemas import BATCH, CHUNK, PENDING, STORED
from .sources.oplog import OpLog, fold
from .sources.scratch import stored
from .sources.segments import KeywordIndex, VectorIndex
from .sources.store import VersionedTable, to_json_rows


class SearchEngine:
    """``open`` replays what the log has beyond the records, then all reads are
    of the current versions."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, embedder: Embedder | None = None):
        self.spark, self.config = spark, config or Config()
        self.embedder = embedder or self.config.embedder()
        self.records_table = VersionedTable(spark, f"{path}/records", STORED)
        self.chunks_table = VersionedTable(spark, f"{path}/chunks", CHUNK)
        self.pending_table = VersionedTable(spark, f"{path}/pending", PENDING)
        self.keywords = KeywordIndex(spark, f"{path}/keywords")
        self.vectors = VectorIndex(spark, f"{path}/vectors")
        self.log = OpLog(spark, f"{path}/ops")
        self.jobs = JobStore()
        self.last_outcome: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: Config | None = None, embedder: Embedder | None = None) -> SearchEngine:
        engine = cls(spark, path, config, embedder)
        done = engine.records_table.applied
        beyond = [b for b in engine.log.numbers() if b > done]
        if engine.config.log_enabled and beyond:
            engine.records_table.write(fold(engine.records_table.read(), engine.log.read(done)), applied=max(beyond))
            if engine.chunking:
                engine.rebuild_chunks()
        if engine.chunking and engine.chunks_table.version is None:
            engine.rebuild_chunks()
        version = engine.records_table.version
        if version is not None:  # a writer may have ended between records and indexes
            engine._index(version, version)
        return engine

    def _index(self, version: str | None, before: str | None, new: DataFrame | None = None) -> None:
        """Bring the indexes from the records' version ``before`` to ``version``:
        by new rows, or only without those that went."""
        live = self.live()
        for index, wanted in ((self.keywords, True), (self.vectors, not self.chunking and self.config.vector_index)):
            if not wanted or index.covers(version):
                continue
            if index is self.vectors and live.where(F.size("embedding") > 0).count() < self.config.index_min_rows:
                continue
            if new is None:
                index.removed(live, version, before)
            else:
                index.add(new, live, version, before)

    # --- tables ---

    @property
    def chunking(self) -> bool:
        return self.config.chunks.kind != "none"

    def records(self) -> DataFrame:
        return self.records_table.read()

    def live(self) -> DataFrame:
        """Live, indexed rows with ``text``, what they are found by."""
        return self._with_text(self.records()).where(~F.col("deleted") & F.coalesce("indexed", F.lit(True)))

    @staticmethod
    def _with_text(rows: DataFrame) -> DataFrame:
        return rows.withColumn("text", F.coalesce("embed_text", build_text(F.col("title"), F.col("body"))))

    def chunks(self) -> DataFrame:
        return self.chunks_table.read()

    def pending(self) -> DataFrame:
        return self.pending_table.read()

    def pending_ids(self) -> DataFrame:
        return self.pending().select("id")

    # --- ingestion ---

    def batch_insert(self, docs: list[dict] | DataFrame) -> dict:
        """Accept documents as pending: accepted, failed, errors. The errors of
        a list are a list, those of a DataFrame one of id and error."""
        if self.chunking and not self.config.allow_batch_with_chunks:
            raise BadRequest("batch insert is not supported when chunking is enabled")
        listed = isinstance(docs, list)
        if listed:
            rows = [(i, *[d.get(n) for n in BATCH.fieldNames()]) for i, d in enumerate(docs)]
            rows = [(r[0], r[1] or "", *r[2:]) for r in rows]
            docs = self.spark.createDataFrame(rows, "ord long, id string, title string, body string, source string, updated_at string, tags array<string>, text string")
        elif "ord" not in docs.columns:
            docs = docs.withColumn("ord", F.monotonically_increasing_id())
        accepted, errors = ingest.prepare_batch(docs)
        counts = accepted.select(F.lit(0).alias("bad")).unionAll(errors.select(F.lit(1))).groupBy("bad").count().collect()
        n = {r.bad: r["count"] for r in counts}
        if n.get(0):
            self.pending_table.write(ingest.upsert_pending(self.pending(), accepted))
        found = errors.orderBy("ord").select("id", "error")
        return {"accepted": n.get(0, 0), "failed": n.get(1, 0), "errors": [r.asDict() for r in found.collect()] if listed else found}

    def sync(self, one_by_one: bool = False, on_progress: Callable[[dict], None] | None = None) -> dict:
        """Index what is pending: total, indexed, skipped, failed. Failed rows
        stay pending. ``on_progress`` hears the total first, then the counts
        once rows are embedded."""
        if self.chunking and not self.config.allow_batch_with_chunks:
            raise BadRequest("sync is not supported when chunking is enabled")
        pending, records = self.pending(), self.records()
        if on_progress:
            on_progress({"total": pending.count()})
        outcome, new = ingest.sync(pending, records, self.embedder, one_by_one)
        counts = ingest.progress(outcome).first().asDict()
        if on_progress:
            on_progress(counts)
        if counts["total"]:
            new = stored(new, "new")
            number = self._log_sync(records, new) if self.config.log_enabled else None
            before = self.records_table.version
            version = self.records_table.write(ingest.replace_rows(records, new), applied=number)
            self._index(version, before, self._with_text(new))
            self._leave_pending(pending.join(outcome.where("result = 'failed'").select("id"), "id", "left_semi"))
            if self.chunking:
                self.rebuild_chunks()
        self.maybe_compact()
        self.maybe_rotate()
        return counts

    def _leave_pending(self, rows: DataFrame) -> None:
        """What failed stays pending. If that can't be written in three tries,
        all stays, and the next sync finds it unchanged."""
        for left in (2, 1, 0):
            try:
                self.pending_table.write(rows)
                return
            except Exception as e:
                if not left:
                    raise StorageError(f"indexed, but the pending table could not be written: {e}") from e

    def _log_sync(self, records: DataFrame, new: DataFrame) -> int:
        old = records.where(~F.col("deleted")).join(new.select("id"), "id", "left_semi").select("id")
        gone = old.select(F.lit("delete").alias("op"), F.lit(None).cast("string").alias("kind"), "id", F.lit(None).cast(STORED).alias("record"), F.lit(0).alias("o"))
        rows = new.select(F.lit("write").alias("op"), F.lit("append").alias("kind"), "id", F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STORED.fields]).alias("record"), F.lit(1).alias("o"))
        both = gone.unionByName(rows)
        # only the order within an id counts: deletes come before writes
        return self.log.append(both.withColumn("seq", F.col("o").cast("long")), self.records_table.applied)

    def start_sync(self, wait: bool = False) -> Job:
        """A sync job in the background; a second one meanwhile is a conflict."""
        return self.jobs.run(lambda job: job.progress.update(self.sync(on_progress=job.progress.update)), wait)

    def delete(self, ids: list[str]) -> int:
        """Mark live rows of the ids deleted; the number of rows."""
        wanted = self.spark.createDataFrame([(i,) for i in ids], "id string").distinct()
        records = self.records()
        hit = records.where(~F.col("deleted")).join(wanted, "id", "left_semi").select("id")
        n = hit.count()
        if n:
            number = None
            if self.config.log_enabled:
                ops = hit.select(F.lit(0).cast("long").alias("seq"), F.lit("delete").alias("op"), F.lit(None).cast("string").alias("kind"), "id", F.lit(None).cast(STORED).alias("record"))
                number = self.log.append(ops, self.records_table.applied)
            marked = records.join(wanted.withColumn("_x", F.lit(True)), "id", "left").withColumn("deleted", F.col("deleted") | F.coalesce("_x", F.lit(False))).drop("_x")
            before = self.records_table.version
            version = self.records_table.write(marked, applied=number)
            self._index(version, before)
            if self.chunking:
                chunks = self.chunks().join(wanted.select(F.col("id").alias("parent_id"), F.lit(True).alias("_x")), "parent_id", "left")
                self.chunks_table.write(chunks.withColumn("deleted", F.col("deleted") | F.coalesce("_x", F.lit(False))).drop("_x"))
        return n

    # --- chunks ---

    def rebuild_chunks(self) -> None:
        """Chunks of all live rows, embedded."""
        chunker = self.config.chunks.chunker(self.embedder)
        if chunker is None:
            raise BadRequest("no chunker is configured")
        made = chunk_frame(self.live().where(F.col("text").isNotNull()), chunker)
        rows = embed_frame(made, self.embedder, text_col="text").where(F.col("embedding").isNotNull()).drop("error")
        self.chunks_table.write(rows.withColumn("deleted", F.lit(False)))

    # --- maintenance ---

    def maybe_compact(self) -> bool:
        r = compaction.tombstone_stats(self.records()).first()
        if self.config.tombstones.due(r.total, r.tombstones):
            self.compact()
            return True
        return False

    def compact(self) -> None:
        """New versions without deleted rows; the log is no longer needed."""
        version = self.records_table.write(compaction.compact(self.records()))
        self.keywords.rebuild(self.live(), version)
        if self.vectors.state() is not None:
            self.vectors.rebuild(self.live(), version)
        if self.chunks_table.version is not None:
            self.chunks_table.write(compaction.compact(self.chunks()))
        self.log.truncate()
        for t in (self.records_table, self.chunks_table, self.pending_table):
            t.vacuum()

    def maybe_rotate(self) -> bool:
        """The records are already written when the log is asked."""
        policy = self.config.rotation
        if (policy.max_bytes is None and policy.max_records is None) or not policy.due(self.log.size(), self.log.count()):
            return False
        self.log.truncate()
        return True

    def check(self) -> None:
        """Every embedding of live rows must have one dimension, and every live
        chunk a live parent."""
        dims = self.live().where(F.size("embedding") > 0).select(F.size("embedding").alias("d")).distinct().limit(2).count()
        lost = self.chunks().where(~F.col("deleted")).join(self.live().select(F.col("id").alias("parent_id")), "parent_id", "left_anti").limit(1).count()
        if dims > 1 or lost:
            raise StorageError("vectors of several dimensions" if dims > 1 else "chunks without a record")
        version = self.records_table.version
        if self.keywords.covers(version):
            n = self.live().where(F.size(tokens(F.coalesce("text", F.lit("")))) > 0).count()
            if n != (found := self.keywords.state()["n"]):
                raise StorageError(f"the keyword index has {found} documents, the records {n}")

    # --- search ---

    def search(self, request: SearchRequest | dict, prefilter: bool = False) -> DataFrame:
        """Hits of one request, best first."""
        if isinstance(request, dict):
            request = SearchRequest.from_dict(request)
        q = validate(request, self.config.default_k, self.config.default_ef)
        embedding = q.embedding
        if embedding is None and q.mode != "bm25_only":
            embedding = embed_single(self.embedder, q.text)
        queries = self.spark.createDataFrame([(0, q.text, embedding)], "qid long, text string, embedding array<float>")
        found = self.search_batch(queries, k=q.k, alpha=q.alpha, ef=q.search_ef, filter=q.filter, prefilter=prefilter)
        return found.drop("qid").orderBy("rank")

    def search_batch(self, queries: DataFrame, *, ef: int | None = None, **options) -> DataFrame:
        """Hits of a frame of queries (qid, text, embedding). The keyword index
        serves all but prefiltered searches. Where there is a vector index, a
        search reads the share of its cells that ``ef`` says."""
        chunks = self.chunks() if self.chunking and self.chunks_table.version is not None else None
        version = self.records_table.version
        whole = not (options.get("prefilter") and options.get("filter") is not None)
        if whole and version is not None and self.keywords.covers(version):
            options["index"] = self.keywords.index()
        if whole and chunks is None and version is not None and self.vectors.covers(version):
            options["nearest"] = lambda q, k: self.vectors.nearest(q, k, max(ef or self.config.default_ef, k))
        found = hybrid.search(self.live(), queries, chunks=chunks, **options)
        numbers = self.live().select("id", "index_id")
        return found.join(numbers, "id", "left")

    def search_json(self, request: dict) -> dict:
        return {"results": [{k: v for k, v in r.items() if k != "rank"} for r in sorted(to_json_rows(self.search(request)), key=lambda r: r["rank"])]}

    def with_config(self, **changes) -> SearchEngine:
        self.config = replace(self.config, **changes)
        return self
