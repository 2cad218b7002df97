"""Streaming ingestion: files that land in a folder are batches of documents.

Each micro-batch is a batch insert and a sync. A batch that runs twice, after a
failure, finds its documents unchanged by their hashes, so each is indexed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import SearchEngine
from ..schemas import BATCH
from ..sources.scratch import stored


def read_landing(engine: SearchEngine, path: str) -> DataFrame:
    """Documents as JSON lines, as a stream."""
    return engine.spark.readStream.schema(BATCH).json(path)


def start(engine: SearchEngine, docs: DataFrame, checkpoint: str, available_now: bool = True):
    """A query that inserts and syncs each micro-batch."""

    def each(batch: DataFrame, number: int) -> None:
        engine.batch_insert(stored(batch.withColumn("ord", F.monotonically_increasing_id()), "landed"))
        engine.sync()

    writer = docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def pending_stream(docs: DataFrame, table, checkpoint: str):
    """A query that validates each micro-batch and upserts it into a pending
    table; run again, it takes up where it ended."""
    from ..operators.ingest import prepare_batch, upsert_pending

    def each(batch: DataFrame, number: int) -> None:
        accepted, _ = prepare_batch(batch)
        table.write(upsert_pending(table.read(), accepted))

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
