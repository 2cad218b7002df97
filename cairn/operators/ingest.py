"""Ingestion: validation, the pending table, and the set-based sync."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, build_text, content_hash, normal_tags, parse_date, trim
from ..sources.scratch import stored
from .embedding import Embedder, embed_frame


def prepare_batch(docs: DataFrame, order_col: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(accepted, errors) of a batch: rows with a blank id, or a date that is
    none, are errors, named by their place. Accepted rows have the normalised
    record, content_hash and embed_text."""
    rows = docs.select(
        F.col(order_col).alias("ord"), trim(F.coalesce("id", F.lit(""))).alias("id"), "title", "body", "source",
        parse_date(F.col("updated_at")).alias("updated_at"), (F.col("updated_at").isNotNull() & parse_date(F.col("updated_at")).isNull()).alias("bad_date"),
        normal_tags(F.col("tags")).alias("tags"), blank_to_null(F.col("text")).alias("embed_text"),
    )
    blank = F.col("id") == ""
    named = F.when(blank, F.format_string("[index %d]", F.col("ord"))).otherwise(F.col("id"))
    errors = rows.where(blank | F.col("bad_date")).select("ord", named.alias("id"), F.when(blank, "id is required").otherwise("updated_at is not a date").alias("error"))
    hashed = content_hash(F.col("title"), F.col("body"), F.col("embed_text"), F.col("tags"), F.col("updated_at"))
    good = rows.where(~blank & ~F.col("bad_date"))
    return good.select("ord", "id", F.struct("id", "title", "body", "source", "updated_at", "tags").alias("record"), hashed.alias("content_hash"), "embed_text"), errors


def last_wins(accepted: DataFrame) -> DataFrame:
    """One row for each id: the last of the batch."""
    last = Window.partitionBy("id").orderBy(F.col("ord").desc())
    return accepted.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def upsert_pending(pending: DataFrame, batch: DataFrame) -> DataFrame:
    """Pending rows with those of the batch in place of the same ids."""
    new = last_wins(batch).select("id", "record", "content_hash", "embed_text")
    return pending.join(new.select("id"), "id", "left_anti").select(*new.columns).unionByName(new)


def classify(pending: DataFrame, live: DataFrame) -> DataFrame:
    """Pending rows with the live row ``old`` of their id and ``action``:
    clear (unchanged and indexed), reindex (unchanged, not indexed), no_text
    (nothing to embed), embed."""
    old = live.select("id", F.struct(*live.columns).alias("old"))
    text = F.coalesce(blank_to_null(F.col("embed_text")), build_text(F.col("record.title"), F.col("record.body")))
    both = pending.join(old, "id", "left").withColumn("embed_input", text)
    same = F.coalesce((F.col("old.content_hash") == F.col("content_hash")) & (F.size("old.embedding") > 0), F.lit(False))
    action = F.when(same & F.coalesce("old.indexed", F.lit(True)), "clear").when(same, "reindex").when(F.col("embed_input").isNull(), "no_text").otherwise("embed")
    return both.withColumn("action", action)


def numbered(ids: DataFrame) -> DataFrame:
    """id and place from 0 in the order of ids: a range sort, then each part
    counts on from those before it. No task sees all ids."""
    at = F.monotonically_increasing_id()
    parts = stored(ids.orderBy("id").select("id", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("own")), "places")
    ends = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(ends), F.lit(0)).alias("before"))
    return parts.join(F.broadcast(before), "part").select("id", (F.col("before") + F.col("own")).alias("place"))


def sync(pending: DataFrame, records: DataFrame, embedder: Embedder, one_by_one: bool = False) -> tuple[DataFrame, DataFrame]:
    """(outcome, new rows). ``outcome`` has each pending id with its result
    (indexed, skipped or failed) and error. New rows take numbers after the
    greatest, in the order of ids (failed ones leave gaps); the caller marks the old rows of the same
    ids deleted. Rows are classified and embedded once, into the shared folder."""
    live = records.where(~F.col("deleted"))
    asked = classify(pending, live).withColumn("embed_input", F.when(F.col("action") == "embed", F.col("embed_input")))
    old = F.when(F.col("action") == "reindex", F.col("old.embedding"))
    done = embed_frame(asked.withColumn("kept_vector", old).drop("old"), embedder, text_col="embed_input", one_by_one=one_by_one)
    empty = F.array().cast("array<float>")
    vector = F.when(F.col("action") == "embed", F.col("embedding")).otherwise(F.coalesce("kept_vector", empty))
    ok = F.col("embedding").isNotNull() & F.col("error").isNull()
    result = F.when(~ok, "failed").when(F.col("action").isin("clear", "reindex"), "skipped").otherwise("indexed")
    outcome = stored(done.withColumn("embedding", vector).drop("kept_vector", "embed_input").withColumn("ok", ok).withColumn("result", result), "outcome")
    top = records.agg(F.coalesce(F.max("index_id"), F.lit(-1)).alias("top"))
    places = numbered(outcome.where("action <> 'clear'").select("id"))
    new = outcome.where(F.col("ok") & (F.col("action") != "clear")).join(places, "id").crossJoin(F.broadcast(top))
    new = new.select("record.*", "embedding", F.lit(False).alias("deleted"), "content_hash", F.lit(True).alias("indexed"), "embed_text", (F.col("top") + 1 + F.col("place")).alias("index_id"))
    return outcome, new


def replace_rows(records: DataFrame, new: DataFrame) -> DataFrame:
    """Records with live rows of the new ids marked deleted, and the new rows."""
    changed = new.select("id", F.lit(True).alias("_new"))
    old = records.join(changed, "id", "left").withColumn("deleted", F.col("deleted") | F.coalesce("_new", F.lit(False))).drop("_new")
    return old.select(*records.columns).unionByName(new.select(*records.columns))


def progress(outcome: DataFrame) -> DataFrame:
    """One row: total, indexed, skipped, failed."""
    count = lambda r: F.count(F.when(F.col("result") == r, 1)).alias(r)
    return outcome.agg(F.count("*").alias("total"), count("indexed"), count("skipped"), count("failed"))


def fill_embeddings(records: DataFrame, index: DataFrame) -> DataFrame:
    """Records without a vector get that of ``index`` (id, embedding)."""
    known = index.select("id", F.col("embedding").alias("_known"))
    vector = F.when(F.size("embedding") > 0, F.col("embedding")).otherwise(F.coalesce("_known", F.array().cast("array<float>")))
    return records.join(known, "id", "left").withColumn("embedding", vector).select(*records.columns)
