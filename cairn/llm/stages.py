"""The operators as stages over a table of documents.

Each takes (spark, docs, sf_dir) and returns a DataFrame; all but packing keep
the columns of ``docs``. A stage works on all rows it is given.

Defined cases, in all stages: null ids, texts and sources are values like
others; rows that repeat are documents of their own, except where near-dedup
leaves one of them; texts of any length are taken whole; ties go as the operator
says; an empty table gives an empty one. Columns travel under names of our own,
so extra ones may have any name, dots, or a name twice (the first is meant).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, line_dedup, mixing, packing, simhash
from .base import ARROW_ROWS, Neutral

#: A document is rejected if its language is unknown, or if its share of n-grams
#: typical of that language is less than this part of the training level.
MIN_SHARE = 0.5


def _arrow(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a known language: no letters (so null and blank
    texts too), or fewer n-grams typical of any language than MIN_SHARE asks
    for. The model learns from the rows with a language, as the query does."""
    _arrow(spark)
    n = Neutral(docs)
    train = n.df.where(~langid.is_held_out(n["doc_id"])).select(F.col(n["text"]).alias("text"), F.col(n["lang"]).alias("lang"))
    return n.restore(langid.keep_known(n.df, langid.fit(train), min_share=MIN_SHARE, text_col=n["text"]))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines found in ten documents or more, but for the first occurrence;
    documents that had words and lose them all go. ``n_chars`` follows. A null
    text becomes an empty one."""
    _arrow(spark)
    n = Neutral(docs)
    blank = lambda c: F.length(F.translate(F.coalesce(F.col(c), F.lit("")), " \t\n\x0b\f\r", "")) == 0
    carry = (*(c for c in n.cols if c != n["text"]), "blank_")
    found = line_dedup.drop_repeated_lines(n.df.withColumn("blank_", blank(n["text"])), id_col=n["doc_id"], text_col=n["text"], keep_first=True, carry=carry)
    kept = found.where(~blank("kept") | F.col("blank_")).withColumn(n["text"], F.col("kept"))
    if "n_chars" in n.names:
        kept = kept.withColumn(n["n_chars"], F.length("kept").cast(docs.schema["n_chars"].dataType))
    return n.restore(kept)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, by fingerprints of
    three seeds: the smallest by id (nulls last), then by the text's hash; of
    rows equal in both, any one."""
    _arrow(spark)
    n = Neutral(docs)
    return n.restore(simhash.keep_one_of_each(n.df, id_col=n["doc_id"], text_col=n["text"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come near their targets;
    rows are in the order of training."""
    _arrow(spark)
    n = Neutral(docs)
    return n.restore(mixing.mixed(n.df, id_col=n["doc_id"], text_col=n["text"], source_col=n["source"]))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: a row for each piece of a document with its bin.
    Copies of a text, of which mixing makes some, never share one."""
    _arrow(spark)
    n = Neutral(docs)
    return packing.pack_documents(n.df, id_col=n["doc_id"], text_col=n["text"], source_col=n["source"]).withColumnRenamed(n["doc_id"], "doc_id")
