"""Helpers shared by the training-data operators: table access, neutral names,
row numbers and skew-proof joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import fresh, shared_dir, spread, stored

__all__ = ["ARROW_ROWS", "HOT", "WORD", "Neutral", "coded_words", "fresh", "input_bytes", "join_by_key", "join_pairs", "numbered", "occurrences", "shared_dir", "sized", "spread", "stored", "table", "text_bytes", "valid_text", "word_count"]

#: Words are maximal runs of anything but space and U+0009 to U+000D. For
#: UTF-8 bytes this is exactly what ``bytes.split()`` yields.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of one Arrow batch that goes to Python. Texts may be long, so batches
#: are kept short; a batch of the longest documents still fits a worker.
ARROW_ROWS = 500

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; also sets the Arrow batch size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def text_bytes(col: str | Column) -> Column:
    """UTF-8 bytes of a text column, empty for null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit("")).cast("binary")


def valid_text(col: str | Column) -> Column:
    """A text column that Python can read: bytes that are no UTF-8 become U+FFFD."""
    return F.make_valid_utf8(F.col(col) if isinstance(col, str) else col)


class Neutral:
    """A frame's columns under names of our own, so that none clashes, needs
    quoting or occurs twice: ``df`` has them, ``restore`` gives them back."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.cols = [f"col{i}_" for i in range(len(self.names))]
        self.df = docs.toDF(*self.cols)

    def __getitem__(self, name: str) -> str:
        """What a column is called here; of equal names the first."""
        return self.cols[self.names.index(name)]

    def restore(self, out: DataFrame) -> DataFrame:
        return out.select(*self.cols).toDF(*self.names)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``row``, a number of its own for each row. Numbers hold only
    for what is then stored: another run may number otherwise."""
    return df.withColumn("row", F.monotonically_increasing_id())


def occurrences(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (numbered and stored) with ``occ``: equal rows of ``by`` are
    counted 0, 1, ... in any order. Rows count within the part that their number
    names, and parts add what is before them, so no task sees a whole group. An
    equal hash of two groups only leaves gaps in their counts."""
    keyed = rows.withColumn("__g", F.xxhash64(*by)).withColumn("__p", F.shiftright("row", 33))
    parts = stored(keyed.groupBy("__g", "__p").agg(F.count("*").alias("__n")), "parts")
    many = parts.groupBy("__g").agg(F.sum("__n").alias("__m")).where(F.col("__m") > 1).select("__g")
    before = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.join(many, "__g", "left_semi").select("__g", "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    if starts.isEmpty():
        return keyed.drop("__g", "__p").withColumn("occ", F.lit(0).cast("long"))
    found = keyed.join(starts, ["__g", "__p"], "left")
    own = F.row_number().over(Window.partitionBy("__g", "__p").orderBy("row"))
    return found.withColumn("occ", F.coalesce("__before", F.lit(0)).cast("long") + own - 1).drop("__g", "__p", "__before")


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the files that ``df`` reads, as its plan knows them; None if any
    of its sources doesn't say."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(sizes) if sizes and max(sizes) < 1 << 62 else None


def word_count(col: str | Column) -> Column:
    """Number of words in a text column; 0 for null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


#: Keys above one HOT-th of all rows are joined by broadcast: there are fewer
#: than HOT of them, whatever the data.
HOT = 1000


def join_by_key(rows: DataFrame, lookup: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """Join (inner or left) of ``rows`` to ``lookup``, which has one row for each key.

    ``lookup[count]`` is the number of rows of the key and ``total`` that of
    all. Hot keys (more than ``total / HOT`` rows, so fewer than ``HOT`` keys)
    are broadcast and their rows never shuffle; the rest join by shuffle in
    evenly sized groups. Nulls match nulls; ``count`` is not returned.
    """
    bound = max(1, total // HOT)
    hot = F.broadcast(lookup.where(F.col(count) > bound).drop(count).withColumnRenamed(key, "__k"))
    cold = lookup.where(F.col(count) <= bound).drop(count).withColumnRenamed(key, "__k")
    hot_keys = F.broadcast(lookup.where(F.col(count) > bound).select(F.col(key).alias("__h")))
    a = rows.join(hot, F.col(key).eqNullSafe(F.col("__k"))).drop("__k")
    rest = rows.join(hot_keys, F.col(key).eqNullSafe(F.col("__h")), "left_anti")
    b = rest.join(cold.hint("shuffle_merge"), F.col(key).eqNullSafe(F.col("__k")), how).drop("__k")
    return a.unionByName(b)


def join_pairs(rows: DataFrame, lookup: DataFrame, key: str, counts: DataFrame, total: int) -> DataFrame:
    """Inner join where both sides have many rows of a key; ``counts`` (key, n)
    says how many ``rows`` has. Keys with more than ``total / HOT`` rows are
    spread over as many salts as they have such portions, and ``lookup`` is
    repeated for each salt: no key's rows meet in one task."""
    bound = max(1, total // HOT)
    hot = F.broadcast(counts.where(F.col("n") > bound).select(F.col(key).alias("__k"), F.ceil(F.col("n") / bound).cast("int").alias("__salts")))
    a = rows.join(hot, F.col(key) == F.col("__k"), "left").drop("__k")
    a = a.withColumn("__s", F.pmod(F.xxhash64(*rows.columns), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    b = lookup.join(hot, F.col(key) == F.col("__k"), "left").drop("__k")
    b = b.withColumn("__s", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return a.join(b, [key, "__s"]).drop("__s")


def coded_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words of an array of texts, each distinct one named once.

    Returns the offsets of each text's words, the words' codes and the distinct
    strings. White space at an end of a text gives an empty string.
    """
    lists = pc.ascii_split_whitespace(text)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values[offsets[0] : offsets[-1]].dictionary_encode()
    return offsets - offsets[0], words.indices.to_numpy(), words.dictionary.to_pylist()


def sized(batches: Iterator[pa.RecordBatch], col: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches joined until column ``col`` holds ``limit`` bytes, about."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.column(col).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
