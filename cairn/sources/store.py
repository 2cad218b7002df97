"""Versioned Parquet tables, and JSON-lines import and export.

A table is a folder of versions. A new version is written whole beside the
others, and a pointer file names the current one: readers are never blocked,
and no path is overwritten while it is read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import decode_tags, normal_tags, parse_date
from ..schemas import CHUNK, PENDING, STORED


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _pointers(self) -> list[str]:
        fs, p = _fs(self.spark, f"{self.path}/_current")
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p))

    @property
    def version(self) -> str | None:
        """Name of the current version; pointers are names in order."""
        found = self._pointers()
        return found[-1].split(".", 1)[1] if found else None

    @property
    def applied(self) -> int:
        """The last batch of the log that the current version holds; -1: none."""
        v = self.version
        return int(v.rpartition("-l")[2]) if v and "-l" in v else -1

    def read(self) -> DataFrame:
        v = self.version
        if v is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{v}")

    def write(self, df: DataFrame, partition_by: str | None = None, applied: int | None = None) -> str:
        """A new version; it is current once its pointer exists. ``applied`` is
        the last batch of the log that it holds."""
        before = self._pointers()
        n = int(before[-1].split(".", 1)[0]) + 1 if before else 0
        applied = self.applied if applied is None else applied
        name = f"v{n}-{uuid.uuid4().hex[:8]}" + (f"-l{applied}" if applied >= 0 else "")
        fitted = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        writer = fitted.write.mode("errorifexists")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.path}/{name}")
        fs, p = _fs(self.spark, f"{self.path}/_current/{n:012d}.{name}")
        fs.create(p, False).close()  # fails if another writer took the number
        return name

    def vacuum(self, keep: int = 1) -> None:
        """Delete all versions but the last ``keep``."""
        for pointer in self._pointers()[:-keep]:
            delete(self.spark, f"{self.path}/{pointer.split('.', 1)[1]}")
            delete(self.spark, f"{self.path}/_current/{pointer}")


# --- JSON lines -----------------------------------------------------------


def _raw(schema: T.StructType) -> T.StructType:
    """The schema as it stands in JSON: dates and tags as they come."""
    as_text = {"tags": T.StringType(), "updated_at": T.StringType()}
    return T.StructType([T.StructField(f.name, as_text.get(f.name, _raw(f.dataType) if isinstance(f.dataType, T.StructType) else f.dataType)) for f in schema.fields])


def _record_columns(prefix: str = "") -> list:
    c = lambda n: F.col(f"{prefix}{n}")
    return [c("id").alias("id"), c("title").alias("title"), c("body").alias("body"), c("source").alias("source"), parse_date(c("updated_at")).alias("updated_at"), decode_tags(c("tags")).alias("tags")]


def _lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parsed lines with ``_line``, which orders them by file, part of it and
    place; blank lines drop out."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("at"))
    text = spark.read.text(path).select("value", place.alias("_line")).where(F.trim("value") != "")
    parsed = F.from_json("value", _raw(schema), {"mode": "FAILFAST"})
    return text.select("_line", parsed.alias("r")).select("_line", "r.*")


def read_records_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Stored records, or bare ones (no embedding yet); no file, no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], STORED)
    r = _lines(spark, path, STORED)
    return r.select(*_record_columns(), F.coalesce("embedding", F.array().cast("array<float>")).alias("embedding"), F.coalesce("deleted", F.lit(False)).alias("deleted"), "content_hash", F.coalesce("indexed", F.lit(True)).alias("indexed"), "embed_text", "index_id")


def read_chunks_jsonl(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], CHUNK)
    return _lines(spark, path, CHUNK).drop("_line").withColumn("deleted", F.coalesce("deleted", F.lit(False)))


def read_pending_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Pending documents; of lines with the same id the last counts."""
    if not exists(spark, path):
        return spark.createDataFrame([], PENDING)
    r = _lines(spark, path, PENDING)
    last = Window.partitionBy("id").orderBy(F.col("_line").desc())
    r = r.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return r.select("id", F.struct(*_record_columns("record.")).alias("record"), "content_hash", "embed_text")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as JSON lines; null fields are left out, dates are YYYY-MM-DD."""
    df.write.mode(mode).option("ignoreNullFields", "true").option("dateFormat", "yyyy-MM-dd").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Records of a CSV file with header id, title, body, source, updated_at
    and tags (separated by | or ,)."""
    names = ["id", "title", "body", "source", "updated_at", "tags"]
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', schema=", ".join(f"{n} string" for n in names))
    tags = normal_tags(F.filter(F.split(F.coalesce("tags", F.lit("")), r"[|,]"), lambda t: F.trim(t) != ""))
    return raw.select("id", "title", "body", "source", F.try_to_date(F.substring("updated_at", 1, 10), "yyyy-MM-dd").alias("updated_at"), tags.alias("tags"))


def embed_csv(spark: SparkSession, path: str, out: str, embedder) -> None:
    """Records of a CSV file, embedded by title and body, as JSON lines."""
    from ..functions.text import build_text
    from ..operators.embedding import embed_frame

    rows = read_csv(spark, path).withColumn("_text", build_text(F.col("title"), F.col("body")))
    write_jsonl(embed_frame(rows, embedder, text_col="_text").drop("_text", "error").withColumn("embedding", F.coalesce("embedding", F.array().cast("array<float>"))), out)


def to_json_rows(df: DataFrame) -> list[dict]:
    """The rows of a bounded frame (a page of hits), as plain values without
    null fields."""
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true", "dateFormat": "yyyy-MM-dd"})).collect()]

