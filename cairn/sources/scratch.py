"""The folder all executors share, for what a plan writes and reads again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
_CLEANED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder, as ``spark.checkpoint.dir`` names it.

    Only where the cluster names none (local tests) is an own folder used.
    A session's files are removed when the driver's Python ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not _OWN_DIR:
            _OWN_DIR.append(tempfile.mkdtemp(prefix="cairn-"))
        root = f"file://{_OWN_DIR[0]}"
    base = f"{root.rstrip('/')}/cairn-{spark.sparkContext.applicationId}"
    if base not in _CLEANED:
        _CLEANED.add(base)
        atexit.register(_remove, spark, base)
    return base


def _remove(spark: SparkSession, uri: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be gone already
        return


def fresh(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, and
    survives the loss of any executor."""
    path = fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer parts than the cluster has cores, such as one small
    file, dealt out to all of them; any other as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
