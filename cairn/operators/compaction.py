"""Tombstones: how many there are, and when they go."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadRequest


def tombstone_stats(records: DataFrame) -> DataFrame:
    """One row: total, tombstones, ratio (0 for an empty table)."""
    gone = F.count(F.when(F.coalesce("deleted", F.lit(False)), 1))
    return records.agg(F.count("*").alias("total"), gone.alias("tombstones")).withColumn("ratio", F.when(F.col("total") > 0, F.col("tombstones") / F.col("total")).otherwise(0.0))


@dataclass(frozen=True)
class TombstonePolicy:
    max_count: int | None = None
    max_ratio: float | None = None

    def __post_init__(self):
        if self.max_count is not None and self.max_ratio is not None:
            raise BadRequest("a tombstone policy has a count or a ratio, not both")
        if self.max_ratio is not None and (math.isnan(self.max_ratio) or not 0 <= self.max_ratio <= 1):
            raise BadRequest("the ratio of tombstones must lie in 0 to 1")

    def due(self, total: int, tombstones: int) -> bool:
        if not tombstones:
            return False
        if self.max_count is not None:
            return tombstones >= self.max_count
        return self.max_ratio is not None and tombstones / total >= self.max_ratio


def compact(rows: DataFrame) -> DataFrame:
    return rows.where(~F.coalesce("deleted", F.lit(False)))
