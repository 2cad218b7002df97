"""Corpus preparation: documents in, packed training sequences out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import stages
from cairn.llm.base import stored, table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", stages.identify_language),
    ("line_dedup", stages.dedup_lines),
    ("simhash_near_dedup", stages.dedup_near),
    ("source_mixing", stages.mix_sources),
    ("best_fit_packing", stages.pack_sequences),
]

#: Language models, fingerprints and packing aren't expressible in SQL; the
#: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
