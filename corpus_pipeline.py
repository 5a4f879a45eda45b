"""Corpus pipeline: quality rules, near-duplicates, secrets, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shiprisk.llm import bpe, mixing, quality, secrets, simhash
from shiprisk.llm.common import materialise, table

STAGES = [
    ("quality rules", quality.stage),
    ("simhash near-dedup", simhash.stage),
    ("secret scans", secrets.stage),
    ("mixing to target weights", mixing.stage),
    ("bpe encoding and decoding", bpe.stage),
]

#: The robust estimates, the fingerprints and the merges have no SQL form; tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
