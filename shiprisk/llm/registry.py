"""Queries of the training-data operators: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shiprisk.llm import (bpe, langid, mixing, packing, prefixtrie, quality, secrets, simhash, spherical, tokenfiles,
                          toxicity, urlfilter, whitening)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": toxicity.query,
        "op2_bpe": bpe.query,
        "op3_language_id": langid.query,
        "op4_secret_scans": secrets.query,
        "op5_simhash": simhash.query,
        "op6_url_filters": urlfilter.query,
        "op7_token_files": tokenfiles.query,
        "op8_quality_rules": quality.query,
        "op9_embeddings": spherical.query,
        "op10_mixing": mixing.query,
        "op11_prefix_trie": prefixtrie.query,
        "op12_whitening": whitening.query,
        "op13_packing": packing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_embeddings": spherical.SQL, "op10_mixing": mixing.SQL, "op11_prefix_trie": prefixtrie.SQL}
