"""Queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tamarack.llm import fingerprints, importance, license_scans, line_dedup, mixing, ngram_join, packing, prefix_trie, quality_classifier, quality_rules, secret_scans, substring_dedup, toxicity
from tamarack.llm.common import ship


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: _shipped(f)
    for f in (
        fingerprints.op1_fingerprints,
        line_dedup.op2_line_dedup,
        mixing.op3_mixing,
        toxicity.op4_toxicity,
        secret_scans.op5_secret_scans,
        packing.op6_packing,
        substring_dedup.op7_substring_dedup,
        ngram_join.op8_ngram_join,
        quality_rules.op9_quality_rules,
        license_scans.op10_license_scans,
        quality_classifier.op11_quality_classifier,
        importance.op12_importance,
        prefix_trie.op13_prefix_trie,
    )
}

ORACLES = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op7_substring_dedup": substring_dedup.ORACLE,
    "op8_ngram_join": ngram_join.ORACLE,
    "op12_importance": importance.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
