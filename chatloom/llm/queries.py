"""The queries of the corpus operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, fingerprint, kd_clustering, language_id, license_scan, merkle, mixing, quality_classifier, quality_rules, simhash, suffix_dedup, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_quality_classifier": quality_classifier.op2_quality_classifier,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_byte_bpe": byte_bpe.op4_byte_bpe,
        "op5_license_scan": license_scan.op5_license_scan,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
        "op10_syncmer_fingerprints": fingerprint.op10_syncmer_fingerprints,
        "op11_kd_clustering": kd_clustering.op11_kd_clustering,
        "op12_merkle": merkle.op12_merkle,
        "op13_language_id": language_id.op13_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.mix_sql(), "op3_quality_rules": quality_rules.op3_sql(), "op7_url_filter": url_filter.op7_sql(), "op8_suffix_dedup": suffix_dedup.op8_sql(), "op11_kd_clustering": kd_clustering.op11_sql(), "op12_merkle": merkle.op12_sql()}
