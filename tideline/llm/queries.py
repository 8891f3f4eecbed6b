"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, hard_negatives, packing, pii, quality, sharding, simhash, substring_dedup, toxicity, url_filter, whitening, window_packing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_suffix_dedup": substring_dedup.op2_suffix_dedup,
    "op3_pii": pii.op3_pii,
    "op4_url_rules": url_filter.op4_url_rules,
    "op5_quality": quality.op5_quality,
    "op6_simhash": simhash.op6_simhash,
    "op7_multiprobe": ann.op7_multiprobe,
    "op8_feistel_shards": sharding.op8_feistel_shards,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_best_fit": packing.op10_best_fit,
    "op11_window_packing": window_packing.op11_window_packing,
    "op12_whitening": whitening.op12_whitening,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLES: dict[str, str] = {
    "op3_pii": pii.ORACLE_SQL,
    "op2_suffix_dedup": substring_dedup.ORACLE_SQL,
    "op9_decontaminate": decontaminate.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
