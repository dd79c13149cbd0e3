"""The registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, language_id, mixing, near_dedup, pseudonyms, quality, secrets, sharding, substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_language_id": language_id.op2_language_id,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_pseudonyms": pseudonyms.op4_pseudonyms,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_minimax_shards": sharding.op7_minimax_shards,
    "op8_curriculum_mix": mixing.op8_curriculum_mix,
    "op9_quality": quality.op9_quality,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}
SQL: dict[str, str] = {
    "op1_near_dedup": near_dedup.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op5_secret_scan": secrets.SQL,
    "op8_curriculum_mix": mixing.SQL,
    "op10_substring_dedup": substring_dedup.SQL,
}
