"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vecloom.llm.decontaminate import OP3_SQL, op3_decontaminate
from vecloom.llm.licenses import OP6_SQL, op6_license_scan
from vecloom.llm.mixing import OP5_SQL, op5_mix_sources
from vecloom.llm.near_dup import OP10_SQL, op10_near_dup
from vecloom.llm.quality import OP9_SQL, op9_quality
from vecloom.llm.secrets import OP2_SQL, op2_secret_scan
from vecloom.llm.sharding import op8_shard
from vecloom.llm.token_count import op7_token_counts
from vecloom.llm.toxicity import op4_toxicity
from vecloom.llm.url_filter import OP1_SQL, op1_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_secret_scan": op2_secret_scan,
        "op3_decontaminate": op3_decontaminate,
        "op4_toxicity": op4_toxicity,
        "op5_mix_sources": op5_mix_sources,
        "op6_license_scan": op6_license_scan,
        "op7_token_counts": op7_token_counts,
        "op8_shard": op8_shard,
        "op9_quality": op9_quality,
        "op10_near_dup": op10_near_dup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": OP1_SQL,
        "op2_secret_scan": OP2_SQL,
        "op3_decontaminate": OP3_SQL,
        "op5_mix_sources": OP5_SQL,
        "op6_license_scan": OP6_SQL,
        "op9_quality": OP9_SQL,
        "op10_near_dup": OP10_SQL,
    }
