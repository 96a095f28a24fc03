"""Queries of this subpackage for __spark_entry__.py, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .alignment import op13_alignment
from .chat import OP7_SQL, op7_chat
from .counts import op3_token_counts
from .decontaminate import op9_decontamination
from .language import op12_language
from .neardup import OP2_SQL, op2_near_duplicates
from .packing import op10_packing
from .pii import op8_pii
from .quality import op6_quality
from .secrets import op4_secrets
from .token_output import op1_token_output
from .vectors import OP5_SQL, op5_vectors
from .whitening import op11_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_output": op1_token_output,
        "op2_near_duplicates": op2_near_duplicates,
        "op3_token_counts": op3_token_counts,
        "op4_secrets": op4_secrets,
        "op5_vectors": op5_vectors,
        "op6_quality": op6_quality,
        "op7_chat": op7_chat,
        "op8_pii": op8_pii,
        "op9_decontamination": op9_decontamination,
        "op10_packing": op10_packing,
        "op11_whitening": op11_whitening,
        "op12_language": op12_language,
        "op13_alignment": op13_alignment,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    out = {
        "op2_near_duplicates": OP2_SQL,
        "op5_vectors": OP5_SQL,
        "op7_chat": OP7_SQL,
    }
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
