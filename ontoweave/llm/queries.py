"""Queries of this subpackage, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op3_balanced_postings
from .chat import OP4_SQL, op4_chat_format
from .collocations import OP13_SQL, op13_collocations
from .kneser_ney import op7_quality_perplexity
from .mixing import OP8_SQL, op8_source_mixing
from .packing import op10_best_fit_packing
from .sharding import op2_jump_sharding
from .simhash import op6_simhash
from .token_counts import op5_token_counts
from .topk import OP1_SQL, op1_threshold_topk
from .turn_repair import op12_turn_repair
from .url_reputation import OP9_SQL, op9_url_reputation
from .warc import OP11_SQL, op11_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_threshold_topk, op2_jump_sharding, op3_balanced_postings, op4_chat_format, op5_token_counts, op6_simhash,
        op7_quality_perplexity, op8_source_mixing, op9_url_reputation, op10_best_fit_packing,
        op11_warc, op12_turn_repair, op13_collocations,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_threshold_topk": OP1_SQL, "op4_chat_format": OP4_SQL, "op8_source_mixing": OP8_SQL, "op9_url_reputation": OP9_SQL,
    "op11_warc": OP11_SQL, "op13_collocations": OP13_SQL,
}
