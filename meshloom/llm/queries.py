"""The queries of the text operators, by name, and SQL for those that DuckDB can run on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import urlfilter
from .chat import op4_chat_formatting
from .decontaminate import op8_decontamination
from .embedding import op6_embedding_near_dedup
from .packing import op5_packing
from .pii import op1_pii
from .simhash import op10_simhash_near_dedup
from .substring import op3_substring_dedup
from .token_files import op9_token_files
from .toxicity import op2_toxicity
from .urlfilter import op7_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_packing": op5_packing,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_decontamination": op8_decontamination,
    "op9_token_files": op9_token_files,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}

#: The others have none: SQL can't express their results, or is too slow for it on whole tables. tests/llm holds them
#: against brute force.
ORACLE_SQL: dict[str, str] = {"op7_url_filter": urlfilter.ORACLE}
