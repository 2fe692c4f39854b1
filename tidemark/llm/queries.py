"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import pipeline
from tidemark.llm.chat import OP6_SQL, op6_chat
from tidemark.llm.codes import OP12_SQL, op12_codes
from tidemark.llm.languages import op8_language
from tidemark.llm.leaks import OP4_SQL, op4_decontaminate
from tidemark.llm.lines import OP1_SQL, op1_line_dedup
from tidemark.llm.pieces import op2_sentencepiece
from tidemark.llm.private import op9_private
from tidemark.llm.quality import OP10_SQL, op10_quality
from tidemark.llm.repeats import op7_repeats
from tidemark.llm.shards import OP11_SQL, op11_shards
from tidemark.llm.simhash import op3_simhash
from tidemark.llm.tokens import op5_token_ids
from tidemark.llm.whitening import op13_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_simhash": op3_simhash,
        "op4_decontaminate": op4_decontaminate,
        "op5_token_ids": op5_token_ids,
        "op6_chat": op6_chat,
        "op7_repeats": op7_repeats,
        "op8_language": op8_language,
        "op9_private": op9_private,
        "op10_quality": op10_quality,
        "op11_shards": op11_shards,
        "op12_codes": op12_codes,
        "op13_whitening": op13_whitening,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL can express."""
    return {"op1_line_dedup": OP1_SQL, "op4_decontaminate": OP4_SQL, "op6_chat": OP6_SQL, "op10_quality": OP10_SQL, "op11_shards": OP11_SQL, "op12_codes": OP12_SQL}
