"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, image_copies, importance, line_quality, mixing, parity_join, piece_codec, sharding, token_counts, url_filter
from ._shared import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_importance_resampling": importance.query,
        "op2_sharding": sharding.query,
        "op3_image_copies": image_copies.query,
        "op4_token_counts": lambda s, d: token_counts.query(table(s, d, "documents")),
        "op5_jaccard_join": lambda s, d: parity_join.query(table(s, d, "documents")),
        "op6_chat_formatting": lambda s, d: chat_format.query(table(s, d, "conversations")),
        "op7_quality_rules": lambda s, d: line_quality.query(table(s, d, "documents")),
        "op8_mixing": lambda s, d: mixing.query(table(s, d, "documents")),
        "op9_piece_codec": lambda s, d: piece_codec.query(table(s, d, "documents")),
        "op10_url_filters": lambda s, d: url_filter.query(table(s, d, "pages")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_sharding": sharding.ORACLE,
        "op5_jaccard_join": parity_join.ORACLE,
        "op6_chat_formatting": chat_format.ORACLE,
        "op7_quality_rules": line_quality.ORACLE,
        "op8_mixing": mixing.ORACLE,
        "op10_url_filters": url_filter.ORACLE,
    }
