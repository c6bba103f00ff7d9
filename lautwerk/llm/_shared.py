"""What the operators of this subpackage share: joins of checked sizes and word rules; written tables are the library's."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop, durable, release, shared_dir  # noqa: F401

#: Separators of words: space and the ASCII controls tab to carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"
SEPARATOR_CHARS = " \t\n\x0b\x0c\r"


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """A written table with a broadcast hint if it has at most ``rows`` rows, else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Ids up to which their table is broadcast to pick rows; beyond it the join shuffles.
BROADCAST_IDS = 2_000_000
#: Keys that ``join_spread`` broadcasts at most.
HOT_KEYS = 10_000


def give_back() -> None:
    """Freed memory that this process still holds goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``step`` for ``mapInArrow``: workers outlive their tasks, and so give back what a task freed when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], weight: str, rows: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row per key and in ``weight`` the rows of ``left`` with that key.

    Keys of more than a ``HOT_KEYS``-th of all ``rows`` of ``left``, so fewer than ``HOT_KEYS``, are broadcast; none of
    the others can fill a task. Keys are not null.
    """
    hot = F.col(weight) > max(1000, -(-rows // HOT_KEYS))
    many, few = F.broadcast(right.filter(hot).drop(weight)), right.filter(~hot).drop(weight)
    rest = left.join(F.broadcast(right.filter(hot).select(*keys)), keys, "left_anti")
    return left.join(many, keys).unionByName(rest.join(few, keys, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order, as an array; empty for null, empty and blank texts."""
    stripped = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATOR_CHARS))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, SEPARATORS))


def spread_key(*parts: Column) -> Column:
    """52 bits of MD5 over the parts, as a long: uniform, and the same in any SQL engine."""
    joined = F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts))
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long")


KEY_BITS = 52
