"""Browsing a lexicon: its most probable names, prefix search, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from .lexicon import Lexicon

# Fixed values.
HEAD, MOST, USUAL = 5000, 100, 50


def list_names(lexicon: Lexicon, kind: str, limit: int = HEAD) -> DataFrame:
    """The head of a lexicon: by probability, then by name in binary order."""
    names = lexicon.names.filter(F.col("kind") == kind)
    return names.orderBy(F.desc("prob"), "name").limit(limit).select("kind", "name", "norm", "prob")


def search(lexicon: Lexicon, kind: str, prefix: str = "", limit: int = USUAL) -> DataFrame:
    """One row: the names of the head that start with a prefix. ``limit`` is kept within 1 and 100."""
    most = min(max(limit, 1), MOST)
    text = F.lit(prefix.strip())
    head = list_names(lexicon, kind).filter(F.startswith("norm", normalize(text)))
    found = head.agg(F.sort_array(F.collect_list(F.struct((-F.col("prob")).alias("p"), "name"))).alias("all"))  # HEAD rows at most
    names = F.slice(F.col("all.name"), 1, most)
    return found.select(
        F.nullif(text, F.lit("")).alias("prefix"),
        names.alias("names"),
        F.size(names).alias("count"),
        F.size("all").alias("total"),
        (F.size("all") > F.size(names)).alias("truncated"),
    )


def stats(lexicon: Lexicon) -> DataFrame:
    """Per kind: entries, probability mass, variants and licenses."""
    names = lexicon.names.groupBy("kind").agg(
        F.count(F.lit(1)).alias("entries"), (F.floor(F.sum("prob") * 1e6 + 0.5) / 1e6).alias("probability_mass")
    )
    variants = lexicon.variants.groupBy("kind").agg(F.count(F.lit(1)).alias("variants"))
    licenses: Column = F.from_json(F.max(F.when(F.col("key") == "licenses", F.col("value"))), "array<string>")
    meta = lexicon.meta.groupBy("kind").agg(licenses.alias("licenses"))
    return (
        names.join(variants, "kind", "left")
        .join(meta, "kind", "left")
        .select(
            "kind",
            "entries",
            "probability_mass",
            F.coalesce("variants", F.lit(0)).alias("variants"),
            F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"),
        )
    )
