"""The lexicon: merging records, ranking names, their n-gram model, reading and writing.

Records have ``kind seq name count source origin variants``. ``seq`` orders the records of a kind, since the
display name depends on their order.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ngram
from ..functions.text import cologne_of, normalize, skeleton_of
from ..storage import drop, durable

# Attribution of the open sources.
LICENSES = (
    "Wikidata: CC0 1.0",
    "GND/DNB: CC0 1.0",
    "Onomaverse: CC BY 4.0 - Names data from Onomaverse (https://onomaverse.com/datasets)",
    "Municipal open data (Vornamen): see source attribution in meta",
)
UMLAUTS, SPECIAL, FANCY = "[äöüÄÖÜß]", "[ıİłŁøØđĐ]", "(?iu)[áàâéèêíìîóòôúùûý]"


@dataclass
class Lexicon:
    names: DataFrame  # kind id name norm skeleton cologne length prob log_prob plausibility rank_de origin sources
    variants: DataFrame  # kind surname_id name norm cologne source
    grams: DataFrame  # kind gram n count
    meta: DataFrame  # kind key value

    @cached_property
    def size(self) -> int:
        """Number of names and variants, counted once."""
        return self.names.count() + self.variants.count()

    def cache(self) -> Lexicon:
        for t in (self.names, self.variants, self.grams, self.meta):
            t.cache()
        return self

    def close(self) -> None:
        for t in (self.names, self.variants, self.grams, self.meta):
            t.unpersist()

    def write(self, path: str) -> str:
        for name in ("names", "variants", "grams", "meta"):
            getattr(self, name).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/{name}")
        return path

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Lexicon:
        """Opens a written lexicon; a missing one raises."""
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("names", "variants", "grams", "meta")))


def display_class(name: Column) -> Column:
    """Orders spellings by how well they suit display: umlauts, special letters, few accents, length."""
    n = lambda pattern: F.regexp_count(name, F.lit(pattern))
    return F.struct(n(UMLAUTS), n(SPECIAL), -n(FANCY), F.length(name))


def keyed(records: DataFrame) -> DataFrame:
    """Records with a comparison form of two letters or more, as ``norm``."""
    return records.withColumn("norm", normalize(F.col("name"))).filter(F.length("norm") >= 2)


def merge(records: DataFrame) -> DataFrame:
    """One row per kind and norm: ``name origin sources total``.

    The display name is the last record, in order, that ties with the best display class and either came first with
    it or has a count above all before; this equals folding the records one by one.
    """
    by_key = Window.partitionBy("kind", "norm")
    ordered = by_key.orderBy("seq")
    first = F.row_number().over(ordered) == 1
    count = F.when(F.isnan("count"), F.when(first, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))).otherwise(
        F.col("count")
    )
    rows = (
        keyed(records)
        .withColumn("best_count", count)
        .withColumn("class", display_class(F.col("name")))
        .withColumn("top", F.col("class") == F.max("class").over(by_key))
        .withColumn("before", F.max("best_count").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("first_top", F.min(F.when(F.col("top"), F.col("seq"))).over(by_key))
    )
    wins = F.col("top") & ((F.col("seq") == F.col("first_top")) | (F.col("best_count") > F.col("before")))
    positive = F.when((F.col("count") > 0) & ~F.isnan("count"), F.col("count")).otherwise(F.lit(0.0))
    return rows.groupBy("kind", "norm").agg(
        F.max_by("name", F.when(wins, F.col("seq"))).alias("name"),
        F.coalesce(F.min_by("origin", "seq"), F.lit("")).alias("origin"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        F.sum(positive).alias("total"),
    )


def merged_variants(records: DataFrame) -> DataFrame:
    """``kind norm variant source``: spellings with a norm of their own; of several sources, the last."""
    spelled = keyed(records).select("kind", "seq", F.col("norm").alias("key"), "source", F.explode("variants").alias("variant"))
    other = spelled.withColumn("own", normalize(F.col("variant"))).filter((F.col("own") != "") & (F.col("own") != F.col("key")))
    return other.groupBy("kind", F.col("key").alias("norm"), "variant").agg(F.max_by("source", "seq").alias("source"))


def ranked(merged: DataFrame, boundaries: Sequence[str] = ()) -> DataFrame:
    """Names by falling total, then in German order, with probabilities and keys.

    Names of one total and between the same ``boundaries`` are ranked among themselves, after the numbers of all that come
    before, so no task sorts a whole kind.
    """
    totals = merged.groupBy("kind").agg(F.sum("total").alias("mass"), F.count(F.lit(1)).alias("n"))
    # one row per kind
    rows = merged.join(F.broadcast(totals), "kind").withColumn("mass", F.when(F.col("mass") == 0, 1.0).otherwise(F.col("mass")))
    prob = F.when(F.col("total") > 0, F.col("total") / F.col("mass")).otherwise(F.lit(1.0) / F.col("n") / 10)
    name = F.collate("name", "de")
    before = [F.when(F.collate(F.lit(b), "de") <= name, 1).otherwise(0) for b in boundaries]
    cell = ["kind", "total", "cell"]
    placed = rows.withColumn("cell", sum(before, F.lit(0)))
    sizes = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("size"))
    along = Window.partitionBy("kind").orderBy(F.desc("total"), "cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*cell, F.coalesce(F.sum("size").over(along), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*cell).orderBy(F.collate("name", "de"), "name")
    return (
        placed.withColumn("inside", F.row_number().over(inside))
        .join(offsets, cell)
        .withColumn("rank_de", (F.col("offset") + F.col("inside")).cast("int"))
        .withColumn("prob", prob)
        .select(
            "kind",
            F.col("rank_de").alias("id"),
            "name",
            "norm",
            skeleton_of(F.col("norm")).alias("skeleton"),
            cologne_of(F.col("norm")).alias("cologne"),
            F.length("norm").alias("length"),
            "prob",
            F.log10(F.greatest("prob", F.lit(1e-12))).alias("log_prob"),
            "rank_de",
            "origin",
            "sources",
        )
    )


#: Names of one cell that are ranked by one task, about, and the most cells.
CELL_NAMES, CELLS = 500_000, 256


def cell_boundaries(merged: DataFrame) -> list[str]:
    """Names that part the German order into cells of about ``CELL_NAMES``; none for small lexicons."""
    n = merged.count()
    cells = min(n // CELL_NAMES, CELLS)
    if not cells:
        return []
    each = 100  # sampled names per cell
    sample = merged.filter(F.pmod(F.xxhash64("name"), F.lit(max(1, n // (cells * each)))) == 0).select("name")
    names = [r["name"] for r in sample.orderBy(F.collate("name", "de"), "name").limit(2 * CELLS * each).collect()]
    return names[each::each]


def build(records: DataFrame, licenses: tuple[str, ...] = LICENSES) -> Lexicon:
    """The four tables of a lexicon from records, written to the shared folder, so that plans that read them stay small."""
    merged = durable(merge(records), "merged")
    plain = durable(ranked(merged, cell_boundaries(merged)), "ranked")
    variants = (
        merged_variants(records)
        .join(plain.select("kind", "norm", F.col("id").alias("surname_id")), ["kind", "norm"])
        .withColumn("own", normalize(F.col("variant")))
        .select("kind", "surname_id", F.col("variant").alias("name"), F.col("own").alias("norm"), cologne_of(F.col("own")).alias("cologne"), "source")
    )
    variants = durable(variants, "variants")
    counts = durable(ngram.train(plain), "counts")
    scores = durable(ngram.mean_log(plain.select("kind", "norm"), ngram.Model(counts)), "scores")
    calibration = durable(ngram.calibrate(scores), "calibration")
    scored = scores.join(F.broadcast(calibration), "kind").select(  # one row per kind
        "kind", "norm", ngram.logistic(F.col("mean_log"), F.col("median"), F.col("spread")).alias("plausibility")
    )
    columns = ["kind", "norm", *(c for c in plain.columns if c not in ("kind", "norm")), "plausibility"]
    names = durable(plain.join(scored, ["kind", "norm"]).select(*columns), "names")
    pairs = F.array(
        F.struct(F.lit("licenses").alias("key"), F.lit(json.dumps(list(licenses), ensure_ascii=False)).alias("value")),
        F.struct(F.lit("ngram_max_order").alias("key"), F.lit(str(ngram.MAX_ORDER)).alias("value")),
        F.struct(F.lit("ngram_median").alias("key"), F.col("median").cast("string").alias("value")),
        F.struct(F.lit("ngram_spread").alias("key"), F.col("spread").cast("string").alias("value")),
        F.struct(F.lit("kind").alias("key"), F.col("kind").alias("value")),
        F.struct(F.lit("built_at").alias("key"), F.current_timestamp().cast("string").alias("value")),
    )
    meta = durable(calibration.select("kind", F.explode(pairs).alias("m")).select("kind", "m.key", "m.value"), "meta")
    drop(merged, plain, scores, calibration)
    return Lexicon(names, variants, counts.filter("count >= 2 or n <= 2"), meta)
