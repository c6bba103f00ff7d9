"""The character n-gram model that scores how plausible an unknown name is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ORDER = 4
# The weights of the orders, the steepness of the score, its bounds.
WEIGHTS = (0.55, 0.25, 0.15, 0.05)
STEEPNESS, CLAMP, FLOOR = 1.4, 20.0, 1e-12
DEFAULT_MEDIAN, DEFAULT_SPREAD = -3.0, 1.0


def padded(text: Column, order: int) -> Column:
    return F.concat(F.lit("^" * (order - 1)), text, F.lit("$"))


def grams(text: Column, order: int) -> Column:
    """All windows of ``order`` characters over the padded text: one more than it has characters."""
    return F.transform(F.sequence(F.lit(0), F.length(text)), lambda i: F.substr(padded(text, order), i + 1, F.lit(order)))


def exploded(names: DataFrame, *keep: str) -> DataFrame:
    """``kind norm n position gram`` and the columns to keep."""
    orders = F.array(
        *(
            F.struct(F.lit(n).alias("n"), grams(F.col("norm"), n).alias("grams"))
            for n in range(1, MAX_ORDER + 1)
        )
    )
    return names.select("kind", "norm", *keep, F.explode(orders).alias("o")).select(
        "kind", "norm", *keep, "o.n", F.posexplode("o.grams").alias("position", "gram")
    )


def train(names: DataFrame) -> DataFrame:
    """``kind gram n count`` from ranked names; a name counts by its rank."""
    weight = F.greatest(F.lit(1), F.floor(F.lit(1000) / F.col("rank_de") + 0.5)).cast("long")
    return (
        exploded(names.withColumn("weight", weight), "weight")
        .groupBy("kind", "gram", "n")
        .agg(F.sum("weight").alias("count"))
    )


@dataclass
class Model:
    grams: DataFrame

    def sizes(self) -> DataFrame:
        """Per kind the unigrams' total and the size of the vocabulary: one row per kind."""
        return (
            self.grams.filter("n = 1")
            .groupBy("kind")
            .agg(F.sum("count").alias("total"), F.greatest(F.count(F.lit(1)) + 2, F.lit(2)).alias("vocabulary"))
        )


def mean_log(names: DataFrame, model: Model) -> DataFrame:
    """``kind norm mean_log``: the mean log probability per position of each distinct name."""
    own = model.grams.select("kind", "gram", "n", F.col("count").alias("gram_count"))
    context = model.grams.select(
        "kind", F.col("gram").alias("context"), (F.col("n") + 1).alias("n"), F.col("count").alias("context_count")
    )
    rows = exploded(names.filter("norm <> ''").distinct()).filter(F.col("n") <= F.length("norm") + 1)
    rows = rows.withColumn("context", F.substr(F.col("gram"), F.lit(1), F.col("n") - 1))
    joined = (
        rows.join(own, ["kind", "gram", "n"], "left")
        .join(context, ["kind", "context", "n"], "left")
        .join(F.broadcast(model.sizes()), "kind", "left")
    )
    below = F.when(F.col("n") == 1, F.coalesce("total", F.lit(0))).otherwise(F.coalesce("context_count", F.lit(0)))
    conditional = (F.coalesce("gram_count", F.lit(0)) + 1) / (below + F.coalesce("vocabulary", F.lit(2)))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("n"))
    return (
        joined.groupBy("kind", "norm", "position")
        .agg(F.sum(weight * conditional).alias("p"))
        .groupBy("kind", "norm")
        .agg((F.sum(F.log(F.greatest("p", F.lit(FLOOR)))) / F.count(F.lit(1))).alias("mean_log"))
    )


#: Bins of the scores' histogram; scores lie between the logarithms of ``FLOOR`` and of the largest ratio of counts.
BINS_PER_UNIT = 10_000


def calibrate(scores: DataFrame) -> DataFrame:
    """``kind median spread``: order statistics by index; one row per kind.

    A histogram of the scores shows the two bins that hold the values; only the scores of these are ordered, so no task
    holds all scores at once.
    """
    binned = scores.select("kind", "mean_log", F.floor(F.col("mean_log") * BINS_PER_UNIT).alias("bin"))
    counts = binned.groupBy("kind", "bin").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("kind").orderBy("bin")
    placed = counts.select(
        "kind", "bin", (F.sum("n").over(along) - F.col("n")).alias("first"), "n", F.sum("n").over(Window.partitionBy("kind")).alias("all")
    )
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("what"), F.floor(F.col("all") * share).alias("i")) for name, share in (("median", 0.5), ("low", 0.05)))))
    found = placed.select("*", wanted.alias("w")).filter((F.col("w.i") >= F.col("first")) & (F.col("w.i") < F.col("first") + F.col("n")))
    # two rows per kind
    inside = binned.join(F.broadcast(found.select("kind", "bin", "w.what", (F.col("w.i") - F.col("first")).alias("at"))), ["kind", "bin"])
    order = Window.partitionBy("kind", "what").orderBy("mean_log")
    exact = inside.withColumn("k", F.row_number().over(order) - 1).filter(F.col("k") == F.col("at"))
    value = lambda what: F.max(F.when(F.col("what") == what, F.col("mean_log")))
    both = exact.groupBy("kind").agg(value("median").alias("median"), value("low").alias("low"))
    return both.select("kind", "median", F.greatest(F.col("median") - F.col("low"), F.lit(1e-6)).alias("spread"))


def logistic(mean: Column, median: Column, spread: Column) -> Column:
    z = F.greatest(F.least((mean - median) / spread, F.lit(CLAMP)), F.lit(-CLAMP))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-STEEPNESS * z))


def plausibility(names: DataFrame, model: Model, calibration: DataFrame) -> DataFrame:
    """``kind norm plausibility`` of distinct names; 0 for an empty one."""
    scored = mean_log(names, model).join(F.broadcast(calibration), "kind", "left")
    median, spread = F.coalesce("median", F.lit(DEFAULT_MEDIAN)), F.coalesce("spread", F.lit(DEFAULT_SPREAD))
    value = scored.select("kind", "norm", logistic(F.col("mean_log"), median, spread).alias("plausibility"))
    empty = names.filter("norm = ''").distinct().select("kind", "norm", F.lit(0.0).alias("plausibility"))
    return value.unionByName(empty)
