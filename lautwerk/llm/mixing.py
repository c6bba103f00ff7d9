"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets.

Every row gets a uniform hash key. A source's rows are ranged by the high part of the key into as
many cells as its share of the rows needs; cells are summed, the few cell sums are
accumulated per source, and each cell then accumulates its own rows. No task sees a whole source, so
one source may hold most rows. A budget of ``t`` words over a source of ``S`` words takes
``floor(t / S)`` whole epochs and the first ``t mod S`` words in key order, cutting the row at the edge.

Targets: the total is shared by weight; a source's target stops at ``max_epochs`` times its size, and
the excess is reshared by weight among the others until none is above. The closed form sorts sources by
the share at which they fill and finds the level ``L`` with ``sum(min(cap, L * weight)) = total``; it works on
one row per source.

Edge cases: a null text has size 0 and takes nothing; null is a source of its own, the last; a
source of size 0 has target 0. Ties of the key are broken by id and size, and rows equal in those too
are interchangeable; repeated rows are rows of their own. Reruns agree, since nothing is
random. Empty tables give empty results; clashing column names are not touched, as only
``doc_id text source`` are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import KEY_BITS, SEPARATOR_CHARS, broadcast_if_small, durable, spread_key, words

#: Rows of a cell, on average.
CELL_ROWS = 4_000
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
#: Sources, or cells, up to which their table is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 50_000


def targets(sizes: DataFrame, weights: Sequence[int], share: float, max_epochs: int) -> DataFrame:
    """``source, source_size, rows, target`` from one row per source ``source, source_size, rows``.

    The weights repeat over the sources in code point order, null last.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * max_epochs)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    level = (F.col("total") - F.col("full")) / F.col("rest")
    return (
        weighed.withColumn("total", F.sum("source_size").over(everything) * share)
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(after))
        .withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
        .withColumn("target", F.coalesce("target", F.col("cap").cast("double")))
        .select("source", "source_size", "rows", "target")
    )


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """One row per document: ``doc_id, source, key, size, source_size, target, taken``."""
    rows = durable(
        docs.select(
            "doc_id", "source", spread_key(F.col("doc_id")).alias("key"), F.size(words(F.col("text"))).cast("long").alias("size")
        ),
        "mixing-rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    goal = targets(sizes, weights, share, max_epochs).select(
        F.col("source").alias("goal_source"),
        "source_size",
        "target",
        F.greatest(F.lit(1), F.ceil(F.col("rows") / cell_rows)).cast("long").alias("cells"),
    )
    goal = broadcast_if_small(durable(goal, "mixing-targets"), BROADCAST_ROWS)
    placed = durable(
        rows.join(goal, F.col("source").eqNullSafe(F.col("goal_source")))
        .withColumn("cell", F.floor(F.col("key") / float(2**KEY_BITS) * F.col("cells")))
        .drop("goal_source", "cells"),
        "mixing-cells",
    )
    along = Window.partitionBy("cell_source").orderBy("cell_no").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        placed.groupBy(F.col("source").alias("cell_source"), F.col("cell").alias("cell_no"))
        .agg(F.sum("size").alias("cell_size"))
        .select("cell_source", "cell_no", F.coalesce(F.sum("cell_size").over(along), F.lit(0)).alias("offset"))
    )
    cells = broadcast_if_small(durable(cells, "mixing-offsets"), BROADCAST_ROWS)
    inside = (
        Window.partitionBy("source", "cell").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = summed.join(
        cells, F.col("source").eqNullSafe(F.col("cell_source")) & (F.col("cell") == F.col("cell_no")), "left"
    )
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("offset") - F.col("inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return joined.select("doc_id", "source", "key", "size", "source_size", "target", taken.cast("long").alias("taken"))


def expand(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix as rows with the columns of ``docs``: each document as often as it is taken.

    A document cut at a budget's edge ends after its last word taken, words joined by single spaces;
    there is one such row per source at most. Rows with no words taken go.
    """
    key = ["__id", "__source", "__size"]
    rows = mixed.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    groups = durable(rows.groupBy(*key).agg(F.max("__taken").alias("__taken"), F.min("__taken").alias("__least")), "mixing-shares")
    sized = docs.withColumn("__n", F.size(words(F.col("text"))).cast("long"))
    same = (
        F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__n") == F.col("__size"))
    )
    plain = sized.join(groups.filter("__taken > 0 and __taken = __least").drop("__least"), same)
    # rows repeated with one id, source and size are neighbours in the order; only at a source's edge are they taken
    # differently, so this is one group per source at most, whose rows are numbered on both sides
    edge = broadcast_if_small(groups.filter("__taken > __least").select(*key), BROADCAST_ROWS)
    matched = [F.col(c).eqNullSafe(F.col("e" + c)) for c in key]
    shares = rows.join(edge.toDF(*("e" + c for c in key)), matched, "left_semi").withColumn(
        "__row", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("__taken")))
    )
    order = Window.partitionBy("doc_id", "source", "__n").orderBy(F.xxhash64("text"))
    twins = sized.join(edge, same, "left_semi").withColumn("__place", F.row_number().over(order))
    cut_ = twins.join(shares.filter("__taken > 0"), same & (F.col("__place") == F.col("__row"))).drop("__place", "__row")
    joined = plain.unionByName(cut_)
    whole = F.floor(F.col("__taken") / F.col("__n")).cast("int")
    cut = (F.col("__taken") % F.col("__n")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(cut > 0, F.array(cut)).otherwise(F.array().cast("array<int>")))
    head = F.array_join(F.slice(words(F.col("text")), 1, F.greatest("__cut", F.lit(1))), " ")
    return (
        joined.withColumn("__cut", F.explode(copies))
        .withColumn("text", F.when(F.col("__cut") > 0, head).otherwise(F.col("text")))
        .select(*docs.columns)
    )


_SIZE = f"len(regexp_extract_all(coalesce(text, ''), '[^{SEPARATOR_CHARS[0]}\\x09-\\x0D]+'))"
#: ``{docs}`` is the relation that is mixed.
ROWS_SQL = f"""
rows_ AS (
  SELECT doc_id, source, coalesce({_SIZE}, 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0))), 1, 13))::BIGINT AS key FROM {{docs}}),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (ARRAY[3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight
  FROM rows_ GROUP BY source),
filling AS (
  SELECT *, 2 * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total,
    coalesce(sum(2 * source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS full_,
    sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rest
  FROM sizes WINDOW f AS (ORDER BY 2 * source_size::DOUBLE / weight, source NULLS LAST)),
levels AS (
  SELECT *, max(CASE WHEN (total - full_) / rest * weight <= cap THEN (total - full_) / rest END) OVER () AS level
  FROM filling),
goal AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, level * weight), cap::DOUBLE) AS target FROM levels),
summed AS (
  SELECT r.*, g.source_size, g.target, floor(g.target + 0.5)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id NULLS FIRST, size
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows_ r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source),
epochs_ AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM summed),
mixed AS (
  SELECT doc_id, source, size, source_size, target,
    (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM epochs_)
"""
ORACLE = f"WITH {ROWS_SQL.format(docs='documents')} SELECT doc_id, size, source_size, target, taken FROM mixed"


def query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
