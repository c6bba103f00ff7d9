"""Sharding by extendible hashing: a directory indexed by the leading bits of a hash key.

A shard is a prefix of the key's bits. The directory begins as one shard of depth 0; only shards over
the byte limit are split, on their next bit, until each fits. So a document's shard is the shortest
prefix of its key whose documents fit into the limit. Prefix sizes come from one aggregation of
key cells and their roll-up over depths, not from moving documents; only cells that are
still too large get further rounds with more bits. Rows whose keys agree in all bits are told
apart by a second key, made of their position in the input, and split on its bits in the same way.

Edge cases: a null or empty text has 0 bytes and belongs to a shard all the same; a null id has a key.
A single row above the limit is a shard by itself, with ``oversized`` true. An empty table has
no shards. Only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import KEY_BITS, broadcast_if_small, durable, spread_key, table

#: 64 MiB, a usual size of training shards.
SHARD_BYTES = 1 << 26
#: Cells of the first directory for each shard that the total size asks for, as bits.
CELL_BITS = 3
ROUND_BITS = 8
#: Cells up to which the directory is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 50_000


def assign(docs: DataFrame, *, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, depth, prefix, oversized``, the columns to ``carry`` along, and ``shard``.

    ``prefix`` is the bit string of the shard and ``shard`` its label ``<depth>-<prefix in bits>``.
    """
    rows = durable(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"),
            spread_key(F.col(id_col)).alias("key"),
            *carry,
        ).withColumn("second", spread_key(F.col("key"), F.monotonically_increasing_id())),
        "sharding-rows",
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(KEY_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + CELL_BITS)
    settled: list[DataFrame] = []
    base, open_rows = 0, rows
    while True:
        # bits base+1 .. upto of the two keys, taken together
        upto = min(bits, KEY_BITS) if base < KEY_BITS else bits
        word, low = ("key", 0) if base < KEY_BITS else ("second", KEY_BITS)
        cell = F.shiftright(F.col(word), KEY_BITS - (upto - low))
        own = open_rows.withColumn("cell", cell)
        parent = ["key"] if low else []
        cells = durable(
            own.groupBy(*parent, "cell").agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")),
            "sharding-cells",
        )
        depths = F.sequence(F.lit(base), F.lit(upto))
        nodes = cells.withColumn("depth", F.explode(depths)).withColumn(
            "node", F.expr(f"shiftright(cell, {upto} - depth)")
        )
        sizes = nodes.groupBy(*parent, "depth", "node").agg(F.sum("bytes").alias("all_bytes"), F.sum("rows").alias("all_rows"))
        fitting = sizes.filter((F.col("all_bytes") <= limit) | (F.col("all_rows") == 1))
        found = (
            nodes.join(fitting, [*parent, "depth", "node"])
            .groupBy(*parent, "cell")
            .agg(F.min_by(F.struct("depth", "node", "all_bytes"), "depth").alias("at"))
            .select(*parent, "cell", "at.depth", "at.node", (F.col("at.all_bytes") > limit).alias("oversized"))
        )
        directory = broadcast_if_small(durable(found, "sharding-directory"), BROADCAST_ROWS)
        placed = own.join(directory, [*parent, "cell"], "left")
        at_word = F.lpad(F.conv(F.col("node").cast("string"), 10, 2), F.col("depth") - low, "0")
        label = F.when(F.col("depth") == low, F.lit("")).otherwise(at_word)
        settled.append(
            placed.filter("depth is not null").select(
                "doc_id", "n_bytes", "depth", F.concat(_bits("key", KEY_BITS) if low else F.lit(""), label).alias("prefix"), "oversized", *carry
            )
        )
        left = cells.agg(F.max("bytes"), F.max("rows")).first()
        deep = upto == 2 * KEY_BITS
        if left[0] is None or deep or not cells.filter((F.col("bytes") > limit) & (F.col("rows") > 1)).take(1):
            break
        open_rows = durable(
            placed.filter("depth is null").drop("depth", "node", "oversized", "cell"),
            "sharding-open",
        )
        base = upto
        bits = min(upto + ROUND_BITS, KEY_BITS if upto < KEY_BITS else 2 * KEY_BITS)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    shard = F.concat(F.col("depth").cast("string"), F.lit("-"), F.coalesce(F.nullif("prefix", F.lit("")), F.lit("0")))
    return out.withColumn("shard", shard)


def _bits(name: str, width: int):
    return F.lpad(F.conv(F.col(name).cast("string"), 10, 2), width, "0")


def write_shards(docs: DataFrame, path: str, *, limit: int = SHARD_BYTES, id_col: str = "doc_id") -> None:
    """Writes ``docs`` as a table partitioned by ``shard``. Rows are numbered first, so that ids may repeat."""
    numbered = durable(docs.withColumn("__row", F.monotonically_increasing_id()), "sharding-input")
    shards = assign(numbered, limit=limit, id_col=id_col, carry=("__row",)).select("__row", "shard")
    numbered.join(shards, "__row").drop("__row").repartition("shard").write.partitionBy("shard").parquet(path)


#: The limit of the query, which parts even small tables to several depths.
QUERY_BYTES = 1 << 18


def query(spark, sf_dir: str, limit: int = QUERY_BYTES) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"), limit=limit)


#: The shortest fitting prefix, over all depths up to 20.
ORACLE = f"""
WITH r AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0))), 1, 13))::BIGINT AS key FROM documents),
n AS (
  SELECT doc_id, n_bytes, depth::INTEGER AS depth, key >> ({KEY_BITS} - depth) AS node
  FROM r, range(0, 21) d(depth)),
s AS (SELECT *, sum(n_bytes) OVER (PARTITION BY depth, node) AS bytes, count(*) OVER (PARTITION BY depth, node) AS n FROM n),
f AS (
  SELECT doc_id, n_bytes, min(depth) AS depth, arg_min(node, depth) AS node, arg_min(bytes, depth) > {QUERY_BYTES} AS oversized
  FROM s WHERE bytes <= {QUERY_BYTES} OR n = 1 GROUP BY doc_id, n_bytes),
p AS (SELECT *, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(node), depth, '0') END AS prefix FROM f)
SELECT doc_id, n_bytes, depth, prefix, oversized, depth::VARCHAR || '-' || coalesce(nullif(prefix, ''), '0') AS shard FROM p
"""
