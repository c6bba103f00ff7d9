"""A training-data pipeline of five stages over ``documents``.

Each stage reads what the stage before it wrote and applies one operator of ``lautwerk.llm``. All but the
last return the columns of ``documents``; the last returns token ids. A stage's table is deleted once the next one is written.

Edge cases, in every stage: empty tables give empty ones, and columns beyond those of ``documents`` go. Null and blank texts
fail the quality rules. Of rows with one id, the first two stages judge each text by itself (rows repeated whole share a verdict);
near_duplicates keeps one row of each group and of each id, of rows with one id that with the least text hash. Null ids are
never duplicates. source_mixing repeats rows as often as its budgets ask and cuts one per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lautwerk.llm import importance, line_quality, mixing, parity_join, piece_codec
from lautwerk.llm._shared import BROADCAST_IDS, broadcast_if_small, drop, durable, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their lines above the limit."""
    kept = line_quality.clean(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def _hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps; what goes is usually less than what stays, and is joined."""
    docs = docs.select(*COLUMNS)
    judged = importance.classify(docs, table(spark, sf_dir, "labels"), carry={"k_hash": _hash(F.col("text"))})
    gone = judged.filter("not kept").select(F.col("doc_id").alias("k_id"), "k_hash").distinct()
    gone = broadcast_if_small(durable(gone, "rejected"), BROADCAST_IDS)
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (_hash(F.col("text")) == F.col("k_hash"))
    return docs.join(gone, same, "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram similarity links: that with the smallest id."""
    docs = docs.select(*COLUMNS)
    linked = parity_join.link(docs)
    gone = linked.filter("doc_id <> component_id").select(F.col("doc_id").alias("k_id")).distinct()
    gone = broadcast_if_small(durable(gone, "duplicates"), BROADCAST_IDS)
    first = docs.join(gone, F.col("doc_id") == F.col("k_id"), "left_anti").select(*COLUMNS)
    # ids of several rows are few, if there are any; only their rows are moved
    repeated = linked.filter("doc_id is not null").groupBy(F.col("doc_id").alias("k_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = durable(repeated.select("k_id"), "repeated")
    if not repeated.take(1):
        return first
    repeated = broadcast_if_small(repeated, BROADCAST_IDS)
    alone = first.join(repeated, F.col("doc_id") == F.col("k_id"), "left_anti")
    several = first.join(repeated, F.col("doc_id") == F.col("k_id"), "left_semi")
    order = Window.partitionBy("doc_id").orderBy(_hash(F.col("text")), "lang", "source", "n_chars")
    return alone.unionByName(several.withColumn("k_at", F.row_number().over(order)).filter("k_at = 1").drop("k_at"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, documents repeated as often as it takes them."""
    docs = docs.select(*COLUMNS)
    mixed = mixing.expand(docs, mixing.mix(docs)).select(*COLUMNS)
    return mixed.withColumn("n_chars", F.char_length("text").cast("long"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix its token ids."""
    coded = piece_codec.coded(docs.select("doc_id", "source", "text"), piece_codec.model_path())
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("piece_encoding", piece_encoding),
]

#: None: importance resampling and the piece codec have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, each on what the one before wrote."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out = durable(out, f"stage-{name}")
            drop(before)
            before = out
        docs = out
    return docs
