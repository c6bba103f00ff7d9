"""Quality classifier by importance resampling with hashed n-gram models.

Texts are bags of hashed n-grams: words, pairs of words, and runs of four bytes. Two generative models,
one of the target (documents labelled good) and one of the raw text (all documents), give each bucket a
probability, smoothed by ``SMOOTHING``. A document's log weight is the sum of ``log p_target - log p_raw``
over its n-grams. Adding Gumbel noise drawn from a hash of the id and keeping the ``k`` largest sums
samples ``k`` documents without replacement in proportion to their weights.

``k`` follows from the labels: the share of good ones among the labelled documents of the input, plus
``SLACK`` of the rest. The target model and the share are fitted on at most ``LABELLED_ROWS`` labelled rows, those
with the lowest hash; the raw model counts every document. Per task the counts are one array, so
what is shuffled is one row per bucket and task. The k-th largest key is found by refining a histogram.

Edge cases: null and empty texts have no n-grams and log weight 0. Without good labels all weights are 0, and
without labels everything is kept. Of repeated labels the highest counts. Rows repeated with one id and text have
one key and are kept or rejected together; ties of the key are broken by id. Very long texts are hashed in
chunks. An empty table gives an empty result. Only ``doc_id text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._hashing import CHUNK_BYTES, mix, words
from ._shared import KEY_BITS, durable, lean, spread_key, table

BUCKETS = 1 << 16
SMOOTHING = 1.0
LABELLED_ROWS = 50_000
#: The part of the documents beyond the share of good ones that is kept too.
SLACK = 0.05
BINS = 1024
#: Rows of the last histogram bin that are ordered at once.
LAST_ROWS = 10_000

_FAMILIES = np.array([0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9, 0xD1B54A32D192ED03], np.uint64)


def _bytes_grams(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of the runs of four bytes, in chunks."""
    for at in range(0, max(0, len(text) - 3), CHUNK_BYTES):
        data = np.frombuffer(text[at : at + CHUNK_BYTES + 3], np.uint8).astype(np.uint64)
        code = data[:-3] | data[1:-2] << np.uint64(8) | data[2:-1] << np.uint64(16) | data[3:] << np.uint64(24)
        yield _bucket(code, 2)


def _bucket(code: np.ndarray, family: int) -> np.ndarray:
    return (mix(code ^ _FAMILIES[family]) >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)


def grams(texts: list[bytes] | pa.Array | pd.Series) -> Iterator[list[np.ndarray]]:
    """Per text the buckets of its n-grams, in parts; few texts are held as bytes at once."""
    for at in range(0, len(texts), 256):
        part = _texts(texts[at : at + 256])
        hashes, begins = words(part)
        for k, text in enumerate(part):
            w = hashes[begins[k] : begins[k + 1]]
            pairs = mix(w[:-1]) + w[1:]
            yield [_bucket(w, 0), _bucket(pairs, 1), *_bytes_grams(text)]


def _texts(texts: list[bytes] | pa.Array | pd.Series) -> list[bytes]:
    if isinstance(texts, pa.Array):
        return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    return [t.encode("utf-8", "replace") if isinstance(t, str) else t or b"" for t in texts]


def gram_counts(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """Counts per bucket, ``[raw, target]``, over all documents; ``target`` has the ids (``id``) of the good ones."""

    def count(batches):
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            flags = batch.column(1).to_pylist()
            for flag, parts in zip(flags, grams(batch.column(0)), strict=True):
                for part in parts:
                    n = np.bincount(part, minlength=BUCKETS) if len(part) > BUCKETS // 8 else None
                    if n is not None:
                        raw += n
                        good += n if flag else 0
                    else:
                        np.add.at(raw, part, 1)
                        if flag:
                            np.add.at(good, part, 1)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(good[used])], ["bucket", "raw", "good"])

    flagged = docs.join(F.broadcast(target), F.col("doc_id") == F.col("id"), "left").select("text", F.col("id").isNotNull().alias("flag"))
    rows = (
        flagged.mapInArrow(lean(count), "bucket long, raw long, good long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
        .toPandas()  # BUCKETS rows at most
    )
    out = np.zeros((2, BUCKETS))
    out[0, rows["bucket"]] = rows["raw"]
    out[1, rows["bucket"]] = rows["good"]
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    if not counts[1].sum():
        return np.zeros(BUCKETS)
    smooth = counts + SMOOTHING
    p = smooth / smooth.sum(1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def _kth(rows: DataFrame, name: str, k: int) -> tuple[float | int, int]:
    """The k-th smallest value of a column without nulls, and how many of its rows are among the first k.

    A histogram is refined until its bin has one value, or few enough rows to be ordered at once.
    """
    low, high, n = rows.agg(F.min(name), F.max(name), F.count(F.lit(1))).first()
    inside, left = rows, k
    while low != high and n > LAST_ROWS:
        width = (high - low) / BINS
        place = F.least(F.floor((F.col(name) - low) / width), F.lit(BINS - 1)).cast("int")
        bins = inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("a"), F.max(name).alias("b"))
        for b in sorted(bins.collect(), key=lambda r: r["bin"]):  # BINS rows at most
            if left <= b["n"]:
                break
            left -= b["n"]
        if (b["a"], b["b"]) == (low, high):  # neighbouring numbers
            below = inside.filter(F.col(name) == low).count()
            low, left = (low, left) if left <= below else (high, left - below)
            return low, left
        low, high, n = b["a"], b["b"], b["n"]
        inside = inside.filter(F.col(name).between(low, high))
    if low != high:
        values = sorted(r[0] for r in inside.select(name).collect())  # LAST_ROWS at most
        low = values[left - 1]
        left -= sum(v < low for v in values)
    return low, left


def kth_largest(rows: DataFrame, k: int) -> tuple[float, int] | None:
    """The key and id of the k-th row of ``rows`` (``key, doc_id``) by falling key and rising id, null first; None for all."""
    if k >= rows.count():
        return None
    key, left = _kth(rows.select((-F.col("key")).alias("key")), "key", k)
    tied = rows.filter(F.col("key") == -key)
    nulls = tied.filter("doc_id is null").count()
    if left <= nulls:
        return -key, None
    return -key, _kth(tied.filter("doc_id is not null"), "doc_id", left - nulls)[0]


def classify(
    docs: DataFrame, labels: DataFrame, *, labelled_rows: int = LABELLED_ROWS, slack: float = SLACK, carry: dict[str, Column] | None = None
) -> DataFrame:
    """One row per document: ``doc_id, log_weight, kept``, and columns to ``carry`` along, computed from ``docs``."""
    more = list(carry or {})
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(c.alias(name) for name, c in (carry or {}).items()))
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    sample = durable(known.orderBy(F.xxhash64("id"), "id").limit(labelled_rows), "labels")
    present = docs.select("doc_id").join(F.broadcast(sample), F.col("doc_id") == F.col("id"))
    share = present.agg(F.avg((F.col("quality") > 0).cast("double"))).first()[0]
    ratios = docs.sparkSession.sparkContext.broadcast(
        log_ratios(gram_counts(docs, sample.filter("quality > 0").select("id"))).astype(np.float64)
    )

    @F.pandas_udf("double")
    def weight(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ratio = ratios.value
        for texts in batches:
            yield pd.Series([float(sum(ratio[p].sum() for p in parts)) for parts in grams(texts)], dtype="float64")

    uniform = (spread_key(F.col("doc_id")) + 0.5) / float(2**KEY_BITS)
    scored = durable(
        docs.select("doc_id", *more, weight(F.coalesce("text", F.lit(""))).alias("log_weight")).withColumn(
            "key", F.col("log_weight") - F.log(-F.log(uniform))
        ),
        "importance",
    )
    if share is None:
        return scored.select("doc_id", "log_weight", F.lit(True).alias("kept"), *more)
    k = max(1, int(round(scored.count() * (share + (1 - share) * slack))))
    edge = kth_largest(scored.select("key", "doc_id"), k)
    if edge is None:
        kept = F.lit(True)
    else:
        at = F.col("key") == edge[0]
        first = F.col("doc_id").isNull() if edge[1] is None else F.col("doc_id").isNull() | (F.col("doc_id") <= edge[1])
        kept = (F.col("key") > edge[0]) | (at & first)
    return scored.select("doc_id", "log_weight", kept.alias("kept"), *more)


def query(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
