"""Matching a table of heard names against a lexicon: blocking, scoring, ranking, probabilities.

Heard names have ``query_id name kind`` and may have ``limit threshold``. What a name matches depends on its
comparison form and options alone, so each distinct form is matched once with its options and the rows are joined at the end;
``query_id`` is carried along and need not be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ngram
from ..functions.distance import round4, similarity
from ..functions.text import cologne_of, normalize, skeleton_of
from .lexicon import Lexicon

# Fixed values.
THRESHOLD, LIMIT, PRIOR_WEIGHT, BELOW_THRESHOLD = 0.86, 5, 0.32, 0.15
MAX_CANDIDATES, PREFIX_LETTERS, LENGTH_GAP = 400, 3, 2
UNKNOWN_LOG_PROB = -50.0


def heard_keys(heard: DataFrame) -> DataFrame:
    """Heard names with their keys and options filled in."""
    options = {
        "limit": F.coalesce("limit", F.lit(LIMIT)) if "limit" in heard.columns else F.lit(LIMIT),
        "threshold": F.coalesce("threshold", F.lit(THRESHOLD)) if "threshold" in heard.columns else F.lit(THRESHOLD),
    }
    kept = heard.withColumns(options).withColumn("q_norm", normalize(F.col("name")))
    return kept.withColumns({"q_skeleton": skeleton_of(F.col("q_norm")), "q_cologne": cologne_of(F.col("q_norm"))})


#: Names and variants up to which a lexicon's tables are sent to all executors; beyond it joins with them shuffle.
BROADCAST_ROWS = 500_000


def sent(table: DataFrame, lexicon: Lexicon) -> DataFrame:
    """A table with a row or so per name, with a broadcast hint if the lexicon is small enough."""
    return F.broadcast(table) if lexicon.size <= BROADCAST_ROWS else table


def _cells(entries: DataFrame, key: list[Column], entry: str, cap: int) -> DataFrame:
    """Per kind and key the ``cap`` least entries, as ``found``: a query that fits one of them fits them all, so none of the others
    can be among its first ``cap``."""
    rows = entries.select("kind", *key, entry).distinct()
    keys = [c for c in rows.columns if c != entry]
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(entry))
    return rows.withColumn("at", at).filter(F.col("at") <= cap).groupBy(*keys).agg(F.collect_list(entry).alias("found"))


#: Bits of an id in a place.
_ID_BITS = 32


def _placed(lexicon: Lexicon) -> DataFrame:
    """Names with their ``place``, a number that rises as their probability falls and then with their id, which is its low bits."""
    falling = Window.partitionBy("kind").orderBy(F.desc("prob"))  # one row per kind and probability
    tiers = lexicon.names.select("kind", "prob").distinct().withColumn("tier", F.dense_rank().over(falling).cast("long"))
    placed = lexicon.names.join(sent(tiers, lexicon), ["kind", "prob"])
    return placed.withColumn("place", F.shiftleft("tier", _ID_BITS).bitwiseOR(F.col("id").cast("long")))


def key_candidates(keys: DataFrame, lexicon: Lexicon, cap: int = MAX_CANDIDATES) -> DataFrame:
    """Candidates of each row with ``kind q`` (``q`` a struct ``norm skeleton cologne``): its columns with ``id cand_rank``.

    Names that share norm, skeleton, Cologne code, or first letters and about the length, the most probable ``cap``; for forms
    without any of these, names with a variant of the same norm or code. Each row looks its keys up in the lexicon's cells and merges
    what they hold, so no pair moves between tasks, and rows stay where they are unless the lexicon is too large to be sent.
    """
    names, variants = _placed(lexicon), lexicon.variants.select("kind", "norm", "cologne", F.col("surname_id").cast("long").alias("place"))
    lengths = F.explode(F.array(*(F.col("length") + gap for gap in range(-LENGTH_GAP, LENGTH_GAP + 1)))).alias("k_length")
    key = lambda column: F.col(column).alias("k_key")
    prefix = F.left("norm", F.lit(PREFIX_LETTERS)).alias("k_key")
    form = F.col("q")
    looked_up = {
        "k_norm": (names, [key("norm")], [form["norm"]]),
        "k_skeleton": (names, [key("skeleton")], [form["skeleton"]]),
        "k_cologne": (names, [key("cologne")], [form["cologne"]]),
        "k_variant": (variants, [key("norm")], [form["norm"]]),
        "k_sound": (variants, [key("cologne")], [form["cologne"]]),
        "k_prefix": (names, [prefix, lengths], [F.left(form["norm"], F.lit(PREFIX_LETTERS)), F.length(form["norm"])]),
    }
    rows = keys.filter("q.norm <> ''")
    for name, (entries, columns, asked) in looked_up.items():
        cells = _cells(entries, columns, "place", cap).withColumnRenamed("kind", "k_kind").withColumnRenamed("found", name)
        same = [F.col("kind") == F.col("k_kind"), F.col("k_key") == asked[0], *(F.col("k_length") == a for a in asked[1:])]
        rows = rows.join(sent(cells, lexicon), same, "left").drop("k_kind", "k_key", "k_length")
    primary, second = ["k_norm", "k_skeleton", "k_cologne", "k_prefix"], ["k_variant", "k_sound"]
    none = F.array().cast("array<bigint>")

    def first(found: list[str]) -> Column:
        return F.slice(F.sort_array(F.array_distinct(F.concat(*(F.coalesce(c, none) for c in found)))), 1, cap)

    places = F.when(F.coalesce(*primary).isNotNull(), first(primary)).otherwise(first(second))
    number = (F.col("place").bitwiseAND(F.lit((1 << _ID_BITS) - 1))).cast(lexicon.names.schema["id"].dataType)
    return rows.select(*keys.columns, F.posexplode(places).alias("at", "place")).select(*keys.columns, number.alias("id"), (F.col("at") + 1).alias("cand_rank"))


def parts_of(df: DataFrame) -> int:
    """Partitions to ask for by number, which aren't merged: few bytes of heard names make many candidates."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _form() -> Column:
    return F.struct(F.col("q_norm").alias("norm"), F.col("q_skeleton").alias("skeleton"), F.col("q_cologne").alias("cologne"))


def candidates(heard: DataFrame, lexicon: Lexicon, cap: int = MAX_CANDIDATES) -> DataFrame:
    """``query_id kind id cand_rank`` of heard names with keys; variants are tried only for names without any primary candidate."""
    asked = heard.select("query_id", "kind", _form().alias("q"))
    found = key_candidates(asked.repartition(parts_of(asked)), lexicon, cap)
    return found.select("query_id", "kind", "id", "cand_rank")


#: What decides about matches: the form and the options.
ASKED = ["kind", "q", "threshold", "most"]


def asked_rows(heard: DataFrame, limit: Column | None = None) -> DataFrame:
    """Heard names with the columns ``ASKED``."""
    keyed = heard_keys(heard)
    most = F.col("limit") if limit is None else limit
    return keyed.withColumns({"q": _form(), "most": most}).drop("q_skeleton", "q_cologne", "limit")


def matches_of(asked: DataFrame, lexicon: Lexicon, prior_weight: float = PRIOR_WEIGHT) -> DataFrame:
    """The best matches of distinct rows with the columns ``ASKED``, ``position`` from 1.

    The rows are dealt once; their candidates are made, scored and ranked where they lie.
    """
    floor = F.col("threshold") - BELOW_THRESHOLD
    longest = F.greatest(F.length("q.norm"), "length")
    # sound after the cap: more difference in length than this cannot reach the floor
    reachable = F.abs(F.length("q.norm") - F.col("length")) <= longest * ((1 - floor) / 0.65) + 1e-9
    prior = F.when(F.col("prob") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log10("prob") + 7) / 7))).otherwise(0.0)
    rows = (
        key_candidates(asked.select(*ASKED).repartition(parts_of(asked), *ASKED), lexicon)
        .join(sent(lexicon.names, lexicon), ["kind", "id"])
        .filter(reachable)
        .withColumn("sim", similarity(F.col("q.norm"), F.col("norm")))
        .filter(F.col("sim") >= floor)
        .withColumn("score", round4((1 - prior_weight) * F.col("sim") + prior_weight * prior))
    )
    exact = F.col("norm") == F.col("q.norm")
    order = Window.partitionBy(*ASKED).orderBy(F.desc("score"), "cand_rank")
    via = (
        F.when(exact, "exact")
        .when(F.col("skeleton") == F.col("q.skeleton"), "skeleton")
        .when(F.col("cologne") == F.col("q.cologne"), "phonetic")
        .otherwise("edit")
    )
    return (
        rows.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= F.col("most"))
        .select(
            *ASKED, "position", "id", "name", "norm", "score", round4(F.col("sim")).alias("similarity"),
            F.col("prob").alias("probability"), F.col("rank_de").alias("rank"), "sources", exact.alias("exact"),
            via.alias("matched_via"), (exact | (F.col("sim") >= F.col("threshold"))).alias("confident"),
        )
    )


def match(heard: DataFrame, lexicon: Lexicon, *, limit: Column | None = None, prior_weight: float = PRIOR_WEIGHT) -> DataFrame:
    """The best matches of each heard name, ``position`` from 1."""
    asked = asked_rows(heard, limit).select("query_id", *ASKED)
    found = matches_of(asked.select(*ASKED).distinct(), lexicon, prior_weight)
    return asked.join(found, ASKED).drop("q", "threshold", "most")


def lookup(heard: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Each heard name with the entry of the same norm, if there is one."""
    keyed = heard.withColumn("norm", normalize(F.col("name"))).withColumnRenamed("name", "heard")
    return keyed.join(lexicon.names, ["kind", "norm"], "left")


def probability(heard: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``query_id kind name known probability log_probability plausibility rank sources``.

    Unknown names get probability 0 and the model's plausibility.
    """
    found = lookup(heard, lexicon)
    values = lexicon.meta.groupBy("kind").agg(
        F.max(F.when(F.col("key") == "ngram_median", F.col("value").cast("double"))).alias("median"),
        F.max(F.when(F.col("key") == "ngram_spread", F.col("value").cast("double"))).alias("spread"),
    )
    unknown = found.filter("id is null").select("kind", "norm").distinct()
    model = ngram.plausibility(unknown, ngram.Model(lexicon.grams), values).withColumnRenamed("plausibility", "guess")
    known = F.col("id").isNotNull()
    return found.join(model, ["kind", "norm"], "left").select(
        "query_id",
        "kind",
        F.coalesce("name", "heard").alias("name"),
        known.alias("known"),
        F.coalesce("prob", F.lit(0.0)).alias("probability"),
        F.coalesce("log_prob", F.lit(UNKNOWN_LOG_PROB)).alias("log_probability"),
        F.coalesce("plausibility", "guess").alias("plausibility"),
        F.col("rank_de").alias("rank"),
        F.coalesce("sources", F.lit("")).alias("sources"),
    )


def spellings(lexicon: Lexicon) -> DataFrame:
    """``kind id variants``: the variants of each name that has any, in binary order."""
    return lexicon.variants.groupBy("kind", F.col("surname_id").alias("id")).agg(
        F.array_sort(F.collect_list("name")).alias("variants")
    )


def variants_of(heard: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Each heard name with the variants of the entry of its norm; an empty array if there are none."""
    found = lookup(heard, lexicon).select("query_id", "kind", "id")
    empty = F.array().cast("array<string>")
    return found.join(spellings(lexicon), ["kind", "id"], "left").select(
        "query_id", "kind", F.coalesce("variants", empty).alias("variants")
    )
