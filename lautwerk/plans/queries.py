"""Named queries over the driver's tables. Tokens of German documents are the family names, those of French ones the
given names. The queries that match names or compare pairs use this lexicon; what was heard are its names as customers
misspell them, letters lost, doubled or in reverse. ``seed_`` queries do the same with the seeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ngram, text
from ..functions.distance import jaro, jaro_winkler, similarity, weighted_edit
from ..operators import browse, decide, lexicon, match
from ..operators.lexicon import Lexicon
from ..sources import records
from ..storage import durable

KINDS = {"de": "family", "fr": "given"}
TOKEN = r"\p{L}+"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its language and source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("lang", "source", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), 0)).alias("name"))


def token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per kind, source and word. Its place among the records is the pair of source and word, which
    orders them without numbering all."""
    counted = (
        tokens(spark, sf_dir)
        .filter(F.col("lang").isin(*KINDS))
        .groupBy("lang", "source", "name")
        .agg(F.count(F.lit(1)).cast("double").alias("count"))
    )
    kind = F.when(F.col("lang") == "de", "family").otherwise("given")
    return counted.select(
        kind.alias("kind"), F.struct("source", "name").alias("seq"), "name", "count", "source",
        F.lit("").alias("origin"), F.array(F.regexp_replace("name", "[äöü]", "e"), F.reverse("name")).alias("variants"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).select("name").distinct()


def token_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.ranked(lexicon.merge(token_records(spark, sf_dir)))


_opened: dict[tuple[str, str], Lexicon] = {}


def _kept(spark: SparkSession, name: str, make: Callable[[], Lexicon]) -> Lexicon:
    """A lexicon that is built and kept once per application."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _opened:
        for old in [k for k in _opened if k[0] != key[0]]:
            del _opened[old]
        _opened[key] = make().cache()
    return _opened[key]


def seed_lexicon(spark: SparkSession, sf_dir: str = "") -> Lexicon:
    return _kept(spark, "seeds", lambda: lexicon.build(records.seed_records(spark)))


def open_lexicon(spark: SparkSession, sf_dir: str) -> Lexicon:
    """The lexicon of the documents' tokens."""
    return _kept(spark, sf_dir, lambda: lexicon.build(token_records(spark, sf_dir)))


def misheard(spark: SparkSession, sf_dir: str, lex: Lexicon) -> DataFrame:
    """One name per customer, who takes the lexicon's names in turn and may lose or double a letter, or reverse the name."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("query_id"))
    sizes = lex.names.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))  # one row per kind
    kind = F.when(F.col("query_id") % 4 == 0, "given").otherwise("family")
    picked = rows.withColumn("kind", kind).join(F.broadcast(sizes), "kind").withColumn("id", F.col("query_id") * STRIDE % F.col("n") + 1)
    full = lex.names.select("kind", F.col("id").cast("long").alias("id"), F.col("name").alias("full"))
    named = picked.join(match.sent(full, lex), ["kind", "id"])
    at = F.col("query_id") % F.length("full") + 1
    left, right = F.left("full", at - 1), F.substr(F.col("full"), at + 1)
    letter = F.substr(F.col("full"), at, F.lit(1))
    how = F.col("query_id") % 5
    name = (
        F.when(how == 0, F.concat(left, right)).when(how == 1, F.concat(left, letter, letter, right))
        .when(how == 2, F.reverse("full")).otherwise(F.col("full"))
    )
    return named.select("query_id", name.alias("name"), "kind")


#: Step in which customers go through the names.
STRIDE = 101


def name_pairs(spark: SparkSession, sf_dir: str, lex: Lexicon) -> DataFrame:
    """Heard norms with those of their candidates. A kind has each norm once, so only norms heard in several kinds can repeat a pair."""
    forms = match.asked_rows(misheard(spark, sf_dir, lex)).groupBy("q").agg(F.collect_set("kind").alias("kinds"))  # few kinds
    forms = durable(forms, "heard")
    names = match.sent(lex.names.select("kind", "id", F.col("norm").alias("t")), lex)

    def pairs(some: DataFrame) -> DataFrame:
        keys = some.select("q", F.explode("kinds").alias("kind")).repartition(match.parts_of(some), "q")
        return match.key_candidates(keys, lex).join(names, ["kind", "id"]).select(F.col("q.norm").alias("s"), "t")

    return pairs(forms.filter("size(kinds) = 1")).unionByName(pairs(forms.filter("size(kinds) > 1")).distinct())


def _flat(found: DataFrame) -> DataFrame:
    return found.select(
        "query_id", "query", "kind", "confidence", F.col("best.name").alias("best"), F.col("best.matchKind").alias("match_kind"),
        F.array_join("best.spellings", "|").alias("spellings"), F.array_join("alternatives.name", "|").alias("alternatives"),
        F.col("needsHuman").alias("needs_human"), F.col("followUp").alias("follow_up"), F.col("hints.reasonDe").alias("reason"),
        F.array_join("hints.spellOut", "·").alias("spell_out"),
    )


def hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = open_lexicon(spark, sf_dir)
    return _flat(decide.hydrate(misheard(spark, sf_dir, lex), lex))


#: A cap that many heard names reach.
LOW_CAP = 8


def _matching(opened: Callable[[SparkSession, str], Lexicon], prefix: str = "") -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries that match names, against one lexicon."""

    def asked(f):
        def run(spark, sf_dir):
            lex = opened(spark, sf_dir)
            return f(misheard(spark, sf_dir, lex), lex)

        return run

    def suggestions(h, x):
        found = decide.suggest(h, x)
        return found.select("query_id", "query", "kind", F.array_join("suggestions.name", "|").alias("suggestions"), F.col("followUp").alias("follow_up"))

    def plain(h, x):
        found = decide.hydrate_plain(h, x)
        return found.select("query_id", "kind", "known", F.size("matches").alias("n"), F.array_join("variants", "|").alias("variants"), F.col("needsHuman").alias("needs_human"))

    found = {
        "candidates": asked(lambda h, x: match.candidates(match.heard_keys(h), x)),
        "candidates_capped": asked(lambda h, x: match.candidates(match.heard_keys(h), x, LOW_CAP)),
        "match_topk": asked(lambda h, x: match.match(h, x).withColumn("probability", F.round("probability", 12))),
        "lookup": asked(lambda h, x: match.lookup(h, x).select("query_id", "kind", "heard", "norm", "name", "id")),
        "probability": asked(lambda h, x: match.probability(h, x).withColumns({c: F.round(c, 9) for c in ("probability", "log_probability", "plausibility")})),
        "variants_of": asked(lambda h, x: match.variants_of(h, x).withColumn("variants", F.array_join("variants", "|"))),
        "suggest": asked(suggestions),
        "hydrate_plain": asked(plain),
        "hydrate": asked(lambda h, x: _flat(decide.hydrate(h, x))),
        "follow_up_histogram": asked(lambda h, x: _flat(decide.hydrate(h, x)).groupBy("kind", "follow_up").agg(F.count(F.lit(1)).alias("n"))),
    }
    return {prefix + name: query for name, query in found.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def scalar(form):
        return lambda s, d: words(s, d).select("name", form(F.col("name")).alias("value"))

    def pairs(form):
        return lambda s, d: name_pairs(s, d, open_lexicon(s, d)).select("s", "t", F.round(form(F.col("s"), F.col("t")), 9).alias("value"))

    def names_of(lex):
        return lex.names.withColumns({c: F.round(c, 9) for c in ("prob", "log_prob", "plausibility")})

    return {
        **_matching(open_lexicon),
        **_matching(seed_lexicon, "seed_"),
        "normalize_tokens": scalar(text.normalize),
        "strip_accents": scalar(text.strip_accents),
        "split_prefix": lambda s, d: _bigrams(s, d).select("name", text.prefix_of(F.col("name")).alias("prefix"), text.core_of(F.col("name")).alias("core")),
        "skeleton_keys": scalar(text.skeleton),
        "cologne_keys": scalar(text.cologne),
        "spell_out": lambda s, d: words(s, d).select("name", F.array_join(text.spell_out(F.col("name")), "|").alias("value")),
        "weighted_edit": pairs(weighted_edit),
        "jaro": pairs(jaro),
        "jaro_winkler": pairs(jaro_winkler),
        "similarity": pairs(similarity),
        "merge_records": lambda s, d: lexicon.merge(token_records(s, d)),
        "merged_variants": lambda s, d: lexicon.merged_variants(token_records(s, d)),
        "lexicon_rank": lambda s, d: token_lexicon(s, d).select("kind", "id", "name", "norm", F.round("prob", 12).alias("prob"), F.round("log_prob", 9).alias("log_prob")),
        "ngram_counts": lambda s, d: ngram.train(token_lexicon(s, d)),
        "ngram_calibration": lambda s, d: _calibration(open_lexicon(s, d)),
        "seed_calibration": lambda s, d: _calibration(seed_lexicon(s)),
        "lexicon_names": lambda s, d: names_of(open_lexicon(s, d)),
        "lexicon_variants": lambda s, d: open_lexicon(s, d).variants,
        "seed_names": lambda s, d: names_of(seed_lexicon(s)),
        "seed_variants": lambda s, d: seed_lexicon(s).variants,
        "list_head": lambda s, d: browse.list_names(open_lexicon(s, d), "family", 100).select("name", "norm", F.round("prob", 12).alias("prob")),
        "search_prefix": lambda s, d: browse.search(open_lexicon(s, d), "family", "Sch", 50).withColumn("names", F.array_join("names", "|")),
        "lexicon_stats": lambda s, d: browse.stats(seed_lexicon(s)).select("kind", "entries", "probability_mass", "variants", F.size("licenses").alias("licenses")),
    }


def _bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\p{L}+ \p{L}+"), 0)).alias("name")).distinct()


def _calibration(lex: Lexicon) -> DataFrame:
    values = lex.meta.filter(F.col("key").isin("ngram_median", "ngram_spread"))
    return values.select("kind", "key", F.round(F.col("value").cast("double"), 9).alias("value"))
