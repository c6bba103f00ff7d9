"""Decisions over ranked matches: the best candidate, alternatives, confidence and what to do next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize, spell_out, trim
from .lexicon import Lexicon
from .match import ASKED, LIMIT, THRESHOLD, asked_rows, matches_of, sent, spellings

# Fixed values.
SOFT_FLOOR, NEAR_TIE, CLOSE_SCORES = 0.55, 0.05, 0.02
PULLED, ALTERNATIVES, SPELLINGS = 8, 3, 4
NO_NAME, EMPTY_NAME = "Kein Name erkannt", "name must not be empty"
NO_MATCH, EXACT, PHONETIC, VARIANT = "Kein treffender Name im Lexikon", "Exakter Lexikon-Treffer", "Kölner Phonetik wie ", "Schreibvariante → "
ONE_LETTER, FUZZY = "Fuzzy: 1 Buchstabe", "Fuzzy-Ähnlichkeit zu "
NOT_CONFIGURED, NO_GIVEN = "Vornamen-Lexikon nicht konfiguriert", "given names not configured"

CANDIDATE = "struct<name:string,score:double,confident:boolean,exact:boolean,matchKind:string,spellings:array<string>>"


def match_kind(via: Column, exact: Column, own_spelling: Column) -> Column:
    return (
        F.when(exact, "exact")
        .when(via.isin("phonetic", "skeleton"), "phonetic")
        .when(own_spelling, "variant")
        .otherwise("fuzzy")
    )


def candidate_rows(matches: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Matches as ``candidate`` structs with their kind and spellings."""
    with_variants = matches.join(sent(spellings(lexicon), lexicon), ["kind", "id"], "left").withColumn(
        "variants", F.coalesce("variants", F.array().cast("array<string>"))
    )
    other = F.slice(F.filter("variants", lambda v: v != F.col("name")), 1, SPELLINGS - 1)
    own = F.exists("variants", lambda v: normalize(v) == F.col("norm"))
    shaped = F.struct(
        "name",
        "score",
        "confident",
        "exact",
        match_kind(F.col("matched_via"), F.col("exact"), own).alias("matchKind"),
        F.slice(F.array_distinct(F.concat(F.array("name"), other)), 1, SPELLINGS).alias("spellings"),
    ).cast(CANDIDATE)
    return with_variants.select(*ASKED, "position", "norm", shaped.alias("candidate"))


def follow_up(best: Column, alternatives: Column, needs_human: Column) -> Column:
    n = F.size(alternatives)
    return (
        F.when(needs_human | best.isNull(), "spell_or_human")
        .when(best["exact"] & best["confident"] & (n == 0), "accept")
        .when(n == 0, "confirm_one")
        .when(n == 1, "choose_two")
        .otherwise("choose_few")
    )


def needs_human(best: Column, alternatives: Column, confidence: Column) -> Column:
    first = F.get(alternatives, 0)
    tied = (
        first.isNotNull() & ~best["exact"] & ~best["confident"] & (F.abs(best["score"] - first["score"]) <= NEAR_TIE)
    )
    return best.isNull() | (confidence < SOFT_FLOOR) | F.coalesce(tied, F.lit(False))


def reason(best: Column, query_norm: Column) -> Column:
    gap = F.abs(F.length(query_norm) - F.length(normalize(best["name"])))
    return (
        F.when(best.isNull(), NO_MATCH)
        .when(best["exact"], EXACT)
        .when(best["matchKind"] == "phonetic", F.concat(F.lit(PHONETIC), best["name"]))
        .when(best["matchKind"] == "variant", F.concat(F.lit(VARIANT), best["name"]))
        .when(gap <= 1, ONE_LETTER)
        .otherwise(F.concat(F.lit(FUZZY), best["name"]))
    )


def _best(ranked: Column) -> Column:
    """Among the confident rows within 0.02 of their highest score the longest name, then the first; else the
    first row if it reaches the soft floor. Rows are structs ``position norm candidate`` in order."""
    sure = F.filter(ranked, lambda r: r["candidate"]["confident"])
    top = F.array_max(F.transform(sure, lambda r: r["candidate"]["score"]))
    close = F.filter(sure, lambda r: r["candidate"]["score"] >= top - CLOSE_SCORES)
    longest = F.array_max(F.transform(close, lambda r: F.length(r["candidate"]["name"])))
    chosen = F.get(F.filter(close, lambda r: F.length(r["candidate"]["name"]) == longest), 0)
    first = F.get(ranked, 0)
    soft = F.when(first["candidate"]["score"] >= SOFT_FLOOR, first)
    return F.when(F.size(sure) > 0, chosen).otherwise(soft)


def hydrate(heard: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One decision per heard name.

    ``query_id query kind confidence best alternatives needsHuman followUp hints error``. At least eight matches
    are pulled whatever the limit. Blank names get an error instead, with the name as it came. Each distinct form is decided once.
    """
    raw = F.coalesce("name", F.lit(""))
    cleaned = heard.withColumn("raw", raw).withColumn("name", trim(raw)).withColumn("kind", F.coalesce("kind", F.lit("family")))
    limit = F.coalesce(F.col("limit"), F.lit(LIMIT)) if "limit" in heard.columns else F.lit(LIMIT)
    rows = asked_rows(cleaned, F.greatest(limit, F.lit(PULLED))).select("query_id", "raw", "name", *ASKED)
    asked = rows.filter("q.norm <> ''").select(*ASKED).distinct()
    ranked = (
        candidate_rows(matches_of(asked, lexicon), lexicon)
        .groupBy(*ASKED)
        .agg(F.sort_array(F.collect_list(F.struct("position", "norm", "candidate"))).alias("ranked"))
    )
    variants = F.coalesce("variants", F.array().cast("array<string>"))
    entry = F.struct(
        F.lit(0).alias("position"),
        "norm",
        F.struct(
            "name",
            F.lit(1.0).alias("score"),
            F.lit(True).alias("confident"),
            F.lit(True).alias("exact"),
            F.lit("exact").alias("matchKind"),
            F.slice(F.array_distinct(F.concat(F.array("name"), variants)), 1, SPELLINGS).alias("spellings"),
        )
        .cast(CANDIDATE)
        .alias("candidate"),
    )
    known = lexicon.names.select("kind", "id", "name", "norm").join(spellings(lexicon), ["kind", "id"], "left")
    known = known.select("kind", F.col("norm").alias("known_norm"), entry.alias("entry"))
    empty = F.array().cast(f"array<struct<position:int,norm:string,candidate:{CANDIDATE}>>")
    decided = (
        asked.join(ranked, ASKED, "left")
        .withColumn("known_norm", F.col("q.norm"))
        .join(sent(known, lexicon), ["kind", "known_norm"], "left")
        .withColumn("ranked", F.coalesce("ranked", empty))
        .select(*ASKED, F.coalesce(_best(F.col("ranked")), F.col("entry")).alias("chosen"), "ranked")
    )
    others = F.filter("ranked", lambda r: F.col("chosen").isNull() | (r["norm"] != F.col("chosen.norm")))
    staged = (
        rows.join(decided, ASKED, "left")
        .withColumn("best", F.col("chosen.candidate"))
        .withColumn("alternatives", F.coalesce(F.transform(F.slice(others, 1, ALTERNATIVES), lambda r: r["candidate"]), F.array().cast(f"array<{CANDIDATE}>")))
        .withColumn("confidence", F.coalesce("best.score", F.lit(0.0)))
        .withColumn("needsHuman", needs_human(F.col("best"), F.col("alternatives"), F.col("confidence")))
    )
    blank = F.col("name") == ""
    groups = F.when(F.col("best").isNotNull() & ~F.col("best.exact"), spell_out(F.col("best.name")))
    return staged.select(
        "query_id",
        F.when(blank, F.col("raw")).otherwise(F.col("name")).alias("query"),
        "kind",
        "confidence",
        "best",
        "alternatives",
        "needsHuman",
        follow_up(F.col("best"), F.col("alternatives"), F.col("needsHuman")).alias("followUp"),
        F.struct(
            F.col("q.norm").alias("normalizedQuery"),
            F.col("q.cologne").alias("cologne"),
            F.col("q.skeleton").alias("skeleton"),
            F.when(blank, NO_NAME).otherwise(reason(F.col("best"), F.col("q.norm"))).alias("reasonDe"),
            F.coalesce(groups, F.array().cast("array<string>")).alias("spellOut"),
        ).alias("hints"),
        F.when(blank, EMPTY_NAME).alias("error"),
    )


def suggest(heard: DataFrame, lexicon: Lexicon, limit: int = 3) -> DataFrame:
    """Up to ``limit`` (1 to 5) suggestions per name: the best and its alternatives, four at most."""
    most = min(max(limit, 1), 5)
    found = hydrate(heard, lexicon)
    listed = F.slice(F.array_compact(F.concat(F.array("best"), F.col("alternatives"))), 1, most)
    return found.select("query_id", "query", "kind", listed.alias("suggestions"), "needsHuman", "followUp")


def hydrate_plain(heard: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The older shape: probability, matches, variants and whether a human is needed. Blank names are left out."""
    asked = heard.withColumn("name", trim(F.coalesce("name", F.lit("")))).filter("name <> ''")
    rows = asked_rows(asked).select("query_id", "name", *ASKED)
    struct = F.struct("position", "name", "norm", "score", "similarity", "probability", "rank", "sources", "exact", "matched_via", "confident")
    listed = matches_of(rows.select(*ASKED).distinct(), lexicon).groupBy(*ASKED).agg(F.sort_array(F.collect_list(struct)).alias("matches"))
    known = lexicon.names.select("kind", F.col("norm").alias("known_norm"), F.col("prob").alias("known_prob"))
    joined = (
        rows.withColumn("known_norm", F.col("q.norm"))
        .join(sent(known, lexicon), ["kind", "known_norm"], "left")
        .join(listed, ASKED, "left")
        .withColumn("matches", F.coalesce("matches", F.array().cast(listed.schema["matches"].dataType)))
    )
    sure = F.filter("matches", lambda m: m["confident"])
    human = ~(
        F.col("known_prob").isNotNull()
        | F.exists("matches", lambda m: m["confident"] & m["exact"])
        | F.coalesce(F.get("matches", 0)["confident"], F.lit(False))
    )
    # the variants of the first confident match, else of the name's own entry
    of = lexicon.names.select("kind", "id", F.col("norm").alias("of_norm")).join(spellings(lexicon), ["kind", "id"]).select("kind", "of_norm", "variants")
    origin = joined.withColumn("of_norm", F.coalesce(F.get(sure, 0)["norm"], F.col("q.norm")))
    return origin.join(sent(of, lexicon), ["kind", "of_norm"], "left").select(
        "query_id", "kind", F.col("known_prob").isNotNull().alias("known"), F.coalesce("known_prob", F.lit(0.0)).alias("probability"),
        "matches", F.coalesce("variants", F.array().cast("array<string>")).alias("variants"), human.alias("needsHuman"),
        F.lit(THRESHOLD).alias("threshold"),
    )
