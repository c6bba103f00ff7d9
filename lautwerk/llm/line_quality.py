r"""Quality rules: cross-document line frequency within hosts.

Lines are normalised (outer white space off, inner runs to one space, lower case) and hashed to
64 bits. Per host (``source``) each line's distinct documents are counted, documents of equal text as one, so
that copies of one text do not make its own lines look like boilerplate. A line above the host's
limit, ``max(min_docs, max_share * distinct documents of the host)``, is removed; ``clean`` returns the texts without them. A document
that keeps less than ``min_kept_percent`` percent of its words is depleted and rejected. In hosts of more than
``min_docs / max_share`` distinct texts the limit is a share, so it acts alike at any size.

Base rules come first, per document: too few words, or too many words inside repeated 3-word windows.

The counting shuffles one row per distinct line of a document, first keyed by line and document, so a
line that a third of all documents hold is spread; then partial sums meet per line. Word windows
are compared inside the row by sorting their hashes, so no word is ever shuffled.

Edge cases: a null text has no words and no lines; empty and blank texts fail the base rules. Null hosts
are one host. Rows repeated with one id and text are one document each but count once. Ties do not
occur, as nothing is ranked. An empty table gives an empty result. Only ``doc_id text source`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SEPARATOR_CHARS, broadcast_if_small, durable, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCS = 10
MAX_SHARE = 0.01
MIN_KEPT_PERCENT = 50
#: Common lines, or hosts, up to which their table is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 50_000
#: Windows of a text up to which hash and place are packed into one long.
PACKED_WINDOWS = 1 << 20
#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"


def window_hashes(tokens: Column) -> Column:
    """A 64-bit hash for each 3-word window, in order."""
    last = F.size(tokens) - 3
    hashes = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)),
    )
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(hashes)


def repeat_words(hashes: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, the first occurrence included.

    Takes ``window_hashes``. Most texts have no equal windows, which a set of the hashes shows at once.
    Else the hashes are sorted with their places, packed into longs if the text is short enough; places
    equal to a neighbour, sorted again, cover ``min(3, gap to the next)`` words each.
    """
    return (
        F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0))
        .when(F.size(hashes) < PACKED_WINDOWS, _covered(_repeated_packed(hashes)))
        .otherwise(_covered(_repeated_pairs(hashes)))
    )


def _once(x: Column, f) -> Column:
    """``f(x)`` with ``x`` computed once, as a lambda's variable."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _repeated_packed(hashes: Column) -> Column:
    # 44 bits of the hash and the place; neighbours that agree are compared by their full hashes
    packed = F.transform(hashes, lambda h, i: h.bitwiseAND(-PACKED_WINDOWS).bitwiseOR(i.cast("bigint")))

    def places(ordered: Column) -> Column:
        place = lambda x: x.bitwiseAND(PACKED_WINDOWS - 1).cast("int")

        def same(x: Column, other: Column) -> Column:
            near = x.bitwiseXOR(other).bitwiseAND(-PACKED_WINDOWS) == 0
            return F.coalesce(near & (F.get(hashes, place(x)) == F.get(hashes, place(other))), F.lit(False))

        hit = F.filter(ordered, lambda x, i: same(x, F.get(ordered, i + 1)) | same(x, F.get(ordered, i - 1)))
        return F.sort_array(F.transform(hit, place))

    return _once(F.sort_array(packed), places)


def _repeated_pairs(hashes: Column) -> Column:
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def places(ordered: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
        hit = F.filter(ordered, lambda x, i: same(x, i + 1) | same(x, i - 1))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    return _once(F.sort_array(pairs), places)


def _covered(places: Column) -> Column:
    def total(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    return _once(places, total)


def normal_lines(text: Column) -> Column:
    """Each line of a text, blank ones included, normalised."""
    spaced = text
    for c in "\t\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    single = F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " {2,}", " ")).otherwise(spaced)
    return F.transform(F.split(F.lower(single), "\n"), lambda x: F.trim(x))


def without_lines(text: Column, hashes: Column) -> Column:
    """A text without the lines whose normalised form has one of the ``hashes``."""
    left = F.zip_with(F.split(text, "\n"), normal_lines(text), lambda x, n: F.when(~F.array_contains(hashes, F.xxhash64(n)), x))
    return F.array_join(F.filter(left, lambda x: x.isNotNull()), "\n")


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id source text_hash``, the base figures and ``lines``, an array of ``struct<h, n>``:
    the hash of each normalised line and its words. The only step of ``judge`` that reads texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    normal = F.filter(normal_lines(text), lambda x: x != "")
    n_spaces = lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit("")))
    filled = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SEPARATOR_CHARS)) != "")
    return (
        docs.select(
            "doc_id",
            "source",
            F.xxhash64(text).alias("text_hash"),
            words(F.col("text")).alias("w"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            filled.alias("filled"),
            F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("h"), (n_spaces(x) + 1).alias("n"))).alias("lines"),
        )
        .withColumn("hashes", window_hashes(F.col("w")))
        .select(
            "doc_id",
            "source",
            "text_hash",
            F.size("w").cast("long").alias("n_words"),
            F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
            "n_symbols",
            (F.size("filled") - F.size(F.array_distinct("filled"))).cast("long").alias("n_dup_lines"),
            repeat_words(F.col("hashes")).cast("long").alias("n_repeat_words"),
            "lines",
        )
    )


def common_lines(rows: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """The lines above their host's limit, ``line_host, line_hash``, from ``measured`` rows."""
    counts = (
        rows.select("source", "text_hash", F.explode("lines.h").alias("line"))
        .distinct()
        .groupBy("source", "line")
        .agg(F.count(F.lit(1)).alias("docs"))
    )
    hosts = (
        rows.select(F.col("source").alias("host"), "text_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all_docs"))
    )
    hosts = broadcast_if_small(durable(hosts, "hosts"), BROADCAST_ROWS)  # else a host's frequent lines meet in one task
    frequent = counts.filter(F.col("docs") > min_docs)
    above = frequent.join(hosts, F.col("source").eqNullSafe(F.col("host"))).filter(
        F.col("docs") > F.greatest(F.lit(float(min_docs)), F.lit(max_share) * F.col("all_docs"))
    )
    return above.select(F.col("source").alias("line_host"), F.col("line").alias("line_hash"))


def judge(
    docs: DataFrame,
    *,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    min_kept_percent: int = MIN_KEPT_PERCENT,
) -> DataFrame:
    """One row per document: the base figures, ``base_failed``, ``removed_words``, ``removed_lines`` (the hashes of
    its lines above the limit, null for none) and ``kept``."""
    rows = durable(measured(docs), "line-quality")
    common = broadcast_if_small(durable(common_lines(rows, min_docs, max_share), "common-lines"), BROADCAST_ROWS)
    removed = (
        rows.select("doc_id", "source", "text_hash", F.posexplode("lines").alias("at", "line"))
        .join(common, F.col("source").eqNullSafe(F.col("line_host")) & (F.col("line.h") == F.col("line_hash")))
        .dropDuplicates(["doc_id", "source", "text_hash", "at"])  # of rows repeated whole, one
        .groupBy(F.col("doc_id").alias("r_id"), F.col("source").alias("r_source"), F.col("text_hash").alias("r_hash"))
        .agg(F.sum("line.n").alias("removed"), F.collect_set("line.h").alias("removed_lines"))
    )
    joined = (
        rows.drop("lines")
        .join(
            removed,
            F.col("doc_id").eqNullSafe(F.col("r_id"))
            & F.col("source").eqNullSafe(F.col("r_source"))
            & (F.col("text_hash") == F.col("r_hash")),
            "left",
        )
        .drop("r_id", "r_source", "r_hash")
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return (
        joined.withColumn("removed_words", F.coalesce("removed", F.lit(0)).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (100 * left >= min_kept_percent * F.col("n_words")))
        .drop("removed")
    )


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The documents that are kept, all columns, with ``text`` freed of the lines above the limit."""
    judged = judge(docs, **limits).filter("kept").select("doc_id", "source", "text_hash", "removed_lines").distinct()
    names = {"doc_id": "__id", "source": "__source", "text_hash": "__hash", "removed_lines": "__removed"}
    same = (
        F.col("doc_id").eqNullSafe(F.col("__id"))
        & F.col("source").eqNullSafe(F.col("__source"))
        & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__hash"))
    )
    left = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("__removed")))
    return docs.join(judged.withColumnsRenamed(names), same).withColumn("text", left).select(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"
    )


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+')"
_TRIM = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
#: ``{docs}`` is the relation that is judged.
JUDGE_SQL = f"""
texts AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM {{docs}}),
word_rows AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM texts),
windows_ AS (
  SELECT doc_id, i, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM word_rows
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
repeats AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows_ WHERE c IS NOT NULL)
  WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM repeats, range(3) r(k) GROUP BY doc_id),
raw_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM texts),
dup_lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM raw_lines
  WHERE trim(l, {_TRIM}) <> '' GROUP BY doc_id),
lines_ AS (
  SELECT doc_id, source, text, lower(regexp_replace(trim(l, {_TRIM}), '[ \\x09-\\x0D]+', ' ', 'g')) AS l
  FROM (SELECT *, unnest(string_split(text, chr(10))) AS l FROM texts)),
counts AS (SELECT source, l, count(DISTINCT text) AS docs FROM lines_ WHERE l <> '' GROUP BY source, l),
hosts AS (SELECT source, count(DISTINCT text) AS all_docs FROM texts GROUP BY source),
common AS (
  SELECT c.source, c.l FROM counts c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
  WHERE docs > greatest({MIN_DOCS}, {MAX_SHARE}::DOUBLE * all_docs)),
removed AS (
  SELECT doc_id, sum(len(string_split(x.l, ' '))) AS removed FROM lines_ x
  JOIN common c ON x.source IS NOT DISTINCT FROM c.source AND x.l = c.l GROUP BY doc_id),
stats AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(removed, 0)::BIGINT AS removed_words
  FROM texts t LEFT JOIN covered USING (doc_id) LEFT JOIN dup_lines USING (doc_id) LEFT JOIN removed USING (doc_id)),
failed AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM stats),
judged AS (
  SELECT *, NOT base_failed AND 100 * (n_words - removed_words) >= {MIN_KEPT_PERCENT} * n_words AS kept FROM failed)
"""
ORACLE = f"""WITH {JUDGE_SQL.format(docs="documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, kept FROM judged"""
