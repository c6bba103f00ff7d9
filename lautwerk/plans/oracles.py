"""The queries that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

from ..functions import distance, ngram, text
from ..operators.match import LENGTH_GAP, MAX_CANDIDATES
from ..sources import records
from .queries import LOW_CAP, STRIDE

TOKENS = r"tokens AS (SELECT lang, source, unnest(regexp_extract_all(coalesce(text, ''), '\p{L}+')) AS name FROM documents)"
WORDS = f"{TOKENS}, words AS (SELECT DISTINCT name FROM tokens)"


def _scalar(expression: str, steps: str = "") -> str:
    return f"WITH {WORDS}{steps} SELECT name, {expression} AS value FROM {'steps' if steps else 'words'}"


_NORM_STEP = f", steps AS (SELECT name, {text.normalize_sql('name')} AS norm FROM words)"
_SPLIT = f"'^({text._PARTICLE}) (.*\\S.*)$'"

_COUNTED = f"""{TOKENS},
counted AS (
  SELECT CASE lang WHEN 'de' THEN 'family' ELSE 'given' END AS kind, source, name, count(*)::DOUBLE AS count
  FROM tokens WHERE lang IN ('de', 'fr') GROUP BY ALL),
keyed AS (SELECT * FROM (SELECT *, {text.normalize_sql("name")} AS norm FROM counted) WHERE length(norm) >= 2),
classed AS (
  SELECT *, row_number() OVER (PARTITION BY kind, norm ORDER BY source, name) AS seq,
    row(length(regexp_replace(name, '[^äöüÄÖÜß]', '', 'g')), length(regexp_replace(name, '[^ıİłŁøØđĐ]', '', 'g')),
        -length(regexp_replace(lower(name), '[^áàâéèêíìîóòôúùûý]', '', 'g')), length(name)) AS class
  FROM keyed),
placed AS (
  SELECT *, class = max(class) OVER (PARTITION BY kind, norm) AS top,
    max(count) OVER (PARTITION BY kind, norm ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM classed),
firsts AS (SELECT *, min(CASE WHEN top THEN seq END) OVER (PARTITION BY kind, norm) AS first_top FROM placed),
merged AS (
  SELECT kind, norm, arg_max(name, seq) FILTER (WHERE top AND (seq = first_top OR count > before)) AS name,
    '' AS origin, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, sum(count) AS total
  FROM firsts GROUP BY kind, norm),
lexicon AS MATERIALIZED (
  SELECT kind, sources, row_number() OVER (PARTITION BY kind ORDER BY total DESC, name COLLATE de, name) AS id, name, norm,
    total / sum(total) OVER (PARTITION BY kind) AS prob FROM merged)"""

_SEEDS = ", ".join(
    f"('{kind}', {k + 1}, '{name}', {count}.0, {list(variants)!r})"
    for kind, seeds in (("family", records.FAMILY), ("given", records.GIVEN))
    for k, (name, count, variants) in enumerate(seeds)
).replace("[]", "[]::VARCHAR[]")
_SEED_NAMES = f"""seeds(kind, seq, name, count, variants) AS (VALUES {_SEEDS}),
normed AS (SELECT *, {text.normalize_sql("name")} AS norm FROM seeds),
names AS MATERIALIZED (
  SELECT kind, (row_number() OVER (PARTITION BY kind ORDER BY count DESC, name COLLATE de, name))::INTEGER AS id, name, norm,
    {text.skeleton_sql("norm")} AS skeleton, {text.cologne_sql("norm")} AS cologne, count / sum(count) OVER (PARTITION BY kind) AS prob,
    CASE name {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in records.ORIGINS.items())} ELSE '' END AS origin, 'curated' AS sources, variants
  FROM normed),
variant AS (SELECT kind, id AS surname_id, unnest(variants) AS name, norm AS key, 'curated' AS source FROM names)"""
_TOKEN_NAMES = f"""{_COUNTED},
names AS MATERIALIZED (
  SELECT kind, id::INTEGER AS id, name, norm, {text.skeleton_sql("norm")} AS skeleton, {text.cologne_sql("norm")} AS cologne, prob,
    '' AS origin, sources FROM lexicon),
spelled AS (
  SELECT kind, norm, source, unnest([regexp_replace(name, '[äöü]', 'e', 'g'), reverse(name)]) AS variant FROM keyed),
variant AS (
  SELECT s.kind, n.id AS surname_id, s.variant AS name, s.norm AS key, max(s.source) AS source
  FROM spelled s JOIN names n ON s.kind = n.kind AND s.norm = n.norm GROUP BY ALL)"""
_VARIANTS = f"""variants_ AS MATERIALIZED (
  SELECT kind, surname_id, name, norm, {text.cologne_sql("norm")} AS cologne, source
  FROM (SELECT *, {text.normalize_sql("name")} AS norm FROM variant) WHERE norm <> '' AND norm <> key)"""
_HEARD = f"""picked AS (
  SELECT c_custkey AS id, n.kind, n.name AS full_ FROM (
    SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'given' ELSE 'family' END AS kind FROM customer) c
  JOIN (SELECT kind, count(*) AS n FROM names GROUP BY kind) s USING (kind)
  JOIN names n ON n.kind = c.kind AND n.id = c_custkey * {STRIDE} % s.n + 1),
cut AS (SELECT *, (id % length(full_) + 1)::BIGINT AS pos FROM picked),
heard AS (
  SELECT id AS query_id, kind, CASE id % 5 WHEN 0 THEN left(full_, pos - 1) || substr(full_, pos + 1)
    WHEN 1 THEN left(full_, pos) || substr(full_, pos, 1) || substr(full_, pos + 1)
    WHEN 2 THEN reverse(full_) ELSE full_ END AS name FROM cut),
q AS MATERIALIZED (
  SELECT *, {text.skeleton_sql("norm")} AS skeleton, {text.cologne_sql("norm")} AS cologne
  FROM (SELECT *, {text.normalize_sql("name")} AS norm FROM heard)),
first_ AS MATERIALIZED (
  SELECT q.query_id, q.kind, n.id, row_number() OVER (PARTITION BY q.query_id ORDER BY n.prob DESC, n.id) AS cand_rank
  FROM q JOIN names n ON q.kind = n.kind AND (q.norm = n.norm OR q.skeleton = n.skeleton OR q.cologne = n.cologne
    OR (left(q.norm, 3) = left(n.norm, 3) AND abs(length(q.norm) - length(n.norm)) <= {LENGTH_GAP}))
  WHERE q.norm <> ''),
second_ AS (
  SELECT query_id, kind, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS cand_rank
  FROM (SELECT DISTINCT q.query_id, q.kind, v.surname_id AS id FROM q JOIN variants_ v
        ON q.kind = v.kind AND (q.norm = v.norm OR q.cologne = v.cologne)
        WHERE q.norm <> '' AND q.query_id NOT IN (SELECT query_id FROM first_)))"""


def _candidates(cap: int) -> str:
    return f"""candidates AS MATERIALIZED (
  SELECT query_id, kind, id, cand_rank::INTEGER AS cand_rank FROM (SELECT * FROM first_ UNION ALL SELECT * FROM second_) WHERE cand_rank <= {cap})"""


def _in(pairs: list[str]) -> str:
    return ", ".join(f"'{p}'" for p in sorted(pairs))


_CHANGE = f"""CASE WHEN a = b THEN 0.0 WHEN a || b IN ({_in([p for p, c in distance.COSTS.items() if c == distance.SOFT])}) THEN {distance.SOFT}
  WHEN a || b IN ({_in([p for p, c in distance.COSTS.items() if c == distance.NEAR])}) THEN {distance.NEAR} ELSE {distance.OTHER} END"""
_CELL = _CHANGE.replace("a || b", "substr(s, i + 1, 1) || substr(t, j, 1)").replace("a = b", "substr(s, i + 1, 1) = substr(t, j, 1)")
#: Rows of the table of prefixes, one after the other; inserting is a running minimum along the row.
_EDITS = f"""pairs AS MATERIALIZED (
  SELECT DISTINCT q.norm AS s, n.norm AS t FROM candidates c JOIN q USING (query_id)
  JOIN names n ON n.kind = c.kind AND n.id = c.id),
rows_ AS (
  SELECT s, t, 0 AS i, NULL::DOUBLE[] AS older, list_transform(range(0, length(t) + 1), lambda j: j::DOUBLE) AS above FROM pairs
  UNION ALL
  SELECT s, t, i + 1, above, list_transform(range(0, length(t) + 1), lambda j: j + list_min(list_slice(row_, 1, j + 1)))
  FROM (SELECT *, list_transform(range(0, length(t) + 1), lambda j: CASE WHEN j = 0 THEN (i + 1)::DOUBLE ELSE least(
      above[j + 1] + 1, above[j] + {_CELL},
      CASE WHEN i > 0 AND j > 1 AND substr(s, i + 1, 1) = substr(t, j - 1, 1) AND substr(s, i, 1) = substr(t, j, 1)
        THEN older[j - 1] + {distance.SWAP} ELSE 1e9 END) - j END) AS row_
    FROM rows_ WHERE i < length(s))),
edits AS MATERIALIZED (SELECT s, t, round(above[length(t) + 1], 9)::DOUBLE AS edit FROM rows_ WHERE i = length(s)),
jaros AS (SELECT s, t, CASE WHEN s = t THEN 1.0 ELSE jaro_similarity(s, t) END AS jaro FROM pairs),
alike AS MATERIALIZED (
  SELECT s, t, edit, jaro, jaro + p * {distance.PREFIX_WEIGHT} * (1 - jaro) AS winkler,
    CASE WHEN s = '' OR t = '' THEN 0.0 WHEN s = t THEN 1.0 ELSE {distance.EDIT_SHARE} * (1 - least(edit / greatest(length(s), length(t)), 1))
      + (1 - {distance.EDIT_SHARE}) * (jaro + p * {distance.PREFIX_WEIGHT} * (1 - jaro)) END AS sim
  FROM (SELECT *, CASE {" ".join(
    f"WHEN least(length(s), length(t)) >= {k} AND left(s, {k}) = left(t, {k}) THEN {k}" for k in (4, 3, 2, 1)
  )} ELSE 0 END AS p FROM edits JOIN jaros USING (s, t)))"""
_MATCHES = """scored AS (
  SELECT c.*, q.name AS query, q.norm AS q_norm, n.name, n.norm, n.prob, n.sources, a.sim, q.norm = n.norm AS exact,
    CASE WHEN q.norm = n.norm THEN 'exact' WHEN q.skeleton = n.skeleton THEN 'skeleton' WHEN q.cologne = n.cologne THEN 'phonetic'
      ELSE 'edit' END AS matched_via,
    floor((0.68::DOUBLE * a.sim + 0.32::DOUBLE * CASE WHEN n.prob > 0 THEN greatest(0.0, least(1.0, (log10(n.prob) + 7) / 7)) ELSE 0.0 END) * 10000 + 0.5) / 10000 AS score
  FROM candidates c JOIN q USING (query_id) JOIN names n ON n.kind = c.kind AND n.id = c.id
  JOIN alike a ON a.s = q.norm AND a.t = n.norm WHERE a.sim >= 0.86::DOUBLE - 0.15::DOUBLE),
matches AS MATERIALIZED (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_rank))::INTEGER AS position,
    exact OR sim >= 0.86 AS confident FROM scored)"""
_DECIDED = """vs AS MATERIALIZED (SELECT kind, surname_id AS id, list_sort(list(name)) AS variants FROM variants_ GROUP BY ALL),
cand AS MATERIALIZED (
  SELECT m.*, CASE WHEN exact THEN 'exact' WHEN matched_via IN ('phonetic', 'skeleton') THEN 'phonetic' ELSE 'fuzzy' END AS match_kind,
    list_prepend(m.name, list_slice(list_filter(coalesce(vs.variants, []), lambda v: v <> m.name), 1, 3)) AS spellings
  FROM matches m LEFT JOIN vs USING (kind, id) WHERE position <= 8),
sure AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM cand WHERE confident),
champion AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(name) DESC, position) AS r FROM sure
                 WHERE score >= top - 0.02::DOUBLE) WHERE r = 1),
soft AS (SELECT * FROM cand WHERE position = 1 AND score >= 0.55 AND query_id NOT IN (SELECT query_id FROM champion)),
chosen AS (
  SELECT query_id, name, norm, score, exact, confident, match_kind, spellings FROM champion UNION ALL
  SELECT query_id, name, norm, score, exact, confident, match_kind, spellings FROM soft),
best AS MATERIALIZED (
  SELECT * FROM chosen UNION ALL
  SELECT q.query_id, n.name, n.norm, 1.0, true, true, 'exact', list_prepend(n.name, list_slice(coalesce(vs.variants, []), 1, 3))
  FROM q JOIN names n ON q.kind = n.kind AND q.norm = n.norm LEFT JOIN vs ON vs.kind = n.kind AND vs.id = n.id
  WHERE q.query_id NOT IN (SELECT query_id FROM chosen)),
alternatives AS (
  SELECT query_id, list(name ORDER BY position) AS others, arg_min(score, position) AS next_score
  FROM (SELECT c.*, row_number() OVER (PARTITION BY query_id ORDER BY position) AS r
        FROM cand c LEFT JOIN best b USING (query_id) WHERE b.norm IS NULL OR c.norm <> b.norm)
  WHERE r <= 3 GROUP BY query_id),
judged AS (
  SELECT q.query_id, q.name AS query, q.kind, q.norm AS q_norm, coalesce(b.score, 0.0)::DOUBLE AS confidence, b.name AS best, b.norm AS best_norm,
    b.match_kind, b.exact, b.confident, b.spellings, coalesce(a.others, []) AS others,
    b.name IS NULL OR b.score < 0.55 OR (a.others IS NOT NULL AND NOT b.exact AND NOT b.confident AND abs(b.score - a.next_score) <= 0.05::DOUBLE) AS needs_human
  FROM q LEFT JOIN best b USING (query_id) LEFT JOIN alternatives a USING (query_id)),
hydrated AS MATERIALIZED (
  SELECT *, CASE WHEN needs_human OR best IS NULL THEN 'spell_or_human' WHEN exact AND confident AND len(others) = 0 THEN 'accept'
      WHEN len(others) = 0 THEN 'confirm_one' WHEN len(others) = 1 THEN 'choose_two' ELSE 'choose_few' END AS follow_up,
    CASE WHEN best IS NULL THEN 'Kein treffender Name im Lexikon' WHEN exact THEN 'Exakter Lexikon-Treffer'
      WHEN match_kind = 'phonetic' THEN 'Kölner Phonetik wie ' || best WHEN abs(length(q_norm) - length(best_norm)) <= 1 THEN 'Fuzzy: 1 Buchstabe'
      ELSE 'Fuzzy-Ähnlichkeit zu ' || best END AS reason,
    CASE WHEN best IS NOT NULL AND NOT exact THEN array_to_string(regexp_extract_all(best, '(sch|ch|ck|tz|ie|ei|eu|äu|ue|oe|ae|.)', 1, 'is'), '·') ELSE '' END AS spell_out
  FROM judged)"""


def _model(source: str, kept: str = "") -> str:
    """Steps that give ``{source}_mean`` (``kind norm mean_log``) of the distinct forms in ``{source}``; ``kept`` filters the counts."""
    weight = " ".join(f"WHEN {n} THEN {w}" for n, w in enumerate(ngram.WEIGHTS, 1))
    return f"""{source}_grams AS (
  SELECT kind, norm, n, i, substr(repeat('^', n - 1) || norm || '$', i, n) AS gram
  FROM (SELECT *, unnest(range(1, length(norm) + 2)) AS i FROM {source}, range(1, {ngram.MAX_ORDER} + 1) r(n)) WHERE n <= length(norm) + 1),
{source}_kept AS (SELECT * FROM counts {kept}),
{source}_terms AS (
  SELECT g.kind, g.norm, g.i, CASE g.n {weight} END * (coalesce(c.count, 0) + 1)::DOUBLE
    / (CASE WHEN g.n = 1 THEN coalesce(z.total, 0) ELSE coalesce(x.count, 0) END + coalesce(z.vocabulary, 2)) AS term
  FROM {source}_grams g LEFT JOIN {source}_kept c ON c.kind = g.kind AND c.n = g.n AND c.gram = g.gram
  LEFT JOIN {source}_kept x ON x.kind = g.kind AND x.n = g.n - 1 AND x.gram = left(g.gram, g.n - 1)
  LEFT JOIN sizes z ON z.kind = g.kind),
{source}_mean AS MATERIALIZED (
  SELECT kind, norm, avg(ln(greatest(p, {ngram.FLOOR}))) AS mean_log
  FROM (SELECT kind, norm, i, sum(term) AS p FROM {source}_terms GROUP BY ALL) GROUP BY ALL)"""


_COUNTS = f"""counts AS MATERIALIZED (
  SELECT kind, n, gram, sum(weight)::BIGINT AS count FROM (
    SELECT kind, n, weight, substr(repeat('^', n - 1) || norm || '$', i, n) AS gram FROM (
      SELECT *, unnest(range(1, length(norm) + 2)) AS i FROM (
        SELECT kind, norm, greatest(1, floor(1000 / id::DOUBLE + 0.5))::BIGINT AS weight FROM names), range(1, {ngram.MAX_ORDER} + 1) r(n))) GROUP BY ALL),
sizes AS (SELECT kind, sum(count) AS total, greatest(count(*) + 2, 2) AS vocabulary FROM counts WHERE n = 1 GROUP BY kind),
forms AS (SELECT kind, norm FROM names)"""
_CALIBRATED = f"""{_COUNTS}, {_model("forms")},
ordered AS (SELECT kind, list_sort(list(mean_log)) AS m FROM forms_mean GROUP BY kind),
calibration AS MATERIALIZED (
  SELECT kind, m[floor(0.5 * len(m))::BIGINT + 1] AS median, greatest(m[floor(0.5 * len(m))::BIGINT + 1] - m[floor(0.05 * len(m))::BIGINT + 1], 1e-6) AS spread
  FROM ordered)"""
_PLAUSIBLE = f"1 / (1 + exp(-{ngram.STEEPNESS}::DOUBLE * greatest(least((mean_log - median) / spread, {ngram.CLAMP}), -{ngram.CLAMP})))"


def _matching(names: str, prefix: str = "") -> dict[str, str]:
    base = f"WITH RECURSIVE {names}, {_VARIANTS}, {_HEARD}, {_candidates(MAX_CANDIDATES)}"
    matched = f"{base}, {_EDITS}, {_MATCHES}"
    decided = f"{matched}, {_DECIDED}"
    found = {
        "candidates": f"{base} SELECT * FROM candidates",
        "candidates_capped": f"WITH {names}, {_VARIANTS}, {_HEARD}, {_candidates(LOW_CAP)} SELECT * FROM candidates",
        "match_topk": f"""{matched} SELECT query_id, kind, position, id, name, norm, score, floor(sim * 10000 + 0.5) / 10000 AS similarity,
          round(prob, 12) AS probability, id AS rank, sources, exact, matched_via, confident FROM matches WHERE position <= 5""",
        "lookup": f"""WITH {names}, {_VARIANTS}, {_HEARD} SELECT q.query_id, q.kind, q.name AS heard, q.norm, n.name, n.id
          FROM q LEFT JOIN names n ON q.kind = n.kind AND q.norm = n.norm""",
        "probability": f"""WITH {names}, {_VARIANTS}, {_HEARD}, {_CALIBRATED},
          unknown AS (SELECT DISTINCT kind, norm FROM q WHERE norm <> '' AND (kind, norm) NOT IN (SELECT (kind, norm) FROM names)),
          {_model("unknown", "WHERE count >= 2 OR n <= 2")}
          SELECT q.query_id, q.kind, coalesce(n.name, q.name) AS name, n.id IS NOT NULL AS known, round(coalesce(n.prob, 0.0), 9) AS probability,
            round(CASE WHEN n.id IS NULL THEN -50.0 ELSE log10(greatest(n.prob, 1e-12)) END, 9) AS log_probability,
            round(CASE WHEN q.norm = '' THEN 0.0 ELSE (SELECT {_PLAUSIBLE} FROM calibration c WHERE c.kind = q.kind) END, 9) AS plausibility,
            n.id AS rank, coalesce(n.sources, '') AS sources
          FROM q LEFT JOIN names n ON q.kind = n.kind AND q.norm = n.norm
          LEFT JOIN (SELECT * FROM forms_mean UNION ALL SELECT * FROM unknown_mean) m ON m.kind = q.kind AND m.norm = q.norm""",
        "variants_of": f"""WITH {names}, {_VARIANTS}, {_HEARD}, v AS (
            SELECT kind, surname_id, string_agg(name, '|' ORDER BY name) AS variants FROM variants_ GROUP BY ALL)
          SELECT q.query_id, q.kind, coalesce(v.variants, '') AS variants FROM q
          LEFT JOIN names n ON q.kind = n.kind AND q.norm = n.norm
          LEFT JOIN v ON v.kind = n.kind AND v.surname_id = n.id""",
        "suggest": f"""{decided} SELECT query_id, query, kind, follow_up,
          array_to_string(list_slice(CASE WHEN best IS NULL THEN others ELSE list_prepend(best, others) END, 1, 3), '|') AS suggestions FROM hydrated""",
        "hydrate_plain": f"""{decided},
          five AS (SELECT query_id, count(*) AS n, bool_or(exact AND confident) AS sure_exact, arg_min(confident, position) AS first_sure,
            arg_min(norm, position) FILTER (WHERE confident) AS sure_norm FROM matches WHERE position <= 5 GROUP BY query_id)
          SELECT q.query_id, q.kind, n.id IS NOT NULL AS known, coalesce(f.n, 0)::INTEGER AS n,
            coalesce(array_to_string(vs.variants, '|'), '') AS variants, NOT (n.id IS NOT NULL OR coalesce(sure_exact, false) OR coalesce(first_sure, false)) AS needs_human
          FROM q LEFT JOIN names n ON q.kind = n.kind AND q.norm = n.norm LEFT JOIN five f USING (query_id)
          LEFT JOIN names o ON o.kind = q.kind AND o.norm = coalesce(f.sure_norm, q.norm) LEFT JOIN vs ON vs.kind = o.kind AND vs.id = o.id""",
        "hydrate": f"""{decided} SELECT query_id, query, kind, confidence, best, match_kind, array_to_string(spellings, '|') AS spellings,
          array_to_string(others, '|') AS alternatives, needs_human, follow_up, reason, spell_out FROM hydrated""",
        "follow_up_histogram": f"{decided} SELECT kind, follow_up, count(*) AS n FROM hydrated GROUP BY ALL",
    }
    return {prefix + name: sql for name, sql in found.items()}


def _pairs(value: str) -> str:
    return f"WITH RECURSIVE {_TOKEN_NAMES}, {_VARIANTS}, {_HEARD}, {_candidates(MAX_CANDIDATES)}, {_EDITS} SELECT s, t, round({value}, 9) AS value FROM alike"


def _names(names: str) -> str:
    return f"""WITH {names}, {_CALIBRATED} SELECT n.kind, id, name, n.norm, skeleton, cologne, length(n.norm)::INTEGER AS length,
      round(prob, 9) AS prob, round(log10(greatest(prob, 1e-12)), 9) AS log_prob, round({_PLAUSIBLE}, 9) AS plausibility, id AS rank_de, origin, sources
      FROM names n JOIN forms_mean m ON m.kind = n.kind AND m.norm = n.norm JOIN calibration c ON c.kind = n.kind"""


def _calibration(names: str) -> str:
    return f"""WITH {names}, {_CALIBRATED} SELECT kind, 'ngram_median' AS key, round(median, 9) AS value FROM calibration
      UNION ALL SELECT kind, 'ngram_spread', round(spread, 9) FROM calibration"""


def oracle_sql() -> dict[str, str]:
    return {
        "normalize_tokens": _scalar(text.normalize_sql("name")),
        "skeleton_keys": _scalar(text.skeleton_sql("norm"), _NORM_STEP),
        "cologne_keys": _scalar(text.cologne_sql("norm"), _NORM_STEP),
        "spell_out": _scalar("array_to_string(regexp_extract_all(name, '(sch|ch|ck|tz|ie|ei|eu|äu|ue|oe|ae|.)', 1, 'is'), '|')"),
        "split_prefix": f"""WITH b AS (
            SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), '\\p{{L}}+ \\p{{L}}+')) AS name FROM documents)
          SELECT name, lower(regexp_extract(name, {_SPLIT}, 1, 'is')) AS prefix,
            CASE WHEN regexp_matches(name, {_SPLIT}, 'is') THEN regexp_extract(name, {_SPLIT}, 2, 'is') ELSE name END AS core FROM b""",
        "merge_records": f"WITH {_COUNTED} SELECT * FROM merged",
        "lexicon_rank": f"""WITH {_COUNTED} SELECT kind, id, name, norm, round(prob, 12) AS prob,
          round(log10(greatest(prob, 1e-12)), 9) AS log_prob FROM lexicon""",
        "ngram_counts": f"""WITH {_COUNTED},
          w AS (SELECT kind, norm, greatest(1, floor(1000 / id::DOUBLE + 0.5))::BIGINT AS weight FROM lexicon),
          g AS (SELECT kind, n, weight, repeat('^', n - 1) || norm || '$' AS padded, length(norm) AS size FROM w, range(1, 5) r(n)),
          e AS (SELECT kind, n::INTEGER AS n, weight, substr(padded, i, n) AS gram FROM (SELECT *, unnest(range(1, size + 2)) AS i FROM g))
          SELECT kind, gram, n, sum(weight)::BIGINT AS count FROM e GROUP BY ALL""",
        "list_head": f"""WITH {_COUNTED} SELECT name, norm, round(prob, 12) AS prob FROM lexicon WHERE kind = 'family'
          ORDER BY lexicon.prob DESC, name LIMIT 100""",
        "search_prefix": f"""WITH {_COUNTED},
          head AS (SELECT * FROM lexicon WHERE kind = 'family' ORDER BY prob DESC, name LIMIT 5000),
          hits AS (SELECT *, row_number() OVER (ORDER BY prob DESC, name) AS i FROM head WHERE starts_with(norm, 'sch'))
          SELECT 'Sch' AS prefix, coalesce(string_agg(name, '|' ORDER BY i) FILTER (WHERE i <= 50), '') AS names,
            least(count(*), 50)::INTEGER AS count, count(*)::INTEGER AS total, count(*) > 50 AS truncated FROM hits""",
        "strip_accents": _scalar(text.strip_accents_sql("name")),
        "merged_variants": f"""WITH {_TOKEN_NAMES}, {_VARIANTS}
          SELECT v.kind, n.norm, v.name AS variant, v.source FROM variants_ v JOIN names n ON n.kind = v.kind AND n.id = v.surname_id""",
        "seed_variants": f"WITH {_SEED_NAMES}, {_VARIANTS} SELECT * FROM variants_",
        "lexicon_variants": f"WITH {_TOKEN_NAMES}, {_VARIANTS} SELECT * FROM variants_",
        "seed_names": _names(_SEED_NAMES),
        "lexicon_names": _names(_TOKEN_NAMES),
        "seed_calibration": _calibration(_SEED_NAMES),
        "ngram_calibration": _calibration(_TOKEN_NAMES),
        "weighted_edit": _pairs("edit"),
        "jaro": _pairs("jaro"),
        "jaro_winkler": _pairs("winkler"),
        "similarity": _pairs("sim"),
        **_matching(_TOKEN_NAMES),
        **_matching(_SEED_NAMES, "seed_"),
        "lexicon_stats": f"""WITH {_SEED_NAMES}, {_VARIANTS} SELECT n.kind, n.entries, n.probability_mass, coalesce(v.variants, 0) AS variants, 4 AS licenses
          FROM (SELECT kind, count(*) AS entries, floor(sum(prob) * 1e6 + 0.5) / 1e6 AS probability_mass FROM names GROUP BY kind) n
          LEFT JOIN (SELECT kind, count(*) AS variants FROM variants_ GROUP BY kind) v USING (kind)""",
    }
