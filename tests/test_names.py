import pytest
from pyspark.sql import functions as F

from lautwerk import Names, build, cologne, core_of, normalize, prefix_of, skeleton, spell_out
from lautwerk.functions.distance import COSTS, blends, edit_costs, jaro_values
from lautwerk.operators import match
from lautwerk.sources import records

UNITS = [
    ("Müller", "mueller", "muler", "657"), ("Muller", "muller", "muler", "657"), ("Schmidt", "schmidt", "smit", "862"),
    ("Schneider", "schneider", "snaider", "8627"), ("Schnyder", "schnyder", "snider", "8627"), ("Meyer", "meyer", "mair", "67"),
    ("Hoffmann", "hoffmann", "hofman", "0366"), ("Schulz", "schulz", "sulz", "858"), ("Fischer", "fischer", "fiser", "387"),
    ("Krüger", "krueger", "kruker", "4747"), ("Szczepański", "szczepanski", "szepanski", "81684"),
    ("Öztürk", "oeztuerk", "ozturk", "08274"), ("Claus", "claus", "klaus", "458"), ("Yannick", "yannick", "ianik", "064"),
    ("Sophie", "sophie", "sofi", "83"), ("Christoph", "christoph", "kristof", "47823"), ("Max", "max", "maks", "648"),
    ("Nguyen", "nguyen", "nkuien", "646"), ("Mustermann", "mustermann", "musterman", "682766"),
]


def test_keys(spark):
    rows = spark.createDataFrame([(u[0],) for u in UNITS], "name string")
    name = F.col("name")
    found = {r[0]: tuple(r)[1:] for r in rows.select(name, normalize(name), skeleton(name), cologne(name)).collect()}
    assert found == {u[0]: u[1:] for u in UNITS}


@pytest.mark.parametrize(
    ("name", "prefix", "core", "norm"),
    [
        ("von der Leyen", "von der", "Leyen", "leyen"), ("de la Cruz", "de la", "Cruz", "cruz"), ("von", "", "von", "von"),
        ("von  der X", "von", "der X", "derx"), ("  Große-Müller ", "", "Große-Müller", "grossemueller"),
        ("Łukasz", "", "Łukasz", "lukasz"), ("Müller", "", "Müller", "muller"), ("O'Brien", "", "O'Brien", "obrien"),
        (" ", "", "", ""),
    ],
)
def test_prefix(spark, name, prefix, core, norm):
    c = F.lit(name)
    assert tuple(spark.range(1).select(prefix_of(c), core_of(c), normalize(c)).first()) == (prefix, core, norm)


def test_null_name(spark):
    null = F.lit(None).cast("string")
    assert tuple(spark.range(1).select(normalize(null), skeleton(null), cologne(null)).first()) == ("", "", "")


@pytest.mark.parametrize(
    ("s", "t", "edit", "jaro", "whole"),
    [
        ("schmit", "schmidt", 1.0, 0.952381, 0.897143), ("muller", "mueller", 1.0, 0.896825, 0.878254),
        ("schnyder", "schneider", 1.4, 0.836640, 0.864583), ("claus", "klaus", 0.4, 0.866667, 0.901333),
        ("jannik", "yannick", 2.0, 0.849206, 0.761508),
    ],
)
def test_distances(s, t, edit, jaro, whole):
    assert [f([s], [t])[0] for f in (edit_costs, jaro_values, blends)] == pytest.approx([edit, jaro, whole], abs=1e-6)


def edit_by_recursion(s, t):
    from functools import lru_cache

    @lru_cache(None)
    def d(i, j):
        if not i or not j:
            return float(i or j)
        a, b = s[i - 1], t[j - 1]
        best = min(d(i - 1, j - 1) + (0 if a == b else COSTS.get(a + b, 1.0)), d(i - 1, j) + 1, d(i, j - 1) + 1)
        if i > 1 and j > 1 and a == t[j - 2] and s[i - 2] == b:
            best = min(best, d(i - 2, j - 2) + 0.7)
        return best

    return d(len(s), len(t))


def jaro_by_hand(s, t):
    if s == t:
        return 1.0
    reach, left, mine = max(max(len(s), len(t)) // 2 - 1, 0), dict(enumerate(t)), []
    for i, c in enumerate(s):
        j = next((j for j in sorted(left) if left[j] == c and abs(i - j) <= reach), None)
        if j is not None:
            del left[j]
            mine.append(c)
    theirs = [c for j, c in enumerate(t) if j not in left]
    m = len(mine)
    return (m / len(s) + m / len(t) + (m - sum(a != b for a, b in zip(mine, theirs)) // 2) / m) / 3 if m else 0.0


def test_distances_by_brute_force():
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeoinmck" if rng.random() < 0.8 else "zyéß日") for _ in range(rng.randrange(12)))
    pairs = [(word(), word()) for _ in range(2000)] + [("", ""), ("a", ""), ("日", "本")]
    s, t = map(list, zip(*pairs))
    assert edit_costs(s, t).tolist() == pytest.approx([edit_by_recursion(a, b) for a, b in pairs])
    assert jaro_values(s, t).tolist() == pytest.approx([jaro_by_hand(a, b) for a, b in pairs])


def test_spelling(spark):
    assert spark.range(1).select(spell_out(F.lit("Becker"))).first()[0] == ["B", "e", "ck", "e", "r"]


@pytest.fixture(scope="module")
def names(spark):
    return Names(spark, build(records.seed_records(spark)).cache())


def test_lexicon(names):
    family = names.lexicon.names.filter("kind = 'family'").orderBy("rank_de").collect()
    assert [r["name"] for r in family[:3]] == ["Müller", "Schmidt", "Schneider"]
    order = [r["name"] for r in family]
    assert order.index("Krüger") < order.index("Nguyen")
    assert sum(r["prob"] for r in family) == pytest.approx(1)
    kept = {(r["surname_id"], r["name"]) for r in names.lexicon.variants.filter("kind = 'family'").collect()}
    assert (1, "Muller") in kept and (1, "Mueller") not in kept


HEARD = [
    ("Schmidt", "family", "Schmidt", False), ("Schmit", "family", "Schmidt", False), ("Mueller", "family", "Müller", False),
    ("Muller", "family", "Müller", False), ("Müller", "family", "Müller", False), ("Schnyder", "family", "Schneider", None),
    ("Nguyen", "family", "Nguyen", False), ("Yildirim", "family", "Yıldırım", None),
    ("Claus", "given", ("Claus", "Klaus"), None), ("Szczepanski", "family", "Szczepański", None), ("Xylophonowitz", "family", None, True), ("asdfgh", "family", None, True),
    (" ", "family", None, True), (None, "family", None, True), ("Mia", "given", "Mia", False), ("Jannik", "given", "Jannik", None),
    ("Xyzzy", "given", None, True),
]


def test_decisions(spark, names):
    rows = [(k, n, kind) for k, (n, kind, _, _) in enumerate(HEARD)]
    heard = spark.createDataFrame(rows, "query_id long, name string, kind string")
    found = {r["query_id"]: r for r in names.hydrate_all(heard).collect()}
    assert len(found) == len(HEARD)
    for k, (name, _, best, human) in enumerate(HEARD):
        r = found[k]
        if best:
            assert r["best"]["name"] in (best if isinstance(best, tuple) else (best,)), name
        if human is not None:
            assert r["needsHuman"] == human, name
    assert found[1]["confidence"] > 0.8
    blank = next(r for r in found.values() if r["query"] == " ")
    assert blank["error"] and blank["hints"]["reasonDe"] == "Kein Name erkannt"


def test_service(names):
    assert any(n.startswith("Sch") for n in names.search("Sch", limit=10)["names"])
    assert len(names.suggest("Schmit", limit=3)["suggestions"]) <= 3
    assert names.stats()["entries"] == 39 and names.stats()["kinds"] == ["family", "given"]
    assert names.health()["ok"]
    assert "Werkzeugfehler" in names.tool("suggest_names", name=" ")


def test_candidate_cap(spark, names):
    heard = match.heard_keys(spark.createDataFrame([(1, "Schmidt", "family")], "query_id long, name string, kind string"))
    ids = [r["id"] for r in match.candidates(heard, names.lexicon, cap=2).orderBy("cand_rank").collect()]
    assert ids == [2, 3]


def test_written_lexicon(spark, names, tmp_path):
    path = names.lexicon.write(str(tmp_path / "lexicon"))
    assert type(names.lexicon).read(spark, path).names.count() == 39


def test_display_name_depends_on_order(spark):
    from lautwerk import merge

    rows = [("family", 1, "Muller", 5.0, "a"), ("family", 2, "Mueller", float("nan"), "b"), ("family", 3, "Müller", 1.0, "a"), ("family", 4, "x", 9.0, "a")]
    df = spark.createDataFrame(rows, "kind string, seq long, name string, count double, source string")
    df = df.withColumns({"origin": F.lit(""), "variants": F.array().cast("array<string>")})
    found = {r["norm"]: r for r in merge(df).collect()}
    assert found["mueller"]["name"] == "Müller" and found["mueller"]["sources"] == "a,b" and found["mueller"]["total"] == 1.0
    assert set(found) == {"muller", "mueller"}


def test_ranks_do_not_depend_on_cells(spark):
    from lautwerk.operators.lexicon import ranked

    names = ["Mueller", "Muller", "Müller", "Oz", "ozan", "Öztürk", "Zimmer", "ßa", "Æb", "aez", "łu", "ðe", "'t", "日本", "Łz", "Ägypten", "a"]
    rows = [("family", n, f"n{k}", float(k % 3), "", "s") for k, n in enumerate(names)]
    df = spark.createDataFrame(rows, "kind string, name string, norm string, total double, origin string, sources string")
    plain = {r["name"]: r["id"] for r in ranked(df).collect()}
    assert {r["name"]: r["id"] for r in ranked(df, ["aez", "Müller", "ßa"]).collect()} == plain
    assert sorted(plain.values()) == list(range(1, len(names) + 1))


def test_calibration_by_index(spark):
    from lautwerk.functions import ngram

    rows = [("family", f"n{k}", x) for k, x in enumerate([-1.0, -2.0, -3.0, -4.0])] + [("given", "a", -2.5)]
    found = {r["kind"]: (r["median"], r["spread"]) for r in ngram.calibrate(spark.createDataFrame(rows, "kind string, norm string, mean_log double")).collect()}
    assert found == {"family": (-2.0, 2.0), "given": (-2.5, 1e-6)}


def test_same_id_with_several_names(spark, names):
    rows = [(2, "Müller", "family"), (2, "Schmit", "family"), (None, "Schmit", "family"), (5, "  ", "family")]
    found = names.hydrate_all(spark.createDataFrame(rows, "query_id long, name string, kind string")).collect()
    assert sorted((r["query"], r["best"]["name"] if r["best"] else None) for r in found) == [("  ", None), ("Müller", "Müller"), ("Schmit", "Schmidt"), ("Schmit", "Schmidt")]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Name,Country_Code,Count\r\n"Müller",de,3\r\nX,fr,2\r\n\r\nY,DE,0\r\n')
    got = records.country_records(spark, str(tmp_path / "a.csv"), "DE", "s").collect()
    assert [(r["name"], r["count"]) for r in got] == [("Müller", 3.0)]
    (tmp_path / "b.csv").write_text("Vorname;Anzahl\nMia;1,5\nMia;2\nNoah;x\n")
    got = records.municipal_records(spark, str(tmp_path / "b.csv"), "s").collect()
    assert [(r["name"], r["count"]) for r in got] == [("Mia", 3.5)]
    (tmp_path / "c.json").write_text('{"Mia": 3, "Noah": {"anzahl": 2}}')
    got = {r["name"]: r["count"] for r in records.json_records(spark, str(tmp_path / "c.json"), "s").collect()}
    assert got == {"Mia": 3.0, "Noah": 2.0}


def test_files_in_parts(spark, tmp_path):
    for k in range(3):
        sep = ";" if k == 1 else ","
        rows = [f"Name{k}x{i}{sep}{i + 1}" for i in range(200)]
        (tmp_path / f"f{k}.csv").write_text("\n\ufeffName" [1:] + f"{sep}Count\n" + "\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = records.municipal_records(spark, str(tmp_path), "s").orderBy("row").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["name"], r["count"]) for r in got] == [(f"Name{k}x{i}", float(i + 1)) for k in range(3) for i in range(200)]


def test_ascii_variants(spark):
    rows = [("Müller", ["Moeller"]), ("Müllér", None), ("Lê Øl", []), ("Plain", []), ("Großmann", [])]
    df = records.with_ascii_variants(spark.createDataFrame(rows, "name string, variants array<string>"))
    found = {r["name"]: r["variants"] for r in df.collect()}
    assert found == {"Müller": ["Moeller", "Mueller"], "Müllér": ["Mueller"], "Lê Øl": ["Le Øl"], "Plain": [], "Großmann": ["Grossmann"]}


def test_sources_in_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,country_code,count\nB,DE,1\nA,DE,2\n")
    sparql = '{"results": {"bindings": [{"itemLabel": {"value": " Zoe "}}, {"itemLabel": {"value": "Q12"}}, {"itemLabel": {"value": ""}}]}}'
    results = spark.createDataFrame([(1, sparql)], "row long, value string")
    found, errors = records.available(
        lambda: records.country_records(spark, str(tmp_path / "a.csv"), "DE", "x"),
        lambda: records.country_records(spark, str(tmp_path / "none.csv"), "DE", "x"),
        lambda: records.sparql_records(results),
        lambda: records.seeds(spark, "given"),
    )
    assert len(found) == 3 and len(errors) == 1
    names = [r["name"] for r in records.union("given", *found).orderBy("seq").collect()]
    assert names == ["B", "A", "Zoe", *(n for n, _, _ in records.GIVEN)]
    package = '{"result": {"resources": [{"format": "csv", "url": "u1", "name": "öffentlich 2020"}, {"format": "CSV", "url": "u2", "name": "zahlen 2019"}, {"format": "pdf", "url": "u3", "name": "zz"}]}}'
    assert spark.range(1).select(records.newest_csv(package)).first()[0] == "u2"


def test_streamed_decisions(spark, names, tmp_path):
    from lautwerk.streaming import hydrate_stream

    spark.createDataFrame([(1, "Schmit", "family"), (2, " ", "family")], "query_id long, name string, kind string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, name string, kind string").parquet(str(tmp_path / "in"))
    got = []
    query = hydrate_stream(stream, names.lexicon, lambda df, n: got.extend(df.collect()), str(tmp_path / "state"), availableNow=True)
    assert query.awaitTermination(120)
    assert {r["query_id"]: r["best"]["name"] if r["best"] else None for r in got} == {1: "Schmidt", 2: None}


def test_plain_hydrate(spark, names):
    from lautwerk import hydrate_plain

    rows = [(1, "Müller", "family"), (2, "Schmit", "family"), (3, "Xylophonowitz", "family")]
    found = {r["query_id"]: r for r in hydrate_plain(spark.createDataFrame(rows, "query_id long, name string, kind string"), names.lexicon).collect()}
    assert found[1]["known"] and found[1]["variants"] == ["Muller"] and not found[1]["needsHuman"]
    assert found[2]["matches"][0]["name"] == "Schmidt" and not found[2]["known"]
    assert found[3]["needsHuman"] and found[3]["matches"] == []


def test_tools_are_bounded(names):
    import json

    assert json.loads(names.tool("search_names", prefix="Sch", limit=3))["kind"] == "family"
    for name, arguments in (("search_names", {"limit": 0}), ("hydrate_name", {"name": "X", "threshold": 2}), ("suggest_names", {"name": "X", "limit": 9}), ("hydrate_name", {"name": "X", "kind": "pet"})):
        assert json.loads(names.tool(name, **arguments))["needsHuman"]
    stats = names.stats()
    assert stats["family"]["entries"] == 31 and stats["given"]["exists"] and stats["threshold_default"] == 0.86
    assert names.health()["entries"] == {"family": 31, "given": 8}


def test_variant_only_and_close_scores(spark):
    """Found by a variant alone, and a chain of close scores: the longest name within 0.02 of the best."""
    from lautwerk.operators.decide import _best

    rows = [("family", 0, "Yıldırım", 800.0, "c", "", ["Jildirim", "Qwrtz"]), ("family", 1, "Meyer", 9000.0, "c", "", [])]
    lex = build(spark.createDataFrame(rows, "kind string, seq long, name string, count double, source string, origin string, variants array<string>"))
    heard = match.heard_keys(spark.createDataFrame([(1, "Qwrtz", "family"), (2, "\u00a0Meyer ", "family")], "query_id long, name string, kind string"))
    found = {(r["query_id"], r["id"]) for r in match.candidates(heard, lex).collect()}
    assert found == {(1, 2), (2, 1)}
    row = lambda at, name, score: f"struct({at} AS position, '{name}' AS norm, struct('{name}' AS name, {score}D AS score, true AS confident) AS candidate)"
    chain = F.expr(f"array({row(1, 'abc', 0.900)}, {row(2, 'abcd', 0.885)}, {row(3, 'abcdefgh', 0.870)})")
    assert spark.range(1).select(_best(chain)["norm"]).first()[0] == "abcd"


def test_jobs(spark, tmp_path):
    from lautwerk.__main__ import main
    from lautwerk.service import TOOLS

    (tmp_path / "f.csv").write_text("name,country_code,count\nÄrmel,DE,90000\n")
    spark.createDataFrame([(1, "Aermel", "family"), (2, "Xyz", "given")], "query_id long, name string, kind string").write.parquet(str(tmp_path / "heard"))
    main(["build", "--family", str(tmp_path / "f.csv"), "--family", str(tmp_path / "missing.csv"), str(tmp_path / "lex")])
    main(["hydrate", str(tmp_path / "lex"), str(tmp_path / "heard"), str(tmp_path / "out")])
    found = {r["query_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found[1]["best"]["name"] == "Ärmel" and found[2]["needsHuman"]
    assert set(TOOLS) == {"hydrate_name", "lexicon_stats", "search_names", "suggest_names"}


def test_family_only(spark):
    only = Names(spark, build(records.union("family", records.seeds(spark, "family"))))
    r = only.hydrate("Mia", kind="given")
    assert r["error"] == "given names not configured" and r["needsHuman"]
    assert only.stats()["given"] == {"exists": False, "db": None, "entries": 0, "variants": 0, "probability_mass": 0.0}


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)


def test_sql_functions(spark):
    from lautwerk import sql

    sql.register(spark, build(records.seed_records(spark)))
    odd = ["von der  Müller-Krüger", "Große", "Łukasz", "", " ", "it's \\ \"x\"", "\u00a0Çelik\u2003", "zu der", "x" * 5000, None]
    rows = spark.createDataFrame([(n,) for n in [u[0] for u in UNITS] + odd], "heard string")
    rows.createOrReplaceTempView("heard_names")
    for name, _, form in sql.FORMS:
        by_sql = spark.sql(f"SELECT heard, {name}(heard) AS value FROM heard_names").collect()
        assert by_sql == rows.select("heard", form(F.col("heard")).alias("value")).collect(), name
    found = spark.sql("SELECT name_edit('schmit', 'schmidt'), name_jaro('muller', 'mueller'), name_similarity('claus', 'klaus'), name_edit(NULL, 'a')")
    assert tuple(found.first()) == pytest.approx((1.0, 0.896825, 0.901333, 1.0), abs=1e-6)


def test_sql_tables(spark):
    from lautwerk import sql

    lexicon = build(records.seed_records(spark))
    sql.register(spark, lexicon)
    heard = [(1, "Schmidt", "family"), (2, "schmidt", "given"), (3, "von Müller", "family"), (4, " ", "family"), (5, None, "family"), (6, "Müller", None)]
    rows = spark.createDataFrame(heard, "query_id int, name string, kind string")
    rows.createOrReplaceTempView("asked_names")
    found = spark.sql("SELECT a.query_id, t.id, t.name FROM asked_names a, LATERAL name_lookup(a.name, a.kind) t ORDER BY 1").collect()
    names = {r["norm"]: (r["id"], r["name"]) for r in lexicon.names.filter("kind = 'family'").collect()}
    assert [tuple(r) for r in found] == [(k, *names[n]) for k, n in ((1, "schmidt"), (3, "mueller")) if n in names]
    assert found
    assert spark.sql("SELECT count(*) FROM lexicon_variants").first()[0] == lexicon.variants.count()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [match.BROADCAST_ROWS, 0])
def test_candidates_stay_where_they_are(spark, names, monkeypatch, limit):
    """No pair of a heard name and a candidate is dealt out again; a lexicon too large to be sent gives the same candidates."""
    rows = [(1, "Schmit", "family"), (1, "Schmit", "family"), (2, "Meier", "family"), (3, "Xq", "given"), (4, "", "family"), (5, "Sofie", "given")]
    heard = match.heard_keys(spark.createDataFrame(rows, "query_id long, name string, kind string"))
    lex = names.lexicon
    held = {(r["kind"], r["id"]): r for r in lex.names.collect()}
    want = []
    for q in heard.collect():
        near = [
            n for n in held.values()
            if n["kind"] == q["kind"] and q["q_norm"] and (
                n["norm"] == q["q_norm"] or n["skeleton"] == q["q_skeleton"] or n["cologne"] == q["q_cologne"]
                or (n["norm"][:3] == q["q_norm"][:3] and abs(len(n["norm"]) - len(q["q_norm"])) <= 2)
            )
        ]
        want += [(q["query_id"], q["kind"], n["id"], k) for k, n in enumerate(sorted(near, key=lambda n: (-n["prob"], n["id"])), 1)]
    monkeypatch.setattr(match, "BROADCAST_ROWS", limit)
    found = match.candidates(heard, lex)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and want
    plan = _plan(found)
    assert "Exchange" not in plan[: plan.index("posexplode")]
