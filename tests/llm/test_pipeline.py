import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lautwerk.llm import importance, line_quality, mixing, piece_codec

from .test_operators import DOCS, WORDS, components, text

COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    base = [text(rng, 90, 5000) for _ in range(40)]
    near = [" ".join([*b.split()[:85], f"changed{k}"]) for k, b in enumerate(base[:10])]
    texts = [*base, *near, *base[5:8], None, "", "too short", "rep it now " * 60]
    texts += ["a common line of a host\n" + text(rng, 60, 5000) for _ in range(15)]
    rows = [(k, t, "en", None if k % 13 == 0 else f"s{k % 3}", len(t or ""), 1) for k, t in enumerate(texts)]
    rows += [rows[12], rows[12], (14, text(rng, 70, 5000), "en", "s1", 0, 1), (None, text(rng, 70, 5000), "en", "s1", 0, 1)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).write.parquet(str(path / "documents.parquet"))
    labels = [(k, int(k % 5 > 0), 0) for k in range(0, 60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def as_rows(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def test_stages_by_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    kept = corpus_pipeline.quality_rules(spark, docs, folder)
    # rules: by hand from the base rules and the lines of each host
    lines, texts = {}, {}
    for r in docs.collect():
        texts.setdefault(r["source"], set()).add(r["text"] or "")
    for source, group in texts.items():
        for t in group:
            for line in {" ".join(x.split()).lower() for x in t.split("\n")} - {""}:
                lines[source, line] = lines.get((source, line), 0) + 1
    want = Counter()
    for r in docs.collect():
        t = r["text"] or ""
        w = WORDS.findall(t)
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        limit = max(line_quality.MIN_DOCS, line_quality.MAX_SHARE * len(texts[r["source"]]))
        left = [x for x in t.split("\n") if lines.get((r["source"], " ".join(x.split()).lower()), 0) <= limit]
        n = len(WORDS.findall("\n".join(left)))
        if len(w) >= 50 and 2 * len(covered) <= len(w) and 100 * n >= line_quality.MIN_KEPT_PERCENT * len(w):
            clean = "\n".join(left)
            want[r["doc_id"], clean, r["lang"], r["source"], len(clean)] += 1
    assert as_rows(kept) == want and kept.columns == COLUMNS

    before, kept = kept, corpus_pipeline.quality_classifier(spark, kept, folder)
    judged = importance.classify(before, spark.read.parquet(f"{folder}/labels.parquet"), carry={"t": F.col("text")}).filter("kept")
    ids = {(r["doc_id"], r["t"]) for r in judged.collect()}
    assert as_rows(kept) == Counter({k: n for k, n in as_rows(before).items() if k[:2] in ids})

    before, kept = kept, corpus_pipeline.near_duplicates(spark, kept, folder)
    rows = [r for r in as_rows(before).elements() if r[0] is not None]
    linked = components(rows)  # of rows with one id the last; no id of several texts links here
    found = as_rows(kept)
    assert {r[0] for r in found if r[0] is not None} == {d for d, (_, c, _) in linked.items() if c == d}
    assert all(n == 1 for r, n in found.items()) and not found - as_rows(before)
    assert len([r for r in found if r[0] is None]) == len([r for r in as_rows(before) if r[0] is None])

    before, kept = kept, corpus_pipeline.source_mixing(spark, kept, folder)
    taken = mixing.mix(before).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t")).collect()
    sizes = Counter()
    for r in kept.collect():
        sizes[r["source"]] += len(WORDS.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert {r["source"]: r["n"] for r in taken if r["n"]} == dict(sizes)
    assert all(r["n"] == round(r["t"]) for r in taken)

    pytest.importorskip("public_tokenizers")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())
    out = corpus_pipeline.piece_encoding(spark, kept, folder).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out) == Counter((r["doc_id"], tuple(model.encode(r["text"]))) for r in kept.collect())


def test_run(spark, folder, tmp_path):
    pytest.importorskip("public_tokenizers")
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "source", "n_pieces", "ids"] and out.count() > 10
    ids = {r["doc_id"] for r in out.collect()}
    assert not ids & {53, 54, 55, 56} and not {40, 41, 42, 50, 51, 52} & ids  # rejected texts, copies
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_of_odd_rows(spark, folder):
    rows = [(None, None, None, None, None, None), (1, None, "en", None, 0, 1), (1, "x", None, "s", 1, 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("size", "k_id")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        n = out.count()
        assert n <= 3 if name != "source_mixing" else n <= 6
        assert out.columns == COLUMNS or name == "piece_encoding"


def test_workers_give_back_what_they_freed():
    """A worker that has ended a task holds about what it held before, not the task's most."""
    import multiprocessing

    with multiprocessing.get_context("spawn").Pool(1) as pool:
        before, after = pool.apply(_held)
    assert after - before < 20 << 20


def _held():
    import os

    import pyarrow as pa

    from lautwerk.llm._shared import lean

    def pages():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    def step(batches):
        for batch in batches:
            many, last = [bytes(1000) for _ in range(200_000)], bytes(1000)  # noqa: F841: freed below what stays
            kept.append(last)
            yield batch

    kept, before = [], pages()
    for _ in lean(step)(iter([pa.RecordBatch.from_arrays([pa.array([1])], ["x"])])):
        pass
    return before, pages()


def _most(step, batch):
    """The most bytes that a step holds at once beside its input, and what it gives."""
    import gc
    import tracemalloc

    gc.collect()
    tracemalloc.start()
    try:
        n, out = 0, step(iter([batch]))
        for rows in out:
            n += rows.num_rows
            del rows
        return tracemalloc.get_traced_memory()[1], n
    finally:
        tracemalloc.stop()


def test_lanes_are_dealt_in_little_memory():
    """A worker of near_duplicates holds about 18 bytes for each lane of a batch beside its input, where it held 70."""
    import numpy as np
    import pyarrow as pa

    from lautwerk.llm import parity_join

    rng = np.random.default_rng(5)
    runs = rng.integers(1, 400, (5000, 2))
    raw = [rng.bytes(6 * int(n)) for n in runs.sum(1)]
    columns = [np.arange(7, 5007), runs.sum(1), pa.array(runs.tolist(), pa.list_(pa.int32())), pa.array(raw, pa.binary())]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "n_shingles", "runs", "lanes"])
    lanes = int(runs.sum())
    assert _most(parity_join._blocks(40), batch)[0] < 40 * lanes
    # all lanes are there once, also of a slice
    want = Counter()
    for k in range(100, 300):
        places = [*range(runs[k, 0]), *range(runs[k, 1])]
        for j, place in enumerate(places):
            want[int.from_bytes(raw[k][6 * j : 6 * j + 6], "little"), k + 7, len(places), place] += 1
    found, shards = Counter(), {}
    for out in parity_join._blocks(40)(iter([batch.slice(100, 200)])):
        for shard, block in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
            rows = list(zip(*(x.tolist() for x in parity_join._unpack(block)), strict=True))
            found.update(rows)
            assert all(shards.setdefault(r[0], shard) == shard for r in rows)
    assert found == want


def test_texts_are_copied_some_at_a_time():
    import pyarrow as pa

    from lautwerk.llm import parity_join

    batch = pa.RecordBatch.from_arrays([pa.array(range(20_000)), pa.array(["word " * 400] * 20_000)], ["doc_id", "text"])  # 40 MB

    def step(batches):
        for b in batches:
            for _ in parity_join._sets(b):
                pass
            yield b

    assert _most(step, batch)[0] < 40_000_000


def test_frequent_shingles_are_counted_in_little_memory():
    import numpy as np
    import pyarrow as pa

    from lautwerk.llm import parity_join

    rng = np.random.default_rng(6)
    value = np.sort(np.concatenate((rng.integers(0, 1 << 32, 1_000_000), np.repeat(rng.integers(0, 1 << 32, 1000), rng.integers(2, 30, 1000)))))
    batch = pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), pa.array([parity_join._deltas(value.astype(np.uint64))])], ["shard", "block"])
    kinds, n = np.unique(value, return_counts=True)
    many = n >= parity_join.FREQUENT
    rows = pa.Table.from_batches(parity_join._count(iter([batch])))
    assert dict(zip(rows["key"].to_pylist(), rows["n"].to_pylist(), strict=True)) == dict(zip((kinds[many] + (3 << 32)).tolist(), n[many].tolist(), strict=True))
    few = batch.slice(0, 0), pa.RecordBatch.from_arrays([batch.column(0), pa.array([parity_join._deltas(value[:5].astype(np.uint64))])], batch.schema.names)
    assert [r.num_rows for b in few for r in parity_join._count(iter([b]))] == [0]


def test_codec_keeps_no_cache_after_its_task(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string").repartition(1)
    piece_codec.coded(docs, piece_codec.model_path()).collect()

    def held(batches):
        import pyarrow as pa

        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(t.units) + len(t.joints) for t in piece_codec._transducers.values())])], ["n"])

    # workers are used again, so those that coded are among these
    assert {r["n"] for r in spark.range(8, numPartitions=8).mapInArrow(held, "n long").collect()} == {0}
