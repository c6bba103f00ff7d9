"""N-gram Jaccard join by parity sketches, complete: no link is lost.

A document is the set of its distinct 5-word shingles (of fewer words, the whole sequence as one), A-Z
lower-cased. Two documents link if their sets' Jaccard similarity is at least 75 percent.

1. Copies. Equal sets are one class from the start, named by 128 bits; only its smallest id takes part.
2. Sketch. Per size band (bands go up by 4) a set is hashed into lanes, half to two shingles a lane; a lane is the XOR of the
   64-bit hashes of its shingles, so it holds their parity. A shingle in one set only changes one lane, so the number of
   lanes that differ is at most the size of the symmetric difference, which for linked sets of sizes ``a`` and
   ``b`` is at most ``d = (a + b) / 7``. Sets up to ``SMALL_SET`` shingles have a lane for each shingle.
3. Pigeonhole join. Each document gives the first ``d + 1`` of its non-empty lanes in one global order; of the lanes two
   linked documents share, the first is then among both. Lanes with a shingle known to be rare come first, those of frequent
   ones last, so a passage that many documents share is rarely given. Known are the counts of half of the shingles, chosen
   by hash, over all documents; they affect the order only. A set that can link into the next band gives lanes there too.
   Where hashing leaves a set no more than ``d`` non-empty lanes, two such sets may differ in all of them; so these sets
   also give their ``d + 1`` first shingles, under keys of their own.
4. Candidates. Lanes are dealt by hash, packed in blocks, and sorted. A pair must show at the first lane it shares, where
   all lanes before it in the order differ, so no pair is made where their number is above the bound. Up to
   ``SMALL_RUN`` documents with one lane are paired. Longer runs link to a hub first; of what is then still in several
   components, members are compared in blocks of ``BLOCK_ROWS`` by their sketches, and only pairs that may link leave.
5. Verify. Each document also has a sketch of single bits, about four to eight per shingle, that hold
   the parity of the shingles hashed to them. Their Hamming distance bounds the symmetric difference from below, so a
   pair whose distance is above the bound is no link. The rest are checked on the exact sets of whole
   texts. Verified links become components by alternating large and small stars.
6. Links. All links lie inside the components. Those of more than two classes are split into blocks of about ``BLOCK_SHINGLES``
   shingles, and each pair of blocks gives its members' exact intersections by matrix products, of which only the number
   of links per member leaves. So a dense group costs a comparison per pair, but never a row per pair.

Edge cases: null, empty and blank texts have no shingles, link with nothing and are their own component. Rows
repeated with one id count as one document, which links as any of its texts does. Null ids link with nothing and have a null
component. Ties do not occur. Very long texts are hashed in chunks. An empty table gives an empty result. Only ``doc_id`` and
``text`` are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._hashing import mix, shingle_set, words
from ._shared import broadcast_if_small, drop, durable, join_spread, lean

#: Similarity in percent.
PERCENT = 75
#: Documents from which a shingle is frequent, and how many of those are known, the most frequent first.
FREQUENT, FREQUENT_ROWS = 8, 1 << 20
#: Shingles that one task of the count sorts at once, and of a shard of the count.
COUNT_CHUNK, COUNT_SHARD = 1 << 21, 1 << 22
#: Sets up to this size have a lane for each shingle.
SMALL_SET = 15
#: Documents with one lane that are paired at once.
SMALL_RUN = 6
#: Lanes of a shard, which one task sorts.
SHARD_LANES = 1 << 18
#: Bytes of packed lanes that a task passes on at once.
BLOCK_BYTES = 4 << 20
#: Members of a run that are compared with as many others at once, and the bits of their folded sketches.
BLOCK_ROWS, FOLDED_BITS = 512, 512
#: Shingles of a block of a component, on average.
BLOCK_SHINGLES = 1 << 17
#: Ids up to which their table is broadcast to pick texts; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000

_BAND_SEED = np.uint64(0xC2B2AE3D27D4EB4F)
_COLLAPSED_SEED = np.uint64(0x165667B19E3779F9)
_ODD = np.uint64(0x2545F4914F6CDD1D)
_LANE_BITS, _LANE_BYTES = np.uint64(48), 6
_STEP = 1 << 16  # lanes whose hashes are held at once


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
    """Ids and shingle sets of a batch with columns ``doc_id text``."""
    step = 256  # texts copied and hashed together
    for at in range(0, len(batch), step):
        part = batch.slice(at, step)
        hashes, begins = words([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()])
        for k, doc in enumerate(part.column(0).to_pylist()):
            yield doc, shingle_set(hashes[begins[k] : begins[k + 1]])


# --- bounds


def most_different(size, other):
    """The most lanes in which linked sets of these sizes differ."""
    return (size + other) * (100 - PERCENT) // (100 + PERCENT)


def most_missing(size, other):
    """The most shingles of a set that are missing in a linked one of size ``other``."""
    return (100 * size - PERCENT * other) // (100 + PERCENT)


def may_link(size_a, place_a, size_b, place_b):
    """Whether sets (numbers or arrays) of these sizes may link if the first lane they share is at these places."""
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    missing = (place_a <= most_missing(size_a, size_b)) & (place_b <= most_missing(size_b, size_a))
    different = np.maximum(place_a, place_b) <= most_different(size_a, size_b)
    return (100 * small >= PERCENT * large) & np.where(large <= SMALL_SET, missing, different)


def _may_link(size_a: Column, place_a: Column, size_b: Column, place_b: Column) -> Column:
    """The same on columns."""
    small, large = F.least(size_a, size_b), F.greatest(size_a, size_b)
    missing = lambda size, place, other: (100 + PERCENT) * place <= 100 * size - PERCENT * other
    different = (100 + PERCENT) * F.greatest(place_a, place_b) <= (100 - PERCENT) * (size_a + size_b)
    both = missing(size_a, place_a, size_b) & missing(size_b, place_b, size_a)
    return (100 * small >= PERCENT * large) & F.when(large <= SMALL_SET, both).otherwise(different)


# --- the global order: counts of half of the shingles


def _counted(found: np.ndarray) -> np.ndarray:
    """Which shingles are counted."""
    return (found & np.uint64(1)).astype(bool)


def _count_key(found: np.ndarray, shards: int) -> np.ndarray:
    """Shard and 32 bits of a counted shingle."""
    return ((found >> np.uint64(33)) % np.uint64(shards)) << np.uint64(32) | (mix(found) >> np.uint64(32))


def _deltas(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers: a byte with the width, then the differences."""
    steps = np.diff(values, prepend=np.uint64(0))
    width = 3 if steps.max() < 1 << 24 else 4
    return bytes([width]) + steps.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def _undo_deltas(block: bytes) -> np.ndarray:
    width = block[0]
    raw = np.zeros((len(block) // width, 4), np.uint8)
    raw[:, :width] = np.frombuffer(block, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(raw.view("<u4")[:, 0], dtype=np.uint64)


def _count_blocks(shards: int):
    def pack(batches):
        held, size = [], 0

        def take():
            keys = np.concatenate(held)
            held.clear()
            keys.sort()
            ends = np.searchsorted(keys, np.arange(shards + 1, dtype=np.uint64) << np.uint64(32))
            used = np.flatnonzero(np.diff(ends))
            blocks = [_deltas(keys[ends[s] : ends[s + 1]] & np.uint64(0xFFFFFFFF)) for s in used]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blocks, pa.binary())], ["shard", "block"])

        for batch in batches:
            for _, found in _sets(batch):
                held.append(_count_key(found[_counted(found)], shards))
                size += len(held[-1])
                if size >= COUNT_CHUNK:
                    yield take()
                    size = 0
        if size:
            yield take()

    return pack


def _count(batches):
    """Rows ``key n``: the frequent shingles of whole shards, from all their blocks."""
    parts: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for shard, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parts.setdefault(shard, []).append(_undo_deltas(block).astype(np.uint32))
    while parts:
        shard, values = parts.popitem()
        held = np.concatenate(values)
        values.clear()
        held.sort()
        # what is there often enough is there again that many places on
        often = np.unique(held[: -(FREQUENT - 1)][held[FREQUENT - 1 :] == held[: -(FREQUENT - 1)]])
        n = np.searchsorted(held, often, "right") - np.searchsorted(held, often)
        key = np.int64(shard) << 32 | often.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])


def frequent_shingles(docs: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of shards, the keys of frequent shingles, sorted, and their frequency classes (1 and up, by powers of 2)."""
    # a word has two bytes at least
    shards = max(1, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 8 // COUNT_SHARD)
    blocks = docs.mapInArrow(lean(_count_blocks(shards)), "shard int, block binary").repartition(shards, "shard")
    rows = blocks.mapInArrow(lean(_count), "key long, n long").orderBy(F.desc("n"), "key").limit(FREQUENT_ROWS).toArrow()
    key = np.array(rows.column(0).to_numpy(), np.int64).view(np.uint64)
    n = np.array(rows.column(1).to_numpy(), np.int64)
    order = np.argsort(key)
    return shards, key[order], np.floor(np.log2(np.maximum(n[order], 1))).astype(np.int8)


# --- sketches


def _band(size: int) -> int:
    return (size.bit_length() - 1) // 2


def _ordered(word: np.ndarray, lane: np.ndarray, cold: np.ndarray, salt: np.uint64, n: int) -> np.ndarray:
    """Keys of the first ``n`` lanes in the global order."""
    key = mix(mix(word + salt) ^ lane * _ODD)
    return key[np.lexsort((key, cold))[:n]]


def band_lanes(found: np.ndarray, rank: np.ndarray, band: int, differ: int) -> tuple[np.ndarray, np.ndarray]:
    """The lanes a set gives in a band, the first ``differ + 1`` in the global order, and its shingles if that are too few.

    ``rank`` is the frequency class of each shingle, 0 for rare ones.
    """
    top = 4 ** (band + 1) - 1
    salt, none = np.uint64((band + 1) * int(_BAND_SEED) % (1 << 64)), found[:0]
    if top <= SMALL_SET:
        return _ordered(found, found, rank, salt, differ + 1), none
    place = mix(found ^ _ODD) & np.uint64((top + 1) // 2 - 1)
    order = np.argsort(place, kind="stable")
    place = place[order]
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    lane, word = place[first], np.bitwise_xor.reduceat(found[order], first)
    cold = np.minimum.reduceat(rank[order], first)  # as rare as its rarest shingle
    given = _ordered(word, lane, cold, salt, differ + 1)
    if len(lane) > differ:
        return given, none
    return given, _ordered(found, found, rank, salt ^ _COLLAPSED_SEED, differ + 1)


def given_lanes(found: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """The lanes a set gives, in runs in order: those of its own band, then those in the next one."""
    size = len(found)
    if not size:
        return []
    band = _band(size)
    top, most = 4 ** (band + 1) - 1, size * 100 // PERCENT
    if top <= SMALL_SET:
        differ = most_missing(size, -(-size * PERCENT // 100))
    else:
        differ = most_different(size, min(most, top))
    lanes = [*band_lanes(found, rank, band, differ)]
    if most > top:  # partners of the next band have more than top
        differ = most_missing(size, top + 1) if 4 * top + 3 <= SMALL_SET else most_different(size, most)
        lanes += band_lanes(found, rank, band + 1, differ)
    return [x for x in lanes if len(x)]


def parity_bits(found: np.ndarray) -> bytes:
    """Bits with the parity of the shingles hashed to each; a power of two of them, at least four per shingle."""
    size = 1 << max(6, (4 * len(found) - 1).bit_length())
    place = (mix(found + _BAND_SEED) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A sketch folded onto its first ``size`` bytes, as 64-bit words."""
    v = np.frombuffer(bits, np.uint64)
    return np.bitwise_xor.reduce(v.reshape(-1, min(len(v), size // 8)), axis=0)


def bit_distance(x: bytes, y: bytes) -> int:
    """The Hamming distance; a longer sketch is folded onto the places of the shorter."""
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


#: A sketch's row: a set's size, 128 bits that name it, the runs of lanes it gives (lengths, and places of their keys in
#: ``lanes``), its bits.
_SKETCH = "doc_id long, n_shingles long, h1 long, h2 long, runs array<int>, lanes binary, bits binary"


def sketches(docs: DataFrame) -> DataFrame:
    often = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs))  # FREQUENT_ROWS at most

    def ranks(found: np.ndarray) -> np.ndarray:
        shards, frequent, classes = often.value
        counted = _counted(found)
        out = np.where(counted, 0, 1).astype(np.int8)  # the unknown after the rare
        if len(frequent):
            key = _count_key(found[counted], shards)
            at = np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)
            out[counted] = np.where(frequent[at] == key, classes[at] + 1, 0)
        return out

    def sketch(batches):
        for batch in batches:
            out, held = ([], [], [], [], [], [], []), 0
            for doc, found in _sets(batch):
                runs = given_lanes(found, ranks(found))
                lanes = np.concatenate(runs) if runs else found
                row = (
                    doc,
                    len(found),
                    int(mix(found ^ _BAND_SEED).sum(dtype=np.uint64).view(np.int64)),
                    int(mix(found + _ODD).sum(dtype=np.uint64).view(np.int64)),
                    [len(x) for x in runs],
                    (lanes >> (np.uint64(64) - _LANE_BITS)).view(np.uint8).reshape(-1, 8)[:, :_LANE_BYTES].tobytes(),
                    parity_bits(found),
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                held += lanes.nbytes + len(found)
                if held > 8 << 20:
                    yield _sketch_batch(out)
                    out, held = ([], [], [], [], [], [], []), 0
            yield _sketch_batch(out)

    return docs.mapInArrow(lean(sketch), _SKETCH)


def _sketch_batch(out) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary())
    names = ["doc_id", "n_shingles", "h1", "h2", "runs", "lanes", "bits"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)


# --- candidates


def _blocks(shards: int):
    """Lanes of sets (``doc_id n_shingles runs lanes``), packed into one row per batch and shard.

    A batch may have millions of lanes; of each only its shard, its set and its places are held, 18 bytes as measured."""

    def pack(batches):
        for batch in batches:
            ids = np.array(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            sizes = np.array(batch.column(1).to_numpy(zero_copy_only=False), np.int64)
            runs = batch.column(2).flatten().to_numpy().astype(np.int64)
            raw = _values(batch.column(3)).reshape(-1, _LANE_BYTES)
            if not len(raw):
                continue
            # a run counts up to where the next begins; places above 65,535 count as that
            place = np.ones(len(raw), np.int32)
            begins = np.cumsum(runs) - runs
            place[0], place[begins[1:]] = 0, 1 - runs[:-1]
            place = np.minimum(np.cumsum(place, dtype=np.int32, out=place), 0xFFFF).astype(np.uint16)
            ends = np.concatenate(([0], np.cumsum(runs)))[batch.column(2).offsets.to_numpy() - batch.column(2).offsets[0].as_py()]
            owner = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(ends))
            shard = np.empty(len(raw), np.int32)
            for at in range(0, len(raw), _STEP):
                shard[at : at + _STEP] = mix(_lanes(raw[at : at + _STEP])) % np.uint64(shards)
            ends = np.cumsum(np.bincount(shard, minlength=shards))
            order = np.argsort(shard, kind="stable")
            del shard
            used, packed, held = [], [], 0
            for k in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
                at = order[ends[k - 1] if k else 0 : ends[k]]
                used.append(k)
                packed.append(_pack(raw[at], ids[owner[at]], sizes[owner[at]], place[at]))
                held += len(packed[-1])
                if held > BLOCK_BYTES:
                    yield _block_batch(used, packed)
                    used, packed, held = [], [], 0
            if used:
                yield _block_batch(used, packed)

    return pack


def _block_batch(shards: list[int], blocks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blocks, pa.binary())], ["shard", "block"])


def _values(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column without nulls, one value after the other, where they lie."""
    at = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    data = column.buffers()[2]
    begin, end = at[column.offset], at[column.offset + len(column)]
    return np.frombuffer(data, np.uint8)[begin:end] if data is not None else np.zeros(0, np.uint8)


def _lanes(raw: np.ndarray) -> np.ndarray:
    """Rows of ``_LANE_BYTES`` bytes as numbers."""
    lane = np.zeros((len(raw), 8), np.uint8)
    lane[:, :_LANE_BYTES] = raw
    return lane.view(np.uint64)[:, 0]


def _pack(raw: np.ndarray, ids: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> bytes:
    """Entries of a block, column by column; ids and sizes in half the width if they fit. Places are 65,535 at most,
    which only makes the bound of those above less sharp."""
    base = int(ids.min())
    narrow = int(ids.max()) - base < 1 << 32 and int(sizes.max()) < 1 << 16
    kinds = (np.uint32, np.uint16) if narrow else (np.uint64, np.uint32)
    head = np.array([len(ids), base if narrow else 0, narrow], np.int64)
    body = (ids - base if narrow else ids).astype(kinds[0]), sizes.astype(kinds[1]), places.astype(np.uint16), raw
    return head.tobytes() + b"".join(x.tobytes() for x in body)


def _unpack(block: bytes) -> tuple[np.ndarray, ...]:
    n, base, narrow = map(int, np.frombuffer(block, np.int64, 3))
    at, out = 24, []
    for kind in (np.uint32, np.uint16, np.uint16) if narrow else (np.uint64, np.uint32, np.uint16):
        out.append(np.frombuffer(block, kind, n, at).astype(np.int64))
        at += out[-1].size * np.dtype(kind).itemsize
    lane = _lanes(np.frombuffer(block, np.uint8, n * _LANE_BYTES, at).reshape(n, _LANE_BYTES))
    return lane, out[0] + base, out[1], out[2]


def _runs(batches):
    """Documents with one lane: pairs of short runs (``run`` null, ``b`` set), members of long ones (``run`` set)."""
    parts: dict[int, list] = {}
    for batch in batches:
        for shard, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parts.setdefault(shard, []).append(block)
    while parts:
        yield from _runs_of([_unpack(x) for x in parts.popitem()[1]])


def _runs_of(parts):
    lane, ids, sizes, places = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    order = np.lexsort((places, ids, lane))
    lane, ids, sizes, places = lane[order], ids[order], sizes[order], places[order]
    new = np.concatenate(([True], (lane[1:] != lane[:-1]) | (ids[1:] != ids[:-1])))  # rows repeated with one id
    lane, ids, sizes, places = lane[new], ids[new], sizes[new], places[new]
    first = np.flatnonzero(np.concatenate(([True], lane[1:] != lane[:-1])))
    length = np.diff(np.append(first, len(lane)))
    pairs = []
    for n in range(2, SMALL_RUN + 1):
        begin = first[length == n]
        for i in range(n):
            for j in range(i + 1, n):
                a, b = begin + i, begin + j
                fits = may_link(sizes[a], places[a], sizes[b], places[b])
                pairs.append(np.stack((ids[a][fits], ids[b][fits])))
    found = np.unique(np.concatenate(pairs, 1), axis=1)
    yield _run_batch(None, found[0], found[1])
    # of runs of the same documents that with the lowest places, which is first in the order of all of them
    lowest: dict[bytes, tuple[int, int, int]] = {}
    for at, n in zip(first[length > SMALL_RUN].tolist(), length[length > SMALL_RUN].tolist(), strict=True):
        digest = mix(ids[at : at + n].view(np.uint64)).sum(dtype=np.uint64).tobytes() + n.to_bytes(8, "little")
        run = int(places[at : at + n].sum()), at, n
        lowest[digest] = min(lowest.get(digest, run), run)
    for _, at, n in lowest.values():
        yield _run_batch(int(lane[at]), ids[at : at + n], None, sizes[at : at + n], places[at : at + n])


def _run_batch(run: int | None, a: np.ndarray, b: np.ndarray | None, *more: np.ndarray) -> pa.RecordBatch:
    """Rows ``run a b size place``: pairs have ``a b``, members of a run all but ``b``."""
    none = pa.nulls(len(a), pa.int64())
    runs = none if run is None else pa.array(np.full(len(a), run), pa.int64())
    columns = [runs, pa.array(a, pa.int64()), none if b is None else pa.array(b, pa.int64())]
    columns += [pa.array(x, pa.int64()) for x in more] or [none, none]
    return pa.RecordBatch.from_arrays(columns, ["run", "a", "b", "size", "place"])


def _open_runs(runs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of runs that are still in several components, with ``component``."""
    if labels is None:
        placed = runs.withColumn("component", F.col("a"))
    else:
        placed = runs.join(labels.select(F.col("id").alias("a"), "component"), "a", "left").withColumn(
            "component", F.coalesce("component", "a")
        )
    spread = placed.groupBy("run").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("members"))
    return durable(placed.join(spread.filter("c0 <> c1").select("run", "members"), "run"), "parity-open")


def _hub_pairs(members: DataFrame) -> DataFrame:
    """Each member of a run with the one that can link with most."""
    hubs = members.groupBy("run").agg(F.min_by(F.struct("a", "component", "size", "place"), F.struct("place", "a")).alias("hub"))
    hub = (F.col(f"hub.{x}").alias(y) for x, y in (("a", "b"), ("component", "c"), ("size", "s"), ("place", "p")))
    fits = _may_link(F.col("size"), F.col("place"), F.col("s"), F.col("p")) & (F.col("component") != F.col("c"))
    pairs = members.join(hubs, "run").select("a", "component", "size", "place", *hub).filter(fits)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _in_block_pairs(rows: DataFrame, group: str, block: Column, blocks: Column) -> DataFrame:
    """Each row once for every pair of blocks that its own is in: columns ``i j`` and ``right``, true in block ``j``."""
    own = rows.withColumn("own", block.cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    return (
        other.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "right": F.col("own") > F.col("other")})
        .drop("own", "other")
        .repartition(group, "i", "j")
        .sortWithinPartitions(group, "i", "j", "right")
    )


def _groups(batches, keys: int) -> Iterator[list[pa.RecordBatch]]:
    """The batches of each group of rows with equal first ``keys`` columns, which rows are sorted by."""
    held, last = [], None
    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([np.array(batch.column(k).to_numpy(), np.int64) for k in range(keys)])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
            if held and tuple(key[:, a]) != last:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(key[:, a])
    if held:
        yield held


def _near_in_blocks(batches):
    """Pairs ``a b`` of a run's members in different components whose places and folded sketches allow a link."""
    for parts in _groups(batches, 3):
        run = pa.Table.from_batches(parts)
        a, component, size, place = (np.array(run.column(c).to_numpy(), np.int64) for c in ("a", "component", "size", "place"))
        right = np.array(run.column("right").to_numpy())
        bits = run.column("bits").to_pylist()
        width = min(FOLDED_BITS // 8, *map(len, bits))
        fold = np.stack([folded(x, width) for x in bits])
        whole = run.column("i")[0] == run.column("j")[0]  # a block with itself
        for k in np.flatnonzero(~right).tolist():
            with_ = np.arange(k + 1, len(a)) if whole else np.flatnonzero(right)
            near = may_link(size[k], place[k], size[with_], place[with_]) & (component[k] != component[with_]) & (a[k] != a[with_])
            with_ = with_[near]
            apart = np.bitwise_count(fold[k] ^ fold[with_]).sum(1, dtype=np.int64)
            b = a[with_[apart * (100 + PERCENT) <= (size[k] + size[with_]) * (100 - PERCENT)]]
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[k], b)), pa.array(np.maximum(a[k], b))], ["a", "b"])


def _block_pairs(members: DataFrame, sketched: DataFrame) -> DataFrame:
    """The pairs ``a b`` of runs that may still link."""
    ids = broadcast_if_small(durable(members.select(F.col("a").alias("doc_id")).distinct(), "parity-ids"), BROADCAST_ROWS)
    bits = sketched.filter("n_shingles > 0").join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("size"), "bits")
    both = members.join(bits, ["a", "size"]).select("run", "a", "component", "size", "place", "bits", "members")
    blocks = F.ceil(F.col("members") / BLOCK_ROWS)
    rows = _in_block_pairs(both, "run", F.pmod(F.xxhash64("a"), blocks), blocks)
    columns = ["run", "i", "j", "right", "a", "component", "size", "place", "bits"]
    return rows.select(*columns).mapInArrow(lean(_near_in_blocks), "a long, b long").distinct()


# --- verification


def exact_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, found`` for the documents in ``ids`` (column ``id``): their exact sets; rows repeated with one id once a task."""

    def sets(batches):
        seen = set()
        for batch in batches:
            out, held = ([], []), 0
            for doc, found in _sets(batch):
                row = doc, len(found), int(mix(found).sum(dtype=np.uint64))
                if row in seen:
                    continue
                seen.add(row)
                out[0].append(doc)
                out[1].append(found.view(np.int64))
                held += found.nbytes
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64()))], ["id", "found"])
                    out, held = ([], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64()))], ["id", "found"])

    picked = docs.join(broadcast_if_small(ids, BROADCAST_ROWS), F.col("doc_id") == F.col("id"), "left_semi")
    return picked.select("doc_id", "text").mapInArrow(lean(sets), "id long, found array<bigint>")


def _close(batches):
    for batch in batches:
        a, b, sizes_a, x, sizes_b, y = (c.to_pylist() for c in batch.columns)
        kept = [
            k
            for k in range(len(a))
            if bit_distance(x[k], y[k]) * (100 + PERCENT) <= (sizes_a[k] + sizes_b[k]) * (100 - PERCENT)
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array([a[k] for k in kept], pa.int64()), pa.array([b[k] for k in kept], pa.int64())], ["a", "b"]
        )


def _ids_of(pairs: DataFrame) -> DataFrame:
    return durable(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "parity-ids")


def close_pairs(sketched: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sketches are near enough for a link; only the sketches of their ids are moved."""
    ids = broadcast_if_small(_ids_of(pairs), BROADCAST_ROWS)
    sized = sketched.filter("n_shingles > 0").join(ids, F.col("doc_id") == F.col("id"), "left_semi").select("doc_id", "n_shingles", "bits")
    left = sized.withColumnsRenamed({"doc_id": "a", "n_shingles": "size_a", "bits": "bits_a"})
    right = sized.withColumnsRenamed({"doc_id": "b", "n_shingles": "size_b", "bits": "bits_b"})
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "size_a", "bits_a", "size_b", "bits_b")
    return both.mapInArrow(lean(_close), "a long, b long").distinct()


def verified(docs: DataFrame, sketched: DataFrame, candidates: DataFrame) -> DataFrame | None:
    """The pairs ``a, b`` of ``candidates`` that link, checked on sketches, then on the exact sets; None for none."""
    pairs = durable(close_pairs(sketched, candidates), "parity-close")
    if not pairs.take(1):
        return None
    sets = durable(exact_sets(docs, _ids_of(pairs)), "parity-sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("found").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("found").alias("y")), "b"
    )
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - F.col("common")
    linked = both.withColumn("common", common).filter(100 * F.col("common") >= PERCENT * union).select("a", "b")
    links = durable(linked.distinct(), "parity-links")
    drop(sets, pairs)
    return links if links.take(1) else None


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for all ids of ``links`` (``a, b``): the smallest id each is connected with."""
    edges = durable(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars"
    )
    before, n = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), "stars")
        large = join_spread(both, least, ["u"], "n", 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable(large.filter("u <> v").distinct(), "stars")
        least_ = durable(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "stars")
        small = join_spread(large, least_, ["u"], "n", 2 * n).select(
            F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")
        )
        after = durable(small.select("e.u", F.col("e.m").alias("v")).filter("u <> v").distinct(), "stars")
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(edges, least, large, least_)
        edges, n = after, now[0]
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now


# --- links


def _links_in_blocks(batches):
    """Rows ``id docs``: the documents that a member links with, of each pair of blocks of a component."""
    for parts in _groups(batches, 3):
        rows = pa.Table.from_batches(parts)
        ids, docs = (np.array(rows.column(c).to_numpy(), np.int64) for c in ("id", "docs"))
        right = np.array(rows.column("right").to_numpy())
        whole = rows.column("i")[0] == rows.column("j")[0]  # a block with itself
        size = np.array(rows.column("size").to_numpy(), np.int64)
        _, once = np.unique(np.stack((ids, size)), axis=1, return_index=True)  # rows repeated with one id
        rows, ids, docs, right = rows.take(once), ids[once], docs[once], right[once]
        at = np.flatnonzero(~right), np.flatnonzero(~right if whole else right)
        if not len(at[0]) or not len(at[1]):
            continue
        sets = [np.asarray(x) for part in rows.column("found").chunks for x in part.to_numpy(zero_copy_only=False)]
        linked = _linked([sets[k] for k in at[0]], [sets[k] for k in at[1]])
        linked &= ids[at[0]][:, None] != ids[at[1]][None, :]
        found = linked @ docs[at[1]]
        yield pa.RecordBatch.from_arrays([pa.array(ids[at[0]]), pa.array(found)], ["id", "docs"])
        if not whole:
            yield pa.RecordBatch.from_arrays([pa.array(ids[at[1]]), pa.array(docs[at[0]] @ linked)], ["id", "docs"])


def _linked(x: list[np.ndarray], y: list[np.ndarray], columns: int = 1 << 12) -> np.ndarray:
    """Which sets of ``x`` link with which of ``y``, by exact intersections: products of 0/1 matrices, some shingles at a time."""
    sizes = [np.array([len(s) for s in side], np.int64) for side in (x, y)]
    owner = [np.repeat(np.arange(len(side)), n) for side, n in zip((x, y), sizes, strict=True)]
    flat = [np.concatenate(side) for side in (x, y)]
    shared = np.intersect1d(flat[0], flat[1])
    common = np.zeros((len(x), len(y)), np.float32)  # exact up to 2**24
    at = [np.searchsorted(shared, v) for v in flat]
    at = [np.where(shared[np.minimum(k, len(shared) - 1)] == v, k, -1) if len(shared) else np.full(len(v), -1) for k, v in zip(at, flat, strict=True)]
    order = [np.argsort(k, kind="stable") for k in at]
    at, owner = [k[o] for k, o in zip(at, order, strict=True)], [w[o] for w, o in zip(owner, order, strict=True)]
    for begin in range(0, len(shared), columns):
        sides = []
        for k, w, side in zip(at, owner, (x, y), strict=True):
            a, b = np.searchsorted(k, (begin, begin + columns))
            m = np.zeros((len(side), min(columns, len(shared) - begin)), np.float32)
            m[w[a:b], k[a:b] - begin] = 1
            sides.append(m)
        common += sides[0] @ sides[1].T
    common = common.astype(np.int64)
    return 100 * common >= PERCENT * (sizes[0][:, None] + sizes[1][None, :] - common)


def link_counts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``id links``: the documents of other classes that each member of a component links with.

    ``members`` has ``component id docs size``: classes by their smallest id, the documents of each and its set's size.
    """
    whole = members.groupBy("component").agg(F.count(F.lit(1)).alias("classes"), F.sum("size").alias("sizes"), F.sum("docs").alias("all"))
    placed = durable(members.join(whole, "component"), "parity-members")
    # of two classes in a component each links with the other
    two = placed.filter("classes = 2").select("id", (F.col("all") - F.col("docs")).alias("links"))
    many = placed.filter("classes > 2").drop("all")
    sets = exact_sets(docs, many.select("id"))
    blocks = F.ceil(F.col("sizes") / BLOCK_SHINGLES)
    both = many.join(sets, "id").filter(F.size("found") == F.col("size"))
    rows = _in_block_pairs(both, "component", F.pmod(F.xxhash64("id"), blocks), blocks)
    found = rows.select("component", "i", "j", "right", "id", "docs", "size", "found").mapInArrow(lean(_links_in_blocks), "id long, docs long")
    return two.unionByName(found.groupBy("id").agg(F.sum("docs").alias("links")))


def link(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, n_links``, the last the number of other documents it links with."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = durable(sketches(docs), "parity-sketches")
    named = sketched.select("doc_id", "n_shingles", "h1", "h2")
    filled = named.filter("n_shingles > 0 and doc_id is not null")
    name = ["h1", "h2", "n_shingles"]
    ids = filled.groupBy(*name, "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    classes = durable(
        ids.groupBy(*name).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("docs"), F.sum("rows").alias("rows")), "parity-classes"
    )
    n_rows = filled.count()
    # of equal sets only the smallest id gives lanes
    copies = join_spread(filled, classes.filter("docs > 1").select(*name, "rep", "rows"), name, "rows", n_rows).filter("doc_id <> rep")
    copies = broadcast_if_small(durable(copies.select("doc_id", *name), "parity-copies"), BROADCAST_ROWS)
    reps = sketched.filter("n_shingles > 0 and doc_id is not null").join(copies, ["doc_id", *name], "left_anti")
    lanes = sketched.agg(F.sum(F.octet_length("lanes"))).first()[0] or 0
    shards = max(1, -(-lanes // _LANE_BYTES // SHARD_LANES))
    blocks = reps.select("doc_id", "n_shingles", "runs", "lanes").mapInArrow(lean(_blocks(shards)), "shard int, block binary")
    found = durable(blocks.repartition(shards, "shard").mapInArrow(lean(_runs), "run long, a long, b long, size long, place long"), "parity-runs")
    runs = found.filter("run is not null").select("run", "a", "size", "place")
    tested = durable(found.filter("run is null").select("a", "b").distinct(), "parity-pairs")
    links = verified(docs, sketched, tested)
    labels = None if links is None else components(links)
    for pairs_of in (_hub_pairs, lambda members: _block_pairs(members, sketched)):
        members = _open_runs(runs, labels)
        if not members.take(1):
            break
        more = durable(pairs_of(members).join(tested, ["a", "b"], "left_anti"), "parity-pairs")
        fresh = verified(docs, sketched, more)
        tested = tested.unionByName(more)
        if fresh is not None:
            # the stars found so far stand for the links found so far
            stars = fresh if labels is None else fresh.unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b")))
            labels = components(stars)
    if labels is None:
        placed = classes.withColumns({"component": F.col("rep"), "links": F.lit(0).cast("long")})
    else:
        everyone = labels.unionByName(labels.select(F.col("component").alias("id"), "component").distinct())
        members = everyone.join(classes, F.col("id") == F.col("rep")).select("component", "id", "docs", F.col("n_shingles").alias("size"))
        counts = durable(link_counts(docs, members), "parity-counts")
        counts = counts.groupBy("id").agg(F.max("links").alias("links"))
        placed = (
            classes.join(everyone.withColumnRenamed("id", "rep"), "rep", "left")
            .join(counts.withColumnRenamed("id", "rep"), "rep", "left")
            .withColumns({"component": F.coalesce("component", "rep"), "links": F.coalesce("links", F.lit(0).cast("long"))})
        )
    placed = durable(placed.select(*name, "component", (F.col("links") + F.col("docs") - 1).alias("n_links"), "rows"), "parity-placed")
    joined = join_spread(filled, placed, name, "rows", n_rows).select("doc_id", "n_shingles", F.col("component").alias("component_id"), "n_links")
    alone = named.filter("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")
    )
    out = durable(joined.unionByName(alone), "parity-links")
    drop(sketched, classes, found, placed)
    return out


def query(docs: DataFrame) -> DataFrame:
    return link(docs)


#: For unique ids: all pairs that share a shingle, and what links reach.
ORACLE = """
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^ \\x09-\\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM texts WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
both_ AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS other FROM sizes UNION SELECT r.id, e.b FROM reach r JOIN both_ e ON r.other = e.a)
SELECT t.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, coalesce(r.component, t.doc_id) AS component_id, coalesce(k.n, 0)::BIGINT AS n_links
FROM texts t LEFT JOIN sizes z USING (doc_id)
LEFT JOIN (SELECT id, min(other) AS component FROM reach GROUP BY id) r ON r.id = t.doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM both_ GROUP BY a) k ON k.a = t.doc_id
"""
