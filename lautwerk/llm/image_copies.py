"""Media columns: cropped or edited copies of images found by local descriptors.

Images are binary columns in PGM (``P5``, 8 bits). Each is smoothed and brought to several scales, ``SCALES``. Corners are local
maxima of the Harris response of a level; each gets the direction of its patch's intensity centroid and 256 binary tests turned
by it, so brightness, contrast, noise, cropping, turning and resizing leave most descriptors nearly as they are.

Hamming tables: a descriptor is ``TABLES`` words of 32 bits; descriptors that agree in a word are compared, and match within
a Hamming distance of ``DISTANCE``. All pairs within a distance of ``TABLES - 1`` are found for certain, those beyond with
a chance that falls with the distance. Levels aren't told apart, so an image meets its resized copy.

Consensus: each match proposes a turn, a scale and a shift, by its directions, levels and places; a match agrees if its own
direction and level do and its place is where the proposal puts it, within a tolerance that grows with the distance from the proposing
corner. An image is a copy if ``INLIERS`` distinct corners of either image agree with one proposal.

Images of equal bytes are one class, named by its smallest id; only classes are described, once, where they lie. The query
set is dealt into blocks of about ``BLOCK`` corners, and the tables of one block at a time are sent to all tasks, which return
the copies found. So no corner is shuffled, a word that many images share is no hot key, and what a task holds is bounded by
the block and by ``VOTES``. No word, match or image is left out; only the number of corners per level is limited, strongest first.

Edge cases: null, empty and broken images, and such as are too small for a patch, have no corners and match nothing; null ids are
in no class. Rows repeated with one id are one image if their bytes are equal. Ties of the response are broken by place.
Empty tables give empty results. Only the two named columns are read.

The tables hold no images, so the query draws one from each embedding: the sum of 64 fixed smooth textures, weighted by its numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import durable, join_spread, table

#: Levels: the factor by which an image is made smaller, and the most corners of each.
SCALES, FEATURES = (1.0, 2**0.5, 2.0, 2**1.5), (32, 28, 24, 20)
RADIUS, TESTS = 8, 256
TABLES = TESTS // 32
#: Most bits by which matching descriptors differ.
DISTANCE = 28
INLIERS = 5
#: By how much an agreeing match's direction, level and place may differ: radians, a factor, pixels of the level, and a share
#: of the distance from the proposing corner.
TURN, RATIO, SHIFT, SLACK = 0.45, 1.5, 3.0, 0.12
#: Query corners whose tables are sent to the tasks at once, class corners looked up at once, and matches held at once.
BLOCK, PACK, VOTES = 1 << 17, 1 << 14, 1 << 18
#: Pixels that are described together.
PIXELS = 1 << 18
DIRECTIONS = 32

_rng = np.random.default_rng(20)
_radius = RADIUS * np.sqrt(_rng.random((TESTS, 2)))
_angle = _rng.random((TESTS, 2)) * 2 * np.pi
_turn = (np.arange(DIRECTIONS) * 2 * np.pi / DIRECTIONS)[:, None, None]
#: Per direction and test the two places, as (dy, dx).
_PLACES = np.rint(np.stack((_radius * np.sin(_angle + _turn), _radius * np.cos(_angle + _turn)), -1)).astype(np.int32)
_MARGIN = RADIUS + 1
_GRID = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = np.hypot(*_GRID) <= RADIUS


def to_pgm(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + pixels.clip(0, 255).astype(np.uint8).tobytes()


def from_pgm(data: bytes | None) -> np.ndarray | None:
    try:
        kind, size, depth, body = (data or b"").split(b"\n", 3)
        w, h = map(int, size.split())
        if kind != b"P5" or depth != b"255" or len(body) != w * h:
            return None
        return np.frombuffer(body, np.uint8).reshape(h, w)
    except ValueError:
        return None


def _along(x: np.ndarray, axis: int, weights: tuple[float, ...]) -> np.ndarray:
    """A symmetric filter along an axis, edges repeated."""
    reach = len(weights) // 2
    pad = [(0, 0)] * x.ndim
    pad[axis] = (reach, reach)
    p = np.pad(x, pad, mode="edge")
    n = x.shape[axis]
    return sum(w * p.take(range(k, k + n), axis) for k, w in enumerate(weights))


def smooth(x: np.ndarray) -> np.ndarray:
    weights = (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)
    return _along(_along(x, -1, weights), -2, weights)


def shrink(x: np.ndarray, scale: float) -> np.ndarray:
    """Images (the last two axes) made smaller: pixel ``k`` is what lies at ``scale * k``, between neighbours in proportion."""
    for axis in (-1, -2):
        at = np.arange(int((x.shape[axis] - 1) / scale) + 1) * scale
        low = np.minimum(at.astype(np.int64), x.shape[axis] - 1)
        part = (at - low).astype(np.float32).reshape((-1,) + (1,) * (-1 - axis))
        x = x.take(low, axis) * (1 - part) + x.take(np.minimum(low + 1, x.shape[axis] - 1), axis) * part
    return x


def _corners(level: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Image, y and x of the strongest corners of a stack of levels that leave room for a patch."""
    dy, dx = np.gradient(level, axis=(1, 2))
    a, b, c = (smooth(v) for v in (dx * dx, dy * dy, dx * dy))
    response = a * b - c * c - 0.05 * (a + b) ** 2
    inner = response[:, _MARGIN:-_MARGIN, _MARGIN:-_MARGIN]
    h, w = inner.shape[1:]
    around = [response[:, _MARGIN + i : _MARGIN + i + h, _MARGIN + j : _MARGIN + j + w] for i in (-1, 0, 1) for j in (-1, 0, 1)]
    peak = (inner >= np.max(around, axis=0)) & (inner > 1e-4 * np.maximum(response.max((1, 2), keepdims=True), 1.0))
    image, y, x = np.nonzero(peak)
    order = np.lexsort((x, y, -inner[image, y, x], image))
    image, y, x = image[order], y[order], x[order]
    kept = np.arange(len(image)) - np.searchsorted(image, image) < most
    return image[kept], y[kept] + _MARGIN, x[kept] + _MARGIN


def _described(images: np.ndarray) -> tuple[np.ndarray, ...]:
    """Corners of a stack of images of one size: image, scale, y, x (in pixels of the whole image), direction, words."""
    out = []
    base = smooth(images.astype(np.float32))
    for scale, most in zip(SCALES, FEATURES, strict=True):
        level = base if scale == 1 else shrink(base if scale < 2 else smooth(base), scale)
        if min(level.shape[1:]) <= 2 * _MARGIN + 2:
            break
        image, y, x = (v.astype(np.int32) for v in _corners(level, most))
        level = smooth(level)
        patch = level[image[:, None, None], y[:, None, None] + _GRID[0], x[:, None, None] + _GRID[1]] * _DISC
        angle = np.arctan2((patch * _GRID[0]).sum((1, 2)), (patch * _GRID[1]).sum((1, 2)))
        at = _PLACES[np.rint(angle / (2 * np.pi) * DIRECTIONS).astype(np.int64) % DIRECTIONS]
        values = level[image[:, None, None], y[:, None, None] + at[..., 0], x[:, None, None] + at[..., 1]]
        words = np.packbits(values[..., 0] < values[..., 1], axis=1).view(np.uint32)
        out.append((image, np.full(len(image), scale), y * scale, x * scale, angle, words))
    if not out:
        return tuple(np.zeros(0) for _ in range(5)) + (np.zeros((0, TABLES), np.uint32),)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def describe(data: list[bytes | None]) -> tuple[np.ndarray, ...]:
    """Corners of images: number of the image, then as ``_described``; images of one size are described together."""
    sizes: dict[tuple[int, int], list[int]] = {}
    pixels = [from_pgm(x) for x in data]
    for k, p in enumerate(pixels):
        if p is not None and min(p.shape) > 2 * _MARGIN + 2:
            sizes.setdefault(p.shape, []).append(k)
    out = []
    for shape, numbers in sizes.items():
        step = max(1, PIXELS // (shape[0] * shape[1]))
        for at in range(0, len(numbers), step):
            part = np.array(numbers[at : at + step])
            image, *rest = _described(np.stack([pixels[k] for k in part]))
            out.append((part[image.astype(np.int64)], *rest))
    if not out:
        return tuple(np.zeros(0) for _ in range(5)) + (np.zeros((0, TABLES), np.uint32),)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


#: What makes PGM images of a column's values.
Read = Callable[[list], list[bytes | None]] | None
#: A block of corners: ids, places as (scale, y, x, direction), words; arrays in one row.
_PACKED = "n long, ids binary, places binary, words binary"


def packed(images: DataFrame, read: Read = None) -> DataFrame:
    """Corners of ``images`` (``id image``), one row per block of about ``PACK`` corners of whole images. ``read`` makes images
    of the second column's values, if they aren't images."""

    def block(parts):
        ids, places, words = (np.concatenate(c) for c in zip(*parts, strict=True))
        values = [[len(ids)], [ids.astype(np.int64).tobytes()], [places.astype(np.float32).tobytes()], [words.astype(np.uint32).tobytes()]]
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["n", "ids", "places", "words"])

    def rows(batches):
        parts, held = [], 0
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                ids = np.array(part.column(0).to_numpy(), np.int64)
                values = part.column(1).to_pylist()
                image, scale, y, x, angle, words = describe(read(values) if read else values)
                if len(image):
                    parts.append((ids[image.astype(np.int64)], np.stack((scale, y, x, angle), 1), words))
                    held += len(image)
                if held >= PACK:
                    yield block(parts)
                    parts, held = [], 0
        if parts:
            yield block(parts)

    return images.filter(F.col(images.columns[0]).isNotNull()).select(*images.columns[:2]).mapInArrow(rows, _PACKED)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["places"], np.float32).reshape(-1, 4), np.frombuffer(row["words"], np.uint32).reshape(-1, TABLES)


class QueryTables:
    """The Hamming tables of a block of query corners."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.ids, self.places, self.words = (np.concatenate(c) for c in zip(*parts, strict=True))
        self.order = [np.argsort(self.words[:, t], kind="stable").astype(np.uint32) for t in range(TABLES)]

    def matches(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places among ``words`` and among the query's corners that match, each once; all of one place together."""
        begin, times = [], []
        for t in range(TABLES):
            ordered = self.words[self.order[t], t]
            begin.append(np.searchsorted(ordered, words[:, t]))
            times.append(np.searchsorted(ordered, words[:, t], "right") - begin[-1])
        total = np.cumsum(np.sum(times, 0))
        at = 0
        while at < len(words):
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + VOTES, "right")))
            found = []
            for t in range(TABLES):
                n = times[t][at:to]
                row = np.repeat(np.arange(at, to), n)
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + begin[t][row]
                corner = self.order[t][place].astype(np.int64)
                apart = np.bitwise_count(words[row] ^ self.words[corner]).sum(1, dtype=np.int64)
                found.append((row * len(self.ids) + corner)[apart <= DISTANCE])
            pair = np.unique(np.concatenate(found))
            yield pair // len(self.ids), pair % len(self.ids)
            at = to


def agreeing(own: np.ndarray, asked: np.ndarray) -> int:
    """The most distinct corners that agree with one proposal; matches as rows ``scale y x direction`` on either side."""
    place = [v[:, 2] + 1j * v[:, 1] for v in (own, asked)]
    ratio, turn = own[:, 0] / asked[:, 0], own[:, 3] - asked[:, 3]
    best = 0
    for at in range(0, len(own), 256):  # proposals
        p = slice(at, at + 256)
        moved = (ratio * np.exp(1j * turn))[p, None] * (place[1][None] - place[1][p, None])
        seen = place[0][None] - place[0][p, None]
        near = np.abs(seen - moved) <= SHIFT * np.maximum(own[:, 0][None], own[:, 0][p, None]) + SLACK * np.abs(moved)
        near &= np.abs(np.angle(np.exp(1j * (turn[None] - turn[p, None])))) <= TURN
        change = ratio[None] / ratio[p, None]
        near &= (change <= RATIO) & (change >= 1 / RATIO)
        counts = near.sum(1)
        for k in np.argsort(-counts, kind="stable").tolist():
            if counts[k] <= best:
                break
            best = max(best, min(len(np.unique(place[side][near[k]])) for side in (0, 1)))
    return best


def copies_in(tables: QueryTables, ids: np.ndarray, places: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``query_id id inliers`` of the copies between a block of queries and one of classes; rows of an id are neighbours."""
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(ids)], strict=True) if len(words) > VOTES else [(0, len(ids))]:
        parts = list(tables.matches(words[a:b]))
        own, asked = (np.concatenate(c) for c in zip(*parts, strict=True))
        if not len(own):
            continue
        own = own + a
        order = np.lexsort((ids[own], tables.ids[asked]))
        own, asked = own[order], asked[order]
        key = np.stack((tables.ids[asked], ids[own]))
        begin = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0))))
        for s, e in zip(begin, np.append(begin[1:], len(own)), strict=True):
            if e - s >= INLIERS:
                n = agreeing(places[own[s:e]], tables.places[asked[s:e]])
                if n >= INLIERS:
                    yield int(key[0, s]), int(key[1, s]), n


def copies(classes: DataFrame, queries: DataFrame, read: Read = None) -> DataFrame:
    """``query_id id inliers``: classes (``id image``) of which a query (``id image``) is a cropped or edited copy. ``read`` as
    in ``packed``."""
    spark = classes.sparkSession
    corners = durable(packed(classes, read), "image-corners")
    asked = durable(packed(queries, read).withColumn("part", F.monotonically_increasing_id()), "image-asked")
    sizes = {r["part"]: r["n"] for r in asked.select("part", "n").collect()}  # a number per PACK corners of the queries
    blocks, held = [[]], 0
    for part in sorted(sizes):
        if held and held + sizes[part] > BLOCK:
            blocks.append([])
            held = 0
        blocks[-1].append(part)
        held += sizes[part]
    found = None
    for parts in blocks:
        rows = asked.filter(F.col("part").isin(parts)).drop("part").toArrow().to_pylist()  # BLOCK corners, about
        tables = spark.sparkContext.broadcast([_unpacked(r) for r in rows])

        def search(batches, tables=tables):
            block = QueryTables(tables.value) if tables.value else None
            for batch in batches:
                for row in batch.to_pylist():
                    if block:
                        out = list(copies_in(block, *_unpacked(row)))
                        columns = zip(*out, strict=True) if out else ([], [], [])
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "id", "inliers"])

        now = durable(corners.mapInArrow(search, "query_id long, id long, inliers long"), "image-copies")
        tables.unpersist()
        found = now if found is None else found.unionByName(now)
    return found


def class_rows(images: DataFrame) -> DataFrame:
    """``id class_id`` of all ``images`` (``id image``): the smallest id with the same bytes."""
    digest = F.coalesce(F.sha2("image", 256), F.lit(""))  # null images are one class
    named = durable(images.filter("id is not null").select("id", digest.alias("digest")), "image-digests")
    classes = named.groupBy("digest").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    return join_spread(named, durable(classes, "image-classes"), ["digest"], "n", named.count()).select("id", "class_id")


#: Pixels of a drawn image's side.
SIDE = 96


def _textures() -> np.ndarray:
    """64 fixed textures, as rows: noise whose amplitude falls with the frequency, as in natural images."""
    noise = np.random.default_rng(21).normal(size=(64, SIDE, SIDE))
    frequency = np.hypot(np.fft.fftfreq(SIDE)[:, None], np.fft.fftfreq(SIDE)[None])
    weight = np.where(frequency > 0, 1 / np.maximum(frequency, 1 / SIDE), 0)
    return np.fft.ifft2(np.fft.fft2(noise) * weight).real.astype(np.float32).reshape(64, -1)


def drawn(vectors: list[list[float] | None]) -> list[bytes | None]:
    """The sums of fixed textures, weighted by vectors' first 64 numbers; None for other vectors."""
    if not _kept:
        _kept.append(_textures())
    vectors = [[np.nan if x is None else x for x in v or ()] for v in vectors]
    good = [k for k, v in enumerate(vectors) if len(v) >= 64 and np.isfinite(v[:64]).all()]
    if not good:
        return [None] * len(vectors)
    pixels = np.array([vectors[k][:64] for k in good], np.float32) @ _kept[0]
    low, high = pixels.min(1, keepdims=True), pixels.max(1, keepdims=True)
    pixels = np.rint((pixels - low) / np.maximum(high - low, 1e-9) * 200 + 20).reshape(-1, SIDE, SIDE)
    images = dict(zip(good, map(to_pgm, pixels), strict=True))
    return [images.get(k) for k in range(len(vectors))]


_kept: list[np.ndarray] = []


def draw(embeddings: DataFrame) -> DataFrame:
    """``id image``: the images drawn from ``vec_id embedding``."""

    def rows(batches):
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                images = pa.array(drawn(part.column(1).to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), images], ["id", "image"])

    return embeddings.select("vec_id", "embedding").mapInArrow(rows, "id long, image binary")


#: Rows whose id this divides are the queries.
QUERY_STEP = 20


def query(spark, sf_dir: str) -> DataFrame:
    """``vec_id class_id match_class_id inliers``: a row per vector with its class, and for the classes of the rows asked
    the row of their smallest id once per other class that holds a copy. The rows of a class match as it does."""
    vectors = table(spark, sf_dir, "embeddings")
    members = durable(class_rows(draw(vectors)), "image-members")
    # vectors are picked, and drawn where they are described
    reps = members.filter("id = class_id").select(F.col("id").alias("vec_id")).distinct()
    asked = members.filter(F.col("id") % QUERY_STEP == 0).select(F.col("class_id").alias("vec_id")).distinct()
    classes, queries = (vectors.join(ids, "vec_id", "left_semi").select(F.col("vec_id").cast("long").alias("id"), "embedding") for ids in (reps, asked))
    found = copies(classes, queries, drawn).filter("query_id <> id")
    pairs = found.select(F.col("query_id").alias("vec_id"), F.col("id").alias("match_class_id"), "inliers")
    return members.withColumnRenamed("id", "vec_id").join(pairs, "vec_id", "left").select("vec_id", "class_id", "match_class_id", "inliers")
