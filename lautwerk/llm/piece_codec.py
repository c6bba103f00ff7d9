"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The transducer is compiled from a model file: the normaliser (dummy prefix, space to U+2581, runs of
spaces collapsed if the model says so), an arc for each piece, and byte fallback arcs for characters
without a piece. Composed with a text it is a lattice whose states are a place and the piece that ended
there. The encoding is the lattice's shortest path in the tropical semiring.

Weights make the path the model's own segmentation. In a BPE model a segmentation is the merges'
result iff each two neighbouring pieces, joined and merged alone, give these two pieces again; so an arc
costs one joint penalty if it follows a piece it would not stay apart from, and nothing else,
and the merges' result is the only path that costs nothing. If no path is free, the path with the
fewest penalties wins, then the fewest pieces. In a unigram model an arc costs its piece's negative score.

No arc spans two neighbouring characters that are neighbours in no piece, so a text is cut at all such places
into units, and its path is that of its units, one after the other. A unit that is one piece is subject to the same
rule: the piece must be what its own merges make. The texts of a batch are cut together, equal units are found by a hash
and compared character by character, and each distinct one is composed once and kept in a bounded cache until the task ends.
Decoding gathers the pieces' bytes over the batch and takes off the dummy prefix.

Edge cases: null and empty texts have no pieces and decode to empty. Very long texts are taken in windows that end
where units do; very long units cost time and memory in proportion to their length. U+2581 in a text decodes to a
space, as in the library. Bytes that are no UTF-8 decode to replacement characters. Rows are
coded one by one: repeated rows, ties, empty tables and extra columns pass through. Models with a character map, and
with user-defined or unused pieces, which the merges treat apart, are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._hashing import mix, powers
from ._shared import lean

SPACE = "▁"
NORMAL, UNKNOWN, USER, UNUSED, BYTE = 1, 2, 4, 5, 6  # kinds of pieces in a model file
BPE = 2
#: Entries of a worker's caches, after which they begin anew, and the longest unit kept.
UNITS, JOINTS, UNIT_CHARS = 1 << 18, 1 << 18, 64
#: Characters that are cut and looked up together.
WINDOW_CHARS = 1 << 18


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("a model with a character map is not supported")
        if any(p.type in (USER, UNUSED) for p in model.pieces):
            raise ValueError("a model with user-defined or unused pieces is not supported")
        self.prefix, self.trims, self.escapes = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.bpe = model.trainer_spec.model_type == BPE
        self.arcs = {p.piece: (k, p.score) for k, p in enumerate(model.pieces) if p.type == NORMAL}
        self.texts = [p.piece for p in model.pieces]
        self.bytes = {int(p.piece[1:-1], 16): k for k, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(k for k, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.ids = {text: k for text, (k, _) in self.arcs.items()}
        self.starts = {text[:k]: -1 for text in self.arcs for k in range(1, len(text) + 1)} | self.ids  # -1: no piece itself
        self.longest = max(map(len, self.arcs))
        self.lengths = [len(text) for text in self.texts]
        # per piece the longest other one that it starts with, -1 for none
        self.shorter = [
            next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), -1) if t in self.ids else -1 for t in self.texts
        ]
        # per character its class, 0 for those in no piece of several; per two classes whether they are neighbours in one
        pairs = {p[k : k + 2] for p in self.arcs for k in range(len(p) - 1)}
        inner = sorted(map(ord, set("".join(pairs))))
        self.classes = np.zeros(max(inner, default=0) + 2, np.int32)
        self.classes[inner] = np.arange(1, len(inner) + 1)
        self.near = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for a, b in pairs:
            self.near[self.classes[ord(a)], self.classes[ord(b)]] = True
        surface = [p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else b"" for p in model.pieces]
        for b, k in self.bytes.items():
            surface[k] = bytes([b])
        if not self.bytes:
            surface[self.unknown] = " ⁇ ".encode()
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_ends = np.cumsum([len(x) for x in surface])
        self.surface_sizes = np.diff(self.surface_ends, prepend=0)
        self.units: dict[str, bytes] = {}
        self.joints: dict[int, bool] = {}

    def forget(self) -> None:
        """Empties the caches, which fill again as they are used."""
        self.units, self.joints = {}, {}

    # --- the normaliser

    def normal(self, text: str) -> str:
        if self.trims:
            text = regex.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        if self.prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escapes else text

    def inner(self, points: np.ndarray) -> np.ndarray:
        """Per code point but the first whether a piece may span it and the one before."""
        kinds = self.classes[np.minimum(points, len(self.classes) - 1)]
        return self.near[kinds[:-1], kinds[1:]]

    def cut(self, text: str) -> list[str]:
        """The units of a normal text."""
        cuts = (np.flatnonzero(~self.inner(_points(text))) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)] if text else []

    def windows(self, text: str, size: int) -> Iterator[str]:
        """A normal text in parts of about ``size`` characters that end where units do."""
        at, width = 0, size
        while len(text) - at > width:
            cuts = np.flatnonzero(~self.inner(_points(text[at : at + width])))
            if not len(cuts):
                width *= 2  # one unit is longer than that
                continue
            yield text[at : at + int(cuts[-1]) + 1]
            at, width = at + int(cuts[-1]) + 1, size
        yield text[at:]

    # --- weights

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short text alone."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                arc = self.arcs.get(parts[k] + parts[k + 1])
                if arc and (best is None or arc[1] > best):
                    best, at = arc[1], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def apart(self, left: int, right: int) -> bool:
        """Whether two neighbouring pieces stay two under the merges; with -1, whether the right one stays one."""
        key = left * len(self.texts) + right
        kept = self.joints.get(key)
        if kept is None:
            parts = [self.texts[k] for k in (left, right) if k >= 0]
            kept = self.merged("".join(parts)) == parts
            if len(self.joints) >= JOINTS:
                self.joints.clear()
            self.joints[key] = kept
        return kept

    # --- the shortest path

    def path(self, unit: str) -> list[int]:
        """The pieces of the shortest path through the lattice of one unit."""
        return (self._free_path(unit) if self.bpe else None) or self._cheapest_path(unit)

    def _longest(self, unit: str, i: int) -> int:
        """The longest piece that starts at a place; -1 for none."""
        starts, found = self.starts.get, -1
        for j in range(i + 1, len(unit) + 1):
            piece = starts(unit[i:j])
            if piece is None:
                break
            if piece >= 0:
                found = piece
        return found

    def _free_path(self, unit: str) -> list[int] | None:
        """A path without penalties, if there is one: no path costs less, so the lattice is composed only along free
        arcs, longest pieces first, and the search ends at the first path; states without a way on are left for good."""
        n, size, known, lengths, shorter = len(unit), len(self.texts), self.joints.get, self.lengths, self.shorter
        taken: list[tuple[int, int, int]] = []  # place, piece before and piece of each arc; -1 for bytes and the start
        dead: set[tuple[int, int]] = set()
        i, before, piece = 0, -1, self._longest(unit, 0)
        while True:
            while piece >= 0:
                free = known(before * size + piece)
                if free is None:
                    free = self.apart(before, piece)
                if free and not (dead and (i + lengths[piece], piece) in dead):
                    break
                piece = shorter[piece]
            if piece >= 0 or (unit[i] not in self.ids and (i + 1, -1) not in dead):
                taken.append((i, before, piece))
                i, before = i + (lengths[piece] if piece >= 0 else 1), piece
                if i == n:
                    break
                piece = self._longest(unit, i)
                continue
            dead.add((i, before))
            while taken and taken[-1][2] < 0:  # bytes are the last arc tried at a place
                i, before, _ = taken.pop()
                dead.add((i, before))
            if not taken:
                return None
            i, before, piece = taken.pop()
            piece = shorter[piece]
        out: list[int] = []
        for i, _, piece in taken:
            out += [piece] if piece >= 0 else self._fallback(unit[i])[::-1]
        return out

    def _fallback(self, text: str) -> list[int]:
        """The pieces of a character without one, last first."""
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in reversed(text.encode("utf-8", "replace"))]

    def _cheapest_path(self, unit: str) -> list[int]:
        n, arcs = len(unit), self.arcs
        # per place: piece that ended there -> (cost, pieces, place before, piece before); -1 for bytes and the start
        states: list[dict[int, tuple[float, int, int, int]]] = [{} for _ in range(n + 1)]
        states[0][-1] = (0.0, 0, -1, -1)
        for i in range(n):
            here = states[i]
            if not here:
                continue
            found = False
            for j in range(i + 1, min(n, i + self.longest) + 1):
                arc = arcs.get(unit[i:j])
                if arc is None:
                    continue
                found = True
                piece, score = arc
                best = None
                for before, (cost, count, _, _) in here.items():
                    if not self.bpe:
                        step = cost - score
                    else:
                        step = cost if self.apart(before, piece) else cost + 1
                    new = (step, count + 1, i, before)
                    if best is None or new < best:
                        best = new
                states[j][piece] = best
            if not found or (unit[i] not in arcs):
                size = len(unit[i].encode("utf-8", "replace")) if self.bytes else 1
                before, (cost, count, _, _) = min(here.items(), key=lambda s: s[1][:2])
                new = (cost + (0 if self.bpe else 1e4), count + size, i, before)
                if -1 not in states[i + 1] or new < states[i + 1][-1]:
                    states[i + 1][-1] = new
        out: list[int] = []
        at, piece = n, min(states[n], key=lambda p: states[n][p][:2])
        while at > 0:
            _, _, start, before = states[at][piece]
            if piece >= 0:
                out.append(piece)
            else:
                out += self._fallback(unit[start:at])
            at, piece = start, before
        return out[::-1]

    def _unit(self, unit: str) -> bytes:
        ids = self.units.get(unit)
        if ids is None:
            ids = np.array(self.path(unit), np.int32).tobytes()
            if len(unit) <= UNIT_CHARS:
                if len(self.units) >= UNITS:
                    self.units.clear()
                self.units[unit] = ids
        return ids

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of all texts, one after the other, and how many each has."""
        counts = np.zeros(len(texts), np.int64)
        ids, parts, owners, held = [], [], [], 0

        def take() -> None:
            nonlocal parts, owners, held
            found, sizes = self._encode_parts(parts)
            ids.append(found)
            np.add.at(counts, owners, sizes)
            parts, owners, held = [], [], 0

        for k, text in enumerate(texts):
            for part in self.windows(self.normal(text or ""), WINDOW_CHARS):
                if part:
                    parts.append(part)
                    owners.append(k)
                    held += len(part)
                if held >= WINDOW_CHARS:
                    take()
        if parts:
            take()
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), counts

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(parts)
        points = _points(joined)
        apart = np.concatenate(([True], ~self.inner(points)))
        begins = np.cumsum([0, *map(len, parts)])
        apart[begins[:-1]] = True
        starts = np.flatnonzero(apart)
        sizes = np.diff(np.append(starts, len(points)))
        # equal units by a polynomial of their code points, each compared with the one that stands for it
        power, inverse = powers(len(points) + 1)
        running = np.concatenate((np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * power[: len(points)], dtype=np.uint64)))
        value = (running[starts + sizes] - running[starts]) * inverse[starts] + sizes.astype(np.uint64)
        _, first, which = np.unique(mix(value), return_index=True, return_inverse=True)
        twin = first[which]
        same = sizes[twin] == sizes
        if same.all():
            same = points[np.repeat(starts[twin] - starts, sizes) + np.arange(len(points))] == points
        if not same.all():  # two units of one hash
            first = which = np.arange(len(starts))
        ends = (starts + sizes)[first].tolist()
        found = [self._unit(joined[a:b]) for a, b in zip(starts[first].tolist(), ends, strict=True)]
        table = np.frombuffer(b"".join(found), np.int32)
        n = np.array([len(x) for x in found], np.int64) // 4
        ids = _gather(table, (np.cumsum(n) - n)[which], n[which])
        return ids, np.add.reduceat(n[which], np.searchsorted(starts, begins[:-1]))

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of piece ids, one after the other, ``counts`` of them each."""
        sizes = self.surface_sizes[ids]
        data = _gather(self.surface, (self.surface_ends - self.surface_sizes)[ids], sizes)
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
        if self.prefix:
            dummy = ends[:-1][ends[1:] > ends[:-1]]
            dummy = dummy[data[dummy] == 32]
            data = np.delete(data, dummy)
            ends = ends - np.searchsorted(dummy, ends)
        raw = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
        try:
            return raw.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.large_string())

    def decode(self, ids) -> str:
        return self.decode_all(np.asarray(ids, np.int64), np.array([len(ids)]))[0].as_py()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` from each start on, of these sizes, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


_transducers: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _transducers:
        _transducers.clear()  # one a worker
        _transducers[path] = Transducer(path)
    return _transducers[path]


def encode(text: Column, path: str) -> Column:
    """The piece ids of a text, ``array<int>``; ``path`` is that of the model file on every node."""

    @F.pandas_udf("array<int>")
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fst = transducer(path)
        for texts in batches:
            ids, counts = fst.encode_all(texts.tolist())
            yield pd.Series(np.split(ids, np.cumsum(counts)[:-1]) if len(texts) else [], dtype="object")

    return ids_of(F.coalesce(text, F.lit("")))


def decode(ids: Column, path: str) -> Column:
    """The text of piece ids."""

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fst = transducer(path)
        for rows in batches:
            counts = np.array([len(r) for r in rows], np.int64)
            flat = np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(rows) else np.zeros(0, np.int64)
            yield pd.Series(fst.decode_all(flat, counts).to_pylist(), dtype="object")

    return text_of(ids)


def coded(docs: DataFrame, path: str, *, decoded: bool = False) -> DataFrame:
    """``docs`` with the piece ids of ``text`` in its place, ``ids``, and if asked for the text they decode to, ``decoded``.

    One worker does both, and passes on what it has about every ``WINDOW_CHARS`` characters.
    """
    kept = [c for c in docs.columns if c != "text"]
    fields = [*docs.select(*kept).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    fields += [T.StructField("decoded", T.StringType())] if decoded else []

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(path)
        try:
            for batch in batches:
                texts, begin, held = batch.column(len(kept)), 0, 0
                sizes = texts.cast(pa.binary()).fill_null(b"")
                for k, size in enumerate(pa.compute.binary_length(sizes).to_pylist()):
                    held += size
                    if held < WINDOW_CHARS and k < len(texts) - 1:
                        continue
                    part = batch.slice(begin, k + 1 - begin)
                    ids, counts = fst.encode_all(part.column(len(kept)).to_pylist())
                    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                    columns = [*part.columns[: len(kept)], pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
                    columns += [fst.decode_all(ids, counts).cast(pa.string())] if decoded else []
                    yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])
                    begin, held = k + 1, 0
        finally:
            fst.forget()  # the worker's next task may be another operator's

    return docs.select(*kept, "text").mapInArrow(lean(code), T.StructType(fields))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: its pieces' number and digest, and whether decoding gives the text again."""
    path = path or model_path()
    rows = coded(docs.select("doc_id", "text", F.sha2("text", 256).alias("digest")), path, decoded=True)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        (F.sha2("decoded", 256) == F.coalesce("digest", F.sha2(F.lit(""), 256))).alias("round_trip"),
    )
