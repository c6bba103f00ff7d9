"""Vectorised hashing of words over the bytes of many texts at once, in bounded memory.

A word's hash is a polynomial of its bytes modulo 2**64, taken from one running sum over a chunk and
brought to the word's own start by the inverse power of the base; it doesn't depend on the chunk.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes of text hashed at once; a word that is longer makes a longer chunk.
CHUNK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser with full avalanche (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        made = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        if size > 8 * CHUNK_BYTES:
            return made  # for one very long word; not kept
        _powers[:] = made
    return _powers


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start places of the words in a chunk of bytes."""
    apart = _SEPARATORS[data]
    inside = np.concatenate(([False], ~apart, [False]))
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(inside[:-1] & ~inside[1:])
    power, inverse = powers(len(data) + 1)
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LOWER[data] * power[: len(data)], dtype=np.uint64)))
    value = (running[ends] - running[starts]) * inverse[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def _chunks(texts: Sequence[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """Parts of texts, as (number of the text, bytes), of a chunk's size together; cut between words."""
    chunk: list[tuple[int, bytes]] = []
    size = 0
    for k, text in enumerate(texts):
        at = 0
        while True:
            end = min(len(text), at + CHUNK_BYTES - size if size < CHUNK_BYTES else at)
            if end < len(text):
                while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
                    end += 1
            chunk.append((k, text[at:end]))
            size += end - at + 1
            at = end
            if size >= CHUNK_BYTES:
                yield chunk
                chunk, size = [], 0
            if at >= len(text):
                break
    if chunk:
        yield chunk


def words(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, A-Z lower-cased, in order, and where each text's begin (n + 1 places)."""
    hashes, owners = [], []
    for chunk in _chunks(texts):
        data = np.frombuffer(b" ".join(t for _, t in chunk), np.uint8)
        if not len(data):
            continue
        h, starts = _word_hashes(data)
        begins = np.cumsum([0] + [len(t) + 1 for _, t in chunk[:-1]])
        numbers = np.array([k for k, _ in chunk], np.int64)
        hashes.append(h)
        owners.append(numbers[np.searchsorted(begins, starts, "right") - 1])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    owner = np.concatenate(owners)
    return np.concatenate(hashes), np.searchsorted(owner, np.arange(len(texts) + 1))


_SHINGLE = np.array(
    [0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64
)


def shingle_set(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles; of fewer words, the whole sequence is one."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(n, k)
    total = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        total += mix(hashes[j : n - width + 1 + j] * _SHINGLE[j]) * _SHINGLE[(j + 2) % 5]
    return np.unique(mix(total))
