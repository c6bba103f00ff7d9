"""Token counts by a two-tier lookup of pre-tokens, on the map side.

A byte-level BPE model encodes each pre-token by itself, so a text's count is the sum of its
pre-tokens' counts. Tier one is a compact table of the most frequent pre-tokens and their counts,
fitted on a bounded sample of documents and broadcast. Tier two is a cache in each Python worker: what
neither has is encoded by the library, a batch at a time. No pre-token is ever shuffled, and the table
affects speed alone, never a count.

Special strings count as the library's default has it: each is one token and parts the text.

Edge cases: null and empty texts have 0 tokens. Very long texts are taken in slices, cut before white
space that follows other characters, where no pre-token can continue. Rows are counted one
by one: repeated rows, ties, empty tables and extra columns pass through.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level BPE parts a text into pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the broadcast table; each is a string of 64 characters at most.
TABLE_ROWS = 1 << 16
#: Documents, and characters of each, that the table is fitted on.
SAMPLE_DOCS = 4096
SAMPLE_CHARS = 1 << 14
#: Entries of a worker's cache, after which it begins anew from the table.
CACHE_ROWS = 1 << 19
CACHED_CHARS = 64
SLICE_CHARS = 1 << 20

_find = regex.compile(PRE_TOKENS).findall
_edge = regex.compile(r"(?<=\S)\s")


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut only where pre-tokens end."""
    at = 0
    while len(text) - at > size:
        cut = _edge.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Table:
    """Pre-tokens and their token counts, packed: one UTF-8 blob, offsets, counts of a byte each."""

    def __init__(self, rows: list[tuple[str, int]]):
        rows = [(p, n) for p, n in rows if n < 256]
        data = [p.encode() for p, _ in rows]
        self.blob = b"".join(data)
        self.ends = np.cumsum([len(x) for x in data], dtype=np.uint32)
        self.counts = np.array([n for _, n in rows], np.uint8)

    def as_dict(self) -> dict[str, int]:
        starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64).tolist() if len(self.ends) else []
        return {
            self.blob[a:b].decode(): n for a, b, n in zip(starts, self.ends.tolist(), self.counts.tolist(), strict=True)
        }


class PreTokenCounter:
    """A worker's counter: the table, then the cache, then the library."""

    def __init__(self, path: str, table: Table):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_padding()
        self.model.no_truncation()
        special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.table = table.as_dict()
        self.known = dict(self.table)

    def encoded(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch(pieces, add_special_tokens=False)]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(self._plain(s) for part in parts for s in slices(part))

    def _plain(self, text: str) -> int:
        pieces = _find(text)
        known = self.known
        missing = set(pieces).difference(known)
        if not missing:
            return sum(map(known.__getitem__, pieces))
        missing = list(missing)
        fresh = dict(zip(missing, self.encoded(missing), strict=True))
        total = sum(fresh[p] if p in fresh else known[p] for p in pieces)
        if len(known) > CACHE_ROWS:
            self.known = known = dict(self.table)
        known.update((p, n) for p, n in fresh.items() if len(p) <= CACHED_CHARS)
        return total


_counters: dict[tuple[str, int], PreTokenCounter] = {}


def _counter(path: str, broadcast) -> PreTokenCounter:
    key = (path, broadcast.id if hasattr(broadcast, "id") else id(broadcast))
    if key not in _counters:
        _counters.clear()  # one counter a worker
        _counters[key] = PreTokenCounter(path, broadcast.value)
    return _counters[key]


def frequent_pre_tokens(docs: DataFrame, path: str, text: str = "text", rows: int = TABLE_ROWS) -> Table:
    """The table, fitted on a random sample of about ``SAMPLE_DOCS`` rows, twice as many at most."""
    n = docs.count()
    sample = (
        docs.sample(min(1.0, SAMPLE_DOCS / max(1, n)), 7)
        .select(F.substring(F.col(text), 1, SAMPLE_CHARS).alias("t"))
        .filter("t is not null")
        .limit(2 * SAMPLE_DOCS)
    )

    def fit(batches):
        seen: Counter[str] = Counter()
        for frame in batches:
            for t in frame["t"]:
                if t:
                    seen.update(p for p in _find(t) if len(p) <= CACHED_CHARS)
        top = [p for p, _ in seen.most_common(rows)]
        model = PreTokenCounter(path, Table([]))
        for at in range(0, len(top), 4096):
            part = top[at : at + 4096]
            yield pd.DataFrame({"p": part, "n": model.encoded(part)})

    found = sample.repartition(1).mapInPandas(fit, "p string, n int").collect()  # ``rows`` of them at most
    return Table([(r["p"], r["n"]) for r in found])


def token_counter(docs: DataFrame, path: str, text: str = "text") -> Column:
    """A column with the tokens of ``docs[text]``; ``path`` is that of a byte-level BPE file on every node."""
    broadcast = docs.sparkSession.sparkContext.broadcast(frequent_pre_tokens(docs, path, text))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(path, broadcast)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return count(F.coalesce(F.col(text), F.lit("")))


def count_tokens(docs: DataFrame, path: str, limit: int, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes n_tokens over_limit``."""
    return docs.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"),
            "n_tokens": token_counter(docs, path, text),
        }
    ).withColumn("over_limit", F.col("n_tokens") > limit)


#: The limit of the query.
LIMIT = 512


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    counted = count_tokens(docs.select("doc_id", "text"), path, LIMIT)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")
