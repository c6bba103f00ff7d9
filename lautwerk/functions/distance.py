"""Similarity of comparison forms: weighted edit distance, Jaro, Jaro-Winkler and their blend.

The two dynamic programs run as Arrow-batched functions in which all pairs of a batch advance together, so no code runs per
pair; everything around them is native.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Letters that sound alike, rows of the German keyboard and their offsets.
SOFT_PAIRS = ("iy", "ck", "fv", "vw", "sz", "dt", "bp", "gk", "mn", "ae", "ou")
KEY_ROWS = (("qwertzuiopü", 0.0), ("asdfghjklöä", 0.5), ("yxcvbnm", 1.5))
SOFT, NEAR, OTHER, SWAP = 0.4, 0.5, 1.0, 0.7
NEAR_DISTANCE = 1.2
EDIT_SHARE, PREFIX_WEIGHT, PREFIX = 0.65, 0.1, 4


def _costs() -> dict[str, float]:
    """The cost of replacing one letter by another, where it is under 1; keys are both letters."""
    at = {c: (row, x + offset) for row, (keys, offset) in enumerate(KEY_ROWS) for x, c in enumerate(keys)}
    near = {
        a + b: NEAR
        for a, (ra, xa) in at.items()
        for b, (rb, xb) in at.items()
        if a != b and (ra - rb) ** 2 + (xa - xb) ** 2 <= NEAR_DISTANCE**2
    }
    soft = {p: SOFT for pair in SOFT_PAIRS for p in (pair, pair[::-1])}
    return near | soft


COSTS = _costs()


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, one column per text, zeros below, and the lengths."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((max(1, int(sizes.max(initial=0))), len(texts)), np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    column = np.repeat(np.arange(len(texts)), sizes)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), column] = flat
    return out, sizes


def _cost_table() -> np.ndarray:
    table = np.full((ALPHABET, ALPHABET), OTHER)
    for pair, cost in COSTS.items():
        a, b = map(ord, pair)
        table[a, b] = cost
    table[np.arange(ALPHABET), np.arange(ALPHABET)] = 0.0
    return table


#: Code points from this on only cost nothing among themselves if equal; all letters of ``COSTS`` are below it.
ALPHABET = 256
_COST = _cost_table()


def edit_costs(s: list[str], t: list[str]) -> np.ndarray:
    """Least cost of turning each ``s`` into its ``t`` by inserting, deleting, replacing and swapping neighbours.

    All pairs advance together, cell by cell of the table of prefixes; a pair's cost is read where both end.
    """
    (x, n), (y, m) = _codes(s), _codes(t)
    small_x, small_y = np.minimum(x, ALPHABET - 1), np.minimum(y, ALPHABET - 1)
    older, above = None, [np.full(len(s), float(j)) for j in range(len(y) + 1)]
    out = m.astype(np.float64)
    pick = np.arange(len(s))
    for i in range(1, int(n.max(initial=0)) + 1):
        row = [np.full(len(s), float(i))]
        for j in range(1, len(y) + 1):
            cost = np.where(x[i - 1] == y[j - 1], 0.0, _COST[small_x[i - 1], small_y[j - 1]])
            cost = np.where((cost == 0) & (x[i - 1] != y[j - 1]), OTHER, cost)  # both beyond the alphabet
            best = np.minimum(np.minimum(above[j - 1] + cost, above[j] + 1), row[-1] + 1)
            if i > 1 and j > 1:
                swapped = (x[i - 1] == y[j - 2]) & (x[i - 2] == y[j - 1])
                best = np.where(swapped, np.minimum(best, older[j - 2] + SWAP), best)
            row.append(best)
        older, above = above, row
        ends = pick[n == i]
        if len(ends):
            out[ends] = np.stack(row)[m[ends], ends]
    return np.round(out, 9)  # sums of tenths, whatever their order


def jaro_values(s: list[str], t: list[str]) -> np.ndarray:
    """Jaro similarity of each pair: letters within reach are matched from the left, all pairs together."""
    (x, n), (y, m) = _codes(s), _codes(t)
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    used_x, used_y = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
    for i in range(len(x)):
        inside = i < n
        for j in range(len(y)):
            hit = inside & (j < m) & (np.abs(i - j) <= reach) & ~used_x[i] & ~used_y[j] & (x[i] == y[j])
            used_x[i] |= hit
            used_y[j] |= hit
    shared = used_x.sum(0)
    swapped = np.zeros(len(s), np.int64)
    if len(s) and shared.max():
        order = []  # the matched letters in order, one column per pair
        for codes, used in ((x, used_x), (y, used_y)):
            letters = np.zeros((int(shared.max()), len(s)), np.uint32)
            place, column = np.nonzero(used)
            letters[(np.cumsum(used, 0) - 1)[place, column], column] = codes[place, column]
            order.append(letters)
        swapped = (order[0] != order[1]).sum(0) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        value = (shared / n + shared / m + (shared - swapped) / shared) / 3
    same = np.array([a == b for a, b in zip(s, t, strict=True)], bool)
    return np.where(same, 1.0, np.where(shared > 0, value, 0.0))


def blends(s: list[str], t: list[str]) -> np.ndarray:
    """0 for an empty form, 1 for equal ones; else the blend of edit and Jaro-Winkler similarity."""
    (x, n), (y, m) = _codes(s), _codes(t)
    longest = np.maximum(n, m)
    edit = 1 - np.minimum(edit_costs(s, t) / np.maximum(longest, 1), 1)
    j = jaro_values(s, t)
    rows = min(PREFIX, len(x), len(y))
    equal = (x[:rows] == y[:rows]) & (x[:rows] != 0)
    common = np.logical_and.accumulate(equal, 0).sum(0)
    value = EDIT_SHARE * edit + (1 - EDIT_SHARE) * (j + common * PREFIX_WEIGHT * (1 - j))
    same = np.array([a == b for a, b in zip(s, t, strict=True)], bool)
    return np.where((n == 0) | (m == 0), 0.0, np.where(same, 1.0, value))


#: Pairs that advance together.
CHUNK = 4096


def _of_pairs(f):
    @F.pandas_udf(DoubleType())
    def column(s: pd.Series, t: pd.Series) -> pd.Series:
        s, t = s.fillna("").to_numpy(object), t.fillna("").to_numpy(object)
        order = np.argsort([len(a) + len(b) for a, b in zip(s, t, strict=True)], kind="stable")  # little padding
        out = np.zeros(len(s))
        for at in range(0, len(order), CHUNK):
            part = order[at : at + CHUNK]
            out[part] = f(s[part].tolist(), t[part].tolist())
        return pd.Series(out)

    return column


weighted_edit = _of_pairs(edit_costs)
jaro = _of_pairs(jaro_values)
_blend = _of_pairs(blends)


def common_prefix(s: Column, t: Column) -> Column:
    """Length of the common prefix, 4 at most."""
    out = F.lit(0)
    for k in range(PREFIX, 0, -1):
        same = (F.length(s) >= k) & (F.left(s, F.lit(k)) == F.left(t, F.lit(k)))
        out = F.when(same, F.greatest(out, F.lit(k))).otherwise(out)
    return out


def jaro_winkler(s: Column, t: Column) -> Column:
    j = jaro(s, t)
    return j + common_prefix(s, t) * PREFIX_WEIGHT * (1 - j)


def similarity(s: Column, t: Column) -> Column:
    return _blend(s, t)


def round4(value: Column) -> Column:
    """Four digits, halves up."""
    return F.floor(value * 10000 + 0.5) / 10000
