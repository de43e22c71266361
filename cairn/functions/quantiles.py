"""Exact quantiles in bounded memory, by selection: no task and no aggregate ever holds a column's different values.

Doubles have 64-bit keys in the same order. A pass counts rows by the first bits of their keys, for all columns and classes
at once; then only the bins that hold a wanted rank are open, and the next pass counts rows of these by the bits that
follow. When the rows of all open bins are few, or no bits are left, the keys themselves are counted. Six passes do for
any table, three for most. What a pass returns is bounded by MOST bins, whatever the rows.

Nulls are left out; NaN is the largest value, as in Spark's order; -0.0 is 0.0. Between two values a quantile is
interpolated linearly at p * (n - 1).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits by which the first pass counts, bins that a pass may return, and rows of open bins whose keys are counted.
BITS, MOST, FEW = 12, 1 << 20, 1 << 15
_COUNTS = "of string, col int, bin long, n long"
_TOP = np.uint64(1 << 63)


def keys(v: np.ndarray) -> np.ndarray:
    """Numbers in the order of the doubles."""
    bits = np.where(np.isnan(v), np.nan, v + 0.0).view(np.uint64)
    return np.where(bits & _TOP, ~bits, bits | _TOP)


def values(k: np.ndarray) -> np.ndarray:
    """The doubles of these keys."""
    k = k.astype(np.uint64)
    return np.where(k & _TOP, k ^ _TOP, ~k).view(np.float64)


@dataclass
class Selected:
    """Quantiles of a column in a class: n values, how many different ones (up to what was asked), and the value at each p."""

    n: int
    different: int
    at: dict[float, float | None]
    passes: int


@dataclass
class _Open:
    """A column in a class: wanted ranks by the bin that holds them, as (rank, rows of the table before the bin)."""

    n: int = 0
    different: int = 0
    bins: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    every: bool = True


def _counted(width: int, shift: int, last: int, open_: Mapping[tuple, np.ndarray] | None):
    """_COUNTS of (class, columns ...): rows by key >> shift, of those whose key >> last is open (all, if None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def add(of, col, v):
            k = keys(v)
            if open_ is not None:
                mine = open_.get((of, col))
                if mine is None:
                    return
                prefix = k >> np.uint64(last)
                k = k[mine[np.minimum(np.searchsorted(mine, prefix), len(mine) - 1)] == prefix]
            if len(k):
                pairs = held.setdefault((of, col), [])
                pairs.append(np.unique(k >> np.uint64(shift), return_counts=True))
                if len(pairs) > 1 and sum(len(b) for b, _ in pairs[1:]) > max(1 << 16, len(pairs[0][0])):
                    pairs[:] = [merged(pairs)]

        def merged(pairs):
            b, at = np.unique(np.concatenate([b for b, _ in pairs]), return_inverse=True)
            return b, np.bincount(at, weights=np.concatenate([n for _, n in pairs]), minlength=len(b)).astype(np.int64)

        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            at = codes.indices.fill_null(-1).to_numpy()
            names = [(i, name) for i, name in enumerate(codes.dictionary.to_pylist())] + [(-1, None)]
            for i, name in names:
                some = at == i
                if some.any():
                    for col in range(width):
                        v = batch.column(1 + col).to_numpy(zero_copy_only=False)[some]
                        there = ~batch.column(1 + col).is_null().to_numpy(zero_copy_only=False)[some]
                        add(name, col, v[there].astype(np.float64))
        for (of, col), pairs in held.items():
            b, n = merged(pairs)
            for i in range(0, len(b), 1 << 16):
                m = len(b[i : i + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array([of] * m, pa.string()), pa.array([col] * m, pa.int32()), pa.array(b[i : i + m].view(np.int64)), pa.array(n[i : i + m])], names=["of", "col", "bin", "n"])

    return run


def _ranks(n: int, probs: Sequence[float]) -> list[int]:
    return sorted({r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}) if n else []


def quantiles(df: DataFrame, columns: Mapping[str, Column], probs: Sequence[float], by: Column | None = None, different: int = 0) -> dict[tuple[str | None, str], Selected]:
    """Selected by (class, column) of numeric columns; by: classes, as text (None where there are none). different: up to which number different values are counted.

    Looks at the data: BITS to begin with, then the bits that follow in open bins. Every class of rows has an entry, and
    where no class is given the whole table, rows or not.
    """
    names = list(columns)
    rows = df.select((F.lit(None) if by is None else by).cast("string").alias("_of"), *[c.cast("double").alias(f"_{i}") for i, c in enumerate(columns.values())])
    state: dict[tuple, _Open] = {} if by is not None else {(None, i): _Open() for i in range(len(names))}
    found: dict[tuple, dict[int, int]] = {}
    shift, last, open_, passes = 64 - BITS, 64, None, 0
    while True:
        passes += 1
        got = rows.mapInArrow(_counted(len(names), shift, last, open_), _COUNTS).groupBy("of", "col", "bin").agg(F.sum("n").alias("n")).orderBy("of", "col", "bin").toArrow()
        of, col = got["of"].to_pylist(), got["col"].to_pylist()
        bins, counts = got["bin"].to_numpy().view(np.uint64), got["n"].to_numpy()
        groups: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(of, col)):
            groups.setdefault(key, []).append(i)
        few = 0
        following: dict[tuple, np.ndarray] = {}
        for key, at in groups.items():
            s = state.setdefault(key, _Open())
            b, n = bins[at], counts[at]
            order = np.argsort(b)
            b, n = b[order], n[order]
            if passes == 1:
                s.n = int(n.sum())
                s.bins = {0: [(r, 0) for r in _ranks(s.n, probs)]}
                parent = np.zeros(len(b), dtype=np.uint64)
            else:
                parent = b >> np.uint64(last - shift)
            if s.every:
                s.different = len(b)
                s.every = len(b) < different and shift > 0
            now: dict[int, list[tuple[int, int]]] = {}
            for p, wanted in s.bins.items():
                some = np.flatnonzero(parent == np.uint64(p))
                if not wanted or not len(some):
                    continue
                before = wanted[0][1] + np.concatenate(([0], np.cumsum(n[some])))
                for r, _ in wanted:
                    i = int(np.searchsorted(before, r, side="right")) - 1
                    now.setdefault(int(b[some[i]]), []).append((r, int(before[i])))
            if shift == 0:
                found.setdefault(key, {}).update({r: p for p, wanted in now.items() for r, _ in wanted})
                continue
            if s.every:
                now = {int(x): now.get(int(x), []) for x in b}
            s.bins = now
            following[key] = np.array(sorted(now), dtype=np.uint64)
            few += int(n[np.isin(b, following[key])].sum())
        if shift == 0 or not following:
            break
        many = sum(map(len, following.values()))
        bits = max(4, min(BITS, int(math.log2(max(1, MOST // many)))))
        open_, last, shift = following, shift, 0 if few <= FEW else max(0, shift - bits)
    classes = {of for of, _ in state}
    out = {}
    for of in classes:
        for i, name in enumerate(names):
            s = state.get((of, i), _Open())
            value = {r: float(values(np.array([k], dtype=np.uint64))[0]) for r, k in found.get((of, i), {}).items()}
            out[of, name] = Selected(s.n, s.different, {p: _between(value, p * (s.n - 1)) if s.n else None for p in probs}, passes)
    return out


def _between(value: Mapping[int, float], place: float) -> float:
    low, high = math.floor(place), math.ceil(place)
    a, b = value[low], value[high]
    if low == high or a == b:
        return a
    # Rounded once less, as DuckDB does it: its labels of bins show the last digits.
    return math.fma(a, high - place, (place - low) * b) if math.isfinite(a) and math.isfinite(b) else (high - place) * a + (place - low) * b
