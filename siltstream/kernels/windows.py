"""Statistics over windows of sorted rows, all rows at once, at a cost that hardly grows with a window's length.

A window is the rows a .. b - 1. Sums take it apart into the end of a piece of rows, whole pieces (nodes of a binary tree
over these) and the start of one; the extremes are those of two overlapping powers of two; the median walks along with a skip list. NaN counts as missing.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable
from math import comb

import numpy as np
import pandas as pd
from pandas.api.indexers import BaseIndexer

from ..plans.ordered import breaks

NAMES = frozenset(("sum", "mean", "avg", "min", "max", "count", "first", "last", "median", "std", "var", "sem", "skew", "kurt"))


def bounds(t: np.ndarray, starts: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose time lies low .. high around each row's, inside its group; ``starts``: the first row of each group."""
    a, b = np.empty(len(t), np.int64), np.empty(len(t), np.int64)
    for p, q in zip(starts.tolist(), [*starts[1:].tolist(), len(t)], strict=True):
        own = t[p:q]
        a[p:q] = p + np.searchsorted(own, own + low, side="left")
        b[p:q] = p + np.searchsorted(own, own + high, side="right")
    return a, np.maximum(a, b)


def _levels(a: np.ndarray, b: np.ndarray, leaves: list[np.ndarray], merge: Callable, take: Callable) -> None:
    """``take(rows, nodes)`` for the nodes of a binary tree whose rows together are each window's, from both its ends inwards."""
    a, b, level = a.copy(), b.copy(), leaves
    while True:
        i = np.flatnonzero((a < b) & (a & 1 == 1))
        take(i, [x[a[i]] for x in level])
        a[i] += 1
        i = np.flatnonzero((a < b) & (b & 1 == 1))
        b[i] -= 1
        take(i, [x[b[i]] for x in level])
        if not (a < b).any():
            return
        a >>= 1
        b >>= 1
        m = len(level[0]) // 2 * 2
        level = merge([x[0:m:2] for x in level], [x[1:m:2] for x in level])


def _nodes(a: np.ndarray, b: np.ndarray, leaves: list[np.ndarray], merge: Callable) -> list[np.ndarray]:
    """One node for each window; no window is empty."""
    out, some = [np.zeros(len(a)) for _ in leaves], np.zeros(len(a), bool)

    def take(i: np.ndarray, nodes: list[np.ndarray]) -> None:
        new = some[i]
        both = merge([o[i] for o in out], nodes)
        for o, x, y in zip(out, nodes, both, strict=True):
            o[i] = np.where(new, y, x)
        some[i] = True

    _levels(a, b, leaves, merge, take)
    return out


def _fold(a: np.ndarray, b: np.ndarray, leaves: list[np.ndarray], merge: Callable, take: Callable, size: int = 32) -> None:
    """``take(rows, nodes)`` for nodes whose rows together are each window's.

    Rows are cut into pieces of ``size``. A window is the end of a piece, whole pieces and the start of one: three nodes,
    however long it is, and the whole pieces are the same for many rows. Windows inside a piece are taken from the tree.
    """
    p, q = a // size, b // size
    i = np.flatnonzero((a < b) & (p == q))
    if len(i):
        _levels(a[i], b[i], leaves, merge, lambda j, nodes: take(i[j], nodes))
    i = np.flatnonzero(p < q)
    if not len(i):
        return
    m = -(-len(leaves[0]) // size)
    # one line for each place in a piece; what is missing of the last piece counts as nothing
    lines = [np.concatenate((x, np.zeros(m * size - len(x)))).reshape(m, size).T.copy() for x in leaves]
    start, end = [np.empty_like(x) for x in lines], [np.empty_like(x) for x in lines]
    for side, order in ((start, range(size)), (end, range(size - 1, -1, -1))):
        node = None
        for k in order:
            row = [x[k] for x in lines]
            node = row if node is None else merge(node, row) if side is start else merge(row, node)
            for s, x in zip(side, node, strict=True):
                s[k] = x
    take(i, [x[a[i] % size, p[i]] for x in end])
    j = i[b[i] % size > 0]
    take(j, [x[b[j] % size - 1, q[j]] for x in start])
    j = i[p[i] + 1 < q[i]]
    if len(j):
        lo, hi = p[j] + 1, q[j]
        run = np.concatenate(([0], np.cumsum((np.diff(lo) != 0) | (np.diff(hi) != 0))))
        first = np.flatnonzero(np.diff(run, prepend=-1))
        whole = _nodes(lo[first], hi[first], [x[size - 1] for x in start], merge)
        take(j, [x[run] for x in whole])


def sums(a: np.ndarray, b: np.ndarray, *xs: np.ndarray) -> list[np.ndarray]:
    out = [np.zeros(len(a)) for _ in xs]

    def take(i: np.ndarray, nodes: list[np.ndarray]) -> None:
        for o, x in zip(out, nodes, strict=True):
            o[i] += x

    _fold(a, b, list(xs), lambda p, q: [x + y for x, y in zip(p, q, strict=True)], take)
    return out


def counts(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    n = np.concatenate(([0], np.cumsum(~np.isnan(x))))
    return n[b] - n[a]


def _shift(p: list[np.ndarray], d: np.ndarray) -> list[np.ndarray]:
    """Sums of powers about a point that lies ``d`` below the one they were about."""
    powers = [np.ones_like(d)]
    for _ in p[1:]:
        powers.append(powers[-1] * d)
    return [sum((comb(k, j) * powers[k - j] * p[j] for j in range(k)), p[k]) for k in range(len(p))]


def power_sums(a: np.ndarray, b: np.ndarray, x: np.ndarray, point: np.ndarray, order: int, y: np.ndarray | None = None, y_order: int = 0, scale: float = 1.0, central: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sums of ((x - point) / scale) ** k over each window, k = 0 .. order, and the same times y (k = 0 .. y_order).

    Every node's sums are about a place of its own (its mean value if ``central``, else its first x), and only moved to the
    row's ``point`` in the end, so no digits are lost where x lies far from 0. Rows without y (or x) are left out.
    """
    known = ~np.isnan(x if y is None else y)
    n, zero = known.astype(float), np.zeros(len(x))
    yo = [] if y is None else [np.where(known, y, 0.0)] + [zero] * y_order
    leaves = [np.where(known, x, 0.0) if central else x, n, *[zero] * order, *yo]
    cut = order + 2

    def merge(p: list[np.ndarray], q: list[np.ndarray]) -> list[np.ndarray]:
        ref = p[0]
        if central:
            total = np.maximum(p[1] + q[1], 1.0)
            ref = p[0] * (p[1] / total) + q[0] * (q[1] / total)
        d, e = (p[0] - ref) / scale, (q[0] - ref) / scale
        sides = [[u + v for u, v in zip(_shift(p[k], d), _shift(q[k], e), strict=True)] for k in (slice(1, cut), slice(cut, None))] if y is not None else [[u + v for u, v in zip(_shift(p[1:], d), _shift(q[1:], e), strict=True)], []]
        return [ref, *sides[0], *sides[1]]

    out, yout = [np.zeros(len(a)) for _ in range(order + 1)], [np.zeros(len(a)) for _ in yo]

    def take(i: np.ndarray, nodes: list[np.ndarray]) -> None:
        d = (nodes[0] - point[i]) / scale
        for o, v in zip(out, _shift(nodes[1:cut], d), strict=True):
            o[i] += v
        if y is not None:
            for o, v in zip(yout, _shift(nodes[cut:], d), strict=True):
                o[i] += v

    _fold(a, b, leaves, merge, take)
    return out, yout


def extreme(a: np.ndarray, b: np.ndarray, x: np.ndarray, best: np.ufunc = np.fmax) -> np.ndarray:
    """The greatest (np.fmax) or least (np.fmin) of each window; NaN where there is none."""
    out = np.full(len(a), np.nan)
    if np.isnan(x).all():
        return out
    size = b - a
    level, k = x, 0
    while True:
        i = np.flatnonzero((size >> k) == 1)
        out[i] = best(level[a[i]], level[b[i] - (1 << k)])
        k += 1
        if not (size >> k).any():
            return out
        level = best(level[: -(1 << k - 1)], level[1 << k - 1 :])


def _same(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Windows with values that are all equal: none differs from the value before it, but the first."""
    known = np.flatnonzero(~np.isnan(x))
    at = np.concatenate(([0], np.cumsum(~np.isnan(x))))
    change = np.cumsum(breaks(x[known]))
    out, some = np.zeros(len(a), bool), at[b] > at[a]
    out[some] = change[at[b[some]] - 1] == change[at[a[some]]]
    return out


class _Windows(BaseIndexer):
    def __init__(self, a: np.ndarray, b: np.ndarray):
        super().__init__()
        self.a, self.b = a, b

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.a, self.b


def median(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a and b must not fall."""
    if not np.isinf(x).any():
        return pd.Series(x).rolling(_Windows(a, b), min_periods=1).median().to_numpy()
    # pandas takes infinite values for missing ones
    v, out, window, p, q = x.tolist(), np.full(len(a), np.nan), [], 0, 0
    for i, (lo, hi) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        for w in v[max(q, lo) : hi]:
            if w == w:
                insort(window, w)
        for w in v[p : min(lo, q)]:
            if w == w:
                del window[bisect_left(window, w)]
        p, q = max(p, lo), max(q, hi)
        if n := len(window):
            out[i] = window[n // 2] if n % 2 else (window[n // 2 - 1] + window[n // 2]) / 2
    return out


def statistic(name: str, a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A named statistic of each window's values; NaN where it is not defined. a and b must not fall."""
    n = counts(a, b, x)
    if name == "count":
        return n.astype(float)
    if name in ("min", "max"):
        return extreme(a, b, x, np.fmin if name == "min" else np.fmax)
    if name == "median":
        return median(a, b, x)
    if name in ("first", "last"):
        known, at = np.flatnonzero(~np.isnan(x)), np.concatenate(([0], np.cumsum(~np.isnan(x))))
        out = np.full(len(a), np.nan)
        some = n > 0
        out[some] = x[known[at[a[some]] if name == "first" else at[b[some]] - 1]]
        return out
    with np.errstate(divide="ignore", invalid="ignore"):
        total = np.where(n > 0, sums(a, b, np.where(np.isnan(x), 0.0, x))[0], np.nan)
        mean = total / n
        if name in ("sum", "mean", "avg"):
            return total if name == "sum" else mean
        (_, _, *m), _ = power_sums(a, b, x, mean, {"skew": 3, "kurt": 4}.get(name, 2), central=True)
        m = [np.where(_same(a, b, x), 0.0, v) for v in m]
        if name in ("std", "var", "sem"):
            var = np.where(n >= 2, m[0] / (n - 1.0), np.nan)
            return var if name == "var" else np.sqrt(var) if name == "std" else np.sqrt(var) / np.sqrt(n)
        m2 = m[0] / n
        if name == "skew":
            out = np.sqrt(n * (n - 1.0)) / (n - 2.0) * (m[1] / n) / m2**1.5
            return np.where((n >= 3) & (m2 > 0), out, np.nan)  # undefined without spread
        if name == "kurt":
            out = (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * (m[2] / n / (m2 * m2) - 3) + 6)
            return np.where((n >= 4) & (m2 > 0), out, np.nan)
    raise ValueError(f"unknown function {name!r}")
