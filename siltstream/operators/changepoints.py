"""Change points: where the statistics of the time before and after a row differ."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..frame import Call, Series
from ..kernels import windows
from ..plans.halo import near
from ..registry import flagging, register
from ..timespan import micros
from .vector import scan


def _reduce(t: np.ndarray, stat: np.ndarray, half: int, best: Callable) -> np.ndarray:
    """Of each neighbourhood of detected points, in order of time, its winner; later neighbourhoods overrule earlier ones."""
    mark = np.ones(len(t), bool)
    for i in range(len(t)):
        a, b = np.searchsorted(t, t[i] - half), np.searchsorted(t, t[i] + half, side="right")
        mark[a:b] = False
        mark[a + int(best(stat[a:b]))] = True
    return mark


def _winners(t: np.ndarray, starts: np.ndarray, stat: np.ndarray, half: int) -> np.ndarray:
    """Of the neighbourhoods that hold a point the last overrules the others, and there the greatest statistic wins, the earliest of equals."""
    order = np.lexsort((-t, stat))
    rank = np.empty(len(t))
    rank[order] = np.arange(len(t))
    best = order[windows.extreme(*windows.bounds(t, starts, -half, half), rank).astype(int)]
    last = windows.bounds(t, starts, 0, half)[1] - 1
    return t[best[last]] == t


def _compared(func: Callable, rows: np.ndarray, x: np.ndarray, back: tuple[np.ndarray, np.ndarray], fore: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A function of the values before and after, at the rows given."""
    at, known = np.concatenate(([0], np.cumsum(~np.isnan(x)))), x[~np.isnan(x)]
    out = np.full(len(x), np.nan)
    for i in np.flatnonzero(rows):
        p, q = (known[at[w[0][i]] : at[w[1][i]]] for w in (back, fore))
        if len(p) and len(q):
            out[i] = float(func(p, q))
    return out


def _points(t: np.ndarray, starts: np.ndarray, cols: dict[str, np.ndarray], stat_func: str | Callable, thresh_func: float | Callable, b: int, f: int, mb: int, mf: int, half: int, reduce_func: Callable | None) -> dict:
    x = cols["value"]
    known = ~np.isnan(x)
    back, fore = windows.bounds(t, starts, -(b - 1), 0), windows.bounds(t, starts, 1, f)
    enough = known & (windows.counts(*back, x) >= mb) & (windows.counts(*fore, x) >= max(mf, 1))
    with np.errstate(invalid="ignore"):
        if callable(stat_func):
            stat = _compared(stat_func, enough, x, back, fore)
        else:
            stat = np.where(enough, np.abs(windows.statistic(stat_func, *back, x) - windows.statistic(stat_func, *fore, x)), np.nan)
        found = np.flatnonzero(stat > (_compared(thresh_func, enough, x, back, fore) if callable(thresh_func) else thresh_func))
    cp, times = np.zeros(len(t), bool), np.ones(len(t))
    if len(found):
        own = np.searchsorted(starts, found, side="right")
        first = np.flatnonzero(np.diff(own, prepend=0))
        tf, sf = t[found], stat[found]
        if reduce_func is None:
            wins = _winners(tf, first, sf, half)
        else:
            wins = np.concatenate([_reduce(tf[p:q], sf[p:q], half, reduce_func) for p, q in zip(first, [*first[1:], len(tf)], strict=True)])
        # a point is its time: all its rows count
        new = np.diff(t, prepend=t[0]) != 0
        new[starts] = True
        moment = np.cumsum(new)
        kept = np.bincount(moment[found[wins]], minlength=moment[-1] + 1)
        # the mark moves to the next row with a value
        prior = np.concatenate(([-1], np.maximum.accumulate(np.where(known, np.arange(len(t)), -1))[:-1]))
        inside = prior >= starts[np.searchsorted(starts, np.arange(len(t)), side="right") - 1]
        times = np.where(inside, np.maximum(kept[moment[prior]], 1), 1).astype(float)
        cp = known & inside & (kept[moment[prior]] > 0)
    return {"stat": stat, "cp": cp, "times": times}


def marked(
    s: Series, stat_func: str | Callable, thresh_func: float | Callable, window: str | tuple[str, str], min_periods: int | tuple[int, int], reduce_window: str | None = None, reduce_func: Callable | None = None, split: str | None = "90D",
) -> Series:
    """Adds ``cp``: rows right after a change point, ``stat``, and ``times``: how many rows the time of the point before has.

    ``stat_func``: the name of a statistic whose values before and after are compared, or a
    function of two arrays. All of it is one scan of stretches, each with the rows that its marks depend on.
    """
    if not callable(stat_func) and stat_func not in windows.NAMES:
        raise ValueError(f"unknown function {stat_func!r}")
    back, fore = (window, window) if isinstance(window, str) else window
    mb, mf = (min_periods, min_periods) if isinstance(min_periods, int) else min_periods
    b, f = micros(back), micros(fore)
    half = (micros(reduce_window) if reduce_window else b + f) // 2
    kernel = partial(_points, stat_func=stat_func, thresh_func=thresh_func, b=b, f=f, mb=mb, mf=mf, half=half, reduce_func=reduce_func)
    # a mark's point lies up to f before it, the points that thin it out up to half before and two halves after that, their windows beyond
    return near(s, max(f + half + b, 2 * half + f), split, lambda s: scan(s, kernel, {"stat": "double", "cp": "boolean", "times": "double"}))


def _joined(s: Series) -> Series:
    """Rows after a point of a repeated time as often as that time occurs, which is what the SQL's join of points and rows gives. Where key and time name one row, nothing changes."""
    return Series(s.df.withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("__again"), s.keys)


@flagging()
def flagChangePoints(s: Series, stat_func: str | Callable = "mean", thresh_func: float | Callable = 0.0, window: str | tuple[str, str] = "1D", min_periods: int | tuple[int, int] = 1, reduce_window: str | None = None, reduce_func: Callable | None = None, call: Call | None = None) -> Series:
    s = _joined(marked(s, stat_func, thresh_func, window, min_periods, reduce_window, reduce_func, call.qc.split))  # type: ignore[union-attr]
    return s.with_(hit=F.col("cp"))


@flagging()
def flagJumps(s: Series, thresh: float = 0.0, window: str = "1D", min_periods: int = 1, call: Call | None = None) -> Series:
    """Where the mean of the time before and after differ by more than ``thresh``."""
    s = _joined(marked(s, "mean", thresh, window, min_periods, split=call.qc.split))  # type: ignore[union-attr]
    return s.with_(hit=F.col("cp"))


def clusters(s: Series) -> Series:
    """Adds ``cluster``: one plus the change points so far."""
    return s.with_(cluster=(1 + F.sum(F.when(F.col("cp"), 1).otherwise(0)).over(s.order.rowsBetween(Window.unboundedPreceding, 0))).cast("double"))


@register()
def assignChangePointCluster(s: Series, stat_func: str | Callable = "mean", thresh_func: float | Callable = 0.0, window: str | tuple[str, str] = "1D", min_periods: int | tuple[int, int] = 1, reduce_window: str | None = None, reduce_func: Callable | None = None, model_by_resids: bool = False) -> Series:
    """Values replaced by the number of their regime, or by the change statistic; flags are cleared."""
    from ..flags import UNFLAGGED

    s = clusters(_joined(marked(s, stat_func, thresh_func, window, min_periods, reduce_window, reduce_func)))
    return s.with_(out=F.col("stat") if model_by_resids else F.col("cluster"), newflag=F.lit(UNFLAGGED))
