"""Tests and transformations over windows of time."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..flags import UNFLAGGED
from ..frame import QC, Call, Field, Series
from ..functions.rolling import frame, over, reach, rolling as stat
from ..kernels import windows
from ..plans.halo import bounded, near
from ..plans.cells import match
from ..registry import flagging, register
from ..timespan import micros
from .vector import apply, scan


def _reach(times: int = 1, default: str | None = "1D", key: str = "window"):
    """How far a row's result depends on others: a multiple of the window; no bound for windows in rows or over the whole series."""

    def reach(kw: dict) -> int | None:
        w = kw.get(key, default)
        return None if w is None or isinstance(w, int) else times * micros(w)

    return reach


def _full(s: Series, window: str | int) -> Column:
    """Rows whose backward window lies inside the series."""
    if isinstance(window, int):
        return F.row_number().over(s.order) >= window
    return F.col("t") - F.min("t").over(s.whole) >= micros(window) - 1


def _rolled(t: np.ndarray, starts: np.ndarray, cols: dict[str, np.ndarray], low_high: tuple[int, int], func: str, least: int) -> dict:
    """A statistic of the window's values, and the greatest of its flags if these are read."""
    a, b = windows.bounds(t, starts, *low_high)
    x = cols["value"]
    out = windows.statistic(func, a, b, x)
    if least > 0:
        # a count is of values, but its window is full by its rows
        out = np.where((b - a if func == "count" else windows.counts(a, b, x)) >= least, out, np.nan)
    return {"out": out} | ({"newflag": windows.extreme(a, b, cols["flag"])} if "flag" in cols else {})


@register(multivariate=True, handles_target=True, name="rolling")
def rolling_(call: Call, fields: list[str], targets: list[str], window: str | int = "1D", func: str | Callable = "mean", min_periods: int = 0, center: bool = True) -> QC:
    """Replace values by a rolling statistic and flags by their rolling maximum; several fields to one target: over all their values."""
    qc, on = call.qc, [*call.qc.keys, "t"]
    if len(targets) == 1 and len(fields) > 1:
        parts = [call.masked(f).df.select(*on, F.col("value").alias(f"v{i}")) for i, f in enumerate(fields)]
        s = Series(reduce(lambda a, b: match(a, b, on, "full_outer"), parts), qc.keys)
        cols = [F.col(f"v{i}") for i in range(len(fields))]
        w = frame(s, window, center)
        n = reduce(Column.__add__, [F.count(c).over(w) for c in cols])
        total = reduce(Column.__add__, [F.coalesce(F.sum(c).over(w), F.lit(0.0)) for c in cols])
        square = reduce(Column.__add__, [F.coalesce(F.sum(c * c).over(w), F.lit(0.0)) for c in cols])
        var = F.try_divide(square - F.try_divide(total * total, n), F.nullif(n - 1, F.lit(0)))
        every = F.flatten(F.collect_list(F.array(*cols)).over(w))
        known = F.array_sort(F.filter(every, lambda x: x.isNotNull()))
        half = (F.size(known) + 1) / 2
        median = (F.try_element_at(known, F.floor(half).cast("int")) + F.try_element_at(known, F.ceil(half).cast("int"))) / 2
        value = {"count": n.cast("double"), "sum": total, "mean": F.try_divide(total, n), "var": F.greatest(var, F.lit(0.0)), "std": F.sqrt(F.greatest(var, F.lit(0.0))), "median": F.when(n > 0, median),
                 "min": reduce(F.least, [F.min(c).over(w) for c in cols]), "max": reduce(F.greatest, [F.max(c).over(w) for c in cols])}[func]
        if isinstance(window, int):
            value = F.when(F.count(F.lit(1)).over(w) >= window, value)
        value = F.when(n >= min_periods, value) if min_periods else value
        df = s.df.select(*on, value.cast("double").alias("value"), F.lit(None).cast("double").alias("flag"), F.array(F.lit(None).cast("double")).alias("hist"))
        return qc._new({**qc.fields, targets[0]: Field(df, (call.meta(),))})
    for f, t in zip(fields, targets, strict=True):
        if isinstance(window, str) and func in windows.NAMES:
            kernel = partial(_rolled, low_high=reach(window, center), func=func, least=min_periods)
            # what was hidden does not come back, so it need not pass through Python
            own = Series(call.masked(f).df.drop("raw", "masked"), qc.keys)
            out = near(own, micros(window), qc.split, lambda s: scan(s, kernel, {"out": "double", "newflag": "double"}, ("value", "flag")))
        else:
            run = lambda s: s.with_(out=stat(s, F.col("value"), window, func, min_periods, center), newflag=F.max("flag").over(frame(s, window, center)))
            out = run(call.masked(f)) if isinstance(window, int) or not qc.split else bounded(call.masked(f), micros(window), micros(qc.split), run)
        qc = Call(**{**call.__dict__, "qc": qc._new({**qc.fields, t: qc.fields[f]})}).write(t, out)
    return qc


def _constant(t: np.ndarray, starts: np.ndarray, cols: dict[str, np.ndarray], w: int, thresh: float, least: int) -> dict:
    x = cols["value"]
    a, b = windows.bounds(t, starts, -(w - 1), 0)
    with np.errstate(invalid="ignore"):
        const = windows.extreme(a, b, x) - windows.extreme(a, b, x, np.fmin) <= thresh
    const &= (windows.counts(a, b, x) >= least) & (t - cols["first"] >= w - 1)
    a, b = windows.bounds(t, starts, 0, w - 1)
    n = np.concatenate(([0], np.cumsum(const)))
    return {"hit": (n[b] > n[a]) & ~np.isnan(x)}


@flagging()
def flagConstants(s: Series, thresh: float = 0.0, window: str | int = 2, min_periods: int = 2, call: Call | None = None) -> Series:
    """Values inside a window in which they vary by at most ``thresh``."""
    if isinstance(window, str):
        kernel = partial(_constant, w=micros(window), thresh=thresh, least=min_periods)
        split = call.qc.split  # type: ignore[union-attr]
        return near(s.summed(first=F.min("t")), micros(window), split, lambda s: scan(s, kernel, {"hit": "boolean"}, ("value", "first")))
    w = frame(s, window)
    const = (F.max(F.col("value")).over(w) - F.min(F.col("value")).over(w) <= thresh) & (F.count(F.col("value")).over(w) >= min_periods) & _full(s, window)
    s = s.with_(const=F.when(const, 1).otherwise(0))
    return s.with_(hit=(F.max("const").over(frame(s, window, forward=True)) == 1) & F.col("value").isNotNull())


def _cover(s: Series, exceeds: Column, window: str | int) -> Series:
    """Flag every row that a window with the property covers."""
    s = s.with_(exceeds=F.when(F.coalesce(exceeds, F.lit(False)), 1).otherwise(0))
    return s.with_(hit=F.max("exceeds").over(frame(s, window, forward=True)) == 1)


@flagging()
def flagByVariance(s: Series, window: str | int = "1D", thresh: float = 0.0, maxna: int | None = None, maxna_group: int | None = None) -> Series:
    """Windows whose variance is below ``thresh`` and that lack no more values than allowed."""
    w = frame(s, window)
    low = (F.var_samp(F.col("value")).over(w) < thresh) & _full(s, window)
    missing = F.sum(F.when(F.col("value").isNull(), 1).otherwise(0)).over(w)
    low = low & (missing <= (0 if maxna is None and maxna_group is None else maxna if maxna is not None else 2**31))
    if maxna_group is not None:
        s = with_null_run(s, F.col("value"))
        low = low & (F.max("run").over(w) <= maxna_group)
    return _cover(s, low, window)


def with_null_run(s: Series, c: Column, name: str = "run") -> Series:
    """Adds the number of missing values up to and with this row, without a value between."""
    s = s.with_(__i=F.row_number().over(s.order))
    upto = s.order.rowsBetween(Window.unboundedPreceding, 0)
    return s.with_(**{name: F.col("__i") - F.coalesce(F.last(F.when(c.isNotNull(), F.col("__i")), True).over(upto), F.lit(0))})


@flagging(reach=_reach(2))
def flagByScatterLowpass(s: Series, window: str | int = "1D", thresh: float = 0.0, func: str | Callable = "std", sub_window: str | None = None, sub_thresh: float | None = None, min_periods: int | None = None) -> Series:
    """Windows whose statistic is above ``thresh`` - and, with a sub window, all of whose parts' statistics are above ``sub_thresh``."""
    over_ = stat(s, F.col("value"), window, func, min_periods) > thresh
    if sub_window is not None:
        s = s.with_(part=stat(s, F.col("value"), sub_window, func, min_periods))
        rest = micros(window) - micros(sub_window)  # type: ignore[arg-type]
        over_ = over_ & (F.min("part").over(s.span(-rest, 0)) > sub_thresh)
    return _cover(s, over_, window)


def _medians(pdf: pd.DataFrame, low: int, high: int) -> dict:
    """Rolling median, and rolling median of the distances from it: a sorted window, as a percentile frame would count each window anew."""
    t = pdf["t"].to_numpy().tolist()

    def median(values: np.ndarray) -> np.ndarray:
        v, out, window, a, b = values.tolist(), np.full(len(values), np.nan), [], 0, 0
        for i, now in enumerate(t):
            while b < len(t) and t[b] <= now + high:
                if v[b] == v[b]:
                    insort(window, v[b])
                b += 1
            while t[a] < now + low:
                if v[a] == v[a]:
                    del window[bisect_left(window, v[a])]
                a += 1
            if k := len(window):
                out[i] = (window[(k - 1) // 2] + window[k // 2]) / 2
        return out

    x = pdf["value"].to_numpy(float)
    middle = median(x)
    return {"middle": middle, "dev_": median(np.abs(x - middle))}


def _zscore(s: Series, c: Column, method: str, window: str | int | None, center: bool, min_periods: int | None) -> tuple[Series, Column, Column]:
    if window is None and method in ("standard", "modified"):
        if method == "standard":
            return s.summed(middle=F.avg(c), dev_=F.stddev_samp(c)), F.col("middle"), F.col("dev_")
        s = s.summed(middle=F.percentile(c, F.lit(0.5)))
        return s.summed(dev_=F.percentile(F.abs(c - F.col("middle")), F.lit(0.5))), F.col("middle"), F.col("dev_")
    w = s.whole if window is None else frame(s, window, center)
    if method == "standard":
        return s, F.avg(c).over(w), (F.stddev_samp(c).over(w))
    if method != "modified":
        raise ValueError("method is standard or modified")
    if isinstance(window, str):
        m = micros(window)
        low, high = (-(m // 2 - 1), m // 2) if center else (-(m - 1), 0)
        s = apply(s, partial(_medians, low=low, high=high), {"middle": "double", "dev_": "double"})
        clean = {k: F.nanvl(k, F.lit(None).cast("double")) for k in ("middle", "dev_")}
        return s.with_(**clean), F.col("middle"), F.col("dev_")
    s = s.with_(middle=F.percentile(c, F.lit(0.5)).over(w))
    s = s.with_(away=F.abs(c - F.col("middle")))
    return s, F.col("middle"), F.percentile("away", F.lit(0.5)).over(w)


@register(mask=True, demask=True, multivariate=True)
def flagZScore(call: Call, fields: list[str], targets: list[str], method: str = "standard", window: str | int | None = None, thresh: float = 3.0, min_residuals: float | None = None, min_periods: int | None = None, center: bool = True, axis: int = 0) -> QC:
    """Values further from the mean (or median) than ``thresh`` standard (or median absolute) deviations; axis 1: over all fields at each time."""
    qc = call.qc
    if axis == 1:
        return _cross(call, targets, method, window, thresh, min_residuals, center)
    for t in targets:
        def run(s: Series) -> Series:
            s, mid, dev = _zscore(s, F.col("value"), method, window, center, min_periods)
            s = s.with_(mid=mid, dev=dev)
            rest = F.abs(F.col("value") - F.col("mid"))
            hit = rest > thresh * F.col("dev")
            if min_residuals:
                hit = hit & (rest >= min_residuals)
            if min_periods:
                hit = hit & (F.count(F.col("value")).over(s.whole if window is None else frame(s, window, center)) >= min_periods)
            return s.with_(hit=hit)

        s = Call(**{**call.__dict__, "qc": qc}).masked(t)
        s = run(s) if window is None or isinstance(window, int) or not qc.split else bounded(s, 2 * micros(window), micros(qc.split), run)
        qc = Call(**{**call.__dict__, "qc": qc}).write(t, s)
    return qc


def _cross(call: Call, fields: list[str], method: str, window: str | int | None, thresh: float, least: float | None, center: bool) -> QC:
    """All fields' values in a window pooled: as rows of one long table, since frames need no join."""
    qc, keys = call.qc, call.qc.keys
    long_ = reduce(lambda a, b: a.union(b), [call.masked(f).df.select(*keys, "t", F.lit(f).alias("__f"), "value") for f in fields])
    s = Series(long_, keys)
    if window is None:
        w = s.whole
    elif isinstance(window, int):
        s = s.with_(t0=F.col("t"), t=F.dense_rank().over(s.order).cast("long"))
        w = s.span(-((window - 1) // 2 if center else window - 1), window // 2 if center else 0)
    else:
        w = frame(s, window, center)
    if method == "standard":
        s = s.with_(mid=F.avg(F.col("value")).over(w), dev=F.stddev_samp(F.col("value")).over(w))
    else:
        s = s.with_(mid=F.percentile(F.col("value"), F.lit(0.5)).over(w))
        s = s.with_(away=F.abs(F.col("value") - F.col("mid")))
        s = s.with_(dev=F.percentile("away", F.lit(0.5)).over(w))
    rest = F.abs(F.col("value") - F.col("mid"))
    hit = (rest > thresh * F.col("dev")) & (rest >= (least or 0.0))
    time = F.col("t0") if window is not None and isinstance(window, int) else F.col("t")
    hits = s.df.select(*keys, time.alias("t"), "__f", F.coalesce(hit, F.lit(False)).alias("hit")).filter("hit")
    for f in fields:
        own = hits.filter(F.col("__f") == f).drop("__f").distinct()
        df = call.masked(f).df.drop("value").withColumnRenamed("raw", "value").join(own, [*keys, "t"], "left")
        qc = Call(**{**call.__dict__, "qc": qc}).write(f, Series(df, keys))
    return qc


@flagging(reach=_reach(2, None))
def flagMAD(s: Series, window: str | int | None = None, z: float = 3.5, min_residuals: float | None = None, min_periods: int | None = None, center: bool = False) -> Series:
    s, mid, dev = _zscore(s, F.col("value"), "modified", window, center, min_periods)
    s = s.with_(mid=mid, dev=dev)
    rest = F.abs(F.col("value") - F.col("mid"))
    return s.with_(hit=(rest > z * F.col("dev")) & (rest >= (min_residuals or 0.0)))


@register(reach=_reach(1, None))
def assignZScore(s: Series, window: str | int | None = None, norm_func: str | Callable = "std", model_func: str | Callable = "mean", center: bool = True, min_periods: int | None = None) -> Series:
    """Values as (x - model) / norm; over the whole series the deviation is the population's."""
    if window is None and norm_func == "std" and model_func == "mean":
        s = s.summed(norm0=F.stddev_pop("value"), mid0=F.avg("value"))
        norm, mid = F.col("norm0"), F.col("mid0")
    elif window is None:
        norm = F.stddev_pop(F.col("value")).over(s.whole) if norm_func == "std" else over(norm_func, F.col("value"), s.whole)
        mid = over(model_func, F.col("value"), s.whole)
    else:
        norm, mid = stat(s, F.col("value"), window, norm_func, min_periods or 0, center), stat(s, F.col("value"), window, model_func, min_periods or 0, center)
    return s.with_(norm=norm, mid=mid).with_(out=F.try_divide(F.col("value") - F.col("mid"), F.col("norm")))


@register(demask=True)
def interpolateByRolling(s: Series, window: str | int = "1D", func: str | Callable = "median", center: bool = True, min_periods: int = 0, flag: float = UNFLAGGED, call: Call | None = None) -> Series:
    """Fill missing values by a rolling statistic; filled rows get ``flag``."""
    split = call.qc.split  # type: ignore[union-attr]
    if isinstance(window, str) and func in windows.NAMES:
        kernel = partial(_rolled, low_high=reach(window, center), func=func, least=min_periods)
        s = near(s, micros(window), split, lambda s: scan(s, kernel, {"out": "double"}))
        s = Series(s.df.withColumnRenamed("out", "fill"), s.keys)
    else:
        run = lambda s: s.with_(fill=stat(s, F.col("value"), window, func, min_periods, center))
        s = run(s) if isinstance(window, int) or not split else bounded(s, micros(window), micros(split), run)
    filled = F.col("value").isNull() & F.col("fill").isNotNull()
    return s.with_(out=F.coalesce(F.col("value"), "fill"), newflag=F.when(filled, F.lit(flag)))


@register(reach=_reach())
def calculateRollingResiduals(s: Series, window: str | int = "1D", func: str | Callable = "mean", min_periods: int = 0, center: bool = True) -> Series:
    return s.with_(mid=stat(s, F.col("value"), window, func, min_periods, center)).with_(out=F.col("value") - F.col("mid"))


@flagging()
def flagIsolated(s: Series, gap_window: str = "1D", group_window: str = "1D") -> Series:
    """Groups of values between gaps of at least ``gap_window`` that last less than ``group_window``; the first and last group never count."""
    gap, size = micros(gap_window), micros(group_window)
    known = F.when(F.col("value").isNotNull(), F.col("t"))
    s = s.with_(known=known).with_(before=F.last("known", True).over(s.past))
    s = s.with_(start=F.when(F.col("value").isNotNull() & (F.col("before").isNull() | (F.col("t") - F.col("before") >= gap)), 1).otherwise(0))
    s = s.with_(group=F.sum("start").over(s.order.rowsBetween(Window.unboundedPreceding, 0)))
    g = Window.partitionBy(*s.by("group"))
    s = s.with_(a=F.min("known").over(g), b=F.max("known").over(g), last=F.max("group").over(s.whole))
    return s.with_(hit=F.col("value").isNotNull() & (F.col("group") > 1) & (F.col("group") < F.col("last")) & (F.col("b") - F.col("a") < size))


@flagging()
def flagRaise(s: Series, thresh: float = 0.0, raise_window: str = "1D", freq: str = "10min", average_window: str | None = None, raise_factor: float = 2.0, slope: float | None = None, weight: float = 0.8) -> Series:
    """Values that rose by ``thresh`` within a window and stand out of the weighted mean of the time before."""
    w = micros(raise_window)
    avg = micros(average_window) if average_window else w * 3 // 2
    low = F.min(F.col("value")).over(s.span(-w, -1))
    s = s.with_(rise=F.col("value") - low, gap=F.least((F.col("t") - F.last(F.when(F.col("value").isNotNull(), F.col("t")), True).over(s.past)) / micros(freq), F.lit(1.5)))
    s = s.with_(weight=F.when(F.col("value").isNotNull(), F.when(F.col("gap") > 1 / weight, F.col("gap")).otherwise(F.coalesce("gap", F.lit(1.0)))))
    before = s.span(-avg, -1)
    mean = F.try_divide(F.sum(F.col("value") * F.col("weight")).over(before), F.sum("weight").over(before))
    hit = (F.col("rise") >= thresh) & (F.col("value") >= mean + F.col("rise") / raise_factor)
    if slope is not None:
        hit = hit & (F.col("value") - F.last(F.col("value"), True).over(s.past) > slope)
    return s.with_(hit=hit)


@register()
def transform(s: Series, func: str | Callable = "zScore", freq: str | int | None = None) -> Series:
    """Apply a named transformation (or a function of a column and its window) to the whole series, periods of time, or blocks of rows."""
    from ..functions.expr import environment

    block = F.lit(0)
    if isinstance(freq, int):
        block = F.floor((F.row_number().over(s.order) - 1) / freq)
    elif freq is not None:
        # periods begin at midnight of the series' first day
        first = F.floor(F.min("t").over(s.whole) / 86_400_000_000) * 86_400_000_000
        block = F.floor((F.col("t") - first) / micros(freq))
    b = Series(s.with_(block=block).df, (*s.keys, "block"))
    name = {"standardizeByMean": "zScore", "standardizeByMedian": "madScore", "standardizeByIQR": "iqsScore", "normScale": "scale"}.get(func, func) if isinstance(func, str) else func
    if name in ("madScore", "mad"):
        b = b.summed(mid=F.percentile("value", F.lit(0.5)))
        b = b.summed(dev=F.percentile(F.abs(F.col("value") - F.col("mid")), F.lit(0.5)))
        out = F.col("dev") if name == "mad" else F.try_divide(F.col("value") - F.col("mid"), F.col("dev"))
    else:
        out = environment(b)[name](F.col("value")) if isinstance(name, str) else name(F.col("value"), b)
    return Series(b.with_(out=out).df, s.keys)
