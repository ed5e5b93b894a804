"""Aggregates over windows in time or rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import Series
from ..timespan import micros


def reach(window: str, center: bool = False, closed: str = "right", forward: bool = False) -> tuple[int, int]:
    """The first and last microsecond of a window in time, around a row's."""
    w = micros(window)
    if center:
        return (-(w // 2), w // 2) if closed == "both" else (-(w // 2 - 1), w // 2)
    low, high = {"right": (-(w - 1), 0), "both": (-w, 0), "left": (-w, -1), "neither": (-(w - 1), -1)}[closed]
    return (-high, -low) if forward else (low, high)


def frame(s: Series, window: str | int, center: bool = False, closed: str = "right", forward: bool = False):
    """The frame of a window: an offset string (time) or a number of rows."""
    if isinstance(window, int):
        if window < 1:
            raise ValueError("a window has one row or more")
        if center:
            off = (window - 1) // 2
            return s.rows(off - window + 1, off)
        return s.rows(0, window - 1) if forward else s.rows(-(window - 1), 0)
    return s.span(*reach(window, center, closed, forward))


def _moments(c: Column, w) -> tuple[Column, ...]:
    n = F.count(c).over(w)
    mean = F.avg(c).over(w)
    p2, p3, p4 = (F.avg(F.pow(c, F.lit(k))).over(w) for k in (2, 3, 4))
    m2 = p2 - mean * mean
    m3 = p3 - 3 * mean * p2 + 2 * F.pow(mean, F.lit(3))
    m4 = p4 - 4 * mean * p3 + 6 * mean * mean * p2 - 3 * F.pow(mean, F.lit(4))
    return n, m2, m3, m4


def over(func: str | Callable, c: Column, w) -> Column:
    """A named statistic, or a callable on a pandas Series, over a window; missing values are left out."""
    if callable(func):
        import pandas as pd

        def own(v: pd.Series) -> float:
            v = v.dropna()
            return float(func(v)) if len(v) else float("nan")

        own.__annotations__ = {"v": pd.Series, "return": float}
        return F.nanvl(F.pandas_udf(own, "double")(c).over(w), F.lit(None).cast("double"))
    simple = {"sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "first": lambda x: F.first(x, True), "last": lambda x: F.last(x, True)}
    if func in simple:
        return simple[func](c).over(w).cast("double")
    if func == "median":
        return F.percentile(c, F.lit(0.5)).over(w)
    n = F.count(c).over(w)
    if func in ("std", "var", "sem"):
        v = F.when(n >= 2, (F.var_samp if func == "var" else F.stddev_samp)(c).over(w))
        return F.try_divide(v, F.sqrt(n)) if func == "sem" else v
    if func == "skew":
        n, m2, m3, _ = _moments(c, w)
        g = F.try_divide(m3, F.pow(m2, F.lit(1.5)))
        return F.when((n >= 3) & (m2 > 1e-14), F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0)) * g)
    if func == "kurt":
        n, m2, _, m4 = _moments(c, w)
        g = F.try_divide(m4, m2 * m2) - 3
        return F.when((n >= 4) & (m2 > 1e-14), (n - 1.0) / F.nullif((n - 2.0) * (n - 3.0), F.lit(0.0)) * ((n + 1.0) * g + 6))
    raise ValueError(f"unknown function {func!r}")


def rolling(s: Series, c: Column, window: str | int, func: str | Callable = "mean", min_periods: int | None = None, center: bool = False, closed: str = "right", forward: bool = False) -> Column:
    """A rolling statistic; null where the window has fewer than min_periods values (default: all rows of an integer window, else 1)."""
    w = frame(s, window, center, closed, forward)
    least = (window if isinstance(window, int) else 1) if min_periods is None else min_periods
    out = over(func, c, w)
    # a count is of values, but its window is full by its rows
    n = F.count(F.lit(1)).over(w) if func == "count" else F.count(c).over(w)
    return F.when(n >= least, out) if least > 0 else out
