"""Fits of the course of a series, and residuals."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..frame import QC, Call, Series
from ..functions.rolling import frame
from ..kernels import numeric as k, windows
from ..plans.cells import match
from ..plans.halo import near
from ..registry import register
from ..timespan import micros
from .vector import apply, scan


def _poly(pdf: pd.DataFrame, window: int | None, rows: int | None, order: int, least: int) -> dict:
    x, t = pdf["value"].to_numpy(float), pdf["t"].to_numpy()
    out = np.full(len(x), np.nan)
    n = len(x)
    for i in np.flatnonzero(~np.isnan(x)):
        if rows is not None:
            h = rows // 2
            a, b = max(0, i - h), min(n, i + h + 1)
            if least == 0 and (i - h < 0 or i + h >= n):
                continue
        else:
            a, b = np.searchsorted(t, t[i] - window / 2), np.searchsorted(t, t[i] + window / 2, side="right")
        own = np.flatnonzero(~np.isnan(x[a:b])) + a
        if len(own) < max(least, order + 1):
            continue
        z = (t[own] - t[i]) / 60e6
        span = max(1.0, float(np.abs(z).max()))
        coef, *_ = np.linalg.lstsq(np.vander(z / span, order + 1), x[own], rcond=None)
        out[i] = coef[-1]
    return {"fit": out}


def _fitted(s: Series, window: str | int, order: int, min_periods: int) -> Series:
    """Adds ``fit``. A window in time and order up to two: from sums of powers over stretches of eight windows; else row by row."""
    if isinstance(window, int) or order > 2:
        rows = (window - 1 + window % 2) if isinstance(window, int) else None
        kernel = partial(_poly, window=None if rows else micros(window), rows=rows, order=order, least=min_periods)  # type: ignore[arg-type]
        s = apply(s, kernel, {"fit": "double"})
        return s.with_(fit=F.nanvl("fit", F.lit(None).cast("double")))
    kernel = partial(_fit, w=(w := micros(window)), order=order, least=min_periods)
    return near(s, w, True, lambda s: scan(s, kernel, {"fit": "double"}))


def _fit(t: np.ndarray, starts: np.ndarray, cols: dict[str, np.ndarray], w: int, order: int, least: int) -> dict:
    """The fitted value at each row, from sums of powers of the time around it."""
    y = cols["value"]
    since = (t - np.repeat(t[starts], np.diff(starts, append=len(t)))).astype(float)
    m, r = windows.power_sums(*windows.bounds(t, starts, -(w // 2), w // 2), since, since, 2 * order, y, order, scale=w)
    with np.errstate(divide="ignore", invalid="ignore"):
        if order == 0:
            over, under, size = r[0], m[0], m[0]
        elif order == 1:
            over, under, size = r[0] * m[2] - r[1] * m[1], m[0] * m[2] - m[1] * m[1], m[0] * m[2]
        else:
            det = lambda a: a[0] * (a[4] * a[8] - a[5] * a[7]) - a[1] * (a[3] * a[8] - a[5] * a[6]) + a[2] * (a[3] * a[7] - a[4] * a[6])
            over, under, size = det([r[0], m[1], m[2], r[1], m[2], m[3], r[2], m[3], m[4]]), det([m[0], m[1], m[2], m[1], m[2], m[3], m[2], m[3], m[4]]), m[0] * m[2] * m[4]
        # too few different times leave nothing but rounding
        return {"fit": np.where((m[0] >= max(least, order + 1)) & ~np.isnan(y) & (np.abs(under) > 1e-14 * size), over / under, np.nan)}


@register()
def fitPolynomial(s: Series, window: str | int = "1D", order: int = 1, min_periods: int = 0) -> Series:
    """The value at each row of a polynomial fitted to the window around it; flags become their rolling maximum."""
    flag = F.max("flag").over(frame(s, window, True))
    s = _fitted(s.with_(wide=flag), window, order, min_periods)
    return s.with_(out=F.col("fit"), newflag=F.col("wide"))


@register()
def calculatePolynomialResiduals(s: Series, window: str | int = "1D", order: int = 1, min_periods: int = 0) -> Series:
    s = _fitted(s, window, order, min_periods)
    return s.with_(out=F.col("value") - F.col("fit"))


def _low(pdf: pd.DataFrame, cutoff: float | int, nyq: float, order: int, method: str) -> dict:
    x, t = pdf["value"].to_numpy(float), pdf["t"].to_numpy()
    gaps = np.isnan(x)
    y = k.interpolate(t, x, method, None, "both")
    if isinstance(cutoff, int):  # a period, in steps of the series
        steps = np.unique(np.diff(t))
        if len(steps) != 1:
            raise ValueError("a period as cutoff needs a series of one step")
        cutoff = float(steps[0]) / cutoff / nyq
    out = None if np.isnan(y).any() else k.filtfilt(*k.butter_low(order, cutoff), y)
    return {"fit": np.where(gaps, np.nan, out if out is not None else np.nan)}


@register()
def fitLowpassFilter(s: Series, cutoff: float | str = 0.1, nyq: float = 0.5, filter_order: int = 2, fill_method: str = "linear") -> Series:
    """Zero-phase Butterworth low-pass; ``cutoff`` as a frequency for the Nyquist frequency ``nyq``, or as a period, for a series of one step."""
    share = micros(cutoff) if isinstance(cutoff, str) else float(cutoff) / nyq
    s = apply(s, partial(_low, cutoff=share, nyq=nyq, order=filter_order, method=fill_method), {"fit": "double"})
    return s.with_(out=F.nanvl("fit", F.lit(None).cast("double")))


@register(multivariate=True)
def fitMomentFM(call: Call, fields: list[str], targets: list[str], ratio: int = 4, context: int = 512, agg: str = "mean", model: Callable | None = None) -> QC:
    """Reconstruction of the fields by a model that the caller brings: ``model(rows x fields) -> rows x fields`` for each series."""
    if model is None:
        raise NotImplementedError("no pretrained model comes with this package; pass one as model=")
    on = [*call.qc.keys, "t"]
    from .outliers import _joint

    s = _joint(call, targets)
    cols = [f"v{i}" for i in range(len(targets))]

    def kernel(pdf: pd.DataFrame) -> dict:
        out = np.asarray(model(pdf[cols].to_numpy(float)), float)
        return {f"o{i}": out[:, i] for i in range(len(cols))}

    s = apply(s, kernel, {f"o{i}": "double" for i in range(len(cols))}, reads=cols)
    qc = call.qc
    for i, t in enumerate(targets):
        df = match(qc.fields[t].df, s.df.select(*on, F.nanvl(f"o{i}", F.lit(None).cast("double")).alias("out")), on, "left").withColumn("masked", F.lit(False))
        qc = Call(**{**call.__dict__, "qc": qc}).write(t, Series(df, qc.keys))
    return qc


@register(demask=True)
def interpolateNANs(s: Series, method: str = "time", order: int = 2, gap_limit: int | None = None, extrapolate: str | None = None) -> Series:
    """Fill gaps shorter than ``gap_limit`` values."""

    def kernel(pdf: pd.DataFrame) -> dict:
        return {"fit": k.interpolate(pdf["t"].to_numpy(), pdf["value"].to_numpy(float), method, gap_limit, extrapolate, order)}

    s = apply(s, kernel, {"fit": "double"})
    return s.with_(out=F.nanvl("fit", F.lit(None).cast("double")))


