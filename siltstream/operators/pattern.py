"""Courses of known form: patterns by time warping, plateaus by wavelets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pandas as pd

from ..frame import Call, Series
from ..kernels import numeric as k
from ..registry import flagging
from ..timespan import micros
from .vector import apply


def _dtw(pdf: pd.DataFrame, ref: np.ndarray, span: int, limit: float, normalize: bool) -> dict:
    x, t = pdf["value"].to_numpy(float), pdf["t"].to_numpy()
    n = len(x)
    dist = np.full(n, np.inf)
    ends = np.searchsorted(t, t + span, side="right")
    for i in range(n):
        if t[i] + span > t[-1]:
            continue  # the window reaches beyond the series
        v = x[i : ends[i]]
        v = v[~np.isnan(v)]
        if len(v):
            dist[i] = k.dtw(v, ref) / (len(ref) if normalize else 1)
    hit = np.zeros(n, bool)
    starts = np.searchsorted(t, t - span)
    for i in np.flatnonzero(dist <= limit):
        if dist[i : ends[i]].min() == dist[starts[i] : i + 1].min():
            hit[i : ends[i]] = True
    return {"hit": hit}


@flagging()
def flagPatternByDTW(s: Series, reference: str | Sequence[tuple[object, float]] = (), max_distance: float = 0.0, normalize: bool = True, plot: bool = False, call: Call | None = None) -> Series:
    """Stretches whose course is within a warping distance of a reference: another field, or pairs of (microseconds, value). The reference is a short pattern."""
    if isinstance(reference, str):
        rows = call.qc.fields[reference].df.select("t", "value").orderBy("t").limit(100_001).collect()  # type: ignore[union-attr]
        if len(rows) > 100_000:
            raise ValueError("a reference pattern has at most 100,000 rows")
        pairs = [(r["t"], r["value"]) for r in rows]
    else:
        pairs = [(micros(a) if isinstance(a, str) and a[0] != "0" else int(a), b) for a, b in reference]  # type: ignore[call-overload]
    if not pairs or any(v is None for _, v in pairs):
        raise ValueError("a reference has values and none missing")
    span = int(pairs[-1][0] - pairs[0][0])
    return apply(s, partial(_dtw, ref=np.array([float(v) for _, v in pairs]), span=span, limit=max_distance, normalize=normalize), {"hit": "boolean"})


def _plateau(pdf: pd.DataFrame, least: int, most: int | None, jump: float | None, grain: int | None) -> dict:
    raw, t = pdf["value"].to_numpy(float), pdf["t"].to_numpy()
    n, hit = len(raw), np.zeros(len(raw), bool)
    if n < 5 or np.isnan(raw).all():
        return {"hit": hit}
    x = pd.Series(raw).ffill().bfill().to_numpy()
    step = float(np.median(np.diff(t)))
    low = max(2, int(round(least / step)))
    high = min(n // 3, int(round(most / step)) if most else n // 10)
    if high < low:
        high = low
    if jump is None:
        far = k.stray(np.abs(np.diff(x)), 0.5, 0.05)
        if not len(far):
            return {"hit": hit}
        jump = 2 * float(np.median(np.abs(np.diff(x)))) or float(np.abs(np.diff(x))[far].min()) / 2
    half = max(0.5, low / 2)
    scales = np.arange(half, high / 2 + 1, max(1, grain or 5) / 2)
    best, scale = np.full(n, -np.inf), np.zeros(n)
    for w in scales:
        wave = k.ricker(w)
        m = len(wave) // 2
        ext = np.pad(x, m, mode="edge")
        c = np.abs(np.convolve(ext, wave, mode="same")[m : m + n]) / np.sqrt(w)
        better = c > best
        best[better], scale[better] = c[better], w
    # around each peak of the response, the two widest jumps of opposite sign bound the plateau
    d = np.diff(x)
    for i in np.argsort(-best):
        if hit[i]:
            continue
        w = int(np.ceil(scale[i] * 2)) + 2
        a, b = max(0, i - w), min(n - 1, i + w)
        left, right = d[a:i], d[i:b]
        if not len(left) or not len(right):
            continue
        for sign in (1, -1):
            p, q = a + int(np.argmax(sign * left)), i + int(np.argmin(sign * right))
            if sign * d[p] < jump or -sign * d[q] < jump:
                continue
            size = q - p
            inside = x[p + 1 : q + 1]
            if low <= size <= high and (sign * (inside - max(sign * x[p], sign * x[q + 1]) * sign) >= jump / 2).all():
                hit[p + 1 : q + 1] = True
        if best[i] <= 0:
            break
    return {"hit": hit & ~np.isnan(raw)}


@flagging()
def flagPlateau(s: Series, min_length: str = "1h", max_length: str | None = None, min_jump: float | None = None, granularity: str | int | None = None) -> Series:
    """Stretches on another level, bounded by jumps of opposite sign: a wavelet of the stretch's scale finds them, the jumps give the edges."""
    grain = granularity if isinstance(granularity, int) else None
    return apply(s, partial(_plateau, least=micros(min_length), most=micros(max_length) if max_length else None, jump=min_jump, grain=grain), {"hit": "boolean"})
