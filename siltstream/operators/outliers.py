"""Outlier tests and scores whose algorithms are sequential or need neighbours."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..flags import UNFLAGGED
from ..frame import QC, Call, Field, Series
from ..kernels import numeric as k
from ..plans.cells import match
from ..registry import flagging, register
from ..timespan import micros
from .vector import apply, blocks_of


# ---- offsets: plateaus that return to their starting level


def _offset_pass(t: np.ndarray, x: np.ndarray, window: int, tol: float | None, thresh: float | None, rel: float | None) -> np.ndarray:
    hit, corners = np.zeros(len(x), bool), set()
    level = thresh or 0.0
    for c in range(len(x) - 1):
        if abs(x[c + 1] - x[c]) <= level or c in corners:
            continue
        up = math.copysign(1, rel) if rel is not None else 0
        if rel is not None and not up * x[c + 1] > up * x[c] * (1 + rel):
            continue
        near = tol if tol is not None else thresh if thresh is not None else abs(x[c] * rel)  # type: ignore[operator]
        j = c + 2
        while j < len(x) and t[j] - t[c] <= window and abs(x[j] - x[c]) >= near:
            j += 1
        if j >= len(x) or t[j] - t[c] > window:
            continue
        mid = x[c + 1 : j]
        side = math.copysign(1, x[c + 1] - x[c])
        if (side * (mid - x[c]) > level).all() and (rel is None or (up * mid > up * x[c] * (1 + rel)).all()):
            hit[c + 1 : j] = True
            corners.add(j - 1)
    return hit


def _offset(pdf: pd.DataFrame, window: int, tol: float | None, passes: list[tuple[float | None, float | None]]) -> dict:
    x, t = pdf["value"].to_numpy(float), pdf["t"].to_numpy()
    out = np.zeros(len(x), bool)
    for thresh, rel in passes:
        own = np.flatnonzero(~np.isnan(x) & ~out)
        out[own[_offset_pass(t[own], x[own], window, tol, thresh, rel)]] = True
    return {"hit": out}


@flagging()
def flagOffset(s: Series, window: str = "1D", tolerance: float | None = None, thresh: float | None = None, thresh_relative: float | tuple[float, float] | None = None) -> Series:
    """Values that jump by more than ``thresh`` (and relatively) and return to within ``tolerance`` of the start inside the window."""
    if thresh is None and thresh_relative is None:
        raise ValueError("thresh or thresh_relative is needed")
    rel = thresh_relative if isinstance(thresh_relative, (tuple, list)) else (thresh_relative,)
    return apply(s, partial(_offset, window=micros(window), tol=tolerance, passes=[(thresh, r) for r in rel]), {"hit": "boolean"})


# ---- tests on blocks


def _grubbs(pdf: pd.DataFrame, alpha: float, least: int) -> dict:
    x = pdf["value"].to_numpy(float)
    hit = np.zeros(len(x), bool)
    if (~np.isnan(x)).sum() > least:
        hit[k.grubbs(x, alpha)] = True
    return {"hit": hit}


@flagging()
def flagByGrubbs(s: Series, window: str | int = "1D", alpha: float = 0.05, min_periods: int = 8, pedantic: bool = False) -> Series:
    """Grubbs test in blocks of time or rows; pedantic: also in blocks shifted by half, flagged by both."""
    kernel = partial(_grubbs, alpha=alpha, least=min_periods)
    out = apply(s, kernel, {"hit": "boolean"}, blocks_of(s, window))
    if not pedantic:
        return out
    if isinstance(window, int):
        half = F.floor((F.row_number().over(s.order) - 1 + window // 2) / window)
    else:
        w = micros(window)
        half = F.floor((F.col("t") - F.floor(F.min("t").over(s.whole) / 86_400_000_000) * 86_400_000_000 + w // 2) / w)
    first = Series(out.df.withColumnRenamed("hit", "one"), s.keys)
    two = apply(first, kernel, {"hit": "boolean"}, half)
    return two.with_(hit=F.col("hit") & F.col("one"))


@flagging()
def flagByStray(s: Series, window: str | int | None = None, min_periods: int = 11, iter_start: float = 0.5, alpha: float = 0.05, freq: str | int | None = None) -> Series:
    """Values beyond a gap that is too wide for the gaps below it; one rank window for each block, no Python."""
    s = s.with_(block=blocks_of(s, window if window is not None else freq))
    from pyspark.sql import Window

    v = F.col("value").isNotNull()
    s = s.with_(valid=F.when(v, 1).otherwise(0))
    part = Window.partitionBy(*s.by("block", "valid"))
    rank = part.orderBy("value", "t")
    s = s.with_(n=F.sum("valid").over(part), i=F.row_number().over(rank) - 1, gap=F.coalesce(F.col("value") - F.lag("value").over(rank), F.lit(0.0)))
    size = F.greatest(F.least(F.floor(F.col("n") / 4), F.lit(50)), F.lit(2)).cast("int")
    s = s.with_(size=size, back=F.reverse(F.collect_list("gap").over(rank.rowsBetween(-49, -1))))
    # gaps just below, nearest first, weighted by their order
    expected = F.aggregate(F.transform(F.slice("back", F.lit(1), F.col("size") - 1), lambda g, p: g * (p + 2) / (F.col("size") - 1)), F.lit(0.0), lambda a, b: a + b)
    far = (F.col("valid") == 1) & (F.col("n") >= min_periods) & (F.col("i") >= F.greatest(F.floor(F.col("n") * iter_start), F.lit(1))) & (F.col("gap") > -math.log(alpha) * expected)
    s = s.with_(far=F.when(far, 1).otherwise(0))
    return s.with_(hit=F.max("far").over(rank.rowsBetween(Window.unboundedPreceding, 0)) == 1)


# ---- scores of nearest neighbours


def _joint(call: Call, fields: list[str]) -> Series:
    on = [*call.qc.keys, "t"]
    parts = [call.masked(f).df.select(*on, F.col("value").alias(f"v{i}")) for i, f in enumerate(fields)]
    return Series(reduce(lambda a, b: match(a, b, on, "full_outer"), parts), call.qc.keys)


def _score(pdf: pd.DataFrame, cols: list[str], kind: str, n: int, p: float, least: int, agg: str | Callable) -> dict:
    pts = pdf[cols].to_numpy(float)
    good = ~np.isnan(pts).any(axis=1)
    out = np.full(len(pts), np.nan)
    if good.sum() >= max(2, least):
        own = pts[good]
        if kind == "lof":
            out[good] = k.lof(own, n, p)
        else:
            d, _ = k.neighbours(own, n, p)
            out[good] = agg(d, axis=1) if callable(agg) else {"sum": d.sum, "mean": d.mean, "max": d.max, "min": d.min}.get(agg, lambda axis: np.median(d, axis=axis))(axis=1)
    return {"score": out}


def _scored(call: Call, fields: list[str], kind: str, n: int, freq, least: int, p: float, agg="sum") -> Series:
    s = _joint(call, fields)
    cols = [f"v{i}" for i in range(len(fields))]
    return apply(s, partial(_score, cols=cols, kind=kind, n=n, p=p, least=least, agg=agg), {"score": "double"}, blocks_of(s, freq), cols)


def _put(call: Call, s: Series, target: str) -> QC:
    df = s.df.select(*s.keys, "t", F.nanvl("score", F.lit(None).cast("double")).alias("value"), F.lit(None).cast("double").alias("flag"), F.array(F.lit(None).cast("double")).alias("hist"))
    return call.qc._new({**call.qc.fields, target: Field(df, (call.meta(),))})


@register(multivariate=True, handles_target=True)
def assignKNNScore(call: Call, fields: list[str], targets: list[str], n: int = 10, func: str | Callable = "sum", freq: str | int | None = None, min_periods: int = 2, algorithm: str = "auto", metric: str = "minkowski", p: float = 2) -> QC:
    """The joint vector's distances to its n nearest neighbours in each block, aggregated."""
    return _put(call, _scored(call, fields, "knn", n, freq, min_periods, p, func), targets[0])


@register(multivariate=True, handles_target=True)
def assignLOF(call: Call, fields: list[str], targets: list[str], n: int = 20, freq: str | int | None = None, min_periods: int = 2, algorithm: str = "auto", p: float = 2) -> QC:
    """The joint vector's (negative) local outlier factor in each block."""
    return _put(call, _scored(call, fields, "lof", n, freq, min_periods, p), targets[0])


@register(mask=True, demask=True, multivariate=True)
def flagLOF(call: Call, fields: list[str], targets: list[str], n: int = 20, thresh: float | str = 1.5, algorithm: str = "auto", p: float = 1) -> QC:
    """Times whose joint vector has a local outlier factor above ``thresh`` (auto: three deviations of the mirrored scores)."""
    s = _scored(call, targets, "lof", n, None, 2, p)
    if thresh == "auto":
        # scores mirrored at -1 have mean -1
        dev = F.sqrt(F.avg((F.col("score") + 1) * (F.col("score") + 1)).over(s.whole))
        hit = (F.col("score") + 1) < -3 * dev
    else:
        hit = F.col("score") < -abs(float(thresh))
    hits = s.df.select(*s.keys, "t", F.coalesce(hit, F.lit(False)).alias("hit"))
    qc = call.qc
    for t in targets:
        df = match(qc.fields[t].df, hits, [*s.keys, "t"], "left")
        qc = Call(**{**call.__dict__, "qc": qc}).write(t, Series(df, s.keys))
    return qc


def _uni(pdf: pd.DataFrame, n: int, p: float, density: str | float, fill: bool, extent: float) -> dict:
    x, t = pdf["value"].to_numpy(float), pdf["t"].to_numpy()
    out = np.full(len(x), np.nan)
    good = ~np.isnan(x)
    if good.sum() < 3:
        return {"score": out, "density": out}
    y = k.interpolate(t, x, "linear") if fill else x
    own = np.flatnonzero(~np.isnan(y))
    y = y[own]
    if density == "auto":
        step = np.abs(np.diff(y**p if p != 1 else y))
        d = float(np.median(step)) or (float(np.median(step[step > 0])) if (step > 0).any() else 1.0)
    else:
        d = float(density)
    m = min(n, len(y) - 1)
    ext = np.concatenate([y[m:0:-1], y, y[-2 : -m - 2 : -1]])
    pts = np.stack([ext, np.arange(len(ext)) * d], axis=1)
    score = (k.lof if extent == 1 else lambda a, b, c: k.loop(a, b, c, extent))(pts, m, p)
    out[own] = score[m : m + len(y)]
    out[~good] = np.nan
    return {"score": out, "density": np.full(len(x), d)}


@register()
def assignUniLOF(s: Series, n: int = 20, algorithm: str = "auto", p: float = 1, density: str | float = "auto", fill_na: bool = True, statistical_extent: float = 1) -> Series:
    """Local outlier factor (or probability) of value and time, the time axis scaled to the values' usual step."""
    s = apply(s, partial(_uni, n=n, p=p, density=density, fill=fill_na, extent=statistical_extent), {"score": "double", "density": "double"})
    return s.with_(out=F.nanvl("score", F.lit(None).cast("double")))


def _corruption_cutoff(score: np.ndarray, count: float) -> float:
    """The score at which outliers begin, from the expected number (or share) of corrupted values.

    The distinct scores of the most outlying values are split in two (1-D k-means, exact). The
    split counts if it is clear (mean silhouette above 0.6); outliers then begin with the least
    outlying member of the upper part that is itself at least that clear, but of more than ten no
    further than three deviations below the part's centre. Without a clear split only scores of 1 count.
    """
    known = -score[~np.isnan(score)]
    most = max(4, int(abs(count * len(score)) if isinstance(count, float) and count < 1 else abs(count)))
    v = np.unique(np.sort(known)[::-1][:most])
    if len(v) < 3:
        return -1.0
    cost = [((v[:i] - v[:i].mean()) ** 2).sum() + ((v[i:] - v[i:].mean()) ** 2).sum() for i in range(1, len(v))]
    cut = int(np.argmin(cost)) + 1
    low, top = v[:cut], v[cut:]

    def silhouettes(own: np.ndarray, other: np.ndarray) -> np.ndarray:
        if len(own) == 1:
            return np.ones(1)
        inner = np.abs(own[:, None] - own[None, :]).sum(axis=1) / (len(own) - 1)
        outer = np.abs(own[:, None] - other[None, :]).mean(axis=1)
        return (outer - inner) / np.maximum(np.maximum(outer, inner), 1e-300)

    upper = silhouettes(top, low)
    mean = float(np.concatenate([upper, silhouettes(low, top)]).mean())
    clear = top[upper >= mean]
    if mean <= 0.6 or not len(clear):
        return -1.0
    begin = float(clear.min())
    if len(clear) > 10:
        begin = max(begin, float(top.mean()) - 3 * float(clear.std()))
    return -begin


def _unilof(pdf: pd.DataFrame, n: int, p: float, density, fill: bool, thresh, probability, corruption, slope: bool, min_offset) -> dict:
    x = pdf["value"].to_numpy(float)
    got = _uni(pdf, n, p, density, fill, 1 if thresh is not None else 0.997)
    s = got["score"]
    with np.errstate(invalid="ignore"):
        if thresh == "auto":
            dev = math.sqrt(np.nanmean((s + 1) ** 2)) if (~np.isnan(s)).any() else math.inf
            hit = (s + 1) / dev < -3 if dev else np.zeros(len(s), bool)
        elif thresh is not None:
            hit = s < -abs(thresh)
        elif probability is not None:
            hit = s <= -abs(probability)
        else:
            count = corruption if corruption is not None else len(x) // max(n, 4)
            hit = s <= _corruption_cutoff(s, count)
    if slope and hit.any():
        own = np.flatnonzero(~np.isnan(x))
        y, h = x[own], hit[own]
        edges = np.flatnonzero(np.diff(h.astype(int))) + 1
        cuts = np.concatenate([[0], edges, [len(h)]])
        eps = min_offset if min_offset is not None else 3 * (np.median(np.abs(np.diff(y))) if density == "auto" else float(density))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if h[a] and a > 0 and b < len(h):
                lo, hi = sorted((y[a - 1], y[b]))
                seq = y[a - 1 : b + 1]
                step = np.diff(seq) * (1 if y[b] >= y[a - 1] else -1)
                if (y[a:b] >= lo - eps).all() and (y[a:b] <= hi + eps).all() and (step >= -eps).all() and hi - lo > eps:
                    h[a:b] = False
        hit = np.zeros(len(x), bool)
        hit[own] = h
    return {"hit": hit & ~np.isnan(x)}


@flagging()
def flagUniLOF(s: Series, n: int = 20, thresh: float | str | None = None, probability: float | None = None, corruption: float | int | None = None, algorithm: str = "auto", p: float = 1, density: str | float = "auto", fill_na: bool = True, slope_correct: bool = True, min_offset: float | None = None) -> Series:
    """Outliers of value in time by local density, cut at a factor, a probability or an expected number; steep courses between two levels are let through."""
    if sum(a is not None for a in (thresh, probability, corruption)) > 1:
        raise ValueError("one cutoff at most")
    kernel = partial(_unilof, n=n, p=p, density=density, fill=fill_na, thresh=thresh, probability=probability, corruption=corruption, slope=slope_correct, min_offset=min_offset)
    return apply(s, kernel, {"hit": "boolean"})


def _blamed(df: DataFrame, hits: DataFrame, keys: tuple[str, ...], reach: int, drop: bool, thresh: float, least: int) -> DataFrame:
    """Of a field's rows the hits whose value leaves the course of the time around: keys, t, blame.

    The course is a polynomial of second degree through the values at most ``reach`` away (of
    degree 0 where the hit lies near an end of them); a value is to blame if it is further from it
    than ``thresh`` robust deviations, or if there are fewer than ``least`` values. Only the
    surroundings of hits are gathered, by buckets of time.
    """
    near = hits.select(*keys, F.col("t").alias("at"), F.explode(F.sequence(F.floor((F.col("t") - reach) / reach), F.floor((F.col("t") + reach) / reach))).alias("bucket"))
    marked = match(df, hits.select(*keys, "t", F.lit(True).alias("marked")), [*keys, "t"], "left").withColumn("bucket", F.floor(F.col("t") / reach)).filter("value is not null")
    around = match(marked, near, [*keys, "bucket"]).filter(F.abs(F.col("t") - F.col("at")) <= reach)
    groups = around.groupBy(*keys, "at").agg(F.collect_list(F.struct("t", "value", F.coalesce("marked", F.lit(False)).alias("marked"))).alias("rows"))

    @F.pandas_udf("boolean")
    def blame(at: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for a, own in zip(at, rows, strict=True):
            own = sorted((r["t"], r["value"], r["marked"]) for r in own)
            t, v = np.array([r[0] for r in own], float), np.array([r[1] for r in own], float)
            now = v[t == a]
            degree = 0 if a - t[0] < reach / 4 or t[-1] - a < reach / 4 else 2
            if drop:
                keep = ~np.array([r[2] for r in own])
                t, v = t[keep], v[keep]
            if len(v) < max(least, 1) or not len(now):
                out.append(True)
                continue
            z = (t - a) / reach
            fit = np.polynomial.polynomial.polyfit(z, v, min(degree, len(v) - 1))
            rest = v - np.polynomial.polynomial.polyval(z, fit)
            middle = np.median(rest)
            with np.errstate(divide="ignore", invalid="ignore"):
                out.append(bool(0.6745 * abs(middle - (now[0] - fit[0])) / np.median(np.abs(rest - middle)) > thresh))
        return pd.Series(out)

    return groups.select(*keys, F.col("at").alias("t"), blame("at", "rows").alias("blame"))


@register(mask=True, demask=True, multivariate=True)
def flagMVScores(
    call: Call, fields: list[str], targets: list[str], trafo: str | Callable = "zScore", alpha: float = 0.05, n: int = 10, func: str = "sum", iter_start: float = 0.5, window: str | int | None = None, min_periods: int = 11,
    stray_range: str | None = None, drop_flagged: bool = False, thresh: float = 3.5, min_periods_r: int = 1,
) -> QC:
    """Joint outliers: transform each field, score by nearest neighbours, take the scores' upper tail (all of it in periods of ``window``).

    Without ``stray_range`` all fields are flagged at such a time; with it, those whose value
    leaves its course in the time around (see ``_blamed``), or all if none does.
    """
    qc = call.qc
    work = qc
    for f in targets:
        work = work.call("transform", f, trafo, target=f"__{f}", freq=window)
    work = work.call("assignKNNScore", [f"__{f}" for f in targets], target="__score", n=n, func=func, freq=window, min_periods=min_periods)
    work = work.call("flagByStray", "__score", freq=window, min_periods=min_periods, iter_start=iter_start, alpha=alpha, flag=call.flag)
    hits = work.fields["__score"].df.select(*qc.keys, "t", (F.coalesce("flag", F.lit(UNFLAGGED)) > UNFLAGGED).alias("hit")).filter("hit")
    if stray_range is not None:
        hits = hits.drop("hit").distinct()
        reach = micros(stray_range)
        for i, f in enumerate(targets):
            own = _blamed(qc.fields[f].df.select(*qc.keys, "t", "value"), hits.select(*qc.keys, "t"), qc.keys, reach, drop_flagged, thresh, min_periods_r)
            hits = match(hits, own.withColumnRenamed("blame", f"b{i}"), [*qc.keys, "t"], "left")
        every = [F.coalesce(F.col(f"b{i}"), F.lit(False)) for i in range(len(targets))]
        nobody = ~reduce(Column.__or__, every)
        hits = hits.select(*qc.keys, "t", *((c | nobody).alias(f"b{i}") for i, c in enumerate(every)))
    for i, t in enumerate(targets):
        own = hits.select(*qc.keys, "t", F.col("hit" if stray_range is None else f"b{i}").alias("hit"))
        qc = Call(**{**call.__dict__, "qc": qc}).write(t, Series(match(qc.fields[t].df, own, [*qc.keys, "t"], "left"), qc.keys))
    return qc
