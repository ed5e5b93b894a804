"""Drift and regimes: series that leave the course of their neighbours or of their own past."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..frame import QC, Call, Series
from ..kernels import numeric as k
from ..plans.cells import match
from ..registry import flagging, register
from ..timespan import micros
from .changepoints import clusters, marked
from .vector import apply, blocks_of


def _wide(call: Call, fields: Sequence[str], window: str, how: str = "inner") -> Series:
    on = [*call.qc.keys, "t"]
    parts = [call.masked(f).df.select(*on, F.col("value").alias(f"v{i}")) for i, f in enumerate(fields)]
    s = Series(reduce(lambda a, b: match(a, b, on, how), parts), call.qc.keys)
    s = Series(s.df.dropna(subset=[f"v{i}" for i in range(len(fields))]), s.keys)
    return s.with_(segment=blocks_of(s, window))


def _distance(metric: str, a: Column, b: Column) -> Column:
    """The mean distance of two fields in a group of rows."""
    return {"cityblock": lambda: F.avg(F.abs(a - b)), "euclidean": lambda: F.sqrt(F.avg((a - b) * (a - b)))}[metric]()


def deviants(d: np.ndarray, sizes: np.ndarray, spread: float, frac: float, method: str) -> np.ndarray:
    """Members outside the one cluster that holds more than ``frac`` of all; none if there is no such cluster."""
    of = k.linkage_clusters(d, spread, method)
    weight = np.bincount(of, weights=sizes)
    major = np.flatnonzero(weight > frac * sizes.sum())
    return of != major[0] if len(major) and len(weight) > 1 else np.zeros(len(of), bool)


@register(mask=True, demask=True, multivariate=True)
def flagDriftFromNorm(call: Call, fields: list[str], targets: list[str], window: str = "1D", spread: float = 0.0, frac: float = 0.5, metric: str | Callable = "cityblock", method: str = "single") -> QC:
    """In each period, fields outside the cluster of most fields: pairwise mean distances in SQL, the small matrix clustered for each period."""
    s = _wide(call, targets, window)
    n = len(targets)
    pairs = [(i, j) for i in range(n) for j in range(i)]
    if callable(metric):
        cols = F.array(*(F.col(f"v{i}") for i in range(n)))

        @F.pandas_udf("array<double>")
        def own(rows: pd.Series) -> pd.Series:
            m = [np.stack([np.asarray(r, float) for r in x]) for x in rows]
            return pd.Series([[float(metric(x[:, i], x[:, j])) for i, j in pairs] or [0.0] for x in m])

        g = s.df.groupBy(*s.keys, "segment").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("t", cols.alias("v")))).alias("rows")).filter("n > 1")
        g = g.select(*s.keys, "segment", "n", own(F.col("rows.v")).alias("d"))
    else:
        g = s.df.groupBy(*s.keys, "segment").agg(F.count("*").alias("n"), F.array(*(_distance(metric, F.col(f"v{i}"), F.col(f"v{j}")) for i, j in pairs) or [F.lit(0.0)]).alias("d")).filter("n > 1")

    @F.pandas_udf("array<boolean>")
    def out(d: pd.Series) -> pd.Series:
        res = []
        for row in d:
            m = np.zeros((n, n))
            for (i, j), x in zip(pairs, row, strict=False):
                m[i, j] = m[j, i] = x
            res.append(deviants(m, np.ones(n), spread, frac, method).tolist())
        return pd.Series(res)

    bad = g.select(*s.keys, "segment", out("d").alias("bad"))
    rows = match(s.df.select(*s.keys, "t", "segment"), bad, [*s.keys, "segment"])
    qc = call.qc
    for i, t in enumerate(targets):
        hit = rows.select(*s.keys, "t", F.get("bad", F.lit(i)).alias("hit"))
        qc = Call(**{**call.__dict__, "qc": qc}).write(t, Series(match(qc.fields[t].df, hit, [*s.keys, "t"], "left"), s.keys))
    return qc


@register(mask=True, demask=True, multivariate=True)
def flagDriftFromReference(call: Call, fields: list[str], targets: list[str], reference: str = "", freq: str = "1D", thresh: float = 0.0, metric: str = "cityblock") -> QC:
    """In each period, fields whose mean distance to the reference field exceeds ``thresh``."""
    qc = call.qc
    for t in targets:
        if t == reference:
            continue
        s = _wide(call, [t, reference], freq)
        bad = s.df.groupBy(*s.keys, "segment").agg((_distance(metric, F.col("v0"), F.col("v1")) > thresh).alias("hit"), F.count("*").alias("n")).filter("n > 1")
        hit = match(s.df.select(*s.keys, "t", "segment"), bad, [*s.keys, "segment"]).select(*s.keys, "t", "hit")
        qc = Call(**{**call.__dict__, "qc": qc}).write(t, Series(match(qc.fields[t].df, hit, [*s.keys, "t"], "left"), s.keys))
    return qc


# ---- drift between maintenance


def linear_drift(x: np.ndarray, origin: float, target: float) -> np.ndarray:
    return origin + x * target


def exponential_drift(x: np.ndarray, c: float, origin: float, target: float) -> np.ndarray:
    c = abs(c)
    d = np.exp(c) - 1
    return origin + (target - origin) * ((np.exp(c * x) - 1) / d if d else x)


def _drift(pdf: pd.DataFrame, model: str | Callable, cal: int) -> dict:
    x, t, seg = pdf["value"].to_numpy(float), pdf["t"].to_numpy(float), pdf["segment"].to_numpy(float)
    out, labels = x.copy(), np.unique(seg[~np.isnan(seg)])
    starts = {}
    for g in labels:
        own = np.flatnonzero((seg == g) & ~np.isnan(x))
        if len(own):
            starts[g] = x[own[:cal]].mean()
    for g in labels:
        own = np.flatnonzero((seg == g) & ~np.isnan(x))
        if len(own) < 2:
            continue
        z = (t[own] - t[own[0]]) / (t[own[-1]] - t[own[0]])
        origin, target, shift = x[own[:cal]].mean(), x[own[-cal:]].mean(), starts.get(g + 1, np.nan)
        if model == "linear":
            f = lambda to: linear_drift(z, origin, to)
        elif model == "exponential":
            c = k.fit_curve(lambda a, b: exponential_drift(a, b, origin, target), z, x[own], np.array([1.0]))
            if c is None:
                continue
            f = lambda to: exponential_drift(z, c[0], origin, to)
        else:
            f = lambda to: model(z, origin=origin, target=to)  # type: ignore[operator]
        out[own] = x[own] + f(shift) - f(target)
    return {"new": out}


@register(handles_target=True)
def correctDrift(call: Call, field: str, target: str, maintenance_field: str = "", model: str | Callable = "linear", cal_range: int = 5) -> QC:
    """Between a maintenance's end and the next one's start, bend the series so that it ends on the level at which the next stretch begins."""
    qc = call.qc if field == target else call.copy([field], [target])
    here = Call(**{**call.__dict__, "qc": qc})
    s = here.masked(target)
    m = qc.fields[maintenance_field].df.filter("value is not null").select(*qc.keys, F.col("t").alias("a"), F.col("value").cast("long").alias("b"))
    w = Window.partitionBy(*(qc.keys or [F.lit(0)])).orderBy("a")
    spans = m.select(*qc.keys, F.col("b").alias("s"), F.lead("a").over(w).alias("e"), F.row_number().over(w).cast("double").alias("segment")).filter("e is not null")
    # the segment of a row is that of the last span that began before it and has not ended
    u = s.df.select(*qc.keys, "t", F.lit(None).cast("struct<e:bigint,segment:double>").alias("g")).union(spans.select(*qc.keys, F.col("s").alias("t"), F.struct(F.col("e").cast("long").alias("e"), "segment")))
    last = F.last("g", True).over(Series(u, qc.keys).order.rangeBetween(Window.unboundedPreceding, 0))
    lab = u.withColumn("l", last).filter("g is null").select(*qc.keys, "t", F.when(F.col("l.e") >= F.col("t"), F.col("l.segment")).alias("segment"))
    s = Series(match(s.df, lab.distinct(), [*qc.keys, "t"], "left"), s.keys)
    s = apply(s, partial(_drift, model=model, cal=cal_range), {"new": "double"}, reads=["value", "segment"])
    return here.write(target, s.with_(out=F.nanvl("new", F.lit(None).cast("double"))))


# ---- regimes


def _with_cluster(call: Call, field: str, cluster_field: str) -> Series:
    s = call.masked(field)
    c = call.qc.fields[cluster_field].df.select(*s.keys, "t", F.col("value").alias("cluster"))
    return Series(match(s.df, c, [*s.keys, "t"], "left"), s.keys)


def _regimes(pdf: pd.DataFrame, spread: float, frac: float, method: str, metric: Callable | None = None) -> dict:
    x, c = pdf["value"].to_numpy(float), pdf["cluster"].to_numpy(float)
    labels = [g for g in np.unique(c[~np.isnan(c)]) if (~np.isnan(x[c == g])).any()]
    if len(labels) < 2:
        return {"odd": np.zeros(len(x), bool)}
    mean = np.array([np.nanmean(x[c == g]) for g in labels])
    size = np.array([(~np.isnan(x[c == g])).sum() for g in labels], float)
    d = np.abs(mean[:, None] - mean[None, :])
    if metric is not None:
        own = [x[(c == g) & ~np.isnan(x)] for g in labels]
        d = np.array([[float(metric(a, b)) for b in own] for a in own])
    bad = deviants(d, size, spread, frac, method)
    return {"odd": np.isin(c, np.array(labels)[bad])}


def _odd(s: Series, spread: float, frac: float, method: str, metric: Callable | None) -> Series:
    return apply(s, partial(_regimes, spread=spread, frac=frac, method=method, metric=metric), {"odd": "boolean"}, reads=["value", "cluster"])


@flagging(handles_target=True)
def flagRegimeAnomaly(call: Call, field: str, target: str, cluster_field: str = "", spread: float = 0.0, method: str = "single", metric: Callable | None = None, frac: float = 0.5) -> QC:
    """Regimes outside the normal cluster of regimes (by the distance of their means, or a metric of two arrays; weighted by their rows)."""
    qc = call.qc if field == target else call.copy([field], [target])
    here = Call(**{**call.__dict__, "qc": qc})
    s = _odd(_with_cluster(here, target, cluster_field), spread, frac, method, metric)
    return here.write(target, s.with_(hit=F.col("odd")))


@register(mask=True, handles_target=True)
def assignRegimeAnomaly(call: Call, field: str, target: str, cluster_field: str = "", spread: float = 0.0, method: str = "single", metric: Callable | None = None, frac: float = 0.5) -> QC:
    """Negates the labels of regimes outside the normal cluster, in the cluster field."""
    s = _odd(_with_cluster(call, field, cluster_field), spread, frac, method, metric)
    odd = s.df.select(*s.keys, "t", "odd")
    df = match(call.qc.fields[cluster_field].df, odd, [*s.keys, "t"], "left").withColumns({"masked": F.lit(False), "out": F.when(F.col("odd"), -F.col("value")).otherwise(F.col("value"))})
    return call.write(cluster_field, Series(df, s.keys))


def _anomaly(pdf: pd.DataFrame, model: Callable, tol: int, epoch: bool) -> dict:
    x, c, t = pdf["value"].to_numpy(float), pdf["cluster"].to_numpy(float), pdf["t"].to_numpy(float) / 1e6
    out, fits = x.copy(), {}
    order = pd.unique(c[~np.isnan(c)])
    from inspect import signature

    n = len(signature(model).parameters) - 1
    for g in order:
        own = np.flatnonzero((c == g) & ~np.isnan(x))
        own = own[(t[own] >= t[own[0]] + tol / 1e6) & (t[own] <= t[own[-1]] - tol / 1e6)] if len(own) and tol else own
        if len(own) >= n:
            z = t[own] - (0 if epoch else t[own[0]])
            fits[g] = k.fit_curve(model, z, x[own], np.ones(n))
    normal = [g for g in order if g >= 0 and fits.get(g) is not None]
    for i, g in enumerate(order):
        if g >= 0 or fits.get(g) is None or not normal:
            continue
        before = [h for h in order[:i] if h in normal]
        ref = fits[before[-1] if before else normal[0]]
        own = np.flatnonzero(c == g)
        z = t[own] - (0 if epoch else t[own[0]])
        out[own] = x[own] + model(z, *ref) - model(z, *fits[g])
    return {"new": out}


def constant_model(x: np.ndarray, c: float) -> np.ndarray:
    return np.full(len(x), float(c))


@register(mask=True, handles_target=True)
def correctRegimeAnomaly(call: Call, field: str, target: str, cluster_field: str = "", model: Callable = constant_model, tolerance: str | None = None, epoch: bool = False) -> QC:
    """Shift the regimes with negative labels by the difference of their fit from that of the normal regime before them."""
    qc = call.qc if field == target else call.copy([field], [target])
    here = Call(**{**call.__dict__, "qc": qc})
    s = apply(_with_cluster(here, target, cluster_field), partial(_anomaly, model=model, tol=micros(tolerance) if tolerance else 0, epoch=epoch), {"new": "double"}, reads=["value", "cluster"])
    return here.write(target, s.with_(out=F.nanvl("new", F.lit(None).cast("double"))))


def _level(pdf: pd.DataFrame, spread: float, tol: int) -> dict:
    odd = _regimes(pdf, spread, 0.5, "single")["odd"]
    c = pdf["cluster"].to_numpy(float)
    return _anomaly(pdf.assign(cluster=np.where(odd, -c, c)), constant_model, tol, False)


@register()
def correctOffset(s: Series, max_jump: float = 0.0, spread: float = 0.0, window: str = "1D", min_periods: int = 1, tolerance: str | None = None) -> Series:
    """Bring stretches between jumps back to the level of the rest."""
    s = clusters(marked(s, "mean", max_jump, window, min_periods))
    s = apply(s, partial(_level, spread=spread, tol=micros(tolerance) if tolerance else 0), {"new": "double"}, reads=["value", "cluster"])
    return s.with_(out=F.nanvl("new", F.lit(None).cast("double")))
