"""Other time grids: resampling, alignment, and the way back."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import QC, Call, Field, Series
from ..plans.cells import match
from ..registry import register
from ..timespan import micros
from .windowed import with_null_run

_DAY, _HOUR = 86_400_000_000, 3_600_000_000
#: How each method is undone (fixed values, but that forward and backward aggregation undo each other).
INVERSE = {"fagg": "bagg", "bagg": "fagg", "nagg": "nagg", "fshift": "bshift", "bshift": "fshift", "nshift": "nshift", "mshift": "sshift", "sshift": "mshift", "froll": "broll", "broll": "froll", "nroll": "nroll", "match": "match"}


def aggregate(func: str | Callable | float, c: Column) -> Column:
    """A statistic by name, a function of a pandas Series, or a constant."""
    if isinstance(func, (int, float)) and not isinstance(func, bool):
        return F.lit(float(func)).cast("double")
    if callable(func):
        def own(v: pd.Series) -> float:
            return float(func(v.dropna()))

        own.__annotations__ = {"v": pd.Series, "return": float}
        return F.pandas_udf(own, "double")(c)
    n = F.count(c)
    return {
        "sum": lambda: F.sum(c), "mean": lambda: F.avg(c), "median": lambda: F.percentile(c, F.lit(0.5)), "min": lambda: F.min(c), "max": lambda: F.max(c), "count": lambda: n.cast("double"),
        "first": lambda: F.min_by(c, F.when(c.isNotNull(), F.col("t"))), "last": lambda: F.max_by(c, F.when(c.isNotNull(), F.col("t"))),
        "std": lambda: F.when(n >= 2, F.stddev_samp(c)), "var": lambda: F.when(n >= 2, F.var_samp(c)), "sem": lambda: F.when(n >= 2, F.stddev_samp(c) / F.sqrt(n)),
        "linear": lambda: F.avg(c), "time": lambda: F.avg(c),
    }[func]()


def _hist(n: int, func: str | Callable = "max") -> Column:
    """Every test's flags, aggregated on their own."""
    return F.array(*(aggregate(func, F.get(F.col("hist"), F.lit(i))) for i in range(n))).alias("hist") if n else F.array().cast("array<double>").alias("hist")


def _grid(df: DataFrame, keys: tuple[str, ...], f: int) -> DataFrame:
    ends = df.groupBy(*(keys or [F.lit(0).alias("__one")])).agg(F.min("t").alias("a"), F.max("t").alias("b")).filter("a is not null")
    steps = F.sequence(F.floor(F.col("a") / f), F.ceil(F.col("b") / f))
    return ends.select(*keys, F.explode(steps).alias("step")).select(*keys, (F.col("step") * f).alias("t"))


def _nearest(df: DataFrame, index: DataFrame, keys: tuple[str, ...], way: str, tol: int | None) -> DataFrame:
    """For each row of df the stamp ``g`` of the index that is next (f), previous (b), nearest (n) or equal (m)."""
    on = [*keys, "t"]
    if way == "m":
        return match(df, index.select(*on, F.col("t").alias("g")).distinct(), on, "left")
    u = df.select(*on, F.lit(None).cast("long").alias("x")).distinct().union(index.select(*on, F.col("t").alias("x")))
    w = Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(0)]))
    past = F.last("x", True).over(w.orderBy("t").rangeBetween(Window.unboundedPreceding, 0))
    next_ = F.last("x", True).over(w.orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, 0))
    near = F.when(past.isNull(), next_).when(next_.isNull(), past).when(F.col("t") - past < next_ - F.col("t"), past).otherwise(next_)
    g = {"f": next_, "b": past, "n": near}[way]
    if tol is not None:
        g = F.when(F.abs(g - F.col("t")) <= tol, g)
    labels = u.withColumn("g", g).filter("x is null").select(*on, "g")
    return match(df, labels, on, "left")


def _label(df: DataFrame, index: DataFrame, keys: tuple[str, ...], way: str, tol: int | None, freq: int | None) -> DataFrame:
    if freq is None or way == "m":
        return _nearest(df, index, keys, way, tol)
    t = F.col("t")
    g = {"f": F.ceil(t / freq) * freq, "b": F.floor(t / freq) * freq, "n": F.floor((t + freq // 2) / freq) * freq}[way]
    return df.withColumn("g", g if tol is None else F.when(F.abs(g - t) <= tol, g))


def regrid(
    field: Field, keys: tuple[str, ...], index: DataFrame, freq: int | None, method: str, tol: int | None, data: str | Callable | float | None, flags: str | Callable | float | None, broadcast: bool,
) -> DataFrame:
    """The field on the stamps of ``index``: keys, t, value, flag, hist."""
    on, n = [*keys, "t"], len(field.meta)
    src = field.df
    way, kind = method[0], method[1:]
    flags = "max" if flags is None else flags
    index = index.select(*on).distinct()
    if method == "match":
        return match(index, src.select(*on, "value", "flag", "hist"), on, "left")
    if kind == "roll":
        if tol is None:
            raise ValueError("rolling methods need a tolerance")
        both = src.select(*on, "value", "flag", "hist", F.lit(0).alias("new")).union(index.select(*on, F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("array<double>"), F.lit(1)))
        s = Series(both, keys)
        w = {"f": s.span(-(tol - 1), 0), "b": s.span(0, tol - 1), "n": s.span(-(tol // 2), tol // 2)}[way]
        from ..functions.rolling import over

        d = F.lit(None).cast("double") if data is None else F.lit(float(data)) if isinstance(data, (int, float)) else over(data, F.col("value"), w)
        h = F.array(*(F.max(F.get("hist", F.lit(i))).over(w) for i in range(n))) if n else F.array().cast("array<double>")
        return s.df.withColumns({"d": d, "fl": F.max("flag").over(w), "h": h}).filter("new = 1").select(*on, F.col("d").alias("value"), F.col("fl").alias("flag"), F.col("h").alias("hist"))
    if method in ("mshift", "sshift"):
        return _pillars(src, keys, index, n, tol, method)
    if kind == "shift":
        src = src.filter("value is not null")
        far = F.abs(F.col("t") - F.col("g"))
        lab = _label(src, index, keys, way, tol, freq).filter("g is not null")
        order = F.struct(far, -F.col("t") if way != "b" else F.col("t"))
        agg = lab.groupBy(*keys, "g").agg(F.min_by("value", order).alias("value"), F.min_by("flag", order).alias("flag"), F.min_by("hist", order).alias("hist"))
    elif kind == "agg":
        lab = _label(src, index, keys, way, tol, freq).filter("g is not null")
        agg = lab.groupBy(*keys, "g").agg((F.lit(None).cast("double") if data is None else aggregate(data, F.col("value"))).alias("value"), aggregate(flags, F.col("flag")).alias("flag"), _hist(n, flags))
    else:
        raise ValueError(f"unknown method {method!r}")
    agg = agg.withColumnRenamed("g", "t")
    if not broadcast or kind == "shift":
        return match(index, agg, on, "left")
    # every new stamp takes the aggregate of the group that its nearest source row belongs to
    own = _nearest(index, src.select(*on), keys, {"f": "b", "b": "f", "n": "n"}[way], tol).withColumnRenamed("g", "s")
    of = _label(src, index, keys, way, tol, freq).filter("g is not null").select(*keys, F.col("t").alias("s"), "g")
    return match(match(own, of, [*keys, "s"], "left"), agg.withColumnRenamed("t", "g"), [*keys, "g"], "left").select(*on, "value", "flag", "hist")


def _pillars(src: DataFrame, keys: tuple[str, ...], index: DataFrame, n: int, tol: int | None, method: str) -> DataFrame:
    """Interpolation in time between the values before and after; flags are the greater of both sides."""
    on = [*keys, "t"]
    one = src.select(*on, F.lit(0).alias("new"), F.struct("t", "value", "flag", "hist").alias("p"), F.when(F.col("value").isNotNull(), F.struct("t", "value")).alias("q"))
    both = one.union(index.select(*on, F.lit(1), F.lit(None).cast(one.schema["p"].dataType), F.lit(None).cast(one.schema["q"].dataType)))
    w = Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(0)]))
    down, up = w.orderBy("t").rangeBetween(Window.unboundedPreceding, 0), w.orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, 0)
    df = both.withColumns({"a": F.last("p", True).over(down), "b": F.last("p", True).over(up), "qa": F.last("q", True).over(down), "qb": F.last("q", True).over(up)}).filter("new = 1")
    near = F.col("a").isNotNull() & F.col("b").isNotNull()
    if tol is not None:
        near = near & (F.col("t") - F.col("a.t") <= tol) & (F.col("b.t") - F.col("t") <= tol)
    span = F.col("qb.t") - F.col("qa.t")
    line = F.when(span == 0, F.col("qa.value")).otherwise(F.col("qa.value") + (F.col("qb.value") - F.col("qa.value")) * F.try_divide(F.col("t") - F.col("qa.t"), span))
    hist = F.array(*(F.greatest(F.get("a.hist", F.lit(i)), F.get("b.hist", F.lit(i))) for i in range(n))) if n else F.array().cast("array<double>")
    return df.select(*on, F.when(near, line).alias("value"), F.when(near, F.greatest("a.flag", "b.flag")).alias("flag"), F.when(near, hist).alias("hist"))


def _apply(call: Call, field: str, index, method: str, tolerance, data, flags, broadcast: bool, squeeze: bool, override: bool, mask: bool = True) -> QC:
    qc = call.qc
    f = qc.fields[field]
    s = call.masked(field, mask)
    src = Field(s.df.select(*qc.keys, "t", "value", "flag", "hist"), f.meta)
    name = None
    if method == "invert":
        name, method, last = _inverse(f)
        index, tolerance = name if index is None else index, last if tolerance is None else tolerance
        broadcast = broadcast or method.endswith("agg")
    tol = micros(tolerance) if isinstance(tolerance, str) else tolerance
    freq = None
    if isinstance(index, DataFrame):
        at = index.select(*qc.keys, "t")
    elif index in qc.fields:
        at = qc.fields[index].df.select(*qc.keys, "t")
    else:
        freq = micros(index)
        at = _grid(src.df, qc.keys, freq)
    df = regrid(src, qc.keys, at, freq, method, tol, data, flags, broadcast)
    none = F.transform(F.sequence(F.lit(1), F.lit(max(1, len(f.meta)))), lambda _: F.lit(None).cast("double")) if f.meta else F.array().cast("array<double>")
    hist = F.coalesce("hist", none)
    meta = f.meta
    if squeeze:
        hist, meta = F.array(F.col("flag")), (call.meta(),)
    if override:
        hist, meta, df = F.array().cast("array<double>"), (), df.withColumn("flag", F.lit(None).cast("double"))
    df = df.select(*qc.keys, "t", "value", "flag", F.concat(hist, F.array(F.lit(None).cast("double"))).alias("hist"))
    note = {"reindex": {"index": index if isinstance(index, str) else None, "method": method, "tolerance": tol, "source": field}}
    return qc._new({**qc.fields, field: Field(df, (*meta, call.meta(**note)))})


def _inverse(f: Field) -> tuple[str, str, int | None]:
    depth = 0
    for m in reversed(f.meta):
        if "reindex" in m:
            if m["reindex"].get("inverted"):
                depth += 1
            elif depth:
                depth -= 1
            else:
                return m["reindex"]["source"], INVERSE[m["reindex"]["method"]], m["reindex"]["tolerance"]
    raise ValueError("nothing to invert")


@register(handles_target=True)
def reindex(call: Call, field: str, target: str, index=None, method: str = "match", tolerance=None, data_aggregation=None, flags_aggregation=None, broadcast: bool = True, squeeze: bool = False, override: bool = False) -> QC:
    """Put a field on another index: a frequency (floor of the first to ceil of the last stamp), another field's stamps, or a table of keys and t."""
    qc = call.qc if field == target else call.copy([field], [target])
    return _apply(Call(**{**call.__dict__, "qc": qc}), target, index, method, tolerance, data_aggregation, flags_aggregation, broadcast, squeeze, override)


@register(handles_target=True)
def resample(call: Call, field: str, target: str, freq: str = "1D", func: str | Callable = "mean", method: str = "bagg", maxna: int | None = None, maxna_group: int | None = None, squeeze: bool = False) -> QC:
    """Aggregate to a regular grid; a cell with too many missing values, or too long a run of them, gets none. ``func`` may also be climatologicalMean or trueDailyMean (days only)."""
    qc = call.qc if field == target else call.copy([field], [target])
    here = Call(**{**call.__dict__, "qc": qc})
    daily = func in _DAILY or getattr(func, "__name__", "") in _DAILY
    if daily and micros(freq) != _DAY:
        raise ValueError("the daily means of the meteorological services need a freq of one day")
    out = _apply(here, target, freq, method, None, "mean" if daily else func, "max", False, squeeze, False)
    if daily:
        mean = _DAILY[func if isinstance(func, str) else func.__name__](here.masked(target).df, qc.keys).select(*qc.keys, (F.col("day") * _DAY).alias("t"), F.col("value").alias("mean"))
        f = out.fields[target]
        out = out._new({**out.fields, target: Field(match(f.df, mean, [*qc.keys, "t"], "left").withColumn("value", F.col("mean")).drop("mean"), f.meta)})
    if maxna is None and maxna_group is None:
        return out
    f, keys = micros(freq), qc.keys
    lab = _label(here.masked(target).df, None, keys, method[0], None, f)  # type: ignore[arg-type]
    s = with_null_run(Series(lab.filter("g is not null"), (*keys, "g")), F.col("value"))
    bad = s.df.groupBy(*keys, "g").agg(F.sum(F.when(F.col("value").isNull(), 1).otherwise(0)).alias("na"), F.max("run").alias("run"))
    limit = F.lit(False)
    for c, x in (("na", maxna), ("run", maxna_group)):
        limit = limit if x is None else limit | (F.col(c) > x)
    bad = bad.filter(limit).select(*keys, F.col("g").alias("t"), F.lit(True).alias("bad"))
    df = match(out.fields[target].df, bad, [*keys, "t"], "left").withColumn("value", F.when(F.col("bad").isNull(), F.col("value"))).drop("bad")
    return out._new({**out.fields, target: Field(df, out.fields[target].meta)})


@register(handles_target=True)
def align(call: Call, field: str, target: str, freq: str = "1D", method: str = "time", order: int = 2, overwrite: bool = False) -> QC:
    """Shift or interpolate to a regular grid: time or linear, pad, fshift, bshift, nshift."""
    how = {"time": "mshift", "linear": "mshift", "pad": "fshift"}.get(method, method)
    qc = call.qc if field == target else call.copy([field], [target])
    return _apply(Call(**{**call.__dict__, "qc": qc}), target, freq, how, micros(freq), None, None, False, False, overwrite)


@register(mask=False, handles_target=True)
def concatFlags(call: Call, field: str, target: str | None, method: str = "auto", invert: bool = True, freq: str | None = None, drop: bool = False, squeeze: bool = False, override: bool = False) -> QC:
    """Project the flags of a re-gridded field onto the stamps of ``target`` and append them to its history."""
    from .basic import transferFlags

    qc, f = call.qc, call.qc.fields[field]
    tol = micros(freq) if freq else None
    if method == "auto":
        last = next((m["reindex"] for m in reversed(f.meta) if "reindex" in m), None)
        if last is None:
            method, tol = "match", None
        else:
            method, tol = INVERSE[last["method"]], tol if tol is not None else last["tolerance"] if last["tolerance"] is not None else micros(last["index"]) if last["index"] and last["index"] not in qc.fields else None
    elif invert:
        method = INVERSE[method]
    at = qc.fields[target].df.select(*qc.keys, "t")
    src = Field(f.df.withColumn("value", F.coalesce("value", F.lit(0.0))), f.meta)
    moved = regrid(src, qc.keys, at, None, method, tol, "mean", "max", True).withColumn("value", F.lit(None).cast("double"))
    none = F.transform(F.sequence(F.lit(1), F.lit(max(1, len(f.meta)))), lambda _: F.lit(None).cast("double"))
    tmp = "__moved"
    both = qc._new({**qc.fields, tmp: Field(moved.withColumn("hist", F.coalesce("hist", none)), f.meta)})
    out = transferFlags(Call(**{**call.__dict__, "qc": both}), [tmp], [target], squeeze=squeeze, overwrite=override)
    return out.without(tmp, *([field] if drop else []))


# ---- means of the meteorological services


def climatologicalMean(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A third of the readings at 06:30, 12:30 and, doubled, 20:30 of each day; null if one of them is missing: keys, day, value. Days without a row at any of these times are left out."""
    minute = F.col("t") % _DAY / 60_000_000
    weight = F.when(minute.isin(390, 750), 1).when(minute == 1230, 2)
    own = df.withColumn("w", weight).filter("w is not null").withColumn("day", F.floor(F.col("t") / _DAY))
    return own.groupBy(*keys, "day").agg(F.when(F.count("value") >= 3, F.sum(F.col("value") * F.col("w")) / F.count("value")).alias("value"))


def trueDailyMean(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the readings ten minutes before each full hour, which belong to the day of that hour; null on a day that lacks more than two hours in a row: keys, day, value. Days without a row at these times are left out."""
    at = F.col("t") + 600_000_000
    own = df.withColumn("at", at).filter(F.col("at") % _HOUR == 0).withColumn("day", F.floor(F.col("at") / _DAY))
    hours = F.array_sort(F.collect_set(F.when(F.col("value").isNotNull(), F.floor(F.col("at") % _DAY / _HOUR))))  # at most 24
    out = own.groupBy(*keys, "day").agg(F.avg("value").alias("mean"), hours.alias("hours"))
    gaps = F.zip_with(F.concat("hours", F.array(F.lit(24).cast("long"))), F.concat(F.array(F.lit(-1).cast("long")), "hours"), lambda a, b: a - b - 1)
    return out.select(*keys, "day", F.when(F.array_max(gaps) <= 2, F.col("mean")).alias("value"))


_DAILY = {"climatologicalMean": climatologicalMean, "trueDailyMean": trueDailyMean}


def equidistant(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The step of each series in microseconds if it is exactly regular, else null: keys, step."""
    d = F.col("t") - F.lag("t").over(Series(df, keys).order)
    return df.withColumn("d", d).groupBy(*(keys or [F.lit(0).alias("all")])).agg(F.when(F.min("d") == F.max("d"), F.min("d")).alias("step"))
