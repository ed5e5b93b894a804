"""Row-wise tests, flag tools and flag algebra."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..flags import UNFLAGGED, is_flagged
from ..frame import QC, Call, Field, Series
from ..functions.expr import compile_expression, evaluate
from ..functions.periods import in_period
from ..plans.cells import match
from ..registry import flagging, processing, register
from ..timespan import micros


@flagging()
def flagRange(s: Series, min: float = float("-inf"), max: float = float("inf")) -> Series:
    """Values below min or above max."""
    return s.with_(hit=(F.col("value") < min) | (F.col("value") > max))


@register(mask=False)
def flagNaN(s: Series, dfilter: float = UNFLAGGED) -> Series:
    """Missing values that have no flag yet."""
    return s.with_(hit=F.col("value").isNull() & ~is_flagged(F.col("flag"), dfilter))


register(mask=False, name="flagMissing")(flagNaN)


@register(mask=False)
def flagUnflagged(s: Series) -> Series:
    return s.with_(hit=F.coalesce("flag", F.lit(UNFLAGGED)) == UNFLAGGED)


@register(mask=False)
def forceFlags(s: Series) -> Series:
    return s.with_(hit=F.lit(True))


@register(mask=False)
def clearFlags(s: Series) -> Series:
    """Back to unflagged; the history keeps what was there."""
    return s.with_(newflag=F.lit(UNFLAGGED))


@flagging()
def flagDummy(s: Series) -> Series:
    """Nothing, but an entry in the history."""
    return s


@processing(handles_target=True)
def copyField(call: Call, field: str, target: str, overwrite: bool = False) -> QC:
    if field == target:
        return call.qc
    if target in call.qc and not overwrite:
        raise ValueError(f"field {target!r} exists")
    return call.copy([field], [target])


@processing(handles_target=True)
def dropField(call: Call, field: str, target: str) -> QC:
    return call.qc.without(field)


@processing(handles_target=True)
def renameField(call: Call, field: str, target: str, new_name: str = "") -> QC:
    if not new_name or new_name in call.qc:
        raise ValueError("a new name is needed that isn't in use")
    return call.qc._new({(new_name if k == field else k): v for k, v in call.qc.fields.items()})


@register(mask=False, handles_target=True)
def selectTime(call: Call, field: str, target: str, mode: str = "periodic", selection_field: str | None = None, start: str | None = None, end: str | None = None, closed: bool = True) -> QC:
    """Remove values and flags inside a period of the calendar, or where another field is true."""
    qc = call.qc if field == target else call.copy([field], [target])
    s = Series(qc.fields[target].df, qc.keys)
    if mode == "periodic":
        inside = in_period(F.timestamp_micros("t"), start or "", end or "", closed)
        df = s.df.withColumn("in", inside)
    elif mode == "selection_field":
        chosen = qc.fields[selection_field].df.filter("value <> 0").select(*qc.keys, "t", F.lit(True).alias("in"))  # type: ignore[index]
        df = match(s.df, chosen, [*qc.keys, "t"], "left").withColumn("in", F.coalesce("in", F.lit(False)))
    else:
        raise ValueError("mode is periodic or selection_field")
    out = Series(df, qc.keys).with_(raw=F.col("value"), masked=F.lit(False), out=F.when(~F.col("in"), F.col("value")), newflag=F.when(F.col("in"), F.lit(UNFLAGGED)))
    return Call(**{**call.__dict__, "qc": qc}).write(target, out)


# ---- expressions


def _aligned(call: Call, fields: Sequence[str], mask: bool = True) -> DataFrame:
    """The fields side by side: ``v0, f0, h0, v1, ..``. All must have the same times: a time that one lacks is an error when the plan runs."""
    out = None
    for i, n in enumerate(fields):
        s = call.masked(n, mask)
        one = s.df.select(*call.qc.keys, "t", F.col("value").alias(f"v{i}"), F.col("flag").alias(f"f{i}"), F.col("hist").alias(f"h{i}"))
        here = one.withColumn(f"here{i}", F.lit(True))
        out = here if out is None else match(out, here, [*call.qc.keys, "t"], "full_outer")
    marks = [F.col(f"here{i}") for i in range(len(fields))]
    if len(marks) > 1:
        everywhere = reduce(Column.__and__, [F.coalesce(m, F.lit(False)) for m in marks])
        out = out.filter(F.when(everywhere, True).otherwise(F.raise_error(F.lit(f"ValueError: the fields {', '.join(fields)} have different times; align them first")).cast("boolean")))  # type: ignore[union-attr]
    return out.drop(*(f"here{i}" for i in range(len(fields))))  # type: ignore[union-attr]


def _expressions(call: Call, fields: Sequence[str], func: str | Callable, n: int) -> tuple[DataFrame, list[Column]]:
    df = _aligned(call, fields)
    s = Series(df, call.qc.keys)
    env = {name: (F.col(f"v{i}"), F.col(f"f{i}"), F.col(f"h{i}"), call.qc.fields[name].meta) for i, name in enumerate(fields)}
    if isinstance(func, str):
        out = [compile_expression(func, env, s, call.dfilter)]
    else:
        out = evaluate(func, [env[f] for f in fields], s, call.dfilter)
    if len(out) == 1:
        out = out * n
    if len(out) != n:
        raise ValueError(f"the expression gives {len(out)} results for {n} targets")
    return s.df, out


@register(multivariate=True, handles_target=True)
def flagGeneric(call: Call, fields: list[str], targets: list[str], func: str | Callable = "") -> QC:
    """Flag the targets where a logical expression of the fields holds and they have no flag yet."""
    df, results = _expressions(call, fields, func, len(targets))
    kinds = df.select(*[r.alias(f"r{i}") for i, r in enumerate(results)]).dtypes
    if any(k != "boolean" for _, k in kinds):
        raise TypeError("the expression must be logical")
    qc = call.qc
    hits = df.select(*qc.keys, "t", *(F.coalesce(r, F.lit(False)).alias(f"hit{i}") for i, r in enumerate(results)))
    for i, t in enumerate(targets):
        if t not in qc:
            qc = qc._new({**qc.fields, t: Field(qc.fields[fields[0]].df.withColumns({"value": F.lit(None).cast("double"), "flag": F.lit(None).cast("double"), "hist": F.array().cast("array<double>")}))})
        old = match(qc.fields[t].df, hits.select(*qc.keys, "t", F.col(f"hit{i}").alias("hit")), [*qc.keys, "t"], "left")
        old = old.withColumn("hit", F.col("hit") & ~is_flagged(F.col("flag"), call.dfilter))
        qc = Call(**{**call.__dict__, "qc": qc}).write(t, Series(old, qc.keys))
    return qc


@register(multivariate=True, handles_target=True)
def processGeneric(call: Call, fields: list[str], targets: list[str], func: str | Callable = "") -> QC:
    """Values of the targets from an expression of the fields."""
    df, results = _expressions(call, fields, func, len(targets))
    qc = call.qc
    for i, t in enumerate(targets):
        new = df.select(*qc.keys, "t", results[i].cast("double").alias("out"), *([] if t in qc else ["h0", "f0"]))
        if t in qc:
            both = match(qc.fields[t].df, new, [*qc.keys, "t"], "left").withColumn("masked", F.lit(False))
            qc = Call(**{**call.__dict__, "qc": qc}).write(t, Series(both, qc.keys))
        else:
            empty = new.select(*qc.keys, "t", F.col("out").alias("value"), F.lit(None).cast("double").alias("flag"), F.array(F.lit(None).cast("double")).alias("hist"))
            qc = qc._new({**qc.fields, t: Field(empty, (call.meta(),))})
    return qc


# ---- flags from elsewhere


@flagging()
def setFlags(s: Series, data: object = None, override: bool = False, call: Call | None = None) -> Series:
    """Flag given stamps, given closed intervals (pairs), or the intervals of another field (t .. value in microseconds)."""
    free = F.coalesce("flag", F.lit(UNFLAGGED)) == UNFLAGGED if not override else F.lit(True)
    if isinstance(data, str):
        spans = call.qc.fields[data].df.select(*s.keys, F.col("t").alias("a"), F.col("value").cast("long").alias("b"))  # type: ignore[union-attr]
        return _in_spans(s, spans, free)
    if isinstance(data, DataFrame):
        return _in_spans(s, data, free)
    items = list(data or [])  # type: ignore[call-overload]
    at = lambda x: F.unix_micros(F.to_timestamp(F.lit(str(x))))
    if items and isinstance(items[0], (tuple, list)):
        hit = reduce(Column.__or__, [(F.col("t") >= at(a)) & (F.col("t") <= at(b)) for a, b in items], F.lit(False))
    else:
        hit = F.col("t").isin(*[at(x) for x in items]) if items else F.lit(False)
    return s.with_(hit=hit & free)


def _in_spans(s: Series, spans: DataFrame, free: Column, bucket: int = 86_400_000_000) -> Series:
    """Rows inside any interval (keys, a, b): an equi-join on day buckets, so that no table is broadcast whole."""
    cut = spans.filter("a <= b").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a") / bucket), F.floor(F.col("b") / bucket))))
    cut = cut.groupBy(*s.keys, "bucket").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    df = s.df.withColumn("bucket", F.floor(F.col("t") / bucket)).join(cut, [*s.keys, "bucket"], "left").drop("bucket")
    hit = F.coalesce(F.exists("spans", lambda x: (F.col("t") >= x["a"]) & (F.col("t") <= x["b"])), F.lit(False))
    return Series(df.withColumn("hit", hit & free), s.keys)


@register(mask=True, demask=True)
def flagManual(s: Series, mdata: DataFrame | None = None, method: str = "left-open", mformat: str | None = None, mflag: float = 1, call: Call | None = None) -> Series:
    """Flag by a table of hand marks (keys, t, value), read as ontime, left-open, right-open or closed steps, or start-end pairs (t .. value)."""
    method = mformat or method
    if method == "start-end":
        spans = mdata.select(*s.keys, F.col("t").alias("a"), F.col("value").cast("long").alias("b"))  # type: ignore[union-attr]
        return _in_spans(s, spans, F.lit(True))
    marks = mdata.select(*s.keys, "t", (F.col("value") == mflag).alias("m"))  # type: ignore[union-attr]
    if method in ("ontime", "plain"):
        df = match(s.df, marks.filter("m").select(*s.keys, "t", F.lit(True).alias("hit")).distinct(), [*s.keys, "t"], "left")
        return Series(df, s.keys)
    both = s.df.select("*", F.lit(None).cast("boolean").alias("m"), F.lit(1).alias("own"))
    other = marks.select(*s.keys, "t", "m").select(*[F.col(c) if c in (*s.keys, "t", "m") else (F.lit(0) if c == "own" else F.lit(None).cast(dict(both.dtypes)[c])).alias(c) for c in both.columns])
    u = Series(both.unionByName(other), s.keys)
    # from the series' first row on: such a frame grows, while one of a great fixed reach is gone through anew for every row
    before = F.last("m", True).over(u.span(Window.unboundedPreceding, Window.currentRow))
    strictly = F.last("m", True).over(u.span(Window.unboundedPreceding, -1))
    hit = {"right-open": before, "left-open": strictly, "closed": F.coalesce(before, F.lit(False)) | F.coalesce(strictly, F.lit(False))}[method]
    return Series(u.df.withColumn("hit", hit).filter("own = 1").drop("own", "m"), s.keys)


@register(mask=False, multivariate=True, handles_target=True)
def transferFlags(call: Call, fields: list[str], targets: list[str], squeeze: bool = False, overwrite: bool = False) -> QC:
    """Append the histories of the fields to those of the targets (n to n, or n to one)."""
    if len(targets) == 1:
        targets = targets * len(fields)
    if len(targets) != len(fields):
        raise ValueError("field and target must be of one length, or the target single")
    qc, on = call.qc, [*call.qc.keys, "t"]
    for f, t in zip(fields, targets, strict=True):
        src = qc.fields[f]
        if t not in qc:
            bare = src.df.withColumns({"flag": F.lit(None).cast("double"), "hist": F.array().cast("array<double>")})
            qc = qc._new({**qc.fields, t: Field(bare)})
        df = match(qc.fields[t].df, src.df.select(*on, F.col("hist").alias("sh"), F.col("flag").alias("sf")), on, "left")
        none = F.transform(F.sequence(F.lit(1), F.lit(max(1, len(src.meta)))), lambda _: F.lit(None).cast("double"))
        free = F.lit(True) if overwrite else ~is_flagged(F.col("flag"), call.dfilter)
        if squeeze:
            new, meta = F.array(F.when(free, F.col("sf"))), (call.meta(),)
        else:
            own = F.when(free & F.col("sh").isNotNull(), F.col("sh")).otherwise(none) if src.meta else F.array().cast("array<double>")
            new, meta = F.concat(own, F.array(F.lit(None).cast("double"))), (*src.meta, call.meta())
        df = df.select(*on, "value", F.when(free, F.coalesce("sf", "flag")).otherwise(F.col("flag")).alias("flag"), F.concat("hist", new).alias("hist"))
        qc = qc._new({**qc.fields, t: Field(df, (*qc.fields[t].meta, *meta))})
    return qc


@flagging(reach=lambda kw: micros(kw["window"]) if isinstance(kw.get("window"), str) else None)
def propagateFlags(s: Series, window: str | int = 1, method: str = "ffill", call: Call | None = None) -> Series:
    """Carry the flags of the last test forward (or back) over a window of time or rows."""
    if method not in ("ffill", "bfill"):
        raise ValueError("method is ffill or bfill")
    hot = F.when(is_flagged(F.try_element_at("hist", F.lit(-1)), call.dfilter), 1).otherwise(0)  # type: ignore[union-attr]
    if isinstance(window, int):
        w = s.rows(-window, -1) if method == "ffill" else s.rows(1, window)
    else:
        m = micros(window)
        w = s.span(-m, -1) if method == "ffill" else s.span(1, m)
    return s.with_(hit=(F.max(hot).over(w) == 1) & ~is_flagged(F.col("flag"), call.dfilter))  # type: ignore[union-attr]


def _group(call: Call, fields: list[str], targets: list[str], group: QC | Sequence[QC] | None, every: bool) -> QC:
    others = [call.qc] if group is None else ([group] if isinstance(group, QC) else list(group))
    qc, on = call.qc, [*call.qc.keys, "t"]
    parts = [o.fields[f].df.select(*on, is_flagged(F.col("flag"), call.dfilter).alias(f"x{i}_{j}")) for i, o in enumerate(others) for j, f in enumerate(fields) if f in o]
    joined = reduce(lambda a, b: match(a, b, on, "full_outer"), parts)
    flags = [F.coalesce(c, F.lit(False)) for c in joined.columns if c not in on]
    hit = joined.select(*on, reduce(Column.__and__ if every else Column.__or__, flags).alias("hit"))
    for t in targets:
        if t not in qc:
            qc = qc._new({**qc.fields, t: qc.fields[fields[0]] if len(fields) == 1 else Field(qc.fields[fields[0]].df.withColumns({"value": F.lit(None).cast("double"), "flag": F.lit(None).cast("double"), "hist": F.array().cast("array<double>")}))})
        df = match(qc.fields[t].df, hit, on, "left").withColumn("hit", F.col("hit") & ~is_flagged(F.col("flag"), call.dfilter))
        qc = Call(**{**call.__dict__, "qc": qc}).write(t, Series(df, qc.keys))
    return qc


@register(mask=False, multivariate=True, handles_target=True)
def andGroup(call: Call, fields: list[str], targets: list[str], group: QC | Sequence[QC] | None = None) -> QC:
    """Flag where all fields of all objects are flagged."""
    return _group(call, fields, targets, group, True)


@register(mask=False, multivariate=True, handles_target=True)
def orGroup(call: Call, fields: list[str], targets: list[str], group: QC | Sequence[QC] | None = None) -> QC:
    """Flag where any field of any object is flagged."""
    return _group(call, fields, targets, group, False)


@register(mask=True, demask=True)
def flagByClick(s: Series, stamps: Sequence[object] = (), call: Call | None = None) -> Series:
    """The effect of picking points in a figure: flag the given stamps. (There is no window to click in.)"""
    return setFlags(s, list(stamps), True, call)
