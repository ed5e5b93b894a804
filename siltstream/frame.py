"""The object that operators work on: fields, each a plan of its own, and what was done to them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schemes
from .flags import BAD, FILTER_ALL, UNFLAGGED, is_flagged
from .plans.cells import match
from .plans.ordered import micros as stamp_micros
from .registry import OPERATORS, Op


@dataclass(frozen=True)
class Field:
    """One field: a plan with the keys, t (microseconds), value, flag and hist (one element a test), and the tests' meta."""

    df: DataFrame
    meta: tuple[dict, ...] = ()


class Series:
    """What an operator gets: rows of one field, its value already masked, and windows over time."""

    def __init__(self, df: DataFrame, keys: tuple[str, ...]):
        self.df, self.keys = df, keys

    def with_(self, **cols: Column) -> Series:
        return Series(self.df.withColumns(cols), self.keys)

    def by(self, *more: str) -> list[Column]:
        # a series without key still names a partition, so that every window shares one exchange
        return [F.col(k) for k in (*self.keys, *more)] or [F.lit(0)]

    @property
    def whole(self) -> Window:
        return Window.partitionBy(*self.by())

    def summed(self, **stats: Column) -> Series:
        """Adds statistics of each whole series: aggregated apart and joined, so that no task holds a series and no row is shuffled where the statistics are few."""
        if not self.keys:
            return Series(self.df.crossJoin(F.broadcast(self.df.agg(*(c.alias(k) for k, c in stats.items())))), self.keys)  # one row
        per = self.df.groupBy(*self.keys).agg(*(c.alias(k) for k, c in stats.items()))
        return Series(match(self.df, per, list(self.keys), "left"), self.keys)

    @property
    def order(self) -> Window:
        return Window.partitionBy(*self.by()).orderBy("t")

    def span(self, low: int, high: int) -> Window:
        """Rows from low to high microseconds around a row's time."""
        return self.order.rangeBetween(low, high)

    def rows(self, low: int, high: int) -> Window:
        return self.order.rowsBetween(low, high)

    @property
    def past(self) -> Window:
        return self.order.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def ahead(self) -> Window:
        """All later rows, nearest last: a growing frame in reversed order."""
        return Window.partitionBy(*self.by()).orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, -1)


def _single(df: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    """One row for each key and time."""
    n = F.row_number().over(Window.partitionBy(*(*keys, "t")).orderBy("value", "flag"))
    again = F.col("__n") > 1
    wrong = F.when(~again, True).otherwise(F.raise_error(F.lit("ValueError: two rows of one key and time")).cast("boolean"))
    return df.withColumn("__n", n).filter(wrong if how == "raise" else ~again).drop("__n")


class QC:
    """Fields with their flag histories; immutable, lazily evaluated.

    ``QC.from_long(...)`` or ``QC.from_wide(...)`` make one; operators are methods
    (``qc.flagRange("x", min=0)``) and return a new object. ``keys`` name columns that divide a
    field into independent series, which are also the unit of parallelism; windows of bounded
    reach are further divided into stretches of ``split`` (None: not).
    """

    def __init__(self, fields: Mapping[str, Field] | None = None, keys: Iterable[str] = (), scheme: str | schemes.Scheme = "float", split: str | None = "90D"):
        self.split = split
        self.fields, self.keys = dict(fields or {}), tuple(keys)
        self.scheme = schemes.of(scheme)

    # ---- sources

    @classmethod
    def from_long(cls, df: DataFrame, time: str, value: str, name: str | None = None, field: str | None = None, keys: Iterable[str] = (), flag: str | None = None, duplicates: str = "keep", **kw) -> QC:
        """One field ``name``, or one for each value of the column ``field``. NaN counts as missing; rows without a time are left out.

        Operators take it that keys and time name one row. ``duplicates``: ``keep`` trusts the
        table, ``raise`` makes a second row of one time an error when the plan runs, ``first``
        keeps one of them (a row with the least value; both cost a shuffle). A null key is a key.
        """
        if duplicates not in ("keep", "raise", "first"):
            raise ValueError("duplicates is keep, raise or first")
        keys = tuple(keys)
        t, v = stamp_micros(df, time), F.col(value).cast("double")
        cols = [*(F.col(k) for k in keys), t.alias("t"), F.nanvl(v, F.lit(None).cast("double")).alias("value")]
        given = F.col(flag).cast("double") if flag else F.lit(None).cast("double")
        given = F.nanvl(given, F.lit(None).cast("double")).alias("flag")
        hist = (F.array(given) if flag else F.array().cast("array<double>")).alias("hist")
        names = [name or value] if field is None else sorted(r[0] for r in df.select(field).distinct().collect() if r[0] is not None)
        meta = ({"func": "importedFlags", "args": (), "kwargs": {}},) if flag else ()
        fields = {n: Field((df if field is None else df.filter(F.col(field) == n)).select(*cols, given, hist).filter("t is not null"), meta) for n in names}
        if duplicates != "keep":
            fields = {n: replace(f, df=_single(f.df, keys, duplicates)) for n, f in fields.items()}
        return cls(fields, keys, **kw)

    @classmethod
    def from_wide(cls, df: DataFrame, time: str, values: Iterable[str], keys: Iterable[str] = (), **kw) -> QC:
        out: dict[str, Field] = {}
        for v in values:
            out |= cls.from_long(df, time, v, keys=keys).fields
        return cls(out, keys, **kw)

    # ---- container

    @property
    def columns(self) -> list[str]:
        return list(self.fields)

    def __len__(self) -> int:
        return len(self.fields)

    def __contains__(self, name: str) -> bool:
        return name in self.fields

    def __getitem__(self, key: str | list[str] | slice) -> QC:
        if isinstance(key, slice):
            names = self.columns
            i = names.index(key.start) if key.start is not None else 0
            j = names.index(key.stop) + 1 if key.stop is not None else len(names)
            names = names[i : j : key.step]
        else:
            names = [key] if isinstance(key, str) else list(key)
        if len(set(names)) != len(names):
            raise ValueError("a field is named twice")
        return self._new({n: self.fields[n] for n in names})

    def set(self, name: str, other: QC) -> QC:
        """A copy in which ``name`` is the only field of ``other``."""
        if len(other) != 1:
            raise ValueError("expected an object with one field")
        return self._new({**self.fields, name: next(iter(other.fields.values()))})

    def without(self, *names: str) -> QC:
        for n in names:
            if n not in self.fields:
                raise KeyError(n)
        return self._new({k: v for k, v in self.fields.items() if k not in names})

    def merge(self, *others: QC) -> QC:
        """All fields of several objects; of a name that occurs twice the later field counts."""
        fields = dict(self.fields)
        for o in others:
            if o.keys != self.keys:
                raise ValueError("objects with different keys")
            fields |= o.fields
        return self._new(fields)

    def _new(self, fields: Mapping[str, Field]) -> QC:
        return QC(fields, self.keys, self.scheme, self.split)

    def with_scheme(self, scheme: str | schemes.Scheme) -> QC:
        return QC(self.fields, self.keys, scheme, self.split)

    # ---- results

    def data(self, name: str) -> DataFrame:
        """keys, ts, value of a field."""
        return self.fields[name].df.select(*self.keys, F.timestamp_micros("t").alias("ts"), "value")

    def flags(self, name: str) -> DataFrame:
        """keys, ts, flag of a field, in the object's scheme."""
        f = self.fields[name]
        return f.df.select(*self.keys, F.timestamp_micros("t").alias("ts"), self.scheme.external(f).alias("flag"))

    def table(self, nodata: float | None = None) -> DataFrame:
        """All fields side by side: keys, ts, <field>__data, <field>__flags, outer-joined on keys and time."""
        out = None
        on = [*self.keys, "t"]
        for n, f in self.fields.items():
            value = F.col("value") if nodata is None else F.coalesce("value", F.lit(float(nodata)))
            one = f.df.select(*on, value.alias(f"{n}__data"), self.scheme.external(f).alias(f"{n}__flags"))
            out = one if out is None else match(out, one, on, "full_outer")
        if out is None:
            raise ValueError("no field")
        return out.withColumn("ts", F.timestamp_micros("t")).select(*self.keys, "ts", *(c for n in self.fields for c in (f"{n}__data", f"{n}__flags")))

    def plot_frame(self, name: str, max_gap: str | None = None) -> DataFrame:
        """The rows behind a figure: keys, ts, value, flag, test (name of the last test that set the flag); an empty row after a gap longer than ``max_gap``."""
        from .timespan import micros

        f = self.fields[name]
        last = F.filter(F.sequence(F.lit(1), F.greatest(F.size("hist"), F.lit(1))), lambda i: F.get(F.col("hist"), i - 1).isNotNull())
        names = F.array(*(F.lit(m["func"]) for m in f.meta)) if f.meta else F.array().cast("array<string>")
        df = f.df.select(*self.keys, "t", "value", F.coalesce("flag", F.lit(UNFLAGGED)).alias("flag"), F.try_element_at(names, F.try_element_at(last, F.lit(-1))).alias("test"))
        if max_gap:
            nxt = F.lead("t").over(Series(df, self.keys).order)
            gaps = df.withColumn("n", nxt).filter(F.col("n") - F.col("t") > micros(max_gap)).select(*self.keys, (F.col("t") + 1).alias("t"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("string"))
            df = df.union(gaps)
        return df.withColumn("ts", F.timestamp_micros("t")).drop("t")

    # ---- calls

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in OPERATORS:
            raise AttributeError(name)
        return partial(self.call, name)

    def _expand(self, field: str | Iterable[str], regex: bool) -> list[str]:
        names = [field] if isinstance(field, str) else list(field)
        if regex:
            names = [n for n in self.columns if any(re.match(p, n) for p in names)]
        return names

    def call(
        self, name: str, /, field: str | Iterable[str], *args, target: str | Iterable[str] | None = None, regex: bool = False, dfilter=None, flag=BAD,
        start_date=None, end_date=None, label: str | None = None, **kw,
    ) -> QC:
        """Run one operator on fields; the keywords named here hold for every operator."""
        op: Op = OPERATORS[name]
        fields = self._expand(field, regex)
        if len(set(fields)) != len(fields):
            raise ValueError("a field is named twice")
        targets = fields if target is None else ([target] if isinstance(target, str) else list(target))
        if not (op.multivariate and op.handles_target) and len(fields) != len(targets):
            raise ValueError("field and target must be of one length")
        for n in fields:
            if n not in self.fields:
                raise KeyError(n)
        limit = self.scheme.limit(dfilter) if dfilter is not None else max(self.scheme.dfilter, op.dfilter)
        ctx = Call(self, name, self.scheme.internal(flag), limit, start_date, end_date, args, kw, label, op)
        if op.multivariate:
            qc = self if op.handles_target or targets == fields else ctx.copy(fields, targets)
            own = fields if op.handles_target else targets
            return op.func(replace(ctx, qc=qc), own, targets, *args, **kw)
        qc = self
        for f, t in zip(fields, targets, strict=True):
            if f != t and not op.handles_target:
                qc = replace(ctx, qc=qc).copy([f], [t])
            here = replace(ctx, qc=qc)
            qc = op.func(here, f, t, *args, **kw) if op.handles_target else here.univariate(t)
        return qc


@dataclass(frozen=True)
class Call:
    """One call of an operator: its keywords, and how its result goes back into the object."""

    qc: QC
    func: str
    flag: float
    dfilter: float
    start: object
    end: object
    args: tuple
    kwargs: dict
    label: str | None
    op: Op

    def copy(self, fields: list[str], targets: list[str]) -> QC:
        return self.qc._new({**self.qc.fields, **{t: self.qc.fields[f] for f, t in zip(fields, targets, strict=True)}})

    def meta(self, **more) -> dict:
        return {"func": self.func, "args": self.args, "kwargs": {**self.kwargs, "dfilter": self.dfilter, "flag": self.flag} | ({"label": self.label} if self.label else {})} | more

    def hidden(self) -> Column:
        """Rows that the operator must not see: flagged ones, and those outside start_date .. end_date."""
        out = is_flagged(F.col("flag"), self.dfilter)
        for limit, low in ((self.start, True), (self.end, False)):
            if limit is not None:
                at = F.unix_micros(F.to_timestamp(F.lit(str(limit))))
                out = out | (F.col("t") < at if low else F.col("t") > at)
        return out

    def masked(self, name: str, mask: bool = True) -> Series:
        df = self.qc.fields[name].df
        cols = {"raw": F.col("value"), "masked": self.hidden() if mask else F.lit(False)}
        df = df.withColumns(cols).withColumn("value", F.when(~F.col("masked"), F.col("value")))
        return Series(df, self.qc.keys)

    def univariate(self, name: str) -> QC:
        s = self.masked(name, self.op.mask)
        run = lambda x: self.op.func(x, *self.args, **self._known(name))
        reach = self.op.reach(dict(zip(self.op.order, self.args)) | self.kwargs) if self.op.reach and self.qc.split else None
        if reach is None:
            return self.write(name, run(s))
        from .plans.halo import bounded
        from .timespan import micros

        out = bounded(s, reach, micros(self.qc.split), run)
        return self.write(name, out)

    def _known(self, name: str) -> dict:
        kw = dict(self.kwargs)
        for k, v in (("flag", self.flag), ("dfilter", self.dfilter), ("call", self), ("name", name)):
            if k in self.op.wants:
                kw[k] = v
        return kw

    def write(self, name: str, s: Series, *, where: Column | None = None, meta: dict | None = None) -> QC:
        """Put a result back: ``hit`` appends flags, ``out`` replaces values, ``newflag`` overrides flags."""
        df, cols = s.df, set(s.df.columns)
        if "hit" in cols:
            new = F.when(F.coalesce(F.col("hit"), F.lit(False)), F.lit(self.flag))
        elif "newflag" in cols:
            new = F.col("newflag")
        else:
            new = F.lit(None).cast("double")
        value = F.col("raw") if "raw" in cols else F.col("value")
        if "out" in cols:
            value = F.coalesce("out", F.when(F.col("masked"), F.col("raw"))) if self.op.demask else F.col("out")
        df = df.select(*self.qc.keys, "t", value.cast("double").alias("value"), F.coalesce(new, F.col("flag")).alias("flag"), F.concat("hist", F.array(new.cast("double"))).alias("hist"))
        old = self.qc.fields[name].meta
        return self.qc._new({**self.qc.fields, name: Field(df, (*old, meta or self.meta()))})


def qc_from_parquet(spark: SparkSession, path: str, time: str, values: Iterable[str], keys: Iterable[str] = ()) -> QC:
    return QC.from_wide(spark.read.parquet(path), time, values, keys)


FILTER_DEFAULT = FILTER_ALL
