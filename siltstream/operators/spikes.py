"""Implausible measurements: impossible readings, stuck stretches and spikes of each source.

A spike is judged by extreme-value theory. The residual of a reading is its distance from the
moving median of its neighbours, which carries the course of the year and of the weather, less
its source's usual residual at that time of day (a winsorised mean, so that spikes cannot bend
it). Over a high quantile of its source's absolute residuals the excesses follow a generalised
Pareto distribution. It is fitted by quantiles of the excesses (Pickands 1975): the highest
quarter of them counts only by its number, so spikes, however large, cannot hide behind their
own fit. Threshold and scale are each source's own; the shape, which takes many excesses to be
told, is drawn towards the field's common shape where a source has few (regional frequency
analysis, Hosking and Wallis 1997). The cutoff is the level that the fitted tail exceeds with a
fixed risk; nothing caps it.

Plan. One range shuffle puts every source in time order (a hot source over many partitions);
one pass computes residuals and stretches; edges of partitions are joined in a small step. One
histogram of the residuals serves the seasonal term, the tail and the first step of the exact
quantile; its size is bounded for each source. Values of a source reach its rows by a join on
source *and partition*, so that a source is spread as wide as the partitions it fills.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import blocks, breaks, ordered
from ..plans.scratch import stage

#: Room for the rounding of decimal fractions in a comparison.
EPS = 1e-9
#: Bins of a residual's logarithm in an octave, and cells of the seasonal term in a day.
_BINS, _CELLS, _DAY = 16, 8, 86_400_000_000
_COLS = {
    "kind": "string", "part": "long", "field": "string", "source": "string", "id": "long", "t": "long", "x": "double", "r": "double", "need": "boolean",
    "piece": "long", "n": "long", "x1": "double", "t1": "long", "opens": "boolean", "closes": "boolean",
}
_SCHEMA = ", ".join(f"{k} {v}" for k, v in _COLS.items())


def _medians(x: np.ndarray, start: np.ndarray, end: np.ndarray, half: int) -> np.ndarray:
    """For each row the median of itself and up to ``half`` rows on each side, within start[i] .. end[i]-1."""
    out = np.empty(len(x))
    for lo in range(0, len(x), 20_000):
        own = np.arange(lo, min(len(x), lo + 20_000))
        i = own[:, None] + np.arange(-half, half + 1)[None, :]
        inside = (i >= start[own, None]) & (i < end[own, None])
        w = np.where(inside, x[np.clip(i, 0, len(x) - 1)], np.inf)
        w.sort(axis=1)
        k = inside.sum(axis=1)
        r = np.arange(len(own))
        out[own] = (w[r, (k - 1) // 2] + w[r, k // 2]) / 2
    return out


def _frame(kind: str, part: int, **cols: object) -> pd.DataFrame:
    n = len(next(iter(cols.values())))
    return pd.DataFrame({"kind": [kind] * n, "part": [part] * n} | {c: cols.get(c, [None] * n) for c in list(_COLS)[2:]}, columns=list(_COLS))


def _walk(batches: Iterable[pd.DataFrame], half: int, tol: float, size: int) -> Iterator[pd.DataFrame]:
    yield from (f for f in _frames(batches, half, tol, size) if len(f))


def _frames(batches: Iterable[pd.DataFrame], half: int, tol: float, size: int) -> Iterator[pd.DataFrame]:
    """Residuals and stretches of one partition, block by block.

    Kinds returned: ``row`` (settled), ``edge`` (rows near a block's ends, ``need`` where the
    residual depends on the next block), ``piece`` (stretches of two rows or more, and those
    that touch a block's ends), ``single`` (counts of the other stretches). A row holds the
    length ``n`` of its stretch, or its number ``piece`` where the stretch touches a block's end.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    piece0 = part << 40
    previous = None
    for block in blocks(batches, size):
        copy = ~breaks(block["id"].to_numpy(), block["t"].to_numpy())
        copy[0] = previous == (block["id"].iloc[0], block["t"].iloc[0])
        previous = (block["id"].iloc[-1], block["t"].iloc[-1])
        block = block[~copy]
        n = len(block)
        if not n:
            continue
        field, source = block["field"].to_numpy(), block["source"].to_numpy()
        x, t, ids = block["x"].to_numpy(float), block["t"].to_numpy(), block["id"].to_numpy()
        new = breaks(field, source)
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        start, end = starts[group], np.append(starts[1:], n)[group]
        r = x - _medians(x, start, end, half)
        row = np.arange(n)
        need = ((row < half) & (group == 0)) | ((row >= n - half) & (group == group[-1]))
        edge = ((row < 2 * half) & (group == 0)) | ((row >= n - 2 * half) & (group == group[-1]))
        cut = new.copy()
        cut[1:] |= np.abs(np.diff(x)) > tol
        at = np.flatnonzero(cut)
        length = np.diff(np.append(at, n))
        of = np.cumsum(cut) - 1
        kept = length > 1
        kept[[0, -1]] = True
        touches = np.zeros(len(at), bool)
        touches[[0, -1]] = True
        rows = {"field": field, "source": source, "id": ids, "t": t, "x": x, "r": r, "piece": np.where(touches[of], piece0 + of, -1), "n": length[of], "need": need}
        yield _frame("row", part, **{k: v[~need] for k, v in rows.items()})
        yield _frame("edge", part, **{k: v[edge] for k, v in rows.items()})
        a, m = at[kept], length[kept]
        yield _frame("piece", part, field=field[a], source=source[a], piece=piece0 + np.flatnonzero(kept), n=m, x=x[a], t=t[a], x1=x[a + m - 1], t1=t[a + m - 1], opens=a == 0, closes=a + m == n)
        alone = np.bincount(group[at[~kept]], minlength=len(starts))
        some = np.flatnonzero(alone)
        yield _frame("single", part, field=field[starts[some]], source=source[starts[some]], n=alone[some])
        piece0 += len(at)


def residuals(readings: DataFrame, half: int = 6, stuck_tol: float = 0.001, block_rows: int = 400_000) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Residuals and stretches of every source: ``(rows, stretches, lengths, parts)``.

    ``readings``: field, source, id, t (microseconds), x; no nulls. Copies (equal id and t)
    count once. rows: each reading with its partition ``part``, its distance ``r`` from the
    moving median (with sign) and the length ``n`` of its stretch, or, where ``piece`` is not
    -1, a part of it; stretches: piece, stretch - the whole lengths of these; lengths: field,
    source, n, times; parts: field, source, part - which partitions hold rows of a source.
    ``block_rows``: rows that a task holds at a time; the result does not depend on it.
    """
    flow = ordered(readings.select("field", "source", "t", "id", "x"), "field", "source", "t", "id")
    table = stage(flow.mapInPandas(partial(_walk, half=half, tol=stuck_tol + EPS, size=block_rows), _SCHEMA), "residuals", ["kind"])
    of = lambda kind: table.filter(F.col("kind") == kind)
    by_time = Window.partitionBy("field", "source").orderBy("t", "id")
    edges = of("edge").withColumn("r", F.col("x") - F.percentile("x", F.lit(0.5)).over(by_time.rowsBetween(-half, half))).filter("need")
    cols = ["field", "source", "part", "id", "t", "x", "r", "piece", "n"]
    rows = of("row").select(cols).union(edges.select(cols))
    chain = Window.partitionBy("field", "source").orderBy("t")
    open_ = of("piece").filter("opens or closes")
    joined = F.col("opens") & F.lag("closes").over(chain) & (F.abs(F.col("x") - F.lag("x1").over(chain)) <= stuck_tol + EPS)
    whole = open_.withColumn("first", F.when(joined, 0).otherwise(1)).withColumn("chain", F.sum("first").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    whole = whole.withColumn("total", F.sum("n").over(Window.partitionBy("field", "source", "chain")))
    inner = of("piece").filter("not opens and not closes")
    lengths = (
        of("single").select("field", "source", F.lit(1).cast("long").alias("n"), F.col("n").alias("times"))
        .union(inner.select("field", "source", "n", F.lit(1).cast("long")))
        .union(whole.filter("first = 1").select("field", "source", F.col("total"), F.lit(1).cast("long")))
        .groupBy("field", "source", "n").agg(F.sum("times").alias("times"))
    )
    parts = table.filter(F.col("kind").isin("piece", "single")).select("field", "source", "part").distinct()
    return rows, whole.select("piece", F.col("total").alias("stretch")), lengths, parts


def histogram(rows: DataFrame, cells: int = 8, floor: float = 0.15) -> DataFrame:
    """Residuals by field, source, time of day (``cells`` a day), sign and logarithmic bin: n, s (sum), w (sum, winsorised at ``floor``)."""
    d = F.abs("r")
    bin_ = F.when(d <= EPS, -10_000).otherwise(F.floor(F.log2(d) * _BINS)).cast("int")
    cell = (F.pmod(F.col("t"), F.lit(_DAY)) / (_DAY // cells)).cast("int")
    clipped = F.greatest(F.least(F.col("r"), F.lit(floor)), F.lit(-floor))
    return rows.groupBy("field", "source", cell.alias("cell"), (F.col("r") < 0).alias("below"), bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum("r").alias("s"), F.sum(clipped).alias("w"))


def tails(bins: DataFrame, level: float = 0.85, risk: float = 1e-3, floor: float = 0.15, prior: float = 1000.0) -> DataFrame:
    """Peaks over threshold: one row for each field and source, from the ``histogram`` of its residuals.

    ``season``: usual residual by time of day; ``threshold``: the quantile ``level`` of the
    absolute seasonal residuals; ``shape`` and ``scale``: the tail fitted to the median and the
    upper quartile of the excesses (null where they do not differ), a source's own shape
    counting as many excesses as it has and the field's as ``prior``; ``cutoff``: what the tail
    exceeds with probability ``risk``. Neither threshold nor cutoff is less than ``floor``,
    below which no distance is implausible. Quantiles are taken inside bins of four in a hundred.
    """
    keys = ["field", "source"]
    cells = bins.groupBy(*keys, "cell").agg((F.sum("w") / F.sum("n")).alias("usual"))
    season = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("cell", "usual"))).alias("season"))  # at most 24
    e = bins.join(season, keys).withColumn("e", F.abs(F.col("s") / F.col("n") - F.element_at("season", F.col("cell"))))
    # binned again without time of day and sign; a quantile lies inside its bin in proportion of its rows, so that none falls between the steps of a coarse probe
    e = e.groupBy(*keys, F.floor(F.log2(F.greatest("e", F.lit(EPS))) * _BINS).alias("bin")).agg(F.sum("n").alias("n"))
    e = e.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    inside = lambda q: (F.col("bin") + (q * F.col("all") - F.col("upto") + F.col("n")) / F.col("n")) / _BINS
    at = lambda q: F.min(F.when((F.col("upto") >= q * F.col("all")) & (F.col("upto") - F.col("n") < q * F.col("all")), F.pow(F.lit(2.0), inside(q))))
    rest = 1 - level
    one = e.groupBy(*keys).agg(F.max("all").alias("n"), at(level).alias("q"), at(1 - rest / 2).alias("half"), at(1 - rest / 4).alias("top"))
    one = one.select(*keys, "n", "q", "half", "top", F.try_divide(F.col("top") - F.col("half"), F.col("top") - F.col("q")).alias("own"))
    common = one.groupBy("field").agg(F.try_divide(F.sum(F.col("own") * F.col("n")), F.sum(F.when(F.col("own").isNotNull(), F.col("n")))).alias("common"))
    fitted = one.join(common, "field").mapInPandas(partial(_fit, rest=rest, risk=risk, floor=floor, prior=prior), "field string, source string, n long, threshold double, shape double, scale double, cutoff double")
    return fitted.join(season, keys)


def _fit(batches: Iterable[pd.DataFrame], rest: float, risk: float, floor: float, prior: float) -> Iterator[pd.DataFrame]:
    """The tail of each source from three quantiles: of the threshold, and of the median and upper quartile of the excesses."""
    for f in batches:
        own, common, m, spread = f["own"].to_numpy(float), f["common"].to_numpy(float), f["n"].to_numpy(float) * rest, (f["top"] - f["q"]).to_numpy(float)
        with np.errstate(all="ignore"):
            share = (own * m + common * prior) / (m + prior)
            # upper quartile over median of the excesses is 2^shape + 1
            shape = np.where((share > 0) & (share < 1), np.log2(share / (1 - share)), np.nan)
            flat = np.abs(shape) < 1e-6
            scale = np.where(flat, spread / math.log(4), shape * spread / (4.0**shape - 1))
            odds = rest / risk
            reach = np.where(flat, math.log(odds), (odds**shape - 1) / shape)
            u = np.maximum(f["q"], floor)
            cutoff = np.fmax(u, f["q"] + scale * reach)
        yield pd.DataFrame({"field": f["field"], "source": f["source"], "n": f["n"], "threshold": u, "shape": shape, "scale": scale, "cutoff": cutoff})


def quantile(rows: DataFrame, bins: DataFrame, parts: DataFrame, level: float = 0.9) -> DataFrame:
    """The interpolated quantile of each source's absolute residuals, exactly: field, source, ``level_d``.

    The histogram names the bins that hold the two values the quantile lies between; their
    values, counted, are divided again into 4,096 parts each, and the parts with the two values
    are sorted. No task sorts more than such a part.
    """
    keys = ["field", "source"]
    hit = lambda k: (F.col("upto") > F.col(k)) & (F.col("upto") - F.col("n") <= F.col(k))
    w = Window.partitionBy(*keys).orderBy("bin")
    one = bins.groupBy(*keys, "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    one = one.withColumn("lo", F.floor(level * (F.col("all") - 1)).cast("long")).withColumn("hi", F.least(F.col("lo") + 1, F.col("all") - 1))
    target = one.filter(hit("lo") | hit("hi")).select(*keys, "bin", (F.col("upto") - F.col("n")).alias("before"), "lo", "hi", (level * (F.col("all") - 1) - F.col("lo")).alias("frac"))
    d = F.abs("r")
    bin_ = F.when(d <= EPS, -10_000).otherwise(F.floor(F.log2(d) * _BINS)).cast("int")
    values = rows.select(*keys, "part", bin_.alias("bin"), d.alias("d")).join(target.join(parts, keys), [*keys, "part", "bin"])
    fine = F.when(F.col("bin") > -10_000, F.floor((F.log2("d") * _BINS - F.col("bin")) * 4096)).otherwise(0).cast("int")
    values = values.groupBy(*keys, "bin", "d").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("before", "lo", "hi", "frac"))).withColumn("fine", fine)
    some = values.groupBy(*keys, "bin", "fine").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("before", "lo", "hi")))
    some = some.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "bin").orderBy("fine")))
    some = some.filter(hit("lo") | hit("hi")).select(*keys, "bin", "fine", (F.col("upto") - F.col("n")).alias("from"))
    last = values.join(some, [*keys, "bin", "fine"]).withColumn("upto", F.col("from") + F.sum("n").over(Window.partitionBy(*keys, "bin", "fine").orderBy("d")))
    at = lambda k: F.max(F.when(hit(k), F.col("d")))
    out = last.groupBy(*keys).agg(at("lo").alias("a"), at("hi").alias("b"), F.first("frac").alias("frac"))
    return out.select(*keys, (F.col("a") + F.col("frac") * (F.col("b") - F.col("a"))).alias("level_d"))


def implausible(
    readings: DataFrame, half: int = 6, level: float = 0.85, risk: float = 1e-3, floor: float = 0.15, stuck_tol: float = 0.001, stuck_rows: int = 16, stuck_factor: float = 8.0,
    low: float = 0.0, high: float = 100.0, confirm: float | None = None, confirm_level: float = 0.9,
) -> DataFrame:
    """Flag readings that are implausible for their source; one row for each flagged reading.

    ``readings``: field, source, id, t (microseconds), x. Rows with a null among them are left
    out before anything else; copies (equal id and t) count once; an empty table gives an empty
    result; a source of one reading has residual 0 and is only tested for plausibility.

    Kinds, the first that fits: ``impossible`` (outside low..high), ``stuck`` (in a longest
    stretch of readings each within ``stuck_tol`` of the one before, of at least ``stuck_rows``
    readings and ``stuck_factor`` times the source's median stretch), ``spike`` (seasonal
    residual over the cutoff of ``tails``). With ``confirm``, spikes that the tail finds are
    checked: the distance from the moving median must exceed ``confirm`` times its exact
    quantile ``confirm_level`` at the source (``floor`` if that is more).
    """
    readings = readings.dropna(subset=["field", "source", "id", "t", "x"])
    rows, stretches, lengths, parts = residuals(readings, half, stuck_tol)
    usual = lengths.groupBy("field", "source").agg(F.percentile("n", F.lit(0.5), F.col("times")).alias("usual"))
    bins = stage(histogram(rows, _CELLS, floor), "histogram")
    limits = tails(bins, level, risk, floor).join(usual, ["field", "source"], "left")
    if confirm is not None:
        limits = limits.join(quantile(rows, bins, parts, confirm_level), ["field", "source"], "left")
    wide = (F.col("x") < low) | (F.col("x") > high)
    # only rows that some rule can still flag travel to the limits; a season term is at most the floor
    d = F.abs("r")
    some = rows.filter(wide | (F.col("n") >= stuck_rows) | (F.col("piece") >= 0) | (2 * d > floor))
    cut = some.filter("piece >= 0").join(stretches, "piece", "left").withColumn("n", F.coalesce("stretch", "n")).drop("stretch")
    some = some.filter("piece < 0").unionByName(cut).filter(wide | (F.col("n") >= stuck_rows) | (2 * d > floor))
    out = some.join(limits.drop("n").join(parts, ["field", "source"]), ["field", "source", "part"])
    cell = (F.pmod(F.col("t"), F.lit(_DAY)) / (_DAY // _CELLS)).cast("int")
    e = F.abs(F.col("r") - F.coalesce(F.element_at("season", cell), F.lit(0.0)))
    stuck = F.col("n") >= F.greatest(F.lit(float(stuck_rows)), stuck_factor * F.col("usual"))
    spike = e > F.col("cutoff")
    if confirm is not None:
        spike &= d > confirm * F.greatest(F.col("level_d"), F.lit(floor)) + EPS
    kind = F.when(wide, "impossible").when(stuck, "stuck").when(spike, "spike")
    return out.withColumn("kind", kind).filter("kind is not null").select("field", "source", "id", "t", "x", "kind", e.alias("residual"), "cutoff", F.col("n").alias("stretch"))


def both_fields(*tables: tuple[DataFrame, str, str, str, str, str]) -> DataFrame:
    """Long readings of several tables: each (table, field, id, source, time, value column)."""
    from ..plans.cells import number
    from ..plans.ordered import micros

    parts = [
        df.select(F.lit(field).alias("field"), F.col(source).cast("string").alias("source"), F.col(id_).cast("long").alias("id"), micros(df, time).alias("t"), number(F.col(value)).alias("x"))
        for df, field, id_, source, time, value in tables
    ]
    return reduce(DataFrame.union, parts).dropna()
