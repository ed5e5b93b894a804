"""Irregular readings onto a regular grid.

A cumulative counter is differenced between consecutive readings, resets are found, and each
increment is shared among the grid cells its interval overlaps, in proportion to the overlap.
A level (a gauge) is the rate of such a counter: its running integral over time, by trapezoids,
is one that never resets. Its increments are shared by the same code, and divided by the time
they cover they give each cell the time-weighted mean of the level. Cells without a reading
are marked: *filled* where the interval between two readings spans them, *uncovered* where
that interval is longer than the source is taken to be in service.

One range shuffle puts the readings in order. Partial sums of a cell meet only where a block
of rows ends, so a second shuffle moves a bounded number of rows for each block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import blocks, breaks, ordered
from ..plans.scratch import stage

_COLS = {"kind": "string", "source": "string", "cell": "long", "amount": "double", "covered": "long", "n": "long", "t": "long", "id": "long", "x": "double", "opens": "boolean", "out": "boolean"}
_SCHEMA = ", ".join(f"{k} {v}" for k, v in _COLS.items())


def _increments(t0: np.ndarray, t1: np.ndarray, x0: np.ndarray, x1: np.ndarray, gauge: bool) -> np.ndarray:
    """What the counter gained between two readings. A counter below its last reading was reset and began again at 0; that of a level gains the trapezoid under it."""
    return (x0 + x1) / 2 * (t1 - t0) if gauge else np.where(x1 < x0, x1, x1 - x0)


def _share(source: np.ndarray, t0: np.ndarray, t1: np.ndarray, x0: np.ndarray, x1: np.ndarray, step: int, silence: int | None, gauge: bool) -> pd.DataFrame:
    """Overlap of the intervals t0..t1 with the cells around multiples of ``step``: source, cell, amount, covered, out."""
    c0, c1 = (t0 + step // 2) // step, (t1 + step // 2) // step
    k = (c1 - c0 + 1).astype(np.int64)
    i = np.repeat(np.arange(len(k)), k)
    cell = c0[i] + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
    lo, hi = cell * step - step // 2, cell * step + step - step // 2
    a, b = np.maximum(lo, t0[i]), np.minimum(hi, t1[i])
    over = np.maximum(b - a, 0)
    span = np.maximum(t1 - t0, 1)[i]
    amount = _increments(t0, t1, x0, x1, gauge)[i] * over / span
    out = np.zeros(len(i), bool) if silence is None else ((t1 - t0)[i] > silence)
    return pd.DataFrame({"source": source[i], "cell": cell, "amount": amount, "covered": over, "out": out})


def _frame(kind: str, rows: int, **cols: object) -> pd.DataFrame:
    return pd.DataFrame({"kind": [kind] * rows} | {c: cols.get(c, [None] * rows) for c in list(_COLS)[1:]}, columns=list(_COLS))


def _walk(batches: Iterable[pd.DataFrame], step: int, silence: int | None, gauge: bool, size: int) -> Iterator[pd.DataFrame]:
    """Cells of one partition: ``cell`` (whole), ``part`` (to be added up), ``end`` (first and last reading of a block)."""
    previous = None
    for block in blocks(batches, size):
        copy = ~breaks(block["id"].to_numpy(), block["t"].to_numpy())
        copy[0] = previous == (block["id"].iloc[0], block["t"].iloc[0])
        previous = (block["id"].iloc[-1], block["t"].iloc[-1])
        block = block[~copy]
        n = len(block)
        if not n:
            continue
        source, t, x, ids = block["source"].to_numpy(), block["t"].to_numpy(), block["x"].to_numpy(float), block["id"].to_numpy()
        new = breaks(source)
        pair = np.flatnonzero(~new)
        shares = _share(source[pair], t[pair - 1], t[pair], x[pair - 1], x[pair], step, silence, gauge)
        own = pd.DataFrame({"source": source, "cell": (t + step // 2) // step, "n": 1, "x": x})
        both = pd.concat([shares.assign(n=0, x=0.0), own.assign(amount=0.0, covered=0, out=False)], ignore_index=True)
        g = both.groupby(["source", "cell"], sort=False, as_index=False).agg(amount=("amount", "sum"), covered=("covered", "sum"), n=("n", "sum"), x=("x", "sum"), out=("out", "max"))
        cells, of = g["cell"].to_numpy(), g["source"].to_numpy()
        part = ((of == source[0]) & (cells == (t[0] + step // 2) // step)) | ((of == source[-1]) & (cells == (t[-1] + step // 2) // step))
        for kind, keep in (("cell", ~part), ("part", part)):
            f = g[keep]
            if len(f):
                yield _frame(kind, len(f), **{c: f[c].to_numpy() for c in f})
        ends = [0, n - 1]
        yield _frame("end", 2, source=source[ends], t=t[ends], id=ids[ends], x=x[ends], opens=[True, False])


def _joints(batches: Iterable[pd.DataFrame], step: int, silence: int | None, gauge: bool) -> Iterator[pd.DataFrame]:
    for f in batches:
        s = _share(f["source"].to_numpy(), f["t0"].to_numpy(), f["t"].to_numpy(), f["x0"].to_numpy(float), f["x"].to_numpy(float), step, silence, gauge)
        yield s.assign(n=0, x=0.0)[["source", "cell", "amount", "covered", "n", "x", "out"]]


def regular_series(readings: DataFrame, step_s: int = 900, silence_s: int | None = 5 * 86400, kind: str = "gauge", block_rows: int = 200_000) -> DataFrame:
    """A regular series for each source: source, slot_epoch_s, value, n_readings, mean_reading, covered_s, status.

    ``readings``: source, id, t (microseconds), x. Rows with a null among them are left out;
    copies (equal id and t) count once; an empty table gives an empty series. A slot stands for
    the time from half a step before it (included) to half a step after it (excluded). kind
    ``counter``: ``value`` is the increment in the cell, ``gauge``: the time-weighted mean, or
    the mean reading where a cell holds readings but no time. status: ``measured`` (has a
    reading), ``filled``, or ``uncovered`` (no reading, inside a silence longer than
    ``silence_s``; value null). The series runs from the first to the last reading.
    """
    if kind not in ("gauge", "counter"):
        raise ValueError("kind is gauge or counter")
    step, silence = step_s * 1_000_000, None if silence_s is None else silence_s * 1_000_000
    if step % 2:
        raise ValueError("the step must have an even number of microseconds")
    how = {"step": step, "silence": silence, "gauge": kind == "gauge"}
    flow = ordered(readings.dropna(subset=["source", "id", "t", "x"]).select("source", "t", "id", "x"), "source", "t", "id")
    table = stage(flow.mapInPandas(partial(_walk, **how, size=block_rows), _SCHEMA), "cells", ["kind"])
    of = lambda k: table.filter(F.col("kind") == k)
    w = Window.partitionBy("source").orderBy("t", "id", F.col("opens").desc())
    ends = of("end").select("source", "t", "id", "x", "opens")
    ends = ends.withColumn("t0", F.lag("t").over(w)).withColumn("x0", F.lag("x").over(w)).withColumn("shut", ~F.lag("opens").over(w)).filter("opens and shut and t0 is not null")
    names = ["source", "cell", "amount", "covered", "n", "x", "out"]
    joints = ends.mapInPandas(partial(_joints, **how), "source string, cell long, amount double, covered long, n long, x double, out boolean")
    # a joint's inner cells are whole, but its outer ones are parts; all of them are few
    parts = of("part").select(names).union(joints).groupBy("source", "cell").agg(*(F.sum(c).alias(c) for c in names[2:6]), F.max("out").alias("out"))
    cells = of("cell").select(names).union(parts.select(names))
    mean = F.when(F.col("n") > 0, F.col("x") / F.col("n"))
    value = F.coalesce(F.when(F.col("covered") > 0, F.col("amount") / F.col("covered")), mean) if kind == "gauge" else F.col("amount")
    status = F.when(F.col("n") > 0, "measured").when(F.col("out"), "uncovered").otherwise("filled")
    return cells.select(
        "source", (F.col("cell") * step_s).alias("slot_epoch_s"), F.when(status != "uncovered", value).alias("value"), F.col("n").alias("n_readings"),
        mean.alias("mean_reading"), (F.col("covered") / 1e6).alias("covered_s"), status.alias("status"),
    )
