"""Collapsing runs of near-identical consecutive events by optimal segmentation.

A segmentation of an entity's events costs the dissimilarity within its runs plus a penalty for
each boundary; pruned dynamic programming finds the cheapest one. The best cost of the events up
to i is the least, over all starts of the last run, of the best cost before the start, the run's
dissimilarity and one penalty. Starts that can no longer win are pruned. Two dissimilarities:

* *step*: the sum over neighbouring events of ``|change| / tolerance``, without bound where the
  events are further apart in time than ``max_gap``; the penalty is 1. It adds up along a run, so
  that of two open starts one leads for ever and pruning leaves a single one: the programme
  collapses to one comparison a step (``segment_steps``; ``segment`` is the plain programme, with
  which it is tested). It allows a slow drift within a run.
* *level*: the squared deviations from the run's mean in units of the tolerance, beside the step
  rule. It does not add up, so that several starts stay open until pruning (as in PELT, Killick
  and others 2012) closes them; a drift is cut into levels.

With the step rule no run reaches over a step that is too large or a gap: such places part the
events into pieces that are solved apart. Blocks of a range-partitioned table are therefore solved
on their own, and the last run of a block and the first of the next are joined by the same cost -
exact for any block size. A hot entity is spread over as many blocks as it fills. For levels a
piece that is cut by a block's end is put together again before it is solved; it is one run of the
step rule, and only such a run meets in one task.
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

#: Room for the rounding of decimal fractions in a comparison.
EPS = 1e-9
_COLS = {"entity": "string", "first_id": "long", "last_id": "long", "n": "long", "t0": "long", "t1": "long", "x0": "double", "x1": "double", "low": "double", "high": "double", "opens": "boolean", "closes": "boolean"}
_SCHEMA = ", ".join(f"{k} {v}" for k, v in _COLS.items())


def segment(cost: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Starts of the runs of a cheapest segmentation; cost[i]: of keeping event i in one run with event i-1.

    Of equally cheap segmentations the one with the longest runs. cost[0] is not read.
    """
    n = len(cost)
    best_before = 0.0  # cheapest cost of all events before the one in hand
    starts: list[tuple[float, int]] = []  # open starts of the last run: cost up to now, start
    chosen = np.zeros(n, np.int64)
    for i, c in enumerate(cost.tolist()):
        starts = [(v + c, s) for v, s in starts] if i else []
        starts.append((best_before + penalty, i))
        # a start whose cost is not below another's stays so: prune it; on a tie the earlier start stays
        lead = starts[0]
        for other in starts[1:]:
            if other[0] < lead[0]:
                lead = other
        starts = [lead]
        best_before, chosen[i] = lead
    out, i = [], n - 1
    while i >= 0:
        out.append(chosen[i])
        i = chosen[i] - 1
    return np.array(out[::-1], np.int64)


def segment_steps(cost: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """What ``segment`` finds, without its loop: with costs that add up, keeping two events together wins where it costs no more than a boundary."""
    cut = cost > penalty
    cut[:1] = True
    return np.flatnonzero(cut)


def segment_levels(x: np.ndarray, tolerance: float, penalty: float = 1.0) -> np.ndarray:
    """Starts of the runs that cost least: squared deviations from each run's mean, in tolerances, plus the penalty for each run.

    Of equally cheap segmentations the one with the longest last runs. The open starts are kept
    as one vector, so that a step costs as much as there are of them.
    """
    n = len(x)
    if not n:
        return np.empty(0, np.int64)
    y = (x - x[0]) / tolerance
    s1, s2 = np.concatenate([[0.0], np.cumsum(y)]), np.concatenate([[0.0], np.cumsum(y * y)])
    best, chosen = np.empty(n + 1), np.zeros(n, np.int64)
    best[0] = 0.0
    open_ = np.zeros(1, np.int64)
    for i in range(n):
        size = i + 1 - open_
        mean = (s1[i + 1] - s1[open_]) / size
        total = best[open_] + np.maximum(s2[i + 1] - s2[open_] - size * mean * mean, 0.0)
        k = int(np.argmin(total > total.min() + EPS))  # the earliest of the best
        best[i + 1], chosen[i] = total[k] + penalty, open_[k]
        # a start that costs no less than a run that begins now can never win again
        open_ = np.append(open_[total < best[i + 1] - EPS], i + 1)
    out, i = [], n - 1
    while i >= 0:
        out.append(chosen[i])
        i = chosen[i] - 1
    return np.array(out[::-1], np.int64)


def _runs(entity: np.ndarray, ids: np.ndarray, t: np.ndarray, x: np.ndarray, at: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> pd.DataFrame:
    """One row for each run that begins at ``at``."""
    m = np.diff(np.append(at, len(x)))
    last = at + m - 1
    return pd.DataFrame({"entity": entity[at], "first_id": ids[at], "last_id": ids[last], "n": m, "t0": t[at], "t1": t[last], "x0": x[at], "x1": x[last], "low": np.minimum.reduceat(x, at), "high": np.maximum.reduceat(x, at), "opens": opens, "closes": closes})


def _levels(x: np.ndarray, at: np.ndarray, tol: float, penalty: float) -> np.ndarray:
    """The starts of runs, each cut into levels; a run of one value is a level."""
    ends = np.append(at[1:], len(x))
    varies = np.maximum.reduceat(x, at) - np.minimum.reduceat(x, at) > EPS
    return np.concatenate([a + segment_levels(x[a:b], tol, penalty) if v else [a] for a, b, v in zip(at, ends, varies, strict=True)]).astype(np.int64)


def _walk(batches: Iterable[pd.DataFrame], tol: float, max_gap: float, least: int, penalty: float | None, size: int) -> Iterator[pd.DataFrame]:
    previous = None
    for block in blocks(batches, size):
        copy = ~breaks(block["id"].to_numpy(), block["t"].to_numpy())
        copy[0] = previous == (block["id"].iloc[0], block["t"].iloc[0])
        previous = (block["id"].iloc[-1], block["t"].iloc[-1])
        block = block[~copy]
        n = len(block)
        if not n:
            continue
        entity, t, x, ids = (block[c].to_numpy() for c in ("entity", "t", "x", "id"))
        cost = np.zeros(n)
        cost[1:] = np.abs(np.diff(x)) / tol
        cost[breaks(entity)] = np.inf
        cost[1:][np.diff(t) > max_gap] = np.inf
        cost[np.abs(cost - 1) * tol <= EPS] = 1.0  # a change of just the tolerance, but for rounding
        at = segment_steps(cost)
        m = np.diff(np.append(at, n))
        edge = (at == 0) | (at + m == n)
        if penalty is None:
            keep = (m >= least) | edge
            yield _runs(entity, ids, t, x, at, at == 0, at + m == n)[keep]
            continue
        # runs that touch an end leave as they are, for the next step; the others are settled here
        settled = np.repeat(~edge, m)
        if settled.any():
            inner = at[~edge] - at[~edge][0]
            part = [v[settled] for v in (entity, ids, t, x)]
            cut = _levels(part[3], inner, tol, penalty)
            runs = _runs(*part, cut, np.zeros(len(cut), bool), np.zeros(len(cut), bool))
            yield runs[runs["n"] >= least]
        loose = np.flatnonzero(np.repeat(edge, m))
        first = np.isin(loose, at)
        yield _runs(*(v[loose] for v in (entity, ids, t, x)), np.arange(len(loose)), loose == 0, loose == n - 1).assign(n=np.where(first, -1, 0))


def _settle(pdf: pd.DataFrame, tol: float, penalty: float, least: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["t0", "first_id"], kind="stable")
    x = pdf["x0"].to_numpy(float)
    at = _levels(x, np.zeros(1, np.int64), tol, penalty)
    out = _runs(pdf["entity"].to_numpy(), pdf["first_id"].to_numpy(), pdf["t0"].to_numpy(), x, at, np.zeros(len(at), bool), np.zeros(len(at), bool))
    return out[out["n"] >= least]


def collapse_runs(events: DataFrame, tolerance: float, max_gap_us: int | None = None, min_count: int = 1, level_penalty: float | None = None, block_rows: int = 200_000) -> DataFrame:
    """One row for each run of at least ``min_count`` events: entity, first_id, last_id, n_events, start_us, end_us, duration_us, first_value, low, high.

    ``events``: entity, id (long), t (microseconds), x (double); other columns are not read.
    Rows with a null or NaN among the four are left out and neither break nor extend a run;
    copies (equal entity, id and t) count once; events at one time are ordered by id. An empty
    table gives an empty result. A change of exactly the tolerance stays within a run. With
    ``level_penalty`` runs are cut into levels, at that price each. ``block_rows``: rows that a
    task holds at a time; the result does not depend on it.
    """
    if tolerance <= 0 or min_count < 1:
        raise ValueError("tolerance must be positive and min_count 1 or more")
    clean = events.select(F.col("entity").cast("string"), F.col("t").cast("long"), F.col("id").cast("long"), F.col("x").cast("double")).dropna()
    flow = ordered(clean, "entity", "t", "id")
    gap = float("inf") if max_gap_us is None else max_gap_us
    table = stage(flow.mapInPandas(partial(_walk, tol=tolerance, max_gap=gap, least=min_count, penalty=level_penalty, size=block_rows), _SCHEMA), "runs")
    w = Window.partitionBy("entity").orderBy("t0", "first_id")
    step = F.abs(F.col("x0") - F.lag("x1").over(w)) <= tolerance + EPS
    near = F.lit(True) if max_gap_us is None else F.col("t0") - F.lag("t1").over(w) <= max_gap_us
    cols = ["entity", "first_id", "last_id", "n", "t0", "t1", "x0", "low", "high"]
    if level_penalty is None:
        whole = table.filter("not opens and not closes")
        joined = F.col("opens") & F.lag("closes").over(w) & step & near
        edge = table.filter("opens or closes").withColumn("start", F.when(joined, 0).otherwise(1)).withColumn("run", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        edge = edge.groupBy("entity", "run").agg(
            F.min_by("first_id", "t0").alias("first_id"), F.max_by("last_id", "t1").alias("last_id"), F.sum("n").alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1"),
            F.min_by("x0", "t0").alias("x0"), F.min("low").alias("low"), F.max("high").alias("high"),
        )
    else:
        # loose events: n is -1 where a run of the step rule begins inside its block, 0 elsewhere
        whole = table.filter("n > 0")
        joined = F.when(F.col("opens"), F.coalesce(F.lag("closes").over(w) & step & near, F.lit(False))).otherwise(F.col("n") == 0)
        edge = table.filter("n <= 0").withColumn("start", F.when(joined, 0).otherwise(1)).withColumn("run", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))

        def settle(pdf: pd.DataFrame) -> pd.DataFrame:
            return _settle(pdf, tolerance, level_penalty, min_count)

        edge = edge.groupBy("entity", "run").applyInPandas(settle, _SCHEMA)
    out = whole.select(cols).union(edge.select(cols)).filter(F.col("n") >= min_count)
    return out.select("entity", "first_id", "last_id", F.col("n").alias("n_events"), F.col("t0").alias("start_us"), F.col("t1").alias("end_us"), (F.col("t1") - F.col("t0")).alias("duration_us"), F.col("x0").alias("first_value"), "low", "high")
