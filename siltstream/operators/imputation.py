"""Filling missing cells by chained equations.

Every incomplete field is modelled from the others: a numeric field by ridge regression, a
word field by a naive Bayes classifier, in turn and repeatedly, each fit using the other
fields' current fills. Fills keep the residual variation: a numeric fill adds a normal draw
of the regression's residual spread, a word is drawn from its posterior. Draws come from a
hash of the row's id, so a rerun gives the same values.

Both models are fitted from sums that add up over rows (products of features, counts of
feature and class), so a fit is one distributed pass that returns one small matrix a task.
Values far from the line between
their neighbours, and outside the bounds, are kept but enter no fit. Complete rows enter those sums once. The repeated passes read only rows with a missing cell,
which the stage table keeps in files of their own, and recompute their fills from the models so
far; no fill is ever stored between passes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cells import number, word
from ..plans.ordered import micros
from ..plans.scratch import stage

#: Ridge weight on standardised features.
_RIDGE = 1.0
_DAY = 86_400_000_000


@dataclass(frozen=True)
class _Plan:
    numeric: tuple[str, ...]
    words: tuple[str, ...]
    vocab: dict[str, tuple[str, ...]]
    centre: dict[str, float]
    scale: dict[str, float]
    rounds: int
    expected: bool = False
    trim: dict[str, float] = field(default_factory=dict)  # farthest from the line between its neighbours that a value may be to enter a fit
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    models: dict = field(default_factory=dict)  # (round, field) -> coefficients, spread | log tables


def _hash01(ids: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in (0, 1) from ids (splitmix64)."""
    z = ids.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2**-54


def _base(pdf: pd.DataFrame, c: str, plan: _Plan) -> np.ndarray:
    """What time and group say of a numeric field: between the neighbours in time, else the group's mean, else the overall one."""
    before, after = pdf[f"{c}__before"].to_numpy(float), pdf[f"{c}__after"].to_numpy(float)
    a, b = pdf[f"{c}__t_before"].to_numpy(float), pdf[f"{c}__t_after"].to_numpy(float)
    share = np.clip(np.divide(a, a + b, out=np.full(len(a), 0.5), where=(a + b) > 0), 0, 1)
    out = np.where(np.isnan(before), after, np.where(np.isnan(after), before, before + (after - before) * share))
    for other in (f"{c}__mean", f"{c}__network"):
        out = np.where(np.isnan(out), pdf[other].to_numpy(float), out)
    return np.where(np.isnan(out), plan.centre[c], out)


def _design(pdf: pd.DataFrame, target: str, now: dict[str, np.ndarray], plan: _Plan) -> np.ndarray:
    z = lambda c, v: (v - plan.centre[c]) / plan.scale[c]
    mean = pdf[f"{target}__mean"].to_numpy(float)
    base = _base(pdf, target, plan)
    turn = pdf["__hour"].to_numpy(float) * (2 * math.pi / 24)
    cols = [np.ones(len(pdf)), z(target, base), z(target, np.where(np.isnan(mean), base, mean)), np.sin(turn), np.cos(turn)]
    cols += [z(c, now[c]) for c in plan.numeric if c != target]
    for w in plan.words:
        cols += list((now[w][:, None] == np.arange(1, len(plan.vocab[w]))[None, :]).astype(float).T)
    return np.nan_to_num(np.stack(cols, axis=1))


def _features(pdf: pd.DataFrame, target: str, now: dict[str, np.ndarray], plan: _Plan) -> list[np.ndarray]:
    """Discrete features of a word field: the words before, after and most usual in its group, and the bins of the numeric fields."""
    n = len(plan.vocab[target])
    out = [np.where(np.isnan(v := pdf[f"{target}__{k}"].to_numpy(float)), n, v).astype(int) for k in ("before", "after", "mode")]
    for c in plan.numeric:
        out.append(np.clip(np.floor((now[c] - plan.centre[c]) / plan.scale[c] * 2) + 5, 0, 9).astype(int))
    return out


def _sizes(target: str, plan: _Plan) -> list[int]:
    return [len(plan.vocab[target]) + 1] * 3 + [10] * len(plan.numeric)


def _start(pdf: pd.DataFrame, plan: _Plan) -> dict[str, np.ndarray]:
    now: dict[str, np.ndarray] = {}
    for c in plan.numeric:
        v = pdf[c].to_numpy(float)
        now[c] = np.where(np.isnan(v), _base(pdf, c, plan), v)
    for w in plan.words:
        v = pdf[f"{w}__code"].to_numpy(float)
        for k in ("before", "after", "mode"):
            v = np.where(np.isnan(v), pdf[f"{w}__{k}"].to_numpy(float), v)
        now[w] = np.where(np.isnan(v), 0, v).astype(int)
    return now


def _predict(pdf: pd.DataFrame, c: str, model: tuple, now: dict[str, np.ndarray], plan: _Plan, turn: int) -> np.ndarray:
    ids = pdf["__row"].to_numpy(np.int64)
    if c in plan.numeric:
        beta, spread, low, high = model
        u, v = _hash01(ids, 2 * turn), _hash01(ids, 2 * turn + 1)
        mean = _design(pdf, c, now, plan) @ beta
        now[f"{c}__expected"] = np.clip(mean, low, high)
        drawn = mean + spread * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
        return np.where(np.isnan(x := pdf[c].to_numpy(float)), np.clip(drawn, low, high), x)
    prior, tables = model
    score = np.tile(prior, (len(pdf), 1))
    for f, table in zip(_features(pdf, c, now, plan), tables, strict=True):
        score += table[f]
    p = np.exp(score - score.max(axis=1, keepdims=True))
    p = np.cumsum(p / p.sum(axis=1, keepdims=True), axis=1)
    drawn = np.minimum((p < _hash01(ids, 1000 + turn)[:, None]).sum(axis=1), p.shape[1] - 1)
    return np.where(np.isnan(x := pdf[f"{c}__code"].to_numpy(float)), drawn, x).astype(int)


def _chain(pdf: pd.DataFrame, plan: _Plan) -> dict[str, np.ndarray]:
    """The fills after all models fitted so far."""
    now = _start(pdf, plan)
    for turn, ((_, c), model) in enumerate(plan.models.items()):
        now[c] = _predict(pdf, c, model, now, plan, turn)
    return now


def _sums(batches: Iterable[pd.DataFrame], fields: list[str], plan: _Plan) -> Iterator[pd.DataFrame]:
    """The addends of the fields' fits over one task's rows: field, position, value."""
    totals: dict[str, np.ndarray] = {}
    for pdf in batches:
        now = _chain(pdf, plan)
        for c in fields:
            if c in plan.numeric:
                x, y = _design(pdf, c, now, plan), pdf[c].to_numpy(float)
                low, high = plan.bounds.get(c, (-math.inf, math.inf))
                with np.errstate(invalid="ignore"):
                    seen = (np.abs(y - (x[:, 1] * plan.scale[c] + plan.centre[c])) <= plan.trim.get(c, math.inf)) & (y >= low) & (y <= high)
                x, y = x[seen], y[seen]
                one = np.concatenate([(x.T @ x).ravel(), x.T @ y, [y @ y, len(y), y.sum()]])
            else:
                seen = ~np.isnan(code := pdf[f"{c}__code"].to_numpy(float))
                k, code = len(plan.vocab[c]), code[seen].astype(int)
                counts = [np.bincount(f[seen] * k + code, minlength=s * k) for f, s in zip(_features(pdf, c, now, plan), _sizes(c, plan), strict=True)]
                one = np.concatenate([np.bincount(code, minlength=k), *counts]).astype(float)
            totals[c] = one if c not in totals else totals[c] + one
    for c, total in totals.items():
        yield pd.DataFrame({"field": c, "at": np.arange(len(total)), "v": total})


def _collect(df: DataFrame, fields: list[str], plan: _Plan) -> dict[str, np.ndarray]:
    """The sums over all rows: a fixed number of values, whatever the table's size."""
    rows = df.mapInPandas(partial(_sums, fields=fields, plan=plan), "field string, at long, v double").groupBy("field", "at").agg(F.sum("v").alias("v")).collect()
    out = {c: np.zeros(sum(r["field"] == c for r in rows)) for c in fields}
    for r in rows:
        out[r["field"]][r["at"]] = r["v"]
    return out


def _trims(rows: DataFrame, numeric: list[str], level: float = 0.95) -> dict[str, float]:
    """For each numeric field how far ``level`` of its values are at most from the line between their neighbours, by logarithmic bins: faulty readings beyond that would bend a fit, and widen its residuals."""
    bins = []
    for c in numeric:
        a, b = F.col(f"{c}__t_before"), F.col(f"{c}__t_after")
        line = F.col(f"{c}__before") + (F.col(f"{c}__after") - F.col(f"{c}__before")) * F.coalesce(F.try_divide(a, a + b), F.lit(0.5))
        bins.append(F.struct(F.lit(c).alias("field"), F.ceil(F.log2(F.greatest(F.abs(F.col(c) - line), F.lit(1e-9))) * 4).alias("bin")))
    counts = rows.select(F.explode(F.array(*bins)).alias("b")).select("b.*").filter("bin is not null").groupBy("field", "bin").count().collect() if bins else []  # at most a few hundred rows
    out = {}
    for c in numeric:
        own = sorted((r["bin"], r["count"]) for r in counts if r["field"] == c)
        total, upto = sum(n for _, n in own), 0
        for b, n in own:
            upto += n
            if upto >= level * total:
                out[c] = 2 ** (b / 4)
                break
    return out


def _fit(sums: np.ndarray, c: str, plan: _Plan, bounds: tuple[float, float]) -> tuple:
    if c in plan.numeric:
        k = 5 + len(plan.numeric) - 1 + sum(len(plan.vocab[w]) - 1 for w in plan.words)
        if not len(sums):
            return np.array([plan.centre[c]] + [0.0] * (k - 1)), 0.0, *bounds
        xx, xy, (yy, n, _) = sums[: k * k].reshape(k, k), sums[k * k : k * k + k], sums[k * k + k :]
        beta = np.linalg.solve(xx + _RIDGE * np.diag([1e-9] + [1.0] * (k - 1)) + 1e-9 * np.eye(k), xy)
        rest = max(0.0, yy - 2 * beta @ xy + beta @ xx @ beta) / max(1.0, n - k)
        return beta, math.sqrt(rest), *bounds
    k = len(plan.vocab[c])
    sums = sums if len(sums) else np.zeros(k + k * sum(_sizes(c, plan)))
    prior, at, tables = sums[:k] + 1.0, k, []
    for s in _sizes(c, plan):
        counts = sums[at : at + s * k].reshape(s, k) + 0.5
        tables.append(np.log(counts / counts.sum(axis=0, keepdims=True)))
        at += s * k
    return np.log(prior / prior.sum()), tables


def _filled(batches: Iterable[pd.DataFrame], plan: _Plan, keep: list[str]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        now = _chain(pdf, plan)
        out = pdf[keep].copy()
        for c in plan.numeric:
            out[c] = now[c]
            out[f"{c}_filled"] = pdf[c].isna().to_numpy()
            if plan.expected:
                out[f"{c}_expected"] = np.where(out[f"{c}_filled"], now.get(f"{c}__expected", np.nan), now[c])
        for w in plan.words:
            out[w] = np.array(plan.vocab[w], dtype=object)[now[w]]
            out[f"{w}_filled"] = pdf[f"{w}__code"].isna().to_numpy()
        yield out


def chained_imputation(
    table: DataFrame, row_id: str, group: str, time: str, numeric: dict[str, Callable[[Column], Column]], words: dict[str, list[str]],
    networks: DataFrame | None = None, bounds: dict[str, tuple[float, float]] | None = None, rounds: int = 3, span_days: int = 7, expected: bool = False,
) -> DataFrame:
    """Every row of ``table`` once, with all its missing cells filled and marked.

    ``numeric``: field -> function that gives null where the cell is missing; ``words``: field ->
    valid words (at most 1,000); any other word counts as missing. ``networks``: group, network:
    where a group has no reading at all, its network's mean helps. Neighbours in time are sought
    in the row's own calendar cell of ``span_days`` and, where that has none, in the cells beside
    it; a group without a valid cell near takes its mean and most usual word over all time.
    Result: row_id, group, time, and for each field its value and ``<field>_filled``; with
    ``expected`` also ``<field>_expected``, the fill of a numeric field without its drawn residual.

    Copies (equal row_id, group and time) count once. Rows without group or time are filled from
    the overall models. A field without any valid cell gets its overall mean of 0, or its first
    word. An empty table gives an empty result. Other columns of ``table`` are not read.
    """
    vocab = {w: tuple(v) for w, v in words.items()}
    if any(not v or len(v) > 1000 for v in vocab.values()):
        raise ValueError("a vocabulary has 1 to 1,000 words")
    base = table.select(
        F.col(row_id).alias("__id"), F.col(group).cast("string").alias("__group"), micros(table, time).alias("__t"), F.col(time).alias("__time"),
        *(f(F.col(c)).cast("double").alias(c) for c, f in numeric.items()),
        *(F.nullif(F.array_position(F.array(*(word(F.lit(x)) for x in v)), word(F.col(w))).cast("double"), F.lit(0.0)).alias(f"{w}__pos") for w, v in vocab.items()),
    )
    base = base.select("*", *((F.col(f"{w}__pos") - 1).alias(f"{w}__code") for w in vocab)).drop(*(f"{w}__pos" for w in vocab))
    base = base.withColumn("__span", F.floor(F.col("__t") / F.lit(span_days * _DAY))).withColumn("__row", F.xxhash64("__id"))
    by = Window.partitionBy("__group", "__span").orderBy("__t", "__id")
    whole = Window.partitionBy("__group", "__span")
    back = Window.partitionBy("__group", "__span").orderBy(F.col("__t").desc(), F.col("__id").desc())
    # both frames grow row by row; a frame that shrinks towards its end would cost a square
    past, ahead = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (by, back))
    cols = [F.col("*"), (F.col("__t") / 3_600_000_000 % 24).alias("__hour"), (F.lag("__id").over(by) == F.col("__id")).alias("__copy")]
    for c in numeric:
        t = F.when(F.col(c).isNotNull(), F.col("__t"))
        cols += [F.last(c, True).over(past).alias(f"{c}__before"), F.last(c, True).over(ahead).alias(f"{c}__after"), F.avg(c).over(whole).alias(f"{c}__mean")]
        cols += [(F.col("__t") - F.last(t, True).over(past)).cast("double").alias(f"{c}__t_before"), (F.last(t, True).over(ahead) - F.col("__t")).cast("double").alias(f"{c}__t_after")]
    for w in vocab:
        code = F.col(f"{w}__code")
        cols += [F.last(code, True).over(past).alias(f"{w}__before"), F.last(code, True).over(ahead).alias(f"{w}__after"), F.mode(code).over(whole).alias(f"{w}__mode")]
    known = base.select(*cols).filter("__copy is not true")
    lone = reduce(Column.__or__, [F.col(c).isNull() for c in numeric] + [F.col(f"{w}__code").isNull() for w in vocab])
    rows = stage(known.drop("__copy").withColumn("__open", lone), "features", ["__open"])

    stats = rows.agg(*(f(c).alias(f"{c}_{k}") for c in numeric for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    plan = _Plan(tuple(numeric), tuple(vocab), vocab, {c: stats[f"{c}_m"] or 0.0 for c in numeric}, {c: stats[f"{c}_s"] or 1.0 for c in numeric}, rounds, expected, _trims(rows, list(numeric)), dict(bounds or {}))
    open_, closed = rows.filter("__open"), rows.filter("not __open")
    none = [F.lit(None).cast("double").alias(f"{c}__network") for c in numeric]
    closed = closed.select("*", *none)
    open_ = _with_group(_with_edges(open_, rows, list(numeric), list(vocab)), rows, networks, list(numeric), list(vocab))
    open_ = stage(open_, "open")  # read once in each pass
    limits = bounds or {}
    once = _collect(closed, [*numeric, *vocab], plan)
    for turn in range(rounds):
        for c in (*numeric, *vocab):
            more = _collect(open_, [c], plan)[c]
            sums = once[c] + more if len(once[c]) and len(more) else once[c] if len(once[c]) else more
            plan.models[(turn, c)] = _fit(sums, c, plan, limits.get(c, (-math.inf, math.inf)))
    keep = ["__id", "__group", "__time"]
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"`{k}` {kind[k]}" for k in keep] + [f"`{c}` double, `{c}_filled` boolean" + (f", `{c}_expected` double" if expected else "") for c in numeric] + [f"`{w}` string, `{w}_filled` boolean" for w in vocab])
    filled = open_.mapInPandas(partial(_filled, plan=plan, keep=keep), schema)
    name = [F.element_at(F.array(*(F.lit(x) for x in v)), (F.col(f"{w}__code") + 1).cast("int")).alias(w) for w, v in vocab.items()]
    untouched = closed.select(*keep, *(x for c in numeric for x in (F.col(c), F.lit(False).alias(f"{c}_filled"), *([F.col(c).alias(f"{c}_expected")] if expected else []))), *(x for w, col in zip(vocab, name, strict=True) for x in (col, F.lit(False).alias(f"{w}_filled"))))
    return untouched.union(filled).withColumnsRenamed({"__id": row_id, "__group": group, "__time": time})


def _with_edges(open_: DataFrame, rows: DataFrame, numeric: list[str], words: list[str]) -> DataFrame:
    """Neighbours from the calendar cells beside a row's own, for the rows that lack one in their own; those alone are joined."""
    values = {c: c for c in numeric} | {w: f"{w}__code" for w in words}
    lacks = reduce(Column.__or__, [F.col(f"{k}__before").isNull() | F.col(f"{k}__after").isNull() for k in values]) & F.col("__group").isNotNull()
    ends = []
    for k, v in values.items():
        t = F.when(F.col(v).isNotNull(), F.col("__t"))
        ends += [F.min_by(v, t).alias(f"{k}__first"), F.max_by(v, t).alias(f"{k}__last"), F.min(t).alias(f"{k}__first_t"), F.max(t).alias(f"{k}__last_t")]
    edges = rows.filter("__group is not null").groupBy("__group", "__span").agg(*ends)
    of = lambda side: [c for k in values for c in ((f"{k}__{side}", f"{k}__{side}_t"))]
    before = edges.select("__group", (F.col("__span") + 1).alias("__span"), *of("last"))
    after = edges.select("__group", (F.col("__span") - 1).alias("__span"), *of("first"))
    both = open_.filter(lacks).join(before, ["__group", "__span"], "left").join(after, ["__group", "__span"], "left")
    new = {}
    for k in values:
        new |= {f"{k}__before": F.coalesce(f"{k}__before", f"{k}__last"), f"{k}__after": F.coalesce(f"{k}__after", f"{k}__first")}
    for c in numeric:
        new[f"{c}__t_before"] = F.coalesce(f"{c}__t_before", (F.col("__t") - F.col(f"{c}__last_t")).cast("double"))
        new[f"{c}__t_after"] = F.coalesce(f"{c}__t_after", (F.col(f"{c}__first_t") - F.col("__t")).cast("double"))
    return open_.filter(~F.coalesce(lacks, F.lit(False))).unionByName(both.withColumns(new).select(open_.columns))


def _with_group(open_: DataFrame, rows: DataFrame, networks: DataFrame | None, numeric: list[str], words: list[str]) -> DataFrame:
    """The group's mean over all time, else its network's, and its most usual word, for rows whose group has none in their cell: those alone are joined."""
    names = [f"{c}__network" for c in numeric]
    bare = reduce(Column.__or__, [F.col(f"{c}__mean").isNull() for c in numeric] + [F.col(f"{w}__mode").isNull() for w in words]) & F.col("__group").isNotNull()
    by_group = rows.filter("__group is not null").groupBy("__group").agg(*(x for c in numeric for x in (F.sum(c).alias(f"{c}_s"), F.count(c).alias(f"{c}_n"))))
    joined = open_.filter(bare).join(by_group, "__group", "left")
    own = {n: F.try_divide(F.col(f"{c}_s"), F.col(f"{c}_n")) for c, n in zip(numeric, names, strict=True)}
    if networks is not None:
        nets = networks.select(F.col(networks.columns[0]).cast("string").alias("__group"), F.col(networks.columns[1]).alias("__network")).dropna().dropDuplicates(["__group"])
        by_net = by_group.join(nets, "__group").groupBy("__network").agg(*(F.try_divide(F.sum(f"{c}_s"), F.sum(f"{c}_n")).alias(f"{c}__net") for c in numeric))
        joined = joined.join(nets, "__group", "left").join(by_net, "__network", "left")
        own = {n: F.coalesce(v, F.col(f"{c}__net")) for (n, v), c in zip(own.items(), numeric, strict=True)}
    for w in words:
        usual = rows.filter(F.col(f"{w}__code").isNotNull() & F.col("__group").isNotNull()).groupBy("__group", f"{w}__code").agg(F.count("*").alias("n"))
        usual = usual.groupBy("__group").agg(F.max_by(f"{w}__code", F.struct("n", -F.col(f"{w}__code"))).alias(f"{w}__usual"))
        joined = joined.join(usual, "__group", "left")
        own[f"{w}__mode"] = F.coalesce(f"{w}__mode", f"{w}__usual")
    none = {n: F.lit(None).cast("double") for n in names}
    return open_.filter(~F.coalesce(bare, F.lit(False))).withColumns(none).unionByName(joined.withColumns(own).select(*open_.columns, *names)) if names or words else open_
