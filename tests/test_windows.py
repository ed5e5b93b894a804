"""Windows of time over dense series: results of plain loops, and costs that do not grow with the windows."""

import time

import numpy as np
import pytest

from siltstream import QC

LONG = "key string, t long, v double"


@pytest.fixture
def marked(spark):
    """A series of 40,000 rows with marks at every hundredth, on and off in turn, and the seconds a method takes."""

    def run(method):
        df = spark.range(40_000).selectExpr("'a' AS key", "id AS t", "1.0D AS v")
        marks = spark.range(400).selectExpr("'a' AS key", "id * 100 AS t", "CAST(id % 2 = 0 AS DOUBLE) AS value")
        qc = QC.from_long(df, "t", "v", "x", keys=["key"])
        began = time.perf_counter()
        rows = qc.flagManual("x", mdata=marks, method=method).fields["x"].df.filter("flag > 0").select("t").collect()
        return {r["t"] for r in rows}, time.perf_counter() - began

    return run


def test_closed_marks(marked):
    hits, took = marked("closed")  # took the square of the rows
    assert hits == {t for t in range(40_000) if t // 100 % 2 == 0 or t % 200 == 100}
    assert took < 20


def test_left_open_marks(marked):
    hits, took = marked("left-open")  # took the square of the rows
    assert hits == {t for t in range(1, 40_000) if (t - 1) // 100 % 2 == 0}
    assert took < 20


def test_right_open_marks(marked):
    hits, took = marked("right-open")  # took the square of the rows
    assert hits == {t for t in range(40_000) if t // 100 % 2 == 0}
    assert took < 20


def _series(spark, n=3_000, keys=("a", None), step=20_000_000):
    """Rows with ties, gaps and one infinite value for each key; with them (key, t, v) as lists by key."""
    r = np.random.default_rng(5)
    rows = []
    for k in keys:
        t = np.sort(r.integers(0, n * step, n) // step * step)
        v = [None if r.random() < 0.1 else float(x) for x in r.exponential(40, n)]
        rows += [(k, int(i), x) for i, x in zip(t, v, strict=True)]
    return rows, QC.from_long(spark.createDataFrame(rows, LONG), "t", "v", "x", keys=["key"])


def _plain(rows, low, high, func):
    """func of the values whose time is low .. high around each row's."""
    out = []
    for key in {k for k, _, _ in rows}:
        t = np.array([i for k, i, _ in rows if k == key])
        v = np.array([np.nan if x is None else x for k, _, x in rows if k == key])
        order = np.argsort(t, kind="stable")
        t, v = t[order], v[order]
        for i, now in enumerate(t):
            x = v[np.searchsorted(t, now + low) : np.searchsorted(t, now + high, side="right")]
            out.append((key, int(now), func(v[i], x[~np.isnan(x)])))
    return out


def _same(got, want):
    key = lambda r: (r[0] or "", r[1], -1.0 if r[2] is None or r[2] != r[2] else r[2])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    a, b = ([np.nan if r[2] is None else r[2] for r in x] for x in (got, want))
    np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)


def _dense(spark, n=30_000):
    return QC.from_long(spark.range(n).selectExpr("'a' AS key", "id AS t", "CAST(id * 7919 % 1009 AS DOUBLE) AS v"), "t", "v", "x", keys=["key"])


def _moment(x, k, least):
    import pandas as pd

    return getattr(pd.Series(x), k)() if len(x) >= least else np.nan


def _seconds(qc, name="x"):
    began = time.perf_counter()
    qc.fields[name].df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


_HALF = 30 * 60_000_000


@pytest.mark.parametrize("func", ["skew", "kurt", "var", "median"])
def test_rolling(spark, func):
    rows, qc = _series(spark)
    least = {"skew": 3, "kurt": 4, "var": 2, "median": 1}[func]
    out = qc.rolling("x", window="30min", func=func, center=False, min_periods=5).fields["x"].df.select("key", "t", "value").collect()
    _same(out, _plain(rows, -(_HALF - 1), 0, lambda _, x: _moment(x, func, max(least, 5))))


@pytest.mark.parametrize("func", ["skew", "kurt", "var", "median"])
def test_rolling_over_many_rows(spark, func):
    assert _seconds(_dense(spark).rolling("x", window="1h", func=func, center=False)) < 20  # took rows times the window's


def test_interpolate_by_rolling(spark):
    rows, qc = _series(spark)
    out = qc.interpolateByRolling("x", window="30min", center=False).fields["x"].df
    _same(out.select("key", "t", "value").collect(), _plain(rows, -(_HALF - 1), 0, lambda v, x: v if v == v else np.median(x) if len(x) else np.nan))
    assert _seconds(_dense(spark).interpolateByRolling("x", window="1h", center=False)) < 20  # took rows times the window's


def test_moments_keep_their_digits(spark):
    """Far from 0, where sums of powers would lose all digits."""
    rows, qc = _series(spark, keys=("a",))
    far = QC.from_long(qc.fields["x"].df.select("key", "t", (qc.fields["x"].df["value"] + 1e7).alias("v")), "t", "v", "x", keys=["key"])
    for func in ("skew", "kurt"):
        a, b = ({r["t"]: r["value"] for r in q.rolling("x", window="30min", func=func, min_periods=5).fields["x"].df.collect()} for q in (qc, far))
        assert a.keys() == b.keys()
        np.testing.assert_allclose([np.nan if v is None else v for v in a.values()], [np.nan if b[t] is None else b[t] for t in a], rtol=1e-5, atol=1e-5)


def test_median_of_infinite_values(spark):
    qc = QC.from_long(spark.createDataFrame([("a", i, v) for i, v in enumerate((1.0, float("inf"), 3.0, float("-inf"), None, 2.0))], LONG), "t", "v", "x", keys=["key"])
    out = qc.rolling("x", window="1h", func="median", center=False).fields["x"].df.orderBy("t").collect()
    assert [r["value"] for r in out] == [1.0, float("inf"), 3.0, 2.0, 2.0, 2.0]


@pytest.mark.parametrize("window", ["1h", 5])
def test_moments_without_spread(series, read, window):
    """Undefined, as in SQL."""
    for func in ("skew", "kurt"):
        assert read(series([7.0] * 6).rolling("x", window=window, func=func, center=False, min_periods=4)) == [None] * 6
        assert read(series([7.0] * 6).rolling("x", window=window, func="var", center=False, min_periods=4))[3:] == [0.0] * 3


def _jumpy(spark):
    """Levels that change at every 500th row, with gaps; 20 s a row."""
    r = np.random.default_rng(9)
    rows = []
    for k in ("a", None):
        level = np.repeat(r.uniform(0, 300, 6), 500)
        rows += [(k, i * 20_000_000, None if r.random() < 0.2 else float(level[i] + r.normal(0, 20))) for i in range(3_000)]
    return rows, QC.from_long(spark.createDataFrame(rows, LONG), "t", "v", "x", keys=["key"])


def _points(rows, func, thresh, w, least):
    """Times of the marks, and statistics, by plain loops."""
    marks, stats = set(), []
    for key in ("a", None):
        own = [(t, v) for k, t, v in rows if k == key]
        t, v = np.array([x for x, _ in own]), np.array([np.nan if x is None else x for _, x in own])
        stat = np.full(len(t), np.nan)
        for i, now in enumerate(t):
            back, fore = v[(t > now - w) & (t <= now)], v[(t > now) & (t <= now + w)]
            back, fore = back[~np.isnan(back)], fore[~np.isnan(fore)]
            if v[i] == v[i] and len(back) >= least and len(fore) >= least:
                stat[i] = abs(func(back) - func(fore))
        stats += [(key, int(x), y) for x, y in zip(t, stat, strict=True)]
        found = np.flatnonzero(stat > thresh)
        mark = np.zeros(len(t), bool)
        for i in found:
            near = found[np.abs(t[found] - t[i]) <= w]
            mark[near] = False
            mark[near[np.argmax(stat[near])]] = True
        known = np.flatnonzero(v == v)
        marks |= {(key, int(t[b])) for a, b in zip(known, known[1:], strict=False) if mark[a]}
    return marks, stats


def _marks_of(qc):
    return {(r["key"], r["t"]) for r in qc.fields["x"].df.filter("flag > 0").collect()}


def test_change_points_by_median(spark):
    rows, qc = _jumpy(spark)
    call = {"stat_func": "median", "thresh_func": 30, "window": "20min", "min_periods": 3}
    marks, _ = _points(rows, np.median, 30, 20 * 60_000_000, 3)
    assert len(marks) >= 5 and _marks_of(qc.flagChangePoints("x", **call)) == marks
    assert _marks_of(qc.flagChangePoints("x", **call | {"stat_func": lambda p, q: abs(np.median(p) - np.median(q)), "reduce_func": np.argmax})) == marks
    assert _seconds(_dense(spark).flagChangePoints("x", **call | {"window": "1h"})) < 20  # took rows times the window's


def test_jumps(spark):
    rows, qc = _jumpy(spark)
    marks, _ = _points(rows, np.mean, 30, 20 * 60_000_000, 3)
    assert len(marks) >= 5 and _marks_of(qc.flagJumps("x", thresh=30, window="20min", min_periods=3)) == marks
    qc.split = None  # stretches change nothing
    assert _marks_of(qc.flagJumps("x", thresh=30, window="20min", min_periods=3)) == marks
    assert _seconds(_dense(spark).flagJumps("x", thresh=30, window="1h", min_periods=3)) < 20  # took rows times the window's


def test_stretches_spread_over_tasks(spark):
    """of the stretches of a series several fell to one task, which took most of the time."""
    from pyspark.sql import functions as F

    from siltstream.frame import Series
    from siltstream.operators.vector import scan
    from siltstream.plans.halo import near

    day = 86_400_000_000
    df = spark.range(8 * 8 * 24).selectExpr("IF(id % 2 = 0, 'a', NULL) AS key", f"id * {day // 24} AS t", "1D AS value")
    out = near(Series(df, ("key",)), day, "90D", lambda s: scan(s, lambda t, starts, c: {"n": t * 0.0}, {"n": "double"})).df
    rows = out.select("key", "t", F.spark_partition_id().alias("task")).collect()
    assert len({(r["key"], r["t"]) for r in rows}) == len(rows) == 8 * 8 * 24
    for key in ("a", None):
        stretches = {(r["t"] // (8 * day), r["task"]) for r in rows if r["key"] == key}
        assert len(stretches) == len({task for _, task in stretches}) == 8


def test_jumps_statistic(spark):
    from siltstream.frame import Series
    from siltstream.operators.changepoints import marked as points

    rows, qc = _jumpy(spark)
    _, stats = _points(rows, np.mean, 30, 20 * 60_000_000, 3)
    _same(points(Series(qc.fields["x"].df, ("key",)), "mean", 30, "20min", 3).df.select("key", "t", "stat").collect(), stats)
    began = time.perf_counter()
    # a time of several rows: F8, rows after a point were repeated, other than in SQL; and it took rows times the window's
    many = spark.range(60_000).selectExpr("'a' AS key", "id div 2 AS t", "IF(id < 30000, 0D, 100D) AS value")
    assert points(Series(many, ("key",)), "mean", 30, "10ms", 3).df.count() == 60_000
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("window, reach", [("20min", 60), (("10min", "30min"), 70)])
def test_reach_of_change_points(spark, monkeypatch, window, reach):
    """Stretches of twice the reach give what the whole series does."""
    from siltstream.frame import Series
    from siltstream.operators import changepoints
    from siltstream.plans.halo import bounded

    _, qc = _jumpy(spark)
    seen = []

    def near(s, reach, split, fn):
        seen.append(reach)
        return bounded(s, reach, 2 * reach, fn) if split else fn(s)

    monkeypatch.setattr(changepoints, "near", near)
    out = []
    for split in ("90D", None):
        df = changepoints.marked(Series(qc.fields["x"].df, ("key",)), "mean", 30, window, 3, split=split).df
        out.append(sorted(((r["key"] or "", r["t"], r["cp"], r["times"], None if r["stat"] is None else round(r["stat"], 9)) for r in df.collect()), key=str))
    assert out[0] == out[1] and sum(r[2] for r in out[0]) >= 5
    assert set(seen) == {reach * 60_000_000}  # F8: stretches had a third more copies


@pytest.mark.parametrize("order", [0, 1, 2])
def test_polynomial_residuals(spark, order):
    rows, qc = _series(spark, n=1_500)

    def plain(rows):
        out = []
        for key in ("a", None):
            t, v = np.array([i for k, i, _ in rows if k == key]), np.array([np.nan if x is None else x for k, _, x in rows if k == key])
            for i, now in enumerate(t):
                near = (np.abs(t - now) <= _HALF) & ~np.isnan(v)
                fit = np.nan
                if v[i] == v[i] and near.sum() >= 5 and len(set(t[near])) > order:
                    fit = np.linalg.lstsq(np.vander((t[near] - now) / _HALF, order + 1), v[near], rcond=None)[0][-1]
                out.append((key, int(now), v[i] - fit))
        return out

    _same(qc.calculatePolynomialResiduals("x", window="1h", order=order, min_periods=5).fields["x"].df.select("key", "t", "value").collect(), plain(rows))
    assert _seconds(_dense(spark).calculatePolynomialResiduals("x", window="1h", order=order)) < 20  # took rows times the window's


def test_constants(spark):
    r = np.random.default_rng(3)
    rows = [(k, int(i) * 20_000_000, None if r.random() < 0.1 else float(x)) for k in ("a", None) for i, x in enumerate(np.repeat(r.integers(0, 9, 150), r.integers(1, 60, 150)))]
    qc = QC.from_long(spark.createDataFrame(rows, LONG), "t", "v", "x", keys=["key"])
    w, want = 10 * 60_000_000, set()
    for key in ("a", None):
        t, v = np.array([i for k, i, _ in rows if k == key]), np.array([np.nan if x is None else x for k, _, x in rows if k == key])
        for now in t[t - t[0] >= w - 1]:
            own = (t > now - w) & (t <= now) & ~np.isnan(v)
            if own.sum() >= 2 and np.ptp(v[own]) <= 1:
                want |= {(key, int(i)) for i in t[own]}
    assert want and _marks_of(qc.flagConstants("x", thresh=1, window="10min")) == want
    assert _seconds(_dense(spark).flagConstants("x", thresh=1, window="1h")) < 20  # took rows times the window's


@pytest.mark.parametrize("n", [1, 31, 32, 33, 500, 3_000])
def test_a_window_is_few_nodes(n):
    """Each row of each window once, and at most three nodes for a window of several pieces."""
    from siltstream.kernels import windows

    r = np.random.default_rng(n)
    a = np.sort(r.integers(0, n, n))
    for b in (np.minimum(a + r.integers(0, 9, n), n), np.minimum(a + n // 2, n), np.full(n, n)):
        rows, taken = np.zeros(n), np.zeros(n, int)

        def take(i, nodes, rows=rows, taken=taken):
            rows[i] += nodes[0]
            taken[i] += 1

        x = 2.0 ** (np.arange(n) % 16)
        windows._fold(a, b, [x], lambda p, q: [p[0] + q[0]], take)
        total = np.concatenate(([0.0], np.cumsum(x)))
        assert (rows == total[b] - total[a]).all()
        assert (taken[b - a > 64] <= 3).all()  # two nodes for each level of the tree


@pytest.mark.parametrize("name", ["kurt", "skew", "var"])
def test_windows_without_spread_are_found_at_once(monkeypatch, name):
    from siltstream.kernels import windows

    def never(*_):
        raise AssertionError("F12: looked for the least and the greatest of each window")

    monkeypatch.setattr(windows, "extreme", never)
    nan, inf = np.nan, np.inf
    x = np.array([0.1, 0.1, nan, 0.1, 0.1, 0.1, 5.0, 5.0, 5.0, 5.0, 5.0, inf, inf, nan, nan])
    a, b = np.maximum(np.arange(len(x)) - 4, 0), np.arange(len(x)) + 1
    flat = [(v := x[i:j][~np.isnan(x[i:j])]).size > 0 and len(set(v)) == 1 for i, j in zip(a, b, strict=True)]
    assert windows._same(a, b, x).tolist() == flat
    out = windows.statistic(name, a, b, x)[:11]
    assert [i for i in range(5, 11) if (out[i] == 0 if name == "var" else np.isnan(out[i]))] == [i for i in range(5, 11) if flat[i]]


def test_rolling_takes_along_what_it_needs(spark, monkeypatch):
    from siltstream.operators import windowed

    seen, scan = [], windowed.scan
    monkeypatch.setattr(windowed, "scan", lambda s, *args: (seen.append(set(s.df.columns)), scan(s, *args))[1])
    rows = [("a", i * 60_000_000, float(i), 255.0 if i == 2 else None) for i in range(6)]
    qc = QC.from_long(spark.createDataFrame(rows, LONG + ", f double"), "t", "v", "x", keys=["key"], flag="f")
    out = qc.rolling("x", window="3min", func="median", center=False).fields["x"].df.orderBy("t").collect()
    assert [r["value"] for r in out] == [0.0, 0.5, 0.5, 2.0, 3.5, 4.0]
    assert [r["flag"] for r in out] == [None, None, 255.0, 255.0, 255.0, None]
    assert seen and all(not c & {"raw", "masked"} for c in seen)  # values went through Python twice
