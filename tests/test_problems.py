"""Imputation, implausible readings and regular series: small cases, brute force, and awkward input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstream.operators.imputation import chained_imputation
from siltstream.operators.regular import regular_series
from siltstream.operators.spikes import histogram, implausible, quantile, residuals, tails
from siltstream.plans.cells import number, word

LONG = "field string, source string, id long, t long, x double"


def test_missing_cells(spark):
    v = spark.createDataFrame([(None,), (float("nan"),), (-9999.0,), (101.0,), (101.5,), (100.0,), (-0.5,), (float("inf"),)], "v double")
    assert [r[0] for r in v.select(number(F.col("v"))).collect()] == [None, None, None, None, 101.5, 100.0, -0.5, None]
    w = spark.createDataFrame([(" Silty_Clay ",), ("SILTY - clay",), (None,)], "w string")
    assert [r[0] for r in w.select(word(F.col("w"))).collect()] == ["silty clay", "silty clay", None]


def _readings(rng, n=400, source="s", start=0):
    x = np.round(20 + rng.normal(0, 0.05, n), 4)
    x[rng.choice(n, 4, replace=False)] += 9
    a = int(rng.integers(10, n - 60))
    x[a : a + 30] = x[a]
    return [("f", source, start + i, i * 60_000_000, float(v)) for i, v in enumerate(x)]


def _brute(rows, half=6):
    """Kinds by the definition, one source at a time."""
    out = {}
    for src in {r[1] for r in rows}:
        own = sorted({r for r in rows if r[1] == src}, key=lambda r: (r[3], r[2]))
        x = np.array([r[4] for r in own])
        d = np.array([abs(x[i] - np.median(x[max(0, i - half) : i + half + 1])) for i in range(len(x))])
        cut = np.concatenate([[True], np.abs(np.diff(x)) > 0.001 + 1e-9])
        of = np.cumsum(cut) - 1
        n = np.bincount(of)
        q = max(np.quantile(d, 0.9), 0.15)
        for i, r in enumerate(own):
            if not 0 <= x[i] <= 100:
                out[r[2]] = "impossible"
            elif n[of[i]] >= 16 and n[of[i]] >= 8 * np.median(n):
                out[r[2]] = "stuck"
            elif d[i] > 8 * q + 1e-9:
                out[r[2]] = "spike"
    return out


def test_implausible_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [r for k in range(5) for r in _readings(rng, 300 + 50 * k, f"s{k}", 10_000 * k)]
    rows[7] = (*rows[7][:4], 120.5)
    rows += rows[40:60]  # copies
    df = spark.createDataFrame(rows, LONG).repartition(7)
    got = {r["id"]: r["kind"] for r in implausible(df, confirm=8.0).collect()}
    assert got == _brute(rows)


def test_edges_of_blocks(spark):
    """Tiny blocks: every window and stretch crosses some."""
    rows = _readings(np.random.default_rng(5), 200)
    found, stretches, lengths, parts = residuals(spark.createDataFrame(rows, LONG), block_rows=17)
    d = {r["id"]: abs(r["r"]) for r in found.collect()}
    x = np.array([r[4] for r in rows])
    assert len(d) == len(x)
    for i in range(len(x)):
        assert d[i] == pytest.approx(abs(x[i] - np.median(x[max(0, i - 6) : i + 7])))
    want = np.diff(np.flatnonzero(np.append(np.insert(np.abs(np.diff(x)) > 0.001 + 1e-9, 0, True), True)))
    assert sorted(n for r in lengths.collect() for n in [r["n"]] * r["times"]) == sorted(want)
    whole = {r["piece"]: r["stretch"] for r in stretches.collect()}
    of = {r["id"]: whole[r["piece"]] if r["piece"] >= 0 else r["n"] for r in found.collect()}
    assert [of[i] for i in range(len(x))] == list(np.repeat(want, want))
    assert parts.count() == found.select("part").distinct().count()


def _parted(spark, d):
    rows = [("f", "s", i % 3, i, i * 97_000_000, float(v)) for i, v in enumerate(d)]
    return spark.createDataFrame(rows, "field string, source string, part long, id long, t long, r double")


def test_tail_fit(spark):
    rng = np.random.default_rng(0)
    d = rng.exponential(1.0, 100_000) * rng.choice([-1, 1], 100_000)
    r = tails(histogram(_parted(spark, d)), risk=1e-3).first()
    assert abs(r["shape"]) < 0.15 and r["cutoff"] == pytest.approx(-np.log(1e-3), rel=0.15)
    # spikes, however large, do not move the cutoff much; the risk does
    d[:1500] *= 1000
    bent = tails(histogram(_parted(spark, d)), risk=1e-3).first()
    assert bent["cutoff"] < 2.5 * r["cutoff"]
    assert tails(histogram(_parted(spark, d)), risk=1e-5).first()["cutoff"] > 1.3 * bent["cutoff"]


def test_tail_decides(spark):
    """Without a check the rows follow from the risk; a seasonal residual is no spike."""
    rng = np.random.default_rng(1)
    x = 20 + rng.normal(0, 0.3, 5000)
    x[rng.choice(5000, 40, replace=False)] += 15
    df = spark.createDataFrame([("f", "s", i, i * 600_000_000, float(v)) for i, v in enumerate(x)], LONG)
    n = [implausible(df, risk=k).count() for k in (0.05, 1e-2, 1e-4)]
    assert n[0] > n[1] > n[2] >= 40
    # a jump of 2 for one reading every day at noon is usual there (the term is winsorised at the floor)
    daily = 20 + rng.normal(0, 0.01, 5000) + np.where(np.arange(5000) % 24 == 12, 2.0, 0.0)
    df = spark.createDataFrame([("f", "s", i, i * 3_600_000_000, float(v)) for i, v in enumerate(daily)], LONG)
    season = tails(histogram(residuals(df)[0], cells=8, floor=3.0), floor=0.01).first()["season"]
    assert season[4] == pytest.approx(2 / 3, abs=0.05) and abs(season[0]) < 0.01


def test_exact_quantile(spark):
    rng = np.random.default_rng(4)
    for d in (rng.normal(0, 1, 3000), np.zeros(50), np.round(rng.normal(0, 1, 500), 1), np.array([3.0])):
        rows = _parted(spark, d)
        got = quantile(rows, histogram(rows), rows.select("field", "source", "part").distinct(), 0.9).first()["level_d"]
        assert got == pytest.approx(np.quantile(np.abs(d), 0.9), abs=1e-12)


def test_spikes_awkward_input(spark):
    assert implausible(spark.createDataFrame([], LONG)).collect() == []
    rows = [("f", None, 1, 0, 1.0), ("f", "s", 2, None, 1.0), ("f", "s", 3, 5, None), ("f", "one", 4, 0, 5.0), ("f", "odd", 5, 0, -3.5), ("f", "odd", 5, 0, -3.5)]
    assert [(r["id"], r["kind"]) for r in implausible(spark.createDataFrame(rows, LONG)).collect()] == [(5, "impossible")]


def test_counter_shares(spark):
    # 0..10 over half an hour from 00:00, then a reset and 4 more by 01:00
    rows = [("s", 1, 0, 0.0), ("s", 2, 1800, 10.0), ("s", 3, 3600, 4.0), ("s", 3, 3600, 4.0)]
    df = spark.createDataFrame([(a, b, c * 1_000_000, d) for a, b, c, d in rows], "source string, id long, t long, x double")
    got = {r["slot_epoch_s"]: (round(r["value"], 6), r["status"]) for r in regular_series(df, 900, kind="counter").collect()}
    assert got == {0: (2.5, "measured"), 900: (5.0, "filled"), 1800: (3.5, "measured"), 2700: (2.0, "filled"), 3600: (1.0, "measured")}


def test_series_cells(spark):
    rng = np.random.default_rng(2)
    t = np.sort(rng.choice(400_000, 150, replace=False))
    t[75:] += 6 * 86400  # a silence longer than five days
    df = spark.createDataFrame([("s", i, int(x) * 1_000_000, float(i)) for i, x in enumerate(t)], "source string, id long, t long, x double").repartition(5)
    got = {r["slot_epoch_s"]: r["status"] for r in regular_series(df).collect()}
    want = {}
    for slot in range(int((t[0] + 450) // 900 * 900), int((t[-1] + 450) // 900 * 900) + 1, 900):
        if ((t >= slot - 450) & (t < slot + 450)).any():
            want[slot] = "measured"
        else:
            i = np.searchsorted(t, slot)
            want[slot] = "uncovered" if t[i] - t[i - 1] > 5 * 86400 else "filled"
    assert got == want
    small = {r["slot_epoch_s"]: (r["status"], round(r["value"] or 0, 6)) for r in regular_series(df, block_rows=9).collect()}
    assert small == {r["slot_epoch_s"]: (r["status"], round(r["value"] or 0, 6)) for r in regular_series(df).collect()}
    assert regular_series(df.limit(0)).collect() == []


def _table(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    words = ["sand", "clay", "peat"]
    rows = []
    for i in range(n):
        s = i % 6
        v = 10.0 + 5 * s + np.sin(i / 40)
        rows.append((i, f"S{s}", i * 600_000_000, float(v) if rng.random() > 0.1 else [None, float("nan"), -9999.0][i % 3], words[s % 3] if rng.random() > 0.1 else [None, "n/a", ""][i % 3], float(v)))
    rows += rows[:5]
    return spark.createDataFrame(rows, "rid long, st string, ts long, v double, c string, truth double")


def test_imputation_fills_well(spark):
    df = _table(spark)
    out = chained_imputation(df.drop("truth"), "rid", "st", "ts", {"v": number}, {"c": ["sand", "clay", "peat"]}).toPandas()
    truth = df.dropDuplicates(["rid"]).toPandas().set_index("rid")
    assert len(out) == 600 and not out[["v", "c"]].isna().any().any()
    out = out.set_index("rid")
    own = truth["v"].map(lambda v: not (v == v and v >= 0))
    assert (out["v_filled"] == own.reindex(out.index)).all()
    err = (out["v"] - truth["truth"].reindex(out.index))[out["v_filled"]]
    assert np.sqrt((err**2).mean()) < 0.5  # the stations differ by 25
    want = truth.index.to_series().mod(6).mod(3).map(dict(enumerate(["sand", "clay", "peat"]))).reindex(out.index)
    assert (out["c"] == want)[out["c_filled"]].mean() > 0.9
    again = chained_imputation(df.drop("truth").repartition(5), "rid", "st", "ts", {"v": number}, {"c": ["sand", "clay", "peat"]}).toPandas().set_index("rid")
    assert np.allclose(again["v"].reindex(out.index), out["v"], atol=1e-6)


def test_imputation_awkward_input(spark):
    df = spark.createDataFrame([(1, None, None, None, None), (2, "a", 5, None, "SAND")], "rid long, st string, ts long, v double, c string").withColumn("__hour", F.lit(1))
    out = chained_imputation(df, "rid", "st", "ts", {"v": number}, {"c": ["sand"]}).toPandas().set_index("rid")
    assert out.loc[1, "v"] == 0.0 and out.loc[1, "c"] == "sand" and out.loc[1, "c_filled"] and not out.loc[2, "c_filled"]
    assert chained_imputation(df.limit(0), "rid", "st", "ts", {"v": number}, {"c": ["sand"]}).count() == 0
