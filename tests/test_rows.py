"""Rows survive every operator (ties, null keys, fields of different times), and values that the semantics fix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstream import QC
from siltstream.kernels.numeric import interpolate
from siltstream.operators.grid import climatologicalMean, trueDailyMean
from siltstream.operators.outliers import _corruption_cutoff

LONG = "key string, t long, v double"
_MIN, _H, _D = 60_000_000, 3_600_000_000, 86_400_000_000


def test_ties_and_null_keys(spark):
    x = [5.0] * 40 + [50.0] + [5.0] * 40
    rows = [(k, i * _MIN, v) for k in ("a", None) for i, v in enumerate(x)] + [("a", 7 * _MIN, 5.0), ("a", 7 * _MIN, 5.0)]
    qc = QC.from_long(spark.createDataFrame(rows, LONG), "t", "v", "x", keys=["key"])
    for call in (
        lambda: qc.flagOffset("x", window="5min", thresh=10, tolerance=1), lambda: qc.flagUniLOF("x", n=5), lambda: qc.flagByGrubbs("x", window="1D"),
        lambda: qc.flagRange("x", max=10).flagGeneric("x", func="x > 1"), lambda: qc.fitLowpassFilter("x", cutoff=0.1), lambda: qc.flagZScore("x", thresh=3),
    ):
        assert call().fields["x"].df.count() >= len(rows)
    out = qc.flagByGrubbs("x", window="1D").fields["x"].df
    assert out.count() == len(rows) and out.filter("flag > 0").count() == 2  # one for each key, null among them
    assert qc.copyField("x", target="y").processGeneric(["x", "y"], target="z", func="x + y").fields["z"].df.filter("key is null").count() == len(x)
    # histories come through Python as they were
    hist = QC.from_long(spark.createDataFrame(rows[:81], LONG), "t", "v", "x", keys=["key"]).flagRange("x", max=10).flagUniLOF("x", n=5).fields["x"].df
    assert hist.filter(F.exists("hist", F.isnan)).count() == 0 and hist.filter(F.get("hist", F.lit(0)) > 0).count() == 1


def test_duplicates(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0), ("a", 2, 4.0)], LONG)
    assert QC.from_long(df, "t", "v", "x", keys=["key"]).fields["x"].df.count() == 3
    assert [r["value"] for r in QC.from_long(df, "t", "v", "x", keys=["key"], duplicates="first").fields["x"].df.orderBy("t").collect()] == [2.0, 4.0]
    with pytest.raises(Exception, match="two rows of one key"):
        QC.from_long(df, "t", "v", "x", keys=["key"], duplicates="raise").fields["x"].df.count()
    with pytest.raises(ValueError):
        QC.from_long(df, "t", "v", "x", duplicates="maybe")


def test_misaligned_fields_are_an_error(spark):
    a = spark.createDataFrame([("a", i, 1.0) for i in range(10)], LONG)
    b = spark.createDataFrame([("a", i, 1.0) for i in range(5, 15)], LONG)
    qc = QC.from_long(a, "t", "v", "x", keys=["key"]).merge(QC.from_long(b, "t", "v", "y", keys=["key"]))
    with pytest.raises(Exception, match="different times"):
        qc.processGeneric(["x", "y"], target="z", func="x + y").fields["z"].df.count()


def test_daily_means(spark):
    """Two days of ten-minute values 0, 1, ..: with 06:30 of the first and rows 150..153 missing."""
    rows = [("a", i * 10 * _MIN, None if i == 39 or 150 <= i < 154 else float(i)) for i in range(288)]
    df = spark.createDataFrame(rows, "key string, t long, value double")
    assert {r["day"]: r["value"] for r in climatologicalMean(df, ("key",)).collect()} == {0: None, 1: 312.0}
    assert {r["day"]: r["value"] for r in trueDailyMean(df, ("key",)).collect()} == {0: 71.0, 1: 212.0, 2: None}
    qc = QC.from_long(df, "t", "value", "x", keys=["key"])
    assert [r["value"] for r in qc.resample("x", freq="1D", func="climatologicalMean").fields["x"].df.orderBy("t").collect()] == [None, 312.0, None]
    with pytest.raises(ValueError):
        qc.resample("x", freq="1h", func="trueDailyMean")


@pytest.mark.parametrize(
    ("method", "tolerance", "expected"),
    # sources at 0, 10, 20 and 30 minutes, five stamps every four and a half minutes: which stamp each source goes to
    [("bshift", "270s", [0, 2, 4, None]), ("bshift", "20min", [0, 2, 4, None]), ("fshift", "1min", [0, None, None, None]), ("nagg", "1min", [0, 2, None, None]), ("bagg", "30min", [0, 2, 4, 4])],
)
def test_groups_of_reindex(spark, method, tolerance, expected):
    src = QC.from_long(spark.createDataFrame([("a", i * 10 * _MIN, 10.0**i) for i in range(4)], LONG), "t", "v", "x", keys=["key"])
    stamps = QC.from_long(spark.createDataFrame([("a", i * 270_000_000, 0.0) for i in range(5)], LONG), "t", "v", "k", keys=["key"])
    out = src.merge(stamps).reindex("x", index="k", method=method, tolerance=tolerance, data_aggregation="sum", broadcast=False).fields["x"].df.orderBy("t").collect()
    got = [r["value"] for r in out]
    if method.endswith("agg"):
        want = [None] * 5
        for i, g in enumerate(expected):
            if g is not None:
                want[g] = (want[g] or 0) + 10.0**i
        assert got == want
    else:
        assert all(got[g] == 10.0**i for i, g in enumerate(expected) if g is not None and expected.index(g) == i and (method == "fshift" or g != 4))


def test_broadcast_fills_finer_stamps(spark):
    qc = QC.from_long(spark.createDataFrame([("a", i * _H, float(i)) for i in range(4)], LONG), "t", "v", "x", keys=["key"])
    run = lambda **kw: [r["value"] for r in qc.reindex("x", index="20min", method="bagg", tolerance="1h", data_aggregation="mean", **kw).fields["x"].df.orderBy("t").collect()]
    assert run() == [0.0, 1.0, 1.0, 1.0, 2.0, 2.0, 2.0, 3.0, 3.0, 3.0]
    assert run(broadcast=False) == [0.0, None, None, 1.0, None, None, 2.0, None, None, 3.0]


def test_expressions(series, read):
    qc = series([1, 2, 4, 8, None, None, 100])
    x = np.array([1, 2, 4, 8, 100.0])
    mad = np.median(np.abs(x - np.median(x)))
    assert read(qc.processGeneric("x", target="y", func="mad(x)"), "y")[0] == mad
    assert read(qc.processGeneric("x", target="y", func="madScore(x)"), "y")[6] == pytest.approx((100 - np.median(x)) / mad)
    for text, n in (("isValid(x, max_nan_consec=2)", 7), ("isValid(x, max_nan_consec=1)", 0), ("isValid(x, max_nan_total=1)", 0), ("isValid(x, max_nan_total=2)", 7)):
        assert len(read.hits(qc.flagGeneric("x", func=text))) == n
    assert read(qc.processGeneric("x", target="y", func="meanQC(x, max_nan_total=1)"), "y") == [None] * 7
    assert read(qc.processGeneric("x", target="y", func="scale(x, target_range=(10, 20))"), "y")[:1] == [10.0]


def test_interpolation_methods():
    t, x = np.array([0, 1, 2, 5, 9]), np.array([0.0, np.nan, 4.0, np.nan, 8.0])
    assert interpolate(t, x, "linear").tolist() == [0, 2, 4, 6, 8] and interpolate(t, x, "time")[3] == pytest.approx(4 + 4 * 3 / 7)
    assert interpolate(t, x, "nearest").tolist() == [0, 0, 4, 4, 8] and interpolate(t, x, "zero").tolist() == [0, 0, 4, 4, 8]
    with pytest.raises(ValueError):
        interpolate(t, x, "akima-ish")


def test_corruption_cutoff():
    rng = np.random.default_rng(0)
    score = -np.concatenate([rng.uniform(0, 0.2, 95), [0.95, 0.951, 0.952, 0.953, 0.954]])
    cut = _corruption_cutoff(score, 20)
    assert (score <= cut).sum() in (4, 5) and -1.0 < cut < -0.5
    assert _corruption_cutoff(-np.linspace(0, 0.1, 3), 4) >= -1.0 and _corruption_cutoff(np.full(5, -0.3), 4) == -1.0


def test_joint_outliers(spark):
    rng = np.random.default_rng(2)
    n = 200
    a, b = rng.normal(0, 1, n), rng.normal(0, 1, n)
    a[100] = 30.0
    make = lambda name, v: QC.from_long(spark.createDataFrame([("k", i * _H, float(z)) for i, z in enumerate(v)], LONG), "t", "v", name, keys=["key"])
    qc = make("a", a).merge(make("b", b))
    hits = lambda q, f: [r["t"] // _H for r in q.fields[f].df.filter("flag > 0").orderBy("t").collect()]
    every = qc.flagMVScores(["a", "b"], n=5)
    assert hits(every, "a") == hits(every, "b") and 100 in hits(every, "a")
    blamed = qc.flagMVScores(["a", "b"], n=5, stray_range="2D")
    assert 100 in hits(blamed, "a") and 100 not in hits(blamed, "b")
    with pytest.raises(TypeError):
        qc.flagMVScores(["a", "b"], no_such_argument=7)


def test_callable_metrics_and_periods(spark):
    make = lambda name, v: QC.from_long(spark.createDataFrame([("k", i * _H, float(z)) for i, z in enumerate(v)], LONG), "t", "v", name, keys=["key"])
    base = np.sin(np.arange(48) / 4)
    qc = make("a", base).merge(make("b", base + 0.1), make("c", base + 5))
    out = qc.flagDriftFromNorm(["a", "b", "c"], window="1D", spread=1.0, metric=lambda x, y: float(np.abs(x - y).max()))
    assert [out.fields[f].df.filter("flag > 0").count() for f in "abc"] == [0, 0, 48]
    low = qc.fitLowpassFilter("a", cutoff="6h", target="s").fields["s"].df.orderBy("t").collect()
    same = qc.fitLowpassFilter("a", cutoff=1 / 6, target="s").fields["s"].df.orderBy("t").collect()
    assert [r["value"] for r in low] == pytest.approx([r["value"] for r in same])
