"""The engine: protocol, histories, schemes, operators on small series with known results."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstream import BAD, DOUBTFUL, FILTER_NONE, QC, UNFLAGGED, register
from siltstream.config import parse_test, read_json, read_text, run
from siltstream.flags import squeeze
from siltstream.registry import OPERATORS


def test_range_and_missing(series, read):
    qc = series([1, 5, None, 20, 7]).flagRange("x", min=2, max=10)
    assert read.hits(qc) == [0, 3]
    assert read.hits(qc.flagNaN("x")) == [0, 2, 3]


def test_flagged_values_are_hidden_and_come_back(series, read):
    qc = series([1, 50, 3], flags=[None, DOUBTFUL, None])
    assert read.hits(qc.flagRange("x", max=10)) == [1]
    assert read(qc.flagRange("x", max=10), col="flag")[1] == DOUBTFUL
    assert read(qc.flagRange("x", max=10, dfilter=BAD), col="flag")[1] == BAD
    assert read(qc.flagRange("x", max=10)) == [1, 50, 3]


def test_later_test_may_lower_a_flag(series, read):
    qc = series([1, 50]).flagRange("x", max=10).flagRange("x", max=10, flag=UNFLAGGED, dfilter=FILTER_NONE)
    assert read.hits(qc) == []
    assert [len(h) for h in read(qc, col="hist")] == [2, 2]


def test_history_is_one_element_a_call(series, read):
    qc = series([1, 2]).flagDummy("x").flagRange("x", max=1).clearFlags("x")
    assert read(qc, col="hist")[1] == [None, BAD, UNFLAGGED]
    assert [m["func"] for m in qc.fields["x"].meta] == ["flagDummy", "flagRange", "clearFlags"]


@pytest.mark.parametrize(("how", "want"), [("last", [25.0, -math.inf]), ("max", [255.0, -math.inf]), ("min", [25.0, -math.inf])])
def test_squeeze(spark, how, want):
    df = spark.createDataFrame([([255.0, None, 25.0],), ([],)], "h array<double>")
    assert [r[0] for r in df.select(squeeze(F.col("h"), how)).collect()] == want


def test_fields_targets_regex(series, read):
    qc = series([1, 99])
    qc = qc.copyField("x", target="x2")
    out = qc.flagRange("x", regex=True, max=10)
    assert read.hits(out, "x") == read.hits(out, "x2") == [1]
    out = qc.flagRange("x", target="y", max=10)
    assert read.hits(out, "x") == [] and read.hits(out, "y") == [1]
    with pytest.raises(ValueError):
        qc.flagRange(["x", "x2"], target="z", max=1)
    with pytest.raises(KeyError):
        qc.flagRange("none", max=1)
    with pytest.raises(ValueError):
        qc.copyField("x", target="x2")
    assert "x2" not in qc.dropField("x2") and "z" in qc.renameField("x2", new_name="z")


def test_dates_limit_a_test(series, read):
    qc = series([9] * 5, step_s=86400).flagRange("x", max=1, start_date="1970-01-02", end_date="1970-01-03")
    assert read.hits(qc) == [1, 2]


def test_schemes(series):
    qc = series([1, 50]).flagRange("x", max=10).flagRange("x", min=5)
    rows = lambda s: [r["flag"] for r in qc.with_scheme(s).flags("x").orderBy("ts").collect()]
    assert rows("simple") == ["BAD", "BAD"]
    assert rows("positional") == [902, 920]
    assert rows("float") == [255.0, 255.0]
    assert rows("annotated-float")[1]["func"] == "flagRange"
    d = rows("dmp")[0]
    assert d["quality_flag"] == "BAD" and json.loads(d["quality_comment"])["test"] == "flagRange"
    with pytest.raises(ValueError):
        qc.with_scheme("unheard of")


def test_generic(series, read):
    qc = series([1, 5, None, 20])
    assert read.hits(qc.flagGeneric("x", func="(x > 4) & (x < 10)")) == [1]
    assert read.hits(qc.flagGeneric("x", func=lambda x: x > 4)) == [1, 3]
    assert read(qc.processGeneric("x", target="y", func="x ** 2 - -7 % 3"), "y") == [-1.0, 23.0, None, 398.0]
    assert read.hits(qc.flagGeneric("x", func="~(x > 4) ^ (x == 5)")) == [0, 1, 2]
    for bad in ("__import__('os')", "x.y", "[a for a in x]", "lambda: x"):
        with pytest.raises((TypeError, NameError, SyntaxError)):
            qc.flagGeneric("x", func=bad)
    with pytest.raises(TypeError):
        qc.flagGeneric("x", func="x + 1")
    assert read.hits(qc.flagRange("x", max=6, label="top").flagGeneric("x", target="y", func="isflagged(x, label='top')"), "y") == [3]
    with pytest.raises(KeyError):
        qc.flagGeneric("x", func="isflagged(x, label='none')")


def test_division_like_floats(series, read):
    qc = series([1, 0, -1]).processGeneric("x", target="y", func="x / 0")
    assert read(qc, "y") == [math.inf, None, -math.inf]


def test_new_operator(series, read):
    @register(mask=True, demask=True)
    def flagEven(s):
        return s.with_(hit=F.col("value") % 2 == 0)

    assert read.hits(series([1, 2, 3, 4]).flagEven("x")) == [1, 3]
    del OPERATORS["flagEven"]


def test_constants(series, read):
    assert read.hits(series([1, 2, 2, 2, 3, 4]).flagConstants("x", thresh=0, window=3)) == [1, 2, 3]


def test_isolated(series, read):
    v = [1, 1, None, None, None, 5, None, None, None, 1, 1]
    assert read.hits(series(v, 3600).flagIsolated("x", gap_window="3h", group_window="2h")) == [5]


@pytest.mark.parametrize(("window", "method", "want"), [(2, "ffill", [1, 2, 3]), (2, "bfill", [0, 1]), ("60s", "ffill", [1, 2])])
def test_propagate(series, read, window, method, want):
    qc = series([0, 9, 0, 0, 0]).flagRange("x", max=1).propagateFlags("x", window=window, method=method)
    assert read.hits(qc) == want


def test_jumps(series, read):
    assert read.hits(series([1] * 5 + [6] * 5, 86400).flagJumps("x", thresh=1, window="2D")) == [5]


def test_offset(series, read):
    v = [1, 1, 1, 9, 9, 1, 1, 1]
    assert read.hits(series(v, 3600).flagOffset("x", window="4h", thresh=5, tolerance=0.5)) == [3, 4]
    assert read.hits(series([1, 1, 9, 9, 9, 9, 9, 1], 3600).flagOffset("x", window="3h", thresh=5, tolerance=0.5)) == []


def test_set_and_group(series, read):
    qc = series([1, 2, 3, 4]).setFlags("x", data=["1970-01-01 00:01:00"])
    assert read.hits(qc) == [1]
    assert read.hits(qc.setFlags("x", data=[("1970-01-01 00:02:00", "1970-01-01 00:09:00")])) == [1, 2, 3]
    two = qc.copyField("x", target="y").flagRange("y", max=2)
    assert read.hits(two.andGroup(["x", "y"], target="z"), "z") == [1]
    assert read.hits(two.orGroup(["x", "y"], target="z"), "z") == [1, 2, 3]
    assert read.hits(two.transferFlags("y", target="x")) == [1, 2, 3]


def test_manual(series, read, spark):
    m = spark.createDataFrame([("k", 60_000_000, 1.0), ("k", 180_000_000, 0.0)], "key string, t long, value double")
    qc = series([0] * 5)
    assert read.hits(qc.flagManual("x", mdata=m, method="right-open")) == [1, 2]
    assert read.hits(qc.flagManual("x", mdata=m, method="left-open")) == [2, 3]
    assert read.hits(qc.flagManual("x", mdata=m, method="closed")) == [1, 2, 3]
    assert read.hits(qc.flagManual("x", mdata=m, method="ontime")) == [1]


def test_regrid_and_back(series, read):
    qc = series(range(8), 450).copyField("x", target="g").resample("g", freq="30min", func="sum", method="bagg")
    assert read(qc, "g") == [6.0, 22.0, None]
    out = qc.flagRange("g", max=10).concatFlags("g", target="x")
    assert read.hits(out) == [4, 5, 6, 7]
    assert read(out) == [float(i) for i in range(8)]


@pytest.mark.parametrize(("method", "want"), [("fshift", [None, 0, 2]), ("bshift", [0, 1, None]), ("nshift", [0, 1, 2]), ("time", [None, 0.5, None])])
def test_align(spark, read, method, want):
    df = spark.createDataFrame([("k", t * 1_000_000, float(i)) for i, t in enumerate((100, 700, 1100))], "key string, t long, v double")
    qc = QC.from_long(df, "t", "v", "x", keys=["key"]).align("x", freq="10min", method=method)
    got = read(qc)
    if method == "time":
        assert got[1] == pytest.approx(500 / 600) and got[0] is None
    elif method == "fshift":
        assert got == [None, 0.0, 2.0]
    elif method == "bshift":
        assert got == [0.0, 1.0, None]
    else:
        assert got == [0.0, 1.0, 2.0]


def test_rolling_equals_pandas(series, read):
    rng = np.random.default_rng(1)
    v = [None if rng.random() < 0.1 else round(float(x), 3) for x in rng.normal(size=60)]
    s = pd.Series(v, dtype=float, index=pd.to_datetime(np.arange(60) * 60, unit="s"))
    for func in ("mean", "median", "std", "skew", "kurt", "min", "max", "sum", "count"):
        got = read(series(v).rolling("x", window="10min", func=func, center=False, min_periods=4))
        want = getattr(s.rolling("10min", min_periods=4), func)()
        assert np.allclose([np.nan if g is None else g for g in got], want, equal_nan=True, atol=1e-6), func
    got = read(series(v).rolling("x", window="10min", func=lambda x: x.max() - x.min(), center=False))
    want = s.rolling("10min").apply(lambda x: np.nanmax(x) - np.nanmin(x))
    assert np.allclose([np.nan if g is None else g for g in got], want, equal_nan=True)


def test_scores_find_a_spike(series, read):
    v = list(np.sin(np.arange(60) / 5) + 10)
    v[30] += 20
    assert read.hits(series(v).flagUniLOF("x", n=10, thresh=3)) == [30]
    assert 30 in read.hits(series(v).flagByGrubbs("x", window=60))
    assert read.hits(series(v).flagByStray("x")) == [30]
    assert read.hits(series(v).flagLOF("x", n=10, thresh=3, p=2))[:1] == [30]


def test_pattern_and_plateau(series, read):
    v = [0.0] * 10 + [1, 2, 3, 2, 1] + [0.0] * 10
    qc = series(v, 60)
    ref = [(i * 60_000_000, x) for i, x in enumerate((1.0, 2.0, 3.0, 2.0, 1.0))]
    assert read.hits(qc.flagPatternByDTW("x", reference=ref, max_distance=0.01)) == [10, 11, 12, 13, 14]
    flat = [0.0] * 30 + [5.0] * 8 + [0.0] * 30
    assert read.hits(series(flat, 60).flagPlateau("x", min_length="5min", max_length="12min", min_jump=2)) == list(range(30, 38))


def test_fits(series, read):
    line = [2.0 * i + 1 for i in range(30)]
    assert np.allclose([x for x in read(series(line).calculatePolynomialResiduals("x", window="10min", order=1)) if x is not None], 0, atol=1e-6)
    assert np.allclose([x for x in read(series([i * i for i in range(30)]).fitPolynomial("x", window="10min", order=2)) if x is not None], [i * i for i in range(30)], atol=1e-3)
    low = read(series([math.sin(i / 20) for i in range(200)]).fitLowpassFilter("x", cutoff=0.1))
    assert max(abs(a - math.sin(i / 20)) for i, a in enumerate(low)) < 0.05
    assert read(series([None, 0, None, None, None, 4, None]).interpolateNANs("x", method="linear")) == [None, 0, 1, 2, 3, 4, None]
    assert read(series([None, 0, None, None, None, 4, None]).interpolateNANs("x", method="linear", gap_limit=3)) == [None, 0, None, None, None, 4, None]


def test_offset_correction(series, read):
    v = [0.0] * 30 + [-100.0] * 10 + [0.0] * 30 + [100.0] * 10 + [0.0] * 20
    got = read(series(v, 86400).correctOffset("x", max_jump=40, spread=5, window="3D", min_periods=1))
    assert max(abs(x) for x in got) < 1e-6


def test_drift(series, read, spark):
    on = lambda v, n: series(v, 3600, n)
    qc = on([1.0] * 48, "a").merge(on([1.1] * 48, "b"), on([1.05] * 48, "c"), on([9.0] * 48, "d"))
    out = qc.flagDriftFromNorm(["a", "b", "c", "d"], window="1D", spread=0.5)
    assert read.hits(out, "d") == list(range(48)) and read.hits(out, "a") == []
    assert read.hits(qc.flagDriftFromReference(["a", "d"], reference="b", freq="1D", thresh=1), "d") == list(range(48))
    m = spark.createDataFrame([("k", -3600_000_000, 0.0), ("k", 10 * 3600_000_000, 10.0 * 3600e6), ("k", 20 * 3600_000_000, 21.0 * 3600e6)], "key string, t long, v double")
    drift = series([0.5 * i for i in range(10)] + [0.0] * 20, 3600).merge(QC.from_long(m, "t", "v", "m", keys=["key"]))
    got = read(drift.correctDrift("x", maintenance_field="m", model="linear", cal_range=1))
    assert abs(got[9]) < 1e-6 and abs(got[0]) < 1e-6


def test_config(series, read):
    text = "varname;test\n# a comment\nx ; flagRange(min=2, max=sum([4, 6]))\n'x.*' ; flagNaN()\nx ; flagGeneric(func=x > 9)\n"
    qc = run(series([1, 5, None, 20, 9.5]), read_text(text))
    assert read.hits(qc) == [0, 2, 3, 4]
    assert read.hits(run(series([1, 20]), read_json([{"varname": "x", "func": "flagRange", "kwargs": {"max": 10}}]))) == [1]
    for bad in ("flagRange(1)", "nothing(x=1)", "flagRange(min=open)"):
        with pytest.raises((TypeError, NameError)):
            parse_test(bad)
    with pytest.raises(Exception, match="line 2"):
        read_text("varname;test\nx ; flagRange(")


def test_empty_and_all_missing(spark, series, read):
    empty = QC.from_long(spark.createDataFrame([], "key string, t long, v double"), "t", "v", "x", keys=["key"])
    for call in (lambda q: q.flagRange("x", max=1), lambda q: q.flagUniLOF("x"), lambda q: q.resample("x", freq="1h"), lambda q: q.flagZScore("x"), lambda q: q.flagIsolated("x"), lambda q: q.flagJumps("x", thresh=1)):
        assert read(call(empty)) == []
        assert set(read(call(series([None, None, None])))) <= {None}


def test_files_and_cli(spark, tmp_path):
    from siltstream.cli import main
    from siltstream.sources.files import read_wide

    (tmp_path / "d.csv").write_text("ts,a,b\n2020-01-01 00:00:00,1,2\n2020-01-01 00:10:00,30,\n")
    (tmp_path / "c.csv").write_text("varname;test\na;flagRange(max=10)\n")
    assert main(["-c", str(tmp_path / "c.csv"), "-d", str(tmp_path / "d.csv"), "-o", str(tmp_path / "o.csv"), "--two-headers"]) == 0
    lines = (tmp_path / "o.csv").read_text().splitlines()
    assert lines[0] == ",a,a,b,b" and lines[3].split(",")[1:3] == ["30.0", "BAD"]
    with pytest.raises(ValueError):
        read_wide(spark, "x.docx")


def test_streaming(spark, tmp_path):
    from siltstream.streaming.tests import constants, flag_range

    pd.DataFrame({"k": ["a"] * 6, "ts": pd.to_datetime(np.arange(6), unit="s"), "v": [1.0, 2.0, 2.0, 2.0, 5.0, 6.0]}).to_parquet(tmp_path / "p.parquet", coerce_timestamps="us")
    src = spark.readStream.schema("k string, ts timestamp_ntz, v double").parquet(str(tmp_path))
    for df, name in ((flag_range(src, "v", 0, 4), "s1"), (constants(src, "k", "ts", "v", 3), "s2")):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert spark.sql("select count(*) from s1 where flag = 255").first()[0] == 2
    assert [r["n"] for r in spark.sql("select n from s2").collect()] == [3]


@pytest.mark.parametrize("call", [
    lambda q: q.rolling("x", window="2h", func="median", center=True), lambda q: q.flagZScore("x", window="3h", thresh=1.2, method="modified"), lambda q: q.flagMAD("x", window="2h", z=2),
    lambda q: q.flagByScatterLowpass("x", window="2h", thresh=1.0), lambda q: q.flagRange("x", max=1).propagateFlags("x", window="90min"), lambda q: q.calculateRollingResiduals("x", window="2h"),
    lambda q: q.interpolateByRolling("x", window="1h"), lambda q: q.assignZScore("x", window="4h"),
])
def test_long_series_are_cut_without_a_difference(series, read, call):
    rng = np.random.default_rng(6)
    qc = series([None if rng.random() < 0.1 else float(v) for v in rng.normal(size=300)], 300)
    got = [call(QC(qc.fields, qc.keys, split=s)) for s in (None, "13h")]
    for col in ("value", "flag"):
        a, b = ([np.nan if v is None else v for v in read(q, col=col)] for q in got)
        assert np.allclose(a, b, equal_nan=True)
