"""Queries for the quality-control operators, on the events table as series by event type or user, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import read_text, run
from ..flags import DOUBTFUL
from ..frame import QC
from ..operators.grid import climatologicalMean, trueDailyMean
from ..plans.ordered import micros

#: Added before rounding, so that means of decimal fractions do not fall just between two results.
_EPS = 3.1e-7
_H, _D = 3_600_000_000, 86_400_000_000


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.withColumn("value", F.when(F.col("event_id") % 17 != 0, F.col("value")))


def _qc(spark: SparkSession, d: str, key: str = "event_type", scheme: str = "float") -> QC:
    return QC.from_long(_events(spark, d), "ts", "value", "x", keys=[key], scheme=scheme)


def _two(spark: SparkSession, d: str) -> QC:
    """Fields x and y with the same times."""
    e = _events(spark, d).withColumn("y", F.col("event_id") % 100 * 1.5)
    return QC.from_wide(e.withColumnRenamed("value", "x"), "ts", ["x", "y"], ["event_type"])


def _days(spark: SparkSession, d: str) -> QC:
    """Three daily fields of the line items: mean quantity, discount (scaled) and price, by return flag."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    g = li.groupBy("l_returnflag", "l_shipdate").agg(F.avg("l_quantity").alias("a"), (F.avg("l_discount") * 500).alias("b"), (F.avg("l_extendedprice") / 1500).alias("c"))
    return QC.from_wide(g, "l_shipdate", ["a", "b", "c"], ["l_returnflag"])


def _flags(qc: QC, name: str = "x") -> DataFrame:
    f = qc.fields[name].df
    return f.select(*qc.keys, "t", F.when(F.col("flag") > float("-inf"), F.col("flag")).otherwise(-1.0).alias("flag"))


def _each(qc: QC, names: str) -> DataFrame:
    """The flags of several fields, one under the other."""
    return reduce(DataFrame.union, (_flags(qc, n).withColumn("field", F.lit(n)) for n in names))


def _values(qc: QC, name: str = "x", digits: int = 5) -> DataFrame:
    return qc.fields[name].df.select(*qc.keys, "t", F.round(F.col("value") + _EPS, digits).alias("value"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_E = "e AS (SELECT event_type, event_id, user_id, epoch_us(ts) AS t, CASE WHEN event_id % 17 <> 0 THEN value END AS v, event_id % 100 * 1.5 AS y FROM events)"
_O = "(PARTITION BY event_type ORDER BY t"


def _put(name: str, query: Callable, sql: str | None = None, flag: str | None = None, value: str | None = None, w: str = "", more: str = "") -> None:
    """Register a query; ``flag``: SQL condition of a flagged row, ``value``: SQL of the new value, ``w``: window definitions, ``more``: further CTEs after e."""
    QUERIES[name] = query
    src = more.split(" ", 1)[0] if more else "e"
    head = f"WITH {_E}" + (f", {more}" if more else "")
    if flag:
        sql = f"{head} SELECT event_type, t, CASE WHEN {flag} THEN 255.0 ELSE -1.0 END AS flag FROM {src} {w}"
    elif value:
        sql = f"{head} SELECT event_type, t, round({value} + {_EPS}, 5) AS value FROM {src} {w}"
    if sql:
        SQL[name] = sql


def _range(spark: SparkSession, d: str) -> DataFrame:
    return _flags(_qc(spark, d).flagRange("x", min=5, max=150))


_put("flag_range", _range, flag="v < 5 OR v > 150")
_put("flag_nan", lambda s, d: _flags(_qc(s, d).flagNaN("x")), flag="v IS NULL")
_put("flag_missing", lambda s, d: _flags(_qc(s, d).flagMissing("x")), flag="v IS NULL")
_put("flag_dummy", lambda s, d: _flags(_qc(s, d).flagDummy("x")), flag="false")
_put("force_flags", lambda s, d: _flags(_qc(s, d).forceFlags("x")), flag="true")
_put("flag_unflagged", lambda s, d: _flags(_qc(s, d).flagRange("x", max=100).flagUnflagged("x", flag=DOUBTFUL)), f"WITH {_E} SELECT event_type, t, CASE WHEN v > 100 THEN 255.0 ELSE 25.0 END AS flag FROM e")
_put("clear_flags", lambda s, d: _flags(_qc(s, d).flagRange("x", max=100).clearFlags("x").flagRange("x", max=200)), flag="v > 200")
_put("flag_last_wins", lambda s, d: _flags(_qc(s, d).flagRange("x", max=100).flagRange("x", max=200, flag=DOUBTFUL, dfilter=float("inf"))), f"WITH {_E} SELECT event_type, t, CASE WHEN v > 200 THEN 25.0 WHEN v > 100 THEN 255.0 ELSE -1.0 END AS flag FROM e")
_put("dfilter_masks", lambda s, d: _flags(_qc(s, d).flagRange("x", max=100, flag=DOUBTFUL).flagRange("x", min=20, max=150)), f"WITH {_E} SELECT event_type, t, CASE WHEN v > 100 THEN 25.0 WHEN v < 20 THEN 255.0 ELSE -1.0 END AS flag FROM e")
_put("start_end_dates", lambda s, d: _flags(_qc(s, d).flagRange("x", max=50, start_date="2024-01-05", end_date="2024-01-20")), flag="v > 50 AND t >= epoch_us(TIMESTAMP '2024-01-05') AND t <= epoch_us(TIMESTAMP '2024-01-20')")
_put("target_and_regex", lambda s, d: _each(_two(s, d).flagRange("[xy]", regex=True, target=["p", "q"], max=90), "pq"), f"WITH {_E}, b AS (SELECT event_type, t, 'p' AS field, v > 90 AS f FROM e UNION ALL SELECT event_type, t, 'q', y > 90 FROM e) SELECT event_type, t, field, CASE WHEN f THEN 255.0 ELSE -1.0 END AS flag FROM b")


def _scheme(scheme: str) -> Callable:
    def query(s: SparkSession, d: str) -> DataFrame:
        qc = _qc(s, d, scheme=scheme).flagRange("x", max=100).flagRange("x", min=20)
        f = qc.fields["x"]
        flag = qc.scheme.external(f)
        out = f.df.select("event_type", "t", flag.alias("flag"))
        return out.select("event_type", "t", "flag.*") if scheme == "dmp" else out

    return query


_put("scheme_simple", _scheme("simple"), f"WITH {_E} SELECT event_type, t, CASE WHEN v > 100 OR v < 20 THEN 'BAD' ELSE 'UNFLAGGED' END AS flag FROM e")
_put("scheme_positional", _scheme("positional"), f"WITH {_E} SELECT event_type, t, CASE WHEN v > 100 THEN 920 WHEN v < 20 THEN 902 ELSE 900 END::BIGINT AS flag FROM e")
_put("scheme_dmp", _scheme("dmp"), f"""WITH {_E}, b AS (SELECT *, v > 100 OR v < 20 AS bad FROM e) SELECT event_type, t, CASE WHEN bad THEN 'BAD' ELSE 'NIL' END AS quality_flag, CASE WHEN bad THEN 'OTHER' ELSE '' END AS quality_cause,
CASE WHEN bad THEN '{{"test":"flagRange","comment":""}}' ELSE '' END AS quality_comment FROM b""")
_put("generic_flag", lambda s, d: _flags(_two(s, d).flagGeneric(["x", "y"], target="y", func="(x > 30) & (y < 100) | ~(y >= 3)"), "y"), flag="(coalesce(v > 30, false) AND y < 100) OR NOT (y >= 3)")
_put("generic_isflagged", lambda s, d: _flags(_two(s, d).flagRange("x", max=50, label="high").flagGeneric(["x", "y"], target="y", func="isflagged(x, label='high') & (y > 30)"), "y"), flag="v > 50 AND y > 30")
_put("generic_process", lambda s, d: _values(_two(s, d).processGeneric(["x", "y"], target="z", func="abs(x - mean(x)) / std(x) + y % 7 - 2 ** 2"), "z"), value="abs(v - avg(v) OVER w) / stddev_pop(v) OVER w + y - 7 * floor(y / 7) - 4", w="WINDOW w AS (PARTITION BY event_type)")
_put("select_time", lambda s, d: _values(_qc(s, d).selectTime("x", start="06:00:00", end="18:00:00")), value="CASE WHEN NOT (strftime(make_timestamp(t), '%H:%M:%S') BETWEEN '06:00:00' AND '18:00:00') THEN v END")
_put("select_time_wrap", lambda s, d: _values(_qc(s, d).selectTime("x", start="22:00:00", end="04:00:00")), value="CASE WHEN NOT (strftime(make_timestamp(t), '%H:%M:%S') >= '22:00:00' OR strftime(make_timestamp(t), '%H:%M:%S') <= '04:00:00') THEN v END")
_put("select_time_field", lambda s, d: _values(_two(s, d).processGeneric("y", target="m", func="y > 75").selectTime("x", mode="selection_field", selection_field="m")), value="CASE WHEN NOT y > 75 THEN v END")


def _roll(func: str, **kw) -> Callable:
    return lambda s, d: _values(_qc(s, d).rolling("x", func=func, **kw), digits=4)


_TIME = f"WINDOW w AS {_O} RANGE BETWEEN {6 * _H - 1} PRECEDING AND CURRENT ROW)"
for _f, _q in {"mean": "avg(v)", "sum": "sum(v)", "min": "min(v)", "max": "max(v)", "count": "1.0 * count(v)", "median": "median(v)", "std": "stddev_samp(v)", "var": "var_samp(v)"}.items():
    _put(f"rolling_{_f}", _roll(_f, window="6h", center=False), f"WITH {_E} SELECT event_type, t, round({_q} OVER w + {_EPS}, 4) AS value FROM e {_TIME}")
_put("rolling_centered", _roll("mean", window="6h", center=True), f"WITH {_E} SELECT event_type, t, round(avg(v) OVER w + {_EPS}, 4) AS value FROM e WINDOW w AS {_O} RANGE BETWEEN {3 * _H - 1} PRECEDING AND {3 * _H} FOLLOWING)")
_put("rolling_rows", _roll("mean", window=9, center=True, min_periods=5), f"WITH {_E} SELECT event_type, t, round(CASE WHEN count(v) OVER w >= 5 THEN avg(v) OVER w END + {_EPS}, 4) AS value FROM e WINDOW w AS {_O} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)")
_put("rolling_residuals", lambda s, d: _values(_qc(s, d).calculateRollingResiduals("x", window="6h", func="mean", center=False)), value="v - avg(v) OVER w", w=_TIME)
_put("interpolate_by_rolling", lambda s, d: _values(_qc(s, d).interpolateByRolling("x", window="6h", func="median", center=False)), value="coalesce(v, median(v) OVER w)", w=_TIME)
_put("zscore_global", lambda s, d: _flags(_qc(s, d).flagZScore("x", thresh=2.5)), flag="abs(v - avg(v) OVER w) > 2.5 * stddev_samp(v) OVER w", w="WINDOW w AS (PARTITION BY event_type)")
_put("zscore_rolling", lambda s, d: _flags(_qc(s, d).flagZScore("x", window="1D", thresh=2.5, center=False, min_residuals=10)), flag="abs(v - avg(v) OVER w) > 2.5 * stddev_samp(v) OVER w AND abs(v - avg(v) OVER w) >= 10", w=f"WINDOW w AS {_O} RANGE BETWEEN {_D - 1} PRECEDING AND CURRENT ROW)")
_put("zscore_modified", lambda s, d: _flags(_qc(s, d).flagZScore("x", method="modified", thresh=6)), flag="r > 6 * median(r) OVER (PARTITION BY event_type)", more="m AS (SELECT *, abs(v - median(v) OVER (PARTITION BY event_type)) AS r FROM e)")
_put("flag_mad", lambda s, d: _flags(_qc(s, d).flagMAD("x", window="1D", z=6)), flag=f"r > 6 * median(r) OVER {_O} RANGE BETWEEN {_D - 1} PRECEDING AND CURRENT ROW)", more=f"m AS (SELECT *, abs(v - median(v) OVER {_O} RANGE BETWEEN {_D - 1} PRECEDING AND CURRENT ROW)) AS r FROM e)")
_put("assign_zscore", lambda s, d: _values(_qc(s, d).assignZScore("x")), value="(v - avg(v) OVER w) / stddev_pop(v) OVER w", w="WINDOW w AS (PARTITION BY event_type)")
_put("zscore_cross", lambda s, d: _each(_days(s, d).flagZScore(["a", "b", "c"], axis=1, thresh=1.1), "abc"), """WITH g AS (SELECT l_returnflag, epoch_us(l_shipdate) AS t, avg(l_quantity) AS a, avg(l_discount) * 500 AS b, avg(l_extendedprice) / 1500 AS c FROM lineitem GROUP BY ALL),
l AS (SELECT l_returnflag, unnest([a, b, c]) AS v FROM g), m AS (SELECT l_returnflag, avg(v) AS m, stddev_samp(v) AS s FROM l GROUP BY 1)
SELECT l_returnflag, t, field, CASE WHEN abs(v - m) > 1.1 * s THEN 255.0 ELSE -1.0 END AS flag FROM (SELECT l_returnflag, t, unnest([a, b, c]) AS v, unnest(['a', 'b', 'c']) AS field FROM g) JOIN m USING (l_returnflag)""")
_W6 = f"(PARTITION BY event_type ORDER BY t RANGE BETWEEN {6 * _H - 1} PRECEDING AND CURRENT ROW)"
_F6 = f"(PARTITION BY event_type ORDER BY t RANGE BETWEEN CURRENT ROW AND {6 * _H - 1} FOLLOWING)"
_put("flag_constants", lambda s, d: _flags(_qc(s, d).flagConstants("x", thresh=25, window="6h")), flag=f"max(c) OVER {_F6} = 1 AND v IS NOT NULL",
     more=f"m AS (SELECT *, CASE WHEN max(v) OVER {_W6} - min(v) OVER {_W6} <= 25 AND count(v) OVER {_W6} >= 2 AND t - min(t) OVER (PARTITION BY event_type) >= {6 * _H - 1} THEN 1 ELSE 0 END AS c FROM e)")
_put("flag_scatter", lambda s, d: _flags(_qc(s, d).flagByScatterLowpass("x", window="6h", thresh=80)), flag=f"max(c) OVER {_F6} = 1", more=f"m AS (SELECT *, CASE WHEN stddev_samp(v) OVER {_W6} > 80 THEN 1 ELSE 0 END AS c FROM e)")
_put("flag_variance", lambda s, d: _flags(_qc(s, d).flagByVariance("x", window="6h", thresh=200, maxna=1)), flag=f"max(c) OVER {_F6} = 1",
     more=f"m AS (SELECT *, CASE WHEN var_samp(v) OVER {_W6} < 200 AND count(*) OVER {_W6} - count(v) OVER {_W6} <= 1 AND t - min(t) OVER (PARTITION BY event_type) >= {6 * _H - 1} THEN 1 ELSE 0 END AS c FROM e)")
_put("propagate_flags", lambda s, d: _flags(_qc(s, d).flagRange("x", max=200).propagateFlags("x", window="2h")), flag=f"v > 200 OR max(CASE WHEN v > 200 THEN 1 ELSE 0 END) OVER {_O} RANGE BETWEEN {2 * _H} PRECEDING AND 1 PRECEDING) = 1")
_put("propagate_back", lambda s, d: _flags(_qc(s, d).flagRange("x", max=200).propagateFlags("x", window=3, method="bfill")), flag=f"v > 200 OR max(CASE WHEN v > 200 THEN 1 ELSE 0 END) OVER {_O} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) = 1")
_put("flag_isolated", lambda s, d: _flags(_qc(s, d, "user_id").flagIsolated("x", gap_window="12h", group_window="6h")), f"""WITH {_E}, k AS (SELECT *, CASE WHEN t - lag(t) OVER o >= {12 * _H} OR lag(t) OVER o IS NULL THEN 1 ELSE 0 END AS s FROM e WHERE v IS NOT NULL WINDOW o AS (PARTITION BY user_id ORDER BY t)),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t) AS g FROM k), x AS (SELECT user_id, t, g, max(g) OVER (PARTITION BY user_id) AS last, max(t) OVER q - min(t) OVER q AS size FROM g WINDOW q AS (PARTITION BY user_id, g))
SELECT e.user_id, e.t, CASE WHEN g > 1 AND g < last AND size < {6 * _H} THEN 255.0 ELSE -1.0 END AS flag FROM e LEFT JOIN x ON e.user_id = x.user_id AND e.t = x.t""")
_put("flag_raise", lambda s, d: _flags(_qc(s, d).flagRaise("x", thresh=150, raise_window="3h", freq="1000D", average_window="6h")), flag="rise >= 150 AND v >= m + rise / 2",
     more=f"m AS (SELECT *, v - min(v) OVER {_O} RANGE BETWEEN {3 * _H} PRECEDING AND 1 PRECEDING) AS rise, lag(t) OVER (PARTITION BY event_type ORDER BY t) AS p, sum(v * k) OVER b / sum(k) OVER b AS m FROM (SELECT *, CASE WHEN v IS NOT NULL THEN coalesce((t - max(CASE WHEN v IS NOT NULL THEN t END) OVER {_O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 86400000000000.0, 1.0) END AS k FROM e) WINDOW b AS {_O} RANGE BETWEEN {6 * _H} PRECEDING AND 1 PRECEDING))")


def _grid(f: int, label: str, agg: str, out: str = "value") -> str:
    return f"""WITH {_E}, a AS (SELECT event_type, {label} AS t, {agg} AS value FROM e GROUP BY 1, 2), b AS (SELECT event_type, floor(min(t) / {f})::BIGINT AS p, ceil(max(t) / {f})::BIGINT AS q FROM e GROUP BY 1),
g AS (SELECT event_type, unnest(range(p, q + 1)) * {f} AS t FROM b) SELECT g.event_type, g.t, round(a.value + {_EPS}, 5) AS {out} FROM g LEFT JOIN a ON g.event_type = a.event_type AND g.t = a.t"""


for _m, _l in {"bagg": f"floor(t / {_H})::BIGINT * {_H}", "fagg": f"ceil(t / {_H})::BIGINT * {_H}", "nagg": f"floor((t + {_H // 2}) / {_H})::BIGINT * {_H}"}.items():
    _put(f"resample_{_m}", lambda s, d, m=_m: _values(_qc(s, d).resample("x", freq="1h", func="mean", method=m)), _grid(_H, _l, "avg(v)"))
for _f, _q in {"sum": "sum(v)", "median": "median(v)", "count": "count(v)::DOUBLE", "std": "stddev_samp(v)", "last": "arg_max(v, t)"}.items():
    _put(f"resample_{_f}", lambda s, d, f=_f: _values(_qc(s, d).resample("x", freq="6h", func=f)), _grid(6 * _H, f"floor(t / {6 * _H})::BIGINT * {6 * _H}", _q))
_put("resample_maxna", lambda s, d: _values(_qc(s, d).resample("x", freq="6h", func="mean", maxna=1)), _grid(6 * _H, f"floor(t / {6 * _H})::BIGINT * {6 * _H}", "CASE WHEN count(*) - count(v) <= 1 THEN avg(v) END"))
_put("resample_flags", lambda s, d: _flags(_qc(s, d).flagRange("x", max=200).resample("x", freq="6h")), _grid(6 * _H, f"floor(t / {6 * _H})::BIGINT * {6 * _H}", "max(CASE WHEN v > 200 THEN 255.0 END)", "f").replace(f"round(a.value + {_EPS}, 5) AS f", "coalesce(a.value, -1.0) AS flag"))
for _m, _j, _c in (("fshift", "t", f"t > g.t - {_H}"), ("bshift", "-t", f"t < g.t + {_H}")):
    _side = "k.t <= g.t AND k.t > g.t - %d" % _H if _m == "fshift" else "k.t >= g.t AND k.t < g.t + %d" % _H
    _put(f"align_{_m}", lambda s, d, m=_m: _values(_qc(s, d).align("x", freq="1h", method=m)), f"""WITH {_E}, b AS (SELECT event_type, floor(min(t) / {_H})::BIGINT AS p, ceil(max(t) / {_H})::BIGINT AS q FROM e GROUP BY 1),
g AS (SELECT event_type, unnest(range(p, q + 1)) * {_H} AS t FROM b), k AS (SELECT * FROM e WHERE v IS NOT NULL)
SELECT g.event_type, g.t, round(arg_max(k.v, {_j.replace("t", "k.t")}) + {_EPS}, 5) AS value FROM g LEFT JOIN k ON g.event_type = k.event_type AND {_side} GROUP BY 1, 2""")
_put("align_time", lambda s, d: _values(_qc(s, d).align("x", freq="1h", method="time"), digits=4), f"""WITH {_E}, b AS (SELECT event_type, floor(min(t) / {_H})::BIGINT AS p, ceil(max(t) / {_H})::BIGINT AS q FROM e GROUP BY 1),
g AS (SELECT event_type, unnest(range(p, q + 1)) * {_H} AS t FROM b), k AS (SELECT * FROM e WHERE v IS NOT NULL),
l AS (SELECT g.*, e.t AS ta FROM g ASOF LEFT JOIN e ON g.event_type = e.event_type AND g.t >= e.t), r AS (SELECT l.*, e.t AS tb FROM l ASOF LEFT JOIN e ON l.event_type = e.event_type AND l.t <= e.t),
p AS (SELECT r.*, k.t AS qa, k.v AS va FROM r ASOF LEFT JOIN k ON r.event_type = k.event_type AND r.t >= k.t), q AS (SELECT p.*, k.t AS qb, k.v AS vb FROM p ASOF LEFT JOIN k ON p.event_type = k.event_type AND p.t <= k.t)
SELECT event_type, t, round(CASE WHEN t - ta <= {_H} AND tb - t <= {_H} THEN CASE WHEN qb = qa THEN va ELSE va + (vb - va) * (t - qa) / (qb - qa) END END + {_EPS}, 4) AS value FROM q""")
_put("concat_flags", lambda s, d: _flags(_qc(s, d).copyField("x", target="g").resample("g", freq="6h", func="max").flagRange("g", max=250).concatFlags("g", target="x")), f"WITH {_E} SELECT event_type, t, CASE WHEN max(v) OVER (PARTITION BY event_type, t // {6 * _H}) > 250 THEN 255.0 ELSE -1.0 END AS flag FROM e")
_put("and_group", lambda s, d: _flags(_two(s, d).flagRange("x", max=50).flagRange("y", max=75).andGroup(["x", "y"], target="z"), "z"), flag="v > 50 AND y > 75")
_put("or_group", lambda s, d: _flags(_two(s, d).flagRange("x", max=50).flagRange("y", max=75).orGroup(["x", "y"], target="z"), "z"), flag="v > 50 OR y > 75")
_put("transfer_flags", lambda s, d: _flags(_two(s, d).flagRange("x", max=50).flagRange("y", max=140, flag=DOUBTFUL).transferFlags("x", target="y"), "y"), f"WITH {_E} SELECT event_type, t, CASE WHEN y > 140 THEN 25.0 WHEN v > 50 THEN 255.0 ELSE -1.0 END AS flag FROM e")
_put("set_flags_intervals", lambda s, d: _flags(_qc(s, d).setFlags("x", data=[("2024-01-03", "2024-01-04 12:00:00"), ("2024-01-20", "2024-01-21")])), flag="t BETWEEN epoch_us(TIMESTAMP '2024-01-03') AND epoch_us(TIMESTAMP '2024-01-04 12:00:00') OR t BETWEEN epoch_us(TIMESTAMP '2024-01-20') AND epoch_us(TIMESTAMP '2024-01-21')")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Maintenance intervals: station_id, a, b (microseconds). An open one lasts until the station's next one begins, or for ever."""
    m = spark.read.parquet(f"{d}/maint.parquet").filter("station_id is not null and maint_start is not null")
    m = m.select("station_id", micros(m, "maint_start").alias("a"), micros(m, "maint_end").alias("b"))
    later = F.min("a").over(Window.partitionBy("station_id").orderBy("a").rangeBetween(1, Window.unboundedFollowing))
    return m.withColumn("b", F.coalesce("b", later - 1, F.lit(2**62)))


_SPANS = """s AS (SELECT station_id, epoch_us(maint_start) AS a, epoch_us(maint_end) AS b FROM maint WHERE station_id IS NOT NULL AND maint_start IS NOT NULL),
m AS (SELECT station_id, a, coalesce(b, min(a) OVER (PARTITION BY station_id ORDER BY a RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1, 4611686018427387904) AS b FROM s)"""


def _maint(spark: SparkSession, d: str) -> DataFrame:
    """Readings of both fields inside a maintenance interval of their station."""
    out = []
    for table, field in (("data_sm1", "sm1"), ("data_sm2", "sm2")):
        sm = spark.read.parquet(f"{d}/{table}.parquet").filter("station_id is not null and ts is not null").groupBy("station_id", "ts").agg(F.max(F.nanvl(field, F.lit(None).cast("double"))).alias(field))
        qc = QC.from_long(sm, "ts", field, field, keys=["station_id"])
        spans = _spans(spark, d)
        # intervals are cut to the station's own time, so that an open one has an end
        ends = qc.fields[field].df.groupBy("station_id").agg(F.min("t").alias("p"), F.max("t").alias("q"))
        spans = spans.join(ends, "station_id").select("station_id", F.greatest("a", "p").alias("a"), F.least("b", "q").alias("b"))
        out.append(_flags(qc.setFlags(field, data=spans), field).withColumn("field", F.lit(field)))
    return reduce(DataFrame.union, out)


_put("set_flags_maintenance", _maint, f"""WITH {_SPANS}, r AS (SELECT DISTINCT 'sm1' AS field, station_id, epoch_us(ts) AS t FROM data_sm1 WHERE station_id IS NOT NULL AND ts IS NOT NULL
UNION ALL SELECT DISTINCT 'sm2', station_id, epoch_us(ts) FROM data_sm2 WHERE station_id IS NOT NULL AND ts IS NOT NULL)
SELECT field, r.station_id, t, CASE WHEN bool_or(m.a IS NOT NULL) THEN 255.0 ELSE -1.0 END AS flag FROM r LEFT JOIN m ON r.station_id = m.station_id AND t BETWEEN m.a AND m.b GROUP BY 1, 2, 3""")


def _imported(spark: SparkSession, d: str) -> DataFrame:
    """Hand checks of both fields as imported flags: those of 25 and more hide their value from the next test."""
    out = []
    for table, field in (("data_sm1", "sm1"), ("data_sm2", "sm2")):
        f = spark.read.parquet(f"{d}/data_flags.parquet").filter("station_id is not null and ts is not null").filter(F.col("field") == field).groupBy("station_id", "ts").agg(F.max(F.nanvl("flag", F.lit(None).cast("double"))).alias("flag"))
        sm = spark.read.parquet(f"{d}/{table}.parquet").filter("station_id is not null and ts is not null").groupBy("station_id", "ts").agg(F.max(F.nanvl(field, F.lit(None).cast("double"))).alias(field))
        qc = QC.from_long(sm.join(f, ["station_id", "ts"], "left"), "ts", field, field, keys=["station_id"], flag="flag")
        out.append(_flags(qc.flagRange(field, min=0, max=40, dfilter=DOUBTFUL, flag=200.0), field).withColumn("field", F.lit(field)))
    return reduce(DataFrame.union, out)


def _imported_sql(table: str, field: str) -> str:
    return f"""SELECT '{field}' AS field, r.station_id, epoch_us(r.ts) AS t, CASE WHEN coalesce(flag, '-infinity'::DOUBLE) < 25 AND (v < 0 OR v > 40) THEN 200.0 WHEN flag > '-infinity'::DOUBLE THEN flag ELSE -1.0 END AS flag
FROM (SELECT station_id, ts, max(CASE WHEN NOT isnan({field}) THEN {field} END) AS v FROM {table} WHERE station_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2) r
LEFT JOIN (SELECT station_id, ts, max(CASE WHEN NOT isnan(flag) THEN flag END) AS flag FROM data_flags WHERE station_id IS NOT NULL AND ts IS NOT NULL AND field = '{field}' GROUP BY 1, 2) f ON r.station_id = f.station_id AND r.ts = f.ts"""


_put("imported_flags", _imported, " UNION ALL ".join((_imported_sql("data_sm1", "sm1"), _imported_sql("data_sm2", "sm2"))))
_DAYW = f"(PARTITION BY event_type, t // {_D})"
_put("transform_zscore_daily", lambda s, d: _values(_qc(s, d).transform("x", func="zScore", freq="1D")), value=f"(v - avg(v) OVER {_DAYW}) / nullif(stddev_samp(v) OVER {_DAYW}, 0)")
_put("transform_mad", lambda s, d: _values(_qc(s, d).transform("x", func="madScore")), value="(v - md) / median(abs(v - md)) OVER (PARTITION BY event_type)", more="m AS (SELECT *, median(v) OVER (PARTITION BY event_type) AS md FROM e)")
_put("transform_iqr", lambda s, d: _values(_qc(s, d).transform("x", func="iqsScore")), value="(v - median(v) OVER w) / (quantile_cont(v, 0.75) OVER w - quantile_cont(v, 0.25) OVER w)", w="WINDOW w AS (PARTITION BY event_type)")
_put("transform_scale", lambda s, d: _values(_qc(s, d).transform("x", func="scale")), value="(v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w)", w="WINDOW w AS (PARTITION BY event_type)")
_put("transform_diff", lambda s, d: _values(_qc(s, d).transform("x", func="diff")), value=f"v - lag(v) OVER {_O})")
_G = "g AS (SELECT l_returnflag, epoch_us(l_shipdate) AS t, avg(l_quantity) AS a, avg(l_discount) * 500 AS b, avg(l_extendedprice) / 1500 AS c FROM lineitem GROUP BY ALL)"
_SEG = f"s AS (SELECT *, (t - min(t) OVER (PARTITION BY l_returnflag) // {_D} * {_D}) // {30 * _D} AS seg FROM g)"
_put("drift_from_reference", lambda s, d: _flags(_days(s, d).flagDriftFromReference(["a"], reference="b", freq="30D", thresh=3.0), "a"), f"""WITH {_G}, {_SEG}, m AS (SELECT l_returnflag, seg, avg(abs(a - b)) AS d, count(*) AS n FROM s GROUP BY 1, 2)
SELECT s.l_returnflag, t, CASE WHEN d > 3 AND n > 1 THEN 255.0 ELSE -1.0 END AS flag FROM s JOIN m ON s.l_returnflag = m.l_returnflag AND s.seg = m.seg""")
_put("drift_from_norm", lambda s, d: _each(_days(s, d).flagDriftFromNorm(["a", "b", "c"], window="30D", spread=3.0), "abc"), f"""WITH {_G}, {_SEG}, m AS (SELECT l_returnflag, seg, avg(abs(a - b)) AS ab, avg(abs(a - c)) AS ac, avg(abs(b - c)) AS bc, count(*) AS n FROM s GROUP BY 1, 2)
SELECT s.l_returnflag, t, unnest(['a', 'b', 'c']) AS field, unnest([CASE WHEN n > 1 AND bc <= 3 AND ab > 3 AND ac > 3 THEN 255.0 ELSE -1.0 END, CASE WHEN n > 1 AND ac <= 3 AND ab > 3 AND bc > 3 THEN 255.0 ELSE -1.0 END,
CASE WHEN n > 1 AND ab <= 3 AND ac > 3 AND bc > 3 THEN 255.0 ELSE -1.0 END]) AS flag FROM s JOIN m ON s.l_returnflag = m.l_returnflag AND s.seg = m.seg""")
_TEN = "r AS (SELECT station_id, epoch_us(time_bucket(INTERVAL 10 MINUTE, ts)) AS t, avg(sm1) AS v FROM data_sm1 WHERE sm1 BETWEEN 0 AND 100 AND station_id IS NOT NULL GROUP BY 1, 2)"
_put("climatological_mean", lambda s, d: _wmo(s, d, climatologicalMean), f"""WITH {_TEN}, w AS (SELECT *, t // {_D} AS day, t // 60000000 % 1440 AS m FROM r)
SELECT station_id, day, round(CASE WHEN count(*) >= 3 THEN (sum(CASE WHEN m < 1230 THEN v END) + 2 * sum(CASE WHEN m = 1230 THEN v END)) / 3 END + {_EPS}, 5) AS value FROM w WHERE m IN (390, 750, 1230) GROUP BY 1, 2""")


def _wmo(spark: SparkSession, d: str, mean: Callable) -> DataFrame:
    sm = spark.read.parquet(f"{d}/data_sm1.parquet").filter("sm1 between 0 and 100 and station_id is not null")
    qc = QC.from_long(sm, "ts", "sm1", "sm1", keys=["station_id"]).resample("sm1", freq="10min")
    return mean(qc.fields["sm1"].df.filter("value is not null"), ("station_id",)).select("station_id", "day", F.round(F.col("value") + _EPS, 5).alias("value"))


_put("true_daily_mean", lambda s, d: _wmo(s, d, trueDailyMean), f"""WITH {_TEN}, h AS (SELECT station_id, (t + 600000000) // {_D} AS day, (t + 600000000) // {_H} % 24 AS h, v FROM r WHERE (t + 600000000) % {_H} = 0),
g AS (SELECT *, greatest(h - coalesce(lag(h) OVER w, -1) - 1, CASE WHEN lead(h) OVER w IS NULL THEN 23 - h ELSE 0 END) AS gap FROM h WINDOW w AS (PARTITION BY station_id, day ORDER BY h))
SELECT station_id, day, round(CASE WHEN max(gap) <= 2 THEN avg(v) END + {_EPS}, 5) AS value FROM g GROUP BY 1, 2""")
_put("resample_climatological", lambda s, d: _climate(s, d), f"""WITH {_TEN}, w AS (SELECT *, t // {_D} AS day, t // 60000000 % 1440 AS m FROM r),
c AS (SELECT station_id, day, CASE WHEN count(*) >= 3 THEN (sum(CASE WHEN m < 1230 THEN v END) + 2 * sum(CASE WHEN m = 1230 THEN v END)) / 3 END AS value FROM w WHERE m IN (390, 750, 1230) GROUP BY 1, 2)
SELECT station_id, day, round(value + {_EPS}, 5) AS value FROM c WHERE value IS NOT NULL""")


def _climate(spark: SparkSession, d: str) -> DataFrame:
    """The same through resample: its grid has every day, of which those with a mean are shown."""
    sm = spark.read.parquet(f"{d}/data_sm1.parquet").filter("sm1 between 0 and 100 and station_id is not null")
    qc = QC.from_long(sm, "ts", "sm1", "sm1", keys=["station_id"]).resample("sm1", freq="10min").resample("sm1", freq="1D", func="climatologicalMean")
    return qc.fields["sm1"].df.filter("value is not null").select("station_id", F.floor(F.col("t") / _D).alias("day"), F.round(F.col("value") + _EPS, 5).alias("value"))


_put("jumps_statistic", lambda s, d: _jump_stat(s, d), f"""WITH {_E} SELECT event_type, t, round(CASE WHEN v IS NOT NULL AND count(v) OVER b >= 3 AND count(v) OVER f >= 3 THEN abs(avg(v) OVER b - avg(v) OVER f) END + {_EPS}, 5) AS stat FROM e
WINDOW b AS {_O} RANGE BETWEEN {12 * _H - 1} PRECEDING AND CURRENT ROW), f AS {_O} RANGE BETWEEN 1 FOLLOWING AND {12 * _H} FOLLOWING)""")


def _jump_stat(spark: SparkSession, d: str) -> DataFrame:
    from ..frame import Series
    from ..operators.changepoints import marked

    f = _qc(spark, d).fields["x"].df
    return marked(Series(f, ("event_type",)), "mean", 50.0, "12h", 3).df.select("event_type", "t", F.round(F.col("stat") + _EPS, 5).alias("stat"))


# algorithms that SQL cannot express, or not in time: compared with brute force in the tests
def _points(agg: str, thresh: float) -> str:
    """Change points after thinning: of the neighbourhoods that hold a point the last decides, and there the greatest statistic wins."""
    h = 12 * _H
    return f"""{_E}, st AS (SELECT event_type, t, v, CASE WHEN v IS NOT NULL AND count(v) OVER b >= 3 AND count(v) OVER f >= 3 THEN abs({agg}(v) OVER b - {agg}(v) OVER f) END AS stat FROM e
WINDOW b AS {_O} RANGE BETWEEN {h - 1} PRECEDING AND CURRENT ROW), f AS {_O} RANGE BETWEEN 1 FOLLOWING AND {h} FOLLOWING)),
found AS (SELECT event_type, t, stat FROM st WHERE stat > {thresh}), lst AS (SELECT *, max(t) OVER {_O} RANGE BETWEEN CURRENT ROW AND {h} FOLLOWING) AS i FROM found),
best AS (SELECT a.event_type, a.t, max(b.stat) AS top FROM lst a JOIN found b ON a.event_type = b.event_type AND b.t BETWEEN a.i - {h} AND a.i + {h} GROUP BY 1, 2),
kept AS (SELECT l.event_type, l.t FROM lst l JOIN best USING (event_type, t) WHERE l.stat = top AND NOT EXISTS (SELECT 1 FROM found b WHERE b.event_type = l.event_type AND b.t BETWEEN l.i - {h} AND l.i + {h} AND b.stat = top AND b.t < l.t)),
pr AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN t END) OVER {_O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM e),
cp AS (SELECT pr.*, kept.t IS NOT NULL AND v IS NOT NULL AS cp FROM pr LEFT JOIN kept ON pr.event_type = kept.event_type AND pr.prior = kept.t)"""


_FLAGGED = "SELECT event_type, t, CASE WHEN cp THEN 255.0 ELSE -1.0 END AS flag FROM cp"
_put("flag_jumps", lambda s, d: _flags(_qc(s, d).flagJumps("x", thresh=60, window="12h", min_periods=3)), f"WITH {_points('avg', 60)} {_FLAGGED}")
_put("flag_change_points", lambda s, d: _flags(_qc(s, d).flagChangePoints("x", stat_func="median", thresh_func=60, window="12h", min_periods=3)), f"WITH {_points('median', 60)} {_FLAGGED}")
_put("change_point_cluster", lambda s, d: _values(_qc(s, d).assignChangePointCluster("x", stat_func="mean", thresh_func=60, window="12h", min_periods=3)), f"WITH {_points('avg', 60)} SELECT event_type, t, 1.0 + count(CASE WHEN cp THEN 1 END) OVER {_O}) AS value FROM cp")
_put("flag_stray", lambda s, d: _flags(_qc(s, d).flagByStray("x", window="1D")), f"""WITH {_E}, b AS (SELECT *, (t - min(t) OVER (PARTITION BY event_type) // {_D} * {_D}) // {_D} AS blk FROM e),
k AS (SELECT *, count(*) OVER (PARTITION BY event_type, blk) AS n, row_number() OVER w - 1 AS i, coalesce(v - lag(v) OVER w, 0) AS gap FROM b WHERE v IS NOT NULL WINDOW w AS (PARTITION BY event_type, blk ORDER BY v, t)),
z AS (SELECT *, greatest(least(n // 4, 50), 2) AS size FROM k),
x AS (SELECT z.event_type, z.blk, z.i, sum(coalesce(y.gap, 0) * (z.i - y.i + 1) / (z.size - 1)) AS expected FROM z LEFT JOIN z y ON z.event_type = y.event_type AND z.blk = y.blk AND y.i BETWEEN z.i - z.size + 1 AND z.i - 1 GROUP BY 1, 2, 3),
h AS (SELECT z.*, max(CASE WHEN n >= 11 AND i >= greatest(floor(n * 0.5), 1) AND gap > -ln(0.05) * coalesce(expected, 0) THEN 1 ELSE 0 END) OVER (PARTITION BY z.event_type, z.blk ORDER BY i) AS far FROM z JOIN x USING (event_type, blk, i))
SELECT e.event_type, e.t, CASE WHEN far = 1 THEN 255.0 ELSE -1.0 END AS flag FROM e LEFT JOIN h ON e.event_type = h.event_type AND e.t = h.t""")
_put("flag_offset", lambda s, d: _flags(_qc(s, d).flagOffset("x", window="12h", thresh=100, tolerance=20)))
_put("flag_grubbs", lambda s, d: _flags(_qc(s, d, "user_id").flagByGrubbs("x", window="10D")))
_put("flag_unilof", lambda s, d: _flags(_qc(s, d, "user_id").flagUniLOF("x", n=10, thresh=2.0)))
_put("assign_unilof", lambda s, d: _values(_qc(s, d, "user_id").assignUniLOF("x", n=10)))


def _lof(seg: str, dist: str, n: int = 20) -> str:
    """Local outlier factors of (a, b) inside the blocks ``seg``, by definition."""
    return f"""{_G}, s AS (SELECT *, {seg} AS seg FROM g), d AS (SELECT x.l_returnflag, x.t, y.t AS u, {dist} AS d FROM s x JOIN s y ON x.l_returnflag = y.l_returnflag AND x.seg = y.seg AND x.t <> y.t),
k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY l_returnflag, t ORDER BY d, u) <= {n}), kd AS (SELECT l_returnflag, t, max(d) AS kd FROM k GROUP BY 1, 2),
den AS (SELECT k.l_returnflag, k.t, 1 / (avg(greatest(k.d, kd.kd)) + 1e-10) AS den FROM k JOIN kd ON k.l_returnflag = kd.l_returnflag AND k.u = kd.t GROUP BY 1, 2),
f AS (SELECT k.l_returnflag, k.t, -avg(o.den) / any_value(m.den) AS lof FROM k JOIN den o ON k.l_returnflag = o.l_returnflag AND k.u = o.t JOIN den m ON k.l_returnflag = m.l_returnflag AND k.t = m.t GROUP BY 1, 2)"""


_put("flag_lof", lambda s, d: _each(_days(s, d).flagLOF(["a", "b"], n=20, thresh=2.0), "ab"), f"""WITH {_lof("0", "abs(x.a - y.a) + abs(x.b - y.b)")}
SELECT g.l_returnflag, g.t, CASE WHEN lof < -2 THEN 255.0 ELSE -1.0 END AS flag, unnest(['a', 'b']) AS field FROM g LEFT JOIN f ON g.l_returnflag = f.l_returnflag AND g.t = f.t""")
_put("assign_lof", lambda s, d: _values(_days(s, d).assignLOF(["a", "b"], target="s", n=20, freq="90D"), "s"), f"""WITH {_lof(f"(t - min(t) OVER (PARTITION BY l_returnflag) // {_D} * {_D}) // {90 * _D}", "sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2)")}
SELECT g.l_returnflag, g.t, round(lof + {_EPS}, 5) AS value FROM g LEFT JOIN f ON g.l_returnflag = f.l_returnflag AND g.t = f.t""")
_put("knn_score", lambda s, d: _values(_days(s, d).assignKNNScore(["a", "b"], target="s", n=5, freq="30D"), "s", 4), f"""WITH {_G}, {_SEG}, p AS (SELECT x.l_returnflag, x.t, sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2) AS d,
row_number() OVER (PARTITION BY x.l_returnflag, x.t ORDER BY sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2)) AS r FROM s x JOIN s y ON x.l_returnflag = y.l_returnflag AND x.seg = y.seg AND x.t <> y.t)
SELECT g.l_returnflag, g.t, round(sum(d) + {_EPS}, 4) AS value FROM g LEFT JOIN p ON g.l_returnflag = p.l_returnflag AND g.t = p.t AND r <= 5 GROUP BY 1, 2""")
_put("flag_mv_scores", lambda s, d: _each(_days(s, d).flagMVScores(["a", "b"], n=5, window="90D"), "ab"))
_put("flag_mv_scores_reduced", lambda s, d: _each(_days(s, d).flagMVScores(["a", "b"], n=5, window="90D", stray_range="20D"), "ab"))
_put("flag_plateau", lambda s, d: _flags(_days(s, d).flagPlateau("a", min_length="3D", max_length="10D", min_jump=3.0), "a"))
_put("flag_pattern_dtw", lambda s, d: _flags(_days(s, d).flagPatternByDTW("a", reference=[(i * _D, v) for i, v in enumerate((25.0, 27.0, 24.0))], max_distance=0.4), "a"))
_put("polynomial_residuals", lambda s, d: _values(_qc(s, d).calculatePolynomialResiduals("x", window="1D", order=2, min_periods=5), digits=4), f"""WITH {_E},
w AS (SELECT a.event_type, a.t, a.v, (b.t - a.t) / 3.6e9 AS h, b.v AS y FROM e a JOIN e b ON a.event_type = b.event_type AND b.t BETWEEN a.t - {_D // 2} AND a.t + {_D // 2} AND b.v IS NOT NULL),
m AS (SELECT event_type, t, any_value(v) AS v, count(*) AS s0, sum(h) AS s1, sum(h ** 2) AS s2, sum(h ** 3) AS s3, sum(h ** 4) AS s4, sum(y) AS r0, sum(y * h) AS r1, sum(y * h ** 2) AS r2 FROM w GROUP BY 1, 2),
p AS (SELECT *, (r0 * (s2 * s4 - s3 * s3) - s1 * (r1 * s4 - s3 * r2) + s2 * (r1 * s3 - s2 * r2)) / nullif(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2), 0) AS fit FROM m WHERE s0 >= 5 AND v IS NOT NULL)
SELECT e.event_type, e.t, round(e.v - fit + {_EPS}, 4) AS value FROM e LEFT JOIN p ON e.event_type = p.event_type AND e.t = p.t""")
_put("fit_polynomial", lambda s, d: _values(_qc(s, d).fitPolynomial("x", window="1D", order=1, min_periods=3), digits=3), f"""WITH {_E} SELECT event_type, t, round(CASE WHEN v IS NOT NULL AND count(v) OVER w >= 3 THEN regr_intercept(v, h) OVER w + regr_slope(v, h) OVER w * h END + {_EPS}, 3) AS value
FROM (SELECT *, CASE WHEN v IS NOT NULL THEN (t - min(t) OVER (PARTITION BY event_type)) / 3.6e9 END AS h FROM e) WINDOW w AS {_O} RANGE BETWEEN {_D // 2} PRECEDING AND {_D // 2} FOLLOWING)""")
_put("fit_lowpass", lambda s, d: _values(_days(s, d).fitLowpassFilter("a", cutoff=0.05), "a", 4))
_put("correct_offset", lambda s, d: _values(_days(s, d).correctOffset("a", max_jump=5.0, spread=3.0, window="20D", min_periods=5), "a", 4))
_put("regime_anomaly", lambda s, d: _flags(_days(s, d).copyField("a", target="k").assignChangePointCluster("k", stat_func="mean", thresh_func=4.0, window="20D", min_periods=5).flagRegimeAnomaly("a", cluster_field="k", spread=1.0), "a"))
_put("interpolate_gaps", lambda s, d: _values(_qc(s, d).interpolateNANs("x", method="time", gap_limit=2)), value="coalesce(v, CASE WHEN pv IS NOT NULL AND nv IS NOT NULL AND lag(v) OVER o IS NOT NULL AND lead(v) OVER o IS NOT NULL THEN pv + (nv - pv) * (t - pt) / (nt - pt) END)", w="WINDOW o AS (PARTITION BY event_type ORDER BY t)",
     more=f"m AS (SELECT *, lag(v) OVER o AS pv, lead(v) OVER o AS nv, lag(t) OVER o AS pt, lead(t) OVER o AS nt FROM e WINDOW o AS {_O}))")


def _correct_drift(spark: SparkSession, d: str) -> DataFrame:
    """Readings of both fields with the maintenance table as a field; an open maintenance lasts until the next begins, and ends the stretch before it."""
    m = _spans(spark, d).groupBy("station_id", "a").agg(F.max("b").cast("double").alias("v"))
    out = []
    for table, field in (("data_sm1", "sm1"), ("data_sm2", "sm2")):
        sm = spark.read.parquet(f"{d}/{table}.parquet").filter(f"station_id is not null and {field} between 0 and 100").groupBy("station_id", "ts").agg(F.max(field).alias(field))
        qc = QC.from_long(sm, "ts", field, field, keys=["station_id"]).merge(QC.from_long(m, "a", "v", "maint", keys=["station_id"]))
        out.append(_values(qc.correctDrift(field, maintenance_field="maint", model="linear"), field).withColumn("field", F.lit(field)))
    return reduce(DataFrame.union, out)


def _drift_sql(field: str) -> str:
    """A stretch from a maintenance's end to the next one's start is bent by the difference between its last five values and the first five of the next stretch."""
    return f"""SELECT '{field}' AS field, x.station_id, x.t, round(CASE WHEN n < 2 OR g IS NULL THEN v ELSE v + (x.t - t0) / (t1 - t0) * (shift - target) END + {_EPS}, 5) AS value
FROM {field}_r x LEFT JOIN {field}_s USING (station_id, g)"""


def _drift_parts(table: str, field: str) -> str:
    return f"""{field}_v AS (SELECT station_id, epoch_us(ts) AS t, max({field}) AS v FROM {table} WHERE station_id IS NOT NULL AND ts IS NOT NULL AND {field} BETWEEN 0 AND 100 GROUP BY 1, 2),
{field}_r AS (SELECT v.station_id, t, v, CASE WHEN e >= t THEN g END AS g FROM {field}_v v ASOF LEFT JOIN spans ON v.station_id = spans.station_id AND v.t >= spans.s),
{field}_k AS (SELECT *, row_number() OVER (PARTITION BY station_id, g ORDER BY t) AS i, row_number() OVER (PARTITION BY station_id, g ORDER BY t DESC) AS j FROM {field}_r WHERE g IS NOT NULL),
{field}_g AS (SELECT station_id, g, count(*) AS n, min(t) AS t0, max(t) AS t1, avg(CASE WHEN i <= 5 THEN v END) AS start, avg(CASE WHEN j <= 5 THEN v END) AS target FROM {field}_k GROUP BY 1, 2),
{field}_s AS (SELECT a.*, b.start AS shift FROM {field}_g a LEFT JOIN {field}_g b ON a.station_id = b.station_id AND a.g + 1 = b.g)"""


_put("correct_drift", _correct_drift, f"""WITH {_SPANS}, u AS (SELECT station_id, a, max(b) AS b FROM m GROUP BY 1, 2),
sp AS (SELECT station_id, b AS s, lead(a) OVER (PARTITION BY station_id ORDER BY a) AS e, row_number() OVER (PARTITION BY station_id ORDER BY a) AS g FROM u), spans AS (SELECT * FROM sp WHERE e IS NOT NULL),
{_drift_parts("data_sm1", "sm1")}, {_drift_parts("data_sm2", "sm2")} {_drift_sql("sm1")} UNION ALL {_drift_sql("sm2")}""")


# ---- other grids: reindex, and expressions


def _reindexed(f: int, value: str, join: str) -> str:
    """A grid of step ``f`` from the floor of the first stamp to the ceiling of the last, with a joined value."""
    return f"""WITH {_E}, b AS (SELECT event_type, floor(min(t) / {f})::BIGINT AS p, ceil(max(t) / {f})::BIGINT AS q FROM e GROUP BY 1), g AS (SELECT event_type, unnest(range(p, q + 1)) * {f} AS t FROM b)
SELECT g.event_type, g.t, round({value} + {_EPS}, 5) AS value FROM g {join}"""


def _near(cond: str) -> str:
    return f"LEFT JOIN e ON g.event_type = e.event_type AND {cond} GROUP BY 1, 2"


for _m, _c in {"froll": f"e.t > g.t - {6 * _H} AND e.t <= g.t", "broll": f"e.t >= g.t AND e.t < g.t + {6 * _H}", "nroll": f"e.t BETWEEN g.t - {3 * _H} AND g.t + {3 * _H}"}.items():
    _put(f"reindex_{_m}", lambda s, d, m=_m: _values(_qc(s, d).reindex("x", index="12h", method=m, tolerance="6h", data_aggregation="mean")), _reindexed(12 * _H, "avg(v)", _near(_c)))
_put("reindex_nshift", lambda s, d: _values(_qc(s, d).reindex("x", index="3h", method="nshift")), _reindexed(3 * _H, "arg_min(v, (abs(e.t - g.t), -e.t))", _near(f"e.t >= g.t - {3 * _H // 2} AND e.t < g.t + {3 * _H // 2} AND v IS NOT NULL")))
_put("reindex_tolerance", lambda s, d: _values(_qc(s, d).reindex("x", index="3h", method="bagg", tolerance="1h", data_aggregation="sum", broadcast=False)), _reindexed(3 * _H, "sum(v)", _near(f"e.t >= g.t AND e.t <= g.t + {_H}")))
_put("reindex_broadcast", lambda s, d: _values(_qc(s, d).reindex("x", index="20min", method="bagg", tolerance="1h", data_aggregation="mean")), f"""WITH {_E}, b AS (SELECT event_type, floor(min(t) / {_H // 3})::BIGINT AS p, ceil(max(t) / {_H // 3})::BIGINT AS q FROM e GROUP BY 1),
g AS (SELECT event_type, unnest(range(p, q + 1)) * {_H // 3} AS t FROM b), a AS (SELECT event_type, t // {_H // 3} AS cell, avg(v) AS value FROM e GROUP BY 1, 2),
n AS (SELECT g.*, e.t AS s FROM g ASOF LEFT JOIN e ON g.event_type = e.event_type AND g.t <= e.t)
SELECT n.event_type, n.t, round(a.value + {_EPS}, 5) AS value FROM n LEFT JOIN a ON n.event_type = a.event_type AND n.s - n.t <= {_H} AND a.cell = n.s // {_H // 3}""")
_put("reindex_match", lambda s, d: _values(_third(s, d).reindex("x", index="k", method="match")), f"WITH {_E} SELECT event_type, t, round(v + {_EPS}, 5) AS value FROM e WHERE event_id % 3 = 0")
_put("reindex_mshift", lambda s, d: _values(_third(s, d).reindex("k", index="x", method="mshift"), "k", 4), f"""WITH {_E}, k AS (SELECT event_type, t, event_id * 0.5 AS v FROM e WHERE event_id % 3 = 0),
l AS (SELECT e.event_type, e.t, k.t AS t0, k.v AS v0 FROM e ASOF LEFT JOIN k ON e.event_type = k.event_type AND e.t >= k.t), r AS (SELECT l.*, k.t AS t1, k.v AS v1 FROM l ASOF LEFT JOIN k ON l.event_type = k.event_type AND l.t <= k.t)
SELECT event_type, t, round(CASE WHEN t1 = t0 THEN v0 WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) END + {_EPS}, 4) AS value FROM r""")
_put("reindex_invert", lambda s, d: _values(_qc(s, d).copyField("x", target="g").resample("g", freq="6h").reindex("g", index="x", method="invert", data_aggregation="mean"), "g"), value=f"avg(v) OVER (PARTITION BY event_type, t // {6 * _H})")


def _third(spark: SparkSession, d: str) -> QC:
    """x, and a field k with every third of its stamps."""
    e = _events(spark, d)
    return _qc(spark, d).merge(QC.from_long(e.filter("event_id % 3 = 0").withColumn("k", F.col("event_id") * 0.5), "ts", "k", "k", keys=["event_type"]))


_put("expression_mad", lambda s, d: _values(_two(s, d).processGeneric(["x", "y"], target="z", func="madScore(x) + mad(y)"), "z"), value="(v - md) / median(abs(v - md)) OVER w + median(abs(y - my)) OVER w", w="WINDOW w AS (PARTITION BY event_type)",
     more="m AS (SELECT *, median(v) OVER (PARTITION BY event_type) AS md, median(y) OVER (PARTITION BY event_type) AS my FROM e)")
_put("expression_functions", lambda s, d: _values(_two(s, d).processGeneric(["x", "y"], target="z", func="scale(x, target_range=(-1, 1)) + clip(y, 10, 90) + cv(y) + count(x) / len(x) + log(y + 1)"), "z"),
     value="(v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 2 - 1 + greatest(least(y, 90), 10) + (stddev_samp(y) OVER w / (max(y) OVER w - min(y) OVER w)) / ((avg(y) OVER w - min(y) OVER w) / (max(y) OVER w - min(y) OVER w)) + 1.0 * count(v) OVER w / count(*) OVER w + ln(y + 1)", w="WINDOW w AS (PARTITION BY event_type)")
_put("expression_valid", lambda s, d: _flags(_qc(s, d, "user_id").flagGeneric("x", func="isValid(x, max_nan_total=1) & isValid(x, max_nan_consec=1)")), f"""WITH {_E}, r AS (SELECT *, count(CASE WHEN v IS NULL THEN 1 END) OVER (PARTITION BY user_id) AS n, v IS NULL AND lag(v) OVER o IS NULL AND row_number() OVER o > 1 AS two FROM e WINDOW o AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, t, CASE WHEN n <= 1 AND NOT bool_or(two) OVER (PARTITION BY user_id) THEN 255.0 ELSE -1.0 END AS flag FROM r""")
_put("rolling_horizontal", lambda s, d: _values(_two(s, d).rolling(["x", "y"], target="z", func="mean", window="6h", center=False), "z"), value="(coalesce(sum(v) OVER w, 0) + coalesce(sum(y) OVER w, 0)) / (count(v) OVER w + count(y) OVER w)", w=_TIME)
_put("rolling_skew", _roll("skew", window="1D", center=False, min_periods=5), f"WITH {_E} SELECT event_type, t, round(CASE WHEN count(v) OVER w >= 5 THEN skewness(v) OVER w END + {_EPS}, 4) AS value FROM e WINDOW w AS {_O} RANGE BETWEEN {_D - 1} PRECEDING AND CURRENT ROW)")
_put("rolling_kurt", _roll("kurt", window="1D", center=False, min_periods=5), f"WITH {_E} SELECT event_type, t, round(CASE WHEN count(v) OVER w >= 5 THEN kurtosis(v) OVER w END + {_EPS}, 4) AS value FROM e WINDOW w AS {_O} RANGE BETWEEN {_D - 1} PRECEDING AND CURRENT ROW)")
_put("field_tools", lambda s, d: _two(s, d).copyField("x", target="z").renameField("z", new_name="w").dropField("x").table().select("event_type", F.unix_micros("ts").alias("t"), "y__data", "w__data"), f"WITH {_E} SELECT event_type, t, y AS y__data, v AS w__data FROM e")
_put("flag_by_click", lambda s, d: _flags(_qc(s, d).flagByClick("x", stamps=["2024-01-02 03:04:05"])), flag="t = epoch_us(TIMESTAMP '2024-01-02 03:04:05')")


def _marks(spark: SparkSession, d: str) -> DataFrame:
    """Hand marks between readings: on at every hundredth event, off at the next fiftieth."""
    e = spark.read.parquet(f"{d}/events.parquet").filter("event_id % 50 = 0")
    return e.select("event_type", micros(e, "ts").alias("t"), F.when(F.col("event_id") % 100 == 0, 1.0).otherwise(0.0).alias("value"))


_MARKS = f"{_E}, k AS (SELECT event_type, t, event_id % 100 = 0 AS m FROM e WHERE event_id % 50 = 0)"
_STEP = "SELECT e.event_type, e.t, CASE WHEN {} THEN 255.0 ELSE -1.0 END AS flag FROM e ASOF LEFT JOIN k ON e.event_type = k.event_type AND e.t {} k.t"
for _m, _q in {"ontime": "SELECT e.event_type, e.t, CASE WHEN k.m THEN 255.0 ELSE -1.0 END AS flag FROM e LEFT JOIN k ON e.event_type = k.event_type AND e.t = k.t", "right-open": _STEP.format("k.m", ">="), "left-open": _STEP.format("k.m", ">"),
               "closed": "SELECT l.event_type, l.t, CASE WHEN l.m OR k.m THEN 255.0 ELSE -1.0 END AS flag FROM (SELECT e.event_type, e.t, k.m FROM e ASOF LEFT JOIN k ON e.event_type = k.event_type AND e.t >= k.t) l ASOF LEFT JOIN k ON l.event_type = k.event_type AND l.t > k.t"}.items():
    _put(f"flag_manual_{_m.replace('-', '_')}", lambda s, d, m=_m: _flags(_qc(s, d).flagManual("x", mdata=_marks(s, d), method=m)), f"WITH {_MARKS} {_q}")
_CONFIG = """
varname ; test
x       ; flagRange(min=5, max=150)      # limits
'[xy]'  ; flagMissing()
y       ; flagGeneric(func=(x > 30) & (y > 120), flag=DOUBTFUL)
"""
_put("config_text", lambda s, d: _flags(run(_two(s, d), read_text(_CONFIG)), "y"), f"WITH {_E} SELECT event_type, t, CASE WHEN v > 30 AND v <= 150 AND y > 120 THEN 25.0 ELSE -1.0 END AS flag FROM e")
_put("output_table", lambda s, d: _two(s, d).flagRange("x", max=150).table().select("event_type", F.unix_micros("ts").alias("t"), F.col("x__data"), F.when(F.col("x__flags") > 0, 255.0).otherwise(-1.0).alias("x__flags"), "y__data"), f"WITH {_E} SELECT event_type, t, v AS x__data, CASE WHEN v > 150 THEN 255.0 ELSE -1.0 END AS x__flags, y AS y__data FROM e")
_put("plot_frame", lambda s, d: _qc(s, d).flagRange("x", max=150).plot_frame("x").select("event_type", F.unix_micros("ts").alias("t"), "value", "test"), f"WITH {_E} SELECT event_type, t, v AS value, CASE WHEN v > 150 THEN 'flagRange' END AS test FROM e")
