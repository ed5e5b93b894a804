"""Queries for the data problems whose operators belong to the core."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.imputation import chained_imputation
from ..operators.regular import regular_series
from ..operators.spikes import both_fields, implausible
from ..plans.cells import number
from ..plans.cells import word as norm_word
from ..plans.ordered import micros

#: Numeric field and word field of each sensor table.
_TABLES = {"data_sm1": ("sm1", "soil_class"), "data_sm2": ("sm2", "surface_state")}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _imputed(spark: SparkSession, d: str, table: str, readings: DataFrame | None = None, **kw) -> DataFrame:
    value, word = _TABLES[table]
    # a vocabulary is a fixed list, so it may come to the driver
    names = sorted(r[0] for r in _table(spark, d, "class_names").filter(F.col("vocab") == word).select("class_name").distinct().limit(1001).collect() if r[0])
    finite = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
    return chained_imputation(
        _table(spark, d, table) if readings is None else readings, "reading_id", "station_id", "ts", {value: number, "battery": finite}, {word: names},
        networks=_table(spark, d, "stations").select("station_id", "network"), bounds={value: (0.0, 100.0)}, **kw,
    )


def p3_filled(spark: SparkSession, d: str) -> DataFrame:
    """Every reading of both tables with its cells filled and marked."""
    parts = []
    for table, (value, word) in _TABLES.items():
        f = _imputed(spark, d, table)
        parts.append(f.select(F.lit(value).alias("field"), "reading_id", "station_id", F.col(value).alias("value"), F.col(f"{value}_filled").alias("value_filled"), F.col(word).alias("word"), F.col(f"{word}_filled").alias("word_filled")))
    return reduce(DataFrame.union, parts)


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    """Held-out accuracy: every twentieth valid cell is hidden and filled. Errors (median, and root of the mean square, which faulty readings among the hidden make large) of the fill, of the fill without its drawn residual, of a straight line between the neighbours in time, and of the station's mean; share of right words beside that of the most usual word of the station."""
    out = []
    for table, (value, word) in _TABLES.items():
        df = _table(spark, d, table).dropDuplicates(["reading_id"]).filter("station_id is not null")
        hide = lambda k: F.pmod(F.xxhash64("reading_id", F.lit(k)), F.lit(20)) == 0
        masked = df.withColumns({value: F.when(~hide(1), F.col(value)), word: F.when(~hide(2), F.col(word))})
        fills = _imputed(spark, d, table, masked, expected=True).select("reading_id", F.col(value).alias("fill"), f"{value}_expected", F.col(word).alias("fill_word"))
        w = Window.partitionBy("station_id").orderBy("ts", "reading_id")
        back = Window.partitionBy("station_id").orderBy(F.col("ts").desc(), F.col("reading_id").desc())
        seen, t = F.when(~hide(1), number(F.col(value))), micros(df, "ts")
        p = F.last(F.when(seen.isNotNull(), F.struct(t.alias("t"), seen.alias("x"))), True)
        plain = df.select("reading_id", "station_id", number(F.col(value)).alias("truth"), norm_word(F.col(word)).alias("word"), hide(1).alias("h"), hide(2).alias("hw"), t.alias("t"),
                          p.over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("a"), p.over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("b"))
        line = F.coalesce(F.col("a.x") + (F.col("b.x") - F.col("a.x")) * F.try_divide(F.col("t") - F.col("a.t"), F.col("b.t") - F.col("a.t")), F.col("a.x"), F.col("b.x"))
        usual = plain.filter("not hw and word is not null").groupBy("station_id", "word").count().groupBy("station_id").agg(F.max_by("word", F.struct("count", "word")).alias("usual"))
        mean = plain.filter("not h").groupBy("station_id").agg(F.avg("truth").alias("mean"))
        names = _table(spark, d, "class_names").filter(F.col("vocab") == word).select(norm_word(F.col("class_name")).alias("word"), F.lit(True).alias("valid")).distinct()
        j = plain.join(fills, "reading_id").join(mean, "station_id", "left").join(usual, "station_id", "left").join(names, "word", "left")
        rms = lambda c: F.sqrt(F.avg(F.when(F.col("h") & F.col("truth").isNotNull(), (c - F.col("truth")) ** 2)))
        mid = lambda c: F.percentile_approx(F.when(F.col("h") & F.col("truth").isNotNull(), F.abs(c - F.col("truth"))), 0.5, 10_000)
        right = lambda c: F.avg(F.when(F.col("hw") & F.col("valid"), (c == F.col("word")).cast("double")))
        out.append(j.agg(
            F.lit(value).alias("field"), F.count(F.when(F.col("h"), F.col("truth"))).alias("hidden"), rms(F.col("fill")).alias("rmse_fill"), rms(F.col(f"{value}_expected")).alias("rmse_expected"), rms(line).alias("rmse_line"), rms(F.col("mean")).alias("rmse_mean"),
            mid(F.col("fill")).alias("median_fill"), mid(F.col(f"{value}_expected")).alias("median_expected"), mid(line).alias("median_line"), mid(F.col("mean")).alias("median_mean"),
            right(norm_word(F.col("fill_word"))).alias("words_right"), right(F.col("usual")).alias("words_usual")))
    return reduce(DataFrame.union, out)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for table, (value, word) in _TABLES.items():
        f = _imputed(spark, d, table).filter(F.col(f"{value}_filled") | F.col(f"{word}_filled"))
        case = lambda c: F.when(F.col(f"{c}_filled") & F.col(c).isNotNull(), F.lit(c))
        parts.append(f.select("reading_id", F.explode(F.array(case(value), case(word))).alias("field")).filter("field is not null").select("field", "reading_id"))
    return reduce(DataFrame.union, parts)


def _both(spark: SparkSession, d: str) -> DataFrame:
    return both_fields(*((_table(spark, d, t), v, "reading_id", "station_id", "ts", v) for t, (v, _) in _TABLES.items()))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Flags of the tail model at a risk of one reading in a thousand; what it finds is checked at eight times the 90th percentile."""
    return implausible(_both(spark, d), risk=1e-3, confirm=8.0).select("field", F.col("id").alias("reading_id"), "kind")


def p4_tail(spark: SparkSession, d: str) -> DataFrame:
    """Flags of the tail model alone, unchecked: its cutoff decides."""
    return implausible(_both(spark, d), risk=1e-3).select("field", F.col("id").alias("reading_id"), "kind", F.round("cutoff", 6).alias("cutoff"))


def _series(spark: SparkSession, d: str) -> DataFrame:
    df = _table(spark, d, "data_sm2")
    return regular_series(df.select(F.col("station_id").alias("source"), F.col("reading_id").alias("id"), micros(df, "ts").alias("t"), number(F.col("sm2")).alias("x")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d).filter("status = 'filled'").select(F.col("source").alias("station_id"), "slot_epoch_s")


def p5_series(spark: SparkSession, d: str) -> DataFrame:
    """The whole regular series: time-weighted mean, readings and status of each quarter hour."""
    return _series(spark, d).select(F.col("source").alias("station_id"), "slot_epoch_s", F.round(F.col("value") + 3.1e-8, 6).alias("value"), "n_readings", F.round("covered_s", 3).alias("covered_s"), "status")


def p5_counter(spark: SparkSession, d: str) -> DataFrame:
    """A cumulative counter with resets: the running sum of the events' values by type, begun again at every fiftieth event, as increments by the hour."""
    e = spark.read.parquet(f"{d}/events.parquet")
    w = Window.partitionBy("event_type", F.floor(F.col("event_id") / 250)).orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    c = e.select(F.col("event_type").alias("source"), F.col("event_id").alias("id"), micros(e, "ts").alias("t"), F.sum("value").over(w).alias("x"))
    out = regular_series(c, 3600, kind="counter")
    return out.select(F.col("source").alias("event_type"), "slot_epoch_s", F.round(F.col("value") + 3.1e-7, 4).alias("increment"), "n_readings", F.round("covered_s", 3).alias("covered_s"), "status")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found, "p3_filled": p3_filled, "p3_scores": p3_scores, "p4_found": p4_found, "p4_tail": p4_tail, "p5_found": p5_found, "p5_series": p5_series, "p5_counter": p5_counter,
}


def usable(table: str, value: str, extra: str = "") -> str:
    return (
        f"SELECT DISTINCT {extra}station_id, reading_id, ts, {value} AS x FROM {table} WHERE station_id IS NOT NULL AND ts IS NOT NULL AND reading_id IS NOT NULL AND {value} IS NOT NULL "
        f"AND NOT isnan({value}) AND NOT isinf({value}) AND NOT ({value} = floor({value}) AND ({value} < 0 OR {value} > 100))"
    )


def _missing(table: str, value: str, word: str) -> str:
    norm = lambda c: f"trim(regexp_replace(lower({c}), '[\\s_-]+', ' ', 'g'))"
    return f"""
SELECT DISTINCT '{value}' AS field, reading_id FROM {table} WHERE {value} IS NULL OR isnan({value}) OR isinf({value}) OR ({value} = floor({value}) AND ({value} < 0 OR {value} > 100))
UNION ALL
SELECT DISTINCT '{word}', reading_id FROM {table} WHERE {word} IS NULL OR {norm(word)} NOT IN (SELECT {norm("class_name")} FROM class_names WHERE vocab = '{word}')"""


_SERIES = f"""
WITH u AS ({usable("data_sm2", "sm2")}),
n AS (SELECT station_id, epoch_us(ts) AS t, x, lead(epoch_us(ts)) OVER w AS t2, lead(x) OVER w AS x2 FROM u WINDOW w AS (PARTITION BY station_id ORDER BY ts, reading_id)),
pairs AS (SELECT *, (t + 450000000) // 900000000 AS c0, (t2 + 450000000) // 900000000 AS c1 FROM n WHERE t2 IS NOT NULL),
cells AS (SELECT *, unnest(range(c0, c1 + 1)) AS cell FROM pairs),
part AS (SELECT *, greatest(t, cell * 900000000 - 450000000) AS a, least(t2, cell * 900000000 + 450000000) AS b FROM cells),
shares AS (SELECT station_id, cell, greatest(b - a, 0) AS over, (x + x2) / 2 * greatest(b - a, 0) AS amount, t2 - t > 432000000000 AS silent FROM part),
own AS (SELECT station_id, (epoch_us(ts) + 450000000) // 900000000 AS cell, count(*) AS n, avg(x) AS mean FROM u GROUP BY 1, 2),
g AS (SELECT station_id, cell, sum(over) AS covered, sum(amount) AS amount, bool_or(silent) AS silent FROM shares GROUP BY 1, 2),
f AS (SELECT coalesce(g.station_id, own.station_id) AS station_id, coalesce(g.cell, own.cell) * 900 AS slot_epoch_s, coalesce(own.n, 0) AS n_readings, coalesce(covered, 0) AS covered,
      CASE WHEN own.n > 0 THEN 'measured' WHEN silent THEN 'uncovered' ELSE 'filled' END AS status, CASE WHEN covered > 0 THEN amount / covered ELSE mean END AS value
      FROM g FULL JOIN own ON g.station_id = own.station_id AND g.cell = own.cell)
"""

_COUNTER = """
WITH c AS (SELECT event_type, event_id, epoch_us(ts) AS t, sum(value) OVER (PARTITION BY event_type, event_id // 250 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS x FROM events),
n AS (SELECT *, lead(t) OVER w AS t2, lead(x) OVER w AS x2 FROM c WINDOW w AS (PARTITION BY event_type ORDER BY t, event_id)),
p AS (SELECT *, CASE WHEN x2 < x THEN x2 ELSE x2 - x END AS rise, unnest(range((t + 1800000000) // 3600000000, (t2 + 1800000000) // 3600000000 + 1)) AS cell FROM n WHERE t2 IS NOT NULL),
o AS (SELECT *, greatest(least(t2, cell * 3600000000 + 1800000000) - greatest(t, cell * 3600000000 - 1800000000), 0) AS over FROM p),
g AS (SELECT event_type, cell, sum(over) AS covered, sum(rise * over / greatest(t2 - t, 1)) AS amount, bool_or(t2 - t > 432000000000) AS silent FROM o GROUP BY 1, 2),
own AS (SELECT event_type, (t + 1800000000) // 3600000000 AS cell, count(*) AS n FROM c GROUP BY 1, 2)
SELECT coalesce(g.event_type, own.event_type) AS event_type, coalesce(g.cell, own.cell) * 3600 AS slot_epoch_s, CASE WHEN own.n > 0 OR NOT silent THEN round(coalesce(amount, 0) + 3.1e-7, 4) END AS increment, coalesce(own.n, 0) AS n_readings,
round(coalesce(covered, 0) / 1e6, 3) AS covered_s, CASE WHEN own.n > 0 THEN 'measured' WHEN silent THEN 'uncovered' ELSE 'filled' END AS status FROM g FULL JOIN own ON g.event_type = own.event_type AND g.cell = own.cell"""

SQL: dict[str, str] = {
    "p5_counter": _COUNTER,
    "p3_found": " UNION ALL ".join(_missing(t, *c) for t, c in _TABLES.items()),
    "p4_found": f"""
WITH u AS ({usable("data_sm1", "sm1", "'sm1' AS field, ")} UNION ALL {usable("data_sm2", "sm2", "'sm2' AS field, ")}),
m AS (SELECT *, abs(x - median(x) OVER (PARTITION BY field, station_id ORDER BY ts, reading_id ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)) AS d,
      CASE WHEN abs(x - lag(x) OVER (PARTITION BY field, station_id ORDER BY ts, reading_id)) <= 0.001 + 1e-9 THEN 0 ELSE 1 END AS cut FROM u),
s AS (SELECT *, sum(cut) OVER (PARTITION BY field, station_id ORDER BY ts, reading_id) AS stretch FROM m),
len AS (SELECT field, station_id, stretch, count(*) AS n FROM s GROUP BY 1, 2, 3),
usual AS (SELECT field, station_id, median(n) AS usual FROM len GROUP BY 1, 2),
q AS (SELECT field, station_id, greatest(quantile_cont(d, 0.9), 0.15) AS q FROM s GROUP BY 1, 2),
k AS (SELECT s.field, s.reading_id, CASE WHEN x < 0 OR x > 100 THEN 'impossible' WHEN n >= 16 AND n >= 8 * usual THEN 'stuck' WHEN d > 8 * q + 1e-9 THEN 'spike' END AS kind
      FROM s JOIN len USING (field, station_id, stretch) JOIN usual USING (field, station_id) JOIN q USING (field, station_id))
SELECT field, reading_id, kind FROM k WHERE kind IS NOT NULL""",
    "p5_found": f"{_SERIES} SELECT station_id, slot_epoch_s FROM f WHERE status = 'filled'",
    "p5_series": f"{_SERIES} SELECT station_id, slot_epoch_s, CASE WHEN status <> 'uncovered' THEN round(value + 3.1e-8, 6) END AS value, n_readings, round(covered / 1e6, 3) AS covered_s, status FROM f",
}
