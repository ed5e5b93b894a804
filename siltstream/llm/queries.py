"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cells import number
from ..plans.ordered import micros
from ..plans.scratch import stage
from ..queries.problems import usable as _usable
from . import pii
from .mixing import mix_report, mix_sources
from .nearest import nearest_in_time
from .packing import harmonic, pack_documents, pack_report
from .runs import collapse_runs
from .tokens import token_sizes


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _readings(spark: SparkSession, d: str, table: str, value: str) -> DataFrame:
    """Usable readings: entity, id, t, x."""
    df = _table(spark, d, table)
    return df.select(F.col("station_id").alias("entity"), F.col("reading_id").alias("id"), micros(df, "ts").alias("t"), number(F.col(value)).alias("x")).dropna()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = nearest_in_time(_readings(spark, d, "data_sm1", "sm1"), _readings(spark, d, "data_sm2", "sm2"), 300_000_000)
    return out.select(F.col("left_id").alias("sm1_reading_id"), F.col("right_id").alias("sm2_reading_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = collapse_runs(_readings(spark, d, "data_sm1", "sm1"), 0.01, 3 * 3600 * 1_000_000, 3)
    return out.select(F.col("entity").alias("station_id"), F.col("first_id").alias("first_reading_id"), F.col("last_id").alias("last_reading_id"))


def p2_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every usable SM1 reading in exactly one run, singles included."""
    out = collapse_runs(_readings(spark, d, "data_sm1", "sm1"), 0.01, 3 * 3600 * 1_000_000, 1)
    return out.select(F.col("entity").alias("station_id"), F.col("first_id").alias("first_reading_id"), F.col("last_id").alias("last_reading_id"), F.col("n_events").alias("n"), "duration_us")


def p2_levels(spark: SparkSession, d: str) -> DataFrame:
    """Runs of at least three readings near one level: a drift within the tolerance of each step is cut into levels."""
    out = collapse_runs(_readings(spark, d, "data_sm1", "sm1"), 0.01, 3 * 3600 * 1_000_000, 3, level_penalty=2.0)
    return out.select(F.col("entity").alias("station_id"), F.col("first_id").alias("first_reading_id"), F.col("last_id").alias("last_reading_id"), F.col("n_events").alias("n"), "duration_us", "low", "high")


def p6_packs(spark: SparkSession, d: str) -> DataFrame:
    """Every document in packs of every capacity."""
    sized = stage(token_sizes(_table(spark, d, "documents"), ["doc_id"]), "sizes")
    return pack_documents(sized, _table(spark, d, "token_packs"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """How full the packs are: of harmonic packing with the room refilled (the packs of ``p6_packs``), and of the plain form."""
    sized = stage(token_sizes(_table(spark, d, "documents"), ["doc_id"]), "sizes")
    caps = _table(spark, d, "token_packs")
    return pack_report(pack_documents(sized, caps)).withColumn("method", F.lit("refilled")).union(pack_report(harmonic(sized, caps)).withColumn("method", F.lit("plain")))


def _in_characters(spark: SparkSession, d: str) -> DataFrame:
    """Documents measured in characters, which SQL can count."""
    return _table(spark, d, "documents").select("doc_id", "source", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_tokens"))


def p6_parts_chars(spark: SparkSession, d: str) -> DataFrame:
    """The packs of ``p6_packs``, but in characters, without their names: every part of every document, and whether its pack holds no more than its capacity."""
    out = pack_documents(_in_characters(spark, d), _table(spark, d, "token_packs"))
    used = out.groupBy("capacity_tokens", "pack_key").agg(F.sum("n_tokens").alias("used"))
    fits = F.col("pack_key").isNull() | (F.col("used") <= F.col("capacity_tokens"))
    return out.join(used.filter("pack_key is not null"), ["capacity_tokens", "pack_key"], "left").select("capacity_tokens", "doc_id", F.col("part").cast("long").alias("part"), "start_token", "n_tokens", fits.alias("fits"))


def p7_mix_chars(spark: SparkSession, d: str) -> DataFrame:
    """The mix measured in characters."""
    return mix_sources(_in_characters(spark, d), _table(spark, d, "mix_targets"))


def p7_shares_chars(spark: SparkSession, d: str) -> DataFrame:
    out = mix_report(_in_characters(spark, d), _table(spark, d, "mix_targets"))
    return out.select("source", "target_share", F.round("reached_share", 9).alias("reached_share"), "docs", "tokens", "asked", "docs_used", "tokens_used", "max_repeats", "most_repeats", "reachable")


def _sized_sources(spark: SparkSession, d: str) -> DataFrame:
    return stage(token_sizes(_table(spark, d, "documents"), ["doc_id", "source"]), "sizes")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Which documents are used how often."""
    return mix_sources(_sized_sources(spark, d), _table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each forum."""
    return mix_report(_sized_sources(spark, d), _table(spark, d, "mix_targets"))


def _scores(spark: SparkSession, d: str) -> tuple[DataFrame, pii.Scores]:
    docs = _table(spark, d, "documents")
    return docs, pii.learn(docs, _table(spark, d, "directory_names"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs, scores = _scores(spark, d)
    return pii.extract(docs, scores)


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    docs, scores = _scores(spark, d)
    return pii.redact(docs, scores)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p2_found": p2_found, "p2_runs": p2_runs, "p2_levels": p2_levels, "p6_packs": p6_packs, "p6_report": p6_report,
    "p6_parts_chars": p6_parts_chars, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_mix_chars": p7_mix_chars, "p7_shares_chars": p7_shares_chars, "p8_found": p8_found, "p8_redacted": p8_redacted,
}


_MIX = """
WITH d AS (SELECT doc_id, source, coalesce(length(text), 0)::BIGINT AS n_tokens, md5(doc_id || '-1') AS key FROM documents WHERE source IS NOT NULL),
s AS (SELECT source, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY 1),
t AS (SELECT m.source, target_share, greatest(coalesce(max_repeats, 1), 0) AS max_repeats, coalesce(docs, 0) AS docs, coalesce(tokens, 0) AS tokens FROM mix_targets m LEFT JOIN s ON m.source = s.source),
p AS (SELECT *, floor(target_share * sum(tokens) OVER ())::BIGINT AS asked FROM t), b AS (SELECT *, least(asked, tokens * max_repeats) AS budget FROM p),
e AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs FROM b), r AS (SELECT *, budget - epochs * tokens AS remainder FROM e),
c AS (SELECT d.*, r.epochs, r.remainder, r.max_repeats, sum(n_tokens) OVER (PARTITION BY d.source ORDER BY key, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN r ON d.source = r.source),
mix AS (SELECT doc_id, source, n_tokens, (epochs + CASE WHEN remainder > 0 AND epochs < max_repeats AND upto <= remainder THEN 1 ELSE 0 END)::INT AS repeats FROM c)
"""

_RUNS = f"""
WITH u AS ({_usable("data_sm1", "sm1")}),
s AS (SELECT *, CASE WHEN abs(x - lag(x) OVER w) <= 0.01 + 1e-9 AND epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 10800000000 THEN 0 ELSE 1 END AS cut
      FROM u WINDOW w AS (PARTITION BY station_id ORDER BY ts, reading_id)),
r AS (SELECT *, sum(cut) OVER (PARTITION BY station_id ORDER BY ts, reading_id) AS run FROM s),
g AS (SELECT station_id, run, arg_min(reading_id, (ts, reading_id)) AS first_reading_id, arg_max(reading_id, (ts, reading_id)) AS last_reading_id,
      count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us FROM r GROUP BY 1, 2)
"""

SQL: dict[str, str] = {
    "p6_parts_chars": """
WITH d AS (SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n FROM documents), c AS (SELECT DISTINCT capacity_tokens::BIGINT AS capacity_tokens FROM token_packs WHERE capacity_tokens >= 1),
x AS (SELECT *, unnest(range(0, greatest(1, (n + capacity_tokens - 1) // capacity_tokens))) AS part FROM d, c)
SELECT capacity_tokens, doc_id, part, part * capacity_tokens AS start_token, least(capacity_tokens, n - part * capacity_tokens) AS n_tokens, true AS fits FROM x""",
    "p7_mix_chars": f"{_MIX} SELECT doc_id, source, n_tokens, repeats FROM mix WHERE repeats > 0",
    "p7_shares_chars": f"""{_MIX}, u AS (SELECT source, count(*) AS docs_used, sum(n_tokens * repeats)::BIGINT AS tokens_used, max(repeats) AS most_repeats FROM mix WHERE repeats > 0 GROUP BY 1)
SELECT r.source, target_share, round(coalesce(tokens_used, 0) / sum(tokens_used) OVER (), 9) AS reached_share, docs, tokens, asked, coalesce(docs_used, 0) AS docs_used, coalesce(tokens_used, 0) AS tokens_used,
max_repeats, coalesce(most_repeats, 0) AS most_repeats, asked <= tokens * max_repeats AS reachable FROM r LEFT JOIN u ON r.source = u.source""",
    "p1_found": f"""
WITH l AS ({_usable("data_sm1", "sm1")}), r AS ({_usable("data_sm2", "sm2")}),
c AS (
  SELECT l.reading_id AS sm1_reading_id, r.reading_id AS sm2_reading_id, abs(epoch_us(l.ts) - epoch_us(r.ts)) AS d FROM l ASOF JOIN r ON l.station_id = r.station_id AND l.ts >= r.ts
  UNION ALL
  SELECT l.reading_id, r.reading_id, abs(epoch_us(l.ts) - epoch_us(r.ts)) FROM l ASOF JOIN r ON l.station_id = r.station_id AND l.ts < r.ts)
SELECT sm1_reading_id, arg_min(sm2_reading_id, (d, sm2_reading_id)) AS sm2_reading_id FROM c WHERE d <= 300000000 GROUP BY sm1_reading_id
""",
    "p2_found": f"{_RUNS} SELECT station_id, first_reading_id, last_reading_id FROM g WHERE n >= 3",
    "p2_runs": f"{_RUNS} SELECT station_id, first_reading_id, last_reading_id, n, duration_us FROM g",
}
