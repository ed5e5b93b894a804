"""Tests on unbounded input: row-wise tests run as they are, periods need a watermark, runs of constants keep state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..flags import BAD, UNFLAGGED


def flag_range(stream: DataFrame, value: str, low: float, high: float, flag: float = BAD) -> DataFrame:
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return stream.withColumn("flag", F.when((v < low) | (v > high), F.lit(flag)).otherwise(F.lit(UNFLAGGED)))


def flag_missing(stream: DataFrame, value: str, flag: float = BAD) -> DataFrame:
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return stream.withColumn("flag", F.when(v.isNull(), F.lit(flag)).otherwise(F.lit(UNFLAGGED)))


def resample(stream: DataFrame, time: str, value: str, keys: list[str], freq: str, late: str, func: str = "mean") -> DataFrame:
    """Statistics of periods of time; rows later than ``late`` are dropped by the watermark."""
    agg = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[func]
    return stream.withWatermark(time, late).groupBy(F.window(time, freq), *keys).agg(agg(value).alias("value"), F.count(value).alias("n")).select(*keys, F.col("window.start").alias("ts"), "value", "n")


def constants(stream: DataFrame, key: str, time: str, value: str, least: int, tolerance: float = 0.0) -> DataFrame:
    """A row for each run of at least ``least`` (nearly) constant values, when it ends: key, start, end, n. State is one run for each key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, end, last, n = state.get if state.exists else (None, None, None, 0)
        out = []
        for row in pd.concat(list(batches)).sort_values(time).itertuples(index=False):
            t, v = getattr(row, time), getattr(row, value)
            if v is None or v != v:
                continue
            if n and abs(v - last) <= tolerance:
                end, last, n = t, v, n + 1
            else:
                if n >= least:
                    out.append((k[0], start, end, n))
                start, end, last, n = t, t, v, 1
        state.update((start, end, last, n))
        yield pd.DataFrame(out, columns=[key, "start", "end", "n"])

    kind = dict(stream.dtypes)
    return stream.select(key, time, value).groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kind[key]}, start {kind[time]}, end {kind[time]}, n long", f"start {kind[time]}, end {kind[time]}, last double, n long", "append", GroupStateTimeout.NoTimeout)
