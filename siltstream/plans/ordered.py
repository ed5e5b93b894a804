"""Ordered scans: sequences in time order without gathering a whole key in one task.

``ordered`` range-partitions rows by (keys, order). A key that holds a large share of all rows
is spread over as many partitions as its size asks for, and equal sort keys never part. A
kernel then walks each partition as a stream of batches. What it cannot settle at a
partition's two ends it returns as *edge* rows - a bounded number for each partition - and a
small second step joins the edges of neighbouring partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered(df: DataFrame, *cols: str) -> DataFrame:
    """Rows in ascending order of ``cols``, over partitions that follow each other."""
    return df.repartitionByRange(*cols).sortWithinPartitions(*cols)


def blocks(batches: Iterable[pd.DataFrame], rows: int = 50_000) -> Iterator[pd.DataFrame]:
    """The batches, joined to blocks of about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            n += len(batch)
        if n >= rows:
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)


def breaks(*cols: np.ndarray) -> np.ndarray:
    """True where a row differs from the row before it in any of ``cols``; the first row counts."""
    out = np.zeros(len(cols[0]), bool)
    out[:1] = True
    for c in cols:
        out[1:] |= c[1:] != c[:-1]
    return out


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without zone."""
    kind = df.schema[name].dataType.typeName()
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    if kind == "timestamp":
        return F.unix_micros(F.col(name))
    if kind == "long":
        return F.col(name)
    raise TypeError(f"{name} is {kind}, not a timestamp")
