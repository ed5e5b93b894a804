"""Running a numpy kernel on each series (or block of it), in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from ..frame import Series
from ..timespan import micros


def _run(pdf: pd.DataFrame, kernel: Callable, out: list[str], keep: list[str]) -> pd.DataFrame:
    pdf = pdf.sort_values("t", kind="stable").reset_index(drop=True)
    new = kernel(pdf)
    return pdf[keep].assign(**{c: new[c] for c in out})


def apply(s: Series, kernel: Callable[[pd.DataFrame], dict], out: dict[str, str], block: Column | None = None, reads: list[str] | None = None) -> Series:
    """``kernel`` gets the rows of one series (and block) in time order and returns new columns.

    The rows pass through it whole, so that nothing is joined afterwards and rows of one time
    stay as many as they were. A series is one task's work: divide long ones with ``block``.
    """
    df = s.df.drop(*out)
    cols = df.columns
    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in cols] + [f"`{c}` {k}" for c, k in out.items()])
    if block is not None:
        df = df.withColumn("__block", block)
    groups = [*(F.col(k) for k in s.keys), *([] if block is None else [F.col("__block")])] or [F.lit(0)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _run(pdf, kernel, list(out), cols)

    res = df.groupBy(*groups).applyInPandas(run, schema)
    # what is missing inside an array comes back from Python as NaN
    lists = [c for c in cols if kinds[c] == "array<double>"]
    return Series(res.withColumns({c: F.transform(c, lambda x: F.nanvl(x, F.lit(None).cast("double"))) for c in lists}), s.keys)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The first row of each series."""
    first = np.zeros(len(table), bool)
    first[:1] = True
    for k in keys:
        try:
            codes = pa.concat_arrays(table[k].chunks).dictionary_encode(null_encoding="encode").indices.to_numpy()
        except pa.ArrowNotImplementedError:  # keys made of several values
            codes = pd.factorize(np.array([repr(x) for x in table[k].to_pylist()], object))[0]
        first[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(first)


def _whole(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows that end where a series does, and the first rows of their series."""
    held, n, most = [], 0, rows
    for batch in batches:
        if len(batch):
            held.append(batch)
            n += len(batch)
        if n >= most:
            table = pa.Table.from_batches(held)
            starts = _starts(table, keys)
            if last := int(starts[-1]):
                yield table.slice(0, last), starts[:-1]
            held = table.slice(last).to_batches()
            n -= last
            most = max(rows, 2 * n)  # a series longer than that is looked at again when it has doubled
    if n:
        table = pa.Table.from_batches(held)
        yield table, _starts(table, keys)


def _spread(s: Series, df: DataFrame) -> DataFrame:
    """A series' rows in one task; its stretches (plans.halo) in turn over twice the usual number of tasks, since hashed, or merged by size, several long ones meet in one."""
    if "__part" not in s.keys or not hasattr(df, "repartitionById"):  # Spark before 4.1
        return df.repartition(*s.by())
    n = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.hash(*(F.col(k) for k in s.keys if k != "__part")) if len(s.keys) > 1 else F.lit(0)
    return df.repartitionById(n, F.pmod(first + F.col("__part"), F.lit(n)).cast("int"))


def scan(s: Series, kernel: Callable[[np.ndarray, np.ndarray, dict[str, np.ndarray]], dict[str, np.ndarray]], out: dict[str, str], reads: Iterable[str] = ("value",), rows: int = 200_000) -> Series:
    """``kernel(t, starts, columns)`` gets whole series, many at once, one after the other and in time order, and returns new columns (double or boolean).

    ``starts`` are the first rows of the series; missing numbers are NaN both ways. Other columns pass in Arrow as they are, and nothing is joined.
    """
    df = s.df.drop(*out)
    keys, reads = list(s.keys), list(reads)
    kinds = {"double": (DoubleType(), pa.float64()), "boolean": (BooleanType(), pa.bool_())}
    schema = StructType([*df.schema.fields, *(StructField(c, kinds[k][0]) for c, k in out.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole(batches, keys, rows):
            new = kernel(table["t"].to_numpy(), starts, {c: pc.fill_null(table[c].cast(pa.float64()), np.nan).to_numpy() for c in reads})
            for c, k in out.items():
                table = table.append_column(c, pa.array(new[c], kinds[k][1], mask=np.isnan(new[c]) if k == "double" else None))
            yield from table.combine_chunks().to_batches(max_chunksize=20_000)

    return Series(_spread(s, df).sortWithinPartitions(*s.by(), "t").mapInArrow(run, schema), s.keys)


def blocks_of(s: Series, freq: str | int | float | None) -> Column:
    """Block numbers: periods from midnight of the first day, or blocks of rows; None or infinity: one block."""
    if freq is None or freq == float("inf"):
        return F.lit(0).cast("long")
    if isinstance(freq, int):
        return F.floor((F.row_number().over(s.order) - 1) / freq)
    first = F.floor(F.min("t").over(s.whole) / 86_400_000_000) * 86_400_000_000
    return F.floor((F.col("t") - first) / micros(freq))  # type: ignore[arg-type]
