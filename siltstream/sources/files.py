"""Files as sources and sinks."""

from __future__ import annotations

import csv
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..frame import QC

FORMATS = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet", ".orc": "orc", ".json": "json"}


def _format(path: str) -> str:
    end = Path(path.rstrip("/")).suffix.lower()
    if end not in FORMATS:
        raise ValueError(f"unsupported file format {end!r}; known: {sorted(FORMATS)}")
    return FORMATS[end]


def read_table(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """A table from a file or folder, its format told by its ending. CSV: with a header; give a schema for large ones, else types are inferred."""
    kind = _format(path)
    r = spark.read.options(**options)
    if kind == "csv":
        r = r.option("header", True)
        r = r if schema else r.option("inferSchema", True)
    return (r.schema(schema) if schema else r).format(kind).load(path)


def read_wide(spark: SparkSession, paths: str | Iterable[str], time: str | None = None, keys: Iterable[str] = (), scheme: str = "float") -> QC:
    """One object from wide tables: a time column (by default the first), other columns are fields; of a name that occurs twice the later file counts."""
    qc = QC(keys=keys, scheme=scheme)
    for p in [paths] if isinstance(paths, str) else paths:
        df = read_table(spark, p)
        t = time or df.columns[0]
        if dict(df.dtypes)[t] in ("string", "date"):
            df = df.withColumn(t, df[t].cast("timestamp"))
        numeric = [c for c, k in df.dtypes if c != t and c not in qc.keys and k not in ("string", "timestamp", "timestamp_ntz", "date", "binary")]
        qc = qc.merge(QC.from_wide(df, t, numeric, keys, scheme=scheme))
    return qc


def write_table(qc: QC, path: str, nodata: float | None = None, two_headers: bool = False) -> None:
    """All fields side by side. ``two_headers``: one CSV file with two header rows, for results that fit the driver's disk, written row by row."""
    if nodata is None and type(qc.scheme).__name__ == "Positional":
        nodata = -9999
    df = qc.table(nodata)
    if not two_headers:
        w = df.write.mode("overwrite")
        (w.option("header", True) if _format(path) == "csv" else w).format(_format(path)).save(path)
        return
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        lead = [*qc.keys, "ts"]
        out.writerow([*[""] * len(lead), *(n for n in qc.columns for _ in (0, 1))])
        out.writerow([*lead, *(x for _ in qc.columns for x in ("data", "flags"))])
        for row in df.orderBy(*lead).toLocalIterator():
            out.writerow(["" if v is None else v for v in row])
