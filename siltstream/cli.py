"""Command line: read tables, run a config, write values and flags."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from .config import run_config
from .sources.files import read_wide, write_table


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="siltstream", description=__doc__)
    p.add_argument("-c", "--config", required=True, help="config file (text or .json), path or URL")
    p.add_argument("-d", "--data", required=True, action="append", help="table; may be given several times")
    p.add_argument("-o", "--outfile", help="where to write; else the first rows are shown")
    p.add_argument("--scheme", default="simple")
    p.add_argument("--key", action="append", default=[], help="column that divides fields into series")
    p.add_argument("--nodata", type=float, default=None)
    p.add_argument("--json-field", default=None)
    p.add_argument("--two-headers", action="store_true")
    p.add_argument("--log-level", default="INFO", type=str.upper)
    a = p.parse_args(args)
    logging.basicConfig(level=a.log_level)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    qc = run_config(read_wide(spark, a.data, keys=a.key, scheme=a.scheme), a.config, a.json_field)
    if a.outfile:
        write_table(qc, a.outfile, a.nodata, a.two_headers)
    else:
        qc.table(a.nodata).show(20, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
