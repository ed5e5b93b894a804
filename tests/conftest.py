import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).parent.parent}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def series(spark):
    """One field from values at a fixed step: series(values, step_s=60) -> QC with field x."""
    from siltstream import QC

    def make(values, step_s=60, name="x", flags=None):
        rows = [("k", i * step_s * 1_000_000, None if v is None else float(v), None if flags is None or flags[i] is None else float(flags[i])) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "key string, t long, v double, f double")
        return QC.from_long(df, "t", "v", name, keys=["key"], flag="f" if flags is not None else None)

    return make


@pytest.fixture
def read():
    def values(qc, name="x", col="value"):
        return [r[col] for r in qc.fields[name].df.orderBy("t").collect()]

    def hits(qc, name="x"):
        return [i for i, f in enumerate(values(qc, name, "flag")) if f is not None and f > float("-inf")]

    values.hits = hits
    return values
