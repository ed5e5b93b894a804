"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a stage to the folder named in
``spark.checkpoint.dir`` and reading it back. Nothing is kept in executor memory or on
executor disks, so a lost executor costs no more than the tasks it was running.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where it is unset and Spark runs on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="siltstream-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def stage(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a scan of it.

    ``by``: partition columns of the table, so that a later filter on them reads only its own
    files. The table is removed by ``drop``, or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    weakref.finalize(out, _PATHS.pop, id(out), None)
    return out


#: Where the tables of this session lie, by the scan that ``stage`` returned.
_PATHS: dict[int, str] = {}


def drop(*tables: DataFrame) -> None:
    """Delete stage tables that no later result reads, before the session ends."""
    for t in tables:
        if path := _PATHS.pop(id(t), None):
            hadoop = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
