"""Intermediate tables in the folder that all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_folders: dict[str, SparkSession] = {}
_local: list[str] = []


def new_path(spark: SparkSession) -> str:
    """A fresh path below this application's folder; only a local session without that
    setting (as in tests) uses a temporary folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        base = _local[0]
    top = f"{base.rstrip('/')}/marketloom-tables-{spark.sparkContext.applicationId}"
    if top not in _folders:
        _folders[top] = spark
        atexit.register(_remove, spark, top)
    return f"{top}/{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def materialize(df: DataFrame) -> DataFrame:
    """Write once as Parquet and read back: lineage ends here, for plans that are used twice."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these tables; nothing may read them, or tables made of them, any more."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


#: Rows up to which a table of a few numbers per row is broadcast (some 10 MB).
MOST_BROADCAST = 100_000


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A table of few rows, written once and counted: up to ``most`` rows it is broadcast
    where it is joined, a larger one is joined by a shuffle."""
    df = materialize(df)
    return F.broadcast(df) if df.count() <= most else df


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended already
        pass
