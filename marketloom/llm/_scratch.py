"""Intermediate tables in the folder that all executors share, and small tables of a checked size."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``.

    Only in a local session without that setting (as in tests) a temporary folder of
    this machine is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local_base()
    path = f"{base.rstrip('/')}/marketloom-{spark.sparkContext.applicationId}"
    if path not in _folders:
        _folders[path] = spark
        atexit.register(remove_all, spark, path)
    return path


_folders: dict[str, SparkSession] = {}
_local: list[str] = []


def _local_base() -> str:
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _local[0]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: lineage ends here, and a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and that nothing reads any more, and no other."""
    spark = df.sparkSession
    top = folder(spark)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/{top.rsplit('/', 1)[1]}/" in path:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Rows up to which a table of a few numbers per row is broadcast (some 10 MB).
MOST_BROADCAST = 100_000


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A table of few rows, written once and counted: up to ``most`` rows it is broadcast
    where it is joined, a larger one is joined by a shuffle, which adaptive execution
    splits where a key is hot."""
    df = materialize(df)
    return F.broadcast(df) if df.count() <= most else df


def remove_all(spark: SparkSession, path: str | None = None) -> None:
    """Delete this application's intermediate tables."""
    path = path or folder(spark)
    try:
        _delete(spark, path)
    except Exception:  # the session may have ended already
        pass
    _folders.pop(path, None)
