"""Incremental loads: files of bars that arrive in a folder are merged into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import merge_bars
from ..scratch import discard, materialize, small
from ..sources.schemas import SCHEMAS
from ..sources.stores import AssetStore

#: Which of two values for one ticker and date is the later one: that of the later file, then by
#: the file's name, then the later row of a file.
ORDER = ("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index")


#: Rows that a file may have: its number in a batch and the row's place in it make one long.
FILE_ROWS = 2**40


def ranked(batch: DataFrame) -> DataFrame:
    """A batch with ``ORDER`` in the struct ``_order``, which becomes a number in the same order.

    Only the files are sorted.  Aggregates by a number are hashed, and no path of a file
    travels with each value.
    """
    files = batch.select("_order.file_modification_time", "_order.file_path").distinct().collect()  # a row a file
    place = {r["file_path"]: k for k, r in enumerate(sorted(files))}
    table = small(batch.sparkSession.createDataFrame(list(place.items()) or [("", 0)], "_path string, _file long"))
    rows = batch.withColumns({"_path": F.col("_order.file_path"), "_row": F.col("_order.row_index")}).drop("_order").join(table, "_path")
    return rows.withColumn("_order", F.col("_file") * FILE_ROWS + F.col("_row")).drop("_path", "_file", "_row")


def latest(batch: DataFrame) -> DataFrame:
    """One row for each ticker and date of a batch that carries ``_order``: of each column the last value that is not NULL."""
    columns = [c for c in batch.columns if c not in ("ticker", "Date", "_order")]
    return batch.groupBy("ticker", "Date").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c) for c in columns])


def upsert_bars(spark: SparkSession, incoming: str, store: AssetStore, checkpoint: str) -> None:
    """ST1: read what is new in ``incoming`` (Parquet bars), merge it over the stored bars of the touched
    tickers, and replace these.

    New values win; among new ones the last that arrived (``ORDER``), whatever the order in
    which Spark reads them.  A replayed file changes nothing.  The store notes the number
    of each batch of this ``checkpoint`` together with its rows, so a batch that is run again after a
    failure is saved once.
    """
    def merge(batch: DataFrame, number: int) -> None:
        new = materialize(latest(ranked(batch)))  # used three times
        merged = merge_bars(store.load("bars", tickers=new), new) if store.exists("bars") else new
        store.save(merged, "bars", (checkpoint, number))
        discard(new)  # a batch leaves nothing but what is saved

    stream = spark.readStream.schema(SCHEMAS["bars"]).parquet(incoming).select("*", F.struct(*[F.col(c) for c in ORDER]).alias("_order"))
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
