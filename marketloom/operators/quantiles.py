"""Exact quantiles of whole columns without a buffer of all values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

#: Buckets of a doubling of the value.
PER_OCTAVE = 4096


def _bucket(x: Column) -> Column:
    """A whole number that never falls when the value rises: its logarithm, cut."""
    size = F.floor(F.log2(F.abs(x)) * PER_OCTAVE).cast("long") + 1100 * PER_OCTAVE
    return (F.when(F.isnan(x), F.lit(2**40)).when(F.abs(x) == float("inf"), F.signum(x).cast("long") * F.lit(2**39))
            .when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0))).cast("long")


def quantile_table(df: DataFrame, columns: Sequence[str], levels: Sequence[float], stored: bool = False) -> DataFrame:
    """Linear quantiles of columns over all rows: one row (column, k, q, v) per column and level.

    A first pass gives bucket totals, some thousands of rows a column, which say which bucket
    holds a wanted rank; a second one counts the values of these buckets only, and sorts each
    in its own partition.  No other value is shuffled.  The columns are stored for the two
    passes unless ``stored`` says that reading them again costs little.
    NULLs don't count, NaN is the greatest value.  A column without values has no row.
    """
    df = df if stored else materialize(df.select(*dict.fromkeys(columns)))
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("r"))
    long = long.select("r.column", "r.x").where("x is not null")
    long = long.select("column", _bucket(F.col("x")).alias("bucket"), "x")
    w = Window.partitionBy("column")
    totals = long.groupBy("column", "bucket").agg(F.count("*").alias("n"))
    totals = totals.withColumns({"before": F.sum("n").over(w.orderBy("bucket")) - F.col("n"), "all": F.sum("n").over(w)})
    place = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(q)).alias("q"), (F.lit(float(q)) * (F.col("all") - 1)).alias("h"))
                      for k, q in enumerate(levels)])
    wanted = totals.withColumn("p", F.explode(place))
    wanted = wanted.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("p.h"), F.ceil("p.h")))))
    wanted = wanted.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
    wanted = wanted.select("column", "bucket", "before", "rank", "p.k", "p.q", "p.h")
    run = F.sum("n").over(Window.partitionBy("column", "bucket").orderBy("x"))
    few = wanted.select("column", "bucket").distinct()  # two a level and column at most
    counts = long.join(F.broadcast(few), ["column", "bucket"], "left_semi").groupBy("column", "bucket", "x").agg(F.count("*").alias("n"))
    sorted_ = counts.withColumn("run", run)
    hit = sorted_.join(F.broadcast(wanted), ["column", "bucket"]).where(F.col("before") + F.col("run") > F.col("rank"))
    at = hit.groupBy("column", "k", "q", "h", "rank").agg(F.min("x").alias("x"))
    low, high = F.min(F.struct("rank", "x")), F.max(F.struct("rank", "x"))
    out = at.groupBy("column", "k", "q", "h").agg(low.alias("a"), high.alias("b"))
    mixed = (F.ceil("h") - F.col("h")) * F.col("a.x") + (F.col("h") - F.floor("h")) * F.col("b.x")
    return out.select("column", "k", "q", F.when(F.floor("h") == F.ceil("h"), F.col("a.x")).otherwise(mixed).alias("v"))


def quantile_row(df: DataFrame, columns: Sequence[str], levels: Sequence[float], names: Sequence[str], stored: bool = False) -> DataFrame:
    """The same as a single row: an array of the levels' values for each column, under ``names``."""
    table = quantile_table(df, columns, levels, stored)
    value = lambda c, k: F.max(F.when((F.col("column") == c) & (F.col("k") == k), F.col("v")))
    return table.agg(*[F.array(*[value(c, k) for k in range(len(levels))]).alias(n) for c, n in zip(columns, names, strict=True)])


def running_totals(df: DataFrame, keys: Sequence[str], value: str, amounts: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Running totals along a value in two levels, so that no task sorts all values of a key.

    Gives the values, one row (keys, ``_bucket``, value, amounts, ``<amount>_run`` up to the
    value within its bucket), and the buckets (keys, ``_bucket``, amounts,
    ``<amount>_before`` of all lower buckets, ``<amount>_all``), a few thousand rows a key.
    Rows without a value don't count.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("_bucket", _bucket(F.col(value).cast("double")))
    values = rows.groupBy(*keys, "_bucket", value).agg(*[F.sum(x).alias(a) for a, x in amounts.items()])
    inside, over = Window.partitionBy(*keys, "_bucket").orderBy(value), Window.partitionBy(*keys)
    buckets = values.groupBy(*keys, "_bucket").agg(*[F.sum(a).alias(a) for a in amounts])
    buckets = buckets.withColumns({f"{a}_before": F.coalesce(F.sum(a).over(over.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for a in amounts}
                                  | {f"{a}_all": F.sum(a).over(over) for a in amounts})
    return values.withColumns({f"{a}_run": F.sum(a).over(inside) for a in amounts}), buckets
