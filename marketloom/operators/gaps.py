"""Gap filling of daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fill_business_days(df: DataFrame, value: str = "price", key: str = "ticker", date: str = "Date", noise: bool = True, seed: int = 0) -> DataFrame:
    """One row per business day between a key's first and last date.

    A missing value is the mean of the observed values around it, plus seeded normal noise
    of half their difference (the mean, if that isn't positive).  With one neighbour it is
    copied, with none it is 0.  Dates at weekends are left out, as are null dates.
    """
    span = df.groupBy(key).agg(F.min(date).alias("_a"), F.max(date).alias("_b")).where("_a is not null")
    days = span.select(key, F.explode(F.sequence("_a", "_b")).alias(date)).where(F.weekday(date) < 5)
    both = days.join(df.select(key, date, F.col(value).alias("_v")).where(F.weekday(date) < 5), [key, date], "left")
    w = Window.partitionBy(key).orderBy(date)
    before = F.last("_v", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_v", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumns({"_p": before, "_n": after})
    mean = (F.col("_p") + F.col("_n")) / 2
    drawn = mean + F.randn(seed) * F.abs(F.col("_n") - F.col("_p")) / 2 if noise else mean
    filled = F.coalesce("_v", F.when(drawn > 0, drawn).otherwise(mean), "_p", "_n", F.lit(0.0))
    return both.select(key, date, filled.alias(value), F.col("_v").isNull().alias("filled"))
