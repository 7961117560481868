"""Portfolio ledger from a table of trades (ticker, Date, quantity: negative sells, price)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import trading_cost
from ..operators.joins import asof


def positions(trades: DataFrame) -> DataFrame:
    """L1: quantity of each ticker after each of its trading days; below 1e-5 it is 0, with a flag for overselling."""
    day = trades.groupBy("ticker", "Date").agg(F.sum("quantity").alias("moved"))
    run = F.sum("moved").over(Window.partitionBy("ticker").orderBy("Date"))
    return day.withColumn("_q", run).select("ticker", "Date", F.when(F.col("_q") < 1e-5, 0.0).otherwise(F.col("_q")).alias("quantity"),
                                            (F.col("_q") < -1e-9).alias("oversold"))


def cash(trades: DataFrame, start: float) -> DataFrame:
    """L2: cash after each day with trades, with a flag for overdrafts.  One row per day."""
    value = F.col("quantity") * F.col("price")
    day = trades.groupBy("Date").agg(F.sum(-value - trading_cost(F.abs(value))).alias("flow"))
    return day.select("Date", (F.lit(start) + F.sum("flow").over(Window.orderBy("Date"))).alias("cash")).withColumn("overdrawn", F.col("cash") < 0)


def value(trades: DataFrame, prices: DataFrame, start: float) -> DataFrame:
    """L3: cash and holdings at each date of ``prices`` from the first trade on; a missing price counts 0.

    As only a ticker with a price adds to a date, each price takes its ticker's last position
    (one as-of join), and dates are summed: no table of dates and tickers.
    """
    dates = prices.select("Date").distinct()
    held = asof(prices.select("ticker", "Date", F.col("Close").alias("_p")), positions(trades).withColumnRenamed("Date", "_at"), right_on="_at")
    worth = held.groupBy("Date").agg(F.sum(F.coalesce("quantity", F.lit(0.0)) * F.coalesce("_p", F.lit(0.0))).alias("holdings"))
    money = asof(dates.withColumn("_k", F.lit(1)), cash(trades, start).select(F.col("Date").alias("_at"), "cash", F.lit(1).alias("_k")),
                 by=("_k",), right_on="_at").where("_at is not null")
    return money.select("Date", "cash").join(worth, "Date").withColumn("value", F.col("cash") + F.col("holdings"))
