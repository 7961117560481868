"""Market views over the star schema tables: bars, statements, assets, ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Order lines with their ``ticker``: the supplier, or the brand of the part (fewer and longer histories)."""
    lines = _table(spark, sf_dir, "lineitem")
    if key == "brand":
        parts = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
        return lines.join(parts, lines.l_partkey == parts.p_partkey)
    return lines.withColumn("ticker", F.col("l_suppkey").cast("string"))


#: Lines that one task groups into bars (and passes on to the windows of their tickers) or joins with their orders.
TASK_LINES = 100_000


def _tasks(spark: SparkSession, sf_dir: str) -> int:
    """A number of tasks that grows with the lines (Parquet footers tell their number)."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_table(spark, sf_dir, "lineitem").count() // TASK_LINES))


def bars(spark: SparkSession, sf_dir: str, key: str = "supplier") -> DataFrame:
    """One bar per supplier (or brand) and ship date; the price of a line is its unit price.

    A supplier's lines go to one task, which groups and sorts them: windows over tickers
    need no further shuffle, and a task holds no more rows when the table grows.  The few
    brands are grouped before the shuffle instead.
    """
    k = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    p = F.col("l_extendedprice") / F.col("l_quantity")
    lines = _lines(spark, sf_dir, key).select(  # what follows from these is worked out behind the shuffle
        "ticker", F.to_date("l_shipdate").alias("Date"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount")
    lines = lines.repartition(_tasks(spark, sf_dir), "ticker") if key == "supplier" else lines
    return (
        lines.select("ticker", "Date", k.alias("k"), p.alias("p"), (p * (1 - F.col("l_discount"))).alias("adj"), F.col("l_quantity").alias("q"))
        .groupBy("ticker", "Date")
        .agg(F.min_by("p", "k").alias("Open"), F.max("p").alias("High"), F.min("p").alias("Low"),
             F.max_by("p", "k").alias("Close"), F.max_by("adj", "k").alias("AdjClose"), F.sum("q").alias("Volume"))
        .withColumns({"Dividends": F.lit(0.0), "Splits": F.lit(1.0)})
    )


def _statement(spark: SparkSession, sf_dir: str, unit: str, key: str = "supplier") -> DataFrame:
    lines, orders = _lines(spark, sf_dir, key), _table(spark, sf_dir, "orders")
    end = F.date_sub(F.add_months(F.trunc("o_orderdate", unit), 3 if unit == "quarter" else 12).cast("date"), 1)
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    n = _tasks(spark, sf_dir)
    if n > int(spark.conf.get("spark.sql.shuffle.partitions")):
        lines = lines.repartition(n, "l_orderkey")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .groupBy("ticker", end.alias("fiscalDateEnding"))
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double").alias("totalRevenue"),
             F.sum(net.cast("decimal(18,4)")).cast("double").alias("grossProfit"),
             F.sum("l_quantity").alias("commonStockSharesOutstanding"), F.count("*").alias("n"))
    )


def fin_q(spark: SparkSession, sf_dir: str, key: str = "supplier") -> DataFrame:
    """Quarterly statements, reported 30 days after the quarter's end."""
    r, g, n = F.col("totalRevenue"), F.col("grossProfit"), F.col("n")
    return _statement(spark, sf_dir, "quarter", key).select(
        "ticker", "fiscalDateEnding", F.date_add("fiscalDateEnding", 30).alias("reportedDate"),
        F.when(n % 3 == 0, "pre-market").when(n % 3 == 1, "post-market").alias("reportTime"),
        ((g - 0.9 * r) / (1000 * n)).alias("reportedEPS"), ((g - 0.91 * r) / (1000 * n)).alias("estimatedEPS"),
        (0.01 * r / (1000 * n)).alias("surprise"), (n % 7).cast("double").alias("surprisePercentage"),
        "grossProfit", "totalRevenue", (g - 0.9 * r).alias("ebit"), (g - 0.85 * r).alias("ebitda"),
        (3 * r).alias("totalAssets"), (0.7 * r).alias("totalCurrentLiabilities"), (1.5 * g).alias("totalShareholderEquity"),
        "commonStockSharesOutstanding", (0.2 * g).alias("operatingCashflow"))


def fin_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual statements."""
    r, g, n = F.col("totalRevenue"), F.col("grossProfit"), F.col("n")
    return _statement(spark, sf_dir, "year").select(
        "ticker", "fiscalDateEnding", ((g - 0.9 * r) / (1000 * n)).alias("reportedEPS"), "grossProfit", "totalRevenue",
        (g - 0.9 * r).alias("ebit"), (g - 0.85 * r).alias("ebitda"), (3 * r).alias("totalAssets"),
        (0.7 * r).alias("totalCurrentLiabilities"), (1.5 * g).alias("totalShareholderEquity"),
        (0.2 * g).alias("operatingCashflow"))


def asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier; its region is the sector."""
    s, n, r = (_table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("s_name").alias("isin"),
                    F.col("r_name").alias("sector"), F.create_map(F.lit("nation"), F.col("n_name")).alias("about")))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last value per user and day."""
    return (_table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("ticker"), F.to_date("ts").alias("Date"))
            .agg(F.max_by("value", F.struct("ts", "event_id")).alias("price")))


# The same views as SQL common table expressions, for comparison.
BARS_SQL = """bars AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS "Date", arg_min(p, k) AS "Open", max(p) AS "High",
    min(p) AS "Low", arg_max(p, k) AS "Close", arg_max(p * (1 - l_discount), k) AS "AdjClose", sum(l_quantity) AS "Volume",
    0.0::DOUBLE AS "Dividends", 1.0::DOUBLE AS "Splits"
  FROM (SELECT *, l_extendedprice / l_quantity AS p,
    {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_extendedprice, 'e': l_quantity} AS k FROM lineitem)
  GROUP BY 1, 2)"""

_STATEMENT_SQL = """SELECT CAST(l_suppkey AS VARCHAR) AS ticker,
    CAST(date_trunc('{unit}', o_orderdate) + INTERVAL {months} MONTH - INTERVAL 1 DAY AS DATE) AS "fiscalDateEnding",
    sum(l_extendedprice::DECIMAL(18, 4))::DOUBLE AS r,
    sum((l_extendedprice * (1 - l_discount))::DECIMAL(18, 4))::DOUBLE AS g, sum(l_quantity) AS q, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"""
_COMMON_SQL = """(g - 0.9::DOUBLE * r) / (1000 * n) AS "reportedEPS", g AS "grossProfit", r AS "totalRevenue", g - 0.9::DOUBLE * r AS "ebit",
  g - 0.85::DOUBLE * r AS "ebitda", 3 * r AS "totalAssets", 0.7::DOUBLE * r AS "totalCurrentLiabilities",
  1.5::DOUBLE * g AS "totalShareholderEquity", 0.2::DOUBLE * g AS "operatingCashflow" """
FIN_Q_SQL = f"""fin_q AS (SELECT ticker, "fiscalDateEnding", "fiscalDateEnding" + 30 AS "reportedDate",
  CASE n % 3 WHEN 0 THEN 'pre-market' WHEN 1 THEN 'post-market' END AS "reportTime", (g - 0.91::DOUBLE * r) / (1000 * n) AS "estimatedEPS",
  0.01::DOUBLE * r / (1000 * n) AS "surprise", (n % 7)::DOUBLE AS "surprisePercentage", q AS "commonStockSharesOutstanding",
  {_COMMON_SQL} FROM ({_STATEMENT_SQL.format(unit="quarter", months=3)}))"""
FIN_A_SQL = f"""fin_a AS (SELECT ticker, "fiscalDateEnding", {_COMMON_SQL} FROM ({_STATEMENT_SQL.format(unit="year", months=12)}))"""
ASSET_SQL = """asset AS (SELECT CAST(s_suppkey AS VARCHAR) AS ticker, s_name AS isin, r_name AS sector, n_name AS nation
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
TICKS_SQL = """ticks AS (SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS "Date",
  arg_max(value, {'a': ts, 'b': event_id}) AS price FROM events GROUP BY 1, 2)"""


def by_brand(sql: str) -> str:
    """The same expression over brands instead of suppliers."""
    lines = "FROM lineitem JOIN part ON l_partkey = p_partkey"
    return sql.replace("CAST(l_suppkey AS VARCHAR)", "p_brand").replace("FROM lineitem", lines)
