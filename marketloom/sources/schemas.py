"""The fixed tables and their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names and order of the tables.
PRICES = ["Open", "High", "Low", "Close", "AdjClose"]
BAR_NUMBERS = [*PRICES, "Volume", "Dividends", "Splits"]
QUARTER_NUMBERS = [
    "reportedEPS", "estimatedEPS", "surprise", "surprisePercentage", "grossProfit", "totalRevenue", "ebit", "ebitda",
    "totalAssets", "totalCurrentLiabilities", "totalShareholderEquity", "commonStockSharesOutstanding", "operatingCashflow",
]
ANNUAL_NUMBERS = [
    "reportedEPS", "grossProfit", "totalRevenue", "ebit", "ebitda", "totalAssets", "totalCurrentLiabilities",
    "totalShareholderEquity", "operatingCashflow",
]
SCHEMAS = {
    "bars": "ticker string, Date date, " + ", ".join(f"{c} double" for c in BAR_NUMBERS),
    "fin_q": "ticker string, fiscalDateEnding date, reportedDate date, reportTime string, "
             + ", ".join(f"{c} double" for c in QUARTER_NUMBERS),
    "fin_a": "ticker string, fiscalDateEnding date, " + ", ".join(f"{c} double" for c in ANNUAL_NUMBERS),
    "asset": "ticker string, isin string, sector string, about map<string, string>",
}
DATES = {"bars": ["Date"], "fin_q": ["fiscalDateEnding", "reportedDate"], "fin_a": ["fiscalDateEnding"], "asset": []}


def empty(spark: SparkSession, table: str) -> DataFrame:
    """A table without rows."""
    return spark.createDataFrame([], SCHEMAS[table])


def typed(df: DataFrame, dates: list[str]) -> DataFrame:
    """Text dates (yyyy-MM-dd) as dates; what is no date becomes NULL."""
    return df.withColumns({c: F.try_to_date(F.col(c).cast("string"), "yyyy-MM-dd") for c in dates})
