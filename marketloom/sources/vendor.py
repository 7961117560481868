"""Vendor files to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize

# Vendor column names, sector names, exchange names in order of precedence.
BAR_NAMES = {"date": "Date", "1. open": "Open", "2. high": "High", "3. low": "Low", "4. close": "Close", "5. adjusted close": "AdjClose",
             "6. volume": "Volume", "7. dividend amount": "Dividends", "8. split coefficient": "Splits"}
SECTOR_NAMES = {
    "OTHER": "other", "MANUFACTURING": "industrials", "LIFE SCIENCES": "healthcare", "TECHNOLOGY": "technology", "FINANCE": "financial-services",
    "REAL ESTATE & CONSTRUCTION": "real-estate", "ENERGY & TRANSPORTATION": "energy", "TRADE & SERVICES": "consumer-cyclical",
}
EXCHANGES = (("NYSE",), ("NASDAQ",), ("NYSE MKT", "NYSEMKT", "AMEX"), ("NYSE ARCA", "ARCA"), ("BATS",))
SWISS = ("SIX", "SWISS")
REPORTS = {"income": ("annualReports", "quarterlyReports"), "balance": ("annualReports", "quarterlyReports"),
           "cash_flow": ("annualReports", "quarterlyReports"), "earnings": ("annualEarnings", "quarterlyEarnings")}


def read_statements(spark: SparkSession, paths: dict[str, str], fields: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Vendor JSON (one document per company, ``symbol`` and two arrays of reports) to eight flat tables.

    ``fields`` names the report fields of each file; all are read as text with an explicit schema.
    The files, one a company, are opened once for both tables.
    """
    out = {}
    for name, path in paths.items():
        row = "array<struct<" + ", ".join(f"{c}: string" for c in fields[name]) + ">>"
        schema = "symbol string, " + ", ".join(f"{a} {row}" for a in REPORTS[name])
        df = materialize(spark.read.schema(schema).option("multiLine", True).json(path).select("symbol", *REPORTS[name]))
        for kind, array in zip(("annual", "quarterly"), REPORTS[name], strict=True):
            out[f"{name}_{kind}"] = df.select(F.col("symbol").alias("ticker"), F.inline(array))
    return out


def read_bars(df: DataFrame) -> DataFrame:
    """Vendor names and text to typed bars; rows without a date go."""
    named = df.withColumnsRenamed(BAR_NAMES)
    kinds = {c: F.expr(f"try_cast(`{c}` as double)") for c in list(BAR_NAMES.values())[1:]}
    return named.withColumns({"Date": F.try_to_date(F.col("Date").cast("string")), **kinds}).where("Date is not null")


def read_overview(df: DataFrame) -> DataFrame:
    """S3: the map of all fields and the canonical sector (NULL if the vendor's is unknown)."""
    names = F.create_map(*[F.lit(x) for kv in SECTOR_NAMES.items() for x in kv])
    about = F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*[F.col(c).cast("string") for c in df.columns]))
    return df.select(F.col("Symbol").alias("ticker"), F.try_element_at(names, F.col("Sector")).alias("sector"), about.alias("about"))


def unknown_sectors(overview: DataFrame) -> DataFrame:
    """S3: how many overviews have a sector that isn't in the list."""
    return overview.agg(F.count_if(F.col("sector").isNull()).alias("n_unknown"))


def symbol_list(df: DataFrame, include_swiss: bool = False) -> DataFrame:
    """Distinct symbols of the known exchanges (``stockExchange``, ``stocks``); of several
    names of one exchange the first that has symbols counts.  Swiss ones end in ``.SW`` or
    are ISIN-like (``CH...``); ``US...`` are left out."""
    each = df.select(F.upper(F.trim("stockExchange")).alias("x"), F.explode("stocks").alias("s")).where("s is not null")
    groups = list(EXCHANGES) + ([SWISS] if include_swiss else [])
    place = {n: (g, i) for g, names in enumerate(groups) for i, n in enumerate(names)}
    of = F.create_map(*[y for n, (g, i) in place.items() for y in (F.lit(n), F.struct(F.lit(g).alias("g"), F.lit(i).alias("i")))])
    each = each.withColumn("p", F.try_element_at(of, F.col("x"))).where("p is not null").select("s", "p.g", "p.i")
    first = each.groupBy("g").agg(F.min("i").alias("i"))
    each = each.join(F.broadcast(first), ["g", "i"])  # a row per exchange
    t = F.trim("s")
    low = F.lower(t)
    swiss = F.when(low.startswith("ch"), t).when(low.startswith("us"), None).when(low.endswith(".sw"), t).otherwise(F.concat(t, F.lit(".SW")))
    return each.select(F.when(F.col("g") == len(EXCHANGES), swiss).otherwise(F.col("s")).alias("ticker")).where("ticker is not null").distinct()
