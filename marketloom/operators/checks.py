"""Data quality reports and eligibility groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schemas import ANNUAL_NUMBERS, BAR_NUMBERS, PRICES, QUARTER_NUMBERS
from .windows import with_repeats


def validate_bars(bars: DataFrame) -> DataFrame:
    """One row per ticker with counts of broken rules."""
    negative = F.lit(False)
    for c in PRICES[:4]:
        negative = negative | F.coalesce(F.col(c) < 0, F.lit(False))
    nulls = sum((F.col(c).isNull().cast("int") for c in BAR_NUMBERS), F.lit(0))
    return bars.groupBy("ticker").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("Date").isNull()).alias("null_dates"), F.count_if(negative).alias("negative_prices"),
        F.sum(nulls).alias("null_numbers"), (F.count("Date") - F.countDistinct("Date")).alias("repeated_dates"),
        F.count_if(F.col("High") < F.col("Low")).alias("high_below_low"))


def schema_problems(df: DataFrame, table: str) -> list[str]:
    """Missing, additional, badly ordered or typed columns (no job is run)."""
    from ..sources.schemas import SCHEMAS

    want = [tuple(x.strip().split(" ", 1)) for x in SCHEMAS[table].split(", ") if "map" not in x and ">" not in x]
    have = dict(df.dtypes)
    out = [f"missing {c}" for c, _ in want if c not in have]
    out += [f"{c} is {have[c]}, not {t}" for c, t in want if c in have and have[c] != t]
    if not out and [c for c in df.columns if c in dict(want)] != [c for c, _ in want]:
        out.append("columns are in another order")
    return out


def validate_statements(df: DataFrame, quarterly: bool) -> DataFrame:
    """P10: counts of broken rules per ticker."""
    numbers = QUARTER_NUMBERS if quarterly else ANNUAL_NUMBERS
    nulls = sum((F.col(c).isNull().cast("int") for c in numbers), F.lit(0))
    rules = [F.count("*").alias("n_rows"), F.count_if(F.col("fiscalDateEnding").isNull()).alias("null_dates"), F.sum(nulls).alias("null_numbers")]
    if quarterly:
        rules += [F.count_if(F.col("reportedDate").isNull()).alias("null_reported"),
                  F.count_if(F.col("reportedDate") < F.col("fiscalDateEnding")).alias("reported_before_end"),
                  F.count_if(F.col("reportTime").isNotNull() & ~F.col("reportTime").isin("pre-market", "post-market")).alias("odd_report_time")]
    return df.groupBy("ticker").agg(*rules)


def feature_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Least, most, NULL and not finite values of each feature, one row per feature."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("r"))
    return long.groupBy("r.feature").agg(
        F.min("r.v").alias("least"), F.max("r.v").alias("most"), F.count_if(F.col("r.v").isNull()).alias("n_null"),
        F.count_if(F.isnan("r.v") | (F.abs("r.v") == float("inf"))).alias("n_not_finite"))


def rows_with_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """P12."""
    bad = F.lit(False)
    for c in columns or df.columns:
        bad = bad | F.col(c).isNull()
    return df.where(bad)


def _required(last: Column, start: str) -> Column:
    return F.floor(250 * F.datediff(last, F.lit(start).cast("date")) / 365.0)


def bars_since(bars: DataFrame, year: int, as_of: str) -> DataFrame:
    """Tickers with 250 bars a year since the year's start, the last within 20 days of ``as_of``."""
    start = f"{year}-01-01"
    f = bars.where(F.col("Date") >= F.lit(start).cast("date")).groupBy("ticker").agg(F.max("Date").alias("last"), F.count("*").alias("n"))
    ok = (F.datediff(F.lit(as_of).cast("date"), "last") <= 20) & (F.col("n") >= _required(F.col("last"), start))
    return f.select("ticker", F.coalesce(ok, F.lit(False)).alias("ok"))


def statements_since(fin_q: DataFrame, fin_a: DataFrame, bars: DataFrame, year: int, as_of: str) -> DataFrame:
    """G1: enough statements without gaps since the year's start, and bars as in G2.

    NULLs are allowed only in the newest quarter if it was reported within 70 days.
    """
    start, now = f"{year}-01-01", F.lit(as_of).cast("date")
    y, m = (int(x) for x in as_of.split("-")[:2])

    def lacks(columns: Sequence[str]) -> Column:
        out = F.lit(False)
        for c in columns:
            out = out | F.col(c).isNull()
        return out

    since = F.col("fiscalDateEnding") >= F.lit(start).cast("date")
    a = fin_a.groupBy("ticker").agg(F.count("*").alias("na"), F.count_if(since & lacks(ANNUAL_NUMBERS)).alias("ga"))
    newest = F.max("reportedDate").over(Window.partitionBy("ticker"))
    q = fin_q.withColumn("_newest", newest)
    free = (F.col("reportedDate") == F.col("_newest")) & (F.col("_newest") >= F.date_sub(now, 70))
    q = q.groupBy("ticker").agg(F.count("*").alias("nq"), F.count_if(
        since & lacks([*QUARTER_NUMBERS, "reportTime"]) & ~F.coalesce(free, F.lit(False))).alias("gq"))
    both = bars_since(bars, year, as_of).join(a, "ticker", "left").join(q, "ticker", "left")
    ok = F.col("ok") & (F.col("na") >= y - year) & (F.col("nq") >= (y - year) * 4 + (m - 1) // 3 + 1) & (F.col("ga") == 0) & (F.col("gq") == 0)
    return both.select("ticker", F.coalesce(ok, F.lit(False)).alias("ok"))


def regular_bars(bars: DataFrame) -> DataFrame:
    """250 bars a year, no NULL but in the first and last row, no repeated bars, no empty volume."""
    w = Window.partitionBy("ticker").orderBy("Date")
    df = with_repeats(bars).withColumns({"_inside": F.lag(F.lit(1), 1).over(w).isNotNull() & F.lead(F.lit(1), 1).over(w).isNotNull()})
    gap = F.lit(False)
    for c in PRICES[:4]:
        gap = gap | F.col(c).isNull() | F.isnan(c)
    f = df.groupBy("ticker").agg(
        F.count("*").alias("n"), F.min("Date").alias("a"), F.max("Date").alias("b"), F.count_if(F.col("repeats")).alias("r"),
        F.count_if("no_volume").alias("v"), F.count_if(gap & F.col("_inside")).alias("g"))
    ok = (F.col("n") >= F.floor(250 * F.datediff("b", "a") / 365.0)) & (F.col("r") == 0) & (F.col("v") == 0) & (F.col("g") == 0)
    return f.select("ticker", F.coalesce(ok, F.lit(False)).alias("ok"))


Criterion = Callable[[], Column]


def check_table(bars: DataFrame, fin_q: DataFrame, fin_a: DataFrame, asset: DataFrame, as_of: str, indexes: DataFrame | None = None) -> DataFrame:
    """One row per ticker with the result of every check the groups use (E2's input)."""
    year = int(as_of[:4])
    out = asset.select("ticker", F.endswith(F.lower("ticker"), F.lit(".sw")).alias("swiss"))
    checks = {"bars_2004": bars_since(bars, 2004, as_of), "bars_2008": bars_since(bars, 2008, as_of), "bars_5y": bars_since(bars, year - 5, as_of),
              "bars_2016": bars_since(bars, 2016, as_of), "fin_2011": statements_since(fin_q, fin_a, bars, 2011, as_of),
              "fin_2016": statements_since(fin_q, fin_a, bars, 2016, as_of), "regular": regular_bars(bars)}
    for name, df in checks.items():
        out = out.join(df.withColumnRenamed("ok", name), "ticker", "left")
    for g in ("sp500", "nas100"):
        if indexes is None:
            out = out.withColumn(g, F.lit(False))
        else:
            own = indexes.where(F.col("group") == g).select("ticker").distinct().withColumn(g, F.lit(True))
            out = out.join(own, "ticker", "left")
    return out.fillna(False, [*checks, "sp500", "nas100"])


#: Group criteria, a name and a predicate over the check table.
CRITERIA: dict[str, Criterion] = {
    "over20years": lambda: F.col("bars_2004"),
    "swiss": lambda: F.col("swiss"),
    "swiss_over20years": lambda: F.col("swiss") & F.col("bars_2004"),
    "snp500": lambda: F.col("sp500"),
    "snp500_over20years": lambda: F.col("sp500") & F.col("bars_2004"),
    "nas100snp500_over20years": lambda: (F.col("sp500") | F.col("nas100")) & F.col("bars_2004"),
    "snp500_finanTo2011": lambda: F.col("sp500") & F.col("fin_2011") & F.col("bars_2008"),
    "finanTo2011": lambda: F.col("fin_2011") & F.col("bars_2008"),
    "finanTo2016": lambda: F.col("fin_2016") & F.col("bars_2016"),
    "regOHLCV_over5years": lambda: F.col("bars_5y") & F.col("regular"),
    "debug": lambda: F.col("fin_2011") & F.col("bars_2004"),
}


def register_group(name: str, criterion: Criterion) -> None:
    CRITERIA[name] = criterion


def generate_groups(checks: DataFrame, criteria: dict[str, Criterion] | None = None) -> DataFrame:
    """The membership table (group, ticker) of all groups in one pass."""
    flags = F.array(*[F.when(c(), F.lit(g)) for g, c in (criteria or CRITERIA).items()])
    return checks.select("ticker", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("group")).select("group", "ticker")
