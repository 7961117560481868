"""Window operators on a panel keyed by ticker and date.

All windows of one function share one specification, so Spark sorts a ticker once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ROWS_PER_MONTH, clip, div, ln


def by(keys: str | Sequence[str] = "ticker", order: str = "Date"):
    return Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(order)


def rolling(agg, value: Column | str, n: int, w, minimum: int | None = None) -> Column:
    """An aggregate over the last ``n`` rows, NULL unless ``minimum`` (all) of them have a value."""
    frame = w.rowsBetween(-(n - 1), 0)
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.count(value).over(frame) >= (n if minimum is None else minimum), agg(value).over(frame))


def with_lags(df: DataFrame, columns: Sequence[str], lags: Sequence[int], w=None) -> DataFrame:
    """``<column>_lag_m<lag>``."""
    w = w or by()
    return df.withColumns({f"{c}_lag_m{n}": F.lag(c, n).over(w) for c in columns for n in lags})


def with_lag_quotients(df: DataFrame, columns: Sequence[str], lags: Sequence[int], per: str | None = None, w=None,
                       suffix: str = "m") -> DataFrame:
    """Value / lagged value within +-30; with ``per``, also lagged value / current ``per``."""
    w, new = w or by(), {}
    for n in lags:
        for c in columns:
            if per:
                new[f"{c}_nivRevLag_{suffix}{n}"] = div(F.lag(c, n).over(w), per)
            new[f"{c}_lagquot_{suffix}{n}"] = clip(div(c, F.lag(c, n).over(w)), -30, 30)
    return df.withColumns(new)


def with_differences(df: DataFrame, price: str = "AdjClose", w=None) -> DataFrame:
    """Differences, logarithmic differences of the elevated price, returns.

    The elevated price is price - lowest price of the whole history + 1, so a later row
    can change earlier ones; that is a property of the definition.
    """
    w = w or by()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("elevated", F.col(price) - F.min(price).over(whole) + 1)
    last = lambda c: F.lag(c, 1).over(w)
    df = df.withColumns({
        "diff": F.col(price) - last(price), "log_diff": F.ln("elevated") - last(F.ln("elevated")),
        "return": clip(div("elevated", last("elevated")), 1e-5, 1e2),
        "adjustment": div(price, "Close") - last(div(price, "Close")),
    })
    return df.withColumns({
        "diff2": F.col("diff") - last("diff"), "log_diff2": F.col("log_diff") - last("log_diff"),
        "log_return": F.ln("return") + 1,
    })


def with_drawdowns(df: DataFrame, months: Sequence[int], price: str = "AdjClose", rows: int = ROWS_PER_MONTH, w=None) -> DataFrame:
    """Distance from the highest and lowest price of the last ``21 * m`` rows."""
    w, new, keep = w or by(), {}, df.columns
    df = with_extremes(df, price, [rows * m for m in months], w)
    for m in months:
        high, low = F.col(f"_high_{rows * m}"), F.col(f"_low_{rows * m}")
        new[f"drawdown_{m}"], new[f"drawup_{m}"] = div(F.col(price) - high, high), div(F.col(price) - low, low)
    return df.withColumns(new).select(*[c for c in keep if c not in new], *new)


def with_extremes(df: DataFrame, price: str, sizes: Sequence[int], w) -> DataFrame:
    """Highest and lowest value of the last ``n`` rows, as ``_high_<n>`` and ``_low_<n>``, NULL unless all rows have one.

    Only the shortest frame is gone through for each row.  A longer one, of up to twice the
    rows, is put together from a shorter one here and the same some rows before (they may overlap).
    """
    have = 0
    for n in sorted(set(sizes)):
        while have < n:
            size = min(2 * have, n) if have else n
            if have:
                pairs = {k: [F.col(f"_{k}_{have}"), F.lag(f"_{k}_{have}", size - have).over(w)] for k in ("high", "low")}
                whole = pairs["high"][0].isNotNull() & pairs["high"][1].isNotNull()
                df = df.withColumns({f"_high_{size}": F.when(whole, F.greatest(*pairs["high"])), f"_low_{size}": F.when(whole, F.least(*pairs["low"]))})
            else:
                df = df.withColumns({f"_high_{size}": rolling(F.max, price, size, w), f"_low_{size}": rolling(F.min, price, size, w)})
            have = size
    return df


def with_rolling_mean(df: DataFrame, column: str, n: int, name: str, minimum: int | None = None, w=None) -> DataFrame:
    """W6 (full window) and W7 (``minimum=1``)."""
    return df.withColumn(name, rolling(F.avg, column, n, w or by(), minimum))


def with_rolling_max_scale(df: DataFrame, column: str, n: int = 252, w=None) -> DataFrame:
    """Value / highest value of the last ``n`` rows."""
    return df.withColumn(f"{column}_scaled", div(column, rolling(F.max, column, n, w or by())))


def fill(df: DataFrame, columns: Sequence[str], backward: bool = False, w=None) -> DataFrame:
    """NULLs from the row before (or after)."""
    w = w or by()
    if backward:
        frame = w.rowsBetween(0, Window.unboundedFollowing)
        return df.withColumns({c: F.first(c, True).over(frame) for c in columns})
    return df.withColumns({c: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in columns})


def with_suffix_mean(df: DataFrame, column: str, w) -> DataFrame:
    """Product and mean of this and all later rows."""
    frame = w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({"suffix_product": F.product(F.col(column)).over(frame), "suffix_mean": F.avg(column).over(frame)})


def with_targets(df: DataFrame, ahead: int = 5, option: str = "last", price: str = "AdjClose", w=None) -> DataFrame:
    """Forward targets ``ahead`` rows on.

    ``mean`` and ``max`` look at rows after this one; they are NULL in the first
    ``ahead - 1`` rows of a ticker and where the window runs over the end.
    """
    w = w or by()
    half = ahead // 2

    def forward(agg, first: int, last: int) -> Column:
        frame = w.rowsBetween(first, last)
        full = (F.count(price).over(frame) == last - first + 1) & (F.row_number().over(w) >= ahead)
        return F.when(full, agg(price).over(frame))

    price_of = {"last": F.lead(price, ahead).over(w), "mean": forward(F.avg, half + 1, half + ahead),
                "max": forward(F.max, 1, ahead)}
    if option not in price_of:
        raise ValueError(f"no such target: {option}")
    new = {"target_date": F.lead("Date", ahead).over(w), "target_last_close": price_of["last"],
           "target_mean_close": price_of["mean"], "target_max_close": price_of["max"], "target_price": price_of[option],
           "AdjOpen": F.col("Open") * div(price, "Close")}
    new |= {f"target_close_at{i}": F.lead(price, i).over(w) * div("Close", price) for i in range(1, ahead + 1)}
    df = df.withColumns(new).withColumn("NextDayAdjOpen", F.lead("AdjOpen", 1).over(w))
    return df.withColumn("target_ratio", div("target_price", "NextDayAdjOpen"))


def top_per_date(df: DataFrame, score: str, n: int, tie: str = "ticker", date: str = "Date") -> DataFrame:
    """The ``n`` best rows of a date with their rank; ties by ticker.

    The filter on the row number is pushed below the shuffle, so a task sends at most
    ``n`` rows of a date.
    """
    w = Window.partitionBy(date).orderBy(F.desc_nulls_last(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def with_dense_rank(df: DataFrame, score: str, top: int, date: str = "Date") -> DataFrame:
    """Dense rank within a date, and whether it is one of the ``top``."""
    w = Window.partitionBy(date).orderBy(F.desc(score))
    return df.withColumn("dense_rank", F.dense_rank().over(w)).withColumn("is_top", F.col("dense_rank") <= top)


def with_group_rank(df: DataFrame, columns: Sequence[str], date: str = "Date") -> DataFrame:
    """Share of rows of the date at or below this one; place between least and most."""
    w, new = Window.partitionBy(date), {}
    for c in columns:
        new[f"{c}_rank"] = F.cume_dist().over(w.orderBy(c))
        new[f"{c}_level"] = div(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w))
    return df.withColumns(new)


def with_sequence(df: DataFrame, column: str, steps: int, stride: int = 1, name: str | None = None, w=None) -> DataFrame:
    """The last ``steps`` values, ``stride`` rows apart, oldest first; NULL without that many rows."""
    w = w or by()
    size = (steps - 1) * stride + 1
    every = F.array(*[F.lag(column, k * stride).over(w) if k else F.col(column) for k in range(steps - 1, -1, -1)])
    return df.withColumn(name or f"{column}_seq", F.when(F.row_number().over(w) >= size, every))


def with_box_smooth(df: DataFrame, column: str, n: int, w) -> DataFrame:
    """Box smoothing over ``n // 5`` rows with zeros beyond the ends, divided by ``n / 5``."""
    size = n // 5
    back = size // 2
    frame = w.rowsBetween(-back, size - 1 - back)
    return df.withColumn(f"{column}_smooth", F.sum(column).over(frame) / F.lit(n / 5))


def with_band_smooth(df: DataFrame, column: str, k: int, keys: Sequence[str], order: str) -> DataFrame:
    """Band smoother whose columns add up to 1, and the same minus the value."""
    w = Window.partitionBy(*keys).orderBy(order)
    c, n = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy(*keys))
    part = F.col(column) / (1 + F.least(c, F.lit(k)) + F.least(n - 1 - c, F.lit(k)))
    df = df.withColumn("_part", part)
    smooth = F.sum("_part").over(w.rowsBetween(-k, k))
    return df.withColumns({"smooth": smooth, "smooth_minus": smooth - F.col(column)}).drop("_part")


def local_minima(df: DataFrame, d: int, price: str = "AdjClose", w=None) -> DataFrame:
    """Rows that are the least of the ``d`` rows on both sides, counted per ticker, with
    the rows between the first and last, and whether the last row of the ticker is within ``d`` of the last."""
    w = w or by()
    df = df.withColumns({"_i": F.row_number().over(w), "_low": F.min(price).over(w.rowsBetween(-d, d)) == F.col(price)})
    hit = F.when(F.col("_low"), F.col("_i"))
    return df.groupBy("ticker").agg(
        F.count(hit).alias("n_minima"), (F.max(hit) - F.min(hit)).alias("span"),
        (F.max("_i") - F.max(hit) <= d).alias("last_inside"))


def with_streaks(df: DataFrame, k: int, rise: float, rows: int, fall: float, price: str = "AdjClose", w=None) -> DataFrame:
    """The last ``k`` ratios all above ``rise``; any of the last ``rows`` below ``fall``."""
    w = w or by()
    df = df.withColumn("_q", div(price, F.lag(price, 1).over(w)))
    up, low = rolling(F.min, "_q", k, w), F.min("_q").over(w.rowsBetween(-(rows - 1), 0))
    return df.withColumns({"rising": up > rise, "fell": low < fall}).drop("_q")


def largest_gap(df: DataFrame, keys: Sequence[str] = ("ticker",), date: str = "Date") -> DataFrame:
    """Most days between successive distinct dates."""
    days = df.select(*keys, date).distinct()
    gap = F.datediff(date, F.lag(date, 1).over(Window.partitionBy(*keys).orderBy(date)))
    return days.withColumn("_gap", gap).groupBy(*keys).agg(F.max("_gap").alias("max_gap"))


def with_repeats(df: DataFrame, w=None) -> DataFrame:
    """Bars t and t+3, and t+1 and t+2, equal (relative 1e-10); W27: no volume, not in the last two rows."""
    w = w or by()

    def same(i: int, j: int) -> Column:
        out = F.lit(True)
        for c in ("Open", "High", "Low", "Close"):
            a, b = F.lead(c, i).over(w), F.lead(c, j).over(w)
            out = out & (F.abs(a - b) <= 1e-10 * F.abs(b))
        return F.coalesce(out, F.lit(False))

    two_more = F.lead(F.lit(1), 2).over(w).isNotNull()
    return df.withColumns({"repeats": same(0, 3) & same(1, 2), "no_volume": (F.col("Volume") == 0) & two_more})


def with_row_number(df: DataFrame, w=None) -> DataFrame:
    """Rows of a ticker, from 0."""
    return df.withColumn("row_idx", F.row_number().over(w or by()) - 1)


def with_change(df: DataFrame, column: str, n: int = 1, guard: float = 0.0, w=None) -> DataFrame:
    """Value / (value ``n`` rows before + guard) - 1."""
    return df.withColumn(f"{column}_pct{n}", div(column, F.lag(column, n).over(w or by()) + guard) - 1)


def with_log(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(f"{column}_log", ln(column))
