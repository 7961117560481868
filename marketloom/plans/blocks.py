"""Feature blocks: each takes a panel of bars and adds its columns.

A block is (names, build); ``register_block`` adds further ones.  Blocks that need only a
ticker's rows share the partitioning by ticker; group dynamics needs one more shuffle by
date.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fourier
from ..functions.arrow import doubles
from ..functions.exprs import clip, div, linear01, ln, log_price_to, sigmoid, tanh01, tanh01_at_one, tanh01_log, week_part
from ..operators import indicators
from ..operators.aggregates import first_row_per_year, per_date_extremes, trading_days, weighted_index
from ..operators.joins import asof, asof_few, with_member_flags
from ..operators.samples import complete_rows
from ..operators.windows import (
    by, fill, rolling, with_change, with_differences, with_drawdowns, with_lag_quotients, with_lags, with_sequence,
)
from ..scratch import materialize, small

# Defaults of a run.
LAGS, MONTHS = (1, 2, 5, 10, 20, 50, 100, 200, 300, 500), (1, 2, 4, 6, 8, 12)
SECTORS = ["other", "industrials", "healthcare", "technology", "financial-services", "real-estate", "energy", "consumer-cyclical"]
QUARTER_LAGS = ["reportedEPS", "estimatedEPS", "grossProfit", "ebit", "ebitda", "totalAssets", "totalCurrentLiabilities",
                "totalShareholderEquity", "operatingCashflow"]
ANNUAL_LAGS = QUARTER_LAGS[2:]
PRICE_METRICS = ["log_trailing_pe_ratio", "log_forward_pe_ratio", "log_pb_ratio"]
DEFAULTS = {"lags": LAGS, "months": MONTHS, "rows_per_month": 21, "steps": 20, "cutoff": 5, "factor": 8}
MATH = ["log_price", "diff", "diff2", "log_diff", "log_diff2", "return", "log_return", "adjustment"]
Block = Callable[..., DataFrame]
BLOCKS: dict[str, Block] = {}


def register_block(name: str, build: Block) -> None:
    """A further block, ``build(bars, params, **tables) -> bars with its columns``."""
    BLOCKS[name] = build


def block(name: str):
    def add(build: Block) -> Block:
        register_block(name, build)
        return build
    return add


def params(given: dict | None = None) -> dict:
    return {**DEFAULTS, **(given or {})}


@block("category")
def category(bars: DataFrame, p: dict | None = None, *, asset: DataFrame, membership: DataFrame | None = None, sectors: Sequence[str] = SECTORS,
             **_) -> DataFrame:
    """B1: a flag per sector and per index."""
    own = asset.select("ticker", *[(F.coalesce(F.col("sector") == s, F.lit(False))).cast("int").alias(f"sector_{s}") for s in sectors])
    out = bars.join(own, "ticker", "left")
    return out if membership is None else with_member_flags(out, membership, ["sp500", "nas100"])


def statement_features(fin: DataFrame, quarterly: bool, n_lags: int) -> DataFrame:
    """Ratios to revenue, logarithmic revenue, lags and lag quotients of statements."""
    w = by("ticker", "fiscalDateEnding")
    dates = ["ticker", "fiscalDateEnding"] + ["reportedDate"] * quarterly
    fin = fill(fin, [c for c in fin.columns if c not in dates], w=w)
    numbers = [c for c in fin.columns if dict(fin.dtypes)[c] == "double" and c not in (
        "totalRevenue", "reportedEPS", "estimatedEPS", "surprise", "surprisePercentage")]
    tag = "qm" if quarterly else "am"
    columns = [c for c in (QUARTER_LAGS if quarterly else ANNUAL_LAGS) if c in fin.columns]
    fin = with_lag_quotients(fin, columns, range(1, n_lags + 1), per="totalRevenue", w=w, suffix=tag)
    new = {f"{c}_nivRev": div(c, "totalRevenue") for c in numbers} | {"totalRevenue_RANK": F.coalesce(ln("totalRevenue"), F.lit(0.0)) / 100}
    if quarterly:
        new |= {"surprisePercentage": F.col("surprisePercentage") / 1000,
                "reportTime": F.when(F.col("reportTime") == "pre-market", 0).when(F.col("reportTime").isNotNull(), 1)}
    return fin.withColumns(new)


BOOK = ["reportedEPS", "estimatedEPS", "totalShareholderEquity", "commonStockSharesOutstanding", "ebit_lagquot_qm1", "totalShareholderEquity_lagquot_qm1"]


def price_metrics(bars: DataFrame, fin_q: DataFrame, look_up: Callable[..., DataFrame] = asof) -> DataFrame:
    """Earnings and book ratios of each bar by the statements reported until then."""
    q = statement_features(fin_q, True, 1).select("ticker", F.col("reportedDate").alias("_q"), *[F.col(c).alias(f"_b_{c}") for c in BOOK])
    df = look_up(bars, q, right_on="_q")
    b = {c: F.col(f"_b_{c}") for c in BOOK}
    df = df.withColumns({
        "log_trailing_pe_ratio": log_price_to("Close", b["reportedEPS"], 4), "log_forward_pe_ratio": log_price_to("Close", b["estimatedEPS"], 4),
        "log_pb_ratio": log_price_to("Close", div(b["totalShareholderEquity"], b["commonStockSharesOutstanding"])),
        "close2ebit_lagquot_qm1": F.col("Close") * b["ebit_lagquot_qm1"],
        "close2totalShareholderEquity_lagquot_qm1": F.col("Close") * b["totalShareholderEquity_lagquot_qm1"]})
    return df.drop(*[f"_b_{c}" for c in BOOK], "_q")


@block("financial")
def financial(bars: DataFrame, p: dict | None = None, *, fin_q: DataFrame, fin_a: DataFrame, quarter_lags: int = 12, annual_lags: int = 3, **_) -> DataFrame:
    """B2: statements as of each bar (quarters by reported date, years by their end), price metrics and their lags.

    The bars are dealt out by ticker once, and each join leaves them there.  A statement's
    hundred columns come last, so that they pass no shuffle, window or sort of the bars.
    """
    lags = params(p)["lags"]
    fin_q, fin_a = materialize(fin_q), materialize(fin_a)
    q = statement_features(fin_q, True, quarter_lags)
    a = statement_features(first_row_per_year(fin_a), False, annual_lags)
    names = lambda d, tag: d.select("ticker", F.col("reportedDate" if tag == "q" else "fiscalDateEnding").alias(f"_{tag}"), *[
        F.col(c).alias(f"{tag}_{c}") for c in d.columns if c.endswith(("_nivRev", "_RANK")) or "_lagquot_" in c or "_nivRevLag_" in c
        or c in ("surprisePercentage", "reportTime")]).where(f"_{tag} is not null")
    df = with_lags(price_metrics(bars, fin_q, asof_few), PRICE_METRICS, lags)
    df = with_lag_quotients(df, PRICE_METRICS, lags)
    return asof_few(asof_few(df, names(q, "q"), right_on="_q"), names(a, "a"), right_on="_a").drop("_q", "_a")


@block("financial_sequence")
def financial_sequence(bars: DataFrame, p: dict | None = None, *, fin_q: DataFrame, **_) -> DataFrame:
    """Five price metrics over strided steps; NULL becomes 0."""
    steps = params(p)["steps"]
    stride = max((12 * 4 * 21 + 31) // max(steps - 1, 1), 1)
    df = price_metrics(bars, fin_q)
    scale = {"log_trailing_pe_ratio": tanh01_log("log_trailing_pe_ratio", 15, 10), "log_forward_pe_ratio": tanh01_log("log_forward_pe_ratio", 15, 10),
             "log_pb_ratio": tanh01_log("log_pb_ratio", 3, 10), "close2ebit_lagquot_qm1": tanh01("close2ebit_lagquot_qm1", 1000),
             "close2totalShareholderEquity_lagquot_qm1": tanh01("close2totalShareholderEquity_lagquot_qm1", 1000)}
    df = df.withColumns({c: F.coalesce(x, F.lit(0.0)) for c, x in scale.items()})
    for c in scale:
        df = with_sequence(df, c, steps, stride)
    return df.drop(*scale)


@block("mathematical")
def mathematical(bars: DataFrame, p: dict | None = None, **_) -> DataFrame:
    """Differences, returns, drawdowns at the row and at lags."""
    q = params(p)
    df = with_differences(bars.withColumn("log_price", ln("Close")))
    df = with_drawdowns(df, q["months"], rows=q["rows_per_month"])
    moves = [f"{k}_{m}" for m in q["months"] for k in ("drawdown", "drawup")]
    return with_lags(df, [*MATH[1:], *moves], q["lags"]).drop("elevated")


@block("mathematical_sequence")
def mathematical_sequence(bars: DataFrame, p: dict | None = None, **_) -> DataFrame:
    """Price level at strides 1, 3 and 7, return and adjustment, over steps."""
    steps = params(p)["steps"]
    df = with_differences(bars)
    for stride in (1, 3, 7):
        df = with_sequence(df, "AdjClose", steps, stride, f"level_{stride}_seq")
        df = df.withColumn(f"level_{stride}_seq", F.transform(f"level_{stride}_seq", lambda x: tanh01_at_one(div(x, "AdjClose"))))
    df = df.withColumns({"_r": tanh01_at_one("return"), "_a": tanh01("adjustment")})
    df = with_sequence(with_sequence(df, "_r", steps, name="return_seq"), "_a", steps, name="adjustment_seq")
    return df.select(*bars.columns, "level_1_seq", "level_3_seq", "level_7_seq", "return_seq", "adjustment_seq")


def with_holiday_distance(df: DataFrame, holidays: DataFrame, date: str = "Date") -> DataFrame:
    """days to the next holiday, since the last, signed to the nearest (a tie is positive), flags."""
    h = holidays.select(F.col("Date").alias("_h"), F.lit(1).alias("_k"), *[c for c in holidays.columns if c == "name"]).distinct()
    df = df.withColumn("_k", F.lit(1))
    days = df.select(date, "_k").distinct()
    days = asof(days, h.withColumnRenamed("_h", "_next").drop("name"), on=date, by=("_k",), right_on="_next", forward=True)
    days = asof(days, h.withColumnRenamed("_h", "_last"), on=date, by=("_k",), right_on="_last")
    to, since = F.datediff("_next", date), F.datediff(date, "_last")
    nearest = F.when(F.coalesce(to, F.lit(10**6)) <= F.coalesce(since, F.lit(10**6)), to).otherwise(-since)
    days = days.withColumns({"days_to_holiday": to, "days_since_holiday": since, "nearest_holiday": nearest, "is_holiday": since == 0,
                             "is_trading_day": (F.weekday(date) < 5) & F.coalesce(since != 0, F.lit(True))})
    if "name" in days.columns:
        days = days.withColumn("holiday_name", F.when(since == 0, F.col("name"))).drop("name")
    return df.drop("_k").join(days.drop("_next", "_last", "_k"), date, "left")


@block("seasonal")
def seasonal(bars: DataFrame, p: dict | None = None, *, holidays: DataFrame, start_year: int, end_year: int, cap: bool = False, **_) -> DataFrame:
    """Date fields scaled to 0..1; lags are calendar days.

    Holiday terms are ``max(days, 90) / 90`` by the definition that is matched, that is
    never below 1; ``cap`` takes the smaller number instead.
    """
    d, bound = F.col("Date"), F.least if cap else F.greatest
    days = bars.select("Date").distinct()
    lagged = {0: d} | {n: F.date_sub(d, n) for n in params(p)["lags"]}
    out = {
        "seasonal_year": (F.year(d) - start_year) / F.lit(end_year - start_year + 1), "seasonal_month": (F.month(d) - 1) / 11,
        "seasonal_day": (F.day(d) - 1) / (F.day(F.last_day(d)) - 1), "seasonal_weekday": F.weekday(d) / 6, "seasonal_quarter": (F.quarter(d) - 1) / 3,
        "seasonal_month_start": (F.day(d) < 7).cast("int"), "seasonal_month_end": (F.day(d) > 21).cast("int"),
        "seasonal_year_start": (F.month(d) < 3).cast("int"), "seasonal_year_end": (F.month(d) > 10).cast("int"), "seasonal_week_part": week_part(d) / 2}
    days = days.withColumns(out)
    every = days.select("Date", F.explode(F.array(*[F.struct(F.lit(n).alias("lag"), x.alias("at")) for n, x in lagged.items()])).alias("r"))
    every = every.select("Date", "r.lag", F.col("r.at").alias("at"))
    far = with_holiday_distance(every, holidays, date="at")
    held = far.groupBy("Date").agg(*[
        F.max(F.when(F.col("lag") == n, x)).alias(name + (f"_lag_m{n}" if n else "")) for n in lagged for name, x in (
            ("seasonal_week_of_year", (F.weekofyear("at") - 1) / 51),
            ("seasonal_days_to_next_holiday", bound(F.col("days_to_holiday"), F.lit(90)) / 90),
            ("seasonal_days_since_last_holiday", bound(F.col("days_since_holiday"), F.lit(90)) / 90))])
    return bars.join(days.join(held, "Date"), "Date")


@block("seasonal_sequence")
def seasonal_sequence(bars: DataFrame, p: dict | None = None, *, holidays: DataFrame, **_) -> DataFrame:
    """Weekday, week and nearest holiday of the last days, as arrays."""
    steps = params(p)["steps"]
    days = bars.select("Date").distinct()
    each = days.select("Date", F.posexplode(F.sequence(F.date_sub("Date", steps - 1), F.col("Date"))).alias("i", "day"))
    each = with_holiday_distance(each, holidays, date="day")
    parts = {"weekday_seq": F.weekday("day") / 6, "week_seq": (F.weekofyear("day") - 1) / 52, "holiday_seq": tanh01("nearest_holiday", 10)}
    packed = each.groupBy("Date").agg(*[F.array_sort(F.collect_list(F.struct("i", x.alias("v")))).alias(n) for n, x in parts.items()])  # steps elements
    return bars.join(packed.select("Date", *[F.transform(n, lambda x: x["v"]).alias(n) for n in parts]), "Date")


GROUP = ["return_level", "volume_level", "return_rank", "volume_rank", "avg_return", "index_pct"]


def _group_dynamics(bars: DataFrame, rows: int) -> DataFrame:
    """Bars with the group fields.  What needs a ticker's order is stored once; dates are summed up from that and looked up."""
    df = materialize(bars.withColumns({"return_pct": div("AdjClose", F.lag("AdjClose", 1).over(by())) - 1, "_w": rolling(F.avg, "Volume", rows * 6, by())}))
    index = weighted_index(df).withColumn("_g", F.lit(1))
    w = Window.partitionBy("_g").orderBy("Date")  # one row per date
    index = with_change(index, "weighted_index", 1, 1e-6, w).withColumnRenamed("weighted_index_pct1", "index_pct").drop("_g")
    dates = small(per_date_extremes(df, ["return_pct", "Volume"]).join(index, "Date"))
    df = df.drop("_w").join(dates, "Date")
    for name, c in (("return", "return_pct"), ("volume", "Volume")):
        low, high = F.col(f"min_{c}"), F.col(f"max_{c}")
        df = df.withColumns({f"{name}_level": div(F.col(c) - low, high - low), f"{name}_rank": F.cume_dist().over(Window.partitionBy("Date").orderBy(c))})
    df = df.withColumnRenamed("avg_return_pct", "avg_return")
    return df.drop(*[f"{f}_{c}" for c in ("return_pct", "Volume") for f in ("min", "max")], "avg_Volume")


@block("group_dynamics")
def group_dynamics(bars: DataFrame, p: dict | None = None, **_) -> DataFrame:
    """Place of each ticker among all of its date, the mean return and a volume-weighted index; lags and horizons.

    A ticker's weight is divided once per date by the sum of the date.
    """
    q = params(p)
    df, month = _group_dynamics(bars, q["rows_per_month"]), q["rows_per_month"]
    back = sorted({k for n in q["lags"] for k in (n, *[n + m * month + 1 for m in q["months"]])})  # each looked up once
    new = {f"index_pct_lag_m{n}_MH_{m}": div(f"_index_{n}", F.col(f"_index_{n + m * month + 1}") + 1e-6) - 1 for n in q["lags"] for m in q["months"]}
    df = with_lags(df, GROUP, q["lags"]).withColumns({f"_index_{k}": F.lag("weighted_index", k).over(by()) for k in back})
    return df.withColumns(new).drop("weighted_index", "return_pct", *[f"_index_{k}" for k in back])


@block("group_dynamics_sequence")
def group_dynamics_sequence(bars: DataFrame, p: dict | None = None, **_) -> DataFrame:
    """The group fields as arrays over steps, on closes."""
    q = params(p)
    df = _group_dynamics(bars.withColumn("AdjClose", F.col("Close")), q["rows_per_month"])
    df = df.withColumns({"avg_return": tanh01("avg_return", 0.1), "index_pct": tanh01("index_pct", 0.1)})
    for c in GROUP:
        df = with_sequence(df, c, q["steps"])
    return df.drop(*GROUP, "weighted_index", "return_pct")


#: Rows of a batch that Python hands back.
BATCH_ROWS = 5_000


def with_fourier(bars: DataFrame, months: Sequence[int], rows: int = 21, cutoff: int = 5, factor: int = 8, lags: Sequence[int] = ()) -> DataFrame:
    """Coefficients of the last ``rows * m + 1`` prices (over the current one) and log returns for each horizon:
    sign and size of the coefficients, error of the partial sums and its ratio to the error of the line alone;
    and ``lags`` of errors and sizes.

    All windows of a ticker are a few matrix products a horizon.  A task works through its
    tickers in one sorted pass, which also looks up the lags: a window after it would
    shuffle all columns once more.  A ticker's history is bounded by its trading days.
    """
    kinds = [*[f"sign_{k}" for k in range(1, cutoff)], *[f"amp_{k}" for k in range(1, cutoff)], "rmse", "ratio"]
    names = [f"{series}_{kind}_MH{m}" for m in months for series in ("price", "ret") for kind in kinds]
    lagged = [k for k, n in enumerate(names) if "_rmse_" in n or "_amp_" in n]
    own, new = bars.columns, [*names, *[f"{names[k]}_lag_m{n}" for k in lagged for n in lags]]
    df = with_differences(bars).select(*own, "log_return").withColumn("_row", F.row_number().over(by(order=F.asc_nulls_last("Date"))))

    def features(price: np.ndarray, returns: np.ndarray) -> Iterator[np.ndarray]:
        for m in months:
            for values in (price, returns):
                got = fourier.window_features(values, rows * m + 1, factor, cutoff)
                if values is price:
                    now = np.where(price == 0, np.nan, price)[:, None]
                    got = np.hstack([got[:, :cutoff - 1] * np.sign(now), got[:, cutoff - 1:] / np.abs(now)])
                got[:, -1] = np.divide(got[:, -2], got[:, -1], out=np.full(len(got), np.nan), where=got[:, -1] != 0)
                yield got.T

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in indicators._histories(batches):
            row = table["_row"].to_numpy() - 1
            price, returns = (table[c].to_numpy().astype(float) for c in ("AdjClose", "log_return"))
            found, starts = np.empty((len(names), len(row))), np.flatnonzero(row == 0)
            with np.errstate(all="ignore"):
                for a, b in zip(starts, [*starts[1:], len(row)], strict=True):
                    found[:, a:b] = np.vstack(list(features(price[a:b], returns[a:b])))
            for a in range(0, len(row), BATCH_ROWS):
                b = min(a + BATCH_ROWS, len(row))
                values = {n: found[k, a:b] for k, n in enumerate(names)}
                for n in lags:
                    past = np.full((len(lagged), b - a), np.nan)
                    skip = min(max(n - a, 0), b - a)
                    past[:, skip:] = found[lagged, a + skip - n:b - n] if skip < b - a else past[:, skip:]
                    past[:, row[a:b] < n] = np.nan
                    values |= {f"{names[k]}_lag_m{n}": x for k, x in zip(lagged, past, strict=True)}
                part = table.slice(a, b - a).combine_chunks()
                yield from pa.table([*[part[c] for c in own], *[doubles(values[n]) for n in new]], names=[*own, *new]).to_batches()

    return df.mapInArrow(compute, T.StructType([*bars.schema.fields, *[T.StructField(n, T.DoubleType()) for n in new]]))


@block("fourier")
def fourier_block(bars: DataFrame, p: dict | None = None, **_) -> DataFrame:
    """``with_fourier`` with lags of errors and sizes."""
    q = params(p)
    return with_fourier(bars, q["months"], q["rows_per_month"], q["cutoff"], q["factor"], q["lags"])


@block("fourier_sequence")
def fourier_sequence(bars: DataFrame, p: dict | None = None, **_) -> DataFrame:
    """Error and ratio of the smallest horizon as arrays."""
    q = params(p)
    m = min(q["months"])
    df = with_fourier(bars, [m], q["rows_per_month"], q["cutoff"], q["factor"])
    df = df.withColumns({"_e": F.tanh(f"price_rmse_MH{m}"), "_q": F.tanh(f"price_ratio_MH{m}")})
    df = with_sequence(with_sequence(df, "_e", q["steps"], name="fourier_rmse_seq"), "_q", q["steps"], name="fourier_ratio_seq")
    return df.select(*bars.columns, "fourier_rmse_seq", "fourier_ratio_seq")


@block("indicators")
def indicator_block(bars: DataFrame, p: dict | None = None, **_) -> DataFrame:
    """85 columns at the row and at lags, relative to the current bar."""
    lags, columns = list(params(p)["lags"]), indicators.COLUMNS
    return indicators.over_bar(indicators.lagged(indicators.prepared_indicators(bars, columns, packed=True), lags), lags, columns)


#: How a column of the indicator sequence is brought to 0..1.
SEQUENCE_SCALES = {
    **{c: "close" for c in ("High", "Low", "Open", "trend_macd", "trend_macd_signal", "trend_sma_slow", "trend_ema_fast", "trend_ema_slow",
                            "volatility_atr", "volatility_bbm", "momentum_ao", "trend_visual_ichimoku_b")},
    **{c: "plain" for c in ("trend_adx", "trend_kst", "trend_kst_sig", "trend_kst_diff", "momentum_ppo")},
    **{c: "clip" for c in ("trend_mass_index", "trend_stc", "volatility_ui", "momentum_stoch", "momentum_stoch_rsi", "momentum_stoch_rsi_k",
                           "momentum_stoch_rsi_d")},
    **{c: "linear" for c in ("volume_obv", "volume_vpt", "volume_cmf", "trend_aroon_ind")},
    "momentum_roc": "tanh", "momentum_pvo": "tanh", "volume_nvi": "tanh", "Volume": "volume",
}


@block("indicator_sequence")
def indicator_sequence(bars: DataFrame, p: dict | None = None, **_) -> DataFrame:
    """32 columns brought to 0..1 by the current bar, as arrays over steps."""
    q, w = params(p), by()
    df = indicators.prepared_indicators(bars, list(SEQUENCE_SCALES))
    n, new = q["steps"], {}
    volume = F.when(F.col("Volume") < 2, 1.0).otherwise(F.col("Volume")).alias("_least_2")
    before = {"clip": lambda x: clip(x, 0, 1), "linear": linear01, "tanh": tanh01}  # doesn't depend on the current bar: once a row
    after = {"close": lambda x: tanh01_at_one(div(x, "Close")), "volume": lambda x: tanh01_at_one(x / F.col("_least_2"))}
    df = df.select("ticker", "Date", "Close", volume, *[before[k](F.col(c)).alias(f"_{c}") if k in before else F.col(c).alias(f"_{c}") for c, k in SEQUENCE_SCALES.items()])
    past = F.collect_list(F.struct(*[f"_{c}" for c in SEQUENCE_SCALES])).over(w.rowsBetween(-(n - 1), 0))  # once for all columns
    df = df.select("ticker", "Date", "Close", "_least_2", past.alias("_past")).withColumn("_past", F.when(F.size("_past") == n, F.col("_past")))
    for c, kind in SEQUENCE_SCALES.items():
        new[f"{c}_seq"] = F.transform(F.col("_past")[f"_{c}"], after[kind]) if kind in after else F.col("_past")[f"_{c}"]
    return df.select("ticker", "Date", *[x.alias(c) for c, x in new.items()])


@block("price_volume_sequence")
def price_volume_sequence(bars: DataFrame, p: dict | None = None, **_) -> DataFrame:
    """Price over the current price, volume between its least and most, over steps; NULL without history."""
    n = params(p)["steps"]
    df = with_sequence(with_sequence(bars, "AdjClose", n, name="_p"), "Volume", n, name="_v")
    low, high = F.array_min("_v"), F.array_max("_v")
    return df.withColumns({"price_seq": F.transform("_p", lambda x: div(x, "AdjClose")),
                           "volume_seq": F.transform("_v", lambda x: div(x - low, high - low))}).drop("_p", "_v")


def assemble(bars: DataFrame, features: Sequence[DataFrame], start: str, end: str) -> DataFrame:
    """Dates by tickers, features as of each date, prices of the exact date, complete rows.

    Only cells with a price of the exact date remain, so the plan begins with the bars on
    trading days; the table of all dates and tickers is never made.
    """
    panel = bars.where(F.col("ticker").isNotNull()).join(trading_days(bars, start, end), "Date", "left_semi").select("ticker", "Date", "Close", "AdjClose", "Open")
    panel, names = complete_rows(panel, ["Close", "AdjClose", "Open"]), []
    for f in features:
        columns = [c for c in f.columns if c not in ("ticker", "Date") and c not in bars.columns]
        panel = asof(panel, f.select("ticker", F.col("Date").alias("_at"), *columns), right_on="_at").drop("_at")
        names += columns
    return complete_rows(panel.select("ticker", "Date", *names, "Close", "AdjClose", "Open"), names)


def yearly_features(bars: DataFrame, build: Callable[[DataFrame], DataFrame], membership: DataFrame, groups: Sequence[str], years: Sequence[int], path: str,
                    kind: str = "tree") -> dict[tuple[str, int], str]:
    """Write the features of each (group, year); an error is kept for its pair and the others go on.

    A group is built once, for all its years, and written in one go.  Only if that fails
    its years are tried one by one, so that the error stays with the year that has it.
    Features may look back over the whole history (the elevated price does), so a year's
    rows can't be built from a slice of the bars.
    """
    from ..sources.stores import FeatureStore

    store, failed = FeatureStore(bars.sparkSession, path), {}
    for g in groups:
        own = bars.join(membership.where(F.col("group") == g).select("ticker"), "ticker", "left_semi")
        try:
            store.write_years(build(own), kind, g, years)
            continue
        except Exception as e:
            error = e
        for y in years:
            try:
                store.write(build(own).where(F.year("Date") == y), kind, g, y)
            except Exception as e:  # one year's failure must not stop the rest
                failed[g, y] = str(e or error)[:200]
    return failed


__all__ = ["BLOCKS", "assemble", "register_block", "rolling", "sigmoid", "yearly_features"]
