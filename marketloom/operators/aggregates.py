"""Aggregations: statement cleaning, per-date statistics, fits, quantiles, reports."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, div, ln
from .quantiles import quantile_row, quantile_table, running_totals


def _first(c: str, order: str) -> Column:
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)))


def coalesce_gaps(df: DataFrame, numbers: Sequence[str], others: Sequence[str], days: int, date: str = "fiscalDateEnding") -> DataFrame:
    """A1: rows of a ticker at most ``days`` after the one before are one: numbers by mean, others by first."""
    w = Window.partitionBy("ticker").orderBy(date)
    new = F.coalesce(F.datediff(date, F.lag(date, 1).over(w)) > days, F.lit(True)).cast("int")
    df = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return df.groupBy("ticker", "_run").agg(
        F.min(date).alias(date), *[F.avg(c).alias(c) for c in numbers], *[_first(c, date).alias(c) for c in others]).drop("_run")


def one_row_per_year(df: DataFrame, numbers: Sequence[str], others: Sequence[str] = (), date: str = "fiscalDateEnding") -> DataFrame:
    """A2: numbers by mean, others from the year's first row."""
    return df.groupBy("ticker", F.year(date).alias("year")).agg(
        F.min(date).alias(date), *[F.avg(c).alias(c) for c in numbers], *[F.min_by(c, date).alias(c) for c in others])


def first_row_per_year(df: DataFrame, date: str = "fiscalDateEnding") -> DataFrame:
    """A3: the earliest row of each year."""
    w = Window.partitionBy("ticker", F.year(date)).orderBy(date)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def _is_last(date: str) -> Column:
    return F.lead(date, 1).over(Window.partitionBy("ticker").orderBy(date)).isNull()


def fill_last_row(df: DataFrame, overview: DataFrame, pairs: dict[str, str], date: str = "fiscalDateEnding") -> DataFrame:
    """A4: NULLs of a ticker's last row from its overview (``{column: overview column}``)."""
    both = df.withColumn("_last", _is_last(date)).join(
        overview.select("ticker", *[F.col(o).alias(f"_v_{c}") for c, o in pairs.items()]), "ticker", "left")
    filled = {c: F.when(F.col("_last"), F.coalesce(c, f"_v_{c}")).otherwise(F.col(c)) for c in pairs}
    return both.withColumns(filled).select(*df.columns)


def drop_early_last_row(df: DataFrame, date: str = "fiscalDateEnding") -> DataFrame:
    """A5: without a last row that follows after less than 95 % of the gap before (tickers of four rows or more)."""
    w = Window.partitionBy("ticker").orderBy(date)
    a, b = F.lag(date, 1).over(w), F.lag(date, 2).over(w)
    early = (F.datediff(date, a) < 0.95 * F.datediff(a, b)) & (F.count("*").over(Window.partitionBy("ticker")) > 3)
    return df.withColumn("_drop", F.coalesce(_is_last(date) & early, F.lit(False))).where("not _drop").drop("_drop")


def drop_empty_last_row(df: DataFrame, keys: Sequence[str] = ("totalRevenue", "grossProfit", "totalAssets"), date: str = "fiscalDateEnding") -> DataFrame:
    """Without a last row that lacks a key value."""
    lacks = F.lit(False)
    for c in keys:
        lacks = lacks | F.col(c).isNull()
    return df.withColumn("_drop", _is_last(date) & lacks).where("not _drop").drop("_drop")


def per_date_extremes(df: DataFrame, columns: Sequence[str], date: str = "Date") -> DataFrame:
    """Least, most and mean of each column per date."""
    return df.groupBy(date).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))])


def weighted_index(bars: DataFrame, rows: int = 126) -> DataFrame:
    """Per date, adjusted closes weighted by mean volume over ``rows`` rows (the column ``_w``, if it is there)."""
    from .windows import by, rolling

    w = bars if "_w" in bars.columns else bars.withColumn("_w", rolling(F.avg, "Volume", rows, by()))
    return w.groupBy("Date").agg(div(F.sum(F.col("AdjClose") * F.col("_w")), F.sum("_w")).alias("weighted_index"))


def error_per_date(df: DataFrame, prediction: str = "prediction_ratio", result: str = "target_ratio", date: str = "Date") -> DataFrame:
    """A9."""
    e = F.abs(F.col(prediction) - F.col(result))
    return df.groupBy(date).agg(F.avg(e).alias("mean_error"), F.sqrt(F.avg(e * e)).alias("rmse_error"),
                                F.count("*").alias("n_entries"), F.avg(result).alias("mean_result_ratio"))


def _geomean(c: Column | str) -> Column:
    return F.exp(F.avg(ln(c)))


def result_per_date(df: DataFrame, keys: Sequence[str] = (), prediction: str = "prediction_ratio", result: str = "target_ratio",
                    date: str = "Date") -> DataFrame:
    """A10: geometric means, the best prediction and its result, number of results."""
    best = F.struct(prediction, F.lit(0))
    return df.groupBy(*keys, date).agg(
        _geomean(prediction).alias("mean_pred"), F.max(prediction).alias("max_pred"), _geomean(result).alias("mean_res"),
        F.max_by(result, best).alias("top_res"), F.count(result).alias("n_entries"))


def run_summary(df: DataFrame, keys: Sequence[str] = (), date: str = "Date", **columns) -> DataFrame:
    """Geometric means over dates of the per-date figures, and those of the last date."""
    per = result_per_date(df, keys, date=date, **columns)
    return per.groupBy(*keys).agg(
        F.min(date).alias("end_train_date"), F.max(date).alias("end_test_date"),
        _geomean("mean_res").alias("res_meanmean"), _geomean("top_res").alias("res_topmean"),
        F.max_by("top_res", date).alias("res_toplast"), F.max_by("mean_res", date).alias("res_meanlast"),
        F.sum("n_entries").alias("n_entries"), F.max_by("max_pred", date).alias("pred_toplast"),
        _geomean("mean_pred").alias("pred_meanmean"), F.max_by("mean_pred", date).alias("pred_meanlast"))


RUN_FIGURES = ("res_meanmean", "res_toplast", "res_meanlast", "pred_toplast", "pred_meanmean", "pred_meanlast")


def summary_of_runs(runs: DataFrame) -> DataFrame:
    """Geometric means over runs."""
    return runs.agg(*[_geomean(c).alias(c) for c in RUN_FIGURES], F.sum("n_entries").alias("n_entries"))


def run_quantiles(runs: DataFrame, levels: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Quantiles of the predictions over runs (only if there are more than three)."""
    cols = ("pred_meanmean", "pred_meanlast", "pred_toplast")
    q = runs.agg(F.count("*").alias("_n"), *[F.percentile(c, F.array(*map(F.lit, levels))).alias(c) for c in cols]).where("_n > 3")
    at = F.arrays_zip(F.array(*map(F.lit, levels)).alias("q"), *cols)
    return q.select(F.explode(at).alias("r")).select(F.col("r.q").alias("q"), *[F.col(f"r.{c}").alias(c) for c in cols])


def runs_above_median(runs: DataFrame, column: str) -> DataFrame:
    """Geometric means of the runs above the median of a prediction."""
    median = runs.agg(F.percentile(column, F.lit(0.5)).alias("_m"), F.count("*").alias("_n")).where("_n > 3")
    return runs.join(F.broadcast(median)).where(F.col(column) > F.col("_m")).agg(*[_geomean(c).alias(c) for c in RUN_FIGURES])


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """Count and share of each label."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def confusion(df: DataFrame, known: str, seen: str) -> DataFrame:
    """Confusion matrix as rows."""
    return df.groupBy(known, seen).agg(F.count("*").alias("n"))


def class_rates(df: DataFrame, known: str, seen: str) -> DataFrame:
    """Per class, true and false positive and negative rates, and the accuracy of all."""
    cells = confusion(df, known, seen)
    total = cells.agg(F.sum("n").alias("all"), F.sum(F.when(F.col(known) == F.col(seen), F.col("n")).otherwise(0)).alias("right"))
    by_class = cells.select(F.explode(F.array(
        F.struct(F.col(known).alias("class"), F.col("n").alias("k"), F.lit(0).cast("long").alias("s"),
                 F.when(F.col(known) == F.col(seen), F.col("n")).otherwise(0).alias("b")),
        F.struct(F.col(seen).alias("class"), F.lit(0).cast("long").alias("k"), F.col("n").alias("s"), F.lit(0).cast("long").alias("b")))).alias("r"))
    out = by_class.groupBy("r.class").agg(F.sum("r.k").alias("k"), F.sum("r.s").alias("s"), F.sum("r.b").alias("b"))
    out = out.join(F.broadcast(total))
    tp, fn, fp = F.col("b"), F.col("k") - F.col("b"), F.col("s") - F.col("b")
    tn = F.col("all") - F.col("k") - fp
    return out.select("class", div(tp, tp + fn).alias("tpr"), div(fp, fp + tn).alias("fpr"), div(tn, tn + fp).alias("tnr"),
                      div(fn, fn + tp).alias("fnr"), div("right", "all").alias("accuracy"))


def log_loss(df: DataFrame, known: str, probability: str) -> DataFrame:
    """Mean of -ln p of the known class."""
    p = clip(probability, 1e-15, 1 - 1e-15)
    return df.agg(F.avg(-F.when(F.col(known) == 1, F.ln(p)).otherwise(F.ln(1 - p))).alias("log_loss"))


def mask_score(df: DataFrame, mask: Column, value: str, date: str = "Date") -> DataFrame:
    """Mean over dates with a selected row of the date's mean value."""
    per = df.where(mask).groupBy(date).agg(F.avg(value).alias("m"))
    return per.agg(F.avg("m").alias("score"), F.count("*").alias("n_dates"))


def mask_coverage(df: DataFrame, mask: Column, date: str = "Date") -> DataFrame:
    """Share of dates without a selected row; days between successive dates with one."""
    per = df.groupBy(date).agg(F.max(mask).alias("has"))
    own = per.where("has").withColumn("gap", F.datediff(date, F.lag(date, 1).over(Window.orderBy(date))))  # a row per date
    empty = per.agg(F.avg(F.when(F.col("has"), 0.0).otherwise(1.0)).alias("empty_share"))
    return empty.join(own.agg(F.max("gap").alias("max_gap"), F.avg("gap").alias("mean_gap"), F.percentile("gap", F.lit(0.5)).alias("median_gap")))


def trading_days(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Dates of bars that business days map to (the last at or before each).

    A bar is found by the business days from its date up to the ticker's next bar, so one
    window over the bars decides, without a table of days and tickers.
    """
    first, last = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    until = F.date_sub(F.lead("Date", 1).over(Window.partitionBy("ticker").orderBy("Date")), 1)
    df = bars.select("ticker", "Date").distinct().select("Date", F.greatest("Date", first).alias("a"), F.least(until, last).alias("b"))
    monday = F.when(F.weekday("a") < 5, F.col("a")).otherwise(F.date_add("a", 7 - F.weekday("a")))
    return df.where(F.col("Date").isNotNull() & (monday <= F.coalesce("b", last))).select("Date").distinct()


def rows_per_date(df: DataFrame, date: str = "Date") -> DataFrame:
    """How many rows each date has."""
    return df.groupBy(date).agg(F.count("*").alias("n"))


def date_listing(picks: DataFrame, date: str = "Date") -> DataFrame:
    """Mean result and prediction of each date's picks."""
    return picks.groupBy(date).agg(F.avg("target_ratio").alias("mean_result"), F.avg("prediction_ratio").alias("mean_prediction"))


def days_per_year(calendar: DataFrame, name: str, date: str = "Date", names: Sequence[str] | None = None) -> DataFrame:
    """Dates per year, a column per calendar."""
    g = calendar.groupBy(F.year(date).alias("year"))
    return (g.pivot(name, list(names)) if names else g.pivot(name)).agg(F.count(F.lit(1)))


def days_ahead(calendar: DataFrame, last, days: int, date: str = "Date") -> DataFrame:
    """Trading days after ``last`` up to ``last + days``."""
    start = F.to_date(F.lit(last))
    return calendar.where((F.col(date) > start) & (F.col(date) <= F.date_add(start, days))).agg(F.count("*").alias("n_days"))


def quantiles(df: DataFrame, column: str, levels: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Linear quantiles, one row per level."""
    if not keys:  # all rows have one key: no buffer of a single task could hold them
        return quantile_table(df, [column], levels).select("q", "v")
    lv = F.array(*map(F.lit, levels))
    q = df.groupBy(*keys).agg(F.percentile(column, lv).alias("v"))
    return q.select(*keys, F.explode(F.arrays_zip(lv.alias("q"), F.col("v"))).alias("r")).select(*keys, "r.q", "r.v")


def weighted_quantiles(df: DataFrame, value: str, weight: Column, levels: Sequence[float], keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Inverted CDF: the least value whose cumulative weight reaches the level; rows without a value don't count.

    The bucket in which a level is reached follows from the buckets' weights; only its values are looked at.
    """
    values, buckets = running_totals(df, keys, value, {"_w": weight})
    reach = F.col("q") * F.col("_w_all") * (1 - 1e-12)
    wanted = buckets.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in levels])))
    first = F.row_number().over(Window.partitionBy(*keys, "q").orderBy("_bucket"))
    wanted = wanted.where(reach <= F.col("_w_before") + F.col("_w")).withColumn("_k", first).where("_k = 1")
    hit = values.join(wanted.select(*keys, "_bucket", "q", "_w_before", "_w_all"), [*keys, "_bucket"])
    return hit.where(F.col("_w_before") + F.col("_w_run") >= reach).groupBy(*keys, "q").agg(F.min(value).alias("v"))


def distribution_distance(train: DataFrame, test: DataFrame, value: str, n_test: int, weight: Column | None = None,
                          keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Mean distance of train and test quantiles per feature."""
    n = max(min(n_test // 3, 100), 1)
    levels = [0.005 + 0.99 * k / (n - 1) for k in range(n)] if n > 1 else [0.005]
    a = weighted_quantiles(train, value, F.lit(1.0) if weight is None else weight, levels, keys)
    b = weighted_quantiles(test, value, F.lit(1.0), levels, keys).withColumnRenamed("v", "v_test")
    return a.join(b, [*keys, "q"]).groupBy(*keys).agg(F.avg(F.abs(F.col("v") - F.col("v_test"))).alias("distance"))


def line_fit(df: DataFrame, x: str, y: str, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Slope, intercept, r, their errors; the p-value is that of a t-test (see ``p_values``)."""
    f = df.groupBy(*keys).agg(
        F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"))
    rest = F.col("syy") * (1 - F.col("r") * F.col("r"))
    return f.select(*keys, "n", "slope", "intercept", "r", F.when(F.col("n") > 2, F.sqrt(div(div(rest, F.col("n") - 2), "sxx"))).alias("slope_err"),
                    div(rest, "n").alias("residual_var"))


def p_values(fits: DataFrame) -> DataFrame:
    """Two-sided p-value of the slope, by the incomplete beta function."""
    from ..functions.special import student_p

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([student_p(a, b) for a, b in zip(r, n, strict=True)])

    return fits.withColumn("p_value", p("r", "n"))


def polynomial_fit(df: DataFrame, x: str, y: str, degree: int, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Coefficients (highest first), their errors, R2 and residual variance.

    Spark sums the powers of the centred and scaled x; only those few sums per key reach
    the solver, so a key's rows are never gathered.
    """
    from ..functions.special import solve_polynomial

    w = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    c = w.groupBy(*keys).agg(F.avg(x).alias("_c"), F.greatest(F.stddev_pop(x), F.lit(1e-12)).alias("_s"))
    z = w.join(c, list(keys)).withColumn("_z", (F.col(x) - F.col("_c")) / F.col("_s"))
    sums = z.groupBy(*keys).agg(
        F.first("_c").alias("c"), F.first("_s").alias("s"), F.array(*[F.sum(F.pow("_z", k)) for k in range(2 * degree + 1)]).alias("xs"),
        F.array(*[F.sum(F.pow("_z", k) * F.col(y)) for k in range(degree + 1)]).alias("ys"), F.sum(F.col(y) * F.col(y)).alias("yy"))

    @F.pandas_udf("coef array<double>, err array<double>, r2 double, residual_var double")
    def solve(c: pd.Series, s: pd.Series, xs: pd.Series, ys: pd.Series, yy: pd.Series) -> pd.DataFrame:
        rows = [solve_polynomial(*r) for r in zip(c, s, xs, ys, yy, strict=True)]
        return pd.DataFrame(rows, columns=["coef", "err", "r2", "residual_var"])

    return sums.withColumn("f", solve("c", "s", "xs", "ys", "yy")).select(*keys, "f.*")


def first_point_line(df: DataFrame, order: str, x: str, y: str, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Slope of the line through the first point, and the variance of its relative residuals."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumns({"_x": F.col(x) - F.first(x).over(w), "_y": F.col(y) - F.first(y).over(w), "_y0": F.first(y).over(w)})
    slope = div(F.sum(F.col("_x") * F.col("_y")).over(Window.partitionBy(*keys)), F.sum(F.col("_x") * F.col("_x")).over(Window.partitionBy(*keys)))
    d = d.withColumn("slope", slope)
    fit = F.col("_y0") + F.col("slope") * F.col("_x")
    return d.groupBy(*keys).agg(F.first("slope").alias("slope"), F.var_pop(div(F.col(y) - fit, fit)).alias("residual_var"))


def prediction_fit(df: DataFrame, prediction: str, result: str) -> DataFrame:
    """Line, R2, and results above the median prediction."""
    median = quantile_row(df, [prediction], [0.5], ["_m"])
    above = F.when(F.col(prediction) > F.col("_m")[0], F.col(result))
    return df.join(F.broadcast(median)).agg(
        F.regr_slope(result, prediction).alias("slope"), F.regr_intercept(result, prediction).alias("intercept"),
        F.regr_r2(result, prediction).alias("r2"), F.avg(above).alias("mean_above"), F.stddev_pop(above).alias("std_above"), F.count(above).alias("n_above"))


def threshold_table(df: DataFrame, prediction: str, result: str, levels: Sequence[float]) -> DataFrame:
    """Mean result above each quantile of the prediction, and its yearly power.  One pass per step:
    the levels' thresholds are a single row, and rows are summed under all of them at once."""
    cuts = quantile_row(df, [prediction], levels, ["_cuts"])
    means = df.join(F.broadcast(cuts)).agg(*[
        F.avg(F.when(F.col(prediction) >= F.col("_cuts")[k], F.col(result))).alias(f"m{k}") for k in range(len(levels))])
    rows = F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"m{k}").alias("mean_result")) for k, q in enumerate(levels)])
    return means.select(F.explode(rows).alias("r")).select("r.q", "r.mean_result", F.pow(F.col("r.mean_result"), 52 * (1 - F.col("r.q"))).alias("yearly"))
