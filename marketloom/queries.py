"""Queries over the market views, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs as X
from .operators import aggregates as A
from .operators import checks as C
from .operators import gaps, indicators
from .operators import joins as J
from .operators import samples as P
from .operators import windows as W
from .plans import blocks as B
from .plans import ledger, learning, screens
from .sources import schemas, stores, vendor, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CTES = {"bars": views.BARS_SQL, "fin_q": views.FIN_Q_SQL, "fin_a": views.FIN_A_SQL, "asset": views.ASSET_SQL, "ticks": views.TICKS_SQL}
DIGITS, HALF = 6, 0.50012


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to some decimals, so that the order of sums doesn't show.

    Exact decimal ties are common in prices, so values are rounded up from slightly below
    a half on, in the same way as in the SQL.
    """
    ten = 10.0**digits
    return df.select(*[(F.floor(F.col(f"`{c}`") * ten + HALF).cast("double") / ten).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def add(name: str, build: Query, sql: str | None = None, keys: Sequence[str] = (), doubles: Sequence[str] = (), digits: int = DIGITS,
        ctes: Sequence[str] = ("bars",)) -> None:
    """Register a query; ``sql`` is its inner SELECT (with further CTEs in front, ended by ``;;``)."""
    QUERIES[name] = lambda spark, sf: rounded(build(spark, sf).select(*keys, *doubles) if keys or doubles else build(spark, sf), digits)
    if sql is not None:
        more, _, body = sql.rpartition(";;")
        outer = ", ".join([*(f'"{k}"' for k in keys), *(f'floor("{d}" * 1e{digits}::DOUBLE + {HALF}::DOUBLE) / 1e{digits}::DOUBLE + 0.0::DOUBLE AS "{d}"' for d in doubles)])
        heads = ", ".join([*(CTES[c] for c in ctes), *([more] if more.strip() else [])])
        SQL[name] = (f"WITH RECURSIVE {heads} " if heads else "") + f"SELECT {outer} FROM ({body})"


KEY = ("ticker", "Date")
BY = "PARTITION BY ticker ORDER BY \"Date\""


def frame(a: str, b: str) -> str:
    return f"({BY} ROWS BETWEEN {a} AND {b})"


def last_rows(n: int) -> str:
    return frame(f"{n - 1} PRECEDING", "CURRENT ROW")


def full(agg: str, column: str, n: int) -> str:
    return f'CASE WHEN count({column}) OVER {last_rows(n)} = {n} THEN {agg}({column}) OVER {last_rows(n)} END'


def lag(column: str, n: int = 1) -> str:
    return f"lag({column}, {n}) OVER ({BY})"


# -- windows -------------------------------------------------------------------------
add("w01_lags", lambda s, d: W.with_lags(views.bars(s, d), ["Close", "Volume"], [1, 5]),
    f'SELECT *, {lag("Close")} AS "Close_lag_m1", {lag("Close", 5)} AS "Close_lag_m5", {lag("Volume")} AS "Volume_lag_m1", {lag("Volume", 5)} AS "Volume_lag_m5" FROM bars',
    KEY, ["Close_lag_m1", "Close_lag_m5", "Volume_lag_m1", "Volume_lag_m5"])
add("w02_lag_quotients", lambda s, d: W.with_lag_quotients(views.fin_q(s, d), ["ebit", "totalAssets"], [1, 2], "totalRevenue", W.by("ticker", "fiscalDateEnding"), "qm"),
    "SELECT ticker, \"fiscalDateEnding\", " + ", ".join(
        f'lag("{c}", {n}) OVER w / nullif("totalRevenue", 0) AS "{c}_nivRevLag_qm{n}", CASE WHEN lag("{c}", {n}) OVER w <> 0 THEN greatest(-30, least(30, "{c}" / lag("{c}", {n}) OVER w)) END AS "{c}_lagquot_qm{n}"'
        for c in ("ebit", "totalAssets") for n in (1, 2)) + ' FROM fin_q WINDOW w AS (PARTITION BY ticker ORDER BY "fiscalDateEnding")',
    ("ticker", "fiscalDateEnding"), [f"{c}_{k}_qm{n}" for c in ("ebit", "totalAssets") for n in (1, 2) for k in ("nivRevLag", "lagquot")], ctes=("fin_q",))
_DIFF = f"""e AS (SELECT *, "AdjClose" - min("AdjClose") OVER (PARTITION BY ticker) + 1 AS el FROM bars),
d AS (SELECT *, "AdjClose" - {lag('"AdjClose"')} AS diff, ln(el) - {lag("ln(el)")} AS log_diff,
  greatest(1e-5, least(1e2, el / nullif({lag("el")}, 0))) AS ret0, {lag("el")} AS el1,
  "AdjClose" / "Close" - {lag('"AdjClose" / "Close"')} AS adjustment FROM e),
m AS (SELECT *, CASE WHEN el1 IS NOT NULL THEN ret0 END AS "return" FROM d);;"""
add("w03_differences", lambda s, d: W.with_differences(views.bars(s, d)),
    _DIFF + f"""SELECT *, diff - {lag("diff")} AS diff2, log_diff - {lag("log_diff")} AS log_diff2, ln("return") + 1 AS log_return FROM m""",
    KEY, ["diff", "diff2", "log_diff", "log_diff2", "return", "log_return", "adjustment"])
add("w05_drawdown", lambda s, d: W.with_drawdowns(views.bars(s, d), [1, 4]),
    "SELECT *, " + ", ".join(f'("AdjClose" - h{m}) / nullif(h{m}, 0) AS drawdown_{m}, ("AdjClose" - l{m}) / nullif(l{m}, 0) AS drawup_{m}' for m in (1, 4))
    + " FROM (SELECT *, " + ", ".join(full(f, '"AdjClose"', 21 * m) + f" AS {k}{m}" for m in (1, 4) for k, f in (("h", "max"), ("l", "min"))) + " FROM bars)",
    KEY, ["drawdown_1", "drawup_1", "drawdown_4", "drawup_4"])
add("w06_rolling_mean", lambda s, d: W.with_rolling_mean(views.bars(s, d), "Volume", 126, "m"), f'SELECT *, {full("avg", chr(34) + "Volume" + chr(34), 126)} AS m FROM bars', KEY, ["m"])
add("w07_rolling_mean_partial", lambda s, d: W.with_rolling_mean(views.bars(s, d), "Close", 50, "m", 1), f'SELECT *, avg("Close") OVER {last_rows(50)} AS m FROM bars', KEY, ["m"])
add("w08_rolling_max_scale", lambda s, d: W.with_rolling_max_scale(views.bars(s, d), "Volume"),
    f'SELECT *, "Volume" / nullif({full("max", chr(34) + "Volume" + chr(34), 252)}, 0) AS "Volume_scaled" FROM bars', KEY, ["Volume_scaled"])


def _holes(df: DataFrame) -> DataFrame:
    return df.withColumn("x", F.when(F.col("Volume") % 3 != 0, F.col("Close")))


_HOLES = "h AS (SELECT *, CASE WHEN \"Volume\" % 3 <> 0 THEN \"Close\" END AS x FROM bars);;"
add("w09_forward_fill", lambda s, d: W.fill(_holes(views.bars(s, d)), ["x"]),
    _HOLES + f'SELECT ticker, "Date", last_value(x IGNORE NULLS) OVER {frame("UNBOUNDED PRECEDING", "CURRENT ROW")} AS x FROM h', KEY, ["x"])
add("w09_backward_fill", lambda s, d: W.fill(_holes(views.bars(s, d)), ["x"], True),
    _HOLES + f'SELECT ticker, "Date", first_value(x IGNORE NULLS) OVER {frame("CURRENT ROW", "UNBOUNDED FOLLOWING")} AS x FROM h', KEY, ["x"])
add("w10_suffix", lambda s, d: W.with_suffix_mean(views.bars(s, d).withColumn("y", 1 + F.col("Volume") / 1e6), "y", W.by()),
    f'SELECT *, product(1 + "Volume" / 1e6) OVER {frame("CURRENT ROW", "UNBOUNDED FOLLOWING")} AS suffix_product, avg(1 + "Volume" / 1e6) OVER {frame("CURRENT ROW", "UNBOUNDED FOLLOWING")} AS suffix_mean FROM bars',
    KEY, ["suffix_product", "suffix_mean"])


def _forward(agg: str, a: int, b: int, n: int) -> str:
    f = frame(f"{a} FOLLOWING", f"{b} FOLLOWING")
    return f'CASE WHEN count("AdjClose") OVER {f} = {b - a + 1} AND row_number() OVER ({BY}) >= {n} THEN {agg}("AdjClose") OVER {f} END'


add("w11_targets", lambda s, d: W.with_targets(views.bars(s, d), 5, "last"),
    f"""SELECT *, "AdjOpen", target_last_close / nullif(nxt, 0) AS target_ratio, nxt AS "NextDayAdjOpen" FROM (SELECT *, lead("AdjOpen", 1) OVER ({BY}) AS nxt FROM (
    SELECT *, lead("Date", 5) OVER ({BY}) AS target_date, lead("AdjClose", 5) OVER ({BY}) AS target_last_close,
    {_forward("avg", 3, 7, 5)} AS target_mean_close, {_forward("max", 1, 5, 5)} AS target_max_close,
    lead("AdjClose", 3) OVER ({BY}) * ("Close" / "AdjClose") AS target_close_at3, "Open" * ("AdjClose" / "Close") AS "AdjOpen" FROM bars))""",
    (*KEY, "target_date"), ["target_last_close", "target_mean_close", "target_max_close", "target_close_at3", "AdjOpen", "NextDayAdjOpen", "target_ratio"])
add("w16_top_per_date", lambda s, d: W.top_per_date(views.bars(s, d), "Volume", 5),
    'SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "Date" ORDER BY "Volume" DESC, ticker) AS rank FROM bars) WHERE rank <= 5', (*KEY, "rank"), ["Volume"])
add("w17_dense_rank", lambda s, d: W.with_dense_rank(views.bars(s, d), "Volume", 3),
    'SELECT *, dense_rank <= 3 AS is_top FROM (SELECT *, dense_rank() OVER (PARTITION BY "Date" ORDER BY "Volume" DESC) AS dense_rank FROM bars)', (*KEY, "dense_rank", "is_top"))
add("w18_group_rank", lambda s, d: W.with_group_rank(views.bars(s, d), ["Volume"]),
    'SELECT *, cume_dist() OVER (PARTITION BY "Date" ORDER BY "Volume") AS "Volume_rank", ("Volume" - min("Volume") OVER p) / nullif(max("Volume") OVER p - min("Volume") OVER p, 0) AS "Volume_level" FROM bars WINDOW p AS (PARTITION BY "Date")',
    KEY, ["Volume_rank", "Volume_level"])
add("w20_sequence", lambda s, d: W.with_sequence(views.bars(s, d), "Close", 4, 3).select("ticker", "Date", F.size("Close_seq").alias("n"), F.col("Close_seq")[0].alias("oldest"), F.col("Close_seq")[3].alias("newest"),
                                                                                        F.aggregate("Close_seq", F.lit(0.0), lambda a, x: a + x).alias("total")),
    f'SELECT ticker, "Date", CASE WHEN c9 IS NOT NULL THEN 4 ELSE NULL END AS n, c9 AS oldest, CASE WHEN c9 IS NOT NULL THEN "Close" END AS newest, c9 + c6 + c3 + "Close" AS total FROM (SELECT *, {lag(chr(34) + "Close" + chr(34), 9)} AS c9, {lag(chr(34) + "Close" + chr(34), 6)} AS c6, {lag(chr(34) + "Close" + chr(34), 3)} AS c3 FROM bars)',
    (*KEY, "n"), ["oldest", "newest", "total"])
add("w21_box_smooth", lambda s, d: W.with_box_smooth(views.bars(s, d), "Close", 50, W.by()),
    f'SELECT *, sum("Close") OVER {frame("5 PRECEDING", "4 FOLLOWING")} / 10.0 AS "Close_smooth" FROM bars', KEY, ["Close_smooth"])
add("w22_band_smooth", lambda s, d: W.with_band_smooth(views.bars(s, d), "Close", 7, ["ticker"], "Date"),
    f"""SELECT *, sum(part) OVER {frame("7 PRECEDING", "7 FOLLOWING")} AS smooth, sum(part) OVER {frame("7 PRECEDING", "7 FOLLOWING")} - "Close" AS smooth_minus FROM (
    SELECT *, "Close" / (1 + least(row_number() OVER ({BY}) - 1, 7) + least(count(*) OVER (PARTITION BY ticker) - row_number() OVER ({BY}), 7)) AS part FROM bars)""", KEY, ["smooth", "smooth_minus"])
_MINIMA = f"""l AS (SELECT *, row_number() OVER ({BY}) AS i, min("AdjClose") OVER {frame("10 PRECEDING", "10 FOLLOWING")} = "AdjClose" AS is_low FROM bars);;"""
add("w23_local_minima", lambda s, d: W.local_minima(views.bars(s, d), 10),
    _MINIMA + "SELECT ticker, count(*) FILTER (is_low) AS n_minima, max(i) FILTER (is_low) - min(i) FILTER (is_low) AS span, max(i) - max(i) FILTER (is_low) <= 10 AS last_inside FROM l GROUP BY ticker",
    ("ticker", "n_minima", "span", "last_inside"))
add("w24_streaks", lambda s, d: W.with_streaks(views.bars(s, d), 3, 1.001, 5, 0.6),
    f"""SELECT *, CASE WHEN count(q) OVER {last_rows(3)} = 3 THEN min(q) OVER {last_rows(3)} > 1.001::DOUBLE END AS rising, min(q) OVER {last_rows(5)} < 0.6::DOUBLE AS fell FROM (SELECT *, "AdjClose" / nullif({lag('"AdjClose"')}, 0) AS q FROM bars)""",
    (*KEY, "rising", "fell"))
add("w25_largest_gap", lambda s, d: W.largest_gap(views.bars(s, d)),
    f'SELECT ticker, max(g) AS max_gap FROM (SELECT ticker, date_diff(\'day\', {lag(chr(34) + "Date" + chr(34))}, "Date") AS g FROM bars) GROUP BY ticker', ("ticker", "max_gap"))
add("w26_repeats", lambda s, d: W.with_repeats(views.bars(s, d)),
    "SELECT ticker, \"Date\", coalesce(" + " AND ".join(
        f'abs("{c}" - lead("{c}", 3) OVER w) <= 1e-10 * abs(lead("{c}", 3) OVER w) AND abs(lead("{c}", 1) OVER w - lead("{c}", 2) OVER w) <= 1e-10 * abs(lead("{c}", 2) OVER w)' for c in ("Open", "High", "Low", "Close"))
    + f', false) AS repeats, "Volume" = 0 AND row_number() OVER (PARTITION BY ticker ORDER BY "Date" DESC) > 2 AS no_volume FROM bars WINDOW w AS ({BY})', (*KEY, "repeats", "no_volume"))
add("w28_row_number", lambda s, d: W.with_row_number(views.bars(s, d)), f'SELECT *, row_number() OVER ({BY}) - 1 AS row_idx FROM bars', (*KEY, "row_idx"))
add("w29_change", lambda s, d: W.with_change(views.bars(s, d), "Close", 21, 1e-6), f'SELECT *, "Close" / ({lag(chr(34) + "Close" + chr(34), 21)} + 1e-6) - 1 AS "Close_pct21" FROM bars', KEY, ["Close_pct21"])

# -- joins ---------------------------------------------------------------------------
add("j01_asof", lambda s, d: J.asof(views.bars(s, d).select("ticker", "Date", "Close"), views.fin_q(s, d).select("ticker", F.col("reportedDate").alias("at"), "totalRevenue"), right_on="at"),
    'SELECT b.ticker, b."Date", q."reportedDate" AS "at", b."Close", q."totalRevenue" FROM bars b ASOF LEFT JOIN fin_q q ON b.ticker = q.ticker AND b."Date" >= q."reportedDate"',
    (*KEY, "at"), ["Close", "totalRevenue"], ctes=("bars", "fin_q"))
add("j01_asof_forward", lambda s, d: J.asof(views.bars(s, d).select("ticker", "Date"), views.fin_q(s, d).select("ticker", F.col("reportedDate").alias("at")), right_on="at", forward=True),
    'SELECT b.ticker, b."Date", q."reportedDate" AS "at" FROM bars b ASOF LEFT JOIN fin_q q ON b.ticker = q.ticker AND b."Date" <= q."reportedDate"', (*KEY, "at"), ctes=("bars", "fin_q"))
add("j02_asof_after_days", lambda s, d: J.asof_after_days(views.bars(s, d).select(*KEY), views.bars(s, d), 30, "Close"),
    'SELECT b.ticker, b."Date", r."Close" AS "Close_after" FROM bars b ASOF LEFT JOIN bars r ON b.ticker = r.ticker AND b."Date" + 30 >= r."Date"', KEY, ["Close_after"])


def _old_new(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = views.bars(s, d)
    new = b.where(F.year("Date") >= 1996).withColumns({"Close": F.col("Close") * 1.1, "Volume": F.when(F.col("Volume") % 2 == 0, F.col("Volume"))})
    return b.where(F.year("Date") < 1998).withColumn("Splits", F.when(F.col("Volume") % 50 == 0, 2.0).otherwise(1.0)), new


_OLD_NEW = """n AS (SELECT ticker, "Date", "Open", "High", "Low", "Close" * 1.1::DOUBLE AS "Close", "AdjClose", CASE WHEN "Volume" % 2 = 0 THEN "Volume" END AS "Volume", "Dividends", "Splits" FROM bars WHERE year("Date") >= 1996),
o AS (SELECT * REPLACE (CASE WHEN "Volume" % 50 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS "Splits") FROM bars WHERE year("Date") < 1998)"""
add("j03_merge", lambda s, d: J.merge_new_over_old(*_old_new(s, d), KEY, ["Close", "Volume", "Splits"]),
    _OLD_NEW + ';;SELECT coalesce(n.ticker, o.ticker) AS ticker, coalesce(n."Date", o."Date") AS "Date", coalesce(n."Close", o."Close") AS "Close", coalesce(n."Volume", o."Volume") AS "Volume", coalesce(n."Splits", o."Splits") AS "Splits" FROM n FULL JOIN o ON n.ticker = o.ticker AND n."Date" = o."Date"',
    KEY, ["Close", "Volume", "Splits"])
add("j04_merge_bars", lambda s, d: J.merge_bars(*_old_new(s, d)), _OLD_NEW + f""",
f AS (SELECT coalesce(n.ticker, o.ticker) AS ticker, coalesce(n."Date", o."Date") AS "Date", coalesce(o."Close", n."Close") AS c, n."AdjClose" AS a, n."Close" AS nc, o."Close" AS oc, o."AdjClose" AS oa,
  1 / coalesce(o."Splits", n."Splits", 1) * (coalesce(o."Close", n."Close") - coalesce(o."Dividends", n."Dividends", 0)) / coalesce(o."Close", n."Close") AS ev FROM n FULL JOIN o ON n.ticker = o.ticker AND n."Date" = o."Date"),
g AS (SELECT *, exp(sum(ln(ev)) OVER {frame("CURRENT ROW", "UNBOUNDED FOLLOWING")}) AS fac FROM f), h AS (SELECT *, a / c / fac AS sc FROM g);;
SELECT ticker, "Date", coalesce(nc, oc) AS "Close", CASE WHEN count(nc) OVER (PARTITION BY ticker) > 0 THEN coalesce(a, c * fac * coalesce(last_value(sc IGNORE NULLS) OVER {frame("UNBOUNDED PRECEDING", "CURRENT ROW")}, first_value(sc IGNORE NULLS) OVER {frame("CURRENT ROW", "UNBOUNDED FOLLOWING")})) ELSE oa END AS "AdjClose" FROM h""",
    KEY, ["Close", "AdjClose"])
add("j05_full_join", lambda s, d: J.full_join(views.fin_q(s, d).select("ticker", "fiscalDateEnding", "ebit"), views.fin_a(s, d).select("ticker", "fiscalDateEnding", "ebit"), ["ticker", "fiscalDateEnding"], "_year"),
    'SELECT ticker, "fiscalDateEnding", q.ebit AS ebit, a.ebit AS ebit_year FROM fin_q q FULL JOIN fin_a a USING (ticker, "fiscalDateEnding")', ("ticker", "fiscalDateEnding"), ["ebit", "ebit_year"], ctes=("fin_q", "fin_a"), digits=2)
add("j08_missing", lambda s, d: J.missing_from(_old_new(s, d)[1], _old_new(s, d)[0], KEY).select(*KEY), _OLD_NEW + ';;SELECT ticker, "Date" FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.ticker = n.ticker AND o."Date" = n."Date")', KEY)


def _membership(s: SparkSession, d: str) -> DataFrame:
    a = views.asset(s, d)
    return a.select("ticker", F.explode(F.array(F.lower("sector"), F.when(F.col("ticker").cast("int") % 3 == 0, "sp500"), F.when(F.col("ticker").cast("int") % 4 == 0, "nas100"))).alias("group")).where("group is not null")


add("j09_members", lambda s, d: J.members(views.bars(s, d), _membership(s, d), "sp500").select(*KEY, "Close"), 'SELECT * FROM bars WHERE ticker IN (SELECT ticker FROM asset WHERE ticker::INT % 3 = 0)', KEY, ["Close"], ctes=("bars", "asset"))
add("j10_grid", lambda s, d: J.grid(views.bars(s, d), views.bars(s, d)), 'SELECT * FROM (SELECT DISTINCT "Date" FROM bars), (SELECT DISTINCT ticker FROM bars)', KEY)


def _two_samples(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = views.bars(s, d).select("ticker", "Date", F.round("Close", 0).alias("v")).withColumn("feature", F.concat(F.lit("f"), F.col("ticker").cast("int") % 3))
    return b.where(F.year("Date") < 1996), b.where(F.year("Date") == 1997)


_TWO = """b AS (SELECT ticker, "Date", round("Close", 0) AS v, 'f' || (ticker::INT % 3) AS feature FROM bars), tr AS (SELECT * FROM b WHERE year("Date") < 1996), te AS (SELECT * FROM b WHERE year("Date") = 1997)"""
add("j12_between", lambda s, d: J.between_neighbours(*(x.select("feature", "v").distinct() for x in _two_samples(s, d)), "v").select("feature", "v", "n_between"),
    _TWO + """, p AS (SELECT feature, v, lag(v) OVER (PARTITION BY feature ORDER BY v) AS u FROM (SELECT DISTINCT feature, v FROM tr));;
    SELECT p.feature, p.v, CASE WHEN u IS NULL THEN 0 ELSE (SELECT count(*) FROM (SELECT DISTINCT feature, v FROM te) t WHERE t.feature = p.feature AND t.v > p.u AND t.v < p.v) END AS n_between FROM p""", ("feature", "n_between"), ["v"])
add("u02_split", lambda s, d: J.split_at(views.bars(s, d), "1996-06-30", "1996-12-31").groupBy("role").agg(F.count("*").alias("n"), F.sum("Volume").alias("v")),
    """SELECT CASE WHEN "Date" <= DATE '1996-06-30' THEN 'train' WHEN "Date" <= DATE '1996-12-31' THEN 'test' END AS role, count(*) AS n, sum("Volume") AS v FROM bars GROUP BY 1""", ("role", "n"), ["v"])
add("u03_overlap", lambda s, d: J.selection_overlap(views.bars(s, d), F.col("Volume") > 60, F.col("Close") > 1200, "AdjClose"),
    """SELECT count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (a AND NOT b) AS n_only_a, avg(v) FILTER (a) AS mean_a, avg(v) FILTER (b) AS mean_b, avg(v) FILTER (a AND NOT b) AS mean_only_a,
    count(*) FILTER (a AND b) / nullif(count(*) FILTER (a), 0) AS overlap FROM (SELECT "Volume" > 60 AS a, "Close" > 1200 AS b, "AdjClose" AS v FROM bars)""", ("n_a", "n_b", "n_only_a"), ["mean_a", "mean_b", "mean_only_a", "overlap"])
add("u05_date_union", lambda s, d: J.date_union(views.bars(s, d), views.ticks(s, d)), 'SELECT "Date" FROM bars UNION SELECT "Date" FROM ticks', ("Date",), ctes=("bars", "ticks"))

# -- aggregates ----------------------------------------------------------------------
_NUM = ["totalRevenue", "ebit"]
add("a01_coalesce_gaps", lambda s, d: A.coalesce_gaps(views.ticks(s, d), ["price"], [], 3, "Date"),
    """r AS (SELECT *, sum(CASE WHEN g > 3 OR g IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY "Date") AS run FROM (SELECT *, date_diff('day', lag("Date") OVER (PARTITION BY ticker ORDER BY "Date"), "Date") AS g FROM ticks));;
    SELECT ticker, min("Date") AS "Date", avg(price) AS price FROM r GROUP BY ticker, run""", KEY, ["price"], ctes=("ticks",))
add("a02_year_rows", lambda s, d: A.one_row_per_year(views.fin_q(s, d), _NUM, ["reportTime"]),
    'SELECT ticker, year("fiscalDateEnding") AS year, min("fiscalDateEnding") AS "fiscalDateEnding", arg_min_null("reportTime", "fiscalDateEnding") AS "reportTime", avg("totalRevenue") AS "totalRevenue", avg(ebit) AS ebit FROM fin_q GROUP BY 1, 2',
    ("ticker", "year", "fiscalDateEnding", "reportTime"), _NUM, ctes=("fin_q",), digits=2)
add("a03_first_of_year", lambda s, d: A.first_row_per_year(views.fin_q(s, d)), 'SELECT * FROM fin_q QUALIFY row_number() OVER (PARTITION BY ticker, year("fiscalDateEnding") ORDER BY "fiscalDateEnding") = 1', ("ticker", "fiscalDateEnding"), _NUM, ctes=("fin_q",), digits=2)
add("a04_fill_last", lambda s, d: A.fill_last_row(views.fin_a(s, d).withColumn("ebit", F.when(F.year("fiscalDateEnding") < 1998, F.col("ebit"))),
                                                  views.fin_a(s, d).groupBy("ticker").agg(F.max("ebit").alias("EBIT_TTM")), {"ebit": "EBIT_TTM"}),
    """a AS (SELECT * REPLACE (CASE WHEN year("fiscalDateEnding") < 1998 THEN ebit END AS ebit), max("fiscalDateEnding") OVER (PARTITION BY ticker) AS l, max(ebit) OVER (PARTITION BY ticker) AS m FROM fin_a);;
    SELECT ticker, "fiscalDateEnding", CASE WHEN "fiscalDateEnding" = l THEN coalesce(ebit, m) ELSE ebit END AS ebit FROM a""", ("ticker", "fiscalDateEnding"), ["ebit"], ctes=("fin_a",), digits=2)
add("a05_drop_early_last", lambda s, d: A.drop_early_last_row(views.ticks(s, d), "Date").select(*KEY),
    """SELECT ticker, "Date" FROM (SELECT *, date_diff('day', lag("Date", 1) OVER w, "Date") AS g1, date_diff('day', lag("Date", 2) OVER w, lag("Date", 1) OVER w) AS g2, lead("Date") OVER w IS NULL AS l, count(*) OVER (PARTITION BY ticker) AS n FROM ticks WINDOW w AS (PARTITION BY ticker ORDER BY "Date"))
    WHERE NOT coalesce(l AND n > 3 AND g1 < 0.95 * g2, false)""", KEY, ctes=("ticks",))
add("a06_drop_empty_last", lambda s, d: A.drop_empty_last_row(views.fin_a(s, d).withColumn("totalAssets", F.when(F.col("ticker") % 2 == 0, F.col("totalAssets")))).select("ticker", "fiscalDateEnding"),
    'SELECT ticker, "fiscalDateEnding" FROM (SELECT *, max("fiscalDateEnding") OVER (PARTITION BY ticker) AS l FROM fin_a) WHERE NOT ("fiscalDateEnding" = l AND ticker::INT % 2 <> 0)', ("ticker", "fiscalDateEnding"), ctes=("fin_a",))
add("a07_date_extremes", lambda s, d: A.per_date_extremes(views.bars(s, d), ["Volume"]), 'SELECT "Date", min("Volume") AS "min_Volume", max("Volume") AS "max_Volume", avg("Volume") AS "avg_Volume" FROM bars GROUP BY 1', ("Date",), ["min_Volume", "max_Volume", "avg_Volume"])
add("a08_weighted_index", lambda s, d: A.weighted_index(views.bars(s, d)),
    f'SELECT "Date", sum("AdjClose" * w) / nullif(sum(w), 0) AS weighted_index FROM (SELECT *, {full("avg", chr(34) + "Volume" + chr(34), 126)} AS w FROM bars) GROUP BY 1', ("Date",), ["weighted_index"])


def predictions(s: SparkSession, d: str) -> DataFrame:
    """A stand-in for a model: last change as the prediction, five-row target as the result."""
    t = W.with_targets(W.with_change(views.bars(s, d), "AdjClose"), 5)
    return t.select("ticker", "Date", "Close", (1 + F.col("AdjClose_pct1") / 10).alias("prediction_ratio"), "target_ratio", F.date_format("Date", "yyyy").alias("run_id")).where("prediction_ratio is not null and target_ratio is not null")


_PRED = f"""p0 AS (SELECT *, "AdjClose" / nullif({lag('"AdjClose"')} + 0, 0) - 1 AS pct, lead("AdjClose", 5) OVER ({BY}) AS t, lead("Open" * ("AdjClose" / "Close"), 1) OVER ({BY}) AS nxt FROM bars),
pred AS (SELECT ticker, "Date", "Close", 1 + pct / 10 AS prediction_ratio, t / nullif(nxt, 0) AS target_ratio, strftime("Date", '%Y') AS run_id FROM p0 WHERE pct IS NOT NULL AND t / nullif(nxt, 0) IS NOT NULL)"""
add("a09_error_per_date", lambda s, d: A.error_per_date(predictions(s, d)),
    _PRED + ';;SELECT "Date", avg(e) AS mean_error, sqrt(avg(e * e)) AS rmse_error, count(*) AS n_entries, avg(target_ratio) AS mean_result_ratio FROM (SELECT *, abs(prediction_ratio - target_ratio) AS e FROM pred) GROUP BY 1',
    ("Date", "n_entries"), ["mean_error", "rmse_error", "mean_result_ratio"])
_PER = """per AS (SELECT run_id, "Date", exp(avg(ln(prediction_ratio))) AS mean_pred, max(prediction_ratio) AS max_pred, exp(avg(ln(target_ratio))) AS mean_res, count(target_ratio) AS n_entries,
  arg_max(target_ratio, prediction_ratio) AS top_res FROM pred GROUP BY 1, 2)"""


def _no_ties(df: DataFrame) -> DataFrame:
    return df.withColumn("prediction_ratio", F.col("prediction_ratio") + F.col("ticker").cast("int") * 1e-9)


_PRED_U = _PRED.replace("1 + pct / 10 AS prediction_ratio", "1 + pct / 10 + ticker::INT * 1e-9 AS prediction_ratio")
add("a10_result_per_date", lambda s, d: A.result_per_date(_no_ties(predictions(s, d)), ["run_id"]), _PRED_U + ", " + _PER + ";;SELECT * FROM per", ("run_id", "Date", "n_entries"), ["mean_pred", "max_pred", "mean_res", "top_res"])
_RUNS = """runs AS (SELECT run_id, min("Date") AS end_train_date, max("Date") AS end_test_date, exp(avg(ln(mean_res))) AS res_meanmean, exp(avg(ln(top_res))) AS res_topmean, arg_max(top_res, "Date") AS res_toplast,
  arg_max(mean_res, "Date") AS res_meanlast, sum(n_entries)::BIGINT AS n_entries, arg_max(max_pred, "Date") AS pred_toplast, exp(avg(ln(mean_pred))) AS pred_meanmean, arg_max(mean_pred, "Date") AS pred_meanlast FROM per GROUP BY 1)"""
_runs = lambda s, d: A.run_summary(_no_ties(predictions(s, d)), ["run_id"])
add("a11_run_summary", _runs, f"{_PRED_U}, {_PER}, {_RUNS};;SELECT * FROM runs", ("run_id", "end_train_date", "end_test_date", "n_entries"), ["res_meanmean", "res_topmean", "res_toplast", "res_meanlast", "pred_toplast", "pred_meanmean", "pred_meanlast"])
add("a12_all_runs", lambda s, d: A.summary_of_runs(_runs(s, d)), f"{_PRED_U}, {_PER}, {_RUNS};;SELECT sum(n_entries)::BIGINT AS n_entries, " + ", ".join(f"exp(avg(ln({c}))) AS {c}" for c in A.RUN_FIGURES) + " FROM runs", ("n_entries",), A.RUN_FIGURES)
add("a13_run_quantiles", lambda s, d: A.run_quantiles(_runs(s, d)), f"{_PRED_U}, {_PER}, {_RUNS};;" + " UNION ALL ".join(
    f"SELECT {q}::DOUBLE AS q, quantile_cont(pred_meanmean, {q}) AS pred_meanmean, quantile_cont(pred_meanlast, {q}) AS pred_meanlast, quantile_cont(pred_toplast, {q}) AS pred_toplast FROM runs" for q in (0.1, 0.25, 0.5, 0.75, 0.9)), (), ["q", "pred_meanmean", "pred_meanlast", "pred_toplast"])
add("a13_above_median", lambda s, d: A.runs_above_median(_runs(s, d), "pred_meanmean"), f"{_PRED_U}, {_PER}, {_RUNS};;SELECT " + ", ".join(f"exp(avg(ln({c}))) AS {c}" for c in A.RUN_FIGURES) + " FROM runs WHERE pred_meanmean > (SELECT quantile_cont(pred_meanmean, 0.5) FROM runs)", (), A.RUN_FIGURES)
add("a14_date_listing", lambda s, d: A.date_listing(W.top_per_date(_no_ties(predictions(s, d)), "prediction_ratio", 5)),
    _PRED_U + ';;SELECT "Date", avg(target_ratio) AS mean_result, avg(prediction_ratio) AS mean_prediction FROM (SELECT * FROM pred QUALIFY row_number() OVER (PARTITION BY "Date" ORDER BY prediction_ratio DESC, ticker) <= 5) GROUP BY 1', ("Date",), ["mean_result", "mean_prediction"])
_labels = lambda s, d: s.read.parquet(f"{d}/labels.parquet")
add("a15_label_distribution", lambda s, d: A.label_distribution(_labels(s, d), "quality"), "SELECT quality, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM labels GROUP BY 1", ("quality", "n"), ["share"], ctes=())
_seen = lambda s, d: _labels(s, d).withColumn("seen", (F.col("doc_id") % 7 != 0).cast("int"))
add("a16_confusion", lambda s, d: A.confusion(_seen(s, d), "quality", "seen"), "SELECT quality, (doc_id % 7 <> 0)::INT AS seen, count(*) AS n FROM labels GROUP BY 1, 2", ("quality", "seen", "n"), ctes=())
add("a16_class_rates", lambda s, d: A.class_rates(_seen(s, d), "quality", "seen"),
    """l AS (SELECT quality AS k, (doc_id % 7 <> 0)::INT AS s FROM labels), c AS (SELECT unnest([0, 1]) AS class), t AS (SELECT class, count(*) FILTER (k = class AND s = class) AS tp, count(*) FILTER (k = class AND s <> class) AS fn,
    count(*) FILTER (k <> class AND s = class) AS fp, count(*) FILTER (k <> class AND s <> class) AS tn, count(*) FILTER (k = s) AS r, count(*) AS n FROM l, c GROUP BY 1);;
    SELECT class, tp / nullif(tp + fn, 0) AS tpr, fp / nullif(fp + tn, 0) AS fpr, tn / nullif(tn + fp, 0) AS tnr, fn / nullif(fn + tp, 0) AS fnr, r / n AS accuracy FROM t""", ("class",), ["tpr", "fpr", "tnr", "fnr", "accuracy"], ctes=())
add("a16_log_loss", lambda s, d: A.log_loss(_labels(s, d).withColumn("p", (F.col("doc_id") % 10 + 0.5) / 10), "quality", "p"), "SELECT avg(-CASE WHEN quality = 1 THEN ln((doc_id % 10 + 0.5::DOUBLE) / 10) ELSE ln(1 - (doc_id % 10 + 0.5::DOUBLE) / 10) END) AS log_loss FROM labels", (), ["log_loss"], ctes=())
add("a17_mask_score", lambda s, d: A.mask_score(predictions(s, d), F.col("prediction_ratio") > 1.05, "target_ratio"), _PRED + ';;SELECT avg(m) AS score, count(*) AS n_dates FROM (SELECT avg(target_ratio) AS m FROM pred WHERE prediction_ratio > 1.05::DOUBLE GROUP BY "Date")', ("n_dates",), ["score"])
add("a18_coverage", lambda s, d: A.mask_coverage(predictions(s, d), F.col("prediction_ratio") > 1.15),
    _PRED + """, per AS (SELECT "Date", bool_or(prediction_ratio > 1.15::DOUBLE) AS has FROM pred GROUP BY 1), g AS (SELECT date_diff('day', lag("Date") OVER (ORDER BY "Date"), "Date") AS gap FROM per WHERE has);;
    SELECT (SELECT avg(CASE WHEN has THEN 0.0 ELSE 1.0 END) FROM per) AS empty_share, max(gap) AS max_gap, avg(gap) AS mean_gap, quantile_cont(gap, 0.5) AS median_gap FROM g""", ("max_gap",), ["empty_share", "mean_gap", "median_gap"])
add("a19_trading_days", lambda s, d: A.trading_days(views.bars(s, d), "1995-01-01", "1995-12-31"),
    """w AS (SELECT CAST(d AS DATE) AS d FROM range(DATE '1995-01-01', DATE '1996-01-01', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6), g AS (SELECT * FROM w, (SELECT DISTINCT ticker FROM bars));;
    SELECT DISTINCT b."Date" FROM g ASOF JOIN bars b ON g.ticker = b.ticker AND g.d >= b."Date" """, ("Date",))
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
add("a20_days_per_year", lambda s, d: A.days_per_year(J.attach(views.bars(s, d), views.asset(s, d), ["ticker"], ["sector"]).select("sector", "Date").distinct(), "sector", names=REGIONS),
    'SELECT year("Date") AS year, ' + ", ".join(f"""count(DISTINCT "Date") FILTER (sector = '{r}') AS "{r}\"""" for r in REGIONS) + " FROM bars JOIN asset USING (ticker) GROUP BY 1", ("year", *REGIONS), ctes=("bars", "asset"))
add("a21_days_ahead", lambda s, d: A.days_ahead(views.bars(s, d).select("Date").distinct(), "1996-03-01", 30), """SELECT count(DISTINCT "Date") AS n_days FROM bars WHERE "Date" > DATE '1996-03-01' AND "Date" <= DATE '1996-03-31'""", ("n_days",))
add("a22_merge_report", lambda s, d: J.merge_report(*_old_new(s, d)).select("ticker", "n_Close", "n_Splits", "n_Volume", "n_new_rows"),
    _OLD_NEW + """;;SELECT n.ticker, count(*) FILTER (NOT (n."Close" / o."Close" BETWEEN 0.99 AND 1.01)) AS "n_Close", count(*) FILTER (NOT (n."Splits" / o."Splits" BETWEEN 0.99 AND 1.01)) AS "n_Splits",
    count(*) FILTER (abs(n."Volume" - o."Volume") / 100 > 0.01) AS "n_Volume", count(*) FILTER (o.ticker IS NULL) AS n_new_rows FROM n LEFT JOIN o ON n.ticker = o.ticker AND n."Date" = o."Date" GROUP BY 1""", ("ticker", "n_Close", "n_Splits", "n_Volume", "n_new_rows"))
add("a22_changed_cells", lambda s, d: J.changed_cells(views.fin_a(s, d), views.fin_a(s, d).withColumn("ebit", F.when(F.col("ticker") % 5 != 0, F.col("ebit"))), ["ticker", "fiscalDateEnding"], ["ebit", "ebitda"]),
    "SELECT count(*) FILTER (ticker::INT % 5 = 0) AS ebit, 0::BIGINT AS ebitda FROM fin_a", ("ebit", "ebitda"), ctes=("fin_a",))
add("a23_quantiles", lambda s, d: A.quantiles(views.bars(s, d), "Close", [0.1, 0.5, 0.9], ["ticker"]), " UNION ALL ".join(f'SELECT ticker, {q}::DOUBLE AS q, quantile_cont("Close", {q}) AS v FROM bars GROUP BY 1' for q in (0.1, 0.5, 0.9)), ("ticker",), ["q", "v"])
add("a24_weighted_quantiles", lambda s, d: A.weighted_quantiles(_two_samples(s, d)[0].withColumn("wt", 1.0 + F.col("ticker").cast("int") % 4), "v", F.col("wt"), [0.1, 0.5, 0.9]),
    _TWO + """, r AS (SELECT feature, v, sum(w) OVER (PARTITION BY feature ORDER BY v) AS run, sum(w) OVER (PARTITION BY feature) AS tot FROM (SELECT feature, v, sum(1.0::DOUBLE + ticker::INT % 4) AS w FROM tr GROUP BY 1, 2)), l AS (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS q);;
    SELECT feature, q, min(v) AS v FROM r, l WHERE run >= q * tot * (1 - 1e-12) GROUP BY 1, 2""", ("feature",), ["q", "v"])
add("a25_distribution_distance", lambda s, d: A.distribution_distance(*_two_samples(s, d), "v", 60),
    _TWO + """, l AS (SELECT 0.005::DOUBLE + 0.99::DOUBLE * k / 19 AS q FROM range(20) t(k)), """ + ", ".join(
        f"{x}q AS (SELECT feature, q, min(v) AS v FROM (SELECT feature, v, sum(n) OVER (PARTITION BY feature ORDER BY v) AS run, sum(n) OVER (PARTITION BY feature) AS tot FROM (SELECT feature, v, count(*)::DOUBLE AS n FROM {x} GROUP BY 1, 2)), l WHERE run >= q * tot * (1 - 1e-12) GROUP BY 1, 2)" for x in ("tr", "te"))
    + ";;SELECT feature, avg(abs(trq.v - teq.v)) AS distance FROM trq JOIN teq USING (feature, q) GROUP BY 1", ("feature",), ["distance"])
_days = lambda s, d: views.bars(s, d).withColumn("x", F.datediff("Date", F.lit("1992-01-01")) / 365.0)
_DAYS = """x AS (SELECT *, date_diff('day', DATE '1992-01-01', "Date") / 365.0::DOUBLE AS x, "Close" AS y FROM bars)"""
add("a26_line_fit", lambda s, d: A.line_fit(_days(s, d), "x", "Close"),
    _DAYS + ";;SELECT ticker, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, corr(x, y) AS r, sqrt(regr_syy(y, x) * (1 - corr(x, y) ^ 2) / (count(*) - 2) / regr_sxx(y, x)) AS slope_err, regr_syy(y, x) * (1 - corr(x, y) ^ 2) / count(*) AS residual_var FROM x GROUP BY 1",
    ("ticker", "n"), ["slope", "intercept", "r", "slope_err", "residual_var"], digits=4)
add("a29_first_point_line", lambda s, d: A.first_point_line(_days(s, d), "Date", "x", "Close"),
    _DAYS + """, f AS (SELECT *, x - first_value(x) OVER w AS dx, y - first_value(y) OVER w AS dy, first_value(y) OVER w AS y0 FROM x WINDOW w AS (PARTITION BY ticker ORDER BY "Date")), g AS (SELECT *, sum(dx * dy) OVER (PARTITION BY ticker) / nullif(sum(dx * dx) OVER (PARTITION BY ticker), 0) AS slope FROM f);;
    SELECT ticker, any_value(slope) AS slope, var_pop((y - (y0 + slope * dx)) / nullif(y0 + slope * dx, 0)) AS residual_var FROM g GROUP BY 1""", ("ticker",), ["slope", "residual_var"])
add("a30_prediction_fit", lambda s, d: A.prediction_fit(predictions(s, d), "prediction_ratio", "target_ratio"),
    _PRED + """, m AS (SELECT quantile_cont(prediction_ratio, 0.5) AS m FROM pred);;SELECT regr_slope(target_ratio, prediction_ratio) AS slope, regr_intercept(target_ratio, prediction_ratio) AS intercept, regr_r2(target_ratio, prediction_ratio) AS r2,
    avg(target_ratio) FILTER (prediction_ratio > m) AS mean_above, stddev_pop(target_ratio) FILTER (prediction_ratio > m) AS std_above, count(*) FILTER (prediction_ratio > m) AS n_above FROM pred, m""", ("n_above",), ["slope", "intercept", "r2", "mean_above", "std_above"])
_LV = [0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 0.95]
add("a31_threshold_table", lambda s, d: A.threshold_table(predictions(s, d), "prediction_ratio", "target_ratio", _LV),
    _PRED + ";;" + " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, avg(target_ratio) AS mean_result, ln(pow(avg(target_ratio), 52 * (1 - {q}::DOUBLE))) AS log_yearly FROM pred WHERE prediction_ratio >= (SELECT quantile_cont(prediction_ratio, {q}) FROM pred)" for q in _LV), (), ["q", "mean_result"])
add("a32_rows_per_date", lambda s, d: A.rows_per_date(views.bars(s, d)), 'SELECT "Date", count(*) AS n FROM bars GROUP BY 1', ("Date", "n"))

# -- samples, checks, groups ---------------------------------------------------------
add("p01_between", lambda s, d: P.between_dates(views.bars(s, d), "1995-01-15", "1995-02-15"), """SELECT * FROM bars WHERE "Date" BETWEEN DATE '1995-01-15' AND DATE '1995-02-15'""", KEY, ["Close"])
add("p03_drop_incomplete", lambda s, d: P.drop_incomplete(_holes(views.bars(s, d)), ["x"]).select(*KEY), _HOLES + f'SELECT ticker, "Date" FROM (SELECT *, lead("Date") OVER ({BY}) IS NULL AS l FROM h) WHERE x IS NOT NULL OR l', KEY)
add("p04_numbers", lambda s, d: P.numbers_from_text(s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.when(F.col("p_size") % 5 == 0, "None").otherwise(F.col("p_size").cast("string")).alias("v"), F.col("p_name").alias("t")), ["p_partkey"]),
    "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_size::DOUBLE END AS v, TRY_CAST(p_name AS DOUBLE) AS t FROM part", ("p_partkey",), ["v", "t"], ctes=())
add("p05_report_time", lambda s, d: P.restrict_report_time(views.fin_q(s, d).withColumn("reportTime", F.coalesce("reportTime", F.lit("later")))), 'SELECT * FROM fin_q', ("ticker", "fiscalDateEnding", "reportTime"), ctes=("fin_q",))
add("p06_complete_rows", lambda s, d: P.complete_rows(W.with_drawdowns(views.bars(s, d), [4]), ["drawdown_4"]).select(*KEY), f'SELECT ticker, "Date" FROM (SELECT *, count(*) OVER {last_rows(84)} AS n FROM bars) WHERE n = 84', KEY)
add("p07_removed", lambda s, d: P.removed_counts(W.with_targets(W.with_lags(views.bars(s, d), ["Close"], [20])), ["Close_lag_m20", "Volume"], "target_price"),
    f'SELECT count(*) FILTER (t IS NULL) AS no_target, count(*) FILTER (l IS NULL) AS bad_features, count(*) AS n_rows FROM (SELECT lead("AdjClose", 5) OVER ({BY}) AS t, {lag(chr(34) + "Close" + chr(34), 20)} AS l FROM bars)', ("no_target", "bad_features", "n_rows"))
add("p09_validate_bars", lambda s, d: C.validate_bars(views.bars(s, d)), 'SELECT ticker, count(*) AS n_rows, count(*) - count("Date") AS null_dates, count(*) FILTER (least("Open", "High", "Low", "Close") < 0) AS negative_prices, 0::BIGINT AS null_numbers, count("Date") - count(DISTINCT "Date") AS repeated_dates, count(*) FILTER ("High" < "Low") AS high_below_low FROM bars GROUP BY 1',
    ("ticker", "n_rows", "null_dates", "negative_prices", "null_numbers", "repeated_dates", "high_below_low"))
add("p10_validate_statements", lambda s, d: C.validate_statements(views.fin_q(s, d), True), 'SELECT ticker, count(*) AS n_rows, 0::BIGINT AS null_dates, 0::BIGINT AS null_numbers, 0::BIGINT AS null_reported, count(*) FILTER ("reportedDate" < "fiscalDateEnding") AS reported_before_end, 0::BIGINT AS odd_report_time FROM fin_q GROUP BY 1',
    ("ticker", "n_rows", "null_dates", "null_numbers", "null_reported", "reported_before_end", "odd_report_time"), ctes=("fin_q",))
add("p11_feature_ranges", lambda s, d: C.feature_ranges(_holes(views.bars(s, d)), ["Close", "x"]), _HOLES + """SELECT 'Close' AS feature, min("Close") AS least, max("Close") AS most, 0::BIGINT AS n_null, 0::BIGINT AS n_not_finite FROM h UNION ALL SELECT 'x', min(x), max(x), count(*) - count(x), 0 FROM h""", ("feature", "n_null", "n_not_finite"), ["least", "most"])
add("p12_rows_with_nulls", lambda s, d: C.rows_with_nulls(_holes(views.bars(s, d))).select(*KEY), _HOLES + 'SELECT ticker, "Date" FROM h WHERE x IS NULL', KEY)
_tt = lambda s, d: (views.bars(s, d).where(F.year("Date") < 1997), views.bars(s, d).where(F.year("Date") >= 1997))
add("p13_standard_scale", lambda s, d: P.standard_scale(*_tt(s, d), ["Close", "Splits"])[1],
    'm AS (SELECT avg("Close") AS a, stddev_pop("Close") AS b FROM bars WHERE year("Date") < 1997);;SELECT ticker, "Date", ("Close" - a) / b AS "Close", 0.0::DOUBLE AS "Splits" FROM bars, m WHERE year("Date") >= 1997', KEY, ["Close", "Splits"])
add("p14_stretch", lambda s, d: P.stretch(W.with_sequence(views.bars(s, d).withColumn("y", F.col("Close") / 2000), "y", 5).where("y_seq is not null"), "y_seq").select(*KEY, F.col("y_seq")[0].alias("a"), F.col("y_seq")[4].alias("e")),
    f"""q AS (SELECT ticker, "Date", y, {lag("y", 4)} AS y4, min(y) OVER {last_rows(5)} AS lo, max(y) OVER {last_rows(5)} AS hi FROM (SELECT *, "Close" / 2000 AS y FROM bars)),
    w AS (SELECT *, CASE WHEN abs(greatest(hi - 0.5, 0.5 - lo)) < 1e-6 THEN 1.0 ELSE greatest(hi - 0.5, 0.5 - lo) END AS wd FROM q WHERE y4 IS NOT NULL);;SELECT ticker, "Date", greatest(0, least(1, (y4 - 0.5) / wd + 0.5)) AS a, greatest(0, least(1, (y - 0.5) / wd + 0.5)) AS e FROM w""", KEY, ["a", "e"])
add("p15_min_max", lambda s, d: P.min_max_scale(views.bars(s, d), ["Close"]), 'SELECT ticker, "Date", ("Close" - min("Close") OVER ()) / (max("Close") OVER () - min("Close") OVER ()) AS "Close" FROM bars', KEY, ["Close"])
add("p16_target_squash", lambda s, d: predictions(s, d).select(*KEY, X.target_squash("target_ratio").alias("y"), X.target_unsquash(X.target_squash("prediction_ratio")).alias("back"), X.clip("target_ratio", 1e-2, 1e2).alias("c")),
    _PRED + ';;SELECT ticker, "Date", tanh((target_ratio - 1) * 10) / 2 + 0.5 AS y, prediction_ratio AS back, greatest(1e-2, least(1e2, target_ratio)) AS c FROM pred', KEY, ["y", "c"])
add("p17_recent", lambda s, d: P.recent_days(views.bars(s, d), 500), 'SELECT * FROM bars WHERE "Date" >= (SELECT max("Date") FROM bars) - 500', KEY, ["Close"])
add("p18_repair_dates", lambda s, d: P.repair_dates(views.bars(s, d).select("Date").distinct(), views.fin_q(s, d).select(F.col("reportedDate").alias("Date"))),
    """t AS (SELECT DISTINCT "Date" AS d FROM bars), o AS (SELECT DISTINCT "reportedDate" AS "Date" FROM fin_q);;SELECT DISTINCT o."Date" FROM t ASOF JOIN o ON t.d >= o."Date" """, ("Date",), ctes=("bars", "fin_q"))
add("g02_bars_since", lambda s, d: C.bars_since(views.bars(s, d), 1996, "1998-12-05"),
    """SELECT ticker, date_diff('day', max("Date"), DATE '1998-12-05') <= 20 AND count(*) >= floor(250 * date_diff('day', DATE '1996-01-01', max("Date")) / 365.0::DOUBLE) AS ok FROM bars WHERE "Date" >= DATE '1996-01-01' GROUP BY 1""", ("ticker", "ok"))
add("g03_regular", lambda s, d: C.regular_bars(views.bars(s, d)), """SELECT ticker, count(*) >= floor(250 * date_diff('day', min("Date"), max("Date")) / 365.0::DOUBLE) AS ok FROM bars GROUP BY 1""", ("ticker", "ok"))
add("g05_groups", lambda s, d: C.generate_groups(C.check_table(views.bars(s, d), views.fin_q(s, d), views.fin_a(s, d), views.asset(s, d), "1998-12-05", _membership(s, d)), C.CRITERIA | {"thirds": lambda: F.col("sp500")}),
    "SELECT g AS \"group\", ticker FROM asset, (SELECT unnest(['snp500', 'thirds']) AS g) WHERE ticker::INT % 3 = 0", ("group", "ticker"), ctes=("asset",))

# -- holidays ------------------------------------------------------------------------
def _holidays(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(f"{y}-{md}", n) for y in range(1990, 2003) for md, n in (("01-01", "new year"), ("05-01", "may day"), ("12-25", "christmas"))], "d string, name string").select(F.to_date("d").alias("Date"), "name")


_HOL = "hol AS (SELECT CAST(y || '-' || md AS DATE) AS h FROM (SELECT unnest(range(1990, 2003)) AS y), (SELECT unnest(['01-01', '05-01', '12-25']) AS md))"
add("f04_holiday_distance", lambda s, d: B.with_holiday_distance(views.bars(s, d).select("Date").distinct(), _holidays(s)),
    _HOL + """, b AS (SELECT DISTINCT "Date" FROM bars), n AS (SELECT b.*, x.h AS nh FROM b ASOF LEFT JOIN hol x ON b."Date" <= x.h), l AS (SELECT n.*, x.h AS lh FROM n ASOF LEFT JOIN hol x ON n."Date" >= x.h);;
    SELECT "Date", a AS days_to_holiday, z AS days_since_holiday, CASE WHEN a <= z THEN a ELSE -z END AS nearest_holiday, z = 0 AS is_holiday FROM (SELECT *, date_diff('day', "Date", nh) AS a, date_diff('day', lh, "Date") AS z FROM l)""",
    ("Date", "days_to_holiday", "days_since_holiday", "nearest_holiday", "is_holiday"))

# -- indicators ----------------------------------------------------------------------
_TA = lambda s, d: indicators.window_indicators(views.bars(s, d))
_C, _H, _L, _V, _A = '"Close"', '"High"', '"Low"', '"Volume"', '"AdjClose"'


def over(agg: str, x: str, n: int) -> str:
    return f"{agg}({x}) OVER {last_rows(n)}"


add("t01_sma", _TA, f"SELECT *, {over('avg', _C, 12)} AS trend_sma_fast, {over('avg', _C, 26)} AS trend_sma_slow FROM bars", KEY, ["trend_sma_fast", "trend_sma_slow"])
add("t04_bollinger", _TA, f"SELECT *, m + 2 * s AS volatility_bbh, 100 * 4 * s / nullif(m, 0) AS volatility_bbw FROM (SELECT *, {over('avg', _C, 20)} AS m, {over('stddev_pop', _C, 20)} AS s FROM bars)", KEY, ["volatility_bbh", "volatility_bbw"], digits=4)
add("t05_keltner", _TA, f"SELECT *, {over('avg', f'({_H} + {_L} + {_C}) / 3', 10)} AS volatility_kcc, {over('avg', f'(4 * {_H} - 2 * {_L} + {_C}) / 3', 10)} AS volatility_kch FROM bars", KEY, ["volatility_kcc", "volatility_kch"])
add("t06_donchian", _TA, f"SELECT *, (lo + hi) / 2 AS volatility_dcm, ({_C} - lo) / nullif(hi - lo, 0) AS volatility_dcp FROM (SELECT *, {over('min', _L, 20)} AS lo, {over('max', _H, 20)} AS hi FROM bars)", KEY, ["volatility_dcm", "volatility_dcp"])
add("t08_ulcer", _TA, f"SELECT *, sqrt({over('avg', 'f * f', 14)}) AS volatility_ui FROM (SELECT *, 100 * ({_C} - {over('max', _C, 14)}) / nullif({over('max', _C, 14)}, 0) AS f FROM bars)", KEY, ["volatility_ui"])
_TR = f"tr AS (SELECT *, greatest({_H} - {_L}, abs({_H} - {lag(_C)}), abs({_L} - {lag(_C)})) AS tr, abs({_H} - {lag(_L)}) AS vp, abs({_L} - {lag(_H)}) AS vm, {_C} - least({_L}, {lag(_C)}) AS bp, greatest({_H}, {lag(_C)}) - least({_L}, {lag(_C)}) AS rg FROM bars);;"
add("t09_vortex", _TA, _TR + f"SELECT *, {over('sum', 'vp', 14)} / nullif({over('sum', 'tr', 14)}, 0) AS trend_vortex_ind_pos, {over('sum', 'vm', 14)} / nullif({over('sum', 'tr', 14)}, 0) AS trend_vortex_ind_neg FROM tr", KEY, ["trend_vortex_ind_pos", "trend_vortex_ind_neg"])
add("t12_dpo", _TA, f"SELECT *, {lag(_C, 11)} - {over('avg', _C, 20)} AS trend_dpo FROM bars", KEY, ["trend_dpo"])
add("t13_kst", _TA, "k AS (SELECT *, " + ", ".join(f"({_C} - {lag(_C, r)}) / nullif({lag(_C, r)}, 0) AS r{r}" for r in (10, 15, 20, 30)) + f" FROM bars);;SELECT *, 100 * ({over('avg', 'r10', 10)} + 2 * {over('avg', 'r15', 10)} + 3 * {over('avg', 'r20', 10)} + 4 * {over('avg', 'r30', 15)}) AS trend_kst FROM k", KEY, ["trend_kst"])
add("t14_ichimoku", _TA, "SELECT *, " + ", ".join(f"({over('max', _H, n)} + {over('min', _L, n)}) / 2 AS trend_ichimoku_{k}" for k, n in (("conv", 9), ("base", 26), ("b", 52))) + " FROM bars", KEY, ["trend_ichimoku_conv", "trend_ichimoku_base", "trend_ichimoku_b"])
add("t15_visual_ichimoku", _TA, f"SELECT *, {lag('b', 26)} AS trend_visual_ichimoku_b FROM (SELECT *, ({over('max', _H, 52)} + {over('min', _L, 52)}) / 2 AS b FROM bars)", KEY, ["trend_visual_ichimoku_b"])
add("t24_ultimate", _TA, _TR + "SELECT *, 100 * (" + " + ".join(f"{k} * {over('sum', 'bp', n)} / nullif({over('sum', 'rg', n)}, 0)" for k, n in ((4, 7), (2, 14), (1, 28))) + ") / 7 AS momentum_uo FROM tr", KEY, ["momentum_uo"])
add("t25_stochastic", _TA, f"SELECT *, {over('avg', 'momentum_stoch', 3)} AS momentum_stoch_signal FROM (SELECT *, 100 * ({_C} - {over('min', _L, 14)}) / nullif({over('max', _H, 14)} - {over('min', _L, 14)}, 0) AS momentum_stoch FROM bars)", KEY, ["momentum_stoch", "momentum_stoch_signal"])
add("t26_williams", _TA, f"SELECT *, -100 * ({over('max', _H, 14)} - {_C}) / nullif({over('max', _H, 14)} - {over('min', _L, 14)}, 0) AS momentum_wr FROM bars", KEY, ["momentum_wr"])
add("t27_awesome", _TA, f"SELECT *, {over('avg', f'({_H} + {_L}) / 2', 5)} - {over('avg', f'({_H} + {_L}) / 2', 34)} AS momentum_ao FROM bars", KEY, ["momentum_ao"])
add("t29_roc", _TA, f"SELECT *, 100 * ({_C} - {lag(_C, 12)}) / nullif({lag(_C, 12)}, 0) AS momentum_roc FROM bars", KEY, ["momentum_roc"])
_RUN = frame("UNBOUNDED PRECEDING", "CURRENT ROW")
_CLV = f"v AS (SELECT *, coalesce((2 * {_C} - {_L} - {_H}) / nullif({_H} - {_L}, 0), 0) * {_V} AS f, {lag(_C)} AS pc, ({_H} + {_L} + {_C}) / 3 AS tp FROM bars);;"
add("t32_adi", _TA, _CLV + f"SELECT *, sum(f) OVER {_RUN} AS volume_adi FROM v", KEY, ["volume_adi"])
add("t33_obv", _TA, _CLV + f"SELECT *, sum(CASE WHEN {_C} < pc THEN -{_V} ELSE {_V} END) OVER {_RUN} AS volume_obv FROM v", KEY, ["volume_obv"])
add("t34_cmf", _TA, _CLV + f"SELECT *, {over('sum', 'f', 20)} / nullif({over('sum', _V, 20)}, 0) AS volume_cmf FROM v", KEY, ["volume_cmf"])
add("t36_ease", lambda s, d: _TA(s, d).withColumn("volume_em", F.col("volume_em") / 1e8), f"SELECT *, (({_H} - {lag(_H)}) + ({_L} - {lag(_L)})) * ({_H} - {_L}) / (2 * {_V}) AS volume_em FROM bars", KEY, ["volume_em"])
add("t37_vpt", _TA, _CLV + f"SELECT *, sum({_V} * (({_C} - pc) / nullif(pc, 0))) OVER {_RUN} AS volume_vpt FROM v", KEY, ["volume_vpt"])
add("t38_vwap", _TA, _CLV + f"SELECT *, {over('sum', f'tp * {_V}', 14)} / nullif({over('sum', _V, 14)}, 0) AS volume_vwap FROM v", KEY, ["volume_vwap"])
add("t39_mfi", _TA, _CLV.replace(";;", f", m AS (SELECT *, {lag('tp')} AS tp1 FROM v);;") + f"SELECT *, 100 * u / nullif(u + w, 0) AS volume_mfi FROM (SELECT *, {over('sum', f'CASE WHEN tp > tp1 THEN tp * {_V} ELSE 0 END', 14)} AS u, {over('sum', f'CASE WHEN tp < tp1 THEN tp * {_V} ELSE 0 END', 14)} AS w FROM m)", KEY, ["volume_mfi"])
add("t40_nvi", lambda s, d: _TA(s, d).withColumn("log_nvi", F.ln("volume_nvi")), f"SELECT *, ln(1000) + sum(CASE WHEN {_V} < pv THEN ln({_C} / pc) ELSE 0 END) OVER {_RUN} AS log_nvi FROM (SELECT *, {lag(_C)} AS pc, {lag(_V)} AS pv FROM bars)", KEY, ["log_nvi"])
add("t42_preprocess", lambda s, d: indicators.preprocess(_TA(s, d)).select(*KEY, "trend_dpo", "momentum_roc", "volume_nvi"),
    f"SELECT *, 1 / (1 + exp(-({lag(_C, 11)} - {over('avg', _C, 20)}) / 100)) AS trend_dpo, ({_C} - {lag(_C, 12)}) / nullif({lag(_C, 12)}, 0) AS momentum_roc FROM bars", KEY, ["trend_dpo", "momentum_roc"])

# -- functions, screens, ledger, gaps ------------------------------------------------
add("f03_date_fields", lambda s, d: views.bars(s, d).select("Date").distinct().withColumns(X.date_fields("Date")),
    """SELECT *, year("Date") AS year, month("Date") AS month, isodow("Date") - 1 AS weekday, week("Date") AS iso_week, quarter("Date") AS quarter, day(last_day("Date")) AS days_in_month, dayname("Date") AS day_name, isodow("Date") > 5 AS is_weekend, "Date" = last_day("Date") AS is_month_end FROM (SELECT DISTINCT "Date" FROM bars)""",
    ("Date", "year", "month", "weekday", "iso_week", "quarter", "days_in_month", "day_name", "is_weekend", "is_month_end"))
add("f06_stop_loss", lambda s, d: W.with_targets(views.bars(s, d), 3).where("target_close_at3 is not null").select(*KEY, X.stop_loss("Close", [F.col(f"target_close_at{i}") for i in (1, 2, 3)]).alias("result")),
    f"""SELECT ticker, "Date", CASE WHEN a1 / "Close" <= 0.92 THEN a1 WHEN a2 / "Close" <= 0.92 THEN a2 ELSE a3 END AS result FROM (SELECT *, """ + ", ".join(f'lead("AdjClose", {i}) OVER ({BY}) * ("Close" / "AdjClose") AS a{i}' for i in (1, 2, 3)) + " FROM bars) WHERE a3 IS NOT NULL", KEY, ["result"])
_FEATS = ["Close_lag_m1", "Volume", "drawdown_1"]


def _panel(s: SparkSession, d: str) -> DataFrame:
    df = W.with_targets(W.with_drawdowns(W.with_lags(views.bars(s, d), ["Close"], [1]), [1]), 5)
    return df.where("drawdown_1 is not null and target_ratio is not null").select(*KEY, *_FEATS, "target_ratio")


_PANEL = f"""pn AS (SELECT * FROM (SELECT ticker, "Date", "Volume", {lag(_C)} AS "Close_lag_m1", ("AdjClose" - h) / nullif(h, 0) AS drawdown_1, lead("AdjClose", 5) OVER ({BY}) / nullif(lead(ao, 1) OVER ({BY}), 0) AS target_ratio
  FROM (SELECT *, {full("max", '"AdjClose"', 21)} AS h, "Open" * ("AdjClose" / "Close") AS ao FROM bars)) WHERE drawdown_1 IS NOT NULL AND target_ratio IS NOT NULL)"""
add("m04_feature_scores", lambda s, d: screens.feature_scores(_panel(s, d), _FEATS, "target_ratio", 0.9),
    _PANEL + ";;" + " UNION ALL ".join(f"""SELECT '{f}' AS feature, avg(m) AS score FROM (SELECT "Date", coalesce(avg(target_ratio) FILTER ("{f}" > (SELECT quantile_cont("{f}", 0.9) FROM pn)), 0) AS m FROM pn GROUP BY 1)""" for f in _FEATS), ("feature",), ["score"])
_LEVELS = [0.005, 0.01, 0.02, 0.98, 0.99, 0.995]
_HITS = _PANEL + ", hits AS (" + " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, {q}::DOUBLE AS q, '{t}' AS tail, ticker, "Date", target_ratio FROM pn WHERE "{f}" {op} (SELECT quantile_cont("{f}", {q}) FROM pn)"""
    for f in _FEATS for q in _LEVELS for t, op in (("upper", ">="), ("lower", "<="))) + """), per AS (SELECT feature, q, tail, "Date", count(*) AS n, sum(target_ratio) AS s, avg(target_ratio) AS m FROM hits GROUP BY 1, 2, 3, 4),
    g AS (SELECT *, date_diff('day', lag("Date") OVER (PARTITION BY feature, q, tail ORDER BY "Date"), "Date") AS gap FROM per), ro AS (SELECT *, avg(target_ratio) OVER h AS r, count(*) OVER h AS k FROM hits WINDOW h AS (PARTITION BY feature, q, tail ORDER BY "Date", ticker ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
    rs AS (SELECT feature, q, tail, avg(r) AS roll_mean, stddev_samp(r) AS roll_std, arg_max(r, {'a': "Date", 'b': ticker}) AS roll_last FROM ro WHERE k = 200 GROUP BY 1, 2, 3),
    su AS (SELECT feature, q, tail, sum(n)::BIGINT AS n, sum(s) / sum(n) AS mean_target, avg(m) AS mean_of_dates, count(*) AS n_dates, max(gap) AS max_gap FROM g GROUP BY 1, 2, 3),
    sc AS (SELECT su.*, roll_mean, roll_std, roll_last, CASE WHEN n >= (CASE tail WHEN 'upper' THEN 1 - q ELSE q END) * (SELECT count(*) FROM pn) AND coalesce(max_gap, 0) <= 100 THEN roll_last * CASE WHEN roll_std < 1 THEN 1 - roll_std WHEN roll_std >= 1 THEN 0 END ELSE 0 END AS score
      FROM su LEFT JOIN rs USING (feature, q, tail));;"""
_screened = lambda s, d: screens.quantile_screen(_panel(s, d), _FEATS, "target_ratio", _LEVELS)
add("m10_quantile_screen", _screened, _HITS + "SELECT * FROM sc", ("feature", "tail", "n", "n_dates", "max_gap"), ["q", "mean_target", "mean_of_dates", "roll_mean", "roll_std", "roll_last", "score"])
add("m10_best_tails", lambda s, d: screens.best_tails(screens.quantile_screen(
    _panel(s, d), _FEATS, "target_ratio", _LEVELS, only=screens.tails_within(_LEVELS, _LEVELS[:3])), _LEVELS[:3]),
    _HITS + "SELECT feature, q0 AS q, max(score) AS score FROM (SELECT *, round(CASE tail WHEN 'upper' THEN 1 - q ELSE q END, 9) AS q0 FROM sc) WHERE q0 < 0.1 GROUP BY 1, 2", ("feature",), ["q", "score"])
add("m11_predicates", lambda s, d: screens.predicate_screen(_panel(s, d), {"low": F.col("drawdown_1") < -0.4, "busy": F.col("Volume") > 60, "either": (F.col("drawdown_1") < -0.4) | (F.col("Volume") > 60)}, "target_ratio"),
    _PANEL + ";;" + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n, avg(target_ratio) AS mean_target FROM pn WHERE {c}" for n, c in (("low", "drawdown_1 < -0.4"), ("busy", '"Volume" > 60'), ("either", 'drawdown_1 < -0.4 OR "Volume" > 60'))), ("name", "n"), ["mean_target"])
add("m13_mean_by_score", lambda s, d: screens.mean_by_score(_panel(s, d), "drawdown_1", "target_ratio", 0.8, 4),
    _PANEL + ", c AS (SELECT quantile_cont(drawdown_1, 0.8) AS c FROM pn), m AS (SELECT avg(target_ratio) FILTER (drawdown_1 >= c) AS above, avg(target_ratio) FILTER (drawdown_1 < c) AS below FROM pn, c);;SELECT above, below, pow(above, 0.25) AS above_root, pow(below, 0.25) AS below_root FROM m", (), ["above", "below", "above_root", "below_root"])


def _trades(s: SparkSession, d: str) -> DataFrame:
    t = s.read.parquet(f"{d}/lineitem.parquet")
    return t.select(F.col("l_suppkey").cast("string").alias("ticker"), F.to_date("l_shipdate").alias("Date"), F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


_TRADES = "t AS (SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS \"Date\", CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity, l_extendedprice / l_quantity AS price FROM lineitem)"
_POS = """, ps AS (SELECT ticker, "Date", sum(sum(quantity)) OVER (PARTITION BY ticker ORDER BY "Date") AS q FROM t GROUP BY 1, 2)"""
_CASH = """, ch AS (SELECT "Date", 1e6::DOUBLE + sum(sum(-quantity * price - 0.002::DOUBLE * abs(quantity * price))) OVER (ORDER BY "Date") AS cash FROM t GROUP BY 1)"""
add("l01_positions", lambda s, d: ledger.positions(_trades(s, d)), _TRADES + _POS + ';;SELECT ticker, "Date", CASE WHEN q < 1e-5 THEN 0.0 ELSE q END AS quantity, q < -1e-9 AS oversold FROM ps', (*KEY, "oversold"), ["quantity"], ctes=())



def _millions(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c) / 1e6 for c in columns})


add("l02_cash", lambda s, d: _millions(ledger.cash(_trades(s, d), 1e6), "cash"), _TRADES + _CASH + ';;SELECT * REPLACE (cash / 1e6 AS cash), cash < 0 AS overdrawn FROM ch', ("Date", "overdrawn"), ["cash"], ctes=(), digits=4)
add("l03_value", lambda s, d: _millions(ledger.value(_trades(s, d), views.bars(s, d), 1e6), "cash", "holdings", "value"),
    _TRADES + _POS + _CASH + """, dd AS (SELECT DISTINCT "Date" FROM bars), m AS (SELECT dd."Date", ch.cash FROM dd ASOF JOIN ch ON dd."Date" >= ch."Date"), w AS (SELECT b."Date", sum(CASE WHEN ps.q < 1e-5 THEN 0 ELSE coalesce(ps.q, 0) END * b."Close") AS holdings FROM bars b ASOF LEFT JOIN ps ON b.ticker = ps.ticker AND b."Date" >= ps."Date" GROUP BY 1);;
    SELECT m."Date", cash / 1e6 AS cash, holdings / 1e6 AS holdings, (cash + holdings) / 1e6 AS value FROM m JOIN w ON m."Date" = w."Date" """, ("Date",), ["cash", "holdings", "value"], digits=4)
add("x01_fill_business_days", lambda s, d: gaps.fill_business_days(views.ticks(s, d), noise=False),
    """s AS (SELECT ticker, CAST(unnest(generate_series(min("Date"), max("Date"), INTERVAL 1 DAY)) AS DATE) AS "Date" FROM ticks GROUP BY 1), j AS (SELECT s.*, price FROM s LEFT JOIN ticks USING (ticker, "Date") WHERE isodow(s."Date") < 6),
    k AS (SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY "Date" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, first_value(price IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY "Date" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM j);;
    SELECT ticker, "Date", price IS NULL AS filled, coalesce(price, (p + n) / 2, p, n, 0) AS price FROM k""", (*KEY, "filled"), ["price"], ctes=("ticks",))

# -- sources -------------------------------------------------------------------------
add("s02_read_bars", lambda s, d: vendor.read_bars(views.bars(s, d).select("ticker", F.date_format("Date", "yyyy-MM-dd").alias("date"), *[F.col(v).cast("string").alias(k) for k, v in list(vendor.BAR_NAMES.items())[1:]])), "SELECT * FROM bars", KEY, ["Open", "Close", "Volume"])
add("s03_overview", lambda s, d: vendor.read_overview(views.asset(s, d).select(F.col("ticker").alias("Symbol"), F.element_at(F.array(*[F.lit(x) for x in [*vendor.SECTOR_NAMES, "?"]]), F.col("ticker").cast("int") % 9 + 1).alias("Sector"))).select("ticker", "sector"),
    "SELECT ticker, [" + ", ".join(f"'{v}'" for v in vendor.SECTOR_NAMES.values()) + ", NULL][ticker::INT % 9 + 1] AS sector FROM asset", ("ticker", "sector"), ctes=("asset",))
add("s04_symbols", lambda s, d: vendor.symbol_list(s.read.parquet(f"{d}/customer.parquet").groupBy(F.element_at(F.array(*[F.lit(x) for x in ("nyse", "Nasdaq", "AMEX", "SIX", "other")]), F.col("c_nationkey") % 5 + 1).alias("stockExchange")).agg(F.collect_list("c_name").alias("stocks")), True),
    "SELECT DISTINCT CASE c_nationkey % 5 WHEN 3 THEN CASE WHEN lower(c_name) LIKE 'ch%' OR lower(c_name) LIKE '%.sw' THEN c_name ELSE c_name || '.SW' END ELSE c_name END AS ticker FROM customer WHERE c_nationkey % 5 <> 4", ("ticker",), ctes=())
add("s11_typed", lambda s, d: schemas.typed(views.bars(s, d).select("ticker", F.when(F.col("Volume") % 4 == 0, "no date").otherwise(F.date_format("Date", "yyyy-MM-dd")).alias("Date"), "Close"), ["Date"]), 'SELECT ticker, CASE WHEN "Volume" % 4 <> 0 THEN "Date" END AS "Date", "Close" FROM bars', KEY, ["Close"])
add("s13_pack_unpack", lambda s, d: stores.unpack(stores.pack(views.bars(s, d))), "SELECT * FROM bars", KEY, ["Close", "Volume"])
add("s14_meta_prices", lambda s, d: J.attach(J.grid(views.bars(s, d), views.bars(s, d)), views.bars(s, d), KEY, ["Close", "Open"]),
    """SELECT ticker, "Date", b."Close", b."Open" FROM (SELECT * FROM (SELECT DISTINCT "Date" FROM bars), (SELECT DISTINCT ticker FROM bars)) LEFT JOIN bars b USING (ticker, "Date")""", KEY, ["Close", "Open"])


# -- flagship ------------------------------------------------------------------------
def top_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars, drawdowns and returns, forward targets, the five best of each date, geometric means per date."""
    df = W.with_targets(W.with_drawdowns(W.with_differences(views.bars(spark, sf_dir)), [1]), 5)
    df = df.where("drawdown_1 is not null and target_ratio is not null").withColumn("prediction_ratio", 1 - F.col("drawdown_1"))
    return A.result_per_date(W.top_per_date(df, "prediction_ratio", 5).where("rank <= 5")).select("Date", "n_entries", "mean_pred", "mean_res")


add("entry_top_tickers", top_tickers,
    _PANEL + ';;SELECT "Date", count(*) AS n_entries, exp(avg(ln(1 - drawdown_1))) AS mean_pred, exp(avg(ln(target_ratio))) AS mean_res FROM (SELECT * FROM pn QUALIFY row_number() OVER (PARTITION BY "Date" ORDER BY 1 - drawdown_1 DESC, ticker) <= 5) GROUP BY 1',
    ("Date", "n_entries"), ["mean_pred", "mean_res"])


# -- more scalar functions, merges and look-ups --------------------------------------
add("f01_math", lambda s, d: views.bars(s, d).select(*KEY, X.ln("Close").alias("ln"), F.sqrt("Close").alias("sqrt"), F.hypot("Open", "Close").alias("hypot"), X.clip("Close", 500, 1500).alias("clip"), F.signum(F.col("Close") - F.col("Open")).alias("sign"), X.sigmoid(F.col("Close") - F.col("Open"), 1000).alias("sigmoid")),
    'SELECT *, ln("Close") AS ln, sqrt("Close") AS sqrt, sqrt("Open" * "Open" + "Close" * "Close") AS hypot, greatest(500, least(1500, "Close")) AS clip, sign("Close" - "Open")::DOUBLE AS sign, 1 / (1 + exp(-("Close" - "Open") / 1000)) AS sigmoid FROM bars',
    KEY, ["ln", "sqrt", "hypot", "clip", "sign", "sigmoid"])
add("f02_squashers", lambda s, d: views.bars(s, d).withColumn("q", F.col("Close") / F.col("Open")).select(*KEY, X.tanh01("q", 2.0).alias("a"), X.tanh01_at_one("q").alias("b"), X.linear01(F.col("q") - 1).alias("c"), X.tanh01_log(X.ln("Close"), 1000, 10).alias("e")),
    'SELECT ticker, "Date", tanh(q / 2) / 2 + 0.5 AS a, tanh(q - 1) / 2 + 0.5 AS b, greatest(0, least(1, q / 2)) AS c, tanh((ln("Close") - ln(1000)) / ln(10)) / 2 + 0.5 AS e FROM (SELECT *, "Close" / "Open" AS q FROM bars)', KEY, ["a", "b", "c", "e"])
add("f05_strings", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.lower(F.trim("p_name")).alias("low"), F.col("p_brand").rlike("[13]$").alias("odd"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"), F.col("p_type").contains("A").alias("has_a")),
    "SELECT p_partkey, lower(trim(p_name)) AS low, regexp_matches(p_brand, '[13]$') AS odd, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, contains(p_type, 'A') AS has_a FROM part", ("p_partkey", "low", "odd", "digits", "has_a"), ctes=())
add("f07_maps", lambda s, d: views.asset(s, d).select("ticker", F.try_element_at("about", F.lit("nation")).alias("nation"), F.try_element_at("about", F.lit("none")).alias("none")), "SELECT ticker, nation, NULL::VARCHAR AS none FROM asset", ("ticker", "nation", "none"), ctes=("asset",))
add("f08_arrays", lambda s, d: W.with_sequence(views.bars(s, d), "Close", 3).where("Close_seq is not null").select(*KEY, F.array_min("Close_seq").alias("lo"), F.array_max("Close_seq").alias("hi"), F.aggregate(F.zip_with("Close_seq", F.array(*map(F.lit, (1.0, 2.0, 3.0))), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x).alias("dot")),
    f'SELECT ticker, "Date", least(a, b, "Close") AS lo, greatest(a, b, "Close") AS hi, a + 2 * b + 3 * "Close" AS dot FROM (SELECT *, {lag(_C, 2)} AS a, {lag(_C, 1)} AS b FROM bars) WHERE a IS NOT NULL', KEY, ["lo", "hi", "dot"])
add("f09_valuation", lambda s, d: B.price_metrics(views.bars(s, d), views.fin_q(s, d)),
    """q AS (SELECT *, ebit / nullif(lag(ebit) OVER (PARTITION BY ticker ORDER BY "fiscalDateEnding"), 0) AS eq FROM fin_q);;SELECT b.ticker, b."Date", CASE WHEN q."estimatedEPS" <= 1e-5 THEN 1e-5 WHEN q."estimatedEPS" > 0 THEN ln("Close" / (q."estimatedEPS" * 4)) END AS log_forward_pe_ratio,
    "Close" * CASE WHEN eq IS NOT NULL THEN greatest(-30, least(30, eq)) END AS close2ebit_lagquot_qm1 FROM bars b ASOF LEFT JOIN q ON b.ticker = q.ticker AND b."Date" >= q."reportedDate" """, KEY, ["log_forward_pe_ratio", "close2ebit_lagquot_qm1"], ctes=("bars", "fin_q"), digits=4)
add("f10_trading_cost", lambda s, d: views.bars(s, d).select(*KEY, X.trading_cost(F.col("Close") * F.col("Volume")).alias("cost")), 'SELECT ticker, "Date", "Close" * "Volume" * 0.002::DOUBLE AS cost FROM bars', KEY, ["cost"], digits=4)
add("j06_combine_statements", lambda s, d: J.merge_new_over_old(views.fin_q(s, d), views.fin_q(s, d).where("ticker < '5'").withColumn("ebit", F.when(F.col("reportTime") == "pre-market", F.col("ebit") * 2)), ["ticker", "fiscalDateEnding"], ["ebit", "totalAssets"]),
    """SELECT ticker, "fiscalDateEnding", CASE WHEN ticker < '5' AND "reportTime" = 'pre-market' THEN ebit * 2 ELSE ebit END AS ebit, "totalAssets" FROM fin_q""", ("ticker", "fiscalDateEnding"), ["ebit", "totalAssets"], ctes=("fin_q",), digits=3)
add("j07_realised", lambda s, d: J.attach(predictions(s, d).select(*KEY, "prediction_ratio"), W.with_targets(views.bars(s, d), 5), KEY, ["target_ratio"]),
    _PRED + ';;SELECT ticker, "Date", prediction_ratio, target_ratio FROM pred', KEY, ["prediction_ratio", "target_ratio"])
add("k05_best_rerun", lambda s, d: learning.best_rerun(views.bars(s, d).select(F.col("ticker").alias("cutoff"), F.year("Date").alias("rerun"), F.col("Volume").alias("score")).groupBy("cutoff", "rerun").agg(F.sum("score").alias("score")), "score"),
    """SELECT cutoff, rerun, score FROM (SELECT ticker AS cutoff, year("Date") AS rerun, sum("Volume") AS score FROM bars GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY cutoff ORDER BY score DESC, rerun) = 1""", ("cutoff", "rerun"), ["score"])
add("u01_union_years", lambda s, d: views.bars(s, d).where(F.year("Date") == 1995).unionByName(views.bars(s, d).where(F.year("Date") == 1996)), 'SELECT * FROM bars WHERE year("Date") IN (1995, 1996)', KEY, ["Close"])
add("u05_new_keys", lambda s, d: J.new_keys(*_old_new(s, d)[::-1], ["Date"]), 'SELECT DISTINCT "Date" FROM bars WHERE year("Date") >= 1998', ("Date",))
add("p02_exact_date", lambda s, d: J.attach(views.ticks(s, d).select("Date").distinct().join(views.asset(s, d).select("ticker")), views.bars(s, d), KEY, ["Close"]), 'SELECT ticker, "Date", "Close" FROM (SELECT * FROM (SELECT DISTINCT "Date" FROM ticks), (SELECT ticker FROM asset)) LEFT JOIN bars USING (ticker, "Date")', KEY, ["Close"], ctes=("bars", "ticks", "asset"))
