"""Queries over the feature blocks with their default parameters.

Blocks have hundreds of columns.  A query returns the columns of the row itself, and for
each family of lags, or each array, one number: the sum of its values times 1, 2, 3, ...
(NULL counts as a value that no column has), so that every value of a block is computed
and compared.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fourier
from .operators import indicators
from .operators import windows as W
from .plans import blocks as B
from .queries import _DIFF, _HOL, BY, CTES, KEY, _holidays, _membership, add, full, lag, last_rows
from .sources import views

LAGS, MONTHS, STEPS = B.LAGS, B.MONTHS, B.DEFAULTS["steps"]
CTES |= {"brand_bars": views.by_brand(views.BARS_SQL), "brand_fin_q": views.by_brand(views.FIN_Q_SQL)}
_C, _A = '"Close"', '"AdjClose"'


#: What NULL counts as: none of the columns' scales gives this number.
NOTHING = -1.0078125


def digest(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [(k + 1) * F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(NOTHING)) for k, c in enumerate(columns)])


def digest_sql(values: Sequence[str]) -> str:
    return " + ".join(f"{k + 1} * coalesce({v}, {NOTHING}::DOUBLE)" for k, v in enumerate(values))


def array_digest(column: str, size: int | None = None) -> Column:
    """The digest of an array; of a known ``size`` it is taken place by place."""
    if size is not None:
        return F.when(F.col(column).isNotNull(), reduce(lambda a, b: a + b, [
            (k + 1) * F.coalesce(F.get(column, F.lit(k)), F.lit(NOTHING)) for k in range(size)], F.lit(0.0)))
    weighted = F.transform(column, lambda x, i: (i + 1) * F.coalesce(x.cast("double"), F.lit(NOTHING)))
    return F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)


def sequence_sql(value: str, steps: int = STEPS, stride: int = 1, scale: str = "{}", order: str = BY) -> str:
    """Digest of the last ``steps`` values, ``stride`` rows apart, each within ``scale``."""
    parts = [scale.format(f"lag({value}, {(steps - 1 - j) * stride}) OVER ({order})") for j in range(steps)]
    return f"CASE WHEN row_number() OVER ({order}) >= {(steps - 1) * stride + 1} THEN {digest_sql(parts)} END"


def lag_digests(df: DataFrame, columns: Sequence[str], lags: Sequence[int] = LAGS) -> DataFrame:
    return df.withColumns({f"{c}_lags": digest([f"{c}_lag_m{n}" for n in lags]) for c in columns})


def lag_digest_sql(columns: Sequence[str], lags: Sequence[int] = LAGS) -> str:
    return ", ".join(f'{digest_sql([lag(chr(34) + c + chr(34), n) for n in lags])} AS "{c}_lags"' for c in columns)


def tanh01_sql(x: str, scale: str = "1") -> str:
    return f"tanh(({x}) / {scale}) / 2 + 0.5::DOUBLE"


def ratio_sql(a: str, b: str) -> str:
    """a / b within +-30."""
    return f"CASE WHEN ({a}) IS NOT NULL AND ({b}) <> 0 THEN greatest(-30, least(30, ({a}) / ({b}))) END"


# -- category ------------------------------------------------------------------------
add("b01_category", lambda s, d: B.category(views.bars(s, d), asset=views.asset(s, d), membership=_membership(s, d), sectors=["ASIA", "EUROPE"]),
    "SELECT b.ticker, \"Date\", (sector = 'ASIA')::INT AS \"sector_ASIA\", (sector = 'EUROPE')::INT AS \"sector_EUROPE\", (a.ticker::INT % 3 = 0)::INT AS in_sp500, (a.ticker::INT % 4 = 0)::INT AS in_nas100 FROM bars b JOIN asset a ON a.ticker = b.ticker",
    (*KEY, "sector_ASIA", "sector_EUROPE", "in_sp500", "in_nas100"), ctes=("bars", "asset"))

# -- financial -----------------------------------------------------------------------
QUARTERS, YEARS = range(1, 13), range(1, 4)
NUMBERS = ["grossProfit", "ebit", "ebitda", "totalAssets", "totalCurrentLiabilities", "totalShareholderEquity", "commonStockSharesOutstanding", "operatingCashflow"]
PE = list(B.PRICE_METRICS)
OWN = [*PE, "close2ebit_lagquot_qm1", "close2totalShareholderEquity_lagquot_qm1"]


def _financial(s: SparkSession, d: str) -> DataFrame:
    df = B.financial(views.bars(s, d), fin_q=views.fin_q(s, d), fin_a=views.fin_a(s, d))
    df = lag_digests(df, PE).withColumns({f"{c}_quots": digest([f"{c}_lagquot_m{n}" for n in LAGS]) for c in PE})
    new = {"q_niv": digest([f"q_{c}_nivRev" for c in NUMBERS]), "a_niv": digest([f"a_{c}_nivRev" for c in NUMBERS if c != "commonStockSharesOutstanding"])}
    for tag, columns, lags in (("q", B.QUARTER_LAGS, QUARTERS), ("a", B.ANNUAL_LAGS, YEARS)):
        for c in columns:
            new |= {f"{tag}_{c}_quots": digest([f"{tag}_{c}_lagquot_{tag}m{n}" for n in lags]), f"{tag}_{c}_nivs": digest([f"{tag}_{c}_nivRevLag_{tag}m{n}" for n in lags])}
    return df.withColumns(new).withColumn("q_reportTime", F.col("q_reportTime").cast("double"))


FINANCIAL = [*OWN, *[f"{c}_lags" for c in PE], *[f"{c}_quots" for c in PE], "q_niv", "a_niv", "q_totalRevenue_RANK", "a_totalRevenue_RANK", "q_surprisePercentage", "q_reportTime",
             *[f"{t}_{c}_{k}" for t, columns in (("q", B.QUARTER_LAGS), ("a", B.ANNUAL_LAGS)) for c in columns for k in ("quots", "nivs")]]


def _statement_sql(tag: str, columns: Sequence[str], numbers: Sequence[str], lags: Sequence[int]) -> str:
    back = lambda c, n: f'lag("{c}", {n}) OVER w'
    rev = 'nullif("totalRevenue", 0)'
    niv = [f'"{c}" / {rev}' for c in numbers]
    out = [f"{digest_sql(niv)} AS {tag}_niv", f'coalesce(CASE WHEN "totalRevenue" > 0 THEN ln("totalRevenue") END, 0) / 100 AS "{tag}_totalRevenue_RANK"']
    for c in columns:
        quots, nivs = [ratio_sql(f'"{c}"', back(c, n)) for n in lags], [f"{back(c, n)} / {rev}" for n in lags]
        out += [f'{digest_sql(quots)} AS "{tag}_{c}_quots"', f'{digest_sql(nivs)} AS "{tag}_{c}_nivs"']
    return ", ".join(out)


def _none(n: int) -> str:
    return f"{NOTHING * n * (n + 1) / 2}::DOUBLE"  # the digest of n NULLs


_METRICS = """CASE WHEN eps <= 1e-5 THEN 1e-5 WHEN eps > 0 THEN ln("Close" / (eps * 4)) END AS log_trailing_pe_ratio, CASE WHEN est <= 1e-5 THEN 1e-5 WHEN est > 0 THEN ln("Close" / (est * 4)) END AS log_forward_pe_ratio,
  CASE WHEN book <= 1e-5 THEN 1e-5 WHEN book > 0 THEN ln("Close" / book) END AS log_pb_ratio, "Close" * eq AS close2ebit_lagquot_qm1, "Close" * sq AS "close2totalShareholderEquity_lagquot_qm1" """
_BOOK = '"reportedEPS" AS eps, "estimatedEPS" AS est, "totalShareholderEquity" / nullif("commonStockSharesOutstanding", 0) AS book, ' + ", ".join(
    f"{ratio_sql(c, f'lag({c}, 1) OVER w')} AS {name}" for c, name in (('"ebit"', "eq"), ('"totalShareholderEquity"', "sq")))
_W = 'WINDOW w AS (PARTITION BY ticker ORDER BY "fiscalDateEnding")'
_FIN = f"""fq AS (SELECT * REPLACE (last_value("reportTime" IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY "fiscalDateEnding" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "reportTime") FROM fin_q),
qf AS (SELECT ticker, "reportedDate", {_BOOK}, "surprisePercentage" / 1000 AS "q_surprisePercentage", CASE "reportTime" WHEN 'pre-market' THEN 0 WHEN 'post-market' THEN 1 END AS "q_reportTime",
  {_statement_sql("q", B.QUARTER_LAGS, NUMBERS, QUARTERS)} FROM fq {_W}),
af AS (SELECT ticker, "fiscalDateEnding", {_statement_sql("a", B.ANNUAL_LAGS, [c for c in NUMBERS if c != "commonStockSharesOutstanding"], YEARS)} FROM fin_a {_W}),
j AS (SELECT b.*, qf.* EXCLUDE (ticker) FROM bars b ASOF LEFT JOIN qf ON b.ticker = qf.ticker AND b."Date" >= qf."reportedDate"),
k AS (SELECT j.*, af.* EXCLUDE (ticker) FROM j ASOF LEFT JOIN af ON j.ticker = af.ticker AND j."Date" >= af."fiscalDateEnding"),
m AS (SELECT *, {_METRICS} FROM k);;"""
_FILLED = ", ".join([f"coalesce(q_niv, {_none(8)}) AS q_niv", f"coalesce(a_niv, {_none(7)}) AS a_niv"] + [
    f'coalesce("{t}_{c}_{k}", {_none(n)}) AS "{t}_{c}_{k}"' for t, columns, n in (("q", B.QUARTER_LAGS, 12), ("a", B.ANNUAL_LAGS, 3)) for c in columns for k in ("quots", "nivs")])
add("b02_financial", _financial,
    _FIN + f"SELECT * REPLACE ({_FILLED}), {lag_digest_sql(PE)}, " + ", ".join(f'{digest_sql([ratio_sql(c, lag(c, n)) for n in LAGS])} AS {c}_quots' for c in PE) + " FROM m",
    KEY, FINANCIAL, ctes=("bars", "fin_q", "fin_a"), digits=5)
_STRIDE = (12 * 4 * 21 + 31) // (STEPS - 1)
add("b03_financial_sequence", lambda s, d: B.financial_sequence(views.bars(s, d, "brand"), fin_q=views.fin_q(s, d, "brand")).select(*KEY, *[array_digest(f"{c}_seq").alias(c) for c in OWN]),
    f"""qf AS (SELECT ticker, "reportedDate", {_BOOK} FROM fin_q {_W}), j AS (SELECT b.*, qf.* EXCLUDE (ticker) FROM bars b ASOF LEFT JOIN qf ON b.ticker = qf.ticker AND b."Date" >= qf."reportedDate"), m0 AS (SELECT *, {_METRICS} FROM j),
    m AS (SELECT ticker, "Date", """ + ", ".join(f"coalesce({x}, 0) AS \"{c}\"" for c, x in {
        "log_trailing_pe_ratio": "tanh((log_trailing_pe_ratio - ln(15)) / ln(10)) / 2 + 0.5::DOUBLE", "log_forward_pe_ratio": "tanh((log_forward_pe_ratio - ln(15)) / ln(10)) / 2 + 0.5::DOUBLE",
        "log_pb_ratio": "tanh((log_pb_ratio - ln(3)) / ln(10)) / 2 + 0.5::DOUBLE", "close2ebit_lagquot_qm1": tanh01_sql("close2ebit_lagquot_qm1", "1000"),
        "close2totalShareholderEquity_lagquot_qm1": tanh01_sql('"close2totalShareholderEquity_lagquot_qm1"', "1000")}.items())
    + " FROM m0);;SELECT ticker, \"Date\", " + ", ".join(f'{sequence_sql(chr(34) + c + chr(34), STEPS, _STRIDE)} AS "{c}"' for c in OWN) + " FROM m", KEY, OWN, ctes=("brand_bars", "brand_fin_q"))

# -- mathematical --------------------------------------------------------------------
MOVES = [f"{k}_{m}" for m in MONTHS for k in ("drawdown", "drawup")]
_MOVES_SQL = ", ".join(f'({_A} - {full(f, _A, 21 * m)}) / nullif({full(f, _A, 21 * m)}, 0) AS {k}_{m}' for m in MONTHS for k, f in (("drawdown", "max"), ("drawup", "min")))
MATH = [*B.MATH[1:], *MOVES]
add("b04_mathematical", lambda s, d: lag_digests(B.mathematical(views.bars(s, d)), MATH),
    _DIFF.replace(";;", f""", x AS (SELECT *, diff - {lag("diff")} AS diff2, log_diff - {lag("log_diff")} AS log_diff2, ln("return") + 1 AS log_return, ln("Close") AS log_price, {_MOVES_SQL} FROM m);;""")
    + f"SELECT *, {lag_digest_sql(MATH)} FROM x", KEY, ["log_price", *MATH, *[f"{c}_lags" for c in MATH]], digits=5)
SEQ = ["level_1_seq", "level_3_seq", "level_7_seq", "return_seq", "adjustment_seq"]
add("b05_mathematical_sequence", lambda s, d: B.mathematical_sequence(views.bars(s, d)).select(*KEY, *[array_digest(c).alias(c) for c in SEQ]),
    _DIFF.replace(";;", f""", x AS (SELECT *, {tanh01_sql('"return" - 1')} AS r, {tanh01_sql("adjustment")} AS a FROM m);;""") + "SELECT *, "
    + ", ".join(f'{sequence_sql(_A, STEPS, k, f"(tanh({{}} / {_A} - 1) / 2 + 0.5::DOUBLE)")} AS level_{k}_seq' for k in (1, 3, 7))
    + f", {sequence_sql('r')} AS return_seq, {sequence_sql('a')} AS adjustment_seq FROM x", KEY, SEQ)

# -- seasonal ------------------------------------------------------------------------
SEASON = ["seasonal_year", "seasonal_month", "seasonal_day", "seasonal_weekday", "seasonal_quarter", "seasonal_month_start", "seasonal_month_end", "seasonal_year_start",
          "seasonal_year_end", "seasonal_week_part"]
HELD = ["seasonal_week_of_year", "seasonal_days_to_next_holiday", "seasonal_days_since_last_holiday"]


def _seasonal(s: SparkSession, d: str) -> DataFrame:
    df = lag_digests(B.seasonal(views.bars(s, d), holidays=_holidays(s), start_year=1995, end_year=2001), HELD)
    return df.withColumns({c: F.col(c).cast("double") for c in SEASON})


_NEAR = """n AS (SELECT e.*, x.h AS nh FROM e ASOF LEFT JOIN hol x ON e.day <= x.h), l AS (SELECT n.*, x.h AS lh FROM n ASOF LEFT JOIN hol x ON n.day >= x.h)"""
_HELD_SQL = {"seasonal_week_of_year": "(week(day) - 1) / 51.0::DOUBLE", "seasonal_days_to_next_holiday": "greatest(date_diff('day', day, nh), 90) / 90.0::DOUBLE",
             "seasonal_days_since_last_holiday": "greatest(date_diff('day', lh, day), 90) / 90.0::DOUBLE"}
add("b06_seasonal", _seasonal, _HOL + f""", e AS (SELECT dd.d, n, CAST(dd.d - n AS DATE) AS day FROM (SELECT DISTINCT "Date" AS d FROM bars) dd, (SELECT unnest([0, {", ".join(map(str, LAGS))}])::INT AS n)), {_NEAR},
    g AS (SELECT d, """ + ", ".join([f"max({x}) FILTER (n = 0) AS {c}" for c, x in _HELD_SQL.items()] + [
        f'{digest_sql([f"max({x}) FILTER (n = {k})" for k in LAGS])} AS {c}_lags' for c, x in _HELD_SQL.items()]) + """ FROM l GROUP BY 1);;
    SELECT *, (year("Date") - 1995) / 7.0::DOUBLE AS seasonal_year, (month("Date") - 1) / 11.0::DOUBLE AS seasonal_month, (day("Date") - 1) / (day(last_day("Date")) - 1)::DOUBLE AS seasonal_day, (isodow("Date") - 1) / 6.0::DOUBLE AS seasonal_weekday,
    (quarter("Date") - 1) / 3.0::DOUBLE AS seasonal_quarter, (day("Date") < 7)::INT AS seasonal_month_start, (day("Date") > 21)::INT AS seasonal_month_end, (month("Date") < 3)::INT AS seasonal_year_start, (month("Date") > 10)::INT AS seasonal_year_end,
    CASE WHEN isodow("Date") < 3 THEN 0 WHEN isodow("Date") < 5 THEN 0.5 ELSE 1 END AS seasonal_week_part FROM bars JOIN g ON d = "Date" """, KEY, [*SEASON, *HELD, *[f"{c}_lags" for c in HELD]])
DAYS = ["weekday_seq", "week_seq", "holiday_seq"]
_FROM_END = STEPS  # the j-th of the last days is STEPS - 1 - j days ago and weighs j + 1
add("b07_seasonal_sequence", lambda s, d: B.seasonal_sequence(views.bars(s, d), holidays=_holidays(s)).select(*KEY, *[array_digest(c).alias(c) for c in DAYS]),
    _HOL + f""", e AS (SELECT dd.d, n, CAST(dd.d - n AS DATE) AS day FROM (SELECT DISTINCT "Date" AS d FROM bars) dd, (SELECT unnest(range({STEPS}))::INT AS n)), {_NEAR},
    v AS (SELECT d, {_FROM_END} - n AS k, (isodow(day) - 1) / 6.0::DOUBLE AS a, (week(day) - 1) / 52.0::DOUBLE AS b, CASE WHEN date_diff('day', day, nh) <= date_diff('day', lh, day) THEN date_diff('day', day, nh) ELSE -date_diff('day', lh, day) END AS h FROM l),
    g AS (SELECT d, sum(k * a) AS weekday_seq, sum(k * b) AS week_seq, sum(k * ({tanh01_sql("h", "10.0::DOUBLE")})) AS holiday_seq FROM v GROUP BY 1);;SELECT * FROM bars JOIN g ON d = "Date" """, KEY, DAYS)

# -- group dynamics ------------------------------------------------------------------
_GROUP = f"""r AS (SELECT *, "AdjClose" / nullif({lag('"AdjClose"')}, 0) - 1 AS rp, {full("avg", '"Volume"', 126)} AS w FROM bars),
i0 AS (SELECT "Date", sum("AdjClose" * w) / nullif(sum(w), 0) AS wi, avg(rp) AS avg_return FROM r GROUP BY 1), i AS (SELECT *, wi / nullif(lag(wi) OVER (ORDER BY "Date") + 1e-6, 0) - 1 AS index_pct FROM i0),
g AS (SELECT r.*, i.wi, i.avg_return, i.index_pct, cume_dist() OVER (PARTITION BY r."Date" ORDER BY rp NULLS FIRST) AS return_rank, cume_dist() OVER (PARTITION BY r."Date" ORDER BY "Volume") AS volume_rank,
  (rp - min(rp) OVER p) / nullif(max(rp) OVER p - min(rp) OVER p, 0) AS return_level, ("Volume" - min("Volume") OVER p) / nullif(max("Volume") OVER p - min("Volume") OVER p, 0) AS volume_level
  FROM r JOIN i ON r."Date" = i."Date" WINDOW p AS (PARTITION BY r."Date"))"""
AHEAD = [f"index_pct_lag_m{n}_MH_{m}" for n in LAGS for m in MONTHS]
_AHEAD_SQL = [f'{lag("wi", n)} / nullif({lag("wi", n + 21 * m + 1)} + 1e-6, 0) - 1' for n in LAGS for m in MONTHS]
add("b08_group_dynamics", lambda s, d: lag_digests(B.group_dynamics(views.bars(s, d)), B.GROUP).withColumn("index_ahead", digest(AHEAD)),
    _GROUP + f";;SELECT *, {lag_digest_sql(B.GROUP)}, {digest_sql(_AHEAD_SQL)} AS index_ahead FROM g", KEY, [*B.GROUP, *[f"{c}_lags" for c in B.GROUP], "index_ahead"])
add("b09_group_sequence", lambda s, d: B.group_dynamics_sequence(views.bars(s, d)).select(*KEY, *[array_digest(f"{c}_seq").alias(c) for c in B.GROUP]),
    _GROUP.replace(_A, _C) + f""", h AS (SELECT * REPLACE ({tanh01_sql("avg_return", "0.1::DOUBLE")} AS avg_return, {tanh01_sql("index_pct", "0.1::DOUBLE")} AS index_pct) FROM g);;SELECT ticker, "Date", """
    + ", ".join(f"{sequence_sql(c)} AS {c}" for c in B.GROUP) + " FROM h", KEY, B.GROUP)

# -- Fourier -------------------------------------------------------------------------
CUT, SERIES = B.DEFAULTS["cutoff"], ("price", "ret")


def _fourier_columns(m: int) -> list[Column]:
    out = []
    for x in SERIES:
        out += [digest([f"{x}_{kind}_{k}_MH{m}" for k in range(1, CUT)]).alias(f"{x}_{kind}_MH{m}") for kind in ("sign", "amp")]
        out += [F.col(f"{x}_{kind}_MH{m}") for kind in ("rmse", "ratio")]
    return out


def _fourier(s: SparkSession, d: str) -> DataFrame:
    df = B.fourier_block(views.bars(s, d))
    lagged = [digest([f"{x}_rmse_MH{m}_lag_m{n}" for n in LAGS]).alias(f"{x}_rmse_MH{m}_lags") for m in MONTHS for x in SERIES]
    lagged += [digest([f"{x}_amp_{k}_MH{m}_lag_m{n}" for k in range(1, CUT) for n in LAGS]).alias(f"{x}_amp_MH{m}_lags") for m in MONTHS for x in SERIES]
    return df.select(*KEY, *[c for m in MONTHS for c in _fourier_columns(m)], *lagged)


def _horizon_sql(m: int) -> str:
    """CTEs of one horizon: what each window gives, by sums over its values.

    A value belongs to ``n`` windows, at another place in each; so rows are multiplied with
    the places, and each window sums its values times the kernels.  The residual of a
    partial sum isn't formed: its squares follow from the sums of the values times the
    line's, cosine and sine functions, and from the products of these with each other.
    """
    n = 21 * m + 1
    cos, sin, _ = fourier.kernels(n, B.DEFAULTS["factor"], CUT)
    x, t = np.arange(n) / (n - 1), np.linspace(-np.pi, 0, n)
    basis = np.array([1 - x, x, *[np.cos(k * t) for k in range(CUT)], *[np.sin(k * t) for k in range(1, CUT)]])
    kernels = np.vstack([cos, sin[1:], basis])
    names = [*[f"c{k}" for k in range(CUT)], *[f"s{k}" for k in range(1, CUT)], *[f"b{k}" for k in range(len(basis))]]
    rows = ", ".join("(" + ", ".join([str(j), *[f"{float(v)!r}" for v in kernels[:, j]]]) + ")" for j in range(n))
    out = [f"k{m} AS MATERIALIZED (SELECT j, {', '.join(f'{c}::DOUBLE AS {c}' for c in names)} FROM (VALUES {rows}) v(j, {', '.join(names)}))"]
    sums = [f"count({v}) AS {w}n, sum({v} * {v}) AS {w}yy, sum({v}) FILTER (j = 0) AS {w}y0, sum({v}) FILTER (j = {n - 1}) AS {w}y1, "
            + ", ".join(f"sum({v} * {c}) AS {w}{c}" for c in names) for w, v in (("p", _A), ("r", "log_return"))]
    out.append(f"w{m} AS MATERIALIZED (SELECT ticker, i + {n - 1} - j AS i, {', '.join(sums)} FROM x0, k{m} GROUP BY 1, 2)")
    gram, size = basis @ basis.T, len(basis)

    def residual(w: str, terms: Sequence[int]) -> str:
        """Mean square of the line plus some terms, less the values."""
        of = {0: f"{w}y0", 1: f"{w}y1", **{2 + k: f"{w}c{k}" for k in range(CUT)}, **{1 + CUT + k: f"{w}s{k}" for k in range(1, CUT)}}
        cross = [f"{of[a]} * {w}b{a}" for a in terms]
        squares = [f"{float(gram[a, b]) * (1 if a == b else 2)!r}::DOUBLE * {of[a]} * {of[b]}" for a in terms for b in terms if a <= b]
        return f"greatest({w}yy - 2 * ({' + '.join(cross)}) + {' + '.join(squares)}, 0) / {n}"

    parts = []
    for w, x_, unit in (("p", "price", _A), ("r", "ret", "1")):
        full_ = f"CASE WHEN {w}n = {n} THEN {{}} END"
        parts += [full_.format(f"sign({w}s{k} / {unit})") + f" AS {x_}_sign_{k}_MH{m}" for k in range(1, CUT)]
        parts += [full_.format(f"sqrt({w}c{k} * {w}c{k} + {w}s{k} * {w}s{k}) / abs({unit})") + f" AS {x_}_amp_{k}_MH{m}" for k in range(1, CUT)]
        parts += [full_.format(f"sqrt({residual(w, range(size))}) / abs({unit})") + f" AS {x_}_rmse_MH{m}", full_.format(f"sqrt({residual(w, [0, 1, 2])}) / abs({unit})") + f" AS {x_}_line_MH{m}"]
    out.append(f"f{m} AS (SELECT x0.ticker, x0.i, {', '.join(parts)} FROM x0 LEFT JOIN w{m} USING (ticker, i))")
    return ", ".join(out)


def _fourier_sql(months: Sequence[int]) -> str:
    head = _DIFF.replace(";;", f", x0 AS MATERIALIZED (SELECT *, ln(\"return\") + 1 AS log_return, row_number() OVER ({BY}) AS i FROM m), ")
    columns = []
    for m in months:
        for x in SERIES:
            columns += [digest_sql([f"{x}_{kind}_{k}_MH{m}" for k in range(1, CUT)]) + f" AS {x}_{kind}_MH{m}" for kind in ("sign", "amp")]
            columns += [f"{x}_rmse_MH{m}, {x}_rmse_MH{m} / nullif({x}_line_MH{m}, 0) AS {x}_ratio_MH{m}", *[f"{x}_amp_{k}_MH{m}" for k in range(1, CUT)]]
    joins = " ".join(f"JOIN f{m} USING (ticker, i)" for m in months)
    return head + ", ".join(_horizon_sql(m) for m in months) + f", fm AS MATERIALIZED (SELECT x0.ticker, x0.\"Date\", {', '.join(columns)} FROM x0 {joins});;"


_FOURIER = [f"{x}_{k}_MH{m}" for m in MONTHS for x in SERIES for k in ("sign", "amp", "rmse", "ratio")]
_LAGGED = [f"{x}_{k}_MH{m}_lags" for m in MONTHS for k in ("rmse", "amp") for x in SERIES]
add("b10_fourier", _fourier, _fourier_sql(MONTHS) + "SELECT *, " + ", ".join(
    [digest_sql([lag(f"{x}_rmse_MH{m}", n) for n in LAGS]) + f" AS {x}_rmse_MH{m}_lags" for m in MONTHS for x in SERIES]
    + [digest_sql([lag(f"{x}_amp_{k}_MH{m}", n) for k in range(1, CUT) for n in LAGS]) + f" AS {x}_amp_MH{m}_lags" for m in MONTHS for x in SERIES]) + " FROM fm",
    KEY, [*_FOURIER, *_LAGGED], digits=4)
add("b10_fourier_month", lambda s, d: B.with_fourier(views.bars(s, d), [1]).select(*KEY, *_fourier_columns(1)), _fourier_sql([1]) + "SELECT * FROM fm",
    KEY, [f"{x}_{k}_MH1" for x in SERIES for k in ("sign", "amp", "rmse", "ratio")])
add("b11_fourier_sequence", lambda s, d: B.fourier_sequence(views.bars(s, d)).select(*KEY, array_digest("fourier_rmse_seq").alias("rmse"), array_digest("fourier_ratio_seq").alias("ratio")),
    _fourier_sql([1]) + f"SELECT ticker, \"Date\", {sequence_sql('tanh(price_rmse_MH1)')} AS rmse, {sequence_sql('tanh(price_ratio_MH1)')} AS ratio FROM fm", KEY, ["rmse", "ratio"])

# -- bars over the current bar ------------------------------------------------------
add("t41_bar_columns", lambda s, d: indicators.scaled_columns(views.bars(s, d), [1], ["Open", "High", "Low", "Volume"]),
    "SELECT *, " + ", ".join(f'"{c}" / nullif("Close", 0) AS "FeatureTA_{c}", {lag(chr(34) + c + chr(34))} / nullif("Close", 0) AS "FeatureTA_{c}_lag_m1"' for c in ("Open", "High", "Low"))
    + f""", "Volume" / v AS "FeatureTA_Volume", {lag('"Volume"')} / v AS "FeatureTA_Volume_lag_m1" FROM (SELECT *, CASE WHEN "Volume" < 2 THEN 1 ELSE "Volume" END AS v FROM bars)""",
    KEY, [f"FeatureTA_{c}{x}" for c in ("Open", "High", "Low", "Volume") for x in ("", "_lag_m1")])

# -- price and volume, panel ---------------------------------------------------------
add("b14_price_volume", lambda s, d: B.price_volume_sequence(views.bars(s, d)).select(*KEY, array_digest("price_seq").alias("price"), array_digest("volume_seq").alias("volume")),
    f"""SELECT ticker, "Date", {sequence_sql(_A, scale=f"({{}} / {_A})")} AS price, {sequence_sql('"Volume"', scale="(({} - lo) / nullif(hi - lo, 0))")} AS volume
    FROM (SELECT *, min("Volume") OVER {last_rows(STEPS)} AS lo, max("Volume") OVER {last_rows(STEPS)} AS hi FROM bars)""", KEY, ["price", "volume"])
add("b15_panel", lambda s, d: B.assemble(views.bars(s, d), [W.with_drawdowns(views.bars(s, d), [1])], "1992-01-01", "1998-12-31"),
    f"""wd AS (SELECT CAST(d AS DATE) AS d FROM range(DATE '1992-01-01', DATE '1999-01-01', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6), tk AS (SELECT DISTINCT ticker FROM bars),
    td AS (SELECT DISTINCT b."Date" FROM (SELECT * FROM wd, tk) g ASOF JOIN bars b ON g.ticker = b.ticker AND g.d >= b."Date"), f AS (SELECT ticker, "Date" AS at, {_MOVES_SQL} FROM bars),
    p AS (SELECT g.*, f.drawdown_1, f.drawup_1 FROM (SELECT * FROM td, tk) g ASOF LEFT JOIN f ON g.ticker = f.ticker AND g."Date" >= f.at);;
    SELECT p.ticker, p."Date", drawdown_1, drawup_1, b."Close", b."AdjClose", b."Open" FROM p JOIN bars b ON p.ticker = b.ticker AND p."Date" = b."Date" WHERE drawdown_1 IS NOT NULL AND drawup_1 IS NOT NULL""",
    KEY, ["drawdown_1", "drawup_1", "Close", "AdjClose", "Open"])
