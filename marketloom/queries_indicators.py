"""Queries over indicators that need recursions or arrays, fits and checks, and the same in SQL.

An exponential average has a closed form: with ``i`` the row of its ticker, the sum of
``a * x / (1 - a)**i`` so far, times ``(1 - a)**i``; so SQL needs no recursion for it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import aggregates as A
from .operators import checks as C
from .operators import indicators
from .plans import blocks as B
from .queries import _C, _DAYS, _H, _L, _RUN, _TA, _V, BY, KEY, _days, add, lag, last_rows, over
from .queries_blocks import LAGS, array_digest, digest, digest_sql, sequence_sql
from .sources import views

# -- arrays over windows -------------------------------------------------------------
add("t18_cci", lambda s, d: _TA(s, d).select(*KEY, "trend_cci"),
    f"""q AS (SELECT *, ({_H} + {_L} + {_C}) / 3 AS tp FROM bars), w AS (SELECT *, list(tp) OVER {last_rows(20)} AS past, avg(tp) OVER {last_rows(20)} AS m FROM q);;
    SELECT *, (tp - m) / nullif(0.015::DOUBLE * list_avg(list_transform(past, lambda x: abs(x - m))), 0) AS trend_cci FROM w""", KEY, ["trend_cci"], digits=4)
add("t19_aroon", lambda s, d: _TA(s, d).select(*KEY, "trend_aroon_up", "trend_aroon_down", "trend_aroon_ind"),
    f"""w AS (SELECT *, list({_H}) OVER {last_rows(25)} AS hs, list({_L}) OVER {last_rows(25)} AS ls, max({_H}) OVER {last_rows(25)} AS hi, min({_L}) OVER {last_rows(25)} AS lo FROM bars),
    v AS (SELECT *, 4.0::DOUBLE * (25 - (len(hs) - list_position(hs, hi))) AS up, 4.0::DOUBLE * (25 - (len(ls) - list_position(ls, lo))) AS down FROM w);;
    SELECT *, up AS trend_aroon_up, down AS trend_aroon_down, up - down AS trend_aroon_ind FROM v""", KEY, ["trend_aroon_up", "trend_aroon_down", "trend_aroon_ind"])


# -- recursions ----------------------------------------------------------------------
def smooth(x: str, a: float, first: str = "0") -> str:
    """Exponential average of ``x`` with factor ``a``, which starts with the value of row ``first``."""
    keep = f"(1 - {a!r}::DOUBLE)"
    return f"pow({keep}, i) * sum(CASE WHEN i > {first} THEN {a!r}::DOUBLE * ({x}) WHEN i = {first} THEN ({x}) END * pow({keep}, -i)) OVER {_RUN}"


def ema(x: str, n: int, first: str = "0") -> str:
    return smooth(x, 2 / (n + 1), first)


def wilder(x: str, n: int, first: str = "0") -> str:
    return smooth(x, 1 / n, first)


def within(x: str, n: int) -> str:
    low, high = f"min({x}) OVER {last_rows(n)}", f"max({x}) OVER {last_rows(n)}"
    return f"CASE WHEN {high} - {low} > 1e-9 THEN ({x} - {low}) / ({high} - {low}) END"


def first_row(x: str) -> str:
    return f"min(CASE WHEN {x} IS NOT NULL THEN i END) OVER (PARTITION BY ticker)"


_STEPS = [
    f"row_number() OVER ({BY}) - 1 AS i, {lag(_C)} AS pc, {lag(_H)} AS h1, {lag(_H, 2)} AS h2, {lag(_L)} AS l1, {lag(_L, 2)} AS l2, {lag(_C, 10)} AS c10, first_value({_C}) OVER ({BY}) AS c0",
    f"{_C} - pc AS d, greatest({_H} - {_L}, abs({_H} - pc), abs({_L} - pc)) AS tr, {_H} - h1 AS mu, l1 - {_L} AS md",
    ", ".join([
        *[f"{ema(_C, n)} AS e{n}" for n in (12, 26, 23, 50)], f"{ema(_C, 15)} AS t1", f"{ema(f'({_H} - {_L})', 9)} AS m1", f"{ema(_V, 12)} AS vf", f"{ema(_V, 26)} AS vs",
        f"{wilder('tr', 10)} AS volatility_atr", f"{wilder('tr', 14)} AS tr14", f"{wilder('CASE WHEN mu > md AND mu > 0 THEN mu ELSE 0 END', 14)} AS plus",
        f"{wilder('CASE WHEN md > mu AND md > 0 THEN md ELSE 0 END', 14)} AS minus", f"{wilder('greatest(d, 0)', 14, '1')} AS g", f"{wilder('greatest(-d, 0)', 14, '1')} AS lo",
        f"{ema('abs(d)', 25, '1')} AS a1", f"{ema('d', 25, '1')} AS d1", f"{ema(f'd * {_V}', 13, '1')} AS volume_fi", f"abs({_C} - c10) / nullif({over('sum', 'abs(d)', 10)}, 0) AS eff"]),
    ", ".join([
        "e12 AS trend_ema_fast, e26 AS trend_ema_slow, e12 - e26 AS trend_macd", f"{ema('(e12 - e26)', 9)} AS trend_macd_signal", f"{ema('t1', 15)} AS t2", f"{ema('m1', 9)} AS m2",
        f"{ema('a1', 13, '1')} AS a2", f"{ema('d1', 13, '1')} AS d2", "100 * (e12 - e26) / nullif(e26, 0) AS momentum_ppo", "100 * (vf - vs) / nullif(vs, 0) AS momentum_pvo",
        "100 * plus / nullif(tr14, 0) AS trend_adx_pos, 100 * minus / nullif(tr14, 0) AS trend_adx_neg", "100 * g / nullif(g + lo, 0) AS momentum_rsi", "e23 - e50 AS sm",
        "pow(coalesce(eff, 0) * (2.0::DOUBLE / 3 - 2.0::DOUBLE / 31) + 2.0::DOUBLE / 31, 2) AS pace"]),
    ", ".join([
        "trend_macd - trend_macd_signal AS trend_macd_diff", f"{ema('t2', 15)} AS t3", f"{over('sum', 'm1 / nullif(m2, 0)', 25)} AS trend_mass_index",
        "100 * abs(trend_adx_pos - trend_adx_neg) / nullif(trend_adx_pos + trend_adx_neg, 0) AS dx", f"{within('sm', 10)} AS k0", f"{ema('momentum_ppo', 9)} AS momentum_ppo_signal",
        f"{ema('momentum_pvo', 9)} AS momentum_pvo_signal", f"{within('momentum_rsi', 14)} AS momentum_stoch_rsi", f"sum(CASE WHEN i > 0 THEN ln(1 - pace) ELSE 0 END) OVER {_RUN} AS lp",
        "100 * d2 / nullif(a2, 0) AS momentum_tsi"]),
    ", ".join([
        f"100 * (t3 - {lag('t3')}) / nullif({lag('t3')}, 0) AS trend_trix", f"{first_row('dx')} AS f_dx, {first_row('k0')} AS f_k0, last_value(k0 IGNORE NULLS) OVER {_RUN} AS k0f", f"{over('avg', 'momentum_stoch_rsi', 3)} AS momentum_stoch_rsi_k",
        f"exp(lp) * (c0 + coalesce(sum(CASE WHEN i > 0 THEN pace * {_C} * exp(-lp) END) OVER {_RUN}, 0)) AS momentum_kama",
        "momentum_ppo - momentum_ppo_signal AS momentum_ppo_hist, momentum_pvo - momentum_pvo_signal AS momentum_pvo_hist"]),
    ", ".join([f"{wilder('dx', 14, 'f_dx')} AS trend_adx", f"{ema('100 * k0f', 3, 'f_k0')} AS k1", f"{over('avg', 'momentum_stoch_rsi_k', 3)} AS momentum_stoch_rsi_d"]),
    f"{within('k1', 10)} AS k2",
    f"{first_row('k2')} AS f_k2, last_value(k2 IGNORE NULLS) OVER {_RUN} AS k2f",
    f"{ema('100 * k2f', 3, 'f_k2')} AS trend_stc",
]
_CHAIN = ", ".join(f"r{k} AS {'MATERIALIZED ' * (k == 0)}(SELECT *, {step} FROM {'bars' if k == 0 else f'r{k - 1}'})" for k, step in enumerate(_STEPS))
_PSAR = f"""ps AS (SELECT ticker, i, {_C} AS stop, true AS rising, 0.02::DOUBLE AS pace, h1 AS best, l1 AS worst, 0.0::DOUBLE AS tu, 0.0::DOUBLE AS td FROM r0 WHERE i = 1
  UNION ALL SELECT ticker, j, CASE WHEN rising THEN CASE WHEN t THEN best ELSE least(s0, l1, l2) END ELSE CASE WHEN t THEN worst ELSE greatest(s0, h1, h2) END END, CASE WHEN t THEN NOT rising ELSE rising END,
    CASE WHEN t THEN 0.02::DOUBLE WHEN rising AND {_H} > best OR NOT rising AND {_L} < worst THEN least(pace + 0.02::DOUBLE, 0.2::DOUBLE) ELSE pace END,
    CASE WHEN rising THEN CASE WHEN NOT t AND {_H} > best THEN {_H} ELSE best END ELSE CASE WHEN t THEN {_H} ELSE best END END,
    CASE WHEN rising THEN CASE WHEN t THEN {_L} ELSE worst END ELSE CASE WHEN NOT t AND {_L} < worst THEN {_L} ELSE worst END END,
    CASE WHEN t AND NOT rising THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN t AND rising THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  FROM (SELECT *, CASE WHEN rising THEN {_L} < s0 ELSE {_H} > s0 END AS t FROM (
    SELECT ps.*, r0.* EXCLUDE (ticker, i), ps.stop + ps.pace * (CASE WHEN ps.rising THEN ps.best ELSE ps.worst END - ps.stop) AS s0, r0.i AS j
    FROM ps JOIN r0 ON r0.ticker = ps.ticker AND r0.i = ps.i + 1) AS q) AS v)"""
_LAST = f"r{len(_STEPS) - 1}"
add("t02_recursive", lambda s, d: indicators.recursive_indicators(views.bars(s, d)),
    f"""{_CHAIN}, {_PSAR};;SELECT {_LAST}.*, CASE WHEN ps.i > 1 AND rising THEN stop END AS trend_psar_up, CASE WHEN ps.i > 1 AND NOT rising THEN stop END AS trend_psar_down,
    coalesce(tu, 0) AS trend_psar_up_indicator, coalesce(td, 0) AS trend_psar_down_indicator FROM {_LAST} LEFT JOIN ps ON ps.ticker = {_LAST}.ticker AND ps.i = {_LAST}.i""",
    KEY, indicators.RECURSIVE, digits=4)

# -- the indicator blocks --------------------------------------------------------------
_PC, _PV = lag(_C), lag(_V)
_TP = f"({_H} + {_L} + {_C}) / 3"
_MID = lambda n: f"({over('max', _H, n)} + {over('min', _L, n)}) / 2"
_FLAG = lambda x: f"CASE WHEN {x} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_FIRST = {
    "x_tp": _TP, "x_pc": _PC, "x_pv": _PV, **{f"x_k{r}": f"({_C} - {lag(_C, r)}) / nullif({lag(_C, r)}, 0)" for r in (10, 15, 20, 30)},
    "x_tr": f"greatest({_H} - {_L}, abs({_H} - {_PC}), abs({_L} - {_PC}))", "x_vp": f"abs({_H} - {lag(_L)})", "x_vm": f"abs({_L} - {lag(_H)})",
    "x_fall": f"100 * ({_C} - {over('max', _C, 14)}) / nullif({over('max', _C, 14)}, 0)", "x_bp": f"{_C} - least({_L}, {_PC})",
    "x_rg": f"greatest({_H}, {_PC}) - least({_L}, {_PC})", "x_clv": f"coalesce((2 * {_C} - {_L} - {_H}) / nullif({_H} - {_L}, 0), 0)", "x_tp1": lag(_TP),
    "volume_em": f"(({_H} - {lag(_H)}) + ({_L} - {lag(_L)})) * ({_H} - {_L}) / nullif(2 * {_V}, 0) * 1e8::DOUBLE",
    "momentum_stoch": f"100 * ({_C} - {over('min', _L, 14)}) / nullif({over('max', _H, 14)} - {over('min', _L, 14)}, 0)",
    "x_m": over("avg", _C, 20), "x_s": over("stddev_pop", _C, 20), "volatility_kcc": over("avg", _TP, 10), "volatility_kch": over("avg", f"(4 * {_H} - 2 * {_L} + {_C}) / 3", 10),
    "volatility_kcl": over("avg", f"(-2 * {_H} + 4 * {_L} + {_C}) / 3", 10), "volatility_dcl": over("min", _L, 20), "volatility_dch": over("max", _H, 20),
    "trend_ichimoku_conv": _MID(9), "trend_ichimoku_base": _MID(26), "trend_ichimoku_b": _MID(52), "x_hs": f"list({_H}) OVER {last_rows(25)}", "x_ls": f"list({_L}) OVER {last_rows(25)}",
    "x_hi": over("max", _H, 25), "x_lo": over("min", _L, 25)}
_SECOND = {
    "trend_sma_fast": over("avg", _C, 12), "trend_sma_slow": over("avg", _C, 26), "volatility_bbm": "x_m", "volatility_bbh": "x_m + 2 * x_s", "volatility_bbl": "x_m - 2 * x_s",
    "volatility_bbw": "100 * 4 * x_s / nullif(x_m, 0)", "volatility_bbp": f"({_C} - (x_m - 2 * x_s)) / nullif(4 * x_s, 0)", "volatility_bbhi": _FLAG(f"{_C} > x_m + 2 * x_s"),
    "volatility_bbli": _FLAG(f"{_C} < x_m - 2 * x_s"), "volatility_kcp": f"({_C} - volatility_kcl) / nullif(volatility_kch - volatility_kcl, 0)",
    "volatility_kchi": _FLAG(f"{_C} > volatility_kch"), "volatility_kcli": _FLAG(f"{_C} < volatility_kcl"), "volatility_dcm": "(volatility_dcl + volatility_dch) / 2",
    "volatility_dcp": f"({_C} - volatility_dcl) / nullif(volatility_dch - volatility_dcl, 0)", "volatility_ui": f"sqrt({over('avg', 'x_fall * x_fall', 14)})",
    "trend_vortex_ind_pos": f"{over('sum', 'x_vp', 14)} / nullif({over('sum', 'x_tr', 14)}, 0)", "trend_vortex_ind_neg": f"{over('sum', 'x_vm', 14)} / nullif({over('sum', 'x_tr', 14)}, 0)",
    "trend_dpo": f"{lag(_C, 11)} - {over('avg', _C, 20)}",
    "trend_kst": f"100 * ({over('avg', 'x_k10', 10)} + 2 * {over('avg', 'x_k15', 10)} + 3 * {over('avg', 'x_k20', 10)} + 4 * {over('avg', 'x_k30', 15)})",
    "x_past": f"list(x_tp) OVER {last_rows(20)}", "x_mean": over("avg", "x_tp", 20), "trend_aroon_up": "4.0::DOUBLE * (25 - (len(x_hs) - list_position(x_hs, x_hi)))",
    "trend_aroon_down": "4.0::DOUBLE * (25 - (len(x_ls) - list_position(x_ls, x_lo)))",
    "momentum_uo": "100 * (" + " + ".join(f"{k} * {over('sum', 'x_bp', n)} / nullif({over('sum', 'x_rg', n)}, 0)" for k, n in ((4, 7), (2, 14), (1, 28))) + ") / 7",
    "momentum_stoch_signal": over("avg", "momentum_stoch", 3), "momentum_wr": f"-100 * ({over('max', _H, 14)} - {_C}) / nullif({over('max', _H, 14)} - {over('min', _L, 14)}, 0)",
    "momentum_ao": f"{over('avg', f'({_H} + {_L}) / 2', 5)} - {over('avg', f'({_H} + {_L}) / 2', 34)}", "momentum_roc": f"100 * ({_C} - {lag(_C, 12)}) / nullif({lag(_C, 12)}, 0)",
    "volume_adi": f"sum(x_clv * {_V}) OVER {_RUN}", "volume_obv": f"sum(CASE WHEN {_C} < x_pc THEN -{_V} ELSE {_V} END) OVER {_RUN}",
    "volume_cmf": f"{over('sum', f'x_clv * {_V}', 20)} / nullif({over('sum', _V, 20)}, 0)", "volume_sma_em": over("avg", "volume_em", 14),
    "volume_vpt": f"sum({_V} * (({_C} - x_pc) / nullif(x_pc, 0))) OVER {_RUN}", "volume_vwap": f"{over('sum', f'x_tp * {_V}', 14)} / nullif({over('sum', _V, 14)}, 0)",
    "x_up": over("sum", f"CASE WHEN x_tp > x_tp1 THEN x_tp * {_V} ELSE 0 END", 14), "x_down": over("sum", f"CASE WHEN x_tp < x_tp1 THEN x_tp * {_V} ELSE 0 END", 14),
    "volume_nvi": f"exp(ln(1000) + sum(CASE WHEN {_V} < x_pv THEN ln({_C} / x_pc) ELSE 0 END) OVER {_RUN})", "trend_ichimoku_a": "(trend_ichimoku_conv + trend_ichimoku_base) / 2"}
_THIRD = {
    "trend_vortex_ind_diff": "trend_vortex_ind_pos - trend_vortex_ind_neg", "trend_kst_sig": over("avg", "trend_kst", 9), "trend_aroon_ind": "trend_aroon_up - trend_aroon_down",
    "trend_cci": "(x_tp - x_mean) / nullif(0.015::DOUBLE * list_avg([abs(y - x_mean) for y in x_past]), 0)", "volume_mfi": "100 * x_up / nullif(x_up + x_down, 0)",
    "trend_visual_ichimoku_a": lag("trend_ichimoku_a", 26), "trend_visual_ichimoku_b": lag("trend_ichimoku_b", 26)}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f'{x} AS "{c}"' for c, x in columns.items())


def _prepared(c: str) -> str:
    """A column as the preprocessing leaves it."""
    if c in indicators.SIGMOID:
        x = f"CASE WHEN row_number() OVER ({BY}) <= 5 THEN 0.0::DOUBLE ELSE {c} END" if c == "trend_trix" else c
        return f"1 / (1 + exp(CASE WHEN {x} < {-700 * indicators.SIGMOID[c]} THEN 700 ELSE -({x}) / {indicators.SIGMOID[c]} END))"
    if c in indicators.HUNDREDTHS:
        return f"{c} / 100"
    if c == "volume_nvi":
        return "ln(volume_nvi / 100)"
    if c == "volatility_kcp":
        return "CASE WHEN volatility_kcp < -10 THEN -10 WHEN volatility_kcp > 10 THEN 10 ELSE volatility_kcp END / 10"
    return f"{c} / nullif({over('max', c, 252)}, 0)" if c in indicators.TO_ROLLING_MAX else f'"{c}"'


def _over_bar(c: str, x: str) -> str:
    """A value, or an earlier one, over the current bar."""
    if c in indicators.TO_CLOSE:
        return f"{x} / nullif({_C}, 0)"
    return f"{x} / vol" if c == "Volume" else f"{x} / nullif(vol * {_C}, 0)" if c == "volume_adi" else x


_PREPARED = list(dict.fromkeys([*indicators.COLUMNS, *B.SEQUENCE_SCALES]))
_ALL = f"""{_CHAIN}, {_PSAR}, rec AS MATERIALIZED (SELECT {_LAST}.*, CASE WHEN ps.i > 1 AND rising THEN stop END AS trend_psar_up, CASE WHEN ps.i > 1 AND NOT rising THEN stop END AS trend_psar_down,
  coalesce(tu, 0) AS trend_psar_up_indicator, coalesce(td, 0) AS trend_psar_down_indicator FROM {_LAST} LEFT JOIN ps ON ps.ticker = {_LAST}.ticker AND ps.i = {_LAST}.i),
q1 AS MATERIALIZED (SELECT *, {_select(_FIRST)} FROM rec), q2 AS MATERIALIZED (SELECT *, {_select(_SECOND)} FROM q1), q3 AS MATERIALIZED (SELECT *, {_select(_THIRD)} FROM q2),
q4 AS MATERIALIZED (SELECT *, trend_kst - trend_kst_sig AS trend_kst_diff FROM q3),
pp AS MATERIALIZED (SELECT ticker, "Date", {_C}, CASE WHEN {_V} < 2 THEN 1 ELSE {_V} END AS vol, {", ".join(f'{_prepared(c)} AS "p_{c}"' for c in _PREPARED)} FROM q4);;"""
add("b12_indicator_block", lambda s, d: B.indicator_block(views.bars(s, d)).select(*KEY, *[
    digest([f"FeatureTA_{c}" + (f"_lag_m{n}" if n else "") for n in (0, *LAGS)]).alias(c) for c in indicators.COLUMNS]),
    _ALL + 'SELECT ticker, "Date", ' + ", ".join(
        digest_sql([_over_bar(c, lag(f'"p_{c}"', n) if n else f'"p_{c}"') for n in (0, *LAGS)]) + f' AS "{c}"' for c in indicators.COLUMNS) + " FROM pp", KEY, indicators.COLUMNS, digits=3)
_SCALES = {
    "close": f"(tanh({{}} / nullif({_C}, 0) - 1) / 2 + 0.5::DOUBLE)", "volume": "(tanh({} / vol - 1) / 2 + 0.5::DOUBLE)", "plain": "({})",
    "clip": "(CASE WHEN {0} < 0 THEN 0 WHEN {0} > 1 THEN 1 ELSE {0} END)", "linear": "(CASE WHEN ({0} + 1) / 2 < 0 THEN 0 WHEN ({0} + 1) / 2 > 1 THEN 1 ELSE ({0} + 1) / 2 END)",
    "tanh": "(tanh({}) / 2 + 0.5::DOUBLE)"}
add("b13_indicator_sequence", lambda s, d: B.indicator_sequence(views.bars(s, d)).select(*KEY, *[array_digest(f"{c}_seq", B.DEFAULTS["steps"]).alias(c) for c in B.SEQUENCE_SCALES]),
    _ALL + 'SELECT ticker, "Date", ' + ", ".join(f'{sequence_sql(chr(34) + "p_" + c + chr(34), scale=_SCALES[kind])} AS "{c}"' for c, kind in B.SEQUENCE_SCALES.items()) + " FROM pp",
    KEY, list(B.SEQUENCE_SCALES), digits=3)

# -- fits: p-values, successive orthogonal polynomials -----------------------------------------
_SIMPSON = 2000


def _integral(low: str) -> str:
    """Of cos(v) ** (n - 3) from ``low`` to a quarter turn, by Simpson's rule."""
    h = f"((pi() / 2 - {low}) / {_SIMPSON})"
    f = lambda k: f"pow(greatest(cos({low} + {h} * ({k})), 0), n - 3)"
    return f"{h} / 6 * list_sum([{f('k')} + 4 * {f('k + 0.5::DOUBLE')} + {f('k + 1')} for k in range({_SIMPSON})])"


# with r the sine of an angle, the density of r is a power of the cosine
add("a26_p_values", lambda s, d: A.p_values(A.line_fit(_days(s, d), "x", "Close")),
    _DAYS + f""", f AS (SELECT ticker, count(*) AS n, asin(least(abs(corr(x, y)), 1)) AS a FROM x GROUP BY 1);;
    SELECT ticker, CASE WHEN n > 2 THEN ({_integral('a')}) / ({_integral('0')}) END AS p_value FROM f""", ("ticker",), ["p_value"])
_POLY = _DAYS + """, z AS (SELECT ticker, y, (x - avg(x) OVER t) / greatest(stddev_pop(x) OVER t, 1e-12) AS z, stddev_pop(x) OVER t AS s FROM x WINDOW t AS (PARTITION BY ticker)),
z2 AS (SELECT *, z * z - (regr_intercept(z * z, z) OVER t + regr_slope(z * z, z) OVER t * z) AS p2 FROM z WINDOW t AS (PARTITION BY ticker)),
z3 AS (SELECT *, z * z * z - (avg(z * z * z) OVER t + regr_slope(z * z * z, z) OVER t * z + regr_slope(z * z * z, p2) OVER t * p2) AS p3 FROM z2 WINDOW t AS (PARTITION BY ticker)),
r AS (SELECT ticker, pow(corr(y, z), 2) + pow(corr(y, p2), 2) AS q2, pow(corr(y, p3), 2) AS q3, regr_slope(y, p2) / any_value(s * s) AS c2, regr_slope(y, p3) / any_value(s * s * s) AS c3, var_pop(y) AS v FROM z3 GROUP BY 1);;"""
_fit = lambda k: lambda s, d: A.polynomial_fit(_days(s, d), "x", "Close", k).select("ticker", F.col("coef")[0].alias("top"), "r2", "residual_var")
add("a27_quadratic_fit", _fit(2), _POLY + "SELECT ticker, c2 AS top, q2 AS r2, v * (1 - q2) AS residual_var FROM r", ("ticker",), ["top", "r2", "residual_var"], digits=4)
add("a28_cubic_fit", _fit(3), _POLY + "SELECT ticker, c3 AS top, q2 + q3 AS r2, v * (1 - q2 - q3) AS residual_var FROM r", ("ticker",), ["top", "r2", "residual_var"], digits=4)

# -- eligibility ---------------------------------------------------------------------
_filled = lambda s, d: views.fin_q(s, d).withColumn("reportTime", F.when(F.col("ticker").cast("int") % 2 == 0, F.coalesce("reportTime", F.lit("pre-market"))).otherwise(F.col("reportTime")))
add("g01_statements_since", lambda s, d: C.statements_since(_filled(s, d), views.fin_a(s, d), views.bars(s, d), 1997, "1998-12-05"),
    """b AS (SELECT ticker, date_diff('day', max("Date"), DATE '1998-12-05') <= 20 AND count(*) >= floor(250 * date_diff('day', DATE '1997-01-01', max("Date")) / 365.0::DOUBLE) AS ok FROM bars WHERE "Date" >= DATE '1997-01-01' GROUP BY 1),
    a AS (SELECT ticker, count(*) AS na FROM fin_a GROUP BY 1), q AS (SELECT ticker, count(*) AS nq, count(*) FILTER ("fiscalDateEnding" >= DATE '1997-01-01' AND "reportTime" IS NULL AND ticker::INT % 2 <> 0 AND NOT ("reportedDate" = nw AND nw >= DATE '1998-12-05' - 70)) AS gq
      FROM (SELECT *, max("reportedDate") OVER (PARTITION BY ticker) AS nw FROM fin_q) GROUP BY 1);;
    SELECT b.ticker, coalesce(ok AND na >= 1 AND nq >= 8 AND gq = 0, false) AS ok FROM b LEFT JOIN a ON a.ticker = b.ticker LEFT JOIN q ON q.ticker = b.ticker""", ("ticker", "ok"), ctes=("bars", "fin_q", "fin_a"))
