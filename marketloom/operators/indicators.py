"""Technical indicators: window frames where they suffice, one pass over the histories for recursions.

Periods are parameters with their usual defaults.  Frames may be shorter at a ticker's
start, so only what needs an earlier row is NULL there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import doubles
from ..functions.exprs import clip, div, ln, sigmoid
from .windows import by

# Column names by the scaling they get.
SIGMOID = {"volume_em": 100, "volume_sma_em": 500, "trend_dpo": 100, "trend_kst": 100, "trend_kst_sig": 100, "trend_kst_diff": 100,
           "trend_adx": 100, "trend_adx_pos": 100, "trend_adx_neg": 100, "momentum_ppo": 10, "momentum_ppo_signal": 10,
           "momentum_ppo_hist": 10, "trend_trix": 2}
HUNDREDTHS = ["volume_mfi", "volatility_ui", "trend_mass_index", "trend_aroon_up", "trend_aroon_down", "trend_aroon_ind", "momentum_tsi",
              "momentum_uo", "momentum_stoch", "momentum_stoch_signal", "momentum_wr", "momentum_roc", "trend_stc", "trend_cci",
              "momentum_pvo_signal", "momentum_rsi", "momentum_pvo", "momentum_pvo_hist"]
AS_IS = ["volume_cmf", "volatility_bbhi", "trend_psar_down_indicator", "volatility_kcli", "volatility_bbli", "trend_psar_up_indicator",
         "volatility_kchi", "momentum_stoch_rsi", "momentum_stoch_rsi_k", "momentum_stoch_rsi_d", "volatility_dcp", "trend_vortex_ind_neg",
         "trend_vortex_ind_pos", "trend_vortex_ind_diff", "volatility_bbp"]
TO_ROLLING_MAX = ["volume_obv", "volume_fi", "volume_vpt"]
TO_CLOSE = ["Open", "High", "Low", "trend_macd", "trend_macd_signal", "trend_macd_diff", "trend_sma_slow", "volatility_atr", "volatility_bbl",
            "volatility_bbm", "volatility_bbh", "volatility_bbw", "volatility_kcc", "momentum_ao", "trend_psar_down", "trend_psar_up",
            "trend_sma_fast", "volatility_kch", "volatility_kcl", "volume_vwap", "trend_ichimoku_base", "trend_ichimoku_conv",
            "trend_ichimoku_a", "trend_visual_ichimoku_a", "trend_visual_ichimoku_b", "trend_ichimoku_b", "trend_ema_slow",
            "momentum_kama", "trend_ema_fast", "volatility_dcm", "volatility_dcl", "volatility_dch"]
TO_VOLUME = ["Volume", "volume_adi"]
COLUMNS = [*TO_CLOSE, *TO_VOLUME, *SIGMOID, "volume_nvi", "volatility_kcp", *TO_ROLLING_MAX, *HUNDREDTHS, *AS_IS]


#: Figures of the last rows of a ticker: name -> (kind, column, rows).
Frames = dict[str, tuple[str, str, int]]


def window_frames(df: DataFrame, wanted: Frames) -> DataFrame:
    """Frames by window expressions; NULLs are left out, but for ``deviation`` (mean distance from the
    mean) and ``since_max`` and ``since_min`` (rows since the extreme, the earliest of equal ones)."""
    w, simple = by(), {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "std": F.stddev_pop}
    first, then = {}, {}
    for name, (kind, c, n) in wanted.items():
        over = w.rowsBetween(-(n - 1), 0)
        if kind in simple:
            first[name] = simple[kind](c).over(over)
            continue
        past, ref = f"_past_{c}_{n}", f"_ref_{name}"
        first[past] = F.collect_list(F.struct(F.col(c).alias("v"))).over(over)
        first[ref] = simple["mean" if kind == "deviation" else kind[6:]](c).over(over)
        then[name] = _deviation(past, F.col(ref)) if kind == "deviation" else _since(past, F.col(ref))
    return df.withColumns(first).withColumns(then)


def _deviation(past: str, mean: Column) -> Column:
    return F.aggregate(past, F.lit(0.0), lambda a, x: a + F.abs(x["v"] - mean)) / F.size(past)


def _since(past: str, extreme: Column) -> Column:
    return (F.size(past) - F.array_position(F.transform(past, lambda x: x["v"] == extreme), True)).cast("double")


def _frame(kind: str, x: np.ndarray, n: int) -> np.ndarray:
    """The same for many histories side by side (rows down), in the order in which the windows add up."""
    rows = np.minimum(np.arange(len(x)) + 1, n)[:, None]
    if kind == "std":
        count, mean, square = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
        for k in range(n - 1, -1, -1):
            now = _before(x, k)
            seen = ~np.isnan(now)
            count = count + seen
            step = np.where(seen, now - mean, 0.0)
            mean = mean + np.where(seen, step / count, 0.0)
            square = square + step * np.where(seen, now - mean, 0.0)
        return np.sqrt(np.where(count > 0, square / count, np.nan))
    if kind == "lag":
        return _before(x, n)
    if kind in ("max", "min"):
        out, better, have = x, np.fmax if kind == "max" else np.fmin, 1
        while have < n:  # two frames that may overlap make a longer one
            more = min(have, n - have)
            out, have = better(out, _before(out, more)), have + more
        return out
    if kind in ("since_max", "since_min"):
        best, since = x, np.where(np.isnan(x), np.nan, 0.0)
        for k in range(1, n):
            past = _before(x, k)
            better = (past >= best if kind == "since_max" else past <= best) | np.isnan(best) & ~np.isnan(past)
            best, since = np.where(better, past, best), np.where(better, k, since)
        return np.where(np.isnan(since), rows, since)
    total, count = np.zeros_like(x), np.zeros_like(x)
    for k in range(n - 1, -1, -1):
        past = _before(x, k)
        seen = ~np.isnan(past)
        total, count = total + np.where(seen, past, 0.0), count + seen
    total = np.where(count > 0, total, np.nan)
    if kind == "sum":
        return total
    mean = total / count
    if kind == "mean":
        return mean
    away = np.zeros_like(x)
    for k in range(n - 1, -1, -1):
        away = away + np.where(np.arange(len(x))[:, None] >= k, np.abs(_before(x, k) - mean), 0.0)
    return away / rows


def window_indicators(bars: DataFrame, fast: int = 12, slow: int = 26, band: int = 20, channel: int = 10, donchian: int = 20,
                      ulcer: int = 14, vortex: int = 14, dpo: int = 20, aroon: int = 25, cci: int = 20, stoch: int = 14,
                      flow: int = 20, money: int = 14, roc: int = 12, frames: Callable[[DataFrame, Frames], DataFrame] = window_frames) -> DataFrame:
    """T1, T4-T6, T8, T9, T12-T15, T18, T19, T24-T29, T32-T34, T36-T41.

    ``frames`` adds what is taken of the last rows.
    """
    w = by()
    wanted, first, second = _plan(fast, slow, band, channel, donchian, ulcer, vortex, dpo, aroon, cci, stoch, flow, money, roc)
    df = frames(_inputs(bars, dpo, roc), wanted).withColumns(first(F.col, div, _flag))
    helpers = [x for x in df.columns if x.startswith("_") and x != "_fall"]
    df = df.drop(*helpers)
    later = {name: F.lag(c, n).over(w) if kind == "lag" else F.avg(c).over(w.rowsBetween(-(n - 1), 0)) for name, (kind, c, n) in second.items()}
    df = df.withColumn("_fall2", F.col("_fall") * F.col("_fall")).withColumns(later)
    return df.withColumns(_last(F.col, F.sqrt)).drop("_fall", "_fall2", "_fall2_mean")


def _flag(x: Column) -> Column:
    return F.when(x, 1.0).otherwise(0.0)


def _inputs(bars: DataFrame, dpo: int = 20, roc: int = 12) -> DataFrame:
    """What the indicators take of a bar, the one before it, and running sums."""
    w = by()
    h, low, c, v = (F.col(x) for x in ("High", "Low", "Close", "Volume"))
    last = lambda x, n=1: F.lag(x, n).over(w)
    typical, run = (h + low + c) / 3, w.rowsBetween(Window.unboundedPreceding, 0)
    df = bars.withColumns({
        "_pc": last(c), "_tp": typical, "_kst1": div(c - last(c, 10), last(c, 10)), "_kst2": div(c - last(c, 15), last(c, 15)),
        "_kst3": div(c - last(c, 20), last(c, 20)), "_kst4": div(c - last(c, 30), last(c, 30)),
        "_tr": F.greatest(h - low, F.abs(h - last(c)), F.abs(low - last(c))), "_vp": F.abs(h - last(low)), "_vm": F.abs(low - last(h)),
        "_bp": c - F.least(low, last(c)), "_range": F.greatest(h, last(c)) - F.least(low, last(c)),
        "_clv": F.coalesce(div(2 * c - low - h, h - low), F.lit(0.0)), "_tp1": last(typical),
        "volume_em": div(((h - last(h)) + (low - last(low))) * (h - low), 2 * v) * 1e8,
        "_nvi": F.when(v < last(v), div(c, last(c))).otherwise(1.0),
        "_kh": (4 * h - 2 * low + c) / 3, "_kl": (-2 * h + 4 * low + c) / 3, "_half": (h + low) / 2,
        "_dpo": last(c, dpo // 2 + 1), "momentum_roc": 100 * div(c - last(c, roc), last(c, roc)),
    })
    return df.withColumns({
        "_up": F.when(F.col("_tp") > F.col("_tp1"), F.col("_tp") * v).otherwise(0.0), "_down": F.when(F.col("_tp") < F.col("_tp1"), F.col("_tp") * v).otherwise(0.0),
        "_tpv": F.col("_tp") * v, "_clvv": F.col("_clv") * v,
        "volume_adi": F.sum(F.col("_clv") * v).over(run), "volume_obv": F.sum(F.when(c < F.col("_pc"), -v).otherwise(v)).over(run),
        "volume_vpt": F.sum(v * div(c - F.col("_pc"), "_pc")).over(run), "volume_nvi": 1000 * F.product("_nvi").over(run),
    }).drop("_pc", "_clv", "_tp1", "_nvi")


def _plan(fast: int = 12, slow: int = 26, band: int = 20, channel: int = 10, donchian: int = 20, ulcer: int = 14, vortex: int = 14, dpo: int = 20,
          aroon: int = 25, cci: int = 20, stoch: int = 14, flow: int = 20, money: int = 14, roc: int = 12) -> tuple[Frames, Callable, Frames]:
    """Frames over the inputs, the formulas of what follows from them, and frames over that.

    ``first(x, div, flag)`` takes columns or arrays by name, so that the formulas are the
    same for window expressions and for histories side by side.
    """
    wanted = {}

    def of(kind: str, x: str, n: int) -> str:
        name = f"_{kind}_{x.strip('_')}_{n}"
        wanted[name] = (kind, x, n)
        return name

    avg, total = (lambda x, n: of("mean", x, n)), (lambda x, n: of("sum", x, n))
    top, bottom = (lambda x, n: of("max", x, n)), (lambda x, n: of("min", x, n))

    def first(x: Callable, div: Callable, flag: Callable) -> dict:
        h, low, c = x("High"), x("Low"), x("Close")
        mid = lambda n: (x(top("High", n)) + x(bottom("Low", n))) / 2
        m, s = x(avg("Close", band)), x(of("std", "Close", band))
        kc, kh, kl = x(avg("_tp", channel)), x(avg("_kh", channel)), x(avg("_kl", channel))
        dl, dh = x(bottom("Low", donchian)), x(top("High", donchian))
        up, down = x(total("_up", money)), x(total("_down", money))
        part = lambda n: div(x(total("_bp", n)), x(total("_range", n)))
        new = {
            "_fall": 100 * div(c - x(top("Close", ulcer)), x(top("Close", ulcer))),
            "momentum_stoch": 100 * div(c - x(bottom("Low", stoch)), x(top("High", stoch)) - x(bottom("Low", stoch))),
            "trend_sma_fast": x(avg("Close", fast)), "trend_sma_slow": x(avg("Close", slow)),
            "volatility_bbm": m, "volatility_bbh": m + 2 * s, "volatility_bbl": m - 2 * s, "volatility_bbw": 100 * div(4 * s, m),
            "volatility_bbp": div(c - (m - 2 * s), 4 * s), "volatility_bbhi": flag(c > m + 2 * s), "volatility_bbli": flag(c < m - 2 * s),
            "volatility_kcc": kc, "volatility_kch": kh, "volatility_kcl": kl, "volatility_kcp": div(c - kl, kh - kl),
            "volatility_kchi": flag(c > kh), "volatility_kcli": flag(c < kl),
            "volatility_dcl": dl, "volatility_dch": dh, "volatility_dcm": (dl + dh) / 2, "volatility_dcp": div(c - dl, dh - dl),
            "trend_vortex_ind_pos": div(x(total("_vp", vortex)), x(total("_tr", vortex))),
            "trend_vortex_ind_neg": div(x(total("_vm", vortex)), x(total("_tr", vortex))),
            "trend_dpo": x("_dpo") - x(avg("Close", dpo)),
            "trend_kst": 100 * (x(avg("_kst1", 10)) + 2 * x(avg("_kst2", 10)) + 3 * x(avg("_kst3", 10)) + 4 * x(avg("_kst4", 15))),
            "trend_ichimoku_conv": mid(9), "trend_ichimoku_base": mid(26), "trend_ichimoku_b": mid(52), "trend_ichimoku_a": (mid(9) + mid(26)) / 2,
            "trend_cci": div(x("_tp") - x(avg("_tp", cci)), 0.015 * x(of("deviation", "_tp", cci))),
            "trend_aroon_up": 100 * (aroon - x(of("since_max", "High", aroon))) / aroon,
            "trend_aroon_down": 100 * (aroon - x(of("since_min", "Low", aroon))) / aroon,
            "momentum_uo": 100 * (4 * part(7) + 2 * part(14) + part(28)) / 7,
            "momentum_wr": -100 * div(x(top("High", stoch)) - c, x(top("High", stoch)) - x(bottom("Low", stoch))),
            "momentum_ao": x(avg("_half", 5)) - x(avg("_half", 34)),
            "volume_cmf": div(x(total("_clvv", flow)), x(total("Volume", flow))), "volume_sma_em": x(avg("volume_em", 14)),
            "volume_vwap": div(x(total("_tpv", money)), x(total("Volume", money))), "volume_mfi": 100 * div(up, up + down),
        }
        return new

    first(lambda name: np.zeros(0), lambda a, b: a, lambda f: f)  # names the frames
    second = {"_fall2_mean": ("mean", "_fall2", ulcer), "momentum_stoch_signal": ("mean", "momentum_stoch", 3), "trend_kst_sig": ("mean", "trend_kst", 9),
              "trend_visual_ichimoku_a": ("lag", "trend_ichimoku_a", 26), "trend_visual_ichimoku_b": ("lag", "trend_ichimoku_b", 26)}
    return wanted, first, second


def _last(x: Callable, sqrt: Callable) -> dict:
    return {"volatility_ui": sqrt(x("_fall2_mean")), "trend_vortex_ind_diff": x("trend_vortex_ind_pos") - x("trend_vortex_ind_neg"),
            "trend_aroon_ind": x("trend_aroon_up") - x("trend_aroon_down"), "trend_kst_diff": x("trend_kst") - x("trend_kst_sig")}


RECURSIVE = ["trend_ema_fast", "trend_ema_slow", "trend_macd", "trend_macd_signal", "trend_macd_diff", "volatility_atr", "trend_trix",
             "trend_mass_index", "trend_stc", "trend_adx", "trend_adx_pos", "trend_adx_neg", "trend_psar_up", "trend_psar_down",
             "trend_psar_up_indicator", "trend_psar_down_indicator", "momentum_rsi", "momentum_stoch_rsi", "momentum_stoch_rsi_k",
             "momentum_stoch_rsi_d", "momentum_tsi", "momentum_kama", "momentum_ppo", "momentum_ppo_signal", "momentum_ppo_hist",
             "momentum_pvo", "momentum_pvo_signal", "momentum_pvo_hist", "volume_fi"]


#: Rows of the histories that one pass works on; a ticker's history is never torn apart.
HISTORY_ROWS = 65_536


def _averages(*series: tuple[np.ndarray, float]) -> np.ndarray:
    """Exponential averages (values, factor) down the rows, all at once; what is missing adds nothing and ages what was before."""
    x, a = np.stack([v for v, _ in series]).swapaxes(0, 1), np.array([f for _, f in series])[:, None]
    out, mean, age = np.empty_like(x), x[0], np.ones_like(x[0])
    out[0] = mean
    for i in range(1, len(x)):
        now, age = x[i], age * (1 - a)
        seen = ~np.isnan(now)
        moved = np.where(np.isnan(mean) | (mean == now), now, (age * mean + a * now) / (age + a))
        mean, age = np.where(seen, moved, mean), np.where(seen, 1.0, age)
        out[i] = mean
    return out.swapaxes(0, 1)


def _span(n: int) -> float:
    return 1 / (1 + (n - 1) / 2)


def _before(x: np.ndarray, n: int = 1) -> np.ndarray:
    """The values ``n`` rows before."""
    out = np.full_like(x, np.nan)
    out[n:] = x[:-n] if n else x
    return out


def _rolling(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least, most, sum and mean of the finite values of the last ``n`` rows; NaN without one."""
    x = np.where(np.isinf(x), np.nan, x)
    low, high, total, count = x, x, np.nan_to_num(x), (~np.isnan(x)).astype(float)
    for k in range(1, n):
        past = _before(x, k)
        low, high, total, count = np.fmin(low, past), np.fmax(high, past), total + np.nan_to_num(past), count + ~np.isnan(past)
    total = np.where(count > 0, total, np.nan)
    return low, high, total, total / count


def _filled(x: np.ndarray) -> np.ndarray:
    out = x.copy()
    for i in range(1, len(out)):
        out[i] = np.where(np.isnan(out[i]), out[i - 1], out[i])
    return out


def _psar(high: np.ndarray, low: np.ndarray, close: np.ndarray, step: float, most: float):
    stop, rising = close.copy(), np.ones(close.shape[1], bool)
    up, down = np.full_like(close, np.nan), np.full_like(close, np.nan)
    turn_up, turn_down = np.zeros_like(close), np.zeros_like(close)
    pace, best, worst = np.full(close.shape[1], step), high[0], low[0]
    for i in range(2, len(close)):
        h, lo = high[i], low[i]
        edge = np.where(rising, best, worst)
        at = stop[i - 1] + pace * (edge - stop[i - 1])
        turned = np.where(rising, lo < at, h > at)
        farther = ~turned & np.where(rising, h > best, lo < worst)
        kept = at  # below the last two lows, or above the last two highs
        for k in (1, 2):
            kept = np.where(np.where(rising, low[i - k] < kept, high[i - k] > kept), np.where(rising, low[i - k], high[i - k]), kept)
        at = np.where(turned, edge, kept)
        best, worst = (np.where(np.where(rising, farther, turned), h, best), np.where(np.where(rising, turned, farther), lo, worst))
        pace = np.where(turned, step, np.where(farther, np.where(most < pace + step, most, pace + step), pace))
        turn_down[i], turn_up[i] = turned & rising, turned & ~rising
        rising, stop[i] = rising ^ turned, at
        up[i], down[i] = np.where(rising, at, np.nan), np.where(rising, np.nan, at)
    return up, down, turn_up, turn_down


def _histories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole histories; ``_row`` is 1 in the first row of each."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        starts = np.flatnonzero(batch["_row"].to_numpy() == 1)
        if n >= HISTORY_ROWS and len(starts):
            rest = batch[starts[-1]:]
            held[-1] = batch[:starts[-1]]
            if n > len(rest):
                yield pa.Table.from_batches(held)
            held, n = [rest], len(rest)
    if n:
        yield pa.Table.from_batches(held)


def _alike(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of histories, together if the shortest has at least half the rows of the longest."""
    order = np.argsort(-sizes, kind="stable")
    while len(order):
        many = 2 * sizes[order] >= sizes[order[0]]
        yield order[many]
        order = order[~many]


def _recursions(h: np.ndarray, low: np.ndarray, c: np.ndarray, v: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9, atr: int = 10, trix: int = 15,
                adx: int = 14, rsi: int = 14, psar: tuple[float, float] = (0.02, 0.20), force: int = 13) -> dict[str, np.ndarray]:
    """``RECURSIVE`` of histories side by side."""
    wild = lambda n: 1 / (1 + (1 - 1 / n) / (1 / n))  # noqa: E731  Wilder's factor
    nonzero = lambda x: np.where(x != 0, x, np.nan)

    def scaled(x: np.ndarray, n: int) -> np.ndarray:
        low, high = _rolling(x, n)[:2]
        return (x - low) / np.where(high - low > 1e-9, high - low, np.nan)  # NULL where the values are all the same

    out, pc, d = {}, _before(c), c - _before(c)
    tr = np.fmax(np.fmax(h - low, np.abs(h - pc)), np.abs(low - pc))
    rise, fall = h - _before(h), _before(low) - low
    plus, minus = np.where((rise > fall) & (rise > 0), rise, 0.0), np.where((fall > rise) & (fall > 0), fall, 0.0)
    (out["trend_ema_fast"], out["trend_ema_slow"], c23, c50, e1, m1, v_fast, v_slow, out["volatility_atr"], true, pos, neg, gain, loss, d1, a1,
     out["volume_fi"]) = _averages(
        (c, _span(fast)), (c, _span(slow)), (c, _span(23)), (c, _span(50)), (c, _span(trix)), (h - low, _span(9)), (v, _span(fast)), (v, _span(slow)),
        (tr, wild(atr)), (tr, wild(adx)), (plus, wild(adx)), (minus, wild(adx)), (np.maximum(d, 0), wild(rsi)), (-np.minimum(d, 0), wild(rsi)),
        (d, _span(25)), (np.abs(d), _span(25)), (d * v, _span(force)))
    out["trend_macd"] = out["trend_ema_fast"] - out["trend_ema_slow"]
    out["trend_adx_pos"], out["trend_adx_neg"] = 100 * pos / true, 100 * neg / true
    both = out["trend_adx_pos"] + out["trend_adx_neg"]
    out["momentum_ppo"] = 100 * out["trend_macd"] / nonzero(out["trend_ema_slow"])
    out["momentum_pvo"] = 100 * (v_fast - v_slow) / nonzero(v_slow)
    k1 = 100 * _filled(scaled(c23 - c50, 10))  # without a range it keeps its last value
    (out["trend_macd_signal"], e2, m2, d2, a2, out["trend_adx"], out["momentum_ppo_signal"], out["momentum_pvo_signal"], k2) = _averages(
        (out["trend_macd"], _span(signal)), (e1, _span(trix)), (m1, _span(9)), (d1, _span(13)), (a1, _span(13)),
        (100 * np.abs(out["trend_adx_pos"] - out["trend_adx_neg"]) / nonzero(both), wild(adx)), (out["momentum_ppo"], _span(signal)),
        (out["momentum_pvo"], _span(signal)), (k1, _span(3)))
    e3, out["trend_stc"] = _averages((e2, _span(trix)), (100 * _filled(scaled(k2, 10)), _span(3)))
    out["trend_macd_diff"] = out["trend_macd"] - out["trend_macd_signal"]
    out["trend_trix"] = 100 * (e3 - _before(e3)) / _before(e3)
    out["trend_mass_index"] = _rolling(m1 / m2, 25)[2]
    for name in ("momentum_ppo", "momentum_pvo"):
        out[f"{name}_hist"] = out[name] - out[f"{name}_signal"]
    out["trend_psar_up"], out["trend_psar_down"], out["trend_psar_up_indicator"], out["trend_psar_down_indicator"] = _psar(h, low, c, *psar)
    out["momentum_rsi"] = 100 * gain / nonzero(gain + loss)
    out["momentum_stoch_rsi"] = scaled(out["momentum_rsi"], rsi)
    out["momentum_stoch_rsi_k"] = _rolling(out["momentum_stoch_rsi"], 3)[3]
    out["momentum_stoch_rsi_d"] = _rolling(out["momentum_stoch_rsi_k"], 3)[3]
    out["momentum_tsi"] = 100 * d2 / nonzero(a2)
    ratio = np.nan_to_num(np.abs(c - _before(c, 10)) / nonzero(_rolling(np.abs(d), 10)[2]))
    pace = (ratio * (2 / 3 - 2 / 31) + 2 / 31) ** 2
    kama = c.copy()
    for i in range(1, len(kama)):
        kama[i] = kama[i - 1] + pace[i] * (kama[i] - kama[i - 1])
    return out | {"momentum_kama": kama}



def _side_by_side(table: pa.Table, inputs: list[str]) -> Iterator[tuple[np.ndarray, tuple, dict[str, np.ndarray]]]:
    """Histories of about one length: their rows in the table, the cells of these, and the inputs as arrays, a column a history."""
    row = table["_row"].to_numpy() - 1
    sizes, own = np.diff(np.append(np.flatnonzero(row == 0), len(row))), np.cumsum(row == 0) - 1
    values = {x: table[x].to_numpy().astype(float) for x in inputs}
    for group in _alike(sizes):
        place = np.full(len(sizes), -1)
        place[group] = np.arange(len(group))
        at = np.flatnonzero(place[own] >= 0)
        cell, side = (row[at], place[own[at]]), {}
        for x, v in values.items():
            side[x] = np.full((sizes[group].max(), len(group)), np.nan)
            side[x][cell] = v[at]
        yield at, cell, side


def recursive_indicators(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, atr: int = 10, trix: int = 15, adx: int = 14,
                         rsi: int = 14, psar: tuple[float, float] = (0.02, 0.20), force: int = 13, carry: bool = False, wanted: Frames | None = None) -> DataFrame:
    """One pass over the histories of the tickers.

    Spark deals out and sorts the tickers; the recursions go down the rows of many
    histories side by side, so that a step is taken for all of them at once.  The length of
    a history is bounded by the trading days.
    Averages start with a ticker's first value; what needs an earlier row is NULL there.
    ``carry`` keeps all columns of ``bars``, so that further windows need no join; ``wanted``
    adds frames over them (``window_frames``).
    """
    wanted = wanted or {}
    inputs = list(dict.fromkeys(["High", "Low", "Close", "Volume", *[c for _, c, _ in wanted.values()]]))
    names = [*RECURSIVE, *wanted]
    keep = bars.columns if carry else ["ticker", "Date"]

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _histories(batches):
            found = {name: np.empty(len(table)) for name in names}
            for at, cell, side in _side_by_side(table, inputs):
                with np.errstate(all="ignore"):
                    got = _recursions(*[side[x] for x in inputs[:4]], fast, slow, signal, atr, trix, adx, rsi, psar, force)
                    for name in RECURSIVE:
                        found[name][at] = got[name][cell]
                    for name, (kind, c, n) in wanted.items():
                        found[name][at] = _frame(kind, side[c], n)[cell]
            out = pa.table([*[table[c] for c in keep], *[doubles(found[name]) for name in names]], names=[*keep, *names])
            yield from out.to_batches(max_chunksize=10_000)

    need = bars if carry else bars.select("ticker", "Date", "High", "Low", "Close", "Volume")
    schema = T.StructType([*[need.schema[c] for c in keep], *[T.StructField(c, T.DoubleType()) for c in names]])
    return need.withColumn("_row", F.row_number().over(by(order=F.asc_nulls_last("Date")))).mapInArrow(many, schema)


def all_indicators(bars: DataFrame) -> DataFrame:
    """All 85 columns.  Recursions and frames are taken in one pass over the histories, so that no frame
    is gone through for each row anew."""
    return window_indicators(bars, frames=lambda df, wanted: recursive_indicators(df, carry=True, wanted=wanted))


def preprocess(df: DataFrame, columns: list[str] | None = None, rows: int = 252) -> DataFrame:
    """Sigmoids, hundredths, logarithm, clips, and shares of the rolling maximum."""
    have, w, new = set(columns or df.columns), by(), {}
    for c, scale in SIGMOID.items():
        if c in have:
            x = F.when(F.row_number().over(w) <= 5, 0.0).otherwise(F.col(c)) if c == "trend_trix" else F.col(c)
            new[c] = sigmoid(x, scale)
    new |= {c: F.col(c) / 100 for c in HUNDREDTHS if c in have}
    if "volume_nvi" in have:
        new["volume_nvi"] = ln(F.col("volume_nvi") / 100)
    if "volatility_kcp" in have:
        new["volatility_kcp"] = clip("volatility_kcp", -10, 10) / 10
    # the last rows are some shorter frames, which may overlap: the highest of each is looked up
    part, most = max(1, round(rows**0.5)), [c for c in TO_ROLLING_MAX if c in have]
    back = sorted({*range(0, rows - part, part), rows - part})
    keep = df.columns
    df = df.withColumns(new | {f"_most_{c}": F.max(c).over(w.rowsBetween(-(part - 1), 0)) for c in most})
    shares = {}
    for c in most:
        past = [F.lag(f"_most_{c}", n).over(w) if n else F.col(f"_most_{c}") for n in back]
        shares[c] = div(c, F.greatest(*past) if len(past) > 1 else past[0])
    return df.withColumns(shares).select(*keep)


#: Frames of so few rows are cheap as window expressions.
SHORT_FRAME = 5
#: Rows of a batch that Python hands back, in whole histories.
PACKED_ROWS = 5_000


def _prepare(side: dict[str, np.ndarray], columns: Sequence[str], rows: int) -> dict[str, np.ndarray]:
    """``preprocess`` of all indicators for histories side by side."""
    wanted, first, second = _plan()
    over = lambda a, b: np.where(b != 0, a / b, np.nan)
    x = dict(side)
    x |= _recursions(x["High"], x["Low"], x["Close"], x["Volume"])
    x |= {name: _frame(kind, x[c], n) for name, (kind, c, n) in wanted.items() if name not in x}
    x |= first(x.__getitem__, over, lambda f: np.where(f, 1.0, 0.0))
    x["_fall2"] = x["_fall"] * x["_fall"]
    x |= {name: _frame(kind, x[c], n) for name, (kind, c, n) in second.items()}
    x |= _last(x.__getitem__, np.sqrt)
    out = {}
    for c in columns:
        v = x[c]
        if c in SIGMOID:
            v = np.where(np.arange(len(v))[:, None] < 5, 0.0, v) if c == "trend_trix" else v
            v = 1 / (1 + np.exp(-v / SIGMOID[c]))
        elif c in HUNDREDTHS:
            v = v / 100
        elif c == "volume_nvi":
            v = np.log(np.where(v > 0, v / 100, np.nan))
        elif c == "volatility_kcp":
            v = np.clip(v, -10, 10) / 10
        elif c in TO_ROLLING_MAX:
            v = over(v, _frame("max", v, rows))
        out[c] = v
    return out


def prepared_indicators(bars: DataFrame, columns: Sequence[str], packed: bool = False, rows: int = 252) -> DataFrame:
    """``preprocess(all_indicators(bars))`` in one pass over the histories: ``ticker``, ``Date``, ``Close``, ``Volume`` and ``columns``.

    A window after the pass would shuffle its table, so frames over indicators and the
    rolling maximum are taken in it.  ``packed`` gives a row a ticker instead: ``_rows``, the
    bars, and ``_past``, their values of ``columns`` as arrays, so that a lag is a place in
    ``_past`` (``lagged``).
    """
    wanted = _plan()[0]
    df = window_frames(_inputs(bars), {name: f for name, f in wanted.items() if f[2] <= SHORT_FRAME})
    own, fields = ["ticker", "Date", "Close", "Volume"], bars.schema
    new = [c for c in columns if packed or c not in own]
    skip = {"ticker", "Date", "AdjClose", "Dividends", "Splits"}
    inputs = [c for c in df.columns if c not in skip]

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _histories(batches):
            found = np.empty((len(new), len(table)))
            for at, cell, side in _side_by_side(table, inputs):
                with np.errstate(all="ignore"):
                    for k, x in enumerate(_prepare(side, new, rows).values()):
                        found[k, at] = x[cell]
            if not packed:
                out = pa.table([*[table[c] for c in own], *[doubles(x) for x in found]], names=[*own, *new])
                yield from out.to_batches(max_chunksize=10_000)
                continue
            table = table.combine_chunks()
            ends = np.append(np.flatnonzero(table["_row"].to_numpy() == 1)[1:], len(table))
            a = 0
            while a < len(table):
                b = int(ends[min(np.searchsorted(ends, a + PACKED_ROWS), len(ends) - 1)])
                cut = pa.array(np.concatenate([[0], ends[(ends > a) & (ends <= b)] - a]).astype(np.int32))
                bar = pa.StructArray.from_arrays([table[c].slice(a, b - a).combine_chunks() for c in own], names=own)
                past = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * len(new)), doubles(found[:, a:b].T.ravel()))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(cut, bar), pa.ListArray.from_arrays(cut, past)], names=["_rows", "_past"])
                a = b

    bar = T.StructType([fields[c] for c in own])
    schema = T.StructType([T.StructField("_rows", T.ArrayType(bar)), T.StructField("_past", T.ArrayType(T.ArrayType(T.DoubleType())))]) if packed else \
        T.StructType([*bar.fields, *[T.StructField(c, T.DoubleType()) for c in new]])
    rows_of = df.select("ticker", "Date", *inputs).withColumn("_row", F.row_number().over(by(order=F.asc_nulls_last("Date"))))
    return rows_of.mapInArrow(many, schema)


def lagged(packed: DataFrame, lags: Sequence[int]) -> DataFrame:
    """The rows of packed histories, with the arrays of the row (``_lag_0``) and of earlier ones; NULL before the first."""
    each = F.transform("_rows", lambda r, i: F.struct(r.alias("_bar"), *[F.get("_past", i - n).alias(f"_lag_{n}") for n in dict.fromkeys([0, *lags])]))
    return packed.select(F.inline(each)).select("_bar.*", *[f"_lag_{n}" for n in dict.fromkeys([0, *lags])])


def scaled_columns(df: DataFrame, lags: list[int], columns: list[str]) -> DataFrame:
    """Columns at the row and at lags, price-like ones over the current close, volumes over the
    current volume (below 2: 1).

    A row's columns are one array, so that a lag is one look back and not one for each column.
    """
    w = by()
    df = df.select("ticker", "Date", "Close", "Volume", F.array(*[F.col(c).cast("double") for c in columns]).alias("_lag_0"))
    return over_bar(df.withColumns({f"_lag_{n}": F.lag("_lag_0", n).over(w) for n in lags}), lags, columns)


def over_bar(df: DataFrame, lags: Sequence[int], columns: Sequence[str]) -> DataFrame:
    """The columns of ``scaled_columns`` from arrays ``_lag_<n>``."""
    df = df.withColumn("_volume", F.when(F.col("Volume") < 2, 1.0).otherwise(F.col("Volume")))
    out = []
    for lag in [0, *lags]:
        for k, c in enumerate(columns):
            x = F.col(f"_lag_{lag}")[k]
            if c in TO_CLOSE:
                x = div(x, "Close")
            elif c == "Volume":
                x = x / F.col("_volume")
            elif c == "volume_adi":
                x = div(x, F.col("_volume") * F.col("Close"))
            out.append(x.alias(f"FeatureTA_{c}" + (f"_lag_m{lag}" if lag else "")))
    return df.select("ticker", "Date", *out)
