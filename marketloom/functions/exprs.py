"""Column expressions: safe arithmetic, squashers, date fields, valuation, costs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ROWS_PER_MONTH = 21


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(col(a), col(b))


def ln(x: Column | str) -> Column:
    """Natural logarithm, NULL for numbers that have none."""
    return F.when(col(x) > 0, F.ln(col(x)))


def clip(x: Column | str, low: float, high: float) -> Column:
    """x within [low, high]; NULL stays NULL."""
    x = col(x)
    return F.when(x < low, F.lit(float(low))).when(x > high, F.lit(float(high))).otherwise(x)


def finite(x: Column | str) -> Column:
    """NaN and infinities to NULL."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def sigmoid(x: Column | str, scale: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-col(x) / scale))


def tanh01(x: Column | str, scale: float = 1.0) -> Column:
    """tanh to (0, 1)."""
    return F.tanh(col(x) / scale) / 2 + 0.5


def tanh01_at_one(x: Column | str) -> Column:
    return F.tanh(col(x) - 1) / 2 + 0.5


def tanh01_log(x: Column | str, center: float, spread: float) -> Column:
    """For a logarithm: centred at ln(center), scaled by ln(spread)."""
    import math

    return F.tanh((col(x) - math.log(center)) / math.log(spread)) / 2 + 0.5


def linear01(x: Column | str) -> Column:
    """-1..1 to 0..1, clipped."""
    return clip((col(x) + 1) / 2, 0, 1)


def target_squash(ratio: Column | str, factor: float = 10.0) -> Column:
    return F.tanh((col(ratio) - 1) * factor) / 2 + 0.5


def target_unsquash(y: Column | str, factor: float = 10.0) -> Column:
    return F.atanh((col(y) - 0.5) * 2) / factor + 1


def trading_cost(value: Column | str) -> Column:
    """Stamp duty 0.15 % and commission 0.05 %, the same for buying and selling."""
    return col(value) * 0.0020


def log_price_to(price: Column | str, base: Column | str, times: float = 1.0) -> Column:
    """ln(price / (base * times)), 1e-5 where the base is not above 1e-5."""
    return F.when(col(base) <= 1e-5, F.lit(1e-5)).otherwise(ln(div(price, col(base) * times)))


def first_match(checks: list[tuple[Column, Column]], last: Column) -> Column:
    """The value of the first condition that holds, else ``last``."""
    return F.coalesce(*[F.when(c, v) for c, v in checks], last)


def stop_loss(close: Column | str, later: list[Column], level: float = 0.92) -> Column:
    """The first of the later closes at or below ``level`` of the close, else the last."""
    return first_match([(div(c, close) <= level, c) for c in later[:-1]], later[-1])


def week_part(date: Column | str) -> Column:
    d = F.weekday(col(date))
    return F.when(d < 2, 0).when(d < 4, 1).otherwise(2)


def season(date: Column | str) -> Column:
    """winter, spring, summer or autumn by month."""
    m = F.month(col(date))
    return (F.when(m.isin(12, 1, 2), "winter").when(m < 6, "spring").when(m < 9, "summer").otherwise("autumn"))


def date_fields(date: Column | str) -> dict[str, Column]:
    d = col(date)
    return {
        "year": F.year(d), "month": F.month(d), "day": F.day(d), "weekday": F.weekday(d), "iso_week": F.weekofyear(d),
        "quarter": F.quarter(d), "days_in_month": F.day(F.last_day(d)), "week_part": week_part(d), "season": season(d),
        "day_name": F.date_format(d, "EEEE"), "is_weekend": F.weekday(d) >= 5,
        "is_month_start": F.day(d) == 1, "is_month_end": d == F.last_day(d),
        "is_year_start": F.dayofyear(d) == 1, "is_year_end": (F.month(d) == 12) & (F.day(d) == 31),
    }


def keyed_uniform(keys: Sequence[Column | str], *salt: int | str) -> Column:
    """A number of (0, 1) drawn from a row's key and a salt: the same on any partitioning and in any engine with MD5."""
    text = F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys], *[F.lit(str(x)) for x in salt])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)


def keyed_normal(keys: Sequence[Column | str], *salt: int | str) -> Column:
    """A standard normal number drawn likewise, from two uniform ones."""
    radius = F.sqrt(-2 * F.ln(keyed_uniform(keys, *salt, "r")))
    return radius * F.cos(2 * math.pi * keyed_uniform(keys, *salt, "a"))
