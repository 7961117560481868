"""Joins: as-of look-ups, merges of old and new rows, membership, grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import div
from ..sources.schemas import BAR_NUMBERS
from .quantiles import running_totals


def asof(left: DataFrame, right: DataFrame, on: str = "Date", by: Sequence[str] = ("ticker",), right_on: str | None = None,
         suffix: str = "", forward: bool = False) -> DataFrame:
    """Each left row with the latest right row whose key is at or before its own
    (``forward``: the earliest at or after).

    Both sides are stacked and the last right row is carried along in key order: one
    shuffle by ``by``, one sort, no range join.  Of several right rows with one key the
    greatest (by its columns) is taken.  Left rows without a match keep NULLs.
    """
    right_on = right_on or on
    clash = [c for c in right.columns if c in left.columns and c not in by]
    names = {c: f"{c}{suffix or '_right'}" if c in clash else c for c in right.columns if c not in by}
    row = F.struct(*[F.col(c).alias(names[c]) for c in names])
    stacked = (
        left.select(*by, F.col(on).alias("_key"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(
            right.select(row.alias("r")).schema["r"].dataType).alias("_right"), F.lit(1).alias("_side"))
        .unionByName(right.where(F.col(right_on).isNotNull()).select(
            *by, F.col(right_on).alias("_key"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType)
            .alias("_left"), row.alias("_right"), F.lit(0).alias("_side")))
    )
    if forward:
        w = Window.partitionBy(*by).orderBy(F.desc("_key"), "_side", F.desc("_right"))
    else:
        w = Window.partitionBy(*by).orderBy("_key", "_side", "_right")
    found = F.last("_right", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = stacked.withColumn("_found", found).where(F.col("_side") == 1)
    return out.select("_left.*", *[F.col(f"_found.{names[c]}") for c in names])


def asof_few(left: DataFrame, right: DataFrame, on: str = "Date", right_on: str = "_at", by: str = "ticker") -> DataFrame:
    """J1 for a right side with few rows a key, whose columns may be many: rows already dealt out by ``by`` stay where they are.

    A right row holds from its own date until the next one's, so a left row meets the
    handful of right rows of its key and keeps one.  Only the right side is shuffled and
    sorted; its columns pass no shuffle together with the left rows.  Of several right rows
    with one date the greatest (by its columns) is taken, as ``asof`` does.
    """
    rest = [c for c in right.columns if c not in (by, right_on)]
    held = right.where(F.col(right_on).isNotNull()).select(F.col(by).alias("_of"), right_on, F.struct(*rest).alias("_row"))
    held = held.withColumn("_until", F.lead(right_on).over(Window.partitionBy("_of").orderBy(right_on, "_row")))
    met = (F.col(by) == F.col("_of")) & (F.col(on) >= F.col(right_on)) & (F.col("_until").isNull() | (F.col(on) < F.col("_until")))
    return left.join(held, met, "left").select(*left.columns, right_on, *[F.col(f"_row.{c}").alias(c) for c in rest])


def asof_after_days(left: DataFrame, right: DataFrame, days: int, value: str, on: str = "Date") -> DataFrame:
    """The last known ``value`` at ``date + days``."""
    ahead = left.withColumn("_ahead", F.date_add(on, days))
    found = asof(ahead, right.select("ticker", F.col(on).alias("_at"), F.col(value).alias(f"{value}_after")), on="_ahead",
                 right_on="_at")
    return found.drop("_ahead", "_at")


def merge_new_over_old(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Full outer merge; a new value wins, an old one fills."""
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in columns])
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in columns])
    return o.join(n, list(keys), "full").select(*keys, *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in columns])


def full_join(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str = "_right") -> DataFrame:
    """Full outer join on equal keys; clashing right columns get a suffix."""
    named = right.select(*[F.col(c) if c in keys else F.col(c).alias(c + suffix if c in left.columns else c) for c in right.columns])
    return left.join(named, list(keys), "full")


def merge_bars(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bars of both, with adjusted closes rebuilt around the new ones.

    A new adjusted close stays.  Elsewhere it is ``Close * factor * scale``: the factor
    is the product of the split and dividend effects from this row on, the scale the
    ratio between a known adjusted close and that, from the row before, else the next.
    A factor is NULL if any effect in it is (a split of 0 has none).  Only tickers of
    either side are touched; running it again on its own result changes nothing.
    """
    cols = [c for c in BAR_NUMBERS if c != "AdjClose"]
    o = old.select("ticker", "Date", *[F.col(c).alias(f"_o_{c}") for c in BAR_NUMBERS])
    n = new.select("ticker", "Date", *[F.col(c).alias(f"_n_{c}") for c in BAR_NUMBERS])
    both = o.join(n, ["ticker", "Date"], "full")
    first = lambda c: F.coalesce(f"_o_{c}", f"_n_{c}")  # noqa: E731  the effects are taken from the old row
    close = first("Close")
    effect = div(F.lit(1.0), F.coalesce(first("Splits"), F.lit(1.0))) * div(close - F.coalesce(first("Dividends"), F.lit(0.0)), close)
    so_far = lambda order: Window.partitionBy("ticker").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rest = so_far(F.desc("Date"))  # from this row on, added up backwards: a frame with an open end would go through all of it for each row
    both = both.withColumns({"_close": close, "_effect": effect})
    factor = F.when(F.count_if(F.col("_effect").isNull()).over(rest) == 0, F.product("_effect").over(rest))
    both = both.withColumn("_factor", factor)
    both = both.withColumn("_scale", div(div("_n_AdjClose", "_close"), "_factor"))
    both = both.withColumn("_next", F.last("_scale", True).over(rest))
    scale = F.coalesce(F.last("_scale", True).over(so_far(F.asc("Date"))), "_next")
    adjusted = F.coalesce("_n_AdjClose", F.col("_close") * F.col("_factor") * scale)
    has_new = F.max(F.col("_n_Close").isNotNull()).over(Window.partitionBy("ticker"))
    out = both.withColumn("AdjClose", F.when(has_new, adjusted).otherwise(F.col("_o_AdjClose")))
    return out.select("ticker", "Date", *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in cols[:4]], "AdjClose",
                      *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in cols[4:]])


def merge_report(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per ticker, how many values of common dates differ by more than 1 % (volume:
    by more than one), and how many dates are new."""
    o = old.select("ticker", "Date", F.lit(True).alias("_old"), *[F.col(c).alias(f"_o_{c}") for c in BAR_NUMBERS])
    both = new.join(o, ["ticker", "Date"], "left")
    parts = [F.count_if(~div(c, f"_o_{c}").between(0.99, 1.01)).alias(f"n_{c}") for c in ("Open", "High", "Low", "Close", "Splits")]
    parts.append(F.count_if(F.abs(F.col("Volume") - F.col("_o_Volume")) / 100 > 0.01).alias("n_Volume"))
    parts.append(F.count_if(F.abs(F.col("Dividends") - F.col("_o_Dividends")) > 0.01).alias("n_Dividends"))
    return both.groupBy("ticker").agg(*parts, F.count_if(F.col("_old").isNull()).alias("n_new_rows"))


def changed_cells(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A22 for statements: cells of common rows that changed (NULL-safe), per column."""
    o = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in columns])
    both = new.join(o, list(keys))
    return both.agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(f"_o_{c}"))).alias(c) for c in columns])


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns of the right row with equal keys, NULL without one."""
    return left.join(right.select(*keys, *columns), list(keys), "left")


def missing_from(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the left side whose keys the right side lacks."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def members(df: DataFrame, membership: DataFrame, group: str) -> DataFrame:
    """Rows of the tickers of a group."""
    return df.join(membership.where(F.col("group") == group).select("ticker"), "ticker", "left_semi")


def with_member_flags(df: DataFrame, membership: DataFrame, groups: Sequence[str]) -> DataFrame:
    """A flag per group.  Memberships are first reduced to one row per ticker."""
    own = membership.groupBy("ticker").agg(*[
        F.max(F.when(F.col("group") == g, 1).otherwise(0)).alias(f"in_{g}") for g in groups])
    return df.join(own, "ticker", "left").fillna(0, [f"in_{g}" for g in groups])


def grid(dates: DataFrame, tickers: DataFrame) -> DataFrame:
    """Every date with every ticker.  Its size is the result's: trading days times
    tickers, which the feature panel has anyway; it is the one cross join here."""
    return tickers.select("ticker").distinct().crossJoin(dates.select("Date").distinct())


def between_neighbours(train: DataFrame, test: DataFrame, value: str, by: Sequence[str] = ("feature",)) -> DataFrame:
    """For successive train values, how many test values lie strictly between (first: 0).

    Running totals over both in two levels (``running_totals``), no range join: within a
    bucket of values the previous train value is the row before; the first one of a bucket
    follows the last one of an earlier bucket.
    """
    both = (train.select(*by, F.col(value).alias("v"), F.lit(0).alias("t"), F.lit(1).alias("k"))
            .unionByName(test.select(*by, F.col(value).alias("v"), F.lit(1).alias("t"), F.lit(0).alias("k"))))
    values, buckets = running_totals(both, by, "v", {"t": F.col("t"), "k": F.col("k")})
    own = values.where("k > 0")  # t_run: test values up to this one
    ends = own.groupBy(*by, "_bucket").agg(F.max("t_run").alias("_end"))
    over = Window.partitionBy(*by).orderBy("_bucket")  # a row a bucket
    ends = buckets.join(ends, [*by, "_bucket"], "left").withColumn(
        "_last", F.last(F.col("t_before") + F.col("_end"), True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy(*by, "_bucket").orderBy("v")
    own = own.withColumn("_lag", F.lag("t_run", 1).over(inside)).join(ends.select(*by, "_bucket", "t_before", "_last"), [*by, "_bucket"])
    upto = F.coalesce(F.col("t_before") + F.col("_lag"), F.col("_last"))
    gap = F.coalesce(F.col("t_before") + F.col("t_run") - F.col("t") - upto, F.lit(0))
    each = own.withColumn("_gap", gap).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))))  # repeated train values
    return each.select(*by, F.col("v").alias(value), F.when(F.col("_i") == 1, F.col("_gap")).otherwise(0).cast("long").alias("n_between"))


def split_at(panel: DataFrame, cutoff, test_end, date: str = "Date") -> DataFrame:
    """A ``role`` column: train up to the cutoff, test after it up to ``test_end``, NULL beyond."""
    d = F.col(date)
    return panel.withColumn("role", F.when(d <= F.lit(cutoff), "train").when(d <= F.lit(test_end), "test"))


def resplit(train: DataFrame, test: DataFrame, last_train, last_test=None, start=None, date: str = "Date") -> tuple[DataFrame, DataFrame]:
    """Move the cutoff back: training rows after ``last_train`` become test rows, in front of the old test rows up
    to ``last_test`` (their last date by default); rows before ``start`` go.  A cutoff at or after the first test date
    raises ``ValueError``."""
    d = F.col(date)
    bounds = test.agg(F.min(date).alias("a"), F.max(date).alias("b")).first()
    if bounds.a is not None and str(last_train) >= str(bounds.a):
        raise ValueError(f"{last_train} is not before the first test date {bounds.a}")
    last_test = bounds.b if last_test is None else last_test
    new = d.between(F.date_add(F.lit(last_train).cast("date"), 1), F.lit(last_test).cast("date"))
    kept = d <= F.lit(last_train).cast("date")
    return train.where(kept if start is None else kept & (d >= F.lit(start).cast("date"))), train.where(new).unionByName(test.where(new))


def date_union(*tables: DataFrame, date: str = "Date") -> DataFrame:
    """The distinct dates of all tables."""
    out = tables[0].select(date)
    for t in tables[1:]:
        out = out.union(t.select(date))
    return out.distinct()


def new_keys(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of the new table that the old one lacks."""
    return missing_from(new.select(*keys).distinct(), old, keys)


def selection_overlap(df: DataFrame, a: Column, b: Column, value: str) -> DataFrame:
    """Counts and means of rows selected by A, by B, by A only, and the share of A in B."""
    only = a & ~b
    return df.agg(
        F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), F.count_if(only).alias("n_only_a"),
        F.avg(F.when(a, F.col(value))).alias("mean_a"), F.avg(F.when(b, F.col(value))).alias("mean_b"),
        F.avg(F.when(only, F.col(value))).alias("mean_only_a"), div(F.count_if(a & b), F.count_if(a)).alias("overlap"))
