"""Samples: filters, masks, scaling, splits."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, div, finite


def between_dates(df: DataFrame, start: str, end: str, date: str = "Date") -> DataFrame:
    """Rows from ``start`` to ``end``, both included."""
    if start > end:
        raise ValueError(f"{start} is after {end}")
    return df.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def drop_incomplete(df: DataFrame, numbers: Sequence[str], date: str = "Date") -> DataFrame:
    """Without rows that lack a date, or a number unless they are their ticker's last row."""
    whole = F.lit(True)
    for c in numbers:
        whole = whole & F.col(c).isNotNull()
    last = F.lead(date, 1).over(Window.partitionBy("ticker").orderBy(date)).isNull()
    return df.where(F.col(date).isNotNull()).withColumn("_last", last).where(whole | F.col("_last")).drop("_last")


def numbers_from_text(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """The text 'None' is NULL; other text becomes a number or NULL."""
    text = {c for c, t in df.dtypes if t == "string"}
    return df.select(*[F.expr(f"nullif(`{c}`, 'None')" if c in text else f"`{c}`").alias(c) if c in exclude else F.expr(
        f"try_cast(nullif(cast(`{c}` as string), 'None') as double)").alias(c) for c in df.columns])


def restrict_report_time(df: DataFrame) -> DataFrame:
    """P5: report times other than pre- and post-market are NULL; quarters without reported date go."""
    ok = F.col("reportTime").isin("pre-market", "post-market")
    return df.where(F.col("reportedDate").isNotNull()).withColumn("reportTime", F.when(ok, F.col("reportTime")))


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns all have finite or non-numeric values."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: finite(c) for c in columns if kinds[c] in ("double", "float")}).dropna(subset=list(columns))


def _usable(columns: Sequence[str], most: float) -> Column:
    return F.forall(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= most))


def clean_samples(df: DataFrame, features: Sequence[str], target: str, train: bool, most: float = 1e10) -> DataFrame:
    """Usable features, and a target in training rows."""
    out = df.where(_usable(features, most))
    return out.where(F.col(target).isNotNull() & ~F.isnan(target)) if train else out


def removed_counts(df: DataFrame, features: Sequence[str], target: str, most: float = 1e10) -> DataFrame:
    """How many rows cleaning removes, and why."""
    bad = ~F.coalesce(_usable(features, most), F.lit(False))
    return df.agg(F.count_if(F.col(target).isNull()).alias("no_target"), F.count_if(bad).alias("bad_features"), F.count("*").alias("n_rows"))


def feature_names(names: Sequence[str], without: Sequence[str] = ("Category", "Seasonal", "lag"), patterns: Sequence[str] = (),
                  distance: dict[str, float] | None = None, keep: int | None = None) -> list[str]:
    """Names without some words that match a pattern, the ``keep`` most distant last."""
    out = [n for n in names if not any(w in n for w in without)]
    if patterns:
        out = [n for n in out if any(re.search(p, n) for p in patterns)]
    if distance is not None:
        out = sorted(out, key=lambda n: (distance.get(n, 0.0), n))
    return out[-keep:] if keep else out


def standard_scale(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Mean 0, deviation 1 by the training rows (deviation 0: 1).  The moments are one row."""
    m = train.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])

    def apply(df: DataFrame) -> DataFrame:
        new = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
        return df.join(F.broadcast(m)).withColumns(new).select(*df.columns)

    return apply(train), apply(test)


def stretch(df: DataFrame, column: str) -> DataFrame:
    """An array stretched about 0.5 until it touches 0 or 1, clipped."""
    low, high = F.array_min(column), F.array_max(column)
    width = F.greatest(high - 0.5, 0.5 - low)
    width = F.when(F.abs(width) < 1e-6, 1.0).otherwise(width)
    return df.withColumn("_w", width).withColumn(column, F.transform(column, lambda x: clip((x - 0.5) / F.col("_w") + 0.5, 0, 1))).drop("_w")


def min_max_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Least 0, most 1."""
    m = df.agg(*[F.min(c).alias(f"_a_{c}") for c in columns], *[F.max(c).alias(f"_b_{c}") for c in columns])
    new = {c: div(F.col(c) - F.col(f"_a_{c}"), F.col(f"_b_{c}") - F.col(f"_a_{c}")) for c in columns}
    return df.join(F.broadcast(m)).withColumns(new).select(*df.columns)


def recent_days(df: DataFrame, days: int, date: str = "Date") -> DataFrame:
    """The last ``days`` days before the last date."""
    last = df.agg(F.max(date).alias("_last"))
    return df.join(F.broadcast(last)).where(F.col(date) >= F.date_sub("_last", days)).select(*df.columns)


def repair_dates(dates: DataFrame, panel: DataFrame, date: str = "Date") -> DataFrame:
    """Each date, or the panel's latest before it; distinct."""
    from .joins import asof

    known = panel.select(date).distinct().withColumn("k", F.lit(1)).withColumnRenamed(date, "_known")
    found = asof(dates.select(F.col(date)).withColumn("k", F.lit(1)), known, on=date, by=("k",), right_on="_known")
    return found.where("_known is not null").select(F.col("_known").alias(date)).distinct()
