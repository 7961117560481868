"""Rolling figures over one long order, in slices that carry the rows before them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import small

#: Rows of a slice; a slice also holds the rows of a frame that come before it.
SLICE_ROWS = 20_000


def with_positions(df: DataFrame, flags: dict[str, Column], date: str = "Date", key: str = "ticker") -> tuple[DataFrame, DataFrame]:
    """Number the rows of each flag along (date, key), though one order may hold all rows.

    Gives one row per row and flag that is set, with ``k``, the flag's place, and ``_pos``,
    from 0 on; and the table of dates with ``_n``, the rows of each flag.  Rows are
    numbered within their date, and a date's numbers start behind those of all earlier
    dates: the only order over everything is that of the dates, one row each.  Rows without
    a flag take part in neither.
    """
    names = list(flags)
    count = F.array(*[F.count_if(flags[f]) for f in names])
    dates = df.groupBy(date).agg(count.alias("_n"))
    over = Window.partitionBy().orderBy(date).rowsBetween(Window.unboundedPreceding, -1)  # a row a date
    before = F.array(*[F.coalesce(F.sum(F.col("_n")[k]).over(over), F.lit(0)) for k in range(len(names))])
    within = Window.partitionBy(date).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    ranks = {f"_r{k}": F.count_if(flags[f]).over(within) for k, f in enumerate(names)}
    some = reduce(lambda a, b: a | b, (F.coalesce(flags[f], F.lit(False)) for f in names))
    placed = df.where(some).withColumns(ranks).join(small(dates.select(date, before.alias("_before"))), date)
    each = F.array(*[F.when(flags[f], F.col(f"_r{k}") + F.col("_before")[k] - 1) for k, f in enumerate(names)])
    return placed.select(*df.columns, F.posexplode(each).alias("k", "_pos")).where("_pos is not null"), dates


def rolling_mean_by_position(df: DataFrame, keys: Sequence[str], position: str, value: str, rows: int, name: str,
                             slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Mean of the last ``rows`` rows of a key by position (0, 1, ... without gaps); NULL where a value lacks or
    the frame isn't full.

    The order of a key is cut into slices of ``slice_rows``; the last ``rows`` rows of a
    slice also go to the next one (the halo), so that each slice is worked on alone, by
    differences of running sums.  No task needs a whole key, however many rows it has.
    """
    if slice_rows < rows:
        raise ValueError("a slice must be at least as long as a frame")
    at, inside = F.floor(F.col(position) / slice_rows), F.col(position) % slice_rows
    copies = F.when(inside >= slice_rows - rows, F.array(at, at + 1)).otherwise(F.array(at))
    cut = df.withColumn("_slice", F.explode(copies)).withColumn("_halo", F.col("_slice") != at)
    w = Window.partitionBy(*keys, "_slice").orderBy(position)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumns({"_sum": F.coalesce(F.sum(value).over(run), F.lit(0.0)), "_count": F.count(value).over(run)})
    last = lambda c: F.coalesce(F.lag(c, rows).over(w), F.lit(0))
    mean = F.when(F.col("_count") - last("_count") == rows, (F.col("_sum") - last("_sum")) / rows)
    return cut.withColumn(name, mean).where("not _halo").drop("_slice", "_halo", "_sum", "_count")
