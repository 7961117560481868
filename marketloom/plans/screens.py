"""Quantile screens: single features, grids, linear combinations."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, div, keyed_normal, keyed_uniform
from ..operators.aggregates import distribution_distance
from ..operators.halo import SLICE_ROWS, rolling_mean_by_position, with_positions
from ..operators.quantiles import quantile_row
from ..operators.samples import feature_names
from ..operators.windows import local_minima
from ..scratch import materialize, small


def unpivot(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per row and feature: ``feature``, ``x``."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("r")) \
        .select(*keep, "r.feature", "r.x")


def feature_scores(df: DataFrame, features: Sequence[str], target: str, q: float, upper: bool = True, date: str = "Date", stored: bool = False) -> DataFrame:
    """M4: per feature, the mean over all dates of the mean target of its rows beyond the quantile (a date without: 0)."""
    df = df if stored else materialize(df.select(date, *dict.fromkeys([*features, target])))
    cuts = quantile_row(df, features, [q], [f"_c{k}" for k in range(len(features))], True)
    both, aggs = df.join(F.broadcast(cuts)), []
    for k, f in enumerate(features):
        hit = F.col(f) > F.col(f"_c{k}")[0] if upper else F.col(f) < F.col(f"_c{k}")[0]
        aggs.append(F.coalesce(F.avg(F.when(hit, F.col(target))), F.lit(0.0)).alias(f"_m{k}"))
    per = both.groupBy(date).agg(*aggs)
    means = per.agg(*[F.avg(f"_m{k}").alias(f"_m{k}") for k in range(len(features))])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_m{k}").alias("score")) for k, f in enumerate(features)])
    return means.select(F.explode(rows).alias("r")).select("r.feature", "r.score")


def quantile_screen(df: DataFrame, features: Sequence[str], target: str, levels: Sequence[float], date: str = "Date",
                    key: str = "ticker", rows: int = 200, most_gap: int = 100, only: Sequence[tuple[float, str]] | None = None) -> DataFrame:
    """For each feature, level and tail: rows, mean target, dates and the largest gap between them; mean,
    deviation and last value of the target's mean over ``rows`` successive hits (by date and ``key``, full windows
    only); and a score.

    The score is the last rolling mean times (1 - deviation, 0 at least), and 0 with fewer hits than the tail's share
    of all rows or with a gap above ``most_gap`` days; both tails alike.

    The rows are stored once with a flag for each tail; the order of a tail, which may
    hold nearly all rows, is worked on in slices (``halo``).  ``only`` names the tails that
    are wanted as (level, "upper" or "lower"); rows in none of them are numbered in none.
    """
    df = materialize(df.select(date, key, *features, F.col(target).alias("_t")))
    names = [f"_c{k}" for k in range(len(features))]
    cuts = quantile_row(df, features, levels, names, True).crossJoin(df.agg(F.count("*").alias("_all")))  # a single row
    tails = [(k, f, i, q, up) for k, f in enumerate(features) for i, q in enumerate(levels) for up in (True, False)
             if only is None or (q, "upper" if up else "lower") in only]
    flags = {f"{k}": F.coalesce(F.col(f) >= F.col(f"_c{j}")[i] if up else F.col(f) <= F.col(f"_c{j}")[i], F.lit(False))
             for k, (j, f, i, _, up) in enumerate(tails)}
    marked = materialize(df.join(F.broadcast(cuts)).withColumns({f"_f{k}": x for k, x in flags.items()}).select(
        date, key, "_t", "_all", *[f"_f{k}" for k in flags]))
    flags = {k: F.col(f"_f{k}") for k in flags}
    placed, _ = with_positions(marked, flags, date, key)
    named = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(float(q)).alias("q"), F.lit("upper" if up else "lower").alias("tail")) for _, f, _, q, up in tails])
    rolled = rolling_mean_by_position(placed.select("k", "_pos", "_t"), ["k"], "_pos", "_t", rows, "r", max(SLICE_ROWS, rows)).where("r is not null")
    rolled = rolled.groupBy("k").agg(F.avg("r").alias("roll_mean"), F.stddev("r").alias("roll_std"), F.max_by("r", "_pos").alias("roll_last"))
    per = marked.groupBy(date).agg(F.first("_all").alias("all"), F.array(*[
        F.struct(F.count_if(x).alias("n"), F.sum(F.when(x, F.col("_t"))).alias("s"), F.avg(F.when(x, F.col("_t"))).alias("m")) for x in flags.values()]).alias("a"))
    per = per.select(date, "all", F.posexplode("a").alias("k", "v")).where("v.n > 0").select(date, "all", "k", "v.*")
    gap = F.datediff(date, F.lag(date, 1).over(Window.partitionBy("k").orderBy(date)))  # a row a date
    out = per.withColumn("gap", gap).groupBy("k").agg(
        F.sum("n").alias("n"), div(F.sum("s"), F.sum("n")).alias("mean_target"), F.avg("m").alias("mean_of_dates"), F.count("*").alias("n_dates"),
        F.max("gap").alias("max_gap"), F.first("all").alias("all")).join(rolled, "k", "left").withColumn("h", F.element_at(named, F.col("k") + 1))
    share = F.when(F.col("h.tail") == "upper", 1 - F.col("h.q")).otherwise(F.col("h.q")) * F.col("all")
    good = (F.col("n") >= share) & (F.coalesce("max_gap", F.lit(0)) <= most_gap)
    score = F.when(good, F.col("roll_last") * F.greatest(1 - F.col("roll_std"), F.lit(0.0))).otherwise(0.0)
    return out.select("h.*", "n", "mean_target", "mean_of_dates", "n_dates", "max_gap", "roll_mean", "roll_std", "roll_last", score.alias("score"))


def tails_within(levels: Sequence[float], most: Sequence[float]) -> list[tuple[float, str]]:
    """Those tails of ``levels`` that ``best_tails`` compares for the levels ``most``: no other score enters its result."""
    wanted = {round(float(q), 9) for q in most}
    return [(q, tail) for q in levels for tail, x in (("upper", 1 - q), ("lower", q)) if round(x, 9) in wanted]


def best_tails(screen: DataFrame, levels: Sequence[float]) -> DataFrame:
    """For each feature and level, the better score of its lower tail and of the upper one at ``1 - level``."""
    q = F.round(F.when(F.col("tail") == "upper", 1 - F.col("q")).otherwise(F.col("q")), 9)
    return screen.withColumn("q", q).where(F.col("q").isin([float(x) for x in levels])).groupBy("feature", "q").agg(F.max("score").alias("score"))


def predicate_screen(df: DataFrame, predicates: dict[str, Column], target: str) -> DataFrame:
    """Count and mean target of named predicates, all in one pass; combine them with | and &."""
    aggs = [x for n, p in predicates.items() for x in (F.count_if(p).alias(f"{n}__n"), F.avg(F.when(p, F.col(target))).alias(f"{n}__m"))]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{n}__n").alias("n"), F.col(f"{n}__m").alias("mean_target")) for n in predicates])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def minima_grid(bars: DataFrame, distances: Sequence[int], least: Sequence[int]) -> DataFrame:
    """Tickers with at least so many minima of each distance, best first."""
    out = None
    for d in distances:
        per = local_minima(bars, d)
        row = per.agg(*[F.count_if((F.col("n_minima") >= n) & F.coalesce("last_inside", F.lit(False))).alias(f"n{n}") for n in least])
        row = row.select(F.lit(d).alias("distance"), F.explode(F.array(*[F.struct(F.lit(n).alias("least"), F.col(f"n{n}").alias("tickers")) for n in least])).alias("r"))
        out = row if out is None else out.unionByName(row)
    return out.select("distance", "r.least", "r.tickers").orderBy(F.desc("tickers"), "distance", "least").limit(10)


def mean_by_score(df: DataFrame, score: str, target: str, q: float, periods: int = 1) -> DataFrame:
    """Mean target above and below a quantile of the score, and its per-period root."""
    cut = quantile_row(df, [score], [q], ["_c"])
    hit = F.col(score) >= F.col("_c")[0]
    out = df.join(F.broadcast(cut)).agg(F.avg(F.when(hit, F.col(target))).alias("above"), F.avg(F.when(~hit, F.col(target))).alias("below"))
    return out.withColumns({"above_root": F.pow("above", 1 / periods), "below_root": F.pow("below", 1 / periods)})


def linear_screen(df: DataFrame, features: Sequence[str], target: str, q: float = 0.9, rate: float = 0.02, epochs: int = 10, sharpness: float = 1.5,
                  date: str = "Date", upper: bool = True, noise: float = 0.0, subsample: float = 1.0, init_top: int = 1, seed: int = 0,
                  key: Sequence[str] = ("ticker",)) -> dict[str, float]:
    """M5: weights of a linear score whose soft upper tail has the best mean target per date.

    Per epoch Spark makes the passes of an exact quantile for the threshold, one for the
    dates' sums and one for the gradient; the driver holds the weights only.  The threshold
    counts as constant within a step.  The weights begin with 1 at one of the ``init_top``
    best single features and 0.1 elsewhere.  Each step adds normal ``noise`` to the soft
    mask (cut to 0..1, where the gradient is 0) and uses a ``subsample`` of the rows; both
    are drawn from a row's (date, ``key``), the step and ``seed``, so that the weights don't
    depend on how the rows are laid out.
    """
    df = materialize(df.select(date, *key, *features, F.col(target).alias("_t")).dropna(subset=[date, *features, "_t"]))
    drawn = [date, *key]
    scores = {r.feature: r.score for r in feature_scores(df, features, "_t", q, upper, date, True).collect()}
    a = np.full(len(features), 0.1)
    best = sorted(range(len(features)), key=lambda k: (-scores[features[k]], k))[:max(init_top, 1)]
    a[best[int(np.random.default_rng(seed).integers(len(best)))]] = 1.0
    m, v, sign = np.zeros(len(a)), np.zeros(len(a)), 1.0 if upper else -1.0
    for step in range(1, epochs + 1):
        w = sum((F.col(f) * float(x) for f, x in zip(features, a, strict=True)), F.lit(0.0))
        cut = quantile_row(df.select(w.alias("_w")), ["_w"], [q], ["_c"], True).first()["_c"][0]
        if cut is None:
            break
        soft = df.withColumn("_s", 1 / (1 + F.exp(-sign * sharpness * (w - cut))))
        if subsample < 1:
            soft = soft.where(keyed_uniform(drawn, seed, step, "rows") < subsample)
        moved = F.col("_s") + F.lit(noise) * keyed_normal(drawn, seed, step, "noise") if noise else F.col("_s")
        soft = soft.withColumn("_m", moved).withColumns({
            "_p": clip("_m", 0, 1), "_d": F.when((F.col("_m") > 0) & (F.col("_m") < 1), F.col("_s") * (1 - F.col("_s"))).otherwise(0.0)})
        dates = soft.groupBy(date).agg(F.sum("_p").alias("_soft_n"), F.sum(F.col("_p") * F.col("_t")).alias("_soft_t"))
        g = soft.join(dates.where("_soft_n > 0"), date).agg(F.countDistinct(date).alias("n"), *[
            F.sum((F.col("_t") - F.col("_soft_t") / F.col("_soft_n")) / F.col("_soft_n") * sign * sharpness * F.col("_d") * F.col(f)).alias(f"g{k}")
            for k, f in enumerate(features)]).first()
        grad = -np.array([g[f"g{k}"] or 0.0 for k in range(len(a))]) / max(g["n"], 1)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        a = a - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return dict(zip(features, a.tolist(), strict=True))


def reduce_screen(df: DataFrame, features: Sequence[str], target: str, iterations: int = 3, ratio: float = 0.5, **options) -> dict[str, float]:
    """M6: repeat the linear screen on the features with the largest weights."""
    features, weights = list(features), {}
    for _ in range(iterations):
        weights = linear_screen(df, features, target, **options)
        keep = max(int(len(features) * ratio), 1)
        if keep == len(features):
            break
        features = sorted(features, key=lambda f: (-abs(weights[f]), f))[:keep]
    return {f: weights[f] for f in features}


def hard_mask(train: DataFrame, test: DataFrame, weights: dict[str, float], q: float) -> tuple[DataFrame, DataFrame]:
    """M6: rows whose score is above the training quantile, on both sides."""
    w = sum((F.col(f) * x for f, x in weights.items()), F.lit(0.0))
    cut = quantile_row(train.select(w.alias("score")), ["score"], [q], ["_c"])
    return tuple(d.withColumn("score", w).join(F.broadcast(cut)).where(F.col("score") > F.col("_c")[0]).drop("_c") for d in (train, test))


def matching_weights(train: DataFrame, test: DataFrame, features: Sequence[str], key: str, bins: int = 10, floor: float = 0.1, passes: int = 5,
                     tolerance: float = 0.0, stored: bool = False) -> DataFrame:
    """M7: weights of training rows so that each feature's bins hold the test rows' shares.

    Bins are training quantiles.  Each pass multiplies a cell's weight by wanted / present
    of its bin, feature after feature (iterative proportional fitting); weights stay at
    least ``floor`` and average 1.  Passes work on the stored table of occupied cells (at
    most bins ** features rows): each feature takes one aggregate of it, whose ``bins`` sums
    come to the driver, and each pass stores the table anew.  Passes end when no weight
    moves by more than ``tolerance``.
    """
    train = train if stored else materialize(train)  # read for the edges, the cells and the result
    row = quantile_row(train, features, [k / bins for k in range(1, bins)], [f"_e{k}" for k in range(len(features))], True).first()
    edges = [row[f"_e{k}"] for k in range(len(features))]  # bins - 1 numbers a feature
    cells = [f"_b{k}" for k in range(len(features))]

    def binned(df: DataFrame) -> DataFrame:
        place = lambda f, e: sum((F.when(F.col(f) > F.lit(x), 1).otherwise(0) for x in e), F.lit(0))
        return df.withColumns({c: place(f, e) for c, f, e in zip(cells, features, edges, strict=True)})

    tr = binned(train)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("b")) for k, c in enumerate(cells)])).alias("r")
    rows = binned(test).select(each).groupBy("r.k", "r.b").agg(F.count("*").alias("n")).collect()  # a row a bin
    wanted = [[0.0] * bins for _ in cells]
    for r in rows:
        wanted[r["k"]][r["b"]] = r["n"] / sum(x["n"] for x in rows if x["k"] == r["k"])
    table = materialize(tr.groupBy(*cells).agg(F.count("*").alias("_n")).withColumn("weight", F.lit(1.0)))
    total = table.agg(F.sum("_n")).first()[0] or 0
    for _ in range(passes):
        weight = F.col("weight")
        for c, share in zip(cells, wanted, strict=True):
            now = {r[c]: r["s"] for r in table.groupBy(c).agg(F.sum(F.col("_n") * weight).alias("s")).collect()}  # a row a bin
            factor = F.array(*[F.lit(share[b] * total / now[b] if now.get(b) else 0.0) for b in range(bins)])
            weight = F.greatest(weight * F.element_at(factor, F.col(c) + 1), F.lit(floor))
        table = materialize(table.withColumns({"_old": F.col("weight"), "weight": weight}))
        if tolerance and (table.agg(F.max(F.abs(F.col("weight") - F.col("_old")))).first()[0] or 0.0) <= tolerance:
            break
        table = table.drop("_old")
    mean = table.agg((F.sum(F.col("_n") * F.col("weight")) / F.sum("_n")).alias("m")).first()["m"]
    weights = table.select(*cells, (F.col("weight") / F.lit(mean)).alias("weight"))
    return tr.join(small(weights), cells).drop(*cells)


#: Families of features that matching can be switched on for, as patterns of this library's column names.
MATCH_FAMILIES = {
    "price_differences": r"^(log_)?diff2?(_lag_m\d+)?$", "quarters": r"^q_", "price_metrics": r"^log_(trailing_pe|forward_pe|pb)_ratio",
    "fourier_errors": r"^price_rmse_MH", "fourier_signs": r"^price_sign_", "trend_indicators": r"^FeatureTA_trend", "group_volume": r"^volume_level"}


def matching_features(names: Sequence[str], distance: dict[str, float], patterns: Sequence[str], fallback: str, keep: int = 2) -> list[str]:
    """Of the names that one of the ``patterns`` finds (else ``fallback``), the ``keep`` whose distributions differ most."""
    chosen = [n for n in names if any(re.search(p, n) for p in patterns)] or [n for n in names if re.search(fallback, n)]
    return feature_names(chosen, without=(), distance=distance, keep=keep) if chosen else []


def tree_weights(train: DataFrame, test: DataFrame, features: Sequence[str], key: str, match: bool = True, patterns: Sequence[str] = (),
                 fallback: str = MATCH_FAMILIES["price_differences"], keep: int = 2, bins: int = 15, floor: float = 0.4) -> DataFrame:
    """A column ``weight`` for the training rows: 1 unless ``match``, else matching weights on the chosen features.

    The distance of each feature between train and test is taken over all rows; one number a feature comes to the driver.
    """
    if not match:
        return train.withColumn("weight", F.lit(1.0))
    train, test = materialize(train), materialize(test.select(*features))  # each is read for the distances and for the weights
    long = [unpivot(d, features, []).where("x is not null") for d in (train, test)]
    n = long[1].groupBy("feature").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    far = {r.feature: r.distance for r in distribution_distance(long[0], long[1], "x", n).collect()}
    chosen = matching_features(features, far, patterns, fallback, keep)
    return matching_weights(train, test, chosen, key, bins, floor, stored=True) if chosen else train.withColumn("weight", F.lit(1.0))
