"""Screens, weights, backtests and Fourier features against plain arithmetic."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.functions import exprs, fourier
from marketloom.operators import halo
from marketloom.operators import joins as J
from marketloom.operators.aggregates import trading_days
from marketloom.operators.quantiles import quantile_row, quantile_table
from marketloom.plans import blocks, learning, screens
from marketloom.sources import schemas, views


def d(text):
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(1)
    rows = [(f"T{k % 7}", d("2024-01-01") + dt.timedelta(days=k // 7), *map(float, rng.normal(size=3)), float(1 + rng.normal() / 10)) for k in range(210)]
    return spark.createDataFrame(rows, "ticker string, Date date, a double, b double, c double, t double").persist()


def test_exact_quantiles(spark):
    rng = np.random.default_rng(0)
    columns = {"x": rng.normal(size=1000) * 1e3, "y": rng.integers(-5, 6, 1000).astype(float), "z": np.exp(rng.normal(size=1000) * 30)}
    rows = [tuple(float(columns[c][k]) for c in "xyz") + (None,) for k in range(1000)] + [(None, None, None, None)] * 5
    df = spark.createDataFrame(rows, "x double, y double, z double, none double")
    levels = [0.0, 0.013, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {(r.column, r.k): r.v for r in quantile_table(df, ["x", "y", "z", "none"], levels).collect()}
    assert got == pytest.approx({(c, k): np.quantile(columns[c], q) for c in "xyz" for k, q in enumerate(levels)}, rel=1e-12)
    one = quantile_row(df, ["y", "none"], [0.5, 0.25], ["p", "q"]).collect()
    assert len(one) == 1 and one[0].p == [np.quantile(columns["y"], 0.5), np.quantile(columns["y"], 0.25)] and one[0].q == [None, None]
    assert quantile_table(df.limit(0), ["x"], [0.5]).count() == 0


def test_trading_days_by_next_bar(spark):
    days = ["2024-01-05", "2024-01-06", "2024-01-07", "2024-01-09", "2024-01-12", "2024-01-13"]  # a Friday, a weekend, ...
    df = spark.createDataFrame([("A", d(x)) for x in days] + [("B", d("2023-12-20")), ("B", d("2024-01-14"))], "ticker string, Date date")
    want = set()
    for t in ("A", "B"):
        own = sorted(r.Date for r in df.where(F.col("ticker") == t).collect())
        for k in range(12):
            day = d("2024-01-03") + dt.timedelta(days=k)
            if day.weekday() < 5 and (before := [x for x in own if x <= day]):
                want.add(before[-1])
    assert {r.Date for r in trading_days(df, "2024-01-03", "2024-01-14").collect()} == want


def test_resplit_moves_training_rows_and_checks_the_cutoff(panel):
    train, test = panel.where("Date < '2024-01-20'"), panel.where("Date >= '2024-01-20'")
    a, b = J.resplit(train, test, "2024-01-10", "2024-01-25", "2024-01-03")
    days = lambda x: (str(x.agg(F.min("Date")).first()[0]), str(x.agg(F.max("Date")).first()[0]))
    assert days(a) == ("2024-01-03", "2024-01-10") and days(b) == ("2024-01-11", "2024-01-25")
    assert b.count() == panel.where("Date between '2024-01-11' and '2024-01-25'").count()
    with pytest.raises(ValueError):
        J.resplit(train, test, "2024-01-20")


def numpy_screen(rows, q, rate, epochs, sharpness, cuts):
    """The same steps on arrays; ``cuts`` are the thresholds of the steps."""
    x, t, day = (np.array([[r[c] for c in cols] for r in rows]).squeeze() for cols in (("a", "b"), ("t",), ("Date",)))
    scores = [np.mean([t[(day == u) & (x[:, k] > np.quantile(x[:, k], q))].mean() if ((day == u) & (x[:, k] > np.quantile(x[:, k], q))).any() else 0 for u in np.unique(day)]) for k in range(2)]
    w = np.full(2, 0.1)
    w[int(np.argmax(scores))] = 1.0
    m, v = np.zeros(2), np.zeros(2)
    for step in range(1, epochs + 1):
        def value(a):
            p = 1 / (1 + np.exp(-sharpness * (x @ a - cuts[step - 1])))
            return np.mean([(p * t)[day == u].sum() / p[day == u].sum() for u in np.unique(day)])

        grad = -np.array([(value(w + e) - value(w - e)) / 2e-6 for e in np.eye(2) * 1e-6])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def test_linear_screen_steps(panel):
    rows = panel.collect()
    got = screens.linear_screen(panel, ["a", "b"], "t", 0.8, rate=0.02, epochs=2)
    x = np.array([[r.a, r.b] for r in rows])

    def cut(w):  # the percentile of Spark's approximation is a value that occurs
        return sorted(x @ w)[int(np.ceil(0.8 * len(x))) - 1]

    first = numpy_screen(rows, 0.8, 0.02, 0, 1.5, [])
    one = numpy_screen(rows, 0.8, 0.02, 1, 1.5, [cut(first)])
    two = numpy_screen(rows, 0.8, 0.02, 2, 1.5, [cut(first), cut(one)])
    assert [got["a"], got["b"]] == pytest.approx(two.tolist(), abs=1e-4)
    noisy = screens.linear_screen(panel, ["a", "b"], "t", 0.8, epochs=2, noise=0.05, subsample=0.5, init_top=2, seed=3)
    assert noisy == screens.linear_screen(panel, ["a", "b"], "t", 0.8, epochs=2, noise=0.05, subsample=0.5, init_top=2, seed=3) and noisy != got


def test_matching_weights_bring_bins_together(panel):
    train, test = panel.where("Date < '2024-01-21'"), panel.where("Date >= '2024-01-21' and a > -0.5")
    rows = screens.matching_weights(train, test, ["a", "b"], "ticker", 4, 0.05, 8).collect()
    assert len(rows) == train.count() and np.mean([r.weight for r in rows]) == pytest.approx(1) and min(r.weight for r in rows) > 0
    low = lambda rs, w: sum(w(r) for r in rs if r.a <= -0.5) / sum(w(r) for r in rs)
    assert low(rows, lambda r: r.weight) < 0.5 * low(rows, lambda _: 1)
    assert {r.weight for r in screens.tree_weights(train, test, ["a", "b", "c"], "ticker", match=False).collect()} == {1.0}
    few = screens.matching_weights(train, test, ["a", "b"], "ticker", 4, 0.05, 50, tolerance=1e-9)
    more = screens.matching_weights(train, test, ["a", "b"], "ticker", 4, 0.05, 60)
    weights = lambda rows: {(r.ticker, r.Date): r.weight for r in rows.collect()}
    assert weights(few) == pytest.approx(weights(more), rel=1e-6)
    chosen = screens.matching_features(["MathFeature_Price_Diff1", "a_lag", "Fourier_x", "Fourier_y"], {"Fourier_x": 0.5, "Fourier_y": 0.2}, ["Fourier"], "MathFeature", 1)
    assert chosen == ["Fourier_x"] and screens.matching_features(["MathFeature_Price_Diff1", "b"], {}, ["none"], "MathFeature") == ["MathFeature_Price_Diff1"]
    matched = screens.tree_weights(train, test, ["a", "b", "c"], "ticker", patterns=["a"], keep=1, bins=4, floor=0.05).collect()
    assert low(matched, lambda r: r.weight) < 0.5 * low(matched, lambda _: 1)


class Stub:
    """A model whose prediction is a feature."""

    def transform(self, df):
        return df.withColumn("prediction", F.col("a"))


def test_backtest_and_predictions(panel):
    cuts = [d("2024-01-10"), d("2024-01-17")]
    got = learning.backtest(panel, ["a", "b"], "t", cuts, 5, 2, lambda *_: Stub()).collect()
    want = set()
    for cut in cuts:
        for k in range(1, 6):
            day = cut + dt.timedelta(days=k)
            rows = sorted((r for r in panel.collect() if r.Date == day), key=lambda r: (-r.a, r.ticker))[:2]
            want |= {(str(cut), day, r.ticker, r.a, r.t, i + 1) for i, r in enumerate(rows)}
    assert {tuple(r) for r in got} == want
    picks, per = learning.predict_now(panel.withColumn("t", F.when(F.col("Date") < "2024-01-20", F.col("t"))), ["a", "b"], "t", d("2024-01-20"), 3, 2, fit=lambda *_: Stub())
    assert picks.count() == 6 and {r.n_entries for r in per.collect()} == {2}
    with pytest.raises(ValueError):
        learning.predict_now(panel, ["a"], "t", d("2025-01-01"), 3, fit=lambda *_: Stub())


def test_random_projection_by_hand(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    y = ["red" if r[0] > 0 else "blue" for r in x]
    df = spark.createDataFrame([(k, r.tolist(), c) for k, (r, c) in enumerate(zip(x, y, strict=True))], "id int, v array<double>, y string")
    model = learning.RandomProjection(5, 40, 0.1).fit(df, "v", "y")
    f = model._features(x)
    weights = np.linalg.solve(f.T @ f + 0.1 * np.eye(41), f.T @ np.array([[c == "blue", c == "red"] for c in y], dtype=float))
    assert model.weights == pytest.approx(weights)
    got = {r.id: r.predicted for r in model.predict(df, "v").collect()}
    assert got == {k: ["blue", "red"][j] for k, j in enumerate(np.argmax(f @ weights, axis=1))}


def by_definition(window, factor, cutoff):
    """Detrend, odd extension, spline, smoothing, transform and partial sums of one window."""
    n = len(window)
    x = np.arange(n) / (n - 1)
    line = window[0] * (1 - x) + window[-1] * x
    odd = np.concatenate([window - line, -(window - line)[:-1][::-1]])[:, None]
    fine = fourier.smooth_wrapped(fourier.periodic_spline(odd, factor), max(factor // 4, 1))[:, 0]
    t = -np.pi + 2 * np.pi * np.arange(len(fine)) / len(fine)
    cos = [np.mean(fine * np.cos(k * t)) * (1 if k == 0 else 2) for k in range(cutoff)]
    sin = [np.mean(fine * np.sin(k * t)) * (1 if k == 0 else 2) for k in range(cutoff)]
    at = np.linspace(-np.pi, 0, n)
    sums = [line + sum(cos[j] * np.cos(j * at) + sin[j] * np.sin(j * at) for j in range(k + 1)) for k in range(cutoff)]
    rms = [np.sqrt(np.mean((s - window) ** 2)) for s in (sums[-1], sums[0])]
    return np.array([*np.sign(sin[1:]), *np.hypot(cos[1:], sin[1:]), *rms])


def test_fourier_features_by_definition(spark):
    rng = np.random.default_rng(3)
    close = 20 + np.cumsum(rng.normal(size=70))
    rows = [("A", d("2024-01-01") + dt.timedelta(days=k), *[float(c)] * 5, 1.0, 0.0, 1.0) for k, c in enumerate(close)]
    got = blocks.with_fourier(spark.createDataFrame(rows, schemas.SCHEMAS["bars"]), [1, 2]).orderBy("Date").collect()
    up = close - close.min() + 1
    returns = np.append(np.nan, np.log(np.clip(up[1:] / up[:-1], 1e-5, 1e2)) + 1)
    for m in (1, 2):
        n = 21 * m + 1
        for k, r in enumerate(got):
            for name, values in (("price", close / close[k]), ("ret", returns)):
                found = [r[f"{name}_{kind}_{j}_MH{m}"] for kind in ("sign", "amp") for j in range(1, 5)] + [r[f"{name}_rmse_MH{m}"]]
                if k < n - 1 + (name == "ret"):
                    assert found == [None] * 9
                else:
                    want = by_definition(values[k - n + 1:k + 1], 8, 5)
                    assert found == pytest.approx(want[:-1].tolist(), abs=1e-9) and r[f"{name}_ratio_MH{m}"] == pytest.approx(want[-2] / want[-1])


def test_linear_screen_does_not_depend_on_partitions(panel):
    got = [screens.linear_screen(panel.repartition(n), ["a", "b"], "t", 0.8, epochs=3, noise=0.05, subsample=0.5, seed=3) for n in (1, 4, 16)]
    assert got[0] == pytest.approx(got[1], rel=1e-9) and got[0] == pytest.approx(got[2], rel=1e-9)


def test_keyed_random_numbers(spark):
    df = spark.range(20_000).select("id", exprs.keyed_uniform(["id"], 1).alias("u"), exprs.keyed_normal(["id"], 1).alias("z"))
    r = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.avg("z"), F.stddev("z"), F.corr("u", "z")).first()
    assert 0 < r[0] < 0.001 and 0.999 < r[1] < 1 and abs(r[2] - 0.5) < 0.01 and abs(r[3]) < 0.03 and abs(r[4] - 1) < 0.02 and abs(r[5]) < 0.03


def test_rolling_by_position_in_slices(spark):
    rng = np.random.default_rng(1)
    rows = [(0, f"2024-01-{1 + i // 9:02d}", f"{i % 9}", None if rng.random() < 0.02 else float(rng.normal()), bool(rng.random() < 0.7)) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, Date string, ticker string, x double, on boolean").withColumn("Date", F.to_date("Date"))
    placed, dates = halo.with_positions(df, {"a": F.col("on"), "b": F.lit(True)})
    assert dates.count() == 23 and sorted(r["_pos"] for r in placed.where("k = 1").collect()) == list(range(200))
    hits = [r for r in sorted(rows, key=lambda r: (r[1], r[2])) if r[4]]
    want = []
    for i in range(len(hits)):
        frame = [r[3] for r in hits[i - 4:i + 1]] if i >= 4 else []
        want.append(sum(frame) / 5 if frame and None not in frame else None)
    on = placed.where("k = 0").select("k", F.col("_pos").alias("pos"), "x")
    for size in (5, 7, 50, 1000):
        got = [r.m for r in halo.rolling_mean_by_position(on, ["k"], "pos", "x", 5, "m", size).orderBy("pos").collect()]
        assert [g is None for g in got] == [w is None for w in want] and all(g == pytest.approx(w, abs=1e-12) for g, w in zip(got, want, strict=True) if w is not None)


def test_ridge_path_takes_two_passes_and_equals_single_fits(spark):
    rng = np.random.default_rng(2)
    rows = [(x.tolist(), int(abs(x[0]) > abs(x[1]))) for x in rng.normal(size=(400, 5))]
    df = spark.createDataFrame(rows, "v array<double>, y int")
    train, check = df.limit(300), df.subtract(df.limit(300))
    path = learning.ridge_path(learning.RandomProjection(5), train, "v", "y", [0.1, 10.0])
    for w, ridge in zip(path, (0.1, 10.0), strict=True):
        assert w == pytest.approx(learning.RandomProjection(5, ridge=ridge).fit(train, "v", "y").weights, abs=1e-6)
    best = learning.best_ridge(train, check, "v", "y", 5)
    counts = learning.right_counts(best, path, check, "v", "y")
    assert counts[0][1] == check.count() and counts[0][0] > 0.65 * counts[0][1]
    right = best.predict(check, "v").where("predicted = y").count()
    assert right >= counts[0][0] - 20


def test_backtest_resumes(panel, tmp_path):
    cuts, seen = [learning.Date(2024, 1, 10), learning.Date(2024, 1, 15), learning.Date(2024, 1, 20)], []

    class Model:
        def transform(self, df):
            return df.withColumn("prediction", F.col("a"))

    def fit(train, *_):
        seen.append(1)
        return Model()

    whole = learning.backtest(panel, ["a", "b"], "t", cuts, 5, 2, fit, path=f"{tmp_path}/all").collect()

    def failing(train, *_):
        seen.append(1)
        if len(seen) == 5:
            raise RuntimeError("lost")
        return Model()

    with pytest.raises(RuntimeError, match="lost"):
        learning.backtest(panel, ["a", "b"], "t", cuts, 5, 2, failing, path=f"{tmp_path}/part", at_once=1)
    before = len(seen)
    again = learning.backtest(panel, ["a", "b"], "t", cuts, 5, 2, fit, path=f"{tmp_path}/part", at_once=2)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, whole)) and len(seen) < before + 3
    count = len(seen)
    assert learning.backtest(panel, ["a", "b"], "t", cuts, 5, 2, fit, path=f"{tmp_path}/part").count() == len(whole) and len(seen) == count


def test_default_families_find_columns_of_the_blocks(spark, sf_dir):
    bars = views.bars(spark, sf_dir, "brand")
    p = {"lags": (1, 2), "months": (1,)}
    columns = blocks.mathematical(bars, p).columns
    assert screens.matching_features(columns, {}, [], screens.MATCH_FAMILIES["price_differences"], 50)
    columns = [*columns, *blocks.group_dynamics(bars, p).columns, *blocks.fourier_block(bars, p).columns, *blocks.indicator_block(bars, p).columns,
               *blocks.financial(bars, p, fin_q=views.fin_q(spark, sf_dir), fin_a=views.fin_a(spark, sf_dir)).columns]
    for name, pattern in screens.MATCH_FAMILIES.items():
        assert any(re.search(pattern, c) for c in columns), name
    own = blocks.mathematical(bars, p).dropna()
    middle = own.select(F.expr("date_from_unix_date(cast(percentile(unix_date(Date), 0.5) as int))")).first()[0]
    train, test = own.where(F.col("Date") < F.lit(middle)), own.where(F.col("Date") >= F.lit(middle))
    features = [c for c in own.columns if c not in bars.columns]
    assert screens.tree_weights(train, test, features, "ticker", bins=5).select("weight").distinct().count() > 1


def plain_tree(x, y, depth, least):
    """Predictions of a regression tree whose splits take the most from the variance, level by level."""
    out = np.full(len(y), y.mean())
    best = (1e-12, None)
    if depth:
        for f in range(x.shape[1]):
            for v in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= v
                if min(left.sum(), (~left).sum()) >= least:
                    gain = y.var() - left.mean() * y[left].var() - (~left).mean() * y[~left].var()
                    best = max(best, (gain, (f, v)), key=lambda b: b[0])
    if best[1] is not None:
        left = x[:, best[1][0]] <= best[1][1]
        for part in (left, ~left):
            out[part] = plain_tree(x[part], y[part], depth - 1, least)
    return out


def test_trees_against_plain_python(spark):
    rng = np.random.default_rng(9)
    x = np.stack([rng.integers(0, 7, 300), rng.integers(0, 4, 300), rng.integers(0, 3, 300)], axis=1).astype(float)
    y = np.sin(x[:, 0]) + 0.5 * x[:, 1] * (x[:, 2] > 0) + rng.normal(0, 0.3, 300)
    df = spark.createDataFrame([(k, *map(float, r), float(t)) for k, (r, t) in enumerate(zip(x, y, strict=True))], "k int, a double, b double, c double, t double")
    leaves = sorted((r.n, r.total, r.mean) for r in learning.tree_leaves(df, ["a", "b", "c"], "t", 3, 15).collect())
    own = plain_tree(x, y, 3, 15)
    want = sorted((int((own == m).sum()), float(y[own == m].sum()), float(m)) for m in np.unique(own))
    assert [w[0] for w in want] == [g[0] for g in leaves] and np.allclose(want, leaves)
    model = learning.fit_trees(df, ["a", "b", "c"], "t", rounds=4, depth=2, rate=0.1, least_rows=10)
    total = plain_tree(x, y, 2, 10)
    for _ in range(3):  # further trees follow the gradient of the squared error
        total = total + 0.1 * plain_tree(x, 2 * (y - total), 2, 10)
    got = {r.k: r.prediction_ratio for r in learning.predict(model, df, ["a", "b", "c"]).collect()}
    assert np.allclose([got[k] for k in range(300)], total)
    assert learning.rmse(learning.predict(model, df, ["a", "b", "c"]), "prediction_ratio", "t").first()[0] == pytest.approx(float(np.sqrt(np.mean((total - y) ** 2))))
    top = learning.importances(spark, model, ["a", "b", "c"]).collect()
    assert [r.importance for r in top] == sorted((r.importance for r in top), reverse=True) and sum(r.importance for r in top) == pytest.approx(1) and {r.feature for r in top} == {"a", "b", "c"}
