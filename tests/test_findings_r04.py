"""What the findings of round 4 asked for."""

import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marketloom import scratch
from marketloom.operators import indicators
from marketloom.operators import windows as W
from marketloom.plans import blocks, learning, screens
from marketloom.sources import stores, views
from marketloom.streaming import upsert
from tests.test_oracle import cell


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def shuffles(df):
    """Exchanges of a plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("name", ["t41_bar_columns"])
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted([cell(r[c]) for c in columns] for r in df.collect())
    found = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert got == sorted([cell(r[names.index(c)]) for c in columns] for r in found.fetchall())


def test_fourier_lags_need_no_further_shuffle(spark, sf_dir):
    bars = views.bars(spark, sf_dir).where(F.col("ticker").isin("1", "2", "3"))
    got = blocks.fourier_block(bars, {"months": (1, 2), "lags": (1, 30, 400)})
    assert shuffles(got) == shuffles(bars)
    names = [f"{x}_{k}_MH{m}" for m in (1, 2) for x in ("price", "ret") for k in ("rmse", "amp_1", "amp_4")]
    seen = [F.count(f"price_rmse_MH2_lag_m{n}").alias(f"n{n}") for n in (1, 30, 400)]
    assert min(got.agg(*seen).first()) > 100
    pairs = [f"{c}_lag_m{n}" for c in names for n in (1, 30, 400)]
    windows = W.with_lags(got.select("ticker", "Date", *names), names, (1, 30, 400)).select("ticker", "Date", *pairs)
    assert windows.exceptAll(got.select("ticker", "Date", *pairs)).isEmpty()


def test_indicator_lags_need_no_further_shuffle(spark, sf_dir):
    bars = views.bars(spark, sf_dir).where(F.col("ticker").isin("4", "5"))
    got, lags = blocks.indicator_block(bars, {"lags": (1, 60)}), [1, 60]
    assert shuffles(got) == shuffles(bars)
    names = [f"FeatureTA_{c}{x}" for c in indicators.COLUMNS for x in ("", "_lag_m1", "_lag_m60")]
    rows = lambda df: {(r.ticker, r.Date): [r[c] for c in names] for r in df.collect()}
    want = rows(indicators.scaled_columns(indicators.preprocess(indicators.window_indicators(
        indicators.recursive_indicators(bars, carry=True))), lags, indicators.COLUMNS))
    found = rows(got)
    assert set(found) == set(want) and len(want) > 800
    for k in want:
        assert found[k] == [None if x is None else pytest.approx(x, rel=1e-9, abs=1e-9) for x in want[k]]


def test_best_tails_compute_no_other_tail(spark):
    rows = [(str(k % 40), k // 40, float(k * 37 % 1009), float(k * 17 % 13)) for k in range(4000)]
    df = spark.createDataFrame(rows, "ticker string, n int, x double, t double").withColumn("Date", F.expr("date_add(date'2024-01-01', n)"))
    levels, most = [0.05, 0.1, 0.9, 0.95], [0.05, 0.1]
    only = screens.tails_within(levels, most)
    assert sorted(only) == [(0.05, "lower"), (0.1, "lower"), (0.9, "upper"), (0.95, "upper")]
    whole, part = (screens.quantile_screen(df, ["x"], "t", levels, rows=20, only=o) for o in (None, only))
    assert whole.count() == 8 and part.count() == 4
    assert part.exceptAll(whole).isEmpty()
    found = lambda screen: sorted(map(tuple, screens.best_tails(screen, most).collect()))
    assert found(part) == found(whole) and all(s > 0 for _, _, s in found(part))


def test_trees_of_cells_are_those_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 7, 400), rng.integers(0, 4, 400), rng.integers(0, 3, 400)], axis=1).astype(float)
    y = np.sin(x[:, 0]) + 0.5 * x[:, 1] * (x[:, 2] > 0) + rng.normal(0, 0.3, 400)
    df = spark.createDataFrame([(k, *map(float, r), float(t)) for k, (r, t) in enumerate(zip(x, y, strict=True))], "k int, a double, b double, c double, t double")
    df = df.unionByName(spark.createDataFrame([(400, None, 1.0, 1.0, 9.0)], df.schema)).coalesce(2)
    found, seen, fit = [], [], learning.GBTRegressor.fit
    monkeypatch.setattr(learning.GBTRegressor, "fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    for most in (10**9, 100):
        monkeypatch.setattr(learning, "CELL_ROWS", most)
        model = learning.fit_trees(df, ["a", "b", "c"], "t", rounds=4, depth=3, rate=0.1, least_rows=12)
        rows = learning.predict(model, df, ["a", "b", "c"]).orderBy("k").collect()
        found.append(([r.k for r in rows], [r.prediction_ratio for r in rows], [tuple(r) for r in learning.importances(spark, model, ["a", "b", "c"]).collect()]))
    assert seen[0] == 400 and seen[1] == len({tuple(r) for r in x}) < 100
    assert found[0][0] == found[1][0] == list(range(400)) and found[1][1] == pytest.approx(found[0][1], rel=1e-9)
    assert [f for f, _ in found[0][2]] == [f for f, _ in found[1][2]] and [g for _, g in found[1][2]] == pytest.approx([g for _, g in found[0][2]], rel=1e-6)


def test_batches_leave_no_scratch_tables(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "new_path", lambda s: f"{tmp_path}/scratch/{uuid.uuid4().hex}")
    bars = views.bars(spark, sf_dir).where(F.col("ticker").isin("1", "2"))
    store = stores.AssetStore(spark, f"{tmp_path}/store")
    for k in (1.0, 2.0):
        bars.withColumn("Open", F.col("Open") * k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/inbox")
        upsert.upsert_bars(spark, f"{tmp_path}/inbox", store, f"{tmp_path}/checkpoint")
    assert store.load("bars").count() == bars.count()
    kept = [spark.read.parquet(str(x)).columns for x in (tmp_path / "scratch").iterdir()]
    assert not any("Close" in c for c in kept), kept  # only tickers and files
