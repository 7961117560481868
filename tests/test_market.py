"""Market operators on hand-made rows."""

import datetime as dt
import json
import os
import shutil
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.functions import exprs as X
from marketloom.functions import fourier
from marketloom.functions.special import incomplete_beta, student_p
from marketloom.operators import aggregates as A
from marketloom.operators import checks as C
from marketloom.operators import gaps
from marketloom.operators import indicators
from marketloom.operators import joins as J
from marketloom.operators import samples as P
from marketloom.operators import windows as W
from marketloom.plans import blocks, ledger, learning
from marketloom.sources import schemas, stores, vendor
from marketloom.streaming.upsert import latest, upsert_bars


def d(text):
    return dt.date.fromisoformat(text)


def bars(spark, rows):
    """(ticker, date, close, adjclose, volume, dividends, splits)"""
    full = [(t, d(day), c, c, c, c, a, v, x, y) for t, day, c, a, v, x, y in rows]
    return spark.createDataFrame(full, schemas.SCHEMAS["bars"])


def test_asof_before_first_exact_between_and_after_last(spark):
    right = spark.createDataFrame([("A", d("2021-01-01"), 10), ("A", d("2021-01-02"), 20), ("A", d("2021-01-04"), 40)], "ticker string, at date, val int")
    days = ["2020-12-31", "2021-01-01", "2021-01-02", "2021-01-03", "2021-01-04", "2021-01-05"]
    left = spark.createDataFrame([("A", d(x)) for x in days] + [("B", d("2021-01-02"))], "ticker string, Date date")
    got = {(r.ticker, str(r.Date)): r.val for r in J.asof(left, right, right_on="at").collect()}
    assert [got["A", x] for x in days] == [None, 10, 20, 20, 40, 40] and got["B", "2021-01-02"] is None
    after = {(r.ticker, str(r.Date)): r.val for r in J.asof(left, right, right_on="at", forward=True).collect()}
    assert [after["A", x] for x in days] == [10, 10, 20, 40, 40, None]
    exact = {str(r.Date): r.val for r in J.attach(left, right.withColumnRenamed("at", "Date"), ["ticker", "Date"], ["val"]).where("ticker = 'A'").collect()}
    assert [exact[x] for x in days] == [None, 10, 20, None, 40, None]


def test_date_slice_needs_order(spark):
    df = spark.createDataFrame([(d("2021-01-01"),), (d("2021-01-02"),), (d("2021-01-04"),)], "Date date")
    assert P.between_dates(df, "2021-01-02", "2021-01-04").count() == 2
    with pytest.raises(ValueError):
        P.between_dates(df, "2021-01-04", "2021-01-02")


def test_merge_rebuilds_adjusted_closes_and_is_idempotent(spark):
    old = bars(spark, [("A", "2024-01-01", 10.0, 10.0, 1.0, 0.0, 1.0), ("A", "2024-01-02", 11.0, 11.0, None, 1.0, 1.0), ("B", "2024-01-01", 5.0, 4.0, 1.0, 0.0, 1.0)])
    new = bars(spark, [("A", "2024-01-02", 11.0, 10.0, 7.0, 1.0, 1.0), ("A", "2024-01-03", 12.0, 12.0, 8.0, 0.0, 1.0)])
    got = {(r.ticker, str(r.Date)): r for r in J.merge_bars(old, new).collect()}
    factor = (11 - 1) / 11
    assert got["A", "2024-01-02"].Volume == 7.0 and got["B", "2024-01-01"].AdjClose == 4.0
    assert got["A", "2024-01-01"].AdjClose == pytest.approx(10 * factor * (10 / 11 / factor))
    again = J.merge_bars(J.merge_bars(old, new), new)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in got.values()}


def test_split_of_zero_leaves_no_adjusted_close(spark):
    old = bars(spark, [("A", "2024-01-01", 10.0, 10.0, 1.0, 0.0, 0.0)])
    new = bars(spark, [("A", "2024-01-02", 11.0, 11.0, 1.0, 0.0, 1.0)])
    got = {str(r.Date): r.AdjClose for r in J.merge_bars(old, new).collect()}
    assert got == {"2024-01-01": None, "2024-01-02": 11.0}


def test_targets_stay_within_tickers(spark):
    rows = [(t, f"2025-01-0{k + 1}", p + k, p + k, 1.0, 0.0, 1.0) for t, p in (("A", 10.0), ("B", 20.0)) for k in range(4)]
    got = {(r.ticker, str(r.Date)): r for r in W.with_targets(bars(spark, rows), 2).collect()}
    assert [got["A", f"2025-01-0{k}"].target_price for k in (1, 2, 3, 4)] == [12.0, 13.0, None, None]
    assert got["A", "2025-01-02"].target_max_close == 13.0 and got["A", "2025-01-01"].target_max_close is None
    assert got["B", "2025-01-01"].target_ratio == 22.0 / 21.0
    with pytest.raises(ValueError):
        W.with_targets(bars(spark, rows), 2, "median")


def test_no_feature_looks_ahead(spark):
    rng = np.random.default_rng(0)
    rows = [("A", str(d("2020-01-01") + dt.timedelta(days=k)), float(c), float(c) * 0.9, float(v), 0.0, 1.0) for k, (c, v) in enumerate(rng.uniform(10, 20, (80, 2)))]
    whole, cut = bars(spark, rows), bars(spark, rows[:60])
    for build in (lambda b: W.with_drawdowns(b, [1]), indicators.all_indicators, lambda b: W.with_sequence(b, "Close", 4, 3)):
        a = {r.Date: r for r in build(whole).where("Date < '2020-03-01'").collect()}
        b = {r.Date: r for r in build(cut).where("Date < '2020-03-01'").collect()}
        for day in a:
            for x, y in zip(a[day], b[day], strict=True):
                assert x == y or (isinstance(x, float) and x == pytest.approx(y, rel=1e-9, nan_ok=True))


def test_ranks_break_ties_by_ticker(spark):
    df = spark.createDataFrame([("B", d("2024-01-01"), 1.0), ("A", d("2024-01-01"), 1.0), ("C", d("2024-01-01"), 0.5), ("D", d("2024-01-01"), None)], "ticker string, Date date, s double")
    assert [(r.ticker, r["rank"]) for r in W.top_per_date(df, "s", 2).orderBy("rank").collect()] == [("A", 1), ("B", 2)]


def test_between_neighbours(spark):
    train = spark.createDataFrame([("f", float(x)) for x in (1, 3, 5, 10)], "feature string, v double")
    test = spark.createDataFrame([("f", float(x)) for x in (2, 4, 6, 7, 9)], "feature string, v double")
    assert [r.n_between for r in J.between_neighbours(train, test, "v").orderBy("v").collect()] == [0, 1, 1, 3]


def test_gap_coalescing_and_last_rows(spark):
    rows = [("A", d("2023-03-30"), 1.0, "x"), ("A", d("2023-03-31"), 3.0, None), ("A", d("2023-06-30"), 5.0, "y")]
    df = spark.createDataFrame(rows, "ticker string, fiscalDateEnding date, n double, t string")
    got = A.coalesce_gaps(df, ["n"], ["t"], 15).orderBy("fiscalDateEnding").collect()
    assert [(str(r.fiscalDateEnding), r.n, r.t) for r in got] == [("2023-03-30", 2.0, "x"), ("2023-06-30", 5.0, "y")]


def test_weighted_quantile_is_inverted_cdf(spark):
    df = spark.createDataFrame([("f", float(x)) for x in (1, 2, 3, 4, 10)], "feature string, v double")
    got = {r.q: r.v for r in A.weighted_quantiles(df, "v", F.lit(1.0), [0.1, 0.2, 0.5, 1.0]).collect()}
    assert got == {0.1: 1.0, 0.2: 1.0, 0.5: 3.0, 1.0: 10.0}


def test_polynomials_and_p_values(spark):
    x = np.linspace(0, 4, 30)
    rows = [("A", float(a), float(2 - a + 3 * a**2)) for a in x] + [("B", float(a), float(a**3)) for a in x]
    df = spark.createDataFrame(rows, "ticker string, x double, y double")
    got = {r.ticker: r for r in A.polynomial_fit(df, "x", "y", 2).collect()}
    assert got["A"].coef == pytest.approx([3, -1, 2], abs=1e-6) and got["A"].r2 == pytest.approx(1)
    assert {r.ticker: r for r in A.polynomial_fit(df, "x", "y", 3).collect()}["B"].coef == pytest.approx([1, 0, 0, 0], abs=1e-6)
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248) and student_p(0.0, 10) == pytest.approx(1.0)


def test_fourier_kernels(spark):
    n = 64
    t = -np.pi + 2 * np.pi * np.arange(n) / n
    series = np.stack([1.5 + 2 * np.cos(t) - 3 * np.sin(2 * t), np.sin(t) + 0.5 * np.cos(3 * t)], axis=1)
    cos, sin = fourier.coefficients(series)
    assert cos[:4, 0] == pytest.approx([1.5, 2, 0, 0], abs=1e-9) and sin[2, 0] == pytest.approx(-3, abs=1e-9)
    assert sin[1, 1] == pytest.approx(1, abs=1e-9) and cos[3, 1] == pytest.approx(0.5, abs=1e-9)
    x = np.sin(np.arange(40) / 3)
    c, s, residual = fourier.kernels(22)
    got = fourier.window_features(x, 22)
    assert np.isnan(got[:21]).all() and got[30, 4] == pytest.approx(np.hypot(c[1] @ x[9:31], s[1] @ x[9:31]))
    assert got[30, -2] == pytest.approx(np.sqrt(np.mean((residual[-1] @ x[9:31]) ** 2)))
    assert np.abs(residual[-1] @ np.linspace(1, 5, 22)).max() < 1e-9


def test_eligibility(spark):
    days = [d("2004-01-01") + dt.timedelta(days=k) for k in range(21 * 365)]
    long = spark.createDataFrame([("A", x, *[1.0] * 8) for x in days] + [("B", x, *[1.0] * 8) for x in days[-700:]], schemas.SCHEMAS["bars"])
    got = {r.ticker: r.ok for r in C.bars_since(long, 2004, str(days[-1])).collect()}
    assert got == {"A": True, "B": False}
    assert {r.ok for r in C.bars_since(long, 2004, "2026-06-01").collect()} == {False}
    assert {r.ok for r in C.regular_bars(long).collect()} == {False}  # all bars repeat


def test_business_days(spark):
    df = spark.createDataFrame([("A", d("2024-01-01"), 10.0), ("A", d("2024-01-04"), 20.0)], "ticker string, Date date, price double")
    got = {str(r.Date): r.price for r in gaps.fill_business_days(df, noise=False).collect()}
    assert got == {"2024-01-01": 10.0, "2024-01-02": 15.0, "2024-01-03": 15.0, "2024-01-04": 20.0}
    noisy = gaps.fill_business_days(df, seed=3).where("filled").collect()
    assert len(noisy) == 2 and all(r.price > 0 for r in noisy)


def test_ledger(spark):
    trades = spark.createDataFrame([("A", d("2024-01-01"), 10.0, 5.0), ("A", d("2024-01-03"), -10.0, 6.0)], "ticker string, Date date, quantity double, price double")
    prices = bars(spark, [("A", f"2024-01-0{k}", 5.0 + k, 1.0, 1.0, 0.0, 1.0) for k in (1, 2, 3)])
    got = {str(r.Date): (r.cash, r.value) for r in ledger.value(trades, prices, 100.0).collect()}
    assert got["2024-01-02"] == pytest.approx((100 - 50.1, 49.9 + 70)) and got["2024-01-03"][0] == pytest.approx(49.9 + 60 - 0.12)


def test_stores_and_streaming_upsert(spark, tmp_path):
    store = stores.AssetStore(spark, f"{tmp_path}/store", 4)
    first = bars(spark, [("A", "2024-01-01", 10.0, 10.0, 1.0, 0.0, 1.0), ("B", "2024-01-01", 3.0, 3.0, 1.0, 0.0, 1.0)])
    second = bars(spark, [("A", "2024-01-01", 11.0, 11.0, 1.0, 0.0, 1.0), ("A", "2024-01-02", 12.0, 12.0, 1.0, 0.0, 1.0)])
    inbox = f"{tmp_path}/in"
    for rows in (first, second, second):
        rows.coalesce(1).write.mode("append").parquet(inbox)
        upsert_bars(spark, inbox, store, f"{tmp_path}/check")
        got = {(r.ticker, str(r.Date)): r.Close for r in store.load("bars").collect()}
    assert got == {("A", "2024-01-01"): 11.0, ("A", "2024-01-02"): 12.0, ("B", "2024-01-01"): 3.0}
    assert store.exists("bars", "A") and not store.exists("bars", "Z") and store.load("bars", "B").count() == 1
    features = stores.FeatureStore(spark, f"{tmp_path}/features")
    features.write(first, "tree", "g", 2024)
    assert features.read("tree", "g", [2024]).count() == 2
    with pytest.raises(FileNotFoundError):
        features.read("tree", "g", [2023, 2024])
    groups = stores.GroupStore(spark, f"{tmp_path}/groups")
    groups.save(spark.createDataFrame([("g", "A"), ("h", "B")], "group string, ticker string"))
    assert [r.ticker for r in groups.load("g").collect()] == ["A"]


def test_the_later_of_two_files_in_one_batch_wins(spark, tmp_path):
    one = bars(spark, [("A", "2024-01-01", 10.0, 10.0, 1.0, 0.0, 1.0), ("B", "2024-01-01", 1.0, 1.0, 7.0, 0.0, 1.0)])
    two = bars(spark, [("A", "2024-01-01", 20.0, 20.0, 1.0, 0.0, 1.0), ("B", "2024-01-01", 2.0, 2.0, None, 0.0, 1.0)])
    for order in ((one, two), (two, one)):
        home = tempfile.mkdtemp(dir=tmp_path)
        for k, rows in enumerate(order):
            rows.coalesce(1).write.parquet(f"{home}/part{k}")
            os.makedirs(f"{home}/in", exist_ok=True)
            part = next(f for f in os.listdir(f"{home}/part{k}") if f.endswith(".parquet"))
            to = f"{home}/in/{'z' if k == 0 else 'a'}.parquet"  # names against the order of arrival
            shutil.copy(f"{home}/part{k}/{part}", to)
            os.utime(to, (1_700_000_000 + k, 1_700_000_000 + k))
        store = stores.AssetStore(spark, f"{home}/store")
        upsert_bars(spark, f"{home}/in", store, f"{home}/check")
        got = {r.ticker: (r.Close, r.Volume) for r in store.load("bars").collect()}
        assert got == ({"A": (20.0, 1.0), "B": (2.0, 7.0)} if order[0] is one else {"A": (10.0, 1.0), "B": (1.0, 7.0)})
    many = one.withColumn("_order", F.lit(1)).unionByName(two.withColumn("_order", F.lit(2)))
    assert {r.ticker: (r.Close, r.Volume) for r in latest(many.repartition(5)).collect()} == {"A": (20.0, 1.0), "B": (2.0, 7.0)}


def test_a_save_that_breaks_off_leaves_the_old_table(spark, tmp_path, monkeypatch):
    store = stores.AssetStore(spark, f"{tmp_path}/store")
    old = spark.createDataFrame([("A", 1), ("B", 2)], "ticker string, x int")
    assert store.save(old, "t", ("s", 0)) and not store.save(old.limit(0), "t", ("s", 0))
    new = spark.createDataFrame([("A", 9)], "ticker string, x int")

    def killed(*_):
        raise RuntimeError("killed before the swap")

    with monkeypatch.context() as m:
        m.setattr(stores.Manifest, "commit", killed)
        with pytest.raises(RuntimeError, match="killed"):
            store.save(new, "t", ("s", 1))
    assert sorted(map(tuple, store.load("t").collect())) == [("A", 1), ("B", 2)]
    assert store.save(new, "t", ("s", 1)) and not store.save(old, "t", ("s", 1))  # a replay of the batch
    assert sorted(map(tuple, store.load("t").collect())) == [("A", 9), ("B", 2)]
    assert store.vacuum("t") == 2 and store.vacuum("t") == 0
    assert sorted(map(tuple, store.load("t").collect())) == [("A", 9), ("B", 2)]
    manifest = stores.Manifest(spark, f"{tmp_path}/store/t")
    version, content = manifest.read()
    with pytest.raises(RuntimeError, match="changed since"):
        manifest.commit(version - 1, content)


def test_buckets_split_by_size(spark, tmp_path):
    store = stores.AssetStore(spark, f"{tmp_path}/store", bucket_rows=100)
    rows = lambda a, b, x: spark.range(a, b).select(F.concat(F.lit("T"), F.col("id") % 40).alias("ticker"), F.lit(x).alias("x"), "id")
    store.save(rows(0, 60, 0), "t")
    buckets = lambda: stores.Manifest(spark, f"{tmp_path}/store/t").read()[1]["buckets"]
    assert set(buckets()) == {""}
    store.save(rows(0, 1200, 1), "t")
    assert len(buckets()) == 16 and sum(b["rows"] for b in buckets().values() if b) == 1200
    assert store.load("t").groupBy("ticker").count().where("count <> 30").isEmpty() and store.load("t").count() == 1200
    before = buckets()
    store.save(spark.createDataFrame([("T7", 5, 0)], "ticker string, x int, id long"), "t")
    changed = [n for n in before if before[n] != buckets()[n]]
    assert len(changed) == 1 and [tuple(r) for r in store.load("t", "T7").collect()] == [("T7", 5, 0)]
    assert store.load("t").count() == 1171 and store.load("t", "none").isEmpty() and not store.exists("t", "none")
    with pytest.raises(FileNotFoundError):
        store.load("other")


def test_years_of_a_group_are_built_once(spark, tmp_path):
    own = bars(spark, [(t, f"{y}-03-0{k}", float(k), 1.0, 1.0, 0.0, 1.0) for t in "AB" for y in (2020, 2021, 2023) for k in (1, 2)])
    groups = spark.createDataFrame([("g", "A"), ("h", "B"), ("h", "A")], "group string, ticker string")
    calls = []

    def build(df):
        calls.append(df)
        if len(calls) == 3:
            raise ValueError("no features")
        return df.withColumn("f", F.col("Close") * 2)

    assert blocks.yearly_features(own, build, groups, ["g", "h"], [2020, 2021, 2022], str(tmp_path)) == {} and len(calls) == 2
    store = stores.FeatureStore(spark, str(tmp_path))
    assert store.read("tree", "h", [2020, 2021]).count() == 8 and store.read("tree", "g", [2022]).isEmpty()
    failing = lambda df: df.where(F.when(F.year("Date") == 2021, F.raise_error(F.lit("bad year"))).otherwise(True))
    failed = blocks.yearly_features(own, failing, groups, ["g"], [2020, 2021], f"{tmp_path}/x")
    assert ("g", 2021) in failed and "bad year" in failed["g", 2021]


def test_outputs(spark, tmp_path):
    name = f"{tmp_path}/output_prediction_Model_g1_02Jan24_0930.parquet"
    df = spark.createDataFrame([(d("2024-01-01"), "A", 10.0, 1.1)], "date date, ticker string, Close double, prediction_ratio double")
    assert stores.write_result(df, name) and not stores.write_result(df, name)
    rows = bars(spark, [("A", f"2024-01-0{k}", 10.0 + k, 10.0 + k, 1.0, 0.0, 1.0) for k in range(1, 5)])
    assert stores.complete_outputs(spark, str(tmp_path), rows, 2, "g1") and stores.complete_outputs(spark, str(tmp_path), rows, 2, "g1") == []
    found = stores.discover_outputs(spark, str(tmp_path)).collect()
    assert {(r.group, str(r.date), r.time, r.completed) for r in found} == {("g1", "2024-01-02", "0930", False), ("g1", "2024-01-02", "0930", True)}
    (tmp_path / "bad.parquet").write_bytes(b"not parquet")
    schema = df.schema.simpleString()[7:-1].replace(":", " ")
    rows, skipped = stores.read_tolerant(spark, [name, str(tmp_path / "bad.parquet"), str(tmp_path / "none.parquet")], schema)
    told = {r.path.rsplit("/", 1)[1]: r.error for r in skipped.collect()}
    assert rows.count() == 1 and set(told) == {"bad.parquet", "none.parquet"} and all(told.values())
    rows, skipped = stores.read_tolerant(spark, [str(tmp_path / "bad.parquet")], schema)
    assert rows.columns == df.columns and rows.isEmpty() and skipped.count() == 1


def test_vendor_files(spark, tmp_path):
    doc = {"symbol": "A", "annualReports": [{"fiscalDateEnding": "2023-12-31", "ebit": "None"}], "quarterlyReports": [{"fiscalDateEnding": "2023-03-31", "ebit": "5"}] * 2}
    (tmp_path / "income.json").write_text(json.dumps(doc, indent=1))
    got = vendor.read_statements(spark, {"income": str(tmp_path)}, {"income": ["fiscalDateEnding", "ebit"]})
    assert got["income_annual"].count() == 1 and got["income_quarterly"].count() == 2
    assert P.numbers_from_text(got["income_annual"], ["ticker", "fiscalDateEnding"]).first().ebit is None
    lists = spark.createDataFrame([("nyse", ["X"]), ("AMEX", ["Y", "X"]), ("NYSEMKT", []), ("SIX", ["CH001", "US1", "ABC", "D.sw"])], "stockExchange string, stocks array<string>")
    assert {r.ticker for r in vendor.symbol_list(lists).collect()} == {"X", "Y"}
    assert {r.ticker for r in vendor.symbol_list(lists, True).collect()} == {"X", "Y", "CH001", "ABC.SW", "D.sw"}


def test_samples(spark):
    df = spark.createDataFrame([(1.0, float("nan"), 1.0), (2.0, 1.0, None), (3.0, 2e10, 1.0), (4.0, 1.0, 2.0)], "a double, b double, t double")
    assert P.clean_samples(df, ["a", "b"], "t", True).count() == 1 and P.clean_samples(df, ["a", "b"], "t", False).count() == 2
    assert P.feature_names(["x_lag_m1", "Seasonal_a", "FeatureTA_q", "Math_z"], patterns=["TA", "Math"], distance={"Math_z": 2.0}, keep=1) == ["Math_z"]
    got = P.stretch(spark.createDataFrame([([0.4, 0.5, 0.6],), ([0.5, 0.5, 0.5],)], "v array<double>"), "v").collect()
    assert got[0].v == pytest.approx([0, 0.5, 1]) and got[1].v == pytest.approx([0.5] * 3)
    r = spark.createDataFrame([(1.1,)], "r double").select(X.target_unsquash(X.target_squash("r")).alias("r")).first().r
    assert r == pytest.approx(1.1)


def test_random_projection_and_blocks(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("embedding", F.col("label").cast("long").alias("label"))
    train, check = e.randomSplit([0.8, 0.2], 3)
    model = learning.RandomProjection(64, 96).fit(train, "embedding", "label")
    assert model.predict(train, "embedding").where("predicted = label").count() > 0.5 * train.count()
    assert {"category", "financial", "fourier", "indicators", "seasonal"} <= set(blocks.BLOCKS)
    blocks.register_block("twice", lambda b, p=None, **_: b.withColumn("twice", F.col("Close") * 2))
    assert "twice" in blocks.BLOCKS
    assert len(indicators.COLUMNS) == 85 == len(set(indicators.COLUMNS))
