"""Plans and stores that must not grow faster than their input."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketloom.functions import fourier
from marketloom.operators import joins as J
from marketloom.operators import quantiles
from marketloom.operators import windows as W
from marketloom.plans import blocks
from marketloom.scratch import materialize
from marketloom.sources import stores, views


def test_asof_few_equals_asof_and_leaves_the_left_rows_where_they_are(spark):
    days = spark.createDataFrame([(t, d) for t in "abc" for d in range(1, 9)] + [(None, 3)], "ticker string, Date int")
    rows = [("a", 2, 1.0, "x"), ("a", 5, 7.0, None), ("a", 5, 3.0, "z"), ("b", None, 4.0, "y"), ("b", 9, 5.0, "y"), ("c", 1, None, "y")]
    found = spark.createDataFrame(rows, "ticker string, at int, v double, s string")
    got, want = J.asof_few(days, found, right_on="at"), J.asof(days, found, right_on="at")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_statements_columns_pass_no_shuffle_with_the_bars(spark, sf_dir):
    df = blocks.financial(views.bars(spark, sf_dir), fin_q=views.fin_q(spark, sf_dir), fin_a=views.fin_a(spark, sf_dir))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and not [x for x in dealt if "_q#" in x or "_a#" in x]


def test_tasks_of_bars_grow_with_the_lines(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(views, "TASK_LINES", 100)
    n = -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 100)
    assert views.bars(spark, sf_dir).rdd.getNumPartitions() == n > 8


def test_files_of_a_store_follow_its_rows_and_not_its_buckets(spark, tmp_path):
    store = stores.AssetStore(spark, f"{tmp_path}/store", bucket_rows=4)
    rows = lambda x, some: spark.range(2000).where(some).select(F.concat(F.lit("T"), F.col("id") % 500).alias("ticker"), F.lit(x).alias("x"), "id")
    want = {(f"T{i % 500}", 0, i) for i in range(2000)}
    assert store.save(rows(0, "true"), "t") and {tuple(r) for r in store.load("t").collect()} == want
    content = lambda: stores.Manifest(spark, f"{tmp_path}/store/t").read()[1]
    assert len(content()["buckets"]) == 512 and len(list(tmp_path.rglob("*.parquet"))) <= 8 + 1
    first = next(iter(content()["folders"]))
    for x, some in ((1, "id % 500 < 200"), (2, "id % 500 between 190 and 400")):  # the second leaves less than half of the first folder in use
        assert store.save(rows(x, some), "t")
        new = {int(r.id): r for r in rows(x, some).collect()}
        want = {w for w in want if w[0] not in {r.ticker for r in new.values()}} | {tuple(r) for r in new.values()}
        assert {tuple(r) for r in store.load("t").collect()} == want
        assert sum(b["rows"] for b in content()["buckets"].values() if b) == 2000
    assert first not in content()["folders"]
    assert sorted(tuple(r) for r in store.load("t", "T450").collect()) == sorted(w for w in want if w[0] == "T450")
    assert store.vacuum("t") >= 1 and {tuple(r) for r in store.load("t").collect()} == want


def test_quantiles_shuffle_no_values_beyond_the_wanted_buckets(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003 + 1).cast("double").alias("x"), F.when(F.col("id") % 3 > 0, F.sin("id")).alias("y"))
    plan = quantiles.quantile_table(df, ["x", "y"], [0.1, 0.5])._jdf.queryExecution().optimizedPlan().toString()
    sums = [x for x in plan.splitlines() if "Aggregate [column" in x and ", x#" in x.split("]")[0]]
    assert sums and plan.count("LeftSemi") >= len(sums)  # values are counted behind the choice of buckets only
    x, y = (sorted(v for v in c if v is not None) for c in zip(*df.collect(), strict=True))
    got = {(r["column"], r.q): r.v for r in quantiles.quantile_table(df, ["x", "y"], [0.1, 0.5]).collect()}
    for name, values in (("x", x), ("y", y)):
        assert [got[name, q] for q in (0.1, 0.5)] == pytest.approx(list(np.quantile(values, [0.1, 0.5])))


def test_targets_are_made_once_for_all_results(spark, tmp_path, monkeypatch):
    calls = []
    monkeypatch.setattr(stores, "materialize", lambda df: calls.append(df.columns) or materialize(df))
    days = spark.sql("SELECT 'A' AS ticker, date_add(date'2024-01-01', id) AS Date, 1.0D + id AS Open, 1.0D + id AS Close, 1.0D + id AS AdjClose FROM range(20)".replace("id", "cast(id AS int)"))
    for k, name in enumerate(("01Jan24_0930", "02Jan24_0930")):
        days.select(F.col("Date").alias("date"), "ticker").where(F.dayofmonth("Date") == k + 2).write.parquet(f"{tmp_path}/output_prediction_M_g_{name}.parquet")
    assert len(stores.complete_outputs(spark, str(tmp_path), days, 3, "g")) == 2
    assert calls.count(["ticker", "date", "target_ratio"]) == 1 and len(calls) == 3


def test_residuals_of_windows_equal_those_by_kernels():
    values = np.cumsum(np.random.default_rng(3).normal(size=300)) + 50
    values[140] = np.nan
    for size in (22, 43):
        _, _, residual = fourier.kernels(size)
        got = fourier.window_features(values, size)
        for k, column in ((-1, -2), (0, -1)):
            want = [np.sqrt(np.mean((residual[k] @ values[i - size + 1:i + 1]) ** 2)) for i in range(size - 1, 300)]
            np.testing.assert_allclose(got[size - 1:, column], want, rtol=1e-9)


def test_long_frames_are_put_together_from_shorter_ones(spark):
    rows = [(t, i, None if i in (40, 41) and t == "a" else float(i * 37 % 101)) for t in "ab" for i in range(120)]
    df = spark.createDataFrame(rows, "ticker string, Date int, AdjClose double")
    sizes = [3, 7, 28, 30]
    got = W.with_extremes(df, "AdjClose", sizes, W.by())
    want = got.withColumns({f"{k}{n}": W.rolling(f, "AdjClose", n, W.by()) for n in sizes for k, f in (("high", F.max), ("low", F.min))})
    assert want.where("b.high30 is not null".replace("b.", "")).count() > 100
    for n in sizes:
        assert want.where(f"not (high{n} <=> _high_{n} and low{n} <=> _low_{n})").isEmpty()
    plan = W.with_drawdowns(df, [1, 12])._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe(RowFrame, -20, currentrow$())" in plan and "RowFrame, -251" not in plan


def test_recursions_step_through_many_histories_at_once(spark, monkeypatch):
    from marketloom.operators import indicators

    rng, frames = np.random.default_rng(3), []
    for k, n in enumerate([1, 2, 40, 3, 75, 18, 33, 60]):
        x = rng.integers(1, 9, (n, 4)).astype(float)
        x[rng.random((n, 4)) < 0.1 * (k % 2)] = np.nan  # without a value
        frames += [(f"t{k}", i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)]
    bars = spark.createDataFrame(frames, "ticker string, i int, High double, Low double, Close double, Volume double").select(
        "ticker", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")).alias("Date"), "High", "Low", "Close", "Volume")
    rows = lambda df: {(r.ticker, r.Date): [r[c] for c in indicators.RECURSIVE] for r in df.collect()}
    got = rows(indicators.recursive_indicators(bars))
    assert got == {k: v for n in range(8) for k, v in rows(indicators.recursive_indicators(bars.where(F.col("ticker") == f"t{n}"))).items()}  # one by one
    for t, pdf in bars.toPandas().sort_values("Date").groupby("ticker"):
        for name, x in (("trend_ema_fast", pdf.Close.ewm(span=12, adjust=False).mean()), ("volume_fi", (pdf.Close.diff() * pdf.Volume).ewm(span=13, adjust=False).mean())):
            k = indicators.RECURSIVE.index(name)
            np.testing.assert_allclose([np.nan if got[t, d][k] is None else got[t, d][k] for d in pdf.Date], x.to_numpy(), rtol=1e-12)
    batches = [pa.RecordBatch.from_pandas(b.assign(_row=np.arange(len(b)) + 1), preserve_index=False) for _, b in bars.toPandas().groupby("ticker")]
    monkeypatch.setattr(indicators, "HISTORY_ROWS", 50)
    cut = [b for x in batches for b in (x[:7], x[7:]) if len(b)]  # batches end anywhere
    whole = [t.to_pandas() for t in indicators._histories(iter(cut))]
    assert sum(map(len, whole)) == len(frames) and all(b._row.iloc[0] == 1 for b in whole) and max(b.ticker.nunique() for b in whole) > 1


def test_frames_of_many_histories_equal_windows(spark):
    from marketloom.operators import indicators

    rng, rows = np.random.default_rng(4), []
    for k, n in enumerate([1, 2, 9, 30, 64]):
        for i, x in enumerate(rng.integers(1, 4, n)):
            rows.append((f"t{k}", i, 2.0, 1.0, 1.5, 1.0, None if k == 2 and x == 3 or k == 3 and i < 12 else float(x)))
    df = spark.createDataFrame(rows, "ticker string, Date int, High double, Low double, Close double, Volume double, x double")
    wanted = {f"{kind}_{n}": (kind, "x", n) for kind in ("mean", "sum", "max", "min", "std", "deviation", "since_max", "since_min") for n in (1, 3, 10)}
    found = lambda d: {(r.ticker, r.Date): [np.nan if r[c] is None else r[c] for c in wanted] for r in d.collect()}
    got, want = found(indicators.recursive_indicators(df, carry=True, wanted=wanted)), found(indicators.window_frames(df, wanted))
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-12, nan_ok=True), k


def test_indicator_blocks_go_through_no_long_frame_for_each_row(spark, sf_dir):
    import re

    for build in (blocks.indicator_block, blocks.indicator_sequence):
        plan = build(views.bars(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
        frames = [int(n) for n in re.findall(r"RowFrame, -(\d+), currentrow", plan)]
        assert frames and max(frames) < 20, sorted(frames)


def test_indicator_sequence_collects_the_last_rows_once(spark, sf_dir):
    plan = blocks.indicator_sequence(views.bars(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1


def test_repeats_and_regular_bars_sort_a_ticker_once(spark, sf_dir):
    from marketloom.operators import checks

    for df in (W.with_repeats(views.bars(spark, sf_dir)), checks.regular_bars(views.bars(spark, sf_dir))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "DESC" not in plan and "row_number" not in plan and "unboundedfollowing" not in plan.lower()
    assert views.TASK_LINES <= 100_000  # what a task holds at most
    rows = [("a", d, *[v] * 4, 0.0) for d, v in enumerate([1.0, 2.0, 2.0, 1.0])] + [("b", 0, *[1.0] * 4, 0.0)]
    got = W.with_repeats(spark.createDataFrame(rows, "ticker string, Date int, Open double, High double, Low double, Close double, Volume double")).collect()
    assert [(r.ticker, r.Date) for r in got if r.no_volume] == [("a", 0), ("a", 1)] and [(r.ticker, r.Date) for r in got if r.repeats] == [("a", 0)]


def test_an_upsert_goes_through_no_open_frame_and_sorts_no_paths(spark, tmp_path):
    from marketloom.sources import schemas
    from marketloom.streaming import upsert

    row = lambda t, day, c, a: (t, day, c, c, c, c, a, 1.0, 0.0, 1.0)
    old = spark.createDataFrame([row("A", k, 10.0 + k, 9.0) for k in range(6)], schemas.SCHEMAS["bars"].replace("Date date", "Date int"))
    new = old.where("Date in (2, 4)").withColumn("AdjClose", F.col("Close") * 0.5)
    merged = J.merge_bars(old, new)
    assert "currentrow$(), unboundedfollowing$()" not in merged._jdf.queryExecution().optimizedPlan().toString()
    assert [r.AdjClose for r in merged.orderBy("Date").collect()] == pytest.approx([(10 + k) / 2 for k in range(6)])
    for k, name in enumerate("ba"):
        new.withColumn("Close", F.lit(float(k))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    read = spark.read.parquet(f"{tmp_path}/a", f"{tmp_path}/b").select("*", F.struct(*[F.col(c) for c in upsert.ORDER]).alias("_order"))
    got = upsert.latest(upsert.ranked(read))
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.Date, r.Close, r.AdjClose) for r in got.collect()} == {(2, 1.0, 6.0), (4, 1.0, 7.0)}  # the later file's, whatever its name


def test_tasks_of_a_fit_grow_with_its_rows(spark, tmp_path, monkeypatch):
    from marketloom.plans import learning

    monkeypatch.setattr(learning, "TASK_ROWS", 100)
    df = spark.range(5000).select(F.col("id").cast("double").alias("a"), F.sin("id").alias("b"), (F.col("id") % 7).cast("double").alias("t"), F.lit(1.0).alias("unused"))
    seen = []
    monkeypatch.setattr(learning.GBTRegressor, "fit", lambda self, rows: seen.append(rows))
    learning.fit_trees(df.coalesce(2), ["a", "b"], "t")
    sizes = seen[0].rdd.glom().map(len).collect()
    assert len(sizes) == 50 and max(sizes) <= 150 and sum(sizes) == 5000 and "unused" not in seen[0].columns
    monkeypatch.setattr(learning, "TASK_VALUES", 100)  # two features: 50 rows
    assert learning.training(df, ["a", "b"], "t").rdd.getNumPartitions() == 100


def test_statements_are_one_file_a_company_in_one_folder_and_read_once(spark, sf_dir, tmp_path, monkeypatch):
    from marketloom import queries_learning
    from marketloom.sources import vendor

    monkeypatch.setattr(queries_learning, "new_path", lambda s: f"{tmp_path}/vendor")
    got = queries_learning._statements(spark, sf_dir)
    companies = got.select("ticker").distinct().count()
    files = [f for f in (tmp_path / "vendor").iterdir() if f.name.startswith("part-")]
    assert len(files) == companies > 5 and all(f.is_file() for f in files)
    tables = vendor.read_statements(spark, {"income": f"{tmp_path}/vendor"}, {"income": ["fiscalDateEnding"]})
    assert sum(t.count() for t in tables.values()) == got.count()
    assert not any("json" in p for t in tables.values() for p in t.inputFiles()) and not any(f"{tmp_path}/vendor" in p for t in tables.values() for p in t.inputFiles())


def test_group_dynamics_make_bars_once(spark, sf_dir):
    bars = views.bars(spark, sf_dir)
    df = blocks.group_dynamics(bars)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan and "lineitem" not in plan  # bars are stored, not made again for each of the dates' figures
    two = df.where("index_pct_lag_m2_MH_1 is not null").select("ticker", "Date", "index_pct_lag_m2_MH_1")
    w = W.by()
    at = df.select("ticker", "Date", F.col("index_pct_lag_m1_MH_1").alias("x"))
    want = at.withColumn("y", F.lag("x", 1).over(w)).where("y is not null").select("ticker", "Date", "y")
    assert {tuple(r) for r in two.collect()} == {tuple(r) for r in want.collect()} and two.count() > 0
