"""Queries over learning on tables, and over what is stored between runs.

Training has no SQL form; tests compare its steps with plain arithmetic.  Store queries
write to the scratch folder of the session and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import checks as C
from .operators import joins as J
from .operators import samples as P
from .operators import windows as W
from .plans import blocks as B
from .plans import learning, screens
from .queries import _A, _FEATS, _MINIMA, _OLD_NEW, _PANEL, _PRED, KEY, SQL, _membership, _old_new, _panel, add, full, predictions
from .scratch import materialize, new_path
from .sources import schemas, stores, vendor, views
from .streaming.upsert import upsert_bars

# -- trees, projections, screens -----------------------------------------------------
add("m01_trees", lambda s, d: (lambda p: learning.rmse(learning.predict(learning.fit_trees(p, _FEATS, "target_ratio", stored=True), p, _FEATS), "prediction_ratio", "target_ratio"))(materialize(_panel(s, d))))
add("m03_importances", lambda s, d: learning.importances(s, learning.fit_trees(_panel(s, d), _FEATS, "target_ratio"), _FEATS, 2))
add("m09_leaves", lambda s, d: learning.tree_leaves(_panel(s, d), _FEATS, "target_ratio"))


def _projection(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    return learning.RandomProjection(64).fit(e, "embedding", "label").predict(e, "embedding").select("vec_id", "label", "predicted")


add("m08_random_projection", _projection)


def _screen(s: SparkSession, d: str) -> DataFrame:
    panel = materialize(P.min_max_scale(_panel(s, d), _FEATS))
    weights = screens.reduce_screen(panel, _FEATS, "target_ratio", iterations=2, ratio=0.7, epochs=5, noise=0.01, subsample=0.5, init_top=2, seed=4)
    return screens.hard_mask(panel, panel, weights, 0.9)[0].select(*KEY, "score")


add("m06_linear_screen", _screen)


def _weights(s: SparkSession, d: str) -> DataFrame:
    """M5: weights of the linear screen after some steps, with noise and a part of the rows."""
    panel = P.min_max_scale(_panel(s, d), _FEATS)
    got = screens.linear_screen(panel, _FEATS, "target_ratio", epochs=_STEPS_TAKEN, noise=0.01, subsample=0.5, seed=4)
    return s.createDataFrame(list(got.items()), "feature string, weight double")


def _uniform_sql(*salt: str) -> str:
    text = "concat_ws('|', \"Date\"::VARCHAR, ticker, " + ", ".join(f"'{x}'" for x in salt) + ")"
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5::DOUBLE) / {float(16**13)!r}::DOUBLE)"


def _steps_sql(steps: int, seed: int = 4, noise: float = 0.01, part: float = 0.5, q: float = 0.9, rate: float = 0.02, sharp: float = 1.5) -> str:
    """Scores of the single features, and then step by step threshold, soft mask, gradient and weights."""
    n = range(len(_FEATS))
    scaled = ", ".join(f'("{f}" - min("{f}") OVER ()) / nullif(max("{f}") OVER () - min("{f}") OVER (), 0) AS f{k}' for k, f in enumerate(_FEATS))
    score = " UNION ALL ".join(f'SELECT {k} AS k, avg(m) AS score FROM (SELECT "Date", coalesce(avg(t) FILTER (f{k} > (SELECT quantile_cont(f{k}, {q}) FROM sx)), 0) AS m FROM sx GROUP BY 1)' for k in n)
    out = [f'sx AS MATERIALIZED (SELECT ticker, "Date", {scaled}, target_ratio AS t FROM pn)', f"sc AS ({score})",
           "b AS (SELECT k FROM sc ORDER BY score DESC, k LIMIT 1)",
           "a0 AS (SELECT " + ", ".join(f"CASE WHEN k = {k} THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS a{k}, 0.0::DOUBLE AS m{k}, 0.0::DOUBLE AS v{k}" for k in n) + " FROM b)"]
    w = " + ".join(f"f{k} * a{k}" for k in n)
    for s in range(1, steps + 1):
        normal = f"sqrt(-2 * ln({_uniform_sql(str(seed), str(s), 'noise', 'r')})) * cos(2 * pi() * {_uniform_sql(str(seed), str(s), 'noise', 'a')})"
        out += [
            f"c{s} AS (SELECT quantile_cont({w}, {q}) AS cut FROM sx, a{s - 1})",
            f"s{s} AS (SELECT sx.*, 1 / (1 + exp(-{sharp}::DOUBLE * ({w} - cut))) AS s FROM sx, a{s - 1}, c{s} WHERE {_uniform_sql(str(seed), str(s), 'rows')} < {part})",
            f"p{s} AS MATERIALIZED (SELECT *, greatest(0, least(1, mv)) AS p, CASE WHEN mv > 0 AND mv < 1 THEN s * (1 - s) ELSE 0 END AS d FROM (SELECT *, s + {noise}::DOUBLE * {normal} AS mv FROM s{s}))",
            f'd{s} AS (SELECT "Date", sum(p) AS sn, sum(p * t) AS st FROM p{s} GROUP BY 1 HAVING sum(p) > 0)',
            f"g{s} AS (SELECT " + ", ".join(f'-sum((t - st / sn) / sn * {sharp}::DOUBLE * d * f{k}) / count(DISTINCT "Date") AS g{k}' for k in n) + f' FROM p{s} JOIN d{s} USING ("Date"))',
            f"n{s} AS (SELECT *, " + ", ".join(f"0.9::DOUBLE * m{k} + 0.1::DOUBLE * g{k} AS nm{k}, 0.999::DOUBLE * v{k} + 0.001::DOUBLE * g{k} * g{k} AS nv{k}" for k in n) + f" FROM g{s}, a{s - 1})",
            f"a{s} AS MATERIALIZED (SELECT " + ", ".join(f"a{k} - {rate}::DOUBLE * (nm{k} / {1 - 0.9**s!r}::DOUBLE) / (sqrt(nv{k} / {1 - 0.999**s!r}::DOUBLE) + 1e-8::DOUBLE) AS a{k}, nm{k} AS m{k}, nv{k} AS v{k}" for k in n) + f" FROM n{s})"]
    return ", ".join(out) + ";;" + " UNION ALL ".join(f"SELECT '{f}' AS feature, a{k} AS weight FROM a{steps}" for k, f in enumerate(_FEATS))


_STEPS_TAKEN = 6
add("m05_linear_steps", _weights, f"{_PANEL}, {_steps_sql(_STEPS_TAKEN)}", ("feature",), ["weight"], digits=5)


def _weights_sql(features: list[str], bins: int = 5, floor: float = 0.1, passes: int = 5) -> str:
    """Quantile bins, cells and proportional passes; ``tr``, ``te`` and ``w`` (a weight per cell)."""
    edges = ", ".join(f'quantile_cont("{f}", {k / bins}) AS e{i}_{k}' for i, f in enumerate(features) for k in range(1, bins))
    place = ", ".join(" + ".join(f'("{f}" > e{i}_{k})::INT' for k in range(1, bins)) + f" AS b{i}" for i, f in enumerate(features))
    cells = ", ".join(f"b{i}" for i in range(len(features)))
    out = [f"ed AS (SELECT {edges} FROM tr0)", f"tr AS (SELECT *, {place} FROM tr0, ed)", f"te AS (SELECT *, {place} FROM te0, ed)"]
    out += [f"s{i} AS (SELECT b{i}, count(*) / (SELECT count(*) FROM te) AS sh{i} FROM te GROUP BY 1)" for i in range(len(features))]
    shares = ", ".join(f"coalesce(sh{i}, 0) AS sh{i}" for i in range(len(features)))
    out.append(f"w0 AS (SELECT {', '.join(f'c.b{i}' for i in range(len(features)))}, n, {shares}, sum(n) OVER () AS tot, 1.0::DOUBLE AS w FROM (SELECT {cells}, count(*) AS n FROM tr GROUP BY ALL) c "
               + " ".join(f"LEFT JOIN s{i} ON c.b{i} = s{i}.b{i}" for i in range(len(features))) + ")")
    for k in range(passes * len(features)):
        i = k % len(features)
        out.append(f"w{k + 1} AS (SELECT * REPLACE (greatest(w * sh{i} * tot / sum(n * w) OVER (PARTITION BY b{i}), {floor}::DOUBLE) AS w) FROM w{k})")
    return ", ".join(out) + f", w AS (SELECT {cells}, w / (SELECT sum(n * w) / sum(n) FROM w{k + 1}) AS weight FROM w{k + 1})"


_MATCH = ["Volume", "drawdown_1"]
add("m07_matching_weights", lambda s, d: (lambda p: screens.matching_weights(p.where("year(Date) < 1997"), p.where("year(Date) >= 1997"), _MATCH, "ticker", 5))(_panel(s, d)),
    _PANEL + ', tr0 AS (SELECT * FROM pn WHERE year("Date") < 1997), te0 AS (SELECT * FROM pn WHERE year("Date") >= 1997), ' + _weights_sql(_MATCH)
    + ';;SELECT ticker, "Date", weight FROM tr JOIN w ON tr.b0 = w.b0 AND tr.b1 = w.b1', KEY, ["weight"])
add("m17_tree_weights", lambda s, d: (lambda p: screens.tree_weights(p.where("year(Date) < 1997"), p.where("year(Date) >= 1997"), _FEATS, "ticker", patterns=["drawdown"], keep=1, bins=5, floor=0.1))(_panel(s, d)),
    _PANEL + ', tr0 AS (SELECT * FROM pn WHERE year("Date") < 1997), te0 AS (SELECT * FROM pn WHERE year("Date") >= 1997), ' + _weights_sql(["drawdown_1"])
    + ';;SELECT ticker, "Date", weight FROM tr JOIN w ON tr.b0 = w.b0', KEY, ["weight"])
add("m12_minima_grid", lambda s, d: screens.minima_grid(views.bars(s, d), [5, 10], [20, 40]),
    ", ".join(_MINIMA.replace(";;", "").replace("l AS", f"l{k} AS").replace("10 PRECEDING", f"{k} PRECEDING").replace("10 FOLLOWING", f"{k} FOLLOWING") + f""",
    n{k} AS (SELECT ticker, count(*) FILTER (is_low) AS n, max(i) - max(i) FILTER (is_low) <= {k} AS inside FROM l{k} GROUP BY 1)""" for k in (5, 10)) + ";;"
    + " UNION ALL ".join(f"SELECT {k} AS distance, {m} AS least, count(*) FILTER (n >= {m} AND coalesce(inside, false)) AS tickers FROM n{k}" for k in (5, 10) for m in (20, 40)), ("distance", "least", "tickers"))

# -- backtests and predictions -------------------------------------------------------
add("m14_backtest", lambda s, d: learning.analyse(learning.backtest(_panel(s, d), _FEATS, "target_ratio", learning.cutoffs("1998-06-01", 4, 60), 20, 5, None, 400)))
add("m15_predict_now", lambda s, d: learning.predict_now(materialize(_panel(s, d).withColumn("Close", F.col("Close_lag_m1"))), _FEATS, "target_ratio", learning.Date(1998, 6, 1), 60)[0])
add("u02_resplit", lambda s, d: (lambda b: (lambda x: x[0].withColumn("role", F.lit("train")).unionByName(x[1].withColumn("role", F.lit("test"))))(
    J.resplit(b.where("Date < '1997-01-01'"), b.where("Date >= '1997-01-01'"), "1995-12-31", "1997-06-30", "1993-01-01")))(views.bars(s, d)),
    """SELECT ticker, "Date", CASE WHEN "Date" <= DATE '1995-12-31' THEN 'train' ELSE 'test' END AS role FROM bars WHERE "Date" BETWEEN DATE '1993-01-01' AND DATE '1997-06-30'""", (*KEY, "role"))
_NAMES = ["Category_a", "Close_lag_m1", "FeatureTA_trend_adx", "FinData_quar_ebit", "MathFeature_Price_Diff", "Seasonal_month"]
add("p08_feature_names", lambda s, d: (lambda b: b.select(*KEY, *P.feature_names([*b.columns, *_NAMES], without=("Category", "Seasonal", "lag", "ticker", "Date"), patterns=["Close$", "^Vol"])))(views.bars(s, d)),
    'SELECT ticker, "Date", "Close", "AdjClose", "Volume" FROM bars', KEY, ["Close", "AdjClose", "Volume"])

# -- stores --------------------------------------------------------------------------
_FIELDS = ["fiscalDateEnding", "ebit", "totalRevenue"]
#: Companies whose files one task writes.
TASK_FILES = 100


def _statements(s: SparkSession, d: str) -> DataFrame:
    """Vendor documents, one file a company, written from the statements and read as JSON."""
    report = lambda df, name: df.groupBy("ticker").agg(F.collect_list(F.struct(*[F.col(c).cast("string").alias(c) for c in _FIELDS])).alias(name))
    both = report(views.fin_q(s, d), "quarterlyReports").join(report(views.fin_a(s, d), "annualReports"), "ticker")
    doc = F.to_json(F.struct(F.col("ticker").alias("symbol"), "annualReports", "quarterlyReports"))
    path, docs = new_path(s), materialize(both.select(doc.alias("value")))
    # a file a row in one folder: a task has a fixed number of them and puts them into place itself (else one thread moves all at the end)
    files = docs.repartition(max(1, -(-docs.count() // TASK_FILES))).write.option("maxRecordsPerFile", 1)
    files.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    got = vendor.read_statements(s, {"income": path}, {"income": _FIELDS})
    whole = got["income_quarterly"].withColumn("kind", F.lit("quarter")).unionByName(got["income_annual"].withColumn("kind", F.lit("year")))
    return schemas.typed(P.numbers_from_text(whole, ["ticker", "kind", "fiscalDateEnding"]), ["fiscalDateEnding"])


add("s01_read_statements", _statements, """SELECT ticker, 'quarter' AS kind, "fiscalDateEnding", ebit, "totalRevenue" FROM fin_q UNION ALL SELECT ticker, 'year', "fiscalDateEnding", ebit, "totalRevenue" FROM fin_a""",
    ("ticker", "kind", "fiscalDateEnding"), ["ebit", "totalRevenue"], ctes=("fin_q", "fin_a"), digits=3)


def _asset_store(s: SparkSession, d: str) -> DataFrame:
    store = stores.AssetStore(s, new_path(s), 2000)
    old, new = _old_new(s, d)
    store.save(old, "bars")
    store.save(old.where("ticker % 2 = 0").withColumn("Volume", F.lit(1.0)), "bars")  # replaces the rows of these tickers
    store.save(J.merge_new_over_old(old, new, KEY, schemas.BAR_NUMBERS), "bars")
    known = store.exists("bars", "1") and not store.exists("bars", "none") and store.load("bars", "1").where("ticker <> '1'").isEmpty()
    return store.load("bars").withColumn("known", F.lit(known))


_MERGED = """;;SELECT coalesce(n.ticker, o.ticker) AS ticker, coalesce(n."Date", o."Date") AS "Date", true AS known, coalesce(n."Close", o."Close") AS "Close", coalesce(n."Volume", o."Volume") AS "Volume" FROM n FULL JOIN o ON n.ticker = o.ticker AND n."Date" = o."Date\""""
add("s05_asset_store", _asset_store, _OLD_NEW + _MERGED, (*KEY, "known"), ["Close", "Volume"])


def _group_store(s: SparkSession, d: str) -> DataFrame:
    store = stores.GroupStore(s, new_path(s))
    store.save(_membership(s, d))
    return views.bars(s, d).join(store.load("nas100"), "ticker", "left_semi")


add("s06_group_store", _group_store, 'SELECT * FROM bars WHERE ticker::INT % 4 = 0', KEY, ["Close"])


def _features(s: SparkSession, d: str) -> DataFrame:
    """Features of each (group, year), written and read; a missing year raises."""
    path, years = new_path(s), range(1995, 2002)
    failed = B.yearly_features(views.bars(s, d), lambda b: W.with_drawdowns(b, [1]), _membership(s, d), ["sp500", "nas100"], years, path)
    store, missing = stores.FeatureStore(s, path), False
    try:
        store.read("tree", "sp500", [1992, 2050])
    except FileNotFoundError:
        missing = True
    out = store.read("tree", "sp500", years).unionByName(store.read("tree", "nas100", years))
    return out.withColumn("fine", F.lit(missing and not failed))


_OF = f"SELECT *, ({_A} - {full('max', _A, 21)}) / nullif({full('max', _A, 21)}, 0) AS drawdown_1, year(\"Date\") AS year, true AS fine FROM bars"
add("s07_feature_store", _features, f"f AS ({_OF});;SELECT 'sp500' AS \"group\", * FROM f WHERE ticker::INT % 3 = 0 UNION ALL SELECT 'nas100', * FROM f WHERE ticker::INT % 4 = 0",
    (*KEY, "group", "year", "fine"), ["drawdown_1"])


def _outputs(s: SparkSession, d: str) -> tuple[str, list[str]]:
    """Raw results of two runs, completed with targets; the folder and what was completed."""
    folder = new_path(s)
    p = materialize(predictions(s, d).select(F.col("Date").alias("date"), "ticker", "Close", "prediction_ratio"))
    last = p.agg(F.max("date")).first()[0]
    for name, part in (("01Jan24_0930", p.where("date < '1997-01-01'")), ("01Jul24_1600", p.where("date >= '1997-01-01'")),
                       ("02Jul24_1600", p.withColumn("date", F.date_add("date", 20_000)).where(F.col("date") > last))):  # the third has no targets yet
        stores.write_result(part, f"{folder}/output_prediction_Model_group1_{name}.parquet")
    return folder, stores.complete_outputs(s, folder, views.bars(s, d), 5, "group1")


def _completed(s: SparkSession, d: str) -> DataFrame:
    folder, done = _outputs(s, d)
    s.range(3).select(F.col("id").cast("string")).coalesce(1).write.text(f"{folder}/broken")  # no Parquet: skipped and told
    schema = "date date, ticker string, Close double, prediction_ratio double, target_ratio double"
    rows, skipped = stores.read_tolerant(s, [done[0], f"{folder}/broken", *done[1:]], schema)
    return rows.withColumn("skipped", F.lit(",".join(r["path"].rsplit("/", 1)[1] for r in skipped.collect())))


def _discovered(s: SparkSession, d: str) -> DataFrame:
    """S8 with the number of rows and the mean prediction that each discovered result holds."""
    found = stores.discover_outputs(s, _outputs(s, d)[0])
    own = None
    for r in found.collect():  # one row a result
        one = s.read.parquet(r["path"]).agg(F.count("*").alias("n"), F.avg("prediction_ratio").alias("mean")).withColumn("path", F.lit(r["path"]))
        own = one if own is None else own.unionByName(one)
    return found.join(own, "path")


add("s08_discover_outputs", _discovered, _PRED + """, l AS (SELECT max("Date") AS last FROM pred), o AS (
      SELECT DATE '2024-01-01' AS day0, '0930' AS time, true AS targets, * FROM pred WHERE "Date" < DATE '1997-01-01' UNION ALL SELECT DATE '2024-07-01', '1600', true, * FROM pred WHERE "Date" >= DATE '1997-01-01'
      UNION ALL SELECT DATE '2024-07-02', '1600', false, pred.* FROM pred, l WHERE "Date" + 20000 > last);;
    SELECT 'group1' AS "group", day0 AS date, time, c AS completed, count(*) AS n, avg(prediction_ratio) AS mean FROM o, (SELECT unnest([false, true]) AS c) WHERE targets OR NOT c GROUP BY 2, 3, 4""",
    ("group", "date", "time", "completed", "n"), ["mean"])


def _written_order(s: SparkSession, d: str) -> DataFrame:
    """K1: the place that each row of a written result has within its file, and the rows before the file."""
    path = new_path(s)
    stores.write_result(predictions(s, d).select(F.col("Date").alias("date"), "ticker", "Close"), path)
    rows = s.read.parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    files = rows.groupBy("file").agg(F.count("*").alias("n"))
    before = files.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a file
    return rows.join(before, "file").withColumn("place", F.col("before") + F.col("row") + 1)


add("k01_written_order", _written_order, _PRED + ';;SELECT "Date" AS date, ticker, "Close", row_number() OVER (ORDER BY "Date", ticker) AS place FROM pred', ("date", "ticker", "place"), ["Close"])
add("m16_completed_outputs", _completed, _PRED + ';;SELECT ticker, "Date" AS date, \'broken\' AS skipped, "Close", prediction_ratio, target_ratio FROM pred', ("ticker", "date", "skipped"), ["Close", "prediction_ratio", "target_ratio"])
add("s12_empty_tables", lambda s, d: schemas.empty(s, "bars").unionByName(views.bars(s, d)), "SELECT * FROM bars", KEY, ["Close", "Splits"])


def _upserted(s: SparkSession, d: str) -> DataFrame:
    """ST1: old bars arrive, then newer ones (volumes differ), then a replay of these."""
    inbox, store, checkpoint, b = new_path(s), stores.AssetStore(s, new_path(s), 2000), new_path(s), materialize(views.bars(s, d))
    new = b.where(F.year("Date") >= 1996).withColumns({"Volume": F.when(F.col("Volume") % 2 == 0, F.col("Volume")), "AdjClose": F.col("AdjClose") * 1.5})
    for rows in (b.where(F.year("Date") < 1998), new, new):
        rows.select(*[c.split()[0] for c in schemas.SCHEMAS["bars"].split(", ")]).write.mode("append").parquet(inbox)
        upsert_bars(s, inbox, store, checkpoint)
    return store.load("bars")


add("st1_upsert_bars", _upserted, None, KEY, ["Close", "AdjClose"])
SQL["st1_upsert_bars"] = SQL["j04_merge_bars"].replace('"Close" * 1.1::DOUBLE AS "Close", "AdjClose",', '"Close", "AdjClose" * 1.5::DOUBLE AS "AdjClose",').replace(
    '* REPLACE (CASE WHEN "Volume" % 50 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS "Splits")', "*")

# -- extension points ----------------------------------------------------------------


def _own_block(s: SparkSession, d: str) -> DataFrame:
    B.register_block("range_share", lambda bars, p=None, **_: bars.withColumn("range_share", (F.col("High") - F.col("Low")) / F.col("Close")))
    return B.BLOCKS["range_share"](views.bars(s, d))


add("e01_own_block", _own_block, 'SELECT *, ("High" - "Low") / "Close" AS range_share FROM bars', KEY, ["range_share"])


def _own_group(s: SparkSession, d: str) -> DataFrame:
    C.register_group("both_indexes", lambda: F.col("sp500") & F.col("nas100"))
    table = C.check_table(views.bars(s, d), views.fin_q(s, d), views.fin_a(s, d), views.asset(s, d), "1998-12-05", _membership(s, d))
    return C.generate_groups(table).where(F.col("group").isin("both_indexes", "snp500"))


add("e02_own_group", _own_group, "SELECT 'both_indexes' AS \"group\", ticker FROM asset WHERE ticker::INT % 12 = 0 UNION ALL SELECT 'snp500', ticker FROM asset WHERE ticker::INT % 3 = 0", ("group", "ticker"), ctes=("asset",))
