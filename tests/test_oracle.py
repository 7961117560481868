"""Queries against their SQL, run by DuckDB on the same tables."""

import datetime
import decimal
import math
import os

import pytest

import __spark_entry__ as entry

NAMES = ["entry_top_tickers", "w03_differences", "w09_forward_fill", "w11_targets", "w22_band_smooth", "j01_asof", "j02_asof_after_days", "j04_merge_bars", "j12_between",
         "a01_coalesce_gaps", "a11_run_summary", "a13_run_quantiles", "a16_class_rates", "a24_weighted_quantiles", "a29_first_point_line", "p14_stretch", "g05_groups",
         "b02_financial", "b06_seasonal", "b08_group_dynamics", "t04_bollinger", "t39_mfi", "m10_quantile_screen", "l03_value", "x01_fill_business_days", "s04_symbols",
         "t02_recursive", "t19_aroon", "b04_mathematical", "b10_fourier_month", "m07_matching_weights", "m10_best_tails", "st1_upsert_bars", "s08_discover_outputs", "s01_read_statements",
         "a25_distribution_distance", "a26_p_values", "b03_financial_sequence", "b10_fourier", "b12_indicator_block", "b13_indicator_sequence", "b15_panel", "k01_written_order",
         "m05_linear_steps", "m16_completed_outputs", "m17_tree_weights", "s05_asset_store", "s07_feature_store",
         "a28_cubic_fit", "a20_days_per_year", "u02_resplit"]


def cell(v):
    if v is None or isinstance(v, str | bool):
        return repr(v)
    if isinstance(v, decimal.Decimal | int | float):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v) + 0.0:.9g}"
    if isinstance(v, datetime.datetime | datetime.date):
        return str(v)[:10]
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted([cell(r[c]) for c in columns] for r in df.collect())
    found = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted([cell(r[names.index(c)]) for c in columns] for r in found.fetchall())
    assert got == want


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
