"""Physical plans: what must not appear, and what must reach the scan."""

from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelwright.catalog import view_queries
from panelwright.operators import asof, ordered, portfolio, quality, stats
from panelwright.sources import bucketed
from panelwright.sources import tables as stored

QUERIES = entry.queries()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroupsInPandas")


@pytest.mark.parametrize(
    "name",
    ["b4_statement_view", "c2_trade_date_by_symbol", "c3_next_rebalance", "c4_latest_filing", "c5_lagged_snapshots", "c10_panel_asof",
     "d2_liquid_top_fraction", "e10_ts_features", "e12_robust_scale", "e17_ml_dataset", "f3_total_score", "f6_rank_columns",
     "f9_percentile_gate", "f12_topk_eval", "g7_daily_value", "g11_sweep_rebalance", "h1_ts_folds", "h5_assign_windows", "i9_ks_drift",
     "flagship_replay"],
)
def test_no_all_pairs_join_and_no_row_python(name, spark, sf_dir):
    plan = physical(QUERIES[name](spark, sf_dir))
    assert not [word for word in FORBIDDEN if word in plan]


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    df = stored.load_table(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey"], [("l_quantity", ">", 40.0)])
    plan = physical(df)
    assert "GreaterThan(l_quantity,40.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_year_filter_prunes_partitions(spark, tables, tmp_path):
    from panelwright.operators.views import load_years

    path = str(tmp_path / "y")
    stored.write_by_year(tables.price, path)
    plan = physical(load_years(spark.read.parquet(path), 2000, 2000))
    assert "PartitionFilters: [isnotnull(year" in plan


def test_top_k_is_cut_before_the_shuffle(tables):
    plan = physical(ordered.top_per_group(tables.prediction, ["cohort"], [("p0", False), ("id", True)], 5))
    assert plan.count("WindowGroupLimit") == 2


def test_first_per_key_is_partially_aggregated(tables):
    plan = physical(ordered.first_per_key(tables.raw("lineitem"), ["l_orderkey"], [("l_linenumber", True)]))
    assert "partial_min" in plan and "Window" not in plan


def test_trade_dates_need_the_day_only(tables, spark):
    days = asof.trading_days(tables.price)
    assert days.columns == ["date"]
    assert days.count() == days.distinct().count()


def test_rank_fraction_windows_run_inside_range_slices(tables, monkeypatch):
    plans, staged = [], ordered.stage_table
    # The windows are in the plans of the statistics that are staged on the way.
    monkeypatch.setattr(ordered, "stage_table", lambda df, label: plans.append(physical(df)) or staged(df, label))
    plans.append(physical(quality.liquid_top_fraction(tables.prediction, "amount", 0.1, ["cohort"])))
    windows = [line for plan in plans for line in plan.splitlines() if "Window [" in line]
    # Either inside one slice, or over the carry of one row per slice.
    assert windows and all("windowspecdefinition(__slice" in w or "sum(__rows" in w for w in windows)


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    from panelwright import session

    class Fake:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Fake()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())


def test_footer_statistics_read_no_page(spark, sf_dir, monkeypatch):
    """Count, minimum and maximum are the scan's own."""
    seen = []
    kind = type(spark.range(1))
    first = kind.first
    monkeypatch.setattr(kind, "first", lambda df: seen.append(physical(df)) or first(df))
    rows = stored.footer_stats(spark, f"{sf_dir}/orders.parquet", ["o_orderkey"]).collect()
    assert rows[0]["n_rows"] == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert any("PushedAggregation: [COUNT(*), MIN(o_orderkey), MAX(o_orderkey)]" in plan for plan in seen)


def test_drift_of_all_windows_is_one_sort(tables, monkeypatch):
    """The number of range sorts and of rows sorted does not depend on the number of windows."""
    sorts, staged = [], ordered.stage_table
    monkeypatch.setattr(ordered, "stage_table", lambda df, label: sorts.append(df) or staged(df, label))
    cohort = F.col("cohort")
    counts = []
    for n in (1, 6):
        sorts.clear()
        stats.ks_drift_by_window(tables.prediction, cohort < 7986, {w: cohort >= 7984 + w for w in range(n)}, ["p0"]).collect()
        counts.append((len(sorts), sorts[0].count()))
    assert counts[0][0] == counts[1][0] == 1 and counts[0][1] == counts[1][1]


def test_benchmark_scans_days_near_the_ends_only(tables, monkeypatch):
    plans = []
    kind = type(tables.price)
    first = kind.first
    monkeypatch.setattr(kind, "first", lambda df: plans.append(physical(df)) or first(df))
    portfolio.benchmark_return(tables.price, tables.symbol, date(1999, 1, 1), date(2000, 6, 1)).collect()
    assert len(plans) == 1 and "1998-12-22" in plans[0] or "10583" in plans[0]


@pytest.mark.parametrize("small", ["10MB", "-1"])
def test_bucketed_views_meet_without_a_shuffle(tables, spark, small):
    parts = {"income": tables.income, "balance": tables.balance, "price": tables.price, "marketcap": tables.marketcap}
    income, balance, price, cap = bucketed.load_bucketed(spark, [bucketed.save_bucketed(df, name) for name, df in parts.items()])
    income.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    for df in (income.join(balance, ["symbol", "date"]), view_queries.bucketed_changes(price, cap)):
        plan = physical(df)
        assert "Exchange hashpartitioning" not in plan
        if small == "-1":
            assert "Exchange" not in plan and "Bucketed: true" in plan and "SortMergeJoin" in plan
        assert df.count() > 0


def test_bucketed_tables_can_be_replaced(spark, tmp_path):
    """A hot symbol, null symbols, an empty table and a second write in the same place."""
    rows = spark.range(300).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 50 != 1, F.col("id")).alias("symbol"), F.col("id").alias("date"))
    for df in (rows, rows.limit(0), rows.where("date < 7")):
        name = bucketed.save_bucketed(df, "replaced", buckets=3, path=str(tmp_path / "b"))
        (back,) = bucketed.load_bucketed(spark, [name])
        assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    spark.sql("DROP TABLE replaced")
