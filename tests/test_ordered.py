"""Order-based building blocks against pandas, with one group holding a third of all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import ordered


@pytest.fixture(scope="module", autouse=True)
def many_slices(spark):
    """Keep small data on several partitions, so carries between ranges are exercised."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(7)
    n = 6000
    group = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 40, n))
    value = np.round(rng.normal(size=n), 2)
    value[rng.random(n) < 0.3] = 1.0  # one value holds a third of the rows
    value[rng.random(n) < 0.05] = np.nan
    return pd.DataFrame({"id": np.arange(n), "g": group, "v": value})


@pytest.fixture(scope="module")
def frame(spark, skewed):
    df = spark.createDataFrame(skewed).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return df.repartition(5)


def test_positions(frame, skewed):
    got = ordered.positions(frame, ["g"], [("v", False), ("id", True)]).toPandas().sort_values("id")
    want = skewed.sort_values(["v", "id"], ascending=[False, True], na_position="last").copy()
    want["pos"] = want.groupby("g").cumcount()
    want = want.sort_values("id")
    assert (got["pos"].to_numpy() == want["pos"].to_numpy()).all()
    assert (got["n"].to_numpy() == want.groupby("g")["id"].transform("size").to_numpy()).all()


def test_positions_whole_table_spread_over_tasks(frame, skewed):
    sliced = ordered.range_slices(frame, [], [("id", True)])
    assert sliced.select("__slice").distinct().count() > 1
    got = ordered.positions(frame, [], [("id", True)], size=None).toPandas()
    assert (got["pos"] == got["id"]).all()


def test_hot_group_is_split(frame):
    parts = ordered.range_slices(frame, ["g"], [("v", True), ("id", True)])
    assert parts.where("g = 0").select("__slice").distinct().count() > 1


def test_value_ranks(frame, skewed):
    got = ordered.value_ranks(frame, ["g"], "v").toPandas().set_index(["g", "v"]).sort_index()
    known = skewed.dropna()
    for (g, v), row in list(got.iterrows())[::7]:
        mine = known[known.g == g].v
        assert row.n_equal == (mine == v).sum()
        assert row.n_above == (mine > v).sum()
        assert row.n_below == (mine < v).sum()


@pytest.mark.parametrize("ascending", [True, False])
def test_tie_counts(spark, frame, skewed, ascending, monkeypatch, request):
    """Ties over many ranges, without a join on the value."""
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.shuffle.partitions", partitions))
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    plans, staged = [], ordered.stage_table
    monkeypatch.setattr(ordered, "stage_table", lambda df, label: plans.append(df) or staged(df, label))
    out = ordered.tie_counts(frame, ["g"], "v", ascending)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in [*plans, out]]
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line]
    assert joins and all("__slice" in line for line in joins)
    got = out.toPandas().sort_values("id")
    spread = ordered.range_slices(frame.withColumn("t", F.xxhash64("id")), ["g"], [("v", ascending), ("t", True)])
    assert spread.where("g = 0 AND v = 1.0").select("__slice").distinct().count() > 1
    by = skewed.groupby("g").v
    low, high = by.rank(method="min", ascending=ascending), by.rank(method="max", ascending=ascending)
    assert np.allclose(got.n_before, low - 1, equal_nan=True)
    assert np.allclose(got.n_equal, high - low + 1, equal_nan=True)


def test_tie_counts_of_one_value(spark):
    df = spark.range(500, numPartitions=4).withColumn("v", F.when(F.col("id") >= 10, F.lit(2.0)))
    rows = ordered.tie_counts(df, [], "v").collect()
    assert {(r["n_before"], r["n_equal"]) for r in rows if r["v"]} == {(0, 490)}
    assert all(r["n_before"] is None and r["n_equal"] is None for r in rows if not r["v"])


def test_bucket_positions_stage_keys_only(spark, frame, skewed, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 300)
    seen, staged = [], ordered.stage_table
    monkeypatch.setattr(ordered, "stage_table", lambda df, label: seen.append(df.columns) or staged(df, label))
    df = frame.withColumn("payload", F.repeat(F.lit("x"), 50))
    got = ordered.bucket_positions(df, ["v", "id"], "pos", "n")
    assert got.columns == [*df.columns, "pos", "n"]
    got = got.toPandas().sort_values("id")
    order = skewed.sort_values(["v", "id"], na_position="last").id.to_numpy()
    want = np.empty(len(order), int)
    want[order] = np.arange(len(order))
    assert (got["pos"].to_numpy() == want).all() and (got["n"] == len(skewed)).all()
    assert not any("payload" in columns for columns in seen)
    assert ordered.bucket_positions(df.limit(0), ["v", "id"], "pos", "n").count() == 0


def test_running_sums(frame, skewed):
    got = ordered.running_sums(frame, ["g"], [("v", True), ("id", True)], {"run": "v"}).toPandas().sort_values("id")
    want = skewed.sort_values(["v", "id"]).copy()
    want["run"] = want.fillna(0).groupby("g")["v"].cumsum()
    assert np.allclose(got["run"], want.sort_values("id")["run"])


def test_exact_percentiles(frame, skewed):
    got = ordered.exact_percentiles(frame, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.92}).toPandas().set_index("g").sort_index()
    want = skewed.dropna().groupby("g")["v"].quantile([0.25, 0.5, 0.92]).unstack()
    assert np.allclose(got[["a", "b", "c"]], want)


# Brackets of no width miss most targets: their groups are opened.
@pytest.mark.parametrize("accuracy, errors", [(200, 2), (200, 5), (20, 0), (10_000, 0)])
def test_sketch_brackets_keep_positions_exact(frame, skewed, monkeypatch, accuracy, errors):
    monkeypatch.setattr(ordered, "SKETCH_ACCURACY", accuracy)
    monkeypatch.setattr(ordered, "BRACKET_ERRORS", errors)
    probs = {"z": 0.0, "a": 0.25, "b": 0.27, "c": 0.92, "d": 1.0}
    got = ordered.exact_percentiles(frame, ["g"], "v", probs).toPandas().set_index("g").sort_index()
    want = skewed.dropna().groupby("g")["v"].quantile(list(probs.values())).unstack()
    assert np.allclose(got[list(probs)], want)
    whole = ordered.exact_percentiles(frame.withColumn("v", F.col("v") * 1000 + F.col("id") / 7), [], "v", probs).head()
    flat = (skewed.v * 1000 + skewed.id / 7).dropna().quantile(list(probs.values()))
    assert np.allclose(list(whole), flat)


@pytest.mark.parametrize("group", [[], ["g"]])
def test_missed_brackets_are_opened(frame, skewed, monkeypatch, group):
    """Brackets drawn around the wrong fraction: the counts show it, and only those groups are read again."""
    monkeypatch.setattr(ordered, "SKETCH_ACCURACY", 100)
    monkeypatch.setattr(ordered, "BRACKET_ERRORS", 1)
    labels, staged = [], ordered.stage_table
    monkeypatch.setattr(ordered, "stage_table", lambda df, label: labels.append(label) or staged(df, label))
    middle = {"mid": F.floor(F.col("__n") / 2)}
    for fraction, reads in ((0.5, 1), (0.01, 2)):
        labels.clear()
        rows = ordered.order_statistics(frame.withColumn("w", F.col("id") * 1.0), group, "w", middle, [fraction]).collect()
        assert labels.count("brackets") == reads
        for r in rows:
            own = np.sort(skewed.id[skewed.g == r["g"]] if group else skewed.id)
            assert r["mid"] == own[len(own) // 2]


def test_percentiles_of_one_group_of_many_rows(spark, duck):
    lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").select("l_extendedprice")
    probs = {"a": 0.001, "b": 0.25, "c": 0.5, "d": 0.8, "e": 0.999}
    got = ordered.exact_percentiles(lines, [], "l_extendedprice", probs).head()
    sql = ", ".join(f"quantile_cont(l_extendedprice::DOUBLE, {p})" for p in probs.values())
    want = duck.execute(f"SELECT {sql} FROM '/root/testdata/sf0.1/lineitem.parquet'").fetchone()
    assert np.allclose([float(x) for x in got], want)


def test_first_per_key_orders_and_nulls(spark):
    df = spark.createDataFrame(
        [(1, 5, "x"), (1, None, "y"), (1, 7, "z"), (2, None, "q"), (None, 1, "n")], "k int, o int, v string"
    )
    up = {r.k: r.v for r in ordered.first_per_key(df, ["k"], [("o", True)]).collect()}
    down = {r.k: r.v for r in ordered.first_per_key(df, ["k"], [("o", False)]).collect()}
    assert up == {1: "x", 2: "q", None: "n"}
    assert down == {1: "z", 2: "q", None: "n"}


def test_top_per_group_above_the_limit_threshold(frame, skewed):
    order = [("v", False), ("id", True)]
    got = ordered.top_per_group(frame, ["g"], order, 1500).toPandas()
    assert len(got) == skewed.groupby("g").size().clip(upper=1500).sum()
    few = ordered.top_per_group(frame, ["g"], order, 4).toPandas()
    both = few.merge(got, on="id", suffixes=("", "_big"))
    assert len(both) == len(few) and (both.rn == both.rn_big).all()


def test_empty_input(spark):
    empty = spark.createDataFrame([], "g int, v double, id long")
    assert ordered.positions(empty, ["g"], [("v", True)]).count() == 0
    assert ordered.exact_percentiles(empty, ["g"], "v", {"m": 0.5}).count() == 0
