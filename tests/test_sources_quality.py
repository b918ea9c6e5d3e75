import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.operators import quality, views
from panelwright.sources import landing, tables
from panelwright.streaming.ingest import incremental_ingest

SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("close", T.DoubleType())])


def test_read_landing_mixes_formats_and_skips_broken_files(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([("a", 1.0)], SCHEMA).write.parquet(f"{root}/p")
    spark.createDataFrame([("b", 2.0)], SCHEMA).write.option("header", "true").csv(f"{root}/c")
    with open(f"{root}/broken.parquet", "wb") as f:
        f.write(b"PAR1 this is no parquet file PAR1")
    got = sorted((r.symbol, r.close) for r in landing.read_landing(spark, root, SCHEMA).collect())
    assert got == [("a", 1.0), ("b", 2.0)]
    lost = {r.path.removeprefix("file:"): r.bytes for r in landing.skipped_files(spark, root, SCHEMA).collect()}
    assert lost.pop(f"{root}/broken.parquet") == 33
    # A writer leaves a file without rows for an empty first task; no file with rows is listed.
    with_rows = {r[0].removeprefix("file:") for r in spark.read.parquet(f"{root}/p").select("_metadata.file_path").collect()}
    with_rows |= {r[0].removeprefix("file:") for r in spark.read.option("header", "true").csv(f"{root}/c").select("_metadata.file_path").collect()}
    assert len(with_rows) == 2 and not with_rows & set(lost)


def test_incremental_ingest_takes_only_new_files(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    spark.createDataFrame([("a", 1.0)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    assert incremental_ingest(spark, src, out, state, SCHEMA).count() == 1
    assert incremental_ingest(spark, src, out, state, SCHEMA).count() == 1
    spark.createDataFrame([("b", 2.0), ("c", 3.0)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    assert incremental_ingest(spark, src, out, state, SCHEMA).count() == 3


def test_flatten_json_levels(spark):
    text = '[{"s": "x", "rows": [{"d": 1, "sub": [{"v": 5}, {"v": 6}]}]}, {"s": "y", "rows": []}]'
    schema = "array<struct<s: string, rows: array<struct<d: int, sub: array<struct<v: int>>>>>>"
    df = spark.createDataFrame([(text,)], "js string")
    once = landing.flatten_json(df, "js", schema)
    assert once.columns == ["s", "d", "sub"] and once.count() == 2
    full = landing.flatten_json(df, "js", schema, expand_all=True)
    assert sorted((r.s, r.d, r.v) for r in full.where("v IS NOT NULL").collect()) == [("x", 1, 5), ("x", 1, 6)]


def test_coerce_types_nan_and_text(spark):
    df = spark.createDataFrame([("", "NaN"), ("x", "1e3"), ("y", "oops")], "name string, dcf string")
    assert [tuple(r) for r in landing.coerce_types(df).collect()] == [(None, None), ("x", 1000.0), ("y", None)]


@pytest.mark.parametrize("mode, n", [("year", 4), ("quarter", 16), ("period", 16), ("from_to", 4), ("date", 2 * 731), ("page", 16), (None, 2)])
def test_manifest_modes(spark, mode, n):
    symbols = spark.createDataFrame([("a",), ("b",), (None,)], "symbol string")
    none = spark.createDataFrame([], "symbol string, postfix string")
    all_of_them = landing.fetch_manifest(symbols, none, mode, 2019, 2020)
    assert all_of_them.count() == n
    done = all_of_them.where("symbol = 'a'").select("symbol", "postfix")
    assert landing.fetch_manifest(symbols, done, mode, 2019, 2020).count() == n // 2


def test_stale_bound_is_included(spark):
    rows = spark.createDataFrame([("a", "2020-01-01"), ("b", "2020-01-02")], "symbol string, date string").withColumn("date", F.to_date("date"))
    active = spark.createDataFrame([("a",), ("b",), ("c",)], "symbol string")
    got = {r.symbol for r in landing.stale_symbols(rows, active, F.lit("2020-03-16").cast("date")).collect()}
    assert got == {"a", "c"}


def test_quarantine_splits_everything(tables):
    good, bad, retry = landing.quarantine(tables.payload, "payload")
    assert good.count() + bad.count() == tables.payload.count()
    assert retry.agg(F.sum("n_bad")).head()[0] == bad.count()


def test_save_validate_load(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(300).select((F.col("id") % 3).alias("k"), "id")
    found = tables.save_table(df, path, "gzip", sample_path=path + "-s", validate=lambda w: quality.validate_table(w, "t", quality.Rules(min_rows=1000)))
    assert {r.check for r in found.where("severity = 'warning'").collect()} == {"min_rows"}
    assert spark.read.option("header", True).csv(path + "-s").count() == 100
    assert tables.save_table(df, path + "p", partition_cols=["k"], validate=lambda w: w) is None
    assert sorted(d for d in os.listdir(path + "p") if d.startswith("k=")) == ["k=0", "k=1", "k=2"]
    assert tables.load_table(spark, path + "p", ["id"], [("k", "not in", [0, 1]), ("id", "<=", 10)]).count() == 3
    with pytest.raises(ValueError):
        tables.save_table(df, path, "lzo")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.load_table(spark, path + "-none").count()
    info = tables.table_info(spark, path)
    assert [(r.column, r.type) for r in info.orderBy("position").collect()] == [("k", "bigint"), ("id", "bigint")]
    assert {r.table for r in tables.list_tables(spark, str(tmp_path)).collect()} == {"t", "tp"}


def test_build_missing_builds_once(spark, tmp_path):
    calls = []

    def build(missing):
        calls.append(sorted(r.k for r in missing.collect()))
        return missing.withColumn("v", F.col("k") * 10)

    path = str(tmp_path / "b")
    for upto in (2, 4):
        out = tables.build_missing(spark.range(upto).select(F.col("id").cast("int").alias("k")), "k", path, build)
    assert calls == [[0, 1], [2, 3]]
    assert sorted(r.v for r in out.collect()) == [0, 10, 20, 30]


def test_coalesce_suffixes(spark):
    df = spark.createDataFrame([(1, None, 2, 3, 4, 5)], "k int, a_x int, a_y int, b_x int, c_x_y int, d_y int")
    out = views.coalesce_suffixes(df)
    assert out.columns == ["k", "a", "b", "d_y"] and tuple(out.head()) == (1, 2, 3, 5)


def test_filing_date_of_cash_flow_wins(spark):
    part = lambda d, c: spark.createDataFrame([("s", 1, d, 1)], f"symbol string, date int, fillingDate int, {c} int")
    row = views.statement_view(part(1, "i"), part(2, "b"), part(3, "c")).head()
    assert row.fillingDate == 3 and (row.i, row.b, row.c) == (1, 1, 1)


def test_row_and_column_pruning(spark):
    df = spark.createDataFrame([(i, None if i < 9 else 1.0, "same", float(i)) for i in range(10)], "id int, sparse double, flat string, x double")
    assert quality.drop_sparse_columns(df)[1] == ["sparse"]
    assert set(quality.drop_constant_columns(df, 0.85)[1]) == {"sparse", "flat"}
    assert quality.drop_sparse_rows(df, 0.25, ["sparse", "x", "id"]).count() == 1
    assert quality.complete_cases(df, ["sparse", "x"]).count() == 1


def test_finite_columns(spark):
    df = spark.createDataFrame([(1.0, float("inf"), 1.0), (2.0, 1.0, float("nan"))], "a double, b double, c double")
    assert {r.column: r.is_finite for r in quality.finite_columns(df, ["a", "b", "c"]).collect()} == {"a": True, "b": False, "c": False}


def test_liquid_fraction_keeps_ties(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([5, 4, 4, 3, 2, 1, 1, 1, 1, 1] * 2)], "as_of int, symbol int, v int")
    assert sorted(r.v for r in quality.liquid_top_fraction(df, "v", 0.2).collect()) == [4, 4, 4, 4, 5, 5]


def test_validation_of_wrong_types(spark):
    df = spark.createDataFrame([("a", "2020-01-01")], "symbol string, date string")
    checks = {r.check for r in quality.validate_table(df, "price").where("severity = 'error'").collect()}
    assert checks == {"required", "date_type"}
    report = quality.validation_report(quality.validate_table(df, "price")).head()
    assert report.status == "failed" and report.n_passed == 0


def test_symbol_master_variants(spark):
    listed = spark.createDataFrame([("a", "NYSE", "stock"), ("b", "NYSE", "etf")], "symbol string, exchangeShortName string, type string")
    gone = spark.createDataFrame([("a", "NYSE", None, "2020-01-01")], "symbol string, exchangeShortName string, ipoDate string, delistedDate string")
    profile = spark.createDataFrame([("a", "NYSE", "1999-01-01", "Steel")], "symbol string, exchangeShortName string, ipoDate string, industry string")
    first = {r.symbol: r.delistedDate for r in views.symbol_master(listed, gone, profile).collect()}
    last = {r.symbol: str(r.delistedDate) for r in views.symbol_master(listed, gone, profile, kind="stock", keep="last").collect()}
    assert first == {"a": None, "b": None}
    assert last == {"a": "2020-01-01"}


def test_heavy_values_are_found_by_one_sketch(spark, monkeypatch):
    """One value among many distinct ones, in every part of the table, and no cell value in an exchange."""
    df = spark.range(20_000, numPartitions=8).selectExpr(
        "if(id % 100 < 13, 'often', concat('x', id)) AS a", "if(id % 2 = 0, NULL, id) AS `b.c`", "id AS d", "if(id < 19000, 1.5, id) AS e", "id % 8 AS f"
    )
    plans, staged = [], quality.stage_table
    monkeypatch.setattr(quality, "stage_table", lambda x, label: plans.append(x._jdf.queryExecution().executedPlan().toString()) or staged(x, label))
    out = quality.heavy_value_shares(df)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert {r["column"]: r["top_share"] for r in out.collect()} == {"a": 0.13, "b.c": 0.5, "d": None, "e": 0.95, "f": 0.125}
    exchanges = [line for plan in plans for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and all("SinglePartition" in line for line in exchanges)
    assert quality.drop_constant_columns(df, 0.9)[1] == ["e"]
    assert quality.heavy_value_shares(df.limit(0)).where("top_share IS NOT NULL").count() == 0
