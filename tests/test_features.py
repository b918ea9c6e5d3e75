import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import tsfeat
from panelwright.functions.names import clean_names, filter_by_suffix, key_columns_first, select_features
from panelwright.operators import features


def test_suffix_rule():
    names = ["a_ts_mean", "a_ts_standard_deviation", "a_ts_large_standard_deviation__r_0.25", "a_ts_large_standard_deviation__r_0.05",
             "a_ts_large_standard_deviation__r_0.3", "a_ts_change_quantiles__ql_0.2", "a_ts_quantile__q_0.8"]
    # __r_0.05 holds __r_0.0, so it stays.
    assert filter_by_suffix(names) == [names[0], names[2], names[3], names[6]]


def test_select_features():
    columns = ["symbol", "revenue", "peRatio", "OverMC_revenue", "adaptiveMC_ev", "x_ts_mean"]
    assert select_features(columns, ["peRatio"], ["revenue", "peRatio"]) == columns[2:]


def test_name_rules(spark):
    df = spark.range(1).select(F.lit(1).alias("b-1"), F.lit(2).alias("b 1"), F.lit(3).alias("reportDate"))
    assert clean_names(df).columns == ["b1", "b1_1", "reportDate"]
    assert key_columns_first(df).columns == ["reportDate", "b-1", "b 1"]


def test_returns_with_zero_previous_price(spark):
    df = spark.createDataFrame([("s", i, p) for i, p in enumerate([2.0, 0.0, 3.0, None, 4.0])], "symbol string, date int, close double")
    got = {r.date: r.price_dev for r in features.price_return(df).collect()}
    assert got == {0: None, 1: -1.0, 2: None, 3: None, 4: None}


def test_denominators(spark):
    df = spark.createDataFrame([(1, 5.0, 0.0, 1.0), (2, 5.0, -1.0, 1.0), (3, 5.0, None, 1.0), (4, -5.0, 10.0, 1.0)], "id int, m double, marketCap double, netDebt double")
    got = {r.id: (r.OverMC_m, r.adaptiveMC_m) for r in features.ev_multiples(features.over_marketcap(df, ["m"]), ["m"]).collect()}
    assert got == {1: (None, 0.2), 2: (None, 0.0), 3: (None, None), 4: (-0.5, None)}


def test_robust_scale_zero_spread_and_cohorts(spark):
    rows = [(c, i, float(i * (c + 1)), 3.0) for c in range(2) for i in range(9)]
    out = features.robust_scale(spark.createDataFrame(rows, "c int, i int, `a.b` double, flat double"), ["a.b", "flat"], ["c"]).toPandas()
    for _, part in out.groupby("c"):
        assert part["a.b"].median() == 0
        assert np.isclose(part["a.b"].quantile(0.75) - part["a.b"].quantile(0.25), 1)
        assert (part["flat"] == 0).all()


def test_orient_and_minmax(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 0.0), (3, -1.0), (4, None)], "id int, x double").withColumn("g", F.lit(1))
    got = {r.id: r.x_sorted for r in features.orient_high_good(df, {"x": "low"}, ["g"]).collect()}
    assert got == {1: -2.0, 2: 0.0, 3: -3.0, 4: None}
    same = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [r.y for r in features.minmax10(same, "x", "y").collect()] == [None, None]


def test_sector_relative_without_sector(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 3.0), (1, None, 9.0)], "c int, sector string, r double")
    got = {r.r: r.sec_r_subavg for r in features.sector_relative(df, "r", ["c"]).collect()}
    assert got == {1.0: -1.0, 3.0: 1.0, 9.0: None}


def test_forward_label_drops_tail(spark):
    df = spark.createDataFrame([("s", date(2020, 1, i + 1), float(p)) for i, p in enumerate([1, 2, 1, 4])], "symbol string, date date, close double")
    got = [(r.future_return, r.target) for r in features.forward_label(df, 2).orderBy("date").collect()]
    assert got == [(0.0, 0), (100.0, 1)]


def test_label_up_keeps_null(spark):
    df = spark.createDataFrame([(0.1,), (0.0,), (None,)], "price_dev double")
    assert [r.label_up for r in features.label_up(df).collect()] == [1, 0, None]


WINDOWS = [
    [1.0, 3.0, 2.0, 5.0, 4.0, 4.0, 6.0, 1.0, 0.0, -2.0, 3.0, 2.0],
    [2.0] * 12,
    [float(i) for i in range(12)],
]


@pytest.fixture(scope="module")
def feature_rows(spark):
    long = [(k, "x", t, v) for k, w in enumerate(WINDOWS) for t, v in enumerate(w)]
    df = spark.createDataFrame(long, "id int, kind string, time int, value double")
    out = features.time_series_features(df.repartition(4), ["id"], fourier=range(7), solver=True, filtered=False)
    return {r["id"]: r.asDict() for r in out.collect()}


def test_moments(feature_rows):
    for k, w in enumerate(WINDOWS):
        x, row = np.array(w), feature_rows[k]
        assert np.isclose(row["mean"], x.mean())
        assert np.isclose(row["variance"], x.var())
        assert np.isclose(row["median"], np.median(x))
        assert np.isclose(row["quantile__q_0.8"], np.quantile(x, 0.8))
        assert row["first_location_of_maximum"] == x.argmax() / 12
        assert row["has_duplicate"] == int(len(set(w)) < 12)


def test_fourier_and_wavelet(feature_rows):
    for k, w in enumerate(WINDOWS):
        spectrum = np.fft.rfft(w)
        for c in range(7):
            assert np.isclose(feature_rows[k][f'fft_coefficient__attr_"real"__coeff_{c}'], spectrum[c].real, atol=1e-9)
            assert np.isclose(feature_rows[k][f'fft_coefficient__attr_"imag"__coeff_{c}'], spectrum[c].imag, atol=1e-9)
        wave = tsfeat.ricker(12, 5)[::-1]
        assert np.isclose(feature_rows[k]["cwt_coefficients__coeff_6__w_5__widths_(2, 5, 10, 20)"], np.convolve(w, wave, mode="same")[6])


def test_partial_autocorrelation_solves_yule_walker(feature_rows):
    x = np.array(WINDOWS[0])
    c = x - x.mean()
    acov = np.array([(c[: 12 - k] * c[k:]).sum() / (12 - k) for k in range(6)])
    for lag in range(1, 6):
        system = np.array([[acov[abs(i - j)] for j in range(lag)] for i in range(lag)])
        want = np.linalg.solve(system, acov[1 : lag + 1])[-1]
        assert np.isclose(feature_rows[0][f"partial_autocorrelation__lag_{lag}"], want)
    assert feature_rows[0]["partial_autocorrelation__lag_6"] is None
    assert feature_rows[1]["partial_autocorrelation__lag_1"] is None


def test_autoregression():
    x = np.zeros((1, 20))
    x[0, :2] = 5, -3
    for i in range(2, 20):
        x[0, i] = 1 + 0.5 * x[0, i - 1] - 0.2 * x[0, i - 2]
    assert np.allclose(tsfeat.ar_coefficients(x, 2, (0, 1, 2))[0], [1, 0.5, -0.2])
    # Twelve points cannot carry order ten.
    assert np.isnan(tsfeat.ar_coefficients(np.array([WINDOWS[0]]))).all()


def test_vectors_equal_the_expressions(spark):
    """The batch program gives what the expressions and the solver give, for whole, short, flat and empty windows."""
    rng = np.random.default_rng(4)
    windows = [rng.standard_normal(12), np.full(12, 0.5), rng.integers(0, 3, 12).astype(float), rng.standard_normal(5), [2.0], [1.0, 3.0], []]
    rows = [(i, "k", [float(v) for v in w]) for i, w in enumerate(windows)]
    df = spark.createDataFrame(rows, "id int, kind string, v array<double>")
    names = features.vector_names(filtered=False)
    got = {r["id"]: r["features"] for r in features.feature_vectors(df, ["id", "kind"], "v", names).collect()}
    want = features.array_features(df.where("size(v) > 0"), ["id", "kind"], "v", solver=True, filtered=False)
    for r in want.collect():
        for name, value in zip(names, got[r["id"]], strict=True):
            if r[name] is None or math.isnan(r[name]):
                assert value is None, (r["id"], name)
            else:
                assert value == pytest.approx(r[name], rel=1e-9, abs=1e-9), (r["id"], name)
    assert got[6] == [None] * len(names)


def test_vector_scaling_takes_either_path(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i % 3 if i % 7 else None, i, [None if rng.random() < 0.2 else float(rng.normal()) for _ in range(70)] + [4.0, None]) for i in range(200)]
    df = spark.createDataFrame(rows, "cohort int, id int, v array<double>")
    plain = features.robust_scale(df.select("cohort", "id", *[df["v"][i].alias(f"c{i}") for i in range(72)]), [f"c{i}" for i in range(72)], ["cohort"])
    want = {r["id"]: [r[f"c{i}"] for i in range(72)] for r in plain.collect()}
    for rows_at_once in (10_000, 40):
        monkeypatch.setattr(features, "COHORT_ROWS", rows_at_once)
        for r in features.robust_scale_vectors(df, "v", 72, ["cohort"]).collect():
            assert r["v"] == [None if v is None else pytest.approx(v, abs=1e-9) for v in want[r["id"]]]


def test_vectors_wide_keep_a_place_for_missing_kinds(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "b", [3.0, None])], "id int, kind string, features array<double>")
    got = {r["id"]: r["features"] for r in features.vectors_wide(df, ["id"], ["a", "b"], 2).collect()}
    assert got == {1: [1.0, 2.0, None, None], 2: [None, None, 3.0, None]}
    long = features.vectors_long(df, ["id"], ["x", "y"]).collect()
    assert [(r["id"], r["name"], r["value"]) for r in sorted(long)] == [(1, "x", 1.0), (1, "y", 2.0), (2, "x", 3.0), (2, "y", None)]
