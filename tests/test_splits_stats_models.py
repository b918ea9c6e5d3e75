from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from panelwright.models import jobs
from panelwright.operators import ordered, splits, stats
from panelwright.plans import validation
from panelwright.session import stage_table


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(103).select("id", (F.lit(103) - F.col("id")).alias("t"))


def test_ts_folds_match_the_library_rule(rows):
    got = {}
    for r in splits.ts_folds(rows, 4, ["t"]).collect():
        got.setdefault((r.fold, r.role), []).append(r.t - 1)
    size = 103 // 5
    for f in range(1, 5):
        start = 103 - (4 - f + 1) * size
        assert sorted(got[(f, "train")]) == list(range(start))
        assert sorted(got[(f, "validation")]) == list(range(start, start + size))


def _expected(n, first, test, step, width):
    out, at, f = {}, first, 1
    while at + test <= n:
        out[(f, "train")] = list(range(0 if width is None else at - width, at))
        out[(f, "test")] = list(range(at, at + test))
        at, f = at + step, f + 1
    return out


@pytest.mark.parametrize("step", [None, 7, 20])
def test_expanding_and_rolling(spark, step):
    df = spark.range(103)
    for got, want in [
        (splits.expanding_folds(df, 30, 12, step, ["id"]), _expected(103, 30, 12, step or 12, None)),
        (splits.rolling_folds(df, 30, 12, step, ["id"]), _expected(103, 30, 12, step or 12, 30)),
    ]:
        found = {}
        for r in got.collect():
            found.setdefault((r.fold, r.role), []).append(r.id)
        assert {k: sorted(v) for k, v in found.items()} == want


def test_too_few_rows_give_no_fold(spark):
    assert splits.expanding_folds(spark.range(10), 30, 12, None, ["id"]).count() == 0


def test_windows_are_half_open_and_need_both_sides(spark):
    windows = splits.walk_forward_windows(spark, date(2020, 1, 1), date(2020, 12, 31), 3, 2, 2)
    assert windows.count() == 4
    df = spark.createDataFrame([(date(2020, 1, 1),), (date(2020, 3, 31),), (date(2020, 4, 1),), (date(2020, 9, 1),)], "date date")
    got = {(r.window, r.role, str(r.date)) for r in splits.assign_windows(df, windows).collect()}
    assert got == {(1, "train", "2020-01-01"), (1, "train", "2020-03-31"), (1, "test", "2020-04-01")}


def test_ks_against_brute_force(spark):
    rng = np.random.default_rng(3)
    a, b = np.round(rng.normal(size=400), 1), np.round(rng.normal(0.4, 1, size=250), 1)
    ref = spark.createDataFrame([(float(v),) for v in a], "x double")
    new = spark.createDataFrame([(float(v),) for v in b], "x double")
    row = stats.ks_drift(ref, new, ["x"]).head()
    at = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= v).mean() - (b <= v).mean()) for v in at)
    assert row.ks_statistic == pytest.approx(want) and row.drifted
    same = stats.ks_drift(ref, ref, ["x"]).head()
    assert same.ks_statistic == 0 and same.p_value == 1 and not same.drifted


@pytest.mark.parametrize("width", [3, 30])
def test_correlations_with_gaps_are_pairwise_at_any_width(spark, width):
    rng = np.random.default_rng(3)
    x = rng.normal(1e6, 1.0, (400, width)) + rng.normal(size=(400, 1))
    gone = rng.random((400, width)) < 0.1
    gone[np.arange(400), np.arange(400) % width] = True  # every row has a gap
    names = [f"c{i}" for i in range(width)]
    frame = pd.DataFrame(np.where(gone, np.nan, x), columns=names)
    df = spark.createDataFrame(frame)
    want = frame.corr()
    rows = stats.correlations(df, names).collect()
    assert len(rows) == width * (width - 1) // 2
    for r in rows:
        assert r["corr"] == pytest.approx(want.loc[r.left, r.right], abs=1e-9)


def test_retrain_directions(spark):
    rows = [(i, m, v) for m, vs in {"rmse": [1, 1, 1, 2, 2, 2], "f1": [0.8, 0.8, 0.8, 0.9, 0.9, 0.9]}.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame([(i, m, float(v)) for i, m, v in rows], "period int, metric string, value double")
    assert {r.metric for r in stats.degradation_alerts(df).collect()} == {"rmse"}
    assert stats.should_retrain(df).head().should_retrain is False
    assert stats.should_retrain(df.where("metric = 'rmse'")).head().should_retrain is True
    assert stats.baseline(df.where("period < 2")).count() == 0


def test_mcnemar_without_disagreement(spark):
    df = spark.createDataFrame([(1, 1, 1), (0, 1, 1)], "y int, a int, b int")
    row = stats.mcnemar(df, "y", ["a", "b"]).head()
    assert row.statistic is None and row.better is None


@pytest.fixture(scope="module")
def learnable(spark):
    return spark.range(600).select(
        "id",
        F.date_add(F.lit(date(2018, 1, 1)), (F.col("id") * 2).cast("int")).alias("date"),
        F.rand(5).alias("x"),
        F.rand(6).alias("noise"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("sector"),
    ).withColumn("copy", F.col("x") * 2).withColumn("y", (F.col("x") > 0.5).cast("double"))


def tree():
    return DecisionTreeClassifier(maxDepth=2, seed=1)


@pytest.mark.parametrize("method", ["f_test", "mutual_info", "tree_importance", "rfe"])
def test_selection_finds_the_signal(learnable, method):
    assert jobs.select(learnable, ["x", "noise", "copy"], "y", method, 1, trees=5) == ["x"]


def test_sector_models_leave_gaps_unscored(learnable):
    fitted = jobs.train_per_sector(learnable, {"a": jobs.SectorConfig(("x", "noise"), tree()), "none": jobs.SectorConfig(("x",), tree())}, "y")
    holed = learnable.withColumn("noise", F.when(F.col("id") % 10 != 0, F.col("noise")))
    out = jobs.predict_per_sector(holed, fitted)
    assert out.count() == 600
    assert out.where("predicted_score IS NOT NULL").count() == out.where("sector = 'a' AND noise IS NOT NULL").count()
    assert out.where("predicted_score IS NOT NULL AND predicted_class != y").count() < 20


def test_stack_learns_and_repeats(learnable):
    first = jobs.held_out(learnable, ["x", "noise"], "y", [tree()], 3, ["id"])
    assert first.count() == 600
    again = jobs.held_out(learnable, ["x", "noise"], "y", [tree()], 3, ["id"])
    assert sorted(r.base0 for r in first.collect()) == sorted(r.base0 for r in again.collect())
    fitted = jobs.stack(learnable, ["x", "noise"], "y", [tree()], folds=2)
    hit = jobs.predict_stack(fitted, learnable).select(F.avg(((F.col("stacked") > 0.5) == (F.col("y") == 1)).cast("int"))).head()[0]
    assert hit > 0.95


def test_blocks_are_the_folds(learnable):
    for rows, folds in [(learnable, 3), (learnable.where("id < 601 AND id % 7 != 0"), 4), (learnable.where("id < 2"), 3)]:
        tagged = splits.ts_folds(rows, folds, ["date", "id"]).select("id", "fold", "role").collect()
        blocks = splits.ts_blocks(rows, folds, ["date", "id"]).select("id", "block").collect()
        want = {(r["id"], f, "train") for r in blocks for f in range(1, folds + 1) if r["block"] < f}
        want |= {(r["id"], r["block"], "validation") for r in blocks if r["block"]}
        assert {(r["id"], r["fold"], r["role"]) for r in tagged} == want


def test_features_are_written_once_for_all_folds(learnable, monkeypatch):
    made = []
    monkeypatch.setattr(jobs, "stage_table", lambda df, label: made.append(df.columns) or stage_table(df, label))
    summary, whole = jobs.cross_validate(learnable, ["x", "noise"], "y", tree(), ["date", "id"], 3)
    assert made == [["__block", "y", "__features"]]
    assert {r["metric"] for r in summary.collect()} >= {"accuracy", "f1"}
    assert jobs.score(whole, learnable, "p").count() == 600
    made.clear()
    jobs.stack(learnable, ["x", "noise"], "y", [tree(), tree()], folds=3)
    assert made == [["__fold", "y", "__features"]]


def test_kept_columns_may_carry_a_feature_s_name(learnable):
    out = jobs.held_out(learnable.withColumn("x", F.col("x").cast("string")), ["x", "noise"], "y", [tree()], 2, ["id"])
    assert out.columns == [*learnable.columns, "base0"] and dict(out.dtypes)["x"] == "string" and out.count() == 600


def test_concurrent_jobs_keep_their_order_and_errors(spark):
    tasks = [lambda i=i: (i, spark.range(i + 1).count()) for i in range(9)]
    assert jobs.concurrently(spark, tasks, 3) == [(i, i + 1) for i in range(9)]
    assert jobs.concurrently(spark, [], 3) == []
    with pytest.raises(ZeroDivisionError):
        jobs.concurrently(spark, [lambda: 1, lambda: 1 // 0], 2)


def test_watched_growth_stops_where_the_newest_rows_no_longer_gain(learnable):
    noisy = learnable.withColumn("y", ((F.col("x") + F.rand(9)) > 1).cast("double"))
    boosted = GBTClassifier(maxIter=25, maxDepth=3, stepSize=0.3, seed=1)
    out = jobs.train_watched(noisy, ["x", "noise"], "y", ["date", "id"], [boosted, RandomForestClassifier(numTrees=3, seed=1)])
    stopped, forest = out.report.orderBy("member").collect()
    assert (forest.kept, forest.n_grown, forest.n_watched) == (3, 600, 0)
    assert stopped.kept < stopped.asked == 25 and (stopped.n_grown, stopped.n_watched) == (480, 120)
    # The same growth without an end, on the same older rows.
    late = splits.time_holdout(noisy, ["date", "id"])
    assert late.where("late").agg(F.min("id")).head()[0] == 480
    vectors = jobs.stage_vectors(late, ["x", "noise"], "y", ["late"], impute=True)
    full = vectors.fit(boosted, ~F.col("late")).stages[-1]
    curve = full.evaluateEachIteration(vectors.rows.where("late"))
    assert stopped.losses == pytest.approx(curve[: stopped.kept]) and stopped.losses[-1] <= curve[-1]
    assert jobs.score_family(out.models, noisy, "p").count() == 600


def test_watched_growth_with_gaps_and_too_few_rows(learnable):
    holed = learnable.withColumn("noise", F.when(F.col("id") % 3 != 0, F.col("noise")))
    few = jobs.train_watched(holed.where("id < 4"), ["x", "noise"], "y", ["date", "id"], [GBTClassifier(maxIter=2, maxDepth=1, seed=1)])
    row = few.report.head()
    assert (row.n_grown, row.n_watched, row.kept, row.losses) == (4, 0, 2, [])
    assert jobs.score_family(few.models, holed, "p").where("p0 IS NOT NULL").count() == 600


def test_members_grow_on_partitions_of_bounded_rows_and_forests_alone(learnable, monkeypatch):
    seen, growing = [], []
    for kind in (GBTClassifier, RandomForestClassifier):

        def watched(self, rows, plain=kind._fit):
            seen.append((type(self).__name__, len(growing), rows.rdd.glom().map(len).collect()))
            growing.append(self)
            model = plain(self, rows)
            growing.remove(self)
            return model

        monkeypatch.setattr(kind, "_fit", watched)
    monkeypatch.setattr(jobs, "FIT_ROWS", 100, raising=False)
    boosted = [GBTClassifier(maxIter=2, maxDepth=d, seed=1) for d in (1, 2)]
    out = jobs.train_watched(learnable, ["x", "noise"], "y", ["date", "id"], [RandomForestClassifier(numTrees=3, seed=1), *boosted])
    assert [(r.member, r.asked, r.n_grown) for r in out.report.orderBy("member").collect()] == [(0, 3, 600), (1, 2, 480), (2, 2, 480)]
    assert all(sum(sizes) == 600 and max(sizes) <= 110 for _, _, sizes in seen)
    assert seen[-1][:2] == ("RandomForestClassifier", 0) and len(seen) == 3


def test_search_is_seeded_and_inside_the_ranges():
    draws = jobs.draw_trials(jobs.SEARCH_SPACE, 20)
    assert draws == jobs.draw_trials(jobs.SEARCH_SPACE, 20)
    assert all(6 <= d["maxDepth"] <= 12 and 0.01 <= d["stepSize"] <= 0.3 for d in draws)


def test_walk_forward_and_robust_run(learnable):
    out = validation.robust_walk_forward(
        learnable, ["x", "noise", "copy"], "y", tree(), date(2018, 1, 1), date(2021, 1, 1), 12, 3, 6, top_k=1, use_cv=True
    )
    assert out.features == ["x"]
    windows = out.results.select("window").distinct().count()
    assert windows >= 3
    assert out.results.where("metric = 'accuracy' AND value < 0.9").count() == 0
    assert out.results.where("train_end > test_start").count() == 0
    assert out.cross_validation.select("window").distinct().count() == windows
    assert out.alerts.count() == 0 and not out.retrain.head().should_retrain


def test_imputing_family_scores_every_row(learnable):
    holed = learnable.withColumn("noise", F.when(F.col("id") % 3 != 0, F.col("noise")))
    fitted = jobs.train_classifiers(holed, ["x", "noise"], "y", jobs.classifier_family(2, (2,), 2))
    out = jobs.score_family(fitted, holed, "p")
    assert out.count() == 600 and out.where("p0 IS NULL OR p1 IS NULL").count() == 0


def test_neighbour_ranges_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """Ranges follow the number of rows, not their bytes: long runs of like rows, which compress to nothing, are split."""
    sizes, staged = [], ordered.stage_table

    def counted(df, label):
        out = staged(df, label)
        if label == "slices":
            sizes.append(max(r["count"] for r in out.groupBy("__slice").count().collect()))
        return out

    monkeypatch.setattr(ordered, "stage_table", counted)
    monkeypatch.setattr(ordered, "SLICE_ROWS", 1_000)
    df = spark.range(20_000).select("id", (F.col("id") % 2).alias("y"), (F.col("id") / 7).alias("x"))
    (row,) = stats.rank_by_neighbour_info(df, ["x"], "y", ["id"], 1).collect()
    assert row["feature"] == "x"
    assert len(sizes) == 2 and max(sizes) < 3_000


def test_neighbour_information_matches_brute_force(spark, monkeypatch):
    """Runs of a few rows, so that most neighbours lie in a halo; ties, gaps, and a class of one row."""
    monkeypatch.setattr(stats, "NEIGHBOUR_ROWS", 7)
    rng = np.random.default_rng(8)
    y = [*(["a"] * 120), *(["b"] * 60), "c", "c", "alone"]
    x = {"tied": rng.integers(0, 20, len(y)) + 5 * (np.array(y) == "b"), "free": rng.normal(size=len(y)) + (np.array(y) == "a"), "noise": rng.normal(size=len(y))}
    rows = [(i, c, *[None if (i + j) % 17 == 0 else float(x[f][i]) for j, f in enumerate(x)]) for i, c in enumerate(y)]
    df = spark.createDataFrame(rows, "id int, y string, tied double, free double, noise double")
    got = {r["feature"]: r["score"] for r in stats.rank_by_neighbour_info(df, list(x), "y", ["id"], 9).collect()}

    def digamma(n):
        return sum(1 / i for i in range(1, n)) - 0.5772156649015329

    for j, f in enumerate(x):
        have = [(r[1], r[2 + j]) for r in rows if r[2 + j] is not None]
        size = {c: sum(a == c for a, _ in have) for c, _ in have}
        have = [(c, v) for c, v in have if size[c] > 1]
        total = 0.0
        for i, (c, v) in enumerate(have):
            near = min(3, size[c] - 1)
            radius = sorted(abs(v - w) for h, (b, w) in enumerate(have) if b == c and h != i)[near - 1]
            inside = sum(abs(v - w) <= radius * (1 - 1e-9) for _, w in have)
            total += digamma(near) - digamma(size[c]) - digamma(inside)
        assert got[f] == pytest.approx(max(0.0, digamma(len(have)) + total / len(have)), abs=1e-9)
