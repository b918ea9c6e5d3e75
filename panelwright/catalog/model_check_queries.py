"""Model jobs on features whose fitted trees SQL can state: means per cell, planted and constant columns."""

from __future__ import annotations

import json
from datetime import date as Date

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from panelwright.catalog.model_queries import _SPLIT, learnable
from panelwright.catalog.ranking_queries import EVAL_COLUMNS, EVALUATED, PREDICTED_SQL, VARIANTS, topk_sql
from panelwright.catalog.registry import query
from panelwright.models import jobs
from panelwright.operators import ranking, splits
from panelwright.plans import evaluation, training, validation
from panelwright.session import scratch_path

# The labels of ``learnable`` with features of two values, a copy of the label and constants.
_ROWS = """(SELECT *, CAST(p0 + p1 / 2 + ret / 4 > 0.8 AS INTEGER) AS up, p0 - p1 / 2 + ret / 10 AS move, CAST(p0 + p1 / 2 > 0.75 AS INTEGER) AS likely,
    CAST(p0 > 0.5 AS INTEGER) AS high0, CAST(p1 > 0.5 AS INTEGER) AS high1 FROM fx_prediction)"""
_CELLS = ["high0", "high1"]
_SPACE = {"maxDepth": (0, 3)}
_TRIALS = 6


def rows_of(t):
    number = lambda c: c.cast("double")
    return learnable(t).withColumns(
        {
            "likely": number(F.col("p0") + F.col("p1") / 2 > 0.75),
            "high0": number(F.col("p0") > 0.5),
            "high1": number(F.col("p1") > 0.5),
            "planted": F.col("up"),
            "flat0": F.lit(1.0),
            "flat1": F.lit(2.0),
        }
    )


def _parts(t):
    df = rows_of(t)
    return df.where(F.col("cohort") < _SPLIT), df.where(F.col("cohort") >= _SPLIT)


def _tree(depth: int = 1):
    return DecisionTreeClassifier(maxDepth=depth, seed=jobs.SEED)


def _cells(depth: int = 2):
    return DecisionTreeRegressor(maxDepth=depth, seed=jobs.SEED)


@query(
    "i4_rfe_planted",
    "feature:s rank:i",
    f"""SELECT feature, row_number() OVER (ORDER BY varies DESC, feature DESC) AS rank FROM (
          SELECT unnest(['planted', 'flat0', 'flat1']) AS feature, unnest([count(DISTINCT up) > 1, false, false]) AS varies FROM {_ROWS})""",
)
def _(t):
    return jobs.rfe(rows_of(t), ["flat1", "planted", "flat0"], "up", 1, trees=20)


@query(
    "i5_rank_by_tree_planted",
    "feature:s importance:f",
    f"SELECT unnest(['planted', 'flat0']) AS feature, unnest([CAST(count(DISTINCT up) > 1 AS INTEGER), 0]) AS importance FROM {_ROWS}",
)
def _(t):
    return jobs.rank_by_tree(rows_of(t), ["flat0", "planted"], "up", 2, trees=20)


@query(
    "j1_classifier_leaves",
    "id:i cohort:i up:i p_up0:f p_up1:f",
    f"""SELECT id, cohort, up, p AS p_up0, (SELECT avg(up) FROM {_ROWS} WHERE cohort < {_SPLIT}) AS p_up1 FROM {_ROWS}
        JOIN (SELECT likely, avg(up) AS p FROM {_ROWS} WHERE cohort < {_SPLIT} GROUP BY likely) USING (likely) WHERE cohort >= {_SPLIT}""",
)
def _(t):
    train, test = _parts(t)
    return jobs.score_family(jobs.train_classifiers(train, ["likely"], "up", [_tree(1), _tree(0)]), test, "p_up")


@query(
    "j2_regressor_leaves",
    "id:i cohort:i move:f pred_move0:f pred_move1:f",
    f"""SELECT id, cohort, move, m AS pred_move0, (SELECT avg(move) FROM {_ROWS} WHERE cohort < {_SPLIT}) AS pred_move1 FROM {_ROWS}
        JOIN (SELECT high0, high1, avg(move) AS m FROM {_ROWS} WHERE cohort < {_SPLIT} GROUP BY ALL) USING (high0, high1) WHERE cohort >= {_SPLIT}""",
)
def _(t):
    train, test = _parts(t)
    return jobs.score_family(jobs.train_regressors(train, _CELLS, "move", [_cells(2), _cells(0)]), test, "pred_move")


@query(
    "j4_held_out",
    "cohort:i n:i n_ids:i n_scored:i",
    "SELECT cohort, count(*) AS n, count(DISTINCT id) AS n_ids, count(*) AS n_scored FROM fx_prediction GROUP BY cohort",
)
def _(t):
    held = jobs.held_out(rows_of(t), ["likely"], "up", [_tree()], 3, ["id"])
    return held.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"), F.count_if(F.col("base0").between(0, 1)).alias("n_scored")
    )


@query(
    "j4_stack_order",
    "likely:i n:i n_inside:i n_scores:i place:i",
    f"""SELECT likely, count(*) AS n, count(*) AS n_inside, 1 AS n_scores, row_number() OVER (ORDER BY avg(up)) AS place
        FROM {_ROWS} WHERE cohort >= {_SPLIT} GROUP BY likely""",
)
def _(t):
    train, test = _parts(t)
    out = jobs.predict_stack(jobs.stack(train, ["likely"], "up", [_tree()], folds=3), test)
    per = out.groupBy("likely").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("stacked").between(0, 1)).alias("n_inside"),
        F.count_distinct("stacked").alias("n_scores"),
        F.collect_set("stacked").alias("own"),
    )
    # Two groups of one score each.
    other = per.select(F.col("likely").alias("l2"), F.array_min("own").alias("low"))
    placed = per.join(other, F.col("low") <= F.array_min("own")).groupBy("likely", "n", "n_inside", "n_scores").agg(F.count(F.lit(1)).alias("place"))
    return placed


def _trials_sql() -> str:
    draws = jobs.draw_trials(_SPACE, _TRIALS)
    values = ", ".join(f"({i}, {d['maxDepth']})" for i, d in enumerate(draws))
    return f"""SELECT trial, depth, perfect, trial = min(CASE WHEN perfect THEN trial END) OVER () AS is_best FROM (
        SELECT trial, depth, depth > 0 OR (SELECT count(DISTINCT up) FROM {_ROWS}) = 1 AS perfect FROM (VALUES {values}) v(trial, depth))"""


@query("j6_tune_planted", "trial:i depth:i perfect:i is_best:i", _trials_sql())
def _(t):
    trials = jobs.tune(rows_of(t), ["planted"], "up", _tree(), _SPACE, trials=_TRIALS, folds=2)[1]
    return trials.withColumns({"depth": F.get_json_object("params", "$.maxDepth"), "perfect": F.col("score") == 1.0})


_METRICS_SQL = """unnest(['accuracy', 'precision', 'recall', 'f1']) AS metric,
    unnest([avg(CAST(hit = (up = 1) AS INTEGER)), coalesce(sum(up) FILTER (hit) / nullif(count(*) FILTER (hit), 0), 0),
            coalesce(sum(up) FILTER (hit) / nullif(sum(up), 0), 0), coalesce(2 * sum(up) FILTER (hit) / nullif(count(*) FILTER (hit) + sum(up), 0), 0)]) AS value"""
_PLACED = f"(SELECT *, row_number() OVER (ORDER BY date, id) - 1 AS pos, count(*) OVER () AS n FROM {_ROWS})"


@query(
    "j7_cross_validate_leaves",
    "metric:s mean:f std:f",
    f"""SELECT metric, avg(value) AS mean, stddev_pop(value) AS std FROM (
          SELECT fold, {_METRICS_SQL} FROM {_PLACED} JOIN range(1, 4) f(fold) ON pos >= n - (4 - fold) * (n // 4) AND pos < n - (3 - fold) * (n // 4)
          JOIN (SELECT fold, likely, avg(up) >= 0.5 AS hit FROM {_PLACED} JOIN range(1, 4) f(fold) ON pos < n - (4 - fold) * (n // 4) GROUP BY ALL)
          USING (fold, likely) GROUP BY fold) GROUP BY metric""",
)
def _(t):
    return jobs.cross_validate(rows_of(t), ["likely"], "up", _tree(), ["date", "id"], 3)[0]


def _watched(t, family, label):
    """Default families on the older cohorts, watched on the newest fifth of them."""
    train, _ = _parts(t)
    grown = jobs.train_watched(train, _ORDINARY, label, ["date", "id"], family)
    losses = F.col("losses")
    # Growing stops at the first round that does not lower the loss on the watched rows.
    falling = F.forall(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(losses))), lambda i: (i == 1) | (F.get(losses, i - 1) < F.get(losses, i - 2)))
    return grown.report.select(
        "member", "asked", "n_grown", "n_watched", (F.col("kept") <= F.col("asked")).alias("not_longer"), falling.alias("falling"),
        (F.size(losses) == F.when(F.col("n_watched") > 0, F.col("kept")).otherwise(0)).alias("watched_each"),
    )


def _watched_sql(boosted: int, forests: int) -> str:
    late = f"(SELECT count(*) AS n, CAST(floor(count(*) * 0.2) AS BIGINT) AS late FROM {_ROWS} WHERE cohort < {_SPLIT})"
    return f"""SELECT member, 100 AS asked, CASE WHEN member < {boosted} THEN n - late ELSE n END AS n_grown, CASE WHEN member < {boosted} THEN late ELSE 0 END AS n_watched,
          1 AS not_longer, 1 AS falling, 1 AS watched_each FROM {late}, range(0, {boosted + forests}) m(member)"""


_ORDINARY = ["p0", "p1", "p2", "p3", "amount"]
_WATCHED_COLUMNS = "member:i asked:i n_grown:i n_watched:i not_longer:i falling:i watched_each:i"


@query("j1_watched_family", _WATCHED_COLUMNS, _watched_sql(3, 1))
def _(t):
    return _watched(t, jobs.classifier_family(), "up")


@query("j2_watched_family", _WATCHED_COLUMNS, _watched_sql(2, 0))
def _(t):
    return _watched(t, jobs.regressor_family(), "move")


def _spread(keys: str) -> str:
    """Sum of squares between the cells of ``keys``."""
    return f"(SELECT sum(n * m * m) - sum(n) * pow(sum(n * m) / sum(n), 2) FROM (SELECT count(*) AS n, avg(move) AS m FROM {_ROWS} GROUP BY {keys}))"


@query(
    "j8_importance_leaves",
    "feature:s importance:f",
    f"""SELECT feature, CASE WHEN own > other THEN own / whole ELSE 1 - other / whole END AS importance FROM (
          SELECT 'high0' AS feature, {_spread("high0")} AS own, {_spread("high1")} AS other, {_spread("high0, high1")} AS whole
          UNION ALL SELECT 'high1', {_spread("high1")}, {_spread("high0")}, {_spread("high0, high1")})""",
)
def _(t):
    return jobs.feature_importance(jobs.fit(rows_of(t), _CELLS, _cells(2), "move"), t.spark, 2)


@query(
    "j9_reloaded_leaves",
    "cohort:i n:i n_same:i mean:f task:s names:s",
    f"""SELECT cohort, count(*) AS n, count(*) AS n_same, avg(m) AS mean, 'regression' AS task, '["high0", "high1"]' AS names FROM {_ROWS}
        JOIN (SELECT high0, high1, avg(move) AS m FROM {_ROWS} WHERE cohort < {_SPLIT} GROUP BY ALL) USING (high0, high1)
        WHERE cohort >= {_SPLIT} GROUP BY cohort""",
)
def _(t):
    train, test = _parts(t)
    model = jobs.fit(train, _CELLS, _cells(2), "move")
    path = scratch_path(t.spark, "model")
    jobs.save_model(model, t.spark, path, _CELLS, "regression")
    loaded, names, task = jobs.load_model(t.spark, path)
    both = jobs.score(loaded, jobs.score(model, test, "before"), "after")
    return both.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") == F.col("after")).alias("n_same"), F.avg("after").alias("mean"),
        F.lit(task).alias("task"), F.lit(json.dumps(names)).alias("names"),
    )


_WINDOW_COLUMNS = "window:i train_start:d train_end:d test_start:d test_end:d train_samples:i test_samples:i metric:s value:f"


def _windows_sql(train_start: str, every: int) -> str:
    end = f"CAST(DATE '1995-01-01' + to_months(CAST({every} * i + {{}} AS INTEGER)) AS DATE)"
    windows = f"(SELECT * FROM (SELECT i + 1 AS \"window\", {train_start} AS train_start, {end.format(24)} AS train_end, {end.format(30)} AS test_end FROM range(0, 50) r(i)) WHERE test_end <= DATE '2001-07-01')"
    return f"""SELECT "window", train_start, train_end, train_end AS test_start, test_end, any_value(train_samples) AS train_samples,
          count(*) AS test_samples, {_METRICS_SQL} FROM {windows} w JOIN {_ROWS} r ON date >= train_end AND date < test_end
        JOIN (SELECT "window", likely, avg(up) >= 0.5 AS hit FROM {windows} JOIN {_ROWS} ON date >= train_start AND date < train_end GROUP BY ALL) USING ("window", likely)
        JOIN (SELECT "window", count(*) AS train_samples FROM {windows} JOIN {_ROWS} ON date >= train_start AND date < train_end GROUP BY ALL) USING ("window")
        GROUP BY "window", train_start, train_end, test_end"""


@query("h6_walk_forward_leaves", _WINDOW_COLUMNS, _windows_sql("CAST(DATE '1995-01-01' + to_months(CAST(12 * i AS INTEGER)) AS DATE)", 12))
def _(t):
    windows = splits.walk_forward_windows(t.spark, Date(1995, 1, 1), Date(2001, 7, 1), 24, 6, 12)
    return validation.walk_forward(rows_of(t), windows, *jobs.model_functions(["likely"], "up", _tree()))


@query("h7_robust_anchored_leaves", _WINDOW_COLUMNS, _windows_sql("DATE '1995-01-01'", 18))
def _(t):
    return validation.robust_walk_forward(
        rows_of(t), ["likely"], "up", _tree(), Date(1995, 1, 1), Date(2001, 7, 1), 24, 6, 18, anchored=True, selection=None, monitor=False
    ).results


_FOLDED = f"""(SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY date, id) - 1 AS pos, count(*) OVER (PARTITION BY "window") AS n FROM (
    SELECT i + 1 AS "window", CAST(DATE '1995-01-01' + to_months(CAST(18 * i AS INTEGER)) AS DATE) AS train_start,
      CAST(DATE '1995-01-01' + to_months(CAST(18 * i + 24 AS INTEGER)) AS DATE) AS train_end, CAST(DATE '1995-01-01' + to_months(CAST(18 * i + 30 AS INTEGER)) AS DATE) AS test_end
    FROM range(0, 50) r(i)) JOIN {_ROWS} ON date >= train_start AND date < train_end WHERE test_end <= DATE '2001-07-01')"""


@query(
    "h7_robust_cross_validation",
    "window:i metric:s mean:f std:f",
    f"""SELECT "window", metric, avg(value) AS mean, stddev_pop(value) AS std FROM (
          SELECT "window", fold, {_METRICS_SQL} FROM {_FOLDED} JOIN range(1, 4) f(fold) ON pos >= n - (4 - fold) * (n // 4) AND pos < n - (3 - fold) * (n // 4)
          JOIN (SELECT "window", fold, likely, avg(up) >= 0.5 AS hit FROM {_FOLDED} JOIN range(1, 4) f(fold) ON pos < n - (4 - fold) * (n // 4) GROUP BY ALL)
          USING ("window", fold, likely) GROUP BY "window", fold) GROUP BY "window", metric""",
)
def _(t):
    return validation.robust_walk_forward(
        rows_of(t), ["likely"], "up", _tree(), Date(1995, 1, 1), Date(2001, 7, 1), 24, 6, 18, selection=None, monitor=False, use_cv=True
    ).cross_validation


# Sparse and constant features are pruned, and one tree of each kind on the rest is left for SQL to state.
_PANEL = ["likely %", "flat0", "gappy"]
_SCORED_SQL = f"""(SELECT r.* EXCLUDE (p0, p1, p2, p3, pred0, pred1), a.p AS p0, b.p AS p1, a.p AS p2, b.p AS p3, a.m AS pred0, b.m AS pred1 FROM {_ROWS} r
    JOIN (SELECT likely, avg(up) AS p, avg(ret) AS m FROM {_ROWS} WHERE cohort < {_SPLIT} GROUP BY likely) a USING (likely),
    (SELECT avg(up) AS p, avg(ret) AS m FROM {_ROWS} WHERE cohort < {_SPLIT}) b)"""
_TESTED_SQL = f"(SELECT * FROM {_SCORED_SQL} WHERE cohort >= {_SPLIT})"
_NEWEST_SQL = f"""(SELECT *, id % 997 AS symbol FROM {_SCORED_SQL} QUALIFY row_number() OVER (PARTITION BY id % 997 ORDER BY cohort DESC, id DESC) = 1)"""


def _over(rows: str) -> str:
    return PREDICTED_SQL.replace("FROM fx_prediction", f"FROM {rows}")


def _trained(t):
    df = rows_of(t).withColumnRenamed("likely", "likely %").withColumn("gappy", F.when(F.col("id") % 10 == 0, F.col("p2")))
    df = df.drop("p0", "p1", "p2", "p3", "pred0", "pred1")
    models = [_tree(1), _tree(0)] * 2, [_cells(1), _cells(0)]
    return training.train_models(df.where(F.col("cohort") < _SPLIT), _PANEL, "up", "ret", *models), df


@query("j11_trained_evaluation", f"cohort:i {EVAL_COLUMNS}", topk_sql("cohort", ranking.TOP_SLICES, EVALUATED, _over(_TESTED_SQL)))
def _(t):
    models, df = _trained(t)
    test = models.scored(df.where(F.col("cohort") >= _SPLIT))
    return evaluation.evaluate_models(test, models.probabilities, models.predictions, "ret", "ret")[2]


@query(
    "j12_trained_latest",
    "symbol:i id:i ai_pred_avg:f " + " ".join(f"{v}:f" for v in VARIANTS),
    f"SELECT * FROM {_over(_NEWEST_SQL).replace('OVER (PARTITION BY cohort)', 'OVER ()')} ORDER BY ai_pred_avg DESC, symbol LIMIT 20",
)
def _(t):
    models, df = _trained(t)
    df = df.withColumn("symbol", F.col("id") % 997)
    return evaluation.latest_prediction(
        df, models.probabilities, models.predictions, 20, ["cohort", "id"], ["amount"], score=models.scored
    )
