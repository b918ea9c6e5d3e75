"""Queries for statistics, feature selection and monitoring."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from panelwright.catalog.registry import query
from panelwright.operators import stats

# Features with one near copy, and a class target.
_COLUMNS = ("p0", "p1", "p2", "amount", "near", "pred0")
SAMPLE_SQL = "(SELECT *, amount * 2 + p0 AS near, CASE WHEN p0 + pred0 > 0.4 THEN 1 ELSE 0 END AS up FROM fx_prediction)"


def sample(t):
    return t.prediction.withColumn("near", F.col("amount") * 2 + F.col("p0")).withColumn(
        "up", (F.col("p0") + F.col("pred0") > 0.4).cast("int")
    )


def _pairs_sql(columns, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS i, '{a}' AS \"left\", '{b}' AS \"right\", corr({a}, {b}) AS corr FROM {source}"
        for i, (a, b) in enumerate(combinations(columns, 2))
    )


@query("i1_correlations", "left:s right:s corr:f", _pairs_sql(_COLUMNS, SAMPLE_SQL))
def _(t):
    return stats.correlations(sample(t), _COLUMNS)


@query(
    "i1_prune_correlated",
    "column:s because_of:s",
    f'SELECT "right" AS "column", arg_min("left", i) AS because_of FROM ({_pairs_sql(_COLUMNS, SAMPLE_SQL)}) WHERE abs(corr) > 0.95 GROUP BY "right"',
)
def _(t):
    return stats.correlated_columns(sample(t), _COLUMNS)


# A wide frame with gaps of its own in every column, and a near copy of every fifth.
_WIDE = tuple(f"w{k}" for k in range(28))
_WIDE_EXPR = {
    f"w{k}": f"CASE WHEN id % {k + 3} <> 0 THEN p{k % 3} * {k % 5 + 1} + pred0 * {k // 5} + amount / {1000 * (k + 1)} END" for k in range(28)
}
_WIDE_SQL = f"(SELECT {', '.join(f'{e} AS {c}' for c, e in _WIDE_EXPR.items())} FROM {SAMPLE_SQL})"


def wide(t):
    return sample(t).select(*[F.expr(e).alias(c) for c, e in _WIDE_EXPR.items()])


@query("i1_correlations_wide", "left:s right:s corr:f", _pairs_sql(_WIDE, _WIDE_SQL))
def _(t):
    return stats.correlations(wide(t), _WIDE)


@query(
    "i1_prune_correlated_wide",
    "column:s because_of:s",
    f'SELECT "right" AS "column", arg_min("left", i) AS because_of FROM ({_pairs_sql(_WIDE, _WIDE_SQL)}) WHERE abs(corr) > 0.95 GROUP BY "right"',
)
def _(t):
    return stats.correlated_columns(wide(t), _WIDE)


_MI = ("p0", "p1", "p2", "pred0")


def _bins_sql(columns, carry: str, source: str) -> str:
    names = ", ".join(f"'{c}'" for c in columns)
    return f"""(SELECT *, floor((row_number() OVER (PARTITION BY feature ORDER BY value, id) - 1) * 10 / count(*) OVER (PARTITION BY feature)) AS bin
        FROM (SELECT id, {carry}, unnest([{names}]) AS feature, unnest([{", ".join(columns)}]) AS value FROM {source}))"""


def _mi_sql(cells: str) -> str:
    return f"""SELECT feature, sum(c / n * ln(c * n / (cx * cy))) AS score FROM (
        SELECT feature, c, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, bin) AS cx,
               sum(c) OVER (PARTITION BY feature, y) AS cy
        FROM (SELECT feature, bin, y, count(*)::DOUBLE AS c FROM {cells} GROUP BY ALL)) GROUP BY feature ORDER BY score DESC LIMIT 3"""


@query("i2_rank_by_mutual_info", "feature:s score:f", _mi_sql(_bins_sql(_MI, "up AS y", SAMPLE_SQL)))
def _(t):
    return stats.rank_by_mutual_info(sample(t), _MI, "up", ["id"], 3)


@query(
    "i2_rank_by_mutual_info_regression",
    "feature:s score:f",
    _mi_sql(
        _bins_sql(
            _MI,
            "y",
            f"(SELECT s.*, floor((row_number() OVER (ORDER BY ret, id) - 1) * 10 / count(*) OVER ()) AS y FROM {SAMPLE_SQL} s)",
        )
    ),
)
def _(t):
    return stats.rank_by_mutual_info(sample(t), _MI, "ret", ["id"], 3, continuous=True)


def _digamma_sql(n: str) -> str:
    x = f"({n} + 8.0)"
    series = f"ln({x}) - 1 / (2 * {x}) - 1 / (12 * {x} ** 2) + 1 / (120 * {x} ** 4) - 1 / (252 * {x} ** 6)"
    return f"({series} - {' - '.join(f'1 / ({n} + {i}.0)' for i in range(8))})"


@query(
    "i2_neighbour_info",
    "feature:s score:f",
    f"""WITH l AS (SELECT id, up, unnest([{", ".join(f"'{c}'" for c in _MI)}]) AS feature, unnest([{", ".join(_MI)}])::DOUBLE AS x FROM {SAMPLE_SQL}),
      c AS (SELECT *, count(*) OVER (PARTITION BY feature, up) AS n,
              list_sort(list_filter([{", ".join(f"x - lag(x, {i}) OVER w, lead(x, {i}) OVER w - x" for i in (1, 2, 3))}], lambda d: d IS NOT NULL)) AS away
            FROM l WINDOW w AS (PARTITION BY feature, up ORDER BY x, id)),
      r AS (SELECT *, least(3, n - 1) AS near, away[least(3, n - 1)] * (1 - 1e-9) AS radius FROM c WHERE n > 1),
      m AS (SELECT *, count(*) OVER (PARTITION BY feature ORDER BY x RANGE BETWEEN radius PRECEDING AND radius FOLLOWING) AS inside FROM r)
      SELECT feature, greatest(0, {_digamma_sql("count(*)")} + avg({_digamma_sql("near")}) - avg({_digamma_sql("n")}) - avg({_digamma_sql("inside")})) AS score
      FROM m GROUP BY feature ORDER BY score DESC, feature LIMIT 3""",
)
def _(t):
    return stats.rank_by_neighbour_info(sample(t), _MI, "up", ["id"], 3)


@query(
    "i3_rank_by_f_test",
    "feature:s score:g",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, (sum(n * (m - g) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS score FROM (
            SELECT up, count(*) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM {SAMPLE_SQL}) AS g FROM {SAMPLE_SQL} GROUP BY up)"""
        for c in _MI
    )
    + ") ORDER BY score DESC LIMIT 3",
)
def _(t):
    return stats.rank_by_f_test(sample(t), _MI, "up", 3)


@query(
    "i3_rank_by_f_test_regression",
    "feature:s score:f",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, corr({c}, near) ** 2 / (1 - corr({c}, near) ** 2) * (count(*) - 2) AS score FROM {SAMPLE_SQL}" for c in _MI
    )
    + ") ORDER BY score DESC LIMIT 3",
)
def _(t):
    return stats.rank_by_f_test(sample(t), _MI, "near", 3, continuous=True)


@query(
    "i3_rank_by_f_test_gaps",
    "feature:s score:g",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, corr({c}, w0) ** 2 / (1 - corr({c}, w0) ** 2) * (count(*) FILTER ({c} IS NOT NULL AND w0 IS NOT NULL) - 2) AS score FROM {_WIDE_SQL}"
        for c in _WIDE[1:9]
    )
    + ") ORDER BY score DESC LIMIT 5",
)
def _(t):
    return stats.rank_by_f_test(wide(t), _WIDE[1:9], "w0", 5, continuous=True)


_CLASS_SQL = """SELECT {by} avg(((p0 > 0.5) = (ret > 0))::INT) AS accuracy,
      coalesce(count(*) FILTER (p0 > 0.5 AND ret > 0) / nullif(count(*) FILTER (p0 > 0.5), 0), 0) AS precision,
      coalesce(count(*) FILTER (p0 > 0.5 AND ret > 0) / nullif(count(*) FILTER (ret > 0), 0), 0) AS recall,
      coalesce(2 * count(*) FILTER (p0 > 0.5 AND ret > 0) / nullif(count(*) FILTER (p0 > 0.5) + count(*) FILTER (ret > 0), 0), 0) AS f1
    FROM fx_prediction {group}"""


def labelled(t):
    df = t.prediction
    return df.withColumn("up", (F.col("ret") > 0).cast("int")).withColumn("guess", (F.col("p0") > 0.5).cast("int"))


@query("i10_classification_metrics", "cohort:i accuracy:f precision:f recall:f f1:f", _CLASS_SQL.format(by="cohort,", group="GROUP BY cohort"))
def _(t):
    return stats.classification_metrics(labelled(t), "up", "guess", by=["cohort"])


@query(
    "i10_classification_metrics_threshold",
    "accuracy:f precision:f recall:f f1:f",
    _CLASS_SQL.format(by="", group="").replace("p0 > 0.5", "p0 >= 0.7"),
)
def _(t):
    return stats.classification_metrics(labelled(t), "up", "p0", 0.7)


@query(
    "i11_regression_metrics",
    "cohort:i rmse:f mae:f",
    "SELECT cohort, sqrt(avg((ret - pred0) ** 2)) AS rmse, avg(abs(ret - pred0)) AS mae FROM fx_prediction GROUP BY cohort",
)
def _(t):
    return stats.regression_metrics(t.prediction, "ret", "pred0", ["cohort"])


# A metric history: one value per cohort and metric.
HISTORY_SQL = """(SELECT cohort AS period, unnest(['accuracy', 'f1', 'rmse']) AS metric, unnest([accuracy, f1, rmse]) AS value FROM (
      SELECT cohort, avg(((p0 > 0.5) = (ret > 0))::INT) AS accuracy,
             2 * count(*) FILTER (p0 > 0.5 AND ret > 0) / (count(*) FILTER (p0 > 0.5) + count(*) FILTER (ret > 0)) AS f1,
             sqrt(avg((ret - pred0) ** 2)) AS rmse FROM fx_prediction GROUP BY cohort))"""


def history(t):
    classes = stats.classification_metrics(labelled(t), "up", "guess", by=["cohort"])
    errors = stats.regression_metrics(t.prediction, "ret", "pred0", ["cohort"])
    return (
        classes.join(errors, "cohort")
        .withColumnRenamed("cohort", "period")
        .unpivot(["period"], ["accuracy", "f1", "rmse"], "metric", "value")
    )


_BASE_SQL = f"(SELECT metric, avg(value) AS baseline FROM (SELECT * FROM {HISTORY_SQL} QUALIFY row_number() OVER (PARTITION BY metric ORDER BY period) <= 3) GROUP BY metric)"
_WORSE = "CASE WHEN metric = 'rmse' THEN -1 ELSE 1 END * (baseline - value) / baseline"


@query("i6_baseline", "metric:s baseline:f", f"SELECT * FROM {_BASE_SQL}")
def _(t):
    return stats.baseline(history(t))


_ALERT_SQL = f"""(SELECT period, metric, baseline, value, {_WORSE} AS degradation FROM (
    SELECT *, row_number() OVER (PARTITION BY metric ORDER BY period) AS rn FROM {HISTORY_SQL}) JOIN {_BASE_SQL} USING (metric)
    WHERE rn >= 3 AND {_WORSE} > 0.03)"""


@query("i6_degradation_alerts", "period:i metric:s baseline:f value:f degradation:f", f"SELECT * FROM {_ALERT_SQL}")
def _(t):
    return stats.degradation_alerts(history(t), 0.03)


@query(
    "i7_should_retrain",
    "metric:s baseline:f should_retrain:i",
    f"""SELECT metric, baseline, bool_and({_WORSE} > 0.001) AND count(*) = 3 AS should_retrain FROM (
        SELECT * FROM {HISTORY_SQL} QUALIFY row_number() OVER (PARTITION BY metric ORDER BY period DESC) <= 3)
        JOIN {_BASE_SQL} USING (metric) WHERE metric = 'accuracy' GROUP BY metric, baseline""",
)
def _(t):
    return stats.should_retrain(history(t), 3, 0.001)


@query(
    "i8_metric_summary",
    "metric:s mean:f std:f min:f max:f current:f total_alerts:i recent_alerts:i",
    f"""SELECT metric, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
          arg_max(value, period) AS current, (SELECT count(*) FROM {_ALERT_SQL} a WHERE a.metric = h.metric) AS total_alerts,
          (SELECT count(*) FROM {_ALERT_SQL} a WHERE a.metric = h.metric AND a.period = max(h.period)) AS recent_alerts
        FROM (SELECT * FROM {HISTORY_SQL} QUALIFY row_number() OVER (PARTITION BY metric ORDER BY period DESC) <= 10) h GROUP BY metric""",
)
def _(t):
    return stats.metric_summary(history(t), 10, 0.03)


_KS = ("p0", "pred0", "amount", "shifted")
_KS_SQL = "(SELECT *, CASE WHEN cohort < 7992 THEN p1 ELSE p1 + 0.05 END AS shifted FROM fx_prediction)"


_DRIFT_WINDOWS = {w: (7984 + 2 * w, 7988 + 2 * w) for w in range(1, 6)}


@query(
    "i9_drift_by_window",
    "window:i feature:s n_ref:i n_new:i ks_statistic:f",
    " UNION ALL ".join(
        f"""SELECT {w} AS "window", '{c}' AS feature, nr AS n_ref, nn AS n_new, max(d) AS ks_statistic FROM (
            SELECT *, abs(sum(r) OVER w / nr - sum(s) OVER w / nn) AS d FROM (
              SELECT {c} AS v, sum((cohort < 7986)::INT) AS r, sum((cohort >= {a} AND cohort < {b})::INT) AS s FROM fx_prediction GROUP BY 1),
              (SELECT count(*) FILTER (cohort < 7986) AS nr, count(*) FILTER (cohort >= {a} AND cohort < {b}) AS nn FROM fx_prediction)
            WINDOW w AS (ORDER BY v)) WHERE nn > 0 GROUP BY nr, nn"""
        for w, (a, b) in _DRIFT_WINDOWS.items()
        for c in ("p0", "amount")
    ),
)
def _(t):
    """Overlapping windows against one reference in one sorted pass."""
    cohort = F.col("cohort")
    windows = {w: (cohort >= a) & (cohort < b) for w, (a, b) in _DRIFT_WINDOWS.items()}
    return stats.ks_drift_by_window(t.prediction, cohort < 7986, windows, ["p0", "amount"])


@query(
    "i9_ks_drift",
    "feature:s n_ref:i n_new:i ks_statistic:f p_value:f drifted:i",
    """SELECT feature, n_ref, n_new, ks_statistic, lam > 1.3581015157406195 AS drifted, CASE WHEN lam < 0.2 THEN 1 ELSE least(1, greatest(0,
         list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * lam * lam))))) END AS p_value FROM ("""
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, nr AS n_ref, nn AS n_new, max(d) AS ks_statistic, max(d) * sqrt(nr * nn / (nr + nn)) AS lam FROM (
            SELECT *, abs(sum(r) OVER w / nr - sum(s) OVER w / nn) AS d FROM (
              SELECT {c} AS v, sum((cohort < 7992)::INT) AS r, sum((cohort >= 7992)::INT) AS s FROM {_KS_SQL} GROUP BY 1),
              (SELECT count(*) FILTER (cohort < 7992) AS nr, count(*) FILTER (cohort >= 7992) AS nn FROM {_KS_SQL})
            WINDOW w AS (ORDER BY v)) GROUP BY nr, nn"""
        for c in _KS
    )
    + ")",
)
def _(t):
    df = t.prediction.withColumn("shifted", F.when(F.col("cohort") < 7992, F.col("p1")).otherwise(F.col("p1") + 0.05))
    return stats.ks_drift(df.where("cohort < 7992"), df.where("cohort >= 7992"), _KS)


_LOSSES = ("pred0", "pred1")


@query(
    "i12_prediction_loss",
    "cohort:i model:s loss:f accumulated_loss:f",
    " UNION ALL ".join(
        f"""SELECT cohort, '{c}' AS model, s / n AS loss, sum(s) OVER (ORDER BY cohort) / sum(n) OVER (ORDER BY cohort) AS accumulated_loss
            FROM (SELECT cohort, count(*) AS n, sum(abs(ret - {c})) AS s FROM fx_prediction GROUP BY cohort)"""
        for c in _LOSSES
    ),
)
def _(t):
    return stats.prediction_loss(t.prediction, _LOSSES, "ret")


_MODELS = ("m0", "m1", "m2")
MODELS_SQL = "(SELECT *, (ret > 0)::INT AS up, (p0 > 0.5)::INT AS m0, (p1 + ret > 0.6)::INT AS m1, (p2 + ret / 4 > 0.5)::INT AS m2 FROM fx_prediction)"


def models(t):
    return t.prediction.select(
        "*",
        (F.col("ret") > 0).cast("int").alias("up"),
        (F.col("p0") > 0.5).cast("int").alias("m0"),
        (F.col("p1") + F.col("ret") > 0.6).cast("int").alias("m1"),
        (F.col("p2") + F.col("ret") / 4 > 0.5).cast("int").alias("m2"),
    )


@query(
    "i13_mcnemar",
    "model1:s model2:s only_first:i only_second:i statistic:f better:s",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS model1, '{b}' AS model2, b AS only_first, c AS only_second, (abs(b - c) - 1) ** 2 / nullif(b + c, 0) AS statistic,
            CASE WHEN (abs(b - c) - 1) ** 2 / nullif(b + c, 0) > {stats.CHI2_1_95} THEN CASE WHEN b > c THEN '{a}' ELSE '{b}' END END AS better
            FROM (SELECT count(*) FILTER ({a} = up AND {b} <> up) AS b, count(*) FILTER ({a} <> up AND {b} = up) AS c FROM {MODELS_SQL})"""
        for a, b in combinations(_MODELS, 2)
    ),
)
def _(t):
    return stats.mcnemar(models(t), "up", _MODELS)


_RESULTS_SQL = "(" + " UNION ALL ".join(f"SELECT '{m}' AS model_name, avg(({m} = up)::INT) AS accuracy FROM {MODELS_SQL}" for m in _MODELS) + ")"


def results(t):
    wide = models(t).agg(*[F.avg((F.col(m) == F.col("up")).cast("double")).alias(m) for m in _MODELS])
    return wide.unpivot([], list(_MODELS), "model_name", "accuracy")


@query("i14_compare_models", "place:i model_name:s accuracy:f", f"SELECT *, row_number() OVER (ORDER BY accuracy DESC, model_name) AS place FROM {_RESULTS_SQL}")
def _(t):
    return stats.compare_models(results(t))


@query(
    "i14_is_improved",
    "new_score:f base_score:f improvement:f improved:i",
    f"""SELECT *, new_score - base_score AS improvement, new_score - base_score > 0.01 AS improved FROM (
        SELECT max(accuracy) FILTER (model_name = 'm1') AS new_score, max(accuracy) FILTER (model_name = 'm0') AS base_score FROM {_RESULTS_SQL})""",
)
def _(t):
    return stats.is_improved(results(t), "m1", "m0")


@query("i14_best_model", "model_name:s accuracy:f", f"SELECT * FROM {_RESULTS_SQL} ORDER BY accuracy DESC, model_name LIMIT 1")
def _(t):
    return stats.best_model(results(t))


@query("i15_agreement_correlation", "left:s right:s corr:f", _pairs_sql(_MODELS, MODELS_SQL))
def _(t):
    return stats.agreement_correlation(models(t), _MODELS)
