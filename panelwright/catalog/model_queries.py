"""Queries for model jobs and whole plans (E17, H6, H7, I4, I5, J1-J12, flagship)."""

from __future__ import annotations

from datetime import date as Date

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from panelwright.catalog.feature_queries import _SQL_FEATURES, _SQL_FEATURES_2
from panelwright.catalog.ranking_queries import EVAL_COLUMNS, EVALUATED, PREDICTED_SQL, VARIANTS, topk_sql
from panelwright.catalog.registry import query
from panelwright.catalog.stats_queries import MODELS_SQL, models
from panelwright.functions.names import keep_feature
from panelwright.models import jobs
from panelwright.operators import features, ranking, splits
from panelwright.plans import evaluation, ml_dataset, replay, validation
from panelwright.session import scratch_path

_FEATURES = ["p0", "p1", "p2", "p3", "amount"]
_SPLIT = 7996


def learnable(t):
    """Scored orders with labels the features explain in part."""
    up = F.col("p0") + F.col("p1") / 2 + F.col("ret") / 4 > 0.8
    move = F.col("p0") - F.col("p1") / 2 + F.col("ret") / 10
    return t.prediction.withColumn("up", up.cast("double")).withColumn("move", move)


def _parts(t):
    df = learnable(t)
    return df.where(F.col("cohort") < _SPLIT), df.where(F.col("cohort") >= _SPLIT)


@query("i4_rfe", "feature:s rank:i")
def _(t):
    return jobs.rfe(learnable(t), _FEATURES, "up", 2, trees=5)


@query("i5_rank_by_tree", "feature:s importance:f")
def _(t):
    return jobs.rank_by_tree(learnable(t), _FEATURES, "up", 3, trees=10)


def _classifiers(t):
    train, test = _parts(t)
    return jobs.train_classifiers(train, _FEATURES, "up", jobs.classifier_family(3, (2, 3, 4), 4)), test


@query("j1_train_classifiers", "id:i cohort:i up:i p_up0:f p_up1:f p_up2:f p_up3:f")
def _(t):
    fitted, test = _classifiers(t)
    return jobs.score_family(fitted, test, "p_up")


@query("j2_train_regressors", "id:i cohort:i move:f pred_move0:f pred_move1:f")
def _(t):
    train, test = _parts(t)
    fitted = jobs.train_regressors(train, _FEATURES, "move", jobs.regressor_family(3, (2, 3)))
    return jobs.score_family(fitted, test, "pred_move")


@query("j3_train_per_sector", "id:i sector:s predicted_score:f predicted_class:i")
def _(t):
    train, test = _parts(t)
    gaps = F.when(F.col("id") % 7 != 0, F.col("p1"))
    tree = DecisionTreeClassifier(maxDepth=3, seed=jobs.SEED)
    configs = {
        "1-URGENT": jobs.SectorConfig(("p0", "p1", "amount"), tree, "f_test", 2),
        "2-HIGH": jobs.SectorConfig(("p0", "p1"), tree),
        "5-LOW": jobs.SectorConfig(("p0", "p2", "p3"), tree, "mutual_info", 2),
    }
    fitted = jobs.train_per_sector(train, configs, "up")
    return jobs.predict_per_sector(test.withColumn("p1", gaps), fitted)


@query(
    "j3_sector_coverage",
    "sector:s n:i n_scored:i n_classes:i",
    f"""SELECT sector, count(*) AS n, count(*) FILTER (sector = '2-HIGH' AND id % 7 <> 0 OR sector = '5-LOW') AS n_scored,
        count(*) FILTER (sector = '2-HIGH' AND id % 7 <> 0 OR sector = '5-LOW') AS n_classes
        FROM fx_prediction WHERE cohort >= {_SPLIT} GROUP BY sector""",
)
def _(t):
    train, test = _parts(t)
    tree = DecisionTreeClassifier(maxDepth=2, seed=jobs.SEED)
    fitted = jobs.train_per_sector(
        train, {"2-HIGH": jobs.SectorConfig(("p0", "p1"), tree), "5-LOW": jobs.SectorConfig(("p0", "p2"), tree)}, "up"
    )
    out = jobs.predict_per_sector(test.withColumn("p1", F.when(F.col("id") % 7 != 0, F.col("p1"))), fitted)
    inside = F.col("predicted_score").between(0, 1)
    return out.groupBy("sector").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("n_scored"), F.count("predicted_class").alias("n_classes")
    )


@query("j4_stack", "id:i up:i stacked:f")
def _(t):
    train, test = _parts(t)
    base = [DecisionTreeClassifier(maxDepth=3, seed=jobs.SEED), LogisticRegression(maxIter=5)]
    return jobs.predict_stack(jobs.stack(train, _FEATURES, "up", base, folds=3), test)


@query("j4_stack_regression", "id:i move:f stacked:f")
def _(t):
    train, test = _parts(t)
    base = [DecisionTreeRegressor(maxDepth=3, seed=jobs.SEED), DecisionTreeRegressor(maxDepth=5, seed=jobs.SEED)]
    return jobs.predict_stack(jobs.stack(train, _FEATURES, "move", base, "ridge", folds=2), test)


@query(
    "j5_vote",
    "id:i hard:i soft:f weighted:f hard_weighted:i",
    f"""SELECT id, m0 + m1 + m2 >= 2 AS hard, (p0 + p1 + p2) / 3 AS soft, (p0 + 2 * p1 + 3 * p2) / 6 AS weighted,
        m0 + 2 * m1 + 3 * m2 > 3 AS hard_weighted FROM {MODELS_SQL}""",
)
def _(t):
    classes, scores = ["m0", "m1", "m2"], ["p0", "p1", "p2"]
    return models(t).select(
        "id",
        jobs.vote(classes, "hard").alias("hard"),
        jobs.vote(scores, "soft").alias("soft"),
        jobs.vote(scores, "soft", [1, 2, 3]).alias("weighted"),
        jobs.vote(classes, "hard", [1, 2, 3]).alias("hard_weighted"),
    )


@query("j6_tune", "trial:i params:s score:f is_best:i")
def _(t):
    space = {"maxDepth": (2, 4), "subsamplingRate": (0.6, 1.0), "numTrees": (3, 6)}
    return jobs.tune(learnable(t), _FEATURES, "up", RandomForestClassifier(seed=jobs.SEED), space, trials=3, folds=2)[1]


@query("j7_cross_validate", "metric:s mean:f std:f")
def _(t):
    tree = DecisionTreeClassifier(maxDepth=3, seed=jobs.SEED)
    return jobs.cross_validate(learnable(t), _FEATURES, "up", tree, ["date", "id"], 3)[0]


@query("j8_feature_importance", "feature:s importance:f")
def _(t):
    model = jobs.fit(learnable(t), _FEATURES, GBTClassifier(maxIter=3, maxDepth=3, seed=jobs.SEED), "up")
    return jobs.feature_importance(model, t.spark, 3)


@query("j9_save_load_model", "id:i before:f after:f task:s n_features:i")
def _(t):
    train, test = _parts(t)
    model = jobs.fit(train, _FEATURES, GBTRegressor(maxIter=2, maxDepth=3, seed=jobs.SEED), "move")
    path = scratch_path(t.spark, "model")
    jobs.save_model(model, t.spark, path, _FEATURES, "regression")
    loaded, names, task = jobs.load_model(t.spark, path)
    both = jobs.score(loaded, jobs.score(model, test, "before"), "after")
    return both.select("id", "before", "after", F.lit(task).alias("task"), F.lit(len(names)).alias("n_features"))


@query(
    "j10_compare_runs",
    "run_name:s score:f depth:s",
    """SELECT 'run_' || cohort AS run_name, avg(((p0 > 0.5) = (ret > 0))::INT) AS score, (cohort % 5)::VARCHAR AS depth
       FROM fx_prediction GROUP BY cohort ORDER BY score DESC, run_name LIMIT 10""",
)
def _(t):
    path = scratch_path(t.spark, "runs")
    runs = t.prediction.groupBy("cohort").agg(
        F.avg(((F.col("p0") > 0.5) == (F.col("ret") > 0)).cast("double")).alias("accuracy")
    )
    key = lambda c, n: F.create_map(F.lit(n), c)
    table = runs.select(
        F.concat(F.lit("run_"), "cohort").alias("run_name"),
        key((F.col("cohort") % 5).cast("string"), "depth").alias("params"),
        key(F.col("accuracy"), "test_accuracy").alias("metrics"),
        key(F.lit("tree"), "model_type").alias("tags"),
        (F.col("cohort") % 2).alias("half"),
    )
    for half in (0, 1):
        jobs.log_runs(table.where(F.col("half") == half), path)
    return jobs.compare_runs(t.spark, path, "test_accuracy").withColumn("depth", F.col("params.depth"))


@query("j11_evaluation", f"cohort:i {EVAL_COLUMNS}", topk_sql("cohort", ranking.TOP_SLICES, EVALUATED, PREDICTED_SQL))
def _(t):
    preds = ["pred0", "pred1"]
    return evaluation.evaluate_models(t.prediction, [f"p{i}" for i in range(4)], preds, "ret", "ret")[2]


@query(
    "j11_evaluation_losses",
    "cohort:i model:s loss:f accumulated_loss:f",
    f"""SELECT cohort, model, s / n AS loss, sum(s) OVER w / sum(n) OVER w AS accumulated_loss FROM (
          SELECT cohort, model, sum(abs(ret - v)) AS s, count(*) AS n FROM (
            SELECT cohort, ret, unnest([{", ".join(f"'{c}'" for c in EVALUATED)}]) AS model, unnest([{", ".join(EVALUATED)}]) AS v FROM {PREDICTED_SQL})
          GROUP BY ALL) WINDOW w AS (PARTITION BY model ORDER BY cohort)""",
)
def _(t):
    preds = ["pred0", "pred1"]
    return evaluation.evaluate_models(t.prediction, [f"p{i}" for i in range(4)], preds, "ret", "ret")[1]


_NEWEST_SQL = """(SELECT *, id % 997 AS symbol FROM fx_prediction QUALIFY row_number() OVER (PARTITION BY id % 997 ORDER BY cohort DESC, id DESC) = 1)"""
_LATEST_SQL = PREDICTED_SQL.replace("FROM fx_prediction", f"FROM {_NEWEST_SQL}").replace("OVER (PARTITION BY cohort)", "OVER ()")


@query(
    "j12_latest_prediction",
    "symbol:i id:i ai_pred_avg:f " + " ".join(f"{v}:f" for v in VARIANTS),
    f"SELECT * FROM {_LATEST_SQL} ORDER BY ai_pred_avg DESC, symbol LIMIT 20",
)
def _(t):
    df = t.prediction.withColumn("symbol", F.col("id") % 997)
    probs = [f"p{i}" for i in range(4)]
    return evaluation.latest_prediction(df, probs, ["pred0", "pred1"], 20, ["cohort", "id"], probs)


@query("h6_walk_forward", "window:i test_start:d train_samples:i test_samples:i metric:s value:f")
def _(t):
    windows = splits.walk_forward_windows(t.spark, Date(1995, 1, 1), Date(2001, 7, 1), 24, 6, 12)
    tree = DecisionTreeClassifier(maxDepth=3, seed=jobs.SEED)
    train, evaluate = jobs.model_functions(["p0", "p1"], "up", tree)
    return validation.walk_forward(learnable(t), windows, train, evaluate)


def _mean_model(rows):
    return rows.agg(F.avg("move")).head()[0]


def _mean_error(mean, rows):
    return rows.agg(F.avg(F.abs(F.col("move") - mean)).alias("mae"), F.avg(F.col("move") - mean).alias("bias")).head().asDict()


@query(
    "h6_walk_forward_custom",
    "window:i train_start:d train_end:d test_start:d test_end:d train_samples:i test_samples:i metric:s value:f",
    """WITH w AS (SELECT i + 1 AS "window", CAST(DATE '1995-01-01' + to_months(CAST(12 * i AS INTEGER)) AS DATE) AS train_start,
            CAST(DATE '1995-01-01' + to_months(CAST(12 * i + 24 AS INTEGER)) AS DATE) AS train_end,
            CAST(DATE '1995-01-01' + to_months(CAST(12 * i + 30 AS INTEGER)) AS DATE) AS test_end FROM range(0, 50) r(i)),
        p AS (SELECT *, p0 - p1 / 2 + ret / 10 AS move FROM fx_prediction),
        m AS (SELECT w.*, avg(move) AS mean, count(*) AS train_samples FROM w JOIN p ON date >= train_start AND date < train_end
              WHERE test_end <= DATE '2001-07-01' GROUP BY ALL)
      SELECT "window", train_start, train_end, train_end AS test_start, test_end, train_samples, test_samples,
             unnest(['mae', 'bias']) AS metric, unnest([mae, bias]) AS value
      FROM (SELECT "window", train_start, train_end, test_end, train_samples, count(*) AS test_samples, avg(abs(move - mean)) AS mae,
                   avg(move - mean) AS bias FROM m JOIN p ON date >= train_end AND date < test_end GROUP BY ALL)""",
)
def _(t):
    windows = splits.walk_forward_windows(t.spark, Date(1995, 1, 1), Date(2001, 7, 1), 24, 6, 12)
    return validation.walk_forward(learnable(t), windows, _mean_model, _mean_error)


@query("h7_robust_walk_forward", "window:i metric:s value:f n_features:i n_drifted:i")
def _(t):
    out = validation.robust_walk_forward(
        learnable(t), _FEATURES, "up", DecisionTreeClassifier(maxDepth=3, seed=jobs.SEED),
        Date(1995, 1, 1), Date(2001, 7, 1), 24, 6, 18, top_k=3,
    )
    drifted = out.drift.groupBy("window").agg(F.count_if("drifted").alias("n_drifted"))
    return out.results.join(drifted, "window", "left").select(
        "window", "metric", "value", F.lit(len(out.features)).alias("n_features"), F.coalesce("n_drifted", F.lit(0)).alias("n_drifted")
    )


def panel_filings(t):
    """Filings with a market cap and two ratios."""
    cap = t.raw("supplier").select(F.col("s_suppkey").alias("symbol"), (F.abs("s_acctbal") * 1e4 + 1).alias("marketCap"))
    return t.filing.join(cap, "symbol").withColumn("margin", F.col("revenue") / F.col("cost"))


_TIME_COLUMNS = ["revenue", "cost", "netDebt", "freeCashFlow", "margin"]


def build_dataset(t, horizon="forward", **options):
    """All features of all time columns."""
    return ml_dataset.ml_dataset(
        t.symbol, t.price, panel_filings(t), 1998, 2000,
        ["revenue", "freeCashFlow"], ["margin"], _TIME_COLUMNS, ["freeCashFlow"], horizon=horizon, **options,
    )


def _robust(c: str) -> str:
    q = f"quantile_cont({c}, {{}}) OVER (PARTITION BY ordinal)"
    spread = f"({q.format(0.75)} - {q.format(0.25)})"
    return f"({c} - {q.format(0.5)}) / CASE WHEN {spread} = 0 THEN 1 ELSE {spread} END AS {c}"


_SCALED = ("margin", "OverMC_revenue", "adaptiveMC_ev", "revenue_ts_mean", "margin_ts_maximum", "revenue_ts_autocorrelation__lag_5")

_FEATURES_BASE = f"""WITH d AS (SELECT DISTINCT date AS d FROM (SELECT as_of, max(date) AS date FROM
        (SELECT CAST(unnest(generate_series(DATE '1995-01-01', least(DATE '2000-12-31', (SELECT max(date) FROM fx_price)), INTERVAL 3 MONTH)) AS DATE) AS as_of)
        JOIN (SELECT DISTINCT date FROM fx_price) ON date BETWEEN as_of - 10 AND as_of GROUP BY as_of)),
    liq AS (SELECT y, symbol FROM (SELECT y, symbol, avg(close * volume) AS m FROM fx_price, (VALUES (1998), (1999), (2000)) v(y)
            WHERE date IN (SELECT d FROM d) AND date BETWEEN make_date(y - 4, 1, 1) AND make_date(y + 1, 3, 1) GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY y ORDER BY m DESC, symbol) <= floor(count(*) OVER (PARTITION BY y) * 0.5)),
    fil AS (SELECT f.*, abs(s_acctbal) * 1e4 + 1 AS marketCap, revenue / cost AS margin, calendarYear * 4 + CAST(period[2] AS INTEGER) AS ordinal,
                   (SELECT min(d) FROM d WHERE d > f.fillingDate) AS rebalance_date FROM fx_filing f JOIN supplier ON s_suppkey = symbol),
    win AS (SELECT *, revenue / marketCap AS OverMC_revenue, marketCap + netDebt AS adaptiveMC_ev, list(revenue) OVER w AS x, list(margin) OVER w AS g,
                   {", ".join(f"list({k}) OVER w AS w_{k}" for k in _TIME_COLUMNS)},
                   min(fillingDate) OVER w AS first_filed, count(*) OVER w AS n
            FROM fil WINDOW w AS (PARTITION BY symbol ORDER BY ordinal ROWS 11 PRECEDING)),
    feat AS (SELECT *, list_avg(x) AS revenue_ts_mean, list_max(g) AS margin_ts_maximum,
                    list_sum(list_transform(range(1, 8), lambda i: (x[i] - list_avg(x)) * (x[i + 5] - list_avg(x)))) / (7 * list_var_pop(x)) AS revenue_ts_autocorrelation__lag_5
             FROM win WHERE n = 12 AND first_filed >= make_date(calendarYear - 4, 1, 1) AND calendarYear BETWEEN 1998 AND 2000
               AND (calendarYear, symbol) IN (SELECT (y, symbol) FROM liq))
""".replace("list_var_pop(x)", "list_aggregate(x, 'var_pop')")

_FEATURES_SQL = f"""({_FEATURES_BASE}
    SELECT symbol, calendarYear, period, ordinal, date AS report_date, rebalance_date, s.sector, {", ".join(_robust(c) for c in _SCALED)}
    FROM feat JOIN (SELECT symbol, sector FROM fx_symbol) s USING (symbol))"""

_DATASET_SQL = f"""(SELECT *, price_dev - avg(price_dev) OVER (PARTITION BY ordinal) AS price_dev_subavg,
      price_dev - avg(price_dev) OVER (PARTITION BY ordinal, sector) AS sec_price_dev_subavg
    FROM {_FEATURES_SQL} f JOIN (SELECT symbol, date AS rebalance_date, lead(close) OVER w / close - 1 AS price_dev FROM fx_price
      WHERE date IN (SELECT DISTINCT date FROM (SELECT as_of, max(date) AS date FROM
        (SELECT CAST(unnest(generate_series(DATE '1995-01-01', least(DATE '2000-12-31', (SELECT max(date) FROM fx_price)), INTERVAL 3 MONTH)) AS DATE) AS as_of)
        JOIN (SELECT DISTINCT date FROM fx_price) ON date BETWEEN as_of - 10 AND as_of GROUP BY as_of))
      WINDOW w AS (PARTITION BY symbol ORDER BY date)) USING (symbol, rebalance_date))"""


@query(
    "e17_ml_dataset",
    "symbol:i calendarYear:i period:s report_date:d rebalance_date:d sector:s "
    + " ".join(f"{c}:f" for c in _SCALED)
    + " price_dev:f price_dev_subavg:f sec_price_dev_subavg:f",
    f"SELECT * FROM {_DATASET_SQL}",
)
def _(t):
    return build_dataset(t)[1]


@query(
    "e17_ml_dataset_trailing",
    "symbol:i calendarYear:i period:s rebalance_date:d margin:f price_dev:f price_dev_subavg:f sec_price_dev_subavg:f",
    "SELECT * FROM " + _DATASET_SQL.replace("lead(close) OVER w / close - 1 AS price_dev", "close / lag(close) OVER w - 1 AS price_dev"),
)
def _(t):
    return build_dataset(t, "trailing")[1]


@query(
    "e17_ml_features",
    "symbol:i calendarYear:i period:s report_date:d sector:s margin:f revenue_ts_mean:f margin_ts_maximum:f",
    f"SELECT * FROM {_FEATURES_SQL}",
)
def _(t):
    path = scratch_path(t.spark, "features")
    ml_dataset.write_dataset(build_dataset(t)[0], path)
    return t.spark.read.parquet(path).withColumnsRenamed({"year": "calendarYear", "quarter": "period"})


# Scaled by a spread of rounding errors: the deviation over itself.
_NOISE = {"autocorrelation__lag_0"}
_LONG_FEATURES = {k: v for k, v in (_SQL_FEATURES | _SQL_FEATURES_2).items() if keep_feature(k) and k not in _NOISE}
_LONG_FEATURES = {k: v for k, v in _LONG_FEATURES.items() if not k.startswith("fft") or k.endswith("__coeff_0")}

_LONG_SQL = f"""WITH rows_ AS ({_FEATURES_BASE} SELECT * FROM feat),
    vals AS (SELECT symbol, ordinal, unnest([{", ".join(f"'{k}'" for k in _TIME_COLUMNS)}]) AS kind,
                    unnest([{", ".join(f"w_{k}" for k in _TIME_COLUMNS)}]) AS x FROM rows_),
    full_windows AS (SELECT symbol, ordinal, kind, unnest(x) AS v, unnest(range(12)) AS i FROM vals
                     WHERE list_bool_and(list_transform(x, lambda e: isfinite(e)))),
    r AS (SELECT *, {", ".join(f"lead(v, {k}) OVER w AS l{k}" for k in (1, 2, 3, 4, 5, 6, 9))},
            {", ".join(f"lag(v, {k}) OVER w AS b{k}" for k in range(1, 6))},
            avg(v) OVER p AS m, stddev_pop(v) OVER p AS sd, min(v) OVER p AS mn, max(v) OVER p AS mx, median(v) OVER p AS md,
            sum(abs(v)) OVER w / sum(abs(v)) OVER p AS mass
          FROM full_windows WINDOW w AS (PARTITION BY symbol, ordinal, kind ORDER BY i), p AS (PARTITION BY symbol, ordinal, kind)),
    f AS (SELECT symbol, ordinal, kind, {", ".join(f'CAST({e} AS DOUBLE) AS "{n.replace(chr(34), chr(34) * 2)}"' for n, e in _LONG_FEATURES.items())}
          FROM r GROUP BY ALL),
    l AS (UNPIVOT f ON COLUMNS(* EXCLUDE (symbol, ordinal, kind)) INTO NAME feature VALUE value),
    q AS (SELECT ordinal, kind, feature, quantile_cont(value, 0.25) AS lo, quantile_cont(value, 0.5) AS mid, quantile_cont(value, 0.75) AS hi FROM l GROUP BY ALL)
    SELECT symbol, ordinal, kind || '_ts_' || feature AS name, sign(z) * ln(1 + abs(z)) AS scaled
    FROM (SELECT *, (value - mid) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END AS z FROM l JOIN q USING (ordinal, kind, feature))"""


@query("e17_ml_dataset_long", "symbol:i ordinal:i name:s scaled:g", _LONG_SQL)
def _(t):
    """Every kind and feature of tiers one and two that SQL states, as rows."""
    out, _, names = build_dataset(t, vectors=True)
    wanted = {f"{k}_ts_{f}" for k in _TIME_COLUMNS for f in _LONG_FEATURES}
    long = features.vectors_long(out, ["symbol", "ordinal"], names).where(F.col("name").isin(sorted(wanted)) & F.col("value").isNotNull())
    return long.withColumn("scaled", F.signum("value") * F.log1p(F.abs("value")))


@query(
    "e17_fresh_names",
    "symbol:i ordinal:i n:i fresh:i",
    f"WITH rows_ AS ({_FEATURES_BASE} SELECT * FROM feat) SELECT symbol, ordinal, {len(_TIME_COLUMNS)} AS n, 1 AS fresh FROM rows_",
)
def _(t):
    """The naming of the first generation: one mean per time column and filing."""
    out = build_dataset(t, feature_names=["mean"], marker="{kind}_fresh_{feature}")[0]
    fresh = [c for c in out.columns if "_fresh_" in c]
    have = sum(F.col(c).isNotNull().cast("int") for c in fresh)
    return out.withColumn("n", have).withColumn("fresh", F.lit(int(fresh == [f"{k}_fresh_mean" for k in _TIME_COLUMNS])))


_PLANS = (ranking.Plan("revenue_sorted", 10.0), ranking.Plan("netDebt_sorted", 10.0), ranking.Plan("OverMC_revenue_sorted", 10.0))
_SETTINGS = replay.ReplaySettings(1996, 2001, 3, 0, top_k=8, members=4, liquid=0.5)


def run_replay(t):
    """The whole replay on the panel, with a market cap of price times a share count."""
    prices = t.price.withColumn("marketCap", F.col("close") * (1000 + F.col("symbol") % 7 * 500))
    table, quotes = replay.date_table(
        t.symbol, prices, t.filing, _SETTINGS, ["revenue"], {"revenue": "high", "netDebt": "low"}
    )
    table = table.withColumn("OverMC_revenue_sorted", F.col("OverMC_revenue"))
    return replay.replay(table, quotes, _PLANS, _SETTINGS)


_UNIVERSE_SQL = """(SELECT d.as_of, p.symbol, d.trade_date, p.close, f.revenue, f.netDebt,
       revenue / (close * (1000 + p.symbol % 7 * 500)) AS over
    FROM (SELECT as_of, max(date) AS trade_date FROM cal JOIN (SELECT DISTINCT date FROM fx_price) ON date BETWEEN as_of - 10 AND as_of GROUP BY as_of) d
    JOIN fx_price p ON p.date = d.trade_date
    JOIN fx_symbol s ON s.symbol = p.symbol AND (s.delistedDate IS NULL OR s.delistedDate >= d.as_of)
    JOIN (SELECT as_of, symbol, revenue, netDebt FROM cal JOIN fx_filing ON fillingDate BETWEEN CAST(as_of - INTERVAL 6 MONTH AS DATE) AND as_of
          QUALIFY row_number() OVER (PARTITION BY as_of, symbol ORDER BY fillingDate DESC, date DESC) = 1) f
      ON f.as_of = d.as_of AND f.symbol = p.symbol
    QUALIFY rank() OVER (PARTITION BY d.as_of ORDER BY close * volume DESC) <= floor(count(*) OVER (PARTITION BY d.as_of) * 0.5))"""


def _points(key: str) -> str:
    rank = f"rank() OVER (PARTITION BY as_of ORDER BY {key} DESC NULLS LAST)"
    return f"CASE WHEN {rank} <= 8 THEN 100 - ({rank} - 1) * 10 ELSE 0 END"


_REPLAY_SQL = f"""(WITH cal AS (SELECT CAST(unnest(generate_series(DATE '1996-01-01', least(DATE '2001-12-31', (SELECT max(date) FROM fx_price)), INTERVAL 3 MONTH)) AS DATE) AS as_of),
    u AS (SELECT *, CASE WHEN netDebt >= 0 THEN -netDebt ELSE netDebt - max(netDebt) OVER (PARTITION BY as_of) END AS debt FROM {_UNIVERSE_SQL}),
    sc AS (SELECT *, {_points("revenue")} + {_points("debt")} + {_points("over")} AS score FROM u),
    pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY score DESC, symbol) AS rn, max(as_of) OVER () AS newest FROM sc)
           WHERE rn <= 8 AND (rn <= 4 OR as_of < newest)),
    pr AS (SELECT as_of AS period_start, lead(as_of) OVER w AS period_end, trade_date AS buy_date, lead(trade_date) OVER w AS sell_date
           FROM (SELECT DISTINCT as_of, trade_date FROM u) WINDOW w AS (ORDER BY as_of)),
    held AS (SELECT period_start, period_end, k.symbol, rn, b.close AS price, s.close AS sell FROM pk k JOIN pr ON period_start = k.as_of
             JOIN fx_price b ON b.symbol = k.symbol AND b.date = buy_date JOIN fx_price s ON s.symbol = k.symbol AND s.date = sell_date
             WHERE s.close > 1e-6 QUALIFY row_number() OVER (PARTITION BY period_start ORDER BY rn, k.symbol) <= 4),
    er AS (SELECT period_start, period_end, sum(gain) AS return FROM (
             SELECT *, (sell - price) / price / count(*) OVER (PARTITION BY period_start) AS gain FROM held) GROUP BY ALL)
    SELECT period_start, period_end, return, 100 * product(1 + return) OVER (ORDER BY period_start) AS accumulated FROM er)"""


@query("flagship_replay", "period_start:d period_end:d return:f log_accumulated:f", f"SELECT *, ln(accumulated) AS log_accumulated FROM {_REPLAY_SQL}")
def flagship(t):
    return run_replay(t)[1].withColumn("log_accumulated", F.ln("accumulated"))
