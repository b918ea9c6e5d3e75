"""Queries for ranking, scoring and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.catalog.asof_queries import PANEL_SQL, panel
from panelwright.catalog.registry import query
from panelwright.operators import asof, ranking
from panelwright.operators.ranking import Plan
from panelwright.session import stage

K, BASE = 5, 100.0
PLANS = (Plan("revenue", 10.0, 2.0), Plan("neg_debt", 15.0, 1.0), Plan("volume", 20.0, 0.5))

KEYED_SQL = f"""(SELECT *, CASE WHEN symbol % 6 <> 0 THEN -netDebt END AS neg_debt FROM {PANEL_SQL})"""


def keyed(t):
    """The panel with a metric that has nulls, and volume, which has ties."""
    return panel(t).withColumn("neg_debt", F.when(F.col("symbol") % 6 != 0, -F.col("netDebt")))


def _rank_sql(key: str) -> str:
    return f"rank() OVER (PARTITION BY as_of ORDER BY {key} DESC NULLS LAST)"


def _score_sql(key: str, diff: float) -> str:
    return f"CASE WHEN {_rank_sql(key)} <= {K} THEN {BASE} - ({_rank_sql(key)} - 1) * {diff} ELSE 0 END"


@query(
    "f1_plan_score",
    "as_of:d symbol:i neg_debt_rank:i neg_debt_score:f",
    f"SELECT as_of, symbol, {_rank_sql('neg_debt')} AS neg_debt_rank, {_score_sql('neg_debt', 15)} AS neg_debt_score FROM {KEYED_SQL}",
)
def _(t):
    return ranking.plan_score(keyed(t), "neg_debt", K, BASE, 15.0, all_ranks=True)


@query(
    "f1_plan_score_top",
    "as_of:d symbol:i volume_score:f",
    f"SELECT as_of, symbol, {_score_sql('volume', 20)} AS volume_score FROM {KEYED_SQL}",
)
def _(t):
    return ranking.plan_score(keyed(t), "volume", K, BASE, 20.0)


@query(
    "f2_plan_score_weighted",
    "as_of:d symbol:i volume_score:f volume_rank:i",
    f"""SELECT as_of, symbol, CASE WHEN rn <= {K} THEN 0.5 * (100 - (rn - 1) * 20) ELSE 0 END AS volume_score,
        CASE WHEN rn <= {K} THEN rn ELSE -1 END AS volume_rank
        FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY volume DESC NULLS LAST, symbol) AS rn FROM {PANEL_SQL})""",
)
def _(t):
    return ranking.plan_score_weighted(panel(t), "volume", K, BASE, 20.0, 0.5)


SCORED_SQL = f"""(SELECT *, {" + ".join(_score_sql(p.key, p.diff) for p in PLANS)} AS score FROM {KEYED_SQL})"""


def scored(t):
    return ranking.total_score(stage(keyed(t)), PLANS, K, BASE)


@query("f3_total_score", "as_of:d symbol:i score:f", f"SELECT as_of, symbol, score FROM {SCORED_SQL}")
def _(t):
    return scored(t)


@query(
    "f4_check_plan",
    "key:s diff:f too_big:i limit:f",
    'SELECT p_brand AS "key", max(p_size) AS diff, 100 - max(p_size) * 2 < 0 AS too_big, 50 AS "limit" FROM part GROUP BY p_brand',
)
def _(t):
    plans = t.raw("part").groupBy(F.col("p_brand").alias("key")).agg(F.max("p_size").cast("double").alias("diff"))
    return ranking.check_plan_table(plans, 2, 100.0)


PICKS_SQL = f"""(SELECT * FROM (SELECT as_of, symbol, score, row_number() OVER (PARTITION BY as_of ORDER BY score DESC, symbol) AS rn,
      max(as_of) OVER () AS newest FROM {SCORED_SQL}) WHERE rn <= 6 AND (rn <= 3 OR as_of < newest))"""


def picked(t):
    return ranking.picks(scored(t), 3).select("as_of", "symbol", "score", "rn")


@query("f5_top_n", "as_of:d symbol:i score:f rn:i", f"SELECT as_of, symbol, score, rn FROM {PICKS_SQL}")
def _(t):
    return picked(t)


@query(
    "f6_rank_columns",
    "id:i cohort:i p0_rank:i amount_rank:i gap_rank:i",
    """SELECT id, cohort, count(*) OVER (PARTITION BY cohort ORDER BY p0 DESC) AS p0_rank,
         count(*) OVER (PARTITION BY cohort ORDER BY amount DESC) AS amount_rank,
         CASE WHEN gap IS NOT NULL THEN count(gap) OVER (PARTITION BY cohort ORDER BY gap DESC NULLS LAST) END AS gap_rank
       FROM (SELECT *, CASE WHEN id % 5 <> 0 THEN p1 END AS gap FROM fx_prediction)""",
)
def _(t):
    df = t.prediction.withColumn("gap", F.when(F.col("id") % 5 != 0, F.col("p1")))
    return ranking.rank_columns(df, ["p0", "amount", "gap"], ["cohort"], ["id"])


_STAT_KEYS = ("p0", "p1", "p2", "p3", "pred0", "pred1", "ret", "amount", "gap", "id")
RANK_STATS_SQL = """(SELECT m || '_sorted_rank' AS "column", m AS "key",
      count(*) FILTER (v IS NULL OR v = 0) AS empty, count(*) FILTER (v = 0) AS zero, var_samp(v) AS var, avg(v) AS avg
    FROM (SELECT unnest(['p0','p1','p2','p3','pred0','pred1','ret','amount','gap','id']) AS m,
                 unnest([floor(p0 * 100), floor(p1 * 100), p2*50, p3*1000, pred0, pred1, ret, amount, CASE WHEN id % 3 <> 0 THEN p0 END, id % 40]) AS v
          FROM fx_prediction QUALIFY row_number() OVER (PARTITION BY cohort ORDER BY ret DESC, id) <= 100)
    GROUP BY m)"""


def rank_statistics(t):
    values = {
        "p0": F.floor(F.col("p0") * 100),
        "p1": F.floor(F.col("p1") * 100),
        "p2": F.col("p2") * 50,
        "p3": F.col("p3") * 1000,
        "pred0": F.col("pred0"),
        "pred1": F.col("pred1"),
        "ret": F.col("ret"),
        "amount": F.col("amount"),
        "gap": F.when(F.col("id") % 3 != 0, F.col("p0")),
        "id": F.col("id") % 40,
    }
    reports = t.prediction.select(
        "cohort", "id", F.col("ret").alias("gain"), *[v.alias(f"{k}_sorted_rank") for k, v in values.items()]
    )
    return ranking.rank_stats(
        reports, [f"{k}_sorted_rank" for k in _STAT_KEYS], [("gain", False), ("id", True)], "cohort"
    )


@query("f7_rank_stats", "column:s key:s empty:i zero:i var:g avg:g", f"SELECT * FROM {RANK_STATS_SQL}")
def _(t):
    return rank_statistics(t)


@query(
    "f8_weights_from_ranks",
    "key:s weight:f key_dir:s diff:s base:s base_dir:s",
    f"""WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY empty, "column") AS rn, count(*) OVER () AS n FROM {RANK_STATS_SQL}) WHERE rn <= floor(n * 0.8)),
        b AS (SELECT * FROM (SELECT * EXCLUDE (rn, n), row_number() OVER (ORDER BY avg, "column") AS rn, count(*) OVER () AS n FROM a) WHERE rn <= floor(n * 0.5)),
        c AS (SELECT *, count(*) OVER (ORDER BY avg) AS ar FROM b),
        d AS (SELECT *, 20 - (var - min(var) OVER ()) / (max(var) OVER () - min(var) OVER ()) * 10
                    - (ar - min(ar) OVER ()) / (max(ar) OVER () - min(ar) OVER ()) * 10 AS wb FROM c)
        SELECT "key", (wb - min(wb) OVER ()) / (max(wb) OVER () - min(wb) OVER ()) * 10 AS weight,
               'low' AS key_dir, '10' AS diff, '>' AS base, '0' AS base_dir FROM d""",
)
def _(t):
    return ranking.weights_from_ranks(rank_statistics(t), lowest_rank=0.5)


_GATES = {f"g{i}": f"p{i}" for i in range(4)}
GATED_SQL = (
    "(SELECT *, "
    + ", ".join(f"CASE WHEN p{i} > quantile_cont(p{i}, 0.92) OVER (PARTITION BY cohort) THEN 1 ELSE 0 END AS g{i}" for i in range(4))
    + " FROM fx_prediction)"
)


def gated(t):
    return ranking.percentile_gates(t.prediction, _GATES)


@query("f9_percentile_gate", "id:i cohort:i g0:i g1:i g2:i g3:i", f"SELECT * FROM {GATED_SQL}")
def _(t):
    return gated(t)


_RULES = {
    "wbinary_0": "g0 = 1",
    "wbinary_1": "g1 = 1",
    "wbinary_2": "g2 = 1",
    "wbinary_3": "g3 = 1",
    "wbinary_ensemble": "g1 = 1 AND g3 = 1",
    "wbinary_ensemble2": "g1 = 1 AND g2 = 1",
    "wbinary_ensemble3": "g1 + g2 + g3 >= 2",
}
VARIANTS = [f"pred{i}" for i in (0, 1)] + [f"pred{i}_{r}" for i in (0, 1) for r in _RULES]
PREDICTED_SQL = (
    "(SELECT *, "
    + ", ".join(f"CASE WHEN {e} THEN pred{i} ELSE -1 END AS pred{i}_{n}" for i in (0, 1) for n, e in _RULES.items())
    + f", (pred0 + pred1) / 2 AS ai_pred_avg, abs(ret - (pred0 + pred1) / 2) AS ai_pred_avg_loss FROM {GATED_SQL})"
)


def predicted(t):
    both = ranking.gate_predictions(gated(t), ["pred0", "pred1"], ["g0", "g1", "g2", "g3"])
    return ranking.average_models(both, ["pred0", "pred1"], "ret")


@query("f10_gate_predictions", "id:i " + " ".join(f"{v}:f" for v in VARIANTS), f"SELECT * FROM {PREDICTED_SQL}")
def _(t):
    return predicted(t)


@query("f11_average_models", "id:i ai_pred_avg:f ai_pred_avg_loss:f", f"SELECT * FROM {PREDICTED_SQL}")
def _(t):
    return ranking.average_models(t.prediction, ["pred0", "pred1"], "ret")


EVALUATED = [*VARIANTS, "ai_pred_avg"]


def topk_sql(by: str, slices, columns, source: str) -> str:
    names = ", ".join(f"'{c}'" for c in columns)
    return f"""SELECT {by}, model, s || '~' || e AS krange, sum(ret) / (e - s + 1) AS avg_earning_per_stock,
        sum(pred) / (e - s + 1) AS cur_model_pred, abs(sum(pred) / (e - s + 1) - sum(ret) / (e - s + 1)) AS loss_y_and_pred,
        sum(pred) / (e - s + 1) > 0 AS cur_model_pred_ispositive
      FROM (SELECT *, row_number() OVER (PARTITION BY {by}, model ORDER BY pred DESC, id) - 1 AS rn
            FROM (SELECT {by}, id, ret, unnest([{names}]) AS model, unnest([{", ".join(columns)}]) AS pred FROM {source})),
           (VALUES {", ".join(f"({s}, {e})" for s, e in slices)}) v(s, e)
      WHERE rn BETWEEN s AND e GROUP BY {by}, model, s, e"""


EVAL_COLUMNS = "model:s krange:s avg_earning_per_stock:f cur_model_pred:f loss_y_and_pred:f cur_model_pred_ispositive:i"


@query("f12_topk_eval", f"cohort:i {EVAL_COLUMNS}", topk_sql("cohort", ranking.TOP_SLICES, EVALUATED, PREDICTED_SQL))
def _(t):
    return ranking.topk_eval(predicted(t), EVALUATED, "ret")


@query(
    "f13_topk_by_sector",
    f"cohort:i sector:s {EVAL_COLUMNS}",
    topk_sql("cohort, sector", ranking.SECTOR_SLICES, ("pred0", "pred1"), "fx_prediction"),
)
def _(t):
    return ranking.topk_by_sector(t.prediction, ["pred0", "pred1"], "ret")


@query(
    "f13_latest_sector_picks",
    "sector:s id:i pred0:f rn:i",
    """SELECT *, row_number() OVER (PARTITION BY sector ORDER BY pred0 DESC, id) AS rn FROM fx_prediction
       WHERE cohort = (SELECT max(cohort) FROM fx_prediction) QUALIFY rn <= 4""",
)
def _(t):
    return ranking.latest_sector_picks(t.prediction, "pred0", 4)


@query(
    "f13_latest_sector_report",
    "k:i sector:s model:s i:i id:i pred:f",
    """SELECT e - s AS k, sector, model, rn - s AS i, id, pred FROM (
         SELECT *, row_number() OVER (PARTITION BY sector, model ORDER BY pred DESC, id) - 1 AS rn FROM (
           SELECT sector, id, unnest(['pred0', 'pred1']) AS model, unnest([pred0, pred1]) AS pred FROM fx_prediction
           WHERE cohort = (SELECT max(cohort) FROM fx_prediction))), (VALUES (0, 3), (0, 7), (0, 15)) v(s, e)
       WHERE rn BETWEEN s AND e""",
)
def _(t):
    return ranking.latest_sector_report(t.prediction, ["pred0", "pred1"])


@query(
    "f14_latest_per_symbol",
    "symbol:i ordinal:i revenue:f",
    """SELECT *, calendarYear * 4 + CAST(period[2] AS INTEGER) AS ordinal FROM fx_income
       QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ordinal DESC) = 1""",
)
def _(t):
    return ranking.latest_per_symbol(asof.fiscal_ordinal(t.income))


_SELECTED_SQL = "(SELECT * FROM fx_prediction WHERE id % 3 <> 0 ORDER BY p0 DESC, id LIMIT 40)"


def _selected(t):
    scores = t.prediction.withColumn("predicted_score", F.when(F.col("id") % 3 != 0, F.col("p0")))
    return ranking.select_across_sectors(scores, 40, ids=["id"])


@query("f15_select_across_sectors", "id:i sector:s predicted_score:f", f"SELECT id, sector, p0 AS predicted_score FROM {_SELECTED_SQL}")
def _(t):
    return _selected(t)


@query("f15_sector_distribution", "sector:s n:i share:f", f"SELECT sector, count(*) AS n, count(*) / 40 AS share FROM {_SELECTED_SQL} GROUP BY sector")
def _(t):
    return ranking.sector_distribution(_selected(t))
