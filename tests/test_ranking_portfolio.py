from datetime import date

import pytest
from pyspark.sql import functions as F

from panelwright.operators import portfolio, ranking
from panelwright.operators.ranking import Plan


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(1, "a", 9.0), (1, "b", 7.0), (1, "c", 7.0), (1, "d", 5.0), (1, "e", None), (1, "f", None), (2, "a", None), (2, "b", None)]
    return spark.createDataFrame(rows, "as_of int, symbol string, m double")


@pytest.mark.parametrize("all_ranks", [True, False])
def test_plan_score_ties_and_nulls(scores, all_ranks):
    got = {(r.as_of, r.symbol): (r.m_rank, r.m_score) for r in ranking.plan_score(scores, "m", 3, 10.0, 2.0, all_ranks=all_ranks).collect()}
    beyond = {4: 4, 5: 5} if all_ranks else {4: None, 5: None}
    assert got == {
        (1, "a"): (1, 10.0), (1, "b"): (2, 8.0), (1, "c"): (2, 8.0), (1, "d"): (beyond[4], 0.0),
        (1, "e"): (beyond[5], 0.0), (1, "f"): (beyond[5], 0.0), (2, "a"): (1, 10.0), (2, "b"): (1, 10.0),
    }


def test_plan_score_weighted_takes_exactly_k(scores):
    got = {(r.as_of, r.symbol): (r.m_rank, r.m_score) for r in ranking.plan_score_weighted(scores, "m", 2, 10.0, 2.0, 0.5).collect()}
    assert got[(1, "b")] == (2, 4.0) and got[(1, "c")] == (-1, 0.0) and got[(1, "a")] == (1, 5.0)
    assert got[(2, "a")] == (1, 5.0) and got[(2, "b")] == (2, 4.0)


def test_total_score_is_the_sum_of_plans(scores):
    df = scores.withColumn("n", -F.coalesce("m", F.lit(6.0)))
    plans = [Plan("m", 2.0), Plan("n", 1.0)]
    total = {(r.as_of, r.symbol): r.score for r in ranking.total_score(df, plans, 3, 10.0).collect()}
    one = ranking.plan_score(ranking.plan_score(df, "m", 3, 10.0, 2.0), "n", 3, 10.0, 1.0)
    assert total == {(r.as_of, r.symbol): r.m_score + r.n_score for r in one.collect()}


def test_check_plans():
    assert ranking.check_plans([Plan("a", 10.0), Plan("b", 11.0)], 10, 100.0) == [Plan("b", 11.0)]


def test_rank_columns_worst_rank(scores):
    got = {(r.as_of, r.symbol): r.m_rank for r in ranking.rank_columns(scores, ["m"]).collect()}
    assert got == {(1, "a"): 1, (1, "b"): 3, (1, "c"): 3, (1, "d"): 4, (1, "e"): None, (1, "f"): None, (2, "a"): None, (2, "b"): None}


def test_picks_keep_reserves_except_at_the_newest_date(spark):
    df = spark.createDataFrame([(d, f"s{i}", float(i)) for d in (1, 2) for i in range(9)], "as_of int, symbol string, score double")
    counts = {r.as_of: r["count"] for r in ranking.picks(df, 3).groupBy("as_of").count().collect()}
    assert counts == {1: 6, 2: 3}


def test_gate_size_bound_and_strictness(spark):
    df = spark.createDataFrame([(i, 1, i / 49) for i in range(49)] + [(100 + i, 2, 0.5) for i in range(9)], "id int, cohort int, p double")
    got = {r.cohort: r.g for r in ranking.percentile_gates(df, {"gate": "p"}).groupBy("cohort").agg(F.sum("gate").alias("g")).collect()}
    assert got == {1: 4, 2: 0}


def test_topk_slice_divides_by_its_size(spark):
    df = spark.createDataFrame([(1, i, float(i), 0.5) for i in range(2)], "cohort int, id int, pred double, ret double")
    row = ranking.topk_eval(df, ["pred"], "ret", [(0, 3)]).head()
    assert (row.krange, row.avg_earning_per_stock, row.cur_model_pred) == ("0~3", 0.25, 0.25)


def day(i):
    return date(2020, i, 1)


def test_attach_prices_zero_fill_and_dead_names(spark):
    picks = spark.createDataFrame([(day(1), s, i) for i, s in enumerate("abcd", 1)], "as_of date, symbol string, rn int")
    dates = spark.createDataFrame([(day(1), day(1)), (day(2), day(2))], "as_of date, trade_date date")
    prices = spark.createDataFrame(
        [("a", day(1), 10.0), ("a", day(2), 11.0), ("b", day(2), 5.0), ("c", day(1), 1.0), ("d", day(1), 4.0), ("d", day(2), 2.0)],
        "symbol string, date date, close double",
    )
    held = portfolio.attach_prices(picks, portfolio.holding_periods(dates), prices, 2)
    assert {r.symbol: (r.price, r.rebalance_day_price) for r in held.collect()} == {"a": (10.0, 11.0), "b": (0.0, 5.0)}
    weighted = portfolio.equal_weight(held, 100.0)
    assert {r.symbol: r["count"] for r in weighted.collect()} == {"a": 5.0, "b": 0.0}
    assert portfolio.period_earnings(weighted, 100.0).head()["return"] == pytest.approx(0.05)


def test_compound_with_total_loss(spark):
    df = spark.createDataFrame([(1, 0.5), (2, -1.0), (3, 4.0)], "period_start int, return double")
    assert [r.accumulated for r in portfolio.compound(df).orderBy("period_start").collect()] == pytest.approx([150, 0, 0])
    odd = spark.createDataFrame([(1, -3.0), (2, -2.0), (3, -1.5)], "period_start int, return double")
    assert [r.accumulated for r in portfolio.compound(odd).orderBy("period_start").collect()] == pytest.approx([-200, 200, -100])


def test_return_metrics_and_empty_strategy(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, -50.0), ("a", 3, 20.0)], "strategy string, period_start int, return_pct double")
    names = spark.createDataFrame([("a",), ("none",)], "strategy string")
    got = {r.strategy: r for r in portfolio.return_metrics(df, F.lit(6), strategies=names).collect()}
    a = got["a"]
    assert a.total_return == pytest.approx(-34.0)
    assert a.annualized_return == pytest.approx(((0.66) ** (1 / 1.5) - 1) * 100)
    assert a.max_drawdown == pytest.approx(50.0)
    assert a.win_rate == pytest.approx(200 / 3)
    assert (got["none"].num_trades, got["none"].sharpe_ratio) == (0, 0)


def test_range_drawdown(spark):
    df = spark.createDataFrame([(day(1), 50.0), (day(2), 100.0)], "date date, value double")
    row = portfolio.range_drawdown(df).head()
    assert (row.mdd, row.best_date, row.worst_date) == (-50.0, day(2), day(1))
