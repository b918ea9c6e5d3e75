"""Queries for portfolio arithmetic (G1-G11) and reports."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import functions as F

from panelwright.catalog.asof_queries import CAL_SQL, PANEL_SQL, calendar, panel
from panelwright.catalog.ranking_queries import PICKS_SQL, picked
from panelwright.catalog.registry import query
from panelwright.operators import asof, portfolio
from panelwright.operators.features import price_return
from panelwright.session import scratch_path, stage
from panelwright.sources import tables

PERIODS_SQL = f"""(SELECT as_of AS period_start, lead(as_of) OVER w AS period_end, trade_date AS buy_date, lead(trade_date) OVER w AS sell_date
    FROM (SELECT as_of, max(date) AS trade_date FROM {CAL_SQL} JOIN (SELECT DISTINCT date FROM fx_price) p
          ON date BETWEEN as_of - 10 AND as_of GROUP BY as_of) WINDOW w AS (ORDER BY as_of)
    QUALIFY period_end IS NOT NULL)"""

# The sparse test market rarely trades a name on both ends, so the query looks up
# each name's price within the tolerance of the date.
NEAR_SQL = f"""(SELECT k.symbol, k.trade_date AS date, p.close FROM
    (SELECT symbol, trade_date FROM (SELECT DISTINCT symbol FROM fx_price),
       (SELECT as_of, max(date) AS trade_date FROM {CAL_SQL} JOIN (SELECT DISTINCT date FROM fx_price) p
          ON date BETWEEN as_of - 10 AND as_of GROUP BY as_of)) k
    ASOF JOIN fx_price p ON k.symbol = p.symbol AND p.date <= k.trade_date WHERE p.date >= k.trade_date - 10)"""


def periods(t):
    return portfolio.holding_periods(asof.trade_dates(calendar(t), t.days))


def near_prices(t):
    """Prices seen from each trade date: the newest within ten days."""
    dates = asof.trade_dates(calendar(t), t.days).select(F.col("trade_date").alias("as_of"))
    near = asof.trade_dates_by_symbol(dates, t.price)
    return near.select("symbol", F.col("as_of").alias("date"), "close")


HELD_SQL = f"""(SELECT period_start, period_end, buy_date, sell_date, symbol, score, rn, price, rebalance_day_price FROM (
    SELECT p.*, k.symbol, k.score, k.rn, coalesce(b.close, 0) AS price, coalesce(s.close, 0) AS rebalance_day_price
    FROM {PICKS_SQL} k JOIN {PERIODS_SQL} p ON p.period_start = k.as_of
    LEFT JOIN {NEAR_SQL} b ON b.symbol = k.symbol AND b.date = p.buy_date
    LEFT JOIN {NEAR_SQL} s ON s.symbol = k.symbol AND s.date = p.sell_date)
    WHERE rebalance_day_price > 1e-6 QUALIFY row_number() OVER (PARTITION BY period_start ORDER BY rn, symbol) <= 3)"""


def held(t):
    return portfolio.attach_prices(stage(picked(t)), periods(t), near_prices(t), 3)


@query(
    "g1_attach_prices",
    "period_start:d period_end:d symbol:i rn:i price:f rebalance_day_price:f",
    f"SELECT * FROM {HELD_SQL}",
)
def _(t):
    return held(t)


RANKED_SQL = f"""(SELECT period_start, u.symbol, u.close, e.close AS rebalance_day_price, (e.close - u.close) / u.close AS period_price_diff,
      row_number() OVER (PARTITION BY period_start ORDER BY (e.close - u.close) / u.close DESC NULLS LAST, u.symbol) AS rn
    FROM (SELECT p.period_start, p.sell_date, symbol, close FROM {PANEL_SQL} JOIN {PERIODS_SQL} p ON period_start = as_of) u
    LEFT JOIN {NEAR_SQL} e ON e.symbol = u.symbol AND e.date = u.sell_date WHERE u.close > 1e-6 QUALIFY rn <= 10)"""


def ranked(t):
    spans = periods(t)
    universe = panel(t).select(F.col("as_of").alias("period_start"), "symbol", "close").join(
        spans.select("period_start"), "period_start"
    )
    ends = near_prices(t).join(spans, F.col("date") == F.col("sell_date")).select("period_start", "symbol", "close")
    return portfolio.period_returns(universe, ends, 10)


@query(
    "g2_period_returns",
    "period_start:d symbol:i close:f rebalance_day_price:f period_price_diff:f rn:i",
    f"SELECT * FROM {RANKED_SQL}",
)
def _(t):
    return ranked(t)


WEIGHTED_SQL = f"""(SELECT *, CASE WHEN price > 0 THEN 1e8 / count(*) OVER (PARTITION BY period_start) / price ELSE 0 END AS count,
      (rebalance_day_price - price) * CASE WHEN price > 0 THEN 1e8 / count(*) OVER (PARTITION BY period_start) / price ELSE 0 END AS period_earning
    FROM {HELD_SQL})"""


def weighted(t):
    return portfolio.equal_weight(held(t))


@query(
    "g3_equal_weight",
    "period_start:d symbol:i count:f period_earning:g",
    f"SELECT * FROM {WEIGHTED_SQL}",
)
def _(t):
    return weighted(t)


EARNED_SQL = f"""(SELECT period_start, period_end, sum(period_earning) AS earning, sum(period_earning) / 1e8 AS return
    FROM {WEIGHTED_SQL} GROUP BY period_start, period_end HAVING sum(price * count) <> 0)"""


def earned(t):
    return portfolio.period_earnings(weighted(t))


@query("g3_period_earnings", "period_start:d period_end:d earning:g return:f", f"SELECT * FROM {EARNED_SQL}")
def _(t):
    return earned(t)


COMPOUND_SQL = f"""(SELECT *, 100 * product(1 + return) OVER (ORDER BY period_start) AS accumulated,
      product(1 + return) OVER (ORDER BY period_start) - 1 AS total_return FROM {EARNED_SQL})"""


# The test market compounds to astronomic totals, so running values are compared as logarithms.
@query("g4_compound", "period_start:d return:f log_accumulated:f", f"SELECT *, ln(accumulated) AS log_accumulated FROM {COMPOUND_SQL}")
def _(t):
    return portfolio.compound(earned(t)).withColumn("log_accumulated", F.ln("accumulated"))


@query(
    "g5_best_worst_period",
    "best:f best_period:d worst:f worst_period:d",
    f"""SELECT max(return) AS best, arg_max(period_start, return) AS best_period, min(return) AS worst,
        arg_min(period_start, return) AS worst_period FROM {EARNED_SQL}""",
)
def _(t):
    return portfolio.best_worst_period(earned(t))


@query(
    "g6_benchmark_return",
    "symbol:i benchmark_return:f",
    """WITH d AS (SELECT (SELECT max(date) FROM fx_price WHERE date BETWEEN DATE '1998-12-22' AND DATE '1999-01-01') AS d0,
                         coalesce((SELECT max(date) FROM fx_price WHERE date BETWEEN DATE '2001-12-21' AND DATE '2001-12-31'),
                                  (SELECT max(date) FROM fx_price)) AS d1)
       SELECT symbol, coalesce(max((b.close - a.close) / a.close), 0) AS benchmark_return
       FROM fx_symbol LEFT JOIN (SELECT p.* FROM fx_price p, d WHERE date = d0) a USING (symbol)
       LEFT JOIN (SELECT p.* FROM fx_price p, d WHERE date = d1) b USING (symbol) GROUP BY symbol""",
)
def _(t):
    return portfolio.benchmark_return(t.price, t.symbol, Date(1999, 1, 1), Date(2001, 12, 31))


DAILY_SQL = f"""(SELECT p.date, sum(count * close) AS value FROM {WEIGHTED_SQL} w JOIN fx_price p
      ON p.symbol = w.symbol AND p.date BETWEEN w.buy_date AND w.sell_date GROUP BY p.date)"""


def daily(t):
    return portfolio.daily_value(weighted(t), t.price)


@query("g7_daily_value", "date:d value:g", f"SELECT * FROM {DAILY_SQL}")
def _(t):
    return daily(t)


@query(
    "g8_range_drawdown",
    "mdd:f best_date:d worst_date:d",
    f"SELECT (min(value) / max(value) - 1) * 100 AS mdd, arg_max(date, value) AS best_date, arg_min(date, value) AS worst_date FROM {DAILY_SQL}",
)
def _(t):
    return portfolio.range_drawdown(daily(t))


# Every symbol as a strategy of its own: its percentage return between rebalance dates.
STRATEGY_SQL = f"""(SELECT symbol AS strategy, date AS period_start, (close - lag(close) OVER w) / lag(close) OVER w * 100 AS return_pct
    FROM {NEAR_SQL} WINDOW w AS (PARTITION BY symbol ORDER BY date) QUALIFY return_pct IS NOT NULL)"""


def strategy_returns(t):
    out = price_return(near_prices(t)).where(F.col("price_dev").isNotNull())
    return out.select(
        F.col("symbol").alias("strategy"), F.col("date").alias("period_start"), (F.col("price_dev") * 100).alias("return_pct")
    )


_PATH_SQL = f"""(SELECT *, max(v) OVER (PARTITION BY strategy ORDER BY period_start) AS top FROM (
    SELECT *, product(1 + return_pct / 100) OVER (PARTITION BY strategy ORDER BY period_start) AS v FROM {STRATEGY_SQL}))"""


@query("g9_drawdown", "strategy:i max_drawdown:f", f"SELECT strategy, abs(min((v - top) / top * 100)) AS max_drawdown FROM {_PATH_SQL} GROUP BY strategy")
def _(t):
    return portfolio.drawdown(strategy_returns(t))


_METRICS = "total_return:g annualized_return:g sharpe_ratio:f win_rate:f num_trades:i max_drawdown:f avg_return:f std_return:f"


def _metrics_sql(source: str, by: str, months: str, paths: str) -> str:
    return f"""SELECT a.*, (pow(1 + total_return / 100, 1 / (num_trades * {months} / 12)) - 1) * 100 AS annualized_return,
          CASE WHEN std_return > 0 THEN avg_return / std_return ELSE 0 END AS sharpe_ratio, max_drawdown
        FROM (SELECT {by}, (product(1 + return_pct / 100) - 1) * 100 AS total_return, avg(return_pct) AS avg_return,
                stddev_pop(return_pct) AS std_return, count(*) FILTER (return_pct > 0) / count(*) * 100 AS win_rate, count(*) AS num_trades
              FROM {source} GROUP BY {by}) a
        JOIN (SELECT {by}, abs(min((v - top) / top * 100)) AS max_drawdown FROM {paths} GROUP BY {by}) d USING ({by})"""


@query("g10_return_metrics", f"strategy:i {_METRICS}", _metrics_sql(STRATEGY_SQL, "strategy", "3", _PATH_SQL))
def _(t):
    return portfolio.return_metrics(strategy_returns(t), F.lit(3))


_SWEEP_SQL = """(SELECT period_months, period_start, avg((s.close - b.close) / b.close * 100) AS return_pct FROM (
      SELECT period_months, period_start, b.symbol, b.close AS bc, s.close AS sc,
        row_number() OVER (PARTITION BY period_months, period_start ORDER BY b.close * b.volume DESC, b.symbol) AS rn
      FROM (SELECT m AS period_months, as_of AS period_start, trade_date AS buy_date,
              lead(trade_date) OVER (PARTITION BY m ORDER BY as_of) AS sell_date
            FROM (SELECT as_of, max(date) AS trade_date FROM
                    (SELECT CAST(unnest(generate_series(DATE '1996-01-01', least(DATE '2001-12-31', (SELECT max(date) FROM fx_price)), INTERVAL 1 MONTH)) AS DATE) AS as_of)
                  JOIN (SELECT DISTINCT date FROM fx_price) ON date BETWEEN as_of - 10 AND as_of GROUP BY as_of),
                 (VALUES (1), (2), (3), (4), (6), (12)) v(m)
            WHERE ((year(as_of) - 1996) * 12 + month(as_of) - 1) % m = 0) p
      JOIN fx_price b ON b.date = buy_date JOIN fx_price s ON s.symbol = b.symbol AND s.date = sell_date)
    WHERE rn <= 5 GROUP BY period_months, period_start)""".replace(
    "avg((s.close - b.close) / b.close * 100)", "avg((sc - bc) / bc * 100)"
)
_SWEEP_PATH = f"""(SELECT *, max(v) OVER (PARTITION BY period_months ORDER BY period_start) AS top FROM (
    SELECT *, product(1 + return_pct / 100) OVER (PARTITION BY period_months ORDER BY period_start) AS v FROM {_SWEEP_SQL}))"""


@query(
    "g11_sweep_rebalance",
    f"period_months:i {_METRICS.replace('total_return:g', 'log_growth:f')}",
    f"SELECT *, ln(1 + total_return / 100) AS log_growth FROM ({_metrics_sql(_SWEEP_SQL, 'period_months', 'period_months', _SWEEP_PATH)}) WHERE num_trades >= 3",
)
def _(t):
    out = portfolio.sweep_rebalance(t.price, 1996, 2001)
    return out.withColumn("log_growth", F.ln(1 + F.col("total_return") / 100))


@query(
    "a14_write_reports",
    "report:s period_start:d n:i total:f",
    f"""SELECT 'eval_picks' AS report, period_start, count(*) AS n, sum(symbol) AS total FROM {WEIGHTED_SQL} GROUP BY period_start
        UNION ALL SELECT 'eval_periods', period_start, 1, ln(accumulated) FROM {COMPOUND_SQL}
        UNION ALL SELECT 'rank', period_start, count(*), sum(symbol) FROM {RANKED_SQL}
          WHERE period_start IN (SELECT period_start FROM {EARNED_SQL} ORDER BY 1 LIMIT 5) GROUP BY period_start
        UNION ALL SELECT 'avg', period_start, count(*), sum(symbol) FROM {RANKED_SQL} GROUP BY period_start""",
)
def _(t):
    names = stage(portfolio.equal_weight(held(t)).drop("buy_date", "sell_date"))
    totals = portfolio.compound(portfolio.period_earnings(names))
    paths = tables.write_reports(scratch_path(t.spark, "reports"), names, totals, ranked(t), 4)
    read = lambda name: t.spark.read.option("header", "true").option("inferSchema", "true").csv(paths[name])
    count, total = F.count(F.lit(1)).alias("n"), F.sum("symbol").cast("double").alias("total")
    parts = [read(n).groupBy("period_start").agg(count, total).withColumn("report", F.lit(n)) for n in ("eval_picks", "rank", "avg")]
    parts.append(
        read("eval_periods").select(
            "period_start", F.lit(1).cast("long").alias("n"), F.ln("accumulated").alias("total"), F.lit("eval_periods").alias("report")
        )
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
