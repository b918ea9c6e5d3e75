"""Portfolio arithmetic as joins and aggregates over all periods at once.

Price joins are equi-joins on (symbol, date).  Windows run over period tables
only, which have one row per calendar period.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date as Date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.asof import rebalance_calendar, trade_dates, trading_days
from panelwright.operators.ordered import top_per_group, with_group_stats
from panelwright.session import stage

TOTAL_ASSET = 100_000_000.0
DEAD_PRICE = 0.000001
SWEEP_MONTHS = (1, 2, 3, 4, 6, 12)


def holding_periods(dates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Consecutive trade dates as periods; the newest date has no end and drops out."""
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("as_of")
    out = dates.select(
        *by,
        F.col("as_of").alias("period_start"),
        F.lead("as_of").over(w).alias("period_end"),
        F.col("trade_date").alias("buy_date"),
        F.lead("trade_date").over(w).alias("sell_date"),
    )
    return out.where(F.col("period_end").isNotNull())


def attach_prices(picks: DataFrame, periods: DataFrame, prices: DataFrame, n: int, rank: str = "rn") -> DataFrame:
    """G1: buy and sell price of every pick (0 when missing); dead sells dropped; the first n kept."""
    spans = periods.withColumnRenamed("period_start", "as_of")
    held = picks.join(spans, "as_of").withColumnRenamed("as_of", "period_start")
    buys = prices.select("symbol", F.col("date").alias("buy_date"), F.col("close").alias("price"))
    sells = prices.select("symbol", F.col("date").alias("sell_date"), F.col("close").alias("rebalance_day_price"))
    priced = held.join(buys, ["symbol", "buy_date"], "left").join(sells, ["symbol", "sell_date"], "left")
    filled = priced.na.fill(0.0, ["price", "rebalance_day_price"])
    alive = filled.where(F.col("rebalance_day_price") > DEAD_PRICE)
    return top_per_group(alive, ["period_start"], [(rank, True), ("symbol", True)], n, "__rn").drop("__rn")


def period_returns(universe: DataFrame, end_prices: DataFrame, k: int, group: Sequence[str] = ("period_start",)) -> DataFrame:
    """Every name's return to the period end, full join on (group, symbol), top k by return."""
    keys = [*group, "symbol"]
    ends = end_prices.select(*keys, F.col("close").alias("rebalance_day_price"))
    joined = universe.join(ends, keys, "full").where(F.col("close") > DEAD_PRICE)
    out = joined.withColumn("period_price_diff", (F.col("rebalance_day_price") - F.col("close")) / F.col("close"))
    return top_per_group(out, list(group), [("period_price_diff", False), ("symbol", True)], k, "rn")


def equal_weight(picks: DataFrame, asset: float = TOTAL_ASSET, period: str = "period_start") -> DataFrame:
    """shares = asset / n / price (0 where undefined) and the earning of each name."""
    out = with_group_stats(picks, [period], __n=F.count(F.lit(1)))
    shares = F.coalesce(F.try_divide(F.lit(asset) / F.col("__n"), F.col("price")), F.lit(0.0))
    out = out.withColumn("count", shares).drop("__n")
    return out.withColumn("period_earning", (F.col("rebalance_day_price") - F.col("price")) * F.col("count"))


def period_earnings(weighted: DataFrame, asset: float = TOTAL_ASSET, keys: Sequence[str] = ("period_start", "period_end")) -> DataFrame:
    """G3 per period: earning and return; a period with nothing invested drops out."""
    sums = weighted.groupBy(*keys).agg(
        F.sum("period_earning").alias("earning"), F.sum(F.col("price") * F.col("count")).alias("__in")
    )
    return sums.where(F.col("__in") != 0).drop("__in").withColumn("return", F.col("earning") / asset)


def running_product(factor: Column, w: Window) -> Column:
    """Product of factors along a window; zero and negative factors keep their meaning."""
    size = F.exp(F.sum(F.when(factor != 0, F.ln(F.abs(factor)))).over(w))
    flips = F.sum((factor < 0).cast("int")).over(w)
    zeros = F.sum((factor == 0).cast("int")).over(w)
    return F.when(zeros > 0, 0.0).when(flips % 2 == 1, -size).otherwise(size)


def compound(periods: DataFrame, ret: str = "return", by: Sequence[str] = (), order: str = "period_start") -> DataFrame:
    """Running value of 100 invested at the start, and the running total return."""
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    value = running_product(F.lit(1.0) + F.col(ret), w) * 100
    return periods.withColumn("accumulated", value).withColumn("total_return", value / 100 - 1)


def best_worst_period(periods: DataFrame, ret: str = "return", by: Sequence[str] = (), order: str = "period_start") -> DataFrame:
    """The best and worst period return, and when they happened (the earlier on ties)."""
    first = lambda sign: F.struct((sign * F.col(ret)).alias("v"), F.col(order).alias("d"))
    out = periods.groupBy(*by).agg(
        F.max(ret).alias("best"), F.min(ret).alias("worst"), F.min(first(-1)).alias("__b"), F.min(first(1)).alias("__w")
    )
    return out.select(*by, "best", F.col("__b.d").alias("best_period"), "worst", F.col("__w.d").alias("worst_period"))


# Days before a date within which its trade date is looked for.
TOLERANCE = 10


def benchmark_return(prices: DataFrame, symbols: DataFrame, start: Date, end: Date) -> DataFrame:
    """Buy-and-hold return (a fraction) between two trade dates; 0 when a price is missing.

    An end date without a trade date within the tolerance takes the last price date.
    """
    # Only the days within the tolerance of either end are scanned; two dates come back.
    near = lambda d: F.col("date").between(F.date_sub(F.lit(d), TOLERANCE), F.lit(d))
    last_before = lambda d: F.max(F.when(near(d), F.col("date")))
    first, last = prices.where(near(start) | near(end)).agg(last_before(start).alias("a"), last_before(end).alias("b")).first()
    if last is None:
        last = prices.agg(F.max("date")).first()[0]
    two = prices.where(F.col("date").isin([d for d in {first, last} if d is not None])).groupBy("symbol").agg(
        F.max(F.when(F.col("date") == F.lit(first), F.col("close"))).alias("start_price"),
        F.max(F.when(F.col("date") == F.lit(last), F.col("close"))).alias("end_price"),
    )
    ret = F.try_divide(F.col("end_price") - F.col("start_price"), F.col("start_price"))
    return symbols.select("symbol").distinct().join(two, "symbol", "left").withColumn(
        "benchmark_return", F.coalesce(ret, F.lit(0.0))
    )


def daily_value(weighted: DataFrame, prices: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of shares times close per day over each pick's holding days.

    Picks (a few names per period) are exploded into their days, so prices are
    met by an equi-join.
    """
    days = weighted.select(
        *by, "symbol", "count", F.explode(F.sequence("buy_date", "sell_date")).alias("date")
    )
    held = days.join(prices.select("symbol", "date", "close"), ["symbol", "date"])
    return held.groupBy(*by, "date").agg(F.sum(F.col("count") * F.col("close")).alias("value"))


def range_drawdown(values: DataFrame, value: str = "value", date: str = "date") -> DataFrame:
    """(global min / global max - 1) * 100 with their dates; order plays no part."""
    low = F.min(F.struct(F.col(value).alias("v"), F.col(date).alias("d")))
    high = F.min(F.struct((-F.col(value)).alias("v"), F.col(date).alias("d")))
    out = values.agg(low.alias("lo"), high.alias("hi"))
    return out.select(
        (F.try_divide(F.col("lo.v"), -F.col("hi.v")) * 100 - 100).alias("mdd"),
        F.col("hi.d").alias("best_date"),
        F.col("lo.d").alias("worst_date"),
    )


def _growth(percent: str) -> Column:
    return F.lit(1.0) + F.col(percent) / 100


def drawdown(returns: DataFrame, percent: str = "return_pct", by: Sequence[str] = ("strategy",), order: str = "period_start") -> DataFrame:
    """Largest fall below the running maximum of the compounded value, in percent."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    path = returns.withColumn("__v", running_product(_growth(percent), w))
    top = path.withColumn("__top", F.max("__v").over(w))
    fall = F.try_divide(F.col("__v") - F.col("__top"), F.col("__top")) * 100
    return top.groupBy(*by).agg(F.abs(F.min(fall)).alias("max_drawdown"))


def return_metrics(
    returns: DataFrame,
    months: Column,
    percent: str = "return_pct",
    by: Sequence[str] = ("strategy",),
    order: str = "period_start",
    strategies: DataFrame | None = None,
) -> DataFrame:
    """Total and annualised return, mean, population std, Sharpe, win rate, count, drawdown (percent in, percent out).

    A strategy listed in ``strategies`` but without a return gets zeros.
    """
    by = list(by)
    factor = _growth(percent)
    zero, negative = F.count_if(factor == 0), F.count_if(factor < 0)
    size = F.exp(F.coalesce(F.sum(F.when(factor != 0, F.ln(F.abs(factor)))), F.lit(0.0)))
    product = F.when(zero > 0, 0.0).when(negative % 2 == 1, -size).otherwise(size)
    base = returns.groupBy(*by).agg(
        product.alias("__growth"),
        F.max(months).alias("__months"),
        F.avg(percent).alias("avg_return"),
        F.stddev_pop(percent).alias("std_return"),
        (F.count_if(F.col(percent) > 0) / F.count(F.lit(1)) * 100).alias("win_rate"),
        F.count(F.lit(1)).alias("num_trades"),
    )
    years = F.col("num_trades") * F.col("__months") / 12
    yearly = F.when((F.col("__growth") >= 0) & (years > 0), (F.pow("__growth", 1 / years) - 1) * 100)
    out = base.join(drawdown(returns, percent, by, order), by).select(
        *by,
        ((F.col("__growth") - 1) * 100).alias("total_return"),
        yearly.alias("annualized_return"),
        F.when(F.col("std_return") > 0, F.col("avg_return") / F.col("std_return")).otherwise(0.0).alias("sharpe_ratio"),
        "win_rate",
        "num_trades",
        "max_drawdown",
        "avg_return",
        "std_return",
    )
    if strategies is None:
        return out
    return strategies.select(*by).distinct().join(out, by, "left").na.fill(0)


def sweep_rebalance(
    prices: DataFrame,
    start_year: int,
    end_year: int,
    months: Sequence[int] = SWEEP_MONTHS,
    top_k: int = 5,
    min_trades: int = 3,
    metric: str = "sharpe_ratio",
    score: Column | None = None,
) -> DataFrame:
    """G10 for every rebalance interval in one plan, best interval first.

    Each period buys the ``top_k`` names by ``score`` (turnover by default) in
    equal weight and sells at the next date; names without a sell price are left out.
    """
    spark = prices.sparkSession
    days = trading_days(prices)
    monthly = rebalance_calendar(spark, start_year, end_year, 1, days, 0)
    origin = F.lit(Date(start_year, 1, 1))
    gap = (F.year("as_of") - F.year(origin)) * 12 + F.month("as_of") - F.month(origin)
    on_step = F.filter(F.array(*[F.lit(m) for m in months]), lambda m: gap % m == 0)
    dates = stage(trade_dates(monthly, days)).withColumn("period_months", F.explode(on_step))
    periods = holding_periods(dates, ["period_months"])
    bought = prices.join(periods, prices["date"] == periods["buy_date"]).withColumn(
        "score", score if score is not None else F.col("close") * F.col("volume")
    )
    sells = prices.select("symbol", F.col("date").alias("sell_date"), F.col("close").alias("rebalance_day_price"))
    priced = bought.join(sells, ["symbol", "sell_date"])
    chosen = top_per_group(priced, ["period_months", "period_start"], [("score", False), ("symbol", True)], top_k)
    gain = (F.col("rebalance_day_price") - F.col("close")) / F.col("close") * 100
    returns = chosen.groupBy("period_months", "period_start").agg(F.avg(gain).alias("return_pct"))
    out = return_metrics(returns, F.col("period_months"), by=["period_months"])
    return out.where(F.col("num_trades") >= min_trades).orderBy(F.col(metric).desc(), "period_months")
