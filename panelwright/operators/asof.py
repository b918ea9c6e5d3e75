"""Calendars and point-in-time alignment.

Every as-of and range condition is an equi-join on a day: the bounded calendar
is exploded into the days each of its dates covers, so no range join, nested
loop or per-symbol search is planned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.operators.ordered import first_per_key, top_per_group, with_group_stats
from panelwright.session import stage


def rebalance_calendar(
    spark: SparkSession,
    start_year: int,
    end_year: int,
    months: int = 3,
    prices: DataFrame | None = None,
    lookback_years: int = 3,
    start_month: int = 1,
    start_day: int = 1,
) -> DataFrame:
    """Every ``months`` months from ``start_year - lookback`` to the end year or the last price."""
    first = F.make_date(F.lit(start_year - lookback_years), F.lit(start_month), F.lit(start_day))
    last = F.make_date(F.lit(end_year), F.lit(12), F.lit(31))
    step = F.make_ym_interval(F.lit(0), F.lit(months))
    bounds = spark.range(1) if prices is None else prices.agg(F.max("date").alias("last_price"))
    if prices is not None:
        last = F.least(last, F.col("last_price"))
    in_order = bounds.select(first.alias("a"), last.alias("b")).where(F.col("a") <= F.col("b"))
    return in_order.select(F.explode(F.sequence("a", "b", step)).alias("as_of"))


def trading_days(prices: DataFrame) -> DataFrame:
    """The distinct trading days, staged: one row per day, so at most the calendar's length.

    Calendars and trade dates need days only; from here on they do not scan prices again.
    """
    return stage(prices.select("date").distinct())


def rebalance_quotes(dates: DataFrame, prices: DataFrame) -> DataFrame:
    """Price rows on the trade dates, with ``as_of`` and ``trade_date``; staged, a small share of all prices."""
    on_date = dates.select(F.col("trade_date").alias("date"), "as_of")
    return stage(prices.join(on_date, "date").withColumnRenamed("date", "trade_date"))


def covered_days(calendar: DataFrame, first: Column, last: Column) -> DataFrame:
    """One row per calendar row and day in ``[first, last]``, as column ``day``."""
    return calendar.where(first <= last).withColumn("day", F.explode(F.sequence(first, last)))


def trade_dates(calendar: DataFrame, prices: DataFrame, tolerance: int = 10) -> DataFrame:
    """The latest trading day in ``[as_of - tolerance, as_of]``; dates with none are dropped.

    ``prices`` is any frame with a ``date`` column, such as ``trading_days``.
    """
    days = covered_days(calendar, F.date_sub("as_of", tolerance), F.col("as_of"))
    return (
        prices.select(F.col("date").alias("day"))
        .join(days, "day")
        .groupBy("as_of")
        .agg(F.max("day").alias("trade_date"))
    )


def trade_dates_by_symbol(calendar: DataFrame, prices: DataFrame, tolerance: int = 10) -> DataFrame:
    """C2 per symbol: the latest price row of each symbol within the tolerance of each date."""
    days = covered_days(calendar, F.date_sub("as_of", tolerance), F.col("as_of"))
    rest = [c for c in prices.columns if c != "symbol"]
    return (
        prices.join(days, prices["date"] == days["day"])
        .groupBy("symbol", "as_of")
        .agg(F.max(F.struct("date", *[c for c in rest if c != "date"])).alias("p"))
        .select("symbol", "as_of", F.col("p.date").alias("trade_date"), *[f"p.{c}" for c in rest if c != "date"])
    )


def next_rebalance(filings: DataFrame, calendar: DataFrame, filing_date: str = "fillingDate") -> DataFrame:
    """The first calendar date strictly after the filing date, or null.

    Days before the calendar map to its first date through their clamp to the
    day before it, so the day map spans the calendar only.
    """
    first = calendar.agg(F.date_sub(F.min("as_of"), 1)).scalar()
    previous = F.lag("as_of").over(Window.orderBy("as_of"))
    spans = calendar.select("as_of").distinct().withColumn(
        "from", F.coalesce(previous, F.date_sub("as_of", 1))
    )
    days = covered_days(spans, F.col("from"), F.date_sub("as_of", 1)).select(
        F.col("day").alias("__day"), F.col("as_of").alias("rebalance_date")
    )
    clamped = filings.withColumn("__at", F.when(F.col(filing_date).isNotNull(), F.greatest(F.col(filing_date), first)))
    return clamped.join(days, F.col("__at") == F.col("__day"), "left").drop("__at", "__day")


def latest_filing(
    filings: DataFrame, calendar: DataFrame, months: int = 6, filing_date: str = "fillingDate"
) -> DataFrame:
    """C4: per date and symbol the newest filing dated in ``[as_of - months, as_of]``."""
    days = covered_days(calendar, F.add_months("as_of", -months), F.col("as_of"))
    inside = filings.join(days, F.col(filing_date) == F.col("day")).drop("day")
    return first_per_key(inside, ["as_of", "symbol"], [(filing_date, False), ("date", False)])


def lagged_filings(
    filings: DataFrame,
    calendar: DataFrame,
    lags: Sequence[int] = (3, 6, 9, 12, 15, 18, 21, 24),
    width: int = 4,
    filing_date: str = "fillingDate",
) -> DataFrame:
    """C5 in long form: per date, symbol and lag n the filing in ``[as_of-(n+width)m, as_of-n m]``."""
    with_lags = calendar.withColumn("lag", F.explode(F.array(*[F.lit(n) for n in lags])))
    days = covered_days(
        with_lags,
        F.add_months("as_of", -(F.col("lag") + width)),
        F.add_months("as_of", -F.col("lag")),
    )
    inside = filings.join(days, F.col(filing_date) == F.col("day")).drop("day")
    return first_per_key(inside, ["as_of", "symbol", "lag"], [(filing_date, False), ("date", False)])


def lagged_snapshots(
    filings: DataFrame,
    calendar: DataFrame,
    columns: Sequence[str],
    lags: Sequence[int] = (3, 6, 9, 12, 15, 18, 21, 24),
    width: int = 4,
) -> DataFrame:
    """C5 in wide form: ``prev{n}_{column}`` columns, one row per date and symbol."""
    long = lagged_filings(filings, calendar, lags, width)
    return long.groupBy("as_of", "symbol").agg(
        *[
            F.max(F.when(F.col("lag") == n, F.col(c))).alias(f"prev{n}_{c}")
            for n in lags
            for c in columns
        ]
    )


def date_window(df: DataFrame, column: str, first_year: int, last_year: int) -> DataFrame:
    """``[first_year-01-01, (last_year+1)-03-01]``, both ends included."""
    return df.where(
        F.col(column).between(
            F.lit(f"{first_year}-01-01").cast("date"), F.lit(f"{last_year + 1}-03-01").cast("date")
        )
    )


def fiscal_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """``4*calendarYear + quarter`` as an integer; rows without a year are dropped."""
    quarter = F.substring("period", 2, 1).try_cast("long")
    return df.where(F.col("calendarYear").isNotNull()).withColumn(
        name, F.col("calendarYear").cast("long") * 4 + quarter
    )


def seq_in_symbol(df: DataFrame, order: str = "ordinal", name: str = "time_for_sort") -> DataFrame:
    """0, 1, 2, ... per symbol in fiscal order (one row per symbol and quarter)."""
    w = Window.partitionBy("symbol").orderBy(F.col(order).asc_nulls_last())
    return df.withColumn(name, F.row_number().over(w) - 1)


def last_n_window(df: DataFrame, upto: int, n: int = 12, order: str = "ordinal") -> DataFrame:
    """The last ``n`` rows per symbol with order <= ``upto``; symbols with fewer are dropped."""
    recent = top_per_group(df.where(F.col(order) <= upto), ["symbol"], [(order, False)], n, "__rn")
    full = with_group_stats(recent, ["symbol"], __have=F.count(F.lit(1)))
    return full.where(F.col("__have") == n).drop("__rn", "__have")


def active_on(symbols: DataFrame, day: str) -> DataFrame:
    """B6 at one date: not delisted before it."""
    return symbols.where(F.col("delistedDate").isNull() | (F.col("delistedDate") >= F.lit(day).cast("date")))


def active_at_dates(symbols: DataFrame, calendar: DataFrame) -> DataFrame:
    """B6 at every calendar date.

    The calendar (bounded by its span) is folded into one array, so each symbol
    explodes only the dates it was listed on.
    """
    dates = calendar.agg(F.sort_array(F.collect_set("as_of"))).scalar()
    listed = F.filter(F.col("__dates"), lambda d: F.col("delistedDate").isNull() | (d <= F.col("delistedDate")))
    return (
        symbols.withColumn("__dates", dates)
        .withColumn("as_of", F.explode(listed))
        .drop("__dates")
    )


def panel_asof(
    calendar: DataFrame,
    symbols: DataFrame,
    filings: DataFrame,
    prices: DataFrame,
    months: int = 6,
    tolerance: int = 10,
    quotes: DataFrame | None = None,
) -> DataFrame:
    """Universe, trade-date price and newest filing for all dates in one plan.

    One row per (as_of, symbol) that was listed, traded on the date's trade day
    and filed within ``months``.  ``quotes`` (see ``rebalance_quotes``) replaces
    the price scan when the caller has them already.
    """
    if quotes is None:
        dates = stage(trade_dates(calendar, trading_days(prices), tolerance))
        quotes = prices.join(dates.withColumnRenamed("trade_date", "date"), "date").withColumnRenamed("date", "trade_date")
    else:
        dates = quotes.select("as_of", "trade_date").distinct()
    # Listed on the date: a filter after the symbol join, so the universe is never multiplied by the calendar.
    listed = quotes.join(symbols, "symbol").where(F.col("delistedDate").isNull() | (F.col("delistedDate") >= F.col("as_of")))
    newest = latest_filing(filings, dates.select("as_of"), months).withColumnRenamed("date", "report_date")
    return listed.join(newest, ["as_of", "symbol"])
