"""The rank-plan replay: universe to compounded value, all dates in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import asof, features, portfolio, quality, ranking
from panelwright.operators.ranking import Plan
from panelwright.session import stage


@dataclass(frozen=True)
class ReplaySettings:
    """Parameters of a replay."""

    start_year: int
    end_year: int
    months: int = 3
    lookback_years: int = 0
    top_k: int = 10
    members: int = 5
    base_score: float = 100.0
    liquid: float | None = 0.10
    asset: float = portfolio.TOTAL_ASSET


def date_table(
    symbols: DataFrame,
    prices: DataFrame,
    filings: DataFrame,
    settings: ReplaySettings,
    ratio_columns: Sequence[str],
    directions: Mapping[str, str],
) -> tuple[DataFrame, DataFrame]:
    """(date table, quotes): per date and liquid symbol the newest filing, its ratios to market cap and the oriented metrics.

    Prices are scanned twice in the whole replay: once for the trading days,
    once for the rows on them, which are the quotes the picks are priced with.
    """
    days = asof.trading_days(prices)
    calendar = asof.rebalance_calendar(
        prices.sparkSession, settings.start_year, settings.end_year, settings.months, days, settings.lookback_years
    )
    quotes = asof.rebalance_quotes(asof.trade_dates(calendar, days), prices)
    panel = asof.panel_asof(calendar, symbols, filings, prices, quotes=quotes)
    if settings.liquid is not None:
        valued = panel.withColumn("volume_mul_price", features.turnover())
        panel = quality.liquid_top_fraction(stage(valued), "volume_mul_price", settings.liquid, ["as_of"])
    with_ratios = features.over_marketcap(panel, ratio_columns)
    return features.orient_high_good(with_ratios, directions, ["as_of"]), quotes


def replay(
    table: DataFrame, quotes: DataFrame, plans: Sequence[Plan], settings: ReplaySettings
) -> tuple[DataFrame, DataFrame]:
    """(picks with prices and earnings, periods with return and compounded value).

    ``table`` and ``quotes`` come from ``date_table``; the table is staged once
    because scores, picks and periods all read it.
    """
    table = stage(table)
    scored = ranking.total_score(table, plans, settings.top_k, settings.base_score)
    picked = ranking.picks(scored, settings.members).select("as_of", "symbol", "score", "rn")
    dates = table.select("as_of", "trade_date").distinct()
    periods = portfolio.holding_periods(dates)
    held = portfolio.attach_prices(picked, periods, quotes.withColumnRenamed("trade_date", "date"), settings.members)
    weighted = stage(portfolio.equal_weight(held, settings.asset))
    earned = portfolio.period_earnings(weighted, settings.asset)
    return weighted, portfolio.compound(earned)
