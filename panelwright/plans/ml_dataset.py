"""The training dataset for all quarters in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.names import select_features
from panelwright.operators import asof, features
from panelwright.operators.ordered import positions
from panelwright.session import stage_table

WINDOW = 12


def liquid_by_year(rebalance: DataFrame, first_year: int, last_year: int, fraction: float = 0.5) -> DataFrame:
    """D1 for every dataset year: symbols in the top share by mean turnover over ``[year-4, year]``.

    A row counts for each year whose date window holds it, at most six.
    """
    years = F.filter(
        F.sequence(F.year("as_of") - 1, F.year("as_of") + 4),
        lambda y: (y >= first_year)
        & (y <= last_year)
        & (F.col("as_of") >= F.make_date(y - 4, F.lit(1), F.lit(1)))
        & (F.col("as_of") <= F.make_date(y + 1, F.lit(3), F.lit(1))),
    )
    means = (
        rebalance.withColumn("year", F.explode(years))
        .groupBy("year", "symbol")
        .agg(F.avg(F.col("close") * F.col("volume")).alias("turnover"))
    )
    placed = positions(means, ["year"], [("turnover", False), ("symbol", True)])
    return placed.where(F.col("pos") < F.floor(F.col("n") * fraction)).select("year", "symbol")


def sliding_windows(filings: DataFrame, columns: Sequence[str], size: int = WINDOW) -> DataFrame:
    """One row per filing and kind with the values of the last ``size`` quarters, in order.

    Only whole windows whose filings all fall inside the year's date range are
    kept, and only kinds that are present and finite in every window of the
    quarter (D11).
    """
    long = filings.select(
        "symbol", "ordinal", "calendarYear", "fillingDate", *[F.col(c).cast("double").alias(c) for c in columns]
    ).unpivot(["symbol", "ordinal", "calendarYear", "fillingDate"], list(columns), "kind", "value")
    # One row per symbol, kind and quarter: a partition is as long as the history in quarters.
    back = Window.partitionBy("symbol", "kind").orderBy("ordinal").rowsBetween(1 - size, 0)
    rows = long.select(
        "symbol",
        "ordinal",
        "kind",
        F.collect_list("value").over(back).alias("values"),
        F.count(F.lit(1)).over(back).alias("__n"),
        (F.min("fillingDate").over(back) >= F.make_date((F.col("calendarYear") - 4).cast("int"), F.lit(1), F.lit(1))).alias("__in"),
    ).where((F.col("__n") == size) & F.col("__in"))
    infinite = F.lit(float("inf"))
    whole = (F.size("values") == size) & F.forall("values", lambda v: F.abs(v) < infinite)
    usable = rows.groupBy("ordinal", "kind").agg(F.bool_and(whole).alias("__ok")).where("__ok").select("ordinal", "kind")
    return rows.join(usable, ["ordinal", "kind"], "left_semi").select("symbol", "ordinal", "kind", "values")


def ml_dataset(
    symbols: DataFrame,
    prices: DataFrame,
    filings: DataFrame,
    first_year: int,
    last_year: int,
    amount_columns: Sequence[str],
    ratio_columns: Sequence[str],
    time_columns: Sequence[str],
    ev_columns: Sequence[str],
    months: int = 3,
    horizon: str = "forward",
    fraction: float = 0.5,
    feature_names: Sequence[str] | None = None,
    marker: str = "{kind}_ts_{feature}",
    vectors: bool = False,
) -> tuple[DataFrame, DataFrame] | tuple[DataFrame, DataFrame, list[str]]:
    """(features, dataset): scaled features per symbol and quarter, and the same with returns as labels.

    ``filings`` are statements joined with metrics; they carry marketCap and
    netDebt.  ``horizon="forward"`` labels with the return from the rebalance
    date on; ``"trailing"`` with the return up to it, which partly precedes the
    filing.  All features of all time columns travel as one vector per row; with
    ``vectors`` they stay one (``features``) and its name table comes third,
    else each gets a column in the last projection, named by ``marker``.
    """
    spark = prices.sparkSession
    days = asof.trading_days(prices)
    calendar = asof.rebalance_calendar(spark, first_year, last_year, months, days)
    # The trade dates are a handful of rows and the prices on them a small share of
    # all prices; both are read more than once, so each is computed once.
    found = asof.trade_dates(calendar, days).select(F.col("trade_date").alias("date"), F.col("trade_date").alias("as_of"))
    dates = stage_table(found.distinct(), "trade-dates")
    at_dates = stage_table(prices.join(dates, "date").select("symbol", "as_of", "close", "volume"), "trade-prices")
    rebalance = features.price_return(features.price_change(at_dates, "as_of"), "as_of")
    if horizon == "forward":
        ahead = F.lead("price_dev").over(Window.partitionBy("symbol").orderBy("as_of"))
        rebalance = rebalance.withColumn("price_dev", ahead)
    rebalance = rebalance.withColumn("volume_mul_price", features.turnover())
    liquid = liquid_by_year(rebalance, first_year, last_year, fraction)

    ordered = asof.fiscal_ordinal(asof.next_rebalance(filings, dates.select("as_of")))
    amounts = [c for c in amount_columns if c in filings.columns]
    ratios = features.ev_multiples(
        features.over_marketcap(ordered, amounts), [c for c in ev_columns if c in filings.columns]
    )
    kinds = [c for c in time_columns if c in filings.columns]
    windows = sliding_windows(ordered, kinds)
    own = features.vector_names(WINDOW, features=feature_names)
    summary = features.feature_vectors(windows, ["symbol", "ordinal", "kind"], "values", own, WINDOW)
    wide = features.vectors_wide(summary, ["symbol", "ordinal"], kinds, len(own))

    in_years = ratios.where(F.col("calendarYear").between(first_year, last_year))
    rows = in_years.join(
        liquid.select(F.col("year").cast("long").alias("calendarYear"), "symbol"), ["calendarYear", "symbol"], "left_semi"
    ).join(wide, ["symbol", "ordinal"])
    plain = select_features(ratios.columns, ratio_columns, amounts)
    names = [*plain, *[marker.format(kind=k, feature=f) for k in kinds for f in own]]
    keys = ["symbol", "calendarYear", "period", "ordinal", "date", "fillingDate", "rebalance_date"]
    vector = F.concat(F.array(*[F.col(f"`{c}`").cast("double") for c in plain]).cast("array<double>"), F.col("features"))
    # The scaling reads the vectors twice; they are computed once.
    staged = stage_table(rows.select(*keys, vector.alias("features")), "ml-features")
    scaled = features.robust_scale_vectors(staged, "features", len(names), ["ordinal"]).withColumnRenamed("date", "report_date")
    out = scaled.join(symbols.select("symbol", "industry", "sector"), "symbol")
    labels = rebalance.select(
        "symbol", F.col("as_of").alias("rebalance_date"), F.col("close").alias("price"), "volume_mul_price", "price_diff", "price_dev"
    )
    dataset = out.join(labels, ["symbol", "rebalance_date"])
    dataset = features.market_relative(dataset, "price_dev", ["ordinal"])
    dataset = features.sector_relative(dataset, "price_dev", ["ordinal"])
    if vectors:
        return out, dataset, names
    return _columns(out, names), _columns(dataset, names)


def _columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The vector ``features`` as one column per name."""
    return df.select(*[c for c in df.columns if c != "features"], *[F.get("features", F.lit(i)).alias(n) for i, n in enumerate(names)])


def write_dataset(df: DataFrame, path: str) -> None:
    """Write features or dataset partitioned by (year, quarter); a rerun replaces only its quarters."""
    out = df.withColumnsRenamed({"calendarYear": "year", "period": "quarter"})
    (
        out.hint("rebalance", F.col("year"), F.col("quarter"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "quarter")
        .parquet(path)
    )
