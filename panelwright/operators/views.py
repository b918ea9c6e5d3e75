"""View tables: unions, joins and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.ordered import Order, first_per_key

DATE_FORM = r"^\d{4}-\d{2}-\d{2}$"


def dedup_first(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """One row per key, the first under an explicit order."""
    return first_per_key(df, keys, order)


def symbol_master(
    listed: DataFrame,
    delisted: DataFrame,
    profile: DataFrame,
    exchanges: Sequence[str] | None = ("NASDAQ", "NYSE"),
    kind: str | None = None,
    keep: str = "first",
) -> DataFrame:
    """B1: listed before delisted, one row per symbol, completed from the profile.

    ``keep="last"`` lets the delisted row win.  ``kind`` keeps one instrument
    type (for example ``stock``) when given.
    """
    both = (
        listed.withColumn("__src", F.lit(0))
        .unionByName(delisted.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    )
    if kind is not None:
        both = both.where(F.col("type").isNull() | (F.col("type") == kind))
    order = [("__src", keep == "first")]
    symbols = first_per_key(both, ["symbol"], order).drop("__src")
    extra = first_per_key(profile, ["symbol", "exchangeShortName"], []).withColumnRenamed("ipoDate", "__ipo")
    out = symbols.join(extra, ["symbol", "exchangeShortName"], "left")
    if "ipoDate" in symbols.columns:
        out = out.withColumn("ipoDate", F.coalesce("ipoDate", "__ipo")).drop("__ipo")
    else:
        out = out.withColumnRenamed("__ipo", "ipoDate")
    if exchanges is not None:
        out = out.where(F.col("exchangeShortName").isin(*exchanges))
    return out.select(
        "symbol",
        "exchangeShortName",
        "type",
        F.col("ipoDate").cast("date").alias("ipoDate"),
        F.col("delistedDate").cast("date").alias("delistedDate"),
        "industry",
    )


def recently_active(symbols: DataFrame) -> DataFrame:
    """B2: never delisted, or within one month of the newest delisting."""
    edge = symbols.agg(F.add_months(F.max("delistedDate"), -1)).scalar()
    return symbols.where(F.col("delistedDate").isNull() | (F.col("delistedDate") >= edge))


def price_view(price: DataFrame, marketcap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prices with market cap; rows whose date is not ``YYYY-MM-DD`` go to the second frame."""
    joined = price.join(marketcap, ["symbol", "date"], "left")
    well_formed = F.coalesce(
        F.col("date").rlike(DATE_FORM) & F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).isNotNull(),
        F.lit(False),
    )
    good = joined.where(well_formed).withColumn("date", F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).cast("date"))
    return good, joined.where(~well_formed)


def _marked(df: DataFrame, suffix: str, keys: Sequence[str], shared: set[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{c}{suffix}" if c in shared else c) for c in df.columns if c not in keys])


def statement_view(
    income: DataFrame,
    balance: DataFrame,
    cashflow: DataFrame,
    keys: Sequence[str] = ("symbol", "date"),
    how: str = "full",
) -> DataFrame:
    """The three statements side by side (``full``, or ``inner`` for the strict variant).

    Shared non-key columns come back once, from the first statement having them,
    except ``fillingDate``: the cash-flow date drives alignment, then balance, then income.
    """
    keys = list(keys)
    parts = {"_i": income, "_b": balance, "_c": cashflow}
    names: list[str] = []
    for df in parts.values():
        names += [c for c in df.columns if c not in keys and c not in names]
    shared = {c for c in names if sum(c in df.columns for df in parts.values()) > 1}
    left = _marked(income, "_i", keys, shared)
    joined = left.join(_marked(balance, "_b", keys, shared), keys, how).join(
        _marked(cashflow, "_c", keys, shared), keys, how
    )
    out = []
    for c in names:
        if c not in shared:
            out.append(F.col(c))
            continue
        order = ("_c", "_b", "_i") if c == "fillingDate" else ("_i", "_b", "_c")
        have = [F.col(f"{c}{s}") for s in order if c in parts[s].columns]
        out.append(F.coalesce(*have).alias(c))
    return joined.select(*keys, *out)


def metrics_view(
    key_metrics: DataFrame, growth: DataFrame, dcf: DataFrame, how: str = "full"
) -> DataFrame:
    """Key metrics with growth (outer, or inner), and the discounted value where known."""
    keys = ["symbol", "date"]
    growth_only = growth.select(*keys, *[c for c in growth.columns if c not in key_metrics.columns])
    return key_metrics.join(growth_only, keys, how).join(
        dcf.select(*keys, "dcf"), keys, "left" if how == "full" else how
    )


def coalesce_suffixes(df: DataFrame) -> DataFrame:
    """Drop doubly suffixed columns, merge each ``_x``/``_y`` pair preferring ``_x``."""
    double = ("_x_x", "_y_y", "_x_y", "_y_x")
    names = [c for c in df.columns if not c.endswith(double)]
    bases = {c[:-2] for c in names if c.endswith("_x")}
    out = []
    for c in names:
        base = c[:-2]
        if c.endswith("_x"):
            pair = f"{base}_y"
            out.append(F.coalesce(c, pair).alias(base) if pair in names else F.col(c).alias(base))
        elif not (c.endswith("_y") and base in bases):
            out.append(F.col(c))
    return df.select(*out)


def join_drop_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Order = ()) -> DataFrame:
    """Shared non-key columns come from the right; inner join; one row per key."""
    keys = list(keys)
    common = [c for c in left.columns if c in right.columns and c not in keys]
    return first_per_key(left.drop(*common).join(right, keys), keys, list(order))


def semi_filter(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is in ``wanted``."""
    return df.join(wanted.select(*keys), list(keys), "left_semi")


def anti_filter(df: DataFrame, unwanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``unwanted``."""
    return df.join(unwanted.select(*keys), list(keys), "left_anti")


def map_sector(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Industry to sector through a mapping table ``(industry, sector, position)``.

    Unknown industries get null; of a repeated industry the last position counts.
    """
    last = first_per_key(mapping, ["industry"], [("position", False)]).drop("position")
    return df.drop("sector").join(last, "industry", "left")


def load_years(df: DataFrame, first_year: int, last_year: int, lookback: int = 3, year_column: str = "year") -> DataFrame:
    """Years ``first-lookback .. last``; on a table partitioned by year other files are not read."""
    return df.where(F.col(year_column).between(first_year - lookback, last_year))
