"""Filters, pruning and data quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.ordered import (
    exact_percentiles,
    join_stats,
    order_statistics,
    positions,
    with_group_stats,
)
from panelwright.session import stage_table

_NUMERIC = ("double", "float", "bigint", "int", "smallint", "tinyint")


def _is_missing(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if dict(df.dtypes)[name] in ("double", "float"):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def liquid_half(prices: DataFrame, fraction: float = 0.5) -> DataFrame:
    """Symbols in the top ``int(fraction * n)`` by mean turnover; ties by symbol."""
    means = prices.groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("mean_turnover"))
    placed = positions(means, [], [("mean_turnover", False), ("symbol", True)])
    return placed.where(F.col("pos") < F.floor(F.col("n") * fraction)).select("symbol", "mean_turnover")


def keep_liquid(prices: DataFrame, fraction: float = 0.5) -> DataFrame:
    """D1 as a filter on the price rows."""
    return prices.join(liquid_half(prices, fraction).select("symbol"), "symbol", "left_semi")


def liquid_top_fraction(
    df: DataFrame, value: str, fraction: float = 0.10, group: Sequence[str] = ("as_of",)
) -> DataFrame:
    """Per date the top ``int(fraction * n)`` rows by value, ties at the cut kept."""
    group = list(group)
    have = df.where(F.col(value).isNotNull())
    # The smallest kept value is an order statistic: one row per group instead of a rank per row.
    at = {"__cut": F.col("__n") - F.floor(F.col("__n") * fraction)}
    cut = order_statistics(have, group, value, at, [1 - fraction]).drop("__n")
    return join_stats(have, cut, group).where(F.col(value) >= F.col("__cut")).drop("__cut")


def null_shares(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of missing values per column, from one aggregate pass."""
    columns = list(columns or df.columns)
    wide = df.agg(*[F.avg(_is_missing(df, c).cast("double")).alias(c) for c in columns])
    return wide.unpivot([], columns, "column", "null_share")


def drop_sparse_columns(df: DataFrame, limit: float = 0.8, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """D3: drop columns with more than ``limit`` missing; one row per column reaches the driver."""
    dropped = [r["column"] for r in null_shares(df).where(F.col("null_share") > limit).collect() if r["column"] not in keep]
    return df.drop(*dropped), dropped


def top_value_shares(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of the most frequent value per column, however small; null counts as a value.  Every distinct value is shuffled."""
    columns = list(columns or df.columns)
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    counts = text.unpivot([], columns, "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("column").agg((F.max("c") / F.sum("c")).alias("top_share"))


# A frequent-items sketch of this many values counts each to within 3.5 / TRACKED of the rows, in a few KB a column.
TRACKED = 256
LEAST_SHARE = 1 / 8


def heavy_value_shares(df: DataFrame, columns: Sequence[str] | None = None, least: float = LEAST_SHARE) -> DataFrame:
    """D4 ``(column, top_share)``: the exact share of the most frequent value where it covers at least ``least`` of the rows, else null.

    Two passes that shuffle one row per task.  The first merges one bounded
    sketch of frequent values per column, whose candidates hold every value of
    that share; the second counts each candidate exactly.  Null counts as a value.
    """
    if least < LEAST_SHARE:
        raise ValueError(f"the sketch is sure of shares of {LEAST_SHARE} and more")
    columns = list(columns or df.columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, top_share double")
    value = lambda c: F.col(f"`{c}`").cast("string")
    text = df.select(*[F.when(value(c).isNotNull(), F.xxhash64(value(c))).alias(f"__{i}") for i, c in enumerate(columns)])
    names = text.columns
    # Whatever the sketch may put before a value of that share is nearly as frequent.
    most = int(1 / (least - 3.5 / TRACKED)) + 1
    sketch = text.agg(*[F.expr(f"approx_top_k({c}, {most}, {TRACKED})").getField("item").alias(c) for c in names])
    candidates = stage_table(sketch, "heavy-values")
    # At most a few dozen values a column: a row of literals for the second pass.
    found = candidates.first()
    counts = []
    for c in names:
        hits = [F.count_if(F.col(c) == F.lit(v)) for v in found[c] or [] if v is not None]
        counts.append(F.greatest(F.count_if(F.col(c).isNull()), F.lit(0), *hits).alias(c))
    wide = text.agg(F.count(F.lit(1)).alias("__rows"), *counts)
    long = wide.unpivot("__rows", names, "__name", "__count")
    table = F.array(*[F.lit(c) for c in columns])
    share = F.try_divide("__count", "__rows")
    return long.select(
        F.element_at(table, F.substring("__name", 3, 12).cast("int") + 1).alias("column"), F.when(share >= least, share).alias("top_share")
    )


def drop_constant_columns(
    df: DataFrame, limit: float = 0.95, keep: Sequence[str] = ()
) -> tuple[DataFrame, list[str]]:
    """Drop columns whose most frequent value covers more than ``limit`` of the rows."""
    shares = heavy_value_shares(df) if limit >= LEAST_SHARE else top_value_shares(df)
    rows = shares.where(F.col("top_share") > limit).collect()
    dropped = [r["column"] for r in rows if r["column"] not in keep]
    return df.drop(*dropped), dropped


def drop_sparse_rows(df: DataFrame, fraction: float, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep rows with fewer than ``int((ncols + 1) * fraction)`` missing values.

    The limit counts the helper column the reference adds, hence ``ncols + 1``.
    """
    columns = list(columns or df.columns)
    missing = reduce(lambda a, b: a + b, [_is_missing(df, c).cast("int") for c in columns])
    return df.where(missing < int((len(columns) + 1) * fraction))


def sparse_column_counts(df: DataFrame, columns: Sequence[str], group: str = "as_of", share: float = 0.5) -> DataFrame:
    """On how many dates each column is at least ``int(n * share)`` missing."""
    per_date = df.groupBy(group).agg(
        F.floor(F.count(F.lit(1)) * share).alias("__limit"),
        *[F.sum(_is_missing(df, c).cast("long")).alias(c) for c in columns],
    )
    long = per_date.unpivot([group, "__limit"], list(columns), "column", "missing")
    return long.groupBy("column").agg(F.count_if(F.col("missing") >= F.col("__limit")).alias("n_dates"))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a missing value in the given columns."""
    return df.where(~reduce(lambda a, b: a | b, [_is_missing(df, c) for c in columns]))


@dataclass(frozen=True)
class Rules:
    """What a table must satisfy."""

    required: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    min_rows: int = 0
    unique: str | None = None


# The rule set of the four view tables.
TABLE_RULES = {
    "symbol_list": Rules(
        ("symbol", "exchangeShortName", "type", "ipoDate"), ("symbol", "exchangeShortName"), 1000, "symbol"
    ),
    "price": Rules(("date", "symbol", "close", "volume", "marketCap"), ("date", "symbol", "close"), 100000),
    "financial_statement": Rules(("date", "symbol", "revenue", "netIncome"), ("date", "symbol"), 10000),
    "metrics": Rules(("date", "symbol", "peRatio", "marketCap"), ("date", "symbol"), 10000),
}


def validate_table(df: DataFrame, name: str, rules: Rules | None = None) -> DataFrame:
    """Findings ``(table, check, column, severity, observed, limit)`` of one table.

    Severity is error, warning or info; a table passed when it has no error.
    All figures come from one aggregate pass over the table.
    """
    rules = rules or TABLE_RULES.get(name, Rules())
    types = dict(df.dtypes)
    has_date = types.get("date") in ("date", "timestamp", "timestamp_ntz")
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.sum(_is_missing(df, c).cast("long")).alias(f"__null_{c}") for c in df.columns]
    unique = rules.unique if rules.unique in types else None
    distinct = {c for c in (unique, "symbol" if "symbol" in types else None) if c}
    aggs += [F.count_distinct(c).alias(f"__distinct_{c}") for c in sorted(distinct)]
    if has_date:
        aggs += [F.min("date").cast("string").alias("__first"), F.max("date").cast("string").alias("__last")]
    stats = df.agg(*aggs)
    rows = F.col("__rows")

    def finding(check: str, column: str, severity: str, observed: Column, limit: Column, when: Column) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(check).alias("check"),
                F.lit(column).alias("column"),
                F.lit(severity).alias("severity"),
                observed.cast("string").alias("observed"),
                limit.cast("string").alias("limit"),
            ),
        )

    always, none = F.lit(True), F.lit(None)
    found = [finding("rows", "", "info", rows, none, always)]
    found.append(finding("columns", "", "info", F.lit(len(df.columns)), none, always))
    found += [finding("required", c, "error", F.lit("absent"), none, always) for c in rules.required if c not in types]
    found.append(finding("min_rows", "", "warning", rows, F.lit(rules.min_rows), rows < rules.min_rows))
    found += [
        finding("not_null", c, "error", F.col(f"__null_{c}"), F.lit(0), F.col(f"__null_{c}") > 0)
        for c in rules.not_null
        if c in types
    ]
    if unique:
        extra = rows - F.col(f"__distinct_{unique}") - F.when(F.col(f"__null_{unique}") > 0, 1).otherwise(0)
        found.append(finding("unique", unique, "warning", extra, F.lit(0), extra > 0))
    if "date" in types and not has_date:
        found.append(finding("date_type", "date", "error", F.lit(types["date"]), F.lit("date"), always))
    if has_date:
        found.append(finding("date_range", "date", "info", F.concat_ws("..", "__first", "__last"), none, always))
    found += [
        finding("mostly_null", c, "warning", F.col(f"__null_{c}"), rows * 0.5, F.col(f"__null_{c}") > rows * 0.5)
        for c in df.columns
    ]
    if "symbol" in types:
        found.append(finding("distinct_symbols", "symbol", "info", F.col("__distinct_symbol"), none, always))
    return (
        stats.select(F.explode(F.array_compact(F.array(*found))).alias("f"))
        .select(F.lit(name).alias("table"), "f.*")
    )


def validation_report(findings: DataFrame) -> DataFrame:
    """Per table its status, counts and messages, with the overall tally on every row."""
    text = F.concat_ws(" ", "check", F.nullif("column", F.lit("")), F.concat(F.lit("observed="), "observed"))
    lists = lambda s: F.sort_array(F.collect_list(F.when(F.col("severity") == s, text)))
    per_table = findings.groupBy("table").agg(
        F.count_if(F.col("severity") == "error").alias("n_errors"),
        F.count_if(F.col("severity") == "warning").alias("n_warnings"),
        lists("error").alias("errors"),
        lists("warning").alias("warnings"),
        lists("info").alias("info"),
    )
    status = F.when(F.col("n_errors") == 0, "passed").otherwise("failed")
    tally = {"n_passed": F.count_if(F.col("n_errors") == 0), "n_tables": F.count(F.lit(1))}
    return with_group_stats(per_table.withColumn("status", status), [], **tally)


def profile_table(df: DataFrame, columns: Sequence[str] | None = None, condition: str | None = None) -> DataFrame:
    """Per numeric column count, nulls and share, mean, std, min, quartiles, max; after an optional filter."""
    if condition is not None:
        df = df.where(condition)
    columns = list(columns or [c for c, t in df.dtypes if t in _NUMERIC])
    long = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    basic = long.groupBy("column").agg(
        F.count("value").alias("n"),
        F.count_if(F.col("value").isNull()).alias("n_null"),
        F.avg(F.col("value").isNull().cast("double")).alias("null_share"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quart = exact_percentiles(long, ["column"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return basic.join(quart, "column", "left")


def date_range(df: DataFrame, date_column: str = "date", key: str = "symbol") -> DataFrame:
    """First and last date and the number of distinct keys."""
    return df.agg(
        F.min(date_column).alias("first_date"), F.max(date_column).alias("last_date"), F.count_distinct(key).alias("n_keys")
    )


def sample_rows(df: DataFrame, n: int, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """A look at ``n`` rows, drawn at random when a fraction is given."""
    return (df.sample(fraction=fraction, seed=seed) if fraction else df).limit(n)


def finite_columns(df: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Per column whether every value is present and finite (per group when given)."""
    infinite = F.lit(float("inf"))
    ok = lambda c: F.bool_and(
        F.coalesce(~_is_missing(df, c) & (F.abs(F.col(c).cast("double")) < infinite), F.lit(False))
    )
    wide = df.groupBy(*group).agg(*[ok(c).alias(c) for c in columns])
    return wide.unpivot(list(group), list(columns), "column", "is_finite")


def findings_of(tables: Mapping[str, DataFrame], rules: Mapping[str, Rules] = TABLE_RULES) -> DataFrame:
    """D8 over several tables."""
    return reduce(DataFrame.unionByName, [validate_table(df, n, rules.get(n)) for n, df in tables.items()])
