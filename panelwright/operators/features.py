"""Feature and label expressions over panel tables."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions import tsfeat
from panelwright.functions.names import keep_feature
from panelwright.operators.ordered import exact_percentiles, join_stats, with_group_stats
from panelwright.session import stage_table

CHANGE_LAGS = (3, 6, 12, 24)


def _per_symbol(order: str) -> Window:
    # (symbol, date) is unique, so one symbol has at most one row per day.
    return Window.partitionBy("symbol").orderBy(order)


def price_change(df: DataFrame, order: str = "date", price: str = "close") -> DataFrame:
    """Difference to the symbol's previous row."""
    return df.withColumn("price_diff", F.col(price) - F.lag(price).over(_per_symbol(order)))


def price_return(df: DataFrame, order: str = "date", price: str = "close") -> DataFrame:
    """That difference over the previous price; null without or with a zero previous price."""
    previous = F.lag(price).over(_per_symbol(order))
    return df.withColumn("price_dev", F.try_divide(F.col(price) - previous, previous))


def turnover(price: str = "close", volume: str = "volume") -> Column:
    """Price times volume."""
    return F.col(price) * F.col(volume)


def over_marketcap(df: DataFrame, columns: Sequence[str], cap: str = "marketCap") -> DataFrame:
    """``OverMC_c`` = c / cap, null unless cap > 0."""
    return df.select("*", *[F.when(F.col(cap) > 0, F.col(c) / F.col(cap)).alias(f"OverMC_{c}") for c in columns])


def ev_multiples(df: DataFrame, columns: Sequence[str], cap: str = "marketCap", debt: str = "netDebt") -> DataFrame:
    """E5: ``adaptiveMC_ev`` = cap + debt, ``adaptiveMC_c`` = ev / c, null unless c > 0."""
    ev = F.col(cap) + F.col(debt)
    return df.select(
        "*", ev.alias("adaptiveMC_ev"), *[F.when(F.col(c) > 0, ev / F.col(c)).alias(f"adaptiveMC_{c}") for c in columns]
    )


def pct_change(df: DataFrame, columns: Sequence[str], lags: Sequence[int] = CHANGE_LAGS) -> DataFrame:
    """``diff{n}_c`` against ``prev{n}_c``, null unless the previous value is > 0."""
    out = []
    for n in lags:
        for c in columns:
            prev = F.col(f"prev{n}_{c}")
            out.append(F.when(prev > 0, (F.col(c) - prev) / prev).alias(f"diff{n}_{c}"))
    return df.select("*", *out)


def market_relative(df: DataFrame, column: str, cohort: Sequence[str]) -> DataFrame:
    """Value minus the cohort mean, as ``{column}_subavg``."""
    out = with_group_stats(df, list(cohort), __mean=F.avg(column))
    return out.withColumn(f"{column}_subavg", F.col(column) - F.col("__mean")).drop("__mean")


def sector_relative(df: DataFrame, column: str, cohort: Sequence[str], sector: str = "sector") -> DataFrame:
    """Value minus the sector's mean in the cohort; null without a sector."""
    out = with_group_stats(df, [*cohort, sector], __mean=F.avg(column))
    value = F.when(F.col(sector).isNotNull(), F.col(column) - F.col("__mean"))
    return out.withColumn(f"sec_{column}_subavg", value).drop("__mean")


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(ids, kind, value), null values dropped."""
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(ids), list(columns), "kind", "value").where(F.col("value").isNotNull())


def time_series_features(
    long: DataFrame,
    ids: Sequence[str],
    time: str = "time",
    window: int = 12,
    fourier: Sequence[int] = (0,),
    solver: bool = False,
    filtered: bool = True,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """One row per (ids, kind) with a column per feature of the values in time order.

    Names are filtered (D13) before anything is computed.  The array of a group
    holds one window, which the caller bounds (C9).
    """
    points = long.groupBy(*ids, "kind").agg(F.sort_array(F.collect_list(F.struct(time, "value"))).alias("__p"))
    values = points.select(*ids, "kind", F.col("__p.value").alias("__v"))
    return array_features(values, [*ids, "kind"], "__v", window, fourier, solver, filtered, features)


def array_features(
    df: DataFrame,
    ids: Sequence[str],
    values: str,
    window: int = 12,
    fourier: Sequence[int] = (0,),
    solver: bool = False,
    filtered: bool = True,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """E10 on an array column that is already in time order."""
    exprs = tsfeat.feature_expressions(window, fourier)
    if features is not None:
        exprs = {k: exprs[k] for k in features if k in exprs}
    if filtered:
        exprs = {k: v for k, v in exprs.items() if keep_feature(k)}
    base = df.select(*ids, *tsfeat.with_moments(values))
    spread = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - F.col("m")) * (v - F.col("m"))) / F.col("n"))
    # Values that are all equal have deviation zero, whatever the mean rounds to.
    sd = F.when(F.col("mn") == F.col("mx"), F.lit(0.0)).otherwise(spread)
    base = base.select("*", sd.alias("sd"), F.expr(tsfeat.quantile(0.5)).alias("md"))
    out = [F.expr(e).cast("double").alias(name) for name, e in exprs.items()]
    if not solver:
        return base.select(*ids, *out)
    names = tsfeat.solver_feature_names()
    solved = base.withColumn("__s", tsfeat.solver_features()("x"))
    out += [F.col("__s")[i].alias(name) for i, name in enumerate(names) if not filtered or keep_feature(name)]
    return solved.select(*ids, *out)


def vector_names(window: int = 12, fourier: Sequence[int] = (0,), features: Sequence[str] | None = None, filtered: bool = True) -> list[str]:
    """The name table of E10's vectors: all kept features (D13), or the given ones."""
    names = tsfeat.feature_names(window, fourier) if features is None else list(features)
    return [n for n in names if not filtered or keep_feature(n)]


def feature_vectors(
    df: DataFrame, ids: Sequence[str], values: str, names: Sequence[str], window: int = 12, fourier: Sequence[int] = (0,)
) -> DataFrame:
    """E10 as one column ``features``: an array with a value per name, null where a feature has none.

    The plan has one node for any number of features; windows of a batch are computed together.
    """
    narrow = df.select(*ids, F.coalesce(F.col(values).cast("array<double>"), F.array().cast("array<double>")).alias("features"))
    return narrow.mapInArrow(tsfeat.feature_vectors(list(names), window, fourier), narrow.schema)


def vectors_wide(df: DataFrame, ids: Sequence[str], kinds: Sequence[str], width: int) -> DataFrame:
    """E11 on vectors: one row per id with the vectors of all kinds behind each other, nulls for a missing kind."""
    none = F.array_repeat(F.lit(None).cast("double"), width)
    own = [F.coalesce(F.max(F.when(F.col("kind") == k, F.col("features"))), none) for k in kinds]
    return df.groupBy(*ids).agg(F.concat(*own).alias("features"))


def vectors_long(df: DataFrame, ids: Sequence[str], names: Sequence[str], vector: str = "features") -> DataFrame:
    """``(ids, name, value)`` of a vector column."""
    table = F.array(*[F.lit(n) for n in names])
    rows = df.select(*ids, F.posexplode(vector).alias("__i", "value"))
    return rows.select(*ids, F.get(table, F.col("__i")).alias("name"), "value")


def features_wide(
    features: DataFrame, ids: Sequence[str], kinds: Sequence[str], marker: str = "{kind}_ts_{feature}"
) -> DataFrame:
    """One row per id; columns ``{kind}_ts_{feature}`` for a known kind list."""
    names = [c for c in features.columns if c not in {*ids, "kind"}]
    return features.groupBy(*ids).agg(
        *[
            F.max(F.when(F.col("kind") == k, F.col(f"`{f}`"))).alias(marker.format(kind=k, feature=f))
            for k in kinds
            for f in names
        ]
    )


def robust_scale(df: DataFrame, columns: Sequence[str], cohort: Sequence[str]) -> DataFrame:
    """(x - median) / (q75 - q25) inside each cohort; a zero spread counts as 1."""
    cohort, columns = list(cohort), list(columns)
    # Feature names may hold dots, which unpivot would read as field access.
    plain = [f"__c{i}" for i in range(len(columns))]
    numbered = [F.col(f"`{c}`").cast("double").alias(p) for c, p in zip(columns, plain, strict=True)]
    long = df.select(*cohort, *numbered).unpivot(cohort, plain, "__column", "__value")
    stats = exact_percentiles(long, [*cohort, "__column"], "__value", {"lo": 0.25, "mid": 0.5, "hi": 0.75})
    wide = stats.groupBy(*cohort).agg(
        *[
            F.max(F.when(F.col("__column") == p, F.struct("lo", "mid", "hi"))).alias(f"__s{i}")
            for i, p in enumerate(plain)
        ]
    )
    joined = join_stats(df, wide, cohort, "left")
    scaled = []
    for i, c in enumerate(columns):
        spread = F.col(f"__s{i}.hi") - F.col(f"__s{i}.lo")
        spread = F.when(spread == 0, 1.0).otherwise(spread)
        scaled.append(((F.col(f"`{c}`") - F.col(f"__s{i}.mid")) / spread).alias(c))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return joined.select(*rest, *scaled)


# Cohorts up to this many rows are sorted where their vectors meet, CHUNK columns to a task; larger ones over range slices.
COHORT_ROWS = 100_000
CHUNK = 64


def _chunk_quartiles(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    values = np.sort(np.stack(part["part"].to_numpy()).astype(float), axis=0)
    n = (~np.isnan(values)).sum(axis=0)
    columns, out = np.arange(values.shape[1]), []
    for p in (0.25, 0.5, 0.75):
        at = p * np.maximum(n - 1, 0)
        low, high = values[np.floor(at).astype(int), columns], values[np.ceil(at).astype(int), columns]
        out.append([None if k == 0 else v for k, v in zip(n, low + (high - low) * (at - np.floor(at)), strict=True)])
    return pd.DataFrame([(*key, *out)])


def vector_quartiles(df: DataFrame, vector: str, width: int, cohort: Sequence[str]) -> DataFrame:
    """Per cohort ``lo``, ``mid`` and ``hi``: the exact quartiles of each element of a vector column, nulls left out."""
    cohort = list(cohort)
    sizes = stage_table(df.groupBy(*cohort).agg(F.count(F.lit(1)).alias("__rows")), "cohort-sizes")
    sized = join_stats(df.select(*cohort, vector), sizes, cohort)
    parts = F.array(*[F.slice(vector, low + 1, CHUNK) for low in range(0, width, CHUNK)])
    chunks = sized.where(F.col("__rows") <= COHORT_ROWS).select(*cohort, F.posexplode(parts).alias("chunk", "part"))
    schema = T.StructType([*[df.schema[c] for c in cohort], T.StructField("chunk", T.IntegerType())])
    for name in ("lo", "mid", "hi"):
        schema = schema.add(name, T.ArrayType(T.DoubleType()))
    found = chunks.groupBy(*cohort, "chunk").applyInPandas(_chunk_quartiles, schema)
    if sizes.where(F.col("__rows") > COHORT_ROWS).isEmpty():
        return _joined_chunks(found, cohort)
    large = sized.where(F.col("__rows") > COHORT_ROWS).select(*cohort, F.posexplode(vector).alias("chunk", "value"))
    single = exact_percentiles(large, [*cohort, "chunk"], "value", {"lo": 0.25, "mid": 0.5, "hi": 0.75})
    # A column without values has no percentile; it keeps its place.
    every = sizes.where(F.col("__rows") > COHORT_ROWS).select(*cohort, F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("chunk"))
    single = join_stats(every, single, [*cohort, "chunk"], "left").select(*cohort, "chunk", *[F.array(c).alias(c) for c in ("lo", "mid", "hi")])
    return _joined_chunks(found, cohort).unionByName(_joined_chunks(single, cohort))


def _joined_chunks(found: DataFrame, cohort: list[str]) -> DataFrame:
    by_chunk = found.groupBy(*cohort).agg(F.sort_array(F.collect_list(F.struct("chunk", "lo", "mid", "hi"))).alias("__p"))
    return by_chunk.select(*cohort, *[F.flatten(F.col(f"__p.{c}")).alias(c) for c in ("lo", "mid", "hi")])


def robust_scale_vectors(df: DataFrame, vector: str, width: int, cohort: Sequence[str]) -> DataFrame:
    """E12 on every element of a vector column of ``width`` values; ``df`` is read twice."""
    stats = stage_table(vector_quartiles(df, vector, width, cohort), "quartiles")
    spread = F.zip_with("hi", "lo", lambda a, b: F.when(a == b, F.lit(1.0)).otherwise(a - b))
    stats = stats.select(*cohort, F.col("mid").alias("__mid"), spread.alias("__spread"))
    joined = join_stats(df, stats, list(cohort), "left")
    scaled = F.zip_with(F.zip_with(vector, "__mid", lambda x, mid: x - mid), "__spread", lambda x, s: x / s)
    return joined.withColumn(vector, scaled).drop("__mid", "__spread")


def orient_high_good(df: DataFrame, directions: Mapping[str, str], cohort: Sequence[str]) -> DataFrame:
    """``{c}_sorted`` columns where high is good; a "low" column maps x >= 0 to -x and x < 0 to x - max."""
    low = [c for c, d in directions.items() if d == "low"]
    out = with_group_stats(df, list(cohort), **{f"__max_{c}": F.max(c) for c in low}) if low else df
    added = []
    for c, d in directions.items():
        value = F.col(c)
        if d == "low":
            value = F.when(value >= 0, -value).otherwise(value - F.col(f"__max_{c}"))
        added.append(value.alias(f"{c}_sorted"))
    return out.select(*df.columns, *added)


def label_up(df: DataFrame, column: str = "price_dev", name: str = "label_up") -> DataFrame:
    """1 when the return is positive, 0 otherwise, null without a return."""
    return df.withColumn(name, (F.col(column) > 0).cast("int"))


def forward_label(df: DataFrame, steps: int, order: str = "date", price: str = "close") -> DataFrame:
    """Percentage return to the row ``steps`` later, and target = return > 0; tail rows dropped."""
    future = F.lead(price, steps).over(_per_symbol(order))
    out = df.withColumn("future_price", future).where(F.col("future_price").isNotNull())
    back = F.try_divide(F.col("future_price") - F.col(price), F.col(price)) * 100
    out = out.withColumn("future_return", back).where(F.col("future_return").isNotNull())
    return out.withColumn("target", (F.col("future_return") > 0).cast("int"))


def minmax10(df: DataFrame, column: str, name: str, group: Sequence[str] = ()) -> DataFrame:
    """Scale to 0..10 over the frame; null when all values are equal."""
    out = with_group_stats(df, list(group), __lo=F.min(column), __hi=F.max(column))
    scaled = F.try_divide(F.col(column) - F.col("__lo"), F.col("__hi") - F.col("__lo")) * 10
    return out.withColumn(name, scaled).drop("__lo", "__hi")


# Tasks get this module's functions also where the package is not installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
