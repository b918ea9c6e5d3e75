"""Time-ordered splits and validation windows.

Row positions come from counts per range of the order keys; fold membership is
arithmetic on the position, so no fold table is joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date as Date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators.asof import covered_days
from panelwright.operators.ordered import bucket_positions


def _tagged(df: DataFrame, order: Sequence[str], roles) -> DataFrame:
    placed = bucket_positions(df, order, "__pos", "__n")

    def named(role: str, folds: Column) -> Column:
        return F.transform(folds, lambda f: F.struct(f.cast("long").alias("fold"), F.lit(role).alias("role")))

    both = F.concat(*[named(role, folds) for role, folds in roles])
    return placed.withColumn("__f", F.explode(both)).select(*df.columns, "__f.fold", "__f.role")


def _span(low: Column, high: Column) -> Column:
    """The integers low..high, empty when low > high."""
    return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<bigint>"))


def ts_folds(df: DataFrame, n_splits: int, order: Sequence[str]) -> DataFrame:
    """H1: growing train, next block as validation; block size is ``n // (n_splits + 1)``.

    ``order`` must be total (date and id).  One row per row, fold and role.
    """
    pos, n = F.col("__pos"), F.col("__n")
    size = F.floor(n / (n_splits + 1))
    start = lambda f: n - (n_splits - f + 1) * size
    folds = F.sequence(F.lit(1), F.lit(n_splits))
    train = F.filter(folds, lambda f: pos < start(f))
    valid = F.filter(folds, lambda f: (start(f) <= pos) & (pos < start(f) + size))
    return _tagged(df, order, [("train", train), ("validation", valid)])


def ts_blocks(df: DataFrame, n_splits: int, order: Sequence[str], output: str = "block") -> DataFrame:
    """The folds of ``ts_folds`` as one number per row: fold f trains on blocks below f and is validated on block f.

    Each row comes once; with fewer than ``n_splits + 1`` rows all lie in block 0.
    """
    placed = bucket_positions(df, order, "__pos", "__n")
    size = F.floor(F.col("__n") / (n_splits + 1))
    into = F.col("__pos") - (F.col("__n") - n_splits * size)
    block = F.when((size > 0) & (into >= 0), F.floor(into / size) + 1).otherwise(0)
    return placed.select(*df.columns, block.cast("long").alias(output))


def time_holdout(df: DataFrame, order: Sequence[str], share: float = 0.2, output: str = "late") -> DataFrame:
    """Mark the last ``floor(n * share)`` rows in time order, the part a model is watched on while it grows."""
    placed = bucket_positions(df, order, "__pos", "__n")
    late = F.col("__pos") >= F.col("__n") - F.floor(F.col("__n") * share)
    return placed.select(*df.columns, late.alias(output))


def expanding_folds(df: DataFrame, initial: int, test: int, step: int | None, order: Sequence[str]) -> DataFrame:
    """H2: train ``[0, initial + (f-1)*step)``, test the next ``test`` rows, f = 1, 2, ..."""
    step = step or test
    pos, n = F.col("__pos"), F.col("__n")
    last = F.floor((n - initial - test) / step)
    before = F.floor((pos - initial) / step)
    train = _span(F.greatest(F.lit(0).cast("long"), before + 1), last)
    tests = _span(
        F.greatest(F.lit(0).cast("long"), F.floor((pos - initial - test) / step) + 1), F.least(last, before)
    )
    shift = lambda a: F.transform(a, lambda f: f + 1)
    return _tagged(df, order, [("train", shift(train)), ("test", shift(tests))])


def rolling_folds(df: DataFrame, train: int, test: int, step: int | None, order: Sequence[str]) -> DataFrame:
    """H3: train a fixed ``train`` rows, test the next ``test`` rows, both moving by ``step``."""
    step = step or test
    pos, n = F.col("__pos"), F.col("__n")
    last = F.floor((n - train - test) / step)
    zero = F.lit(0).cast("long")
    trains = _span(F.greatest(zero, F.floor((pos - train) / step) + 1), F.least(last, F.floor(pos / step)))
    tests = _span(
        F.greatest(zero, F.floor((pos - train - test) / step) + 1), F.least(last, F.floor((pos - train) / step))
    )
    shift = lambda a: F.transform(a, lambda f: f + 1)
    return _tagged(df, order, [("train", shift(trains)), ("test", shift(tests))])


def walk_forward_windows(
    spark: SparkSession,
    start: Date,
    end: Date,
    train_months: int,
    test_months: int,
    every: int,
    anchored: bool = False,
) -> DataFrame:
    """H4: windows until the test would pass ``end``; the train start stays put when anchored."""
    months = (end.year - start.year) * 12 + end.month - start.month + 1
    first = F.lit(start)
    at = F.add_months(first, (train_months + F.col("id") * every).cast("int"))
    back = first if anchored else F.add_months(first, (F.col("id") * every).cast("int"))
    # spark.range is bounded by the number of months between the two dates.
    out = spark.range(max(months // every + 1, 1)).select(
        (F.col("id") + 1).alias("window"),
        back.alias("train_start"),
        at.alias("train_end"),
        at.alias("test_start"),
        F.add_months(at, test_months).alias("test_end"),
    )
    return out.where((F.col("test_end") <= F.lit(end)) & (F.col("test_start") < F.lit(end)))


def assign_windows(df: DataFrame, windows: DataFrame, date: str = "date") -> DataFrame:
    """H5: rows tagged train or test per window, half-open; windows empty on either side dropped."""
    part = lambda role: covered_days(
        windows, F.col(f"{role}_start"), F.date_sub(f"{role}_end", 1)
    ).select("window", F.lit(role).alias("role"), F.col("day").alias("__day"))
    days = part("train").unionByName(part("test"))
    tagged = df.join(days, F.col(date) == F.col("__day")).drop("__day")
    full = (
        tagged.groupBy("window")
        .agg(F.bool_or(F.col("role") == "train").alias("a"), F.bool_or(F.col("role") == "test").alias("b"))
        .where("a AND b")
        .select("window")
    )
    return tagged.join(full, "window", "left_semi")


def year_split(
    df: DataFrame,
    train_years: Sequence[int],
    test_years: Sequence[int],
    test_quarters: Sequence[str] | None = None,
    year: str = "calendarYear",
    quarter: str = "period",
) -> tuple[DataFrame, DataFrame]:
    """H8: train and test rows by year (and quarter for the test side)."""
    test = F.col(year).isin(*test_years)
    if test_quarters:
        test = test & F.col(quarter).isin(*test_quarters)
    return df.where(F.col(year).isin(*train_years)), df.where(test)


def predict_rows(df: DataFrame, day: Date, date: str = "date") -> DataFrame:
    """H9: rows at a date, or at the newest date when there are none."""
    at = df.agg(F.coalesce(F.max(F.when(F.col(date) == F.lit(day), F.col(date))), F.max(date))).scalar()
    return df.where(F.col(date) == at)
