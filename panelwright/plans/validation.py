"""Walk-forward validation (H6, H7): one fit per window over one staged table, several at a time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date as Date
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from panelwright.models import jobs
from panelwright.operators import quality, splits, stats
from panelwright.session import stage_table


def _slice(df: DataFrame, date: str, start: Date, end: Date) -> DataFrame:
    """Half-open date slice; a plain filter, so partitions and row groups are pruned."""
    return df.where((F.col(date) >= F.lit(start)) & (F.col(date) < F.lit(end)))


def walk_forward(
    df: DataFrame, windows: DataFrame, train: jobs.TrainFn, evaluate: jobs.EvaluateFn, date: str = "date", parallelism: int = jobs.PARALLEL_FITS
) -> DataFrame:
    """H6: one row per window with its bounds, row counts and metrics in long form.

    Windows empty on either side are skipped; one pass counts all of them.
    Only the window table, its counts and one metric row per window reach the driver.
    Windows are independent; ``parallelism`` of them run side by side.
    """
    spark = df.sparkSession
    tagged = splits.assign_windows(df.select(date), windows, date)
    counts = {(r["window"], r.role): r["count"] for r in tagged.groupBy("window", "role").count().collect()}
    filled = [w for w in windows.orderBy("window").collect() if counts.get((w["window"], "train")) and counts.get((w["window"], "test"))]

    def judged(w: Row) -> list[tuple]:
        past, ahead = _slice(df, date, w.train_start, w.train_end), _slice(df, date, w.test_start, w.test_end)
        sizes = counts[w["window"], "train"], counts[w["window"], "test"]
        return [(*_bounds(w), *sizes, name, float(v)) for name, v in evaluate(train(past), ahead).items() if v is not None]

    per_window = jobs.concurrently(spark, [lambda w=w: judged(w) for w in filled], parallelism)
    rows = [row for found in per_window for row in found]
    return spark.createDataFrame(rows, _RESULT)


_RESULT = (
    "window long, train_start date, train_end date, test_start date, test_end date, "
    "train_samples long, test_samples long, metric string, value double"
)


def _bounds(w: Row) -> tuple:
    return (w["window"], w.train_start, w.train_end, w.test_start, w.test_end)


@dataclass
class RobustResult:
    """Outcome of a robust walk-forward run."""

    features: list[str]
    results: DataFrame
    cross_validation: DataFrame | None
    drift: DataFrame | None
    alerts: DataFrame
    retrain: DataFrame

    def averages(self) -> DataFrame:
        """Mean and sample deviation of each metric over the windows."""
        return self.results.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def robust_walk_forward(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    estimator: Any,
    start: Date,
    end: Date,
    train_months: int,
    test_months: int,
    every: int,
    date: str = "date",
    ids: Sequence[str] = ("id",),
    anchored: bool = False,
    selection: str | None = "f_test",
    top_k: int = 10,
    use_cv: bool = False,
    monitor: bool = True,
    classification: bool = True,
    alert_limit: float = 0.1,
) -> RobustResult:
    """H7: features picked on the first twelve months, then H6 with optional CV, drift and degradation checks.

    Drift compares each test slice with the first one; the reference is explicit.
    The complete rows are written once, in date order, so that a window reads its own part of them.
    """
    spark = df.sparkSession
    chosen = list(features)
    if selection:
        year_end = Date(start.year + 1, start.month, min(start.day, 28))
        early = quality.complete_cases(_slice(df, date, start, year_end), [*features, label])
        if not early.isEmpty():
            chosen = jobs.select(early, features, label, selection, top_k, ids, continuous=not classification)
    windows = splits.walk_forward_windows(spark, start, end, train_months, test_months, every, anchored)
    used = dict.fromkeys([date, *ids, *chosen, label])
    clean = quality.complete_cases(df.select(*used), [*chosen, label])
    clean = stage_table(clean.repartitionByRange(date, *ids).sortWithinPartitions(date), "walk-forward")
    train, evaluate = jobs.model_functions(chosen, label, estimator, classification)
    results = walk_forward(clean, windows, train, evaluate, date)
    cv = drift = None
    bounds = windows.orderBy("window").collect()
    if use_cv:
        parts = []
        for w in bounds:
            past = _slice(clean, date, w.train_start, w.train_end)
            if past.isEmpty():
                continue
            summary, _model = jobs.cross_validate(past, chosen, label, estimator, [date, *ids], 3, classification)
            parts.append(summary.select(F.lit(w["window"]).alias("window"), "*"))
        cv = reduce(DataFrame.unionByName, parts) if parts else None
    if monitor and len(bounds) > 1:
        held = {w["window"]: (F.col(date) >= F.lit(w.test_start)) & (F.col(date) < F.lit(w.test_end)) for w in bounds}
        reference = held.pop(bounds[0]["window"])
        drift = stats.ks_drift_by_window(clean, reference, held, chosen)
    history = results.select(F.col("test_start").alias("period"), "metric", "value")
    return RobustResult(
        chosen,
        results,
        cv,
        drift,
        stats.degradation_alerts(history, alert_limit),
        stats.should_retrain(history, 3, alert_limit),
    )
