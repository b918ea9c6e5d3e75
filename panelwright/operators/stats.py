"""Statistics, feature selection and monitoring."""

from __future__ import annotations

import math
import sys
from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.operators.ordered import join_stats, positions, running_sums, slices_for
from panelwright.session import stage_table

LOWER_IS_BETTER = ("rmse", "mae", "loss")
METRIC_PREFERENCE = ("accuracy", "f1", "rmse")
# Sums of one pair of columns over the rows where both are present.
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
# Fixed value: the 95th percentile of chi-square with one degree of freedom.
CHI2_1_95 = 3.841458820694124


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair ``(i, j, left, right, corr)`` over the rows where both are present.

    Each task adds up the pair sums of its rows, centred on the column means,
    as matrix products; the tasks' sums are added by pair.  One path for any width.
    A pair with fewer than two common rows or a constant side has no correlation.
    """
    columns = list(columns)
    k = len(columns)
    numbers = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"c{i}") for i, c in enumerate(columns)])
    means = [m or 0.0 for m in numbers.agg(*[F.avg(f"c{i}") for i in range(k)]).first()] if k else []

    def pair_sums(batches):
        left, right = np.triu_indices(k, 1)
        total = np.zeros((6, k, k))
        for batch in batches:
            x = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in batch.columns])
            there = ~np.isnan(x)
            z, m = np.where(there, x - np.asarray(means), 0.0), there.astype(float)
            zm, z2m = z.T @ m, (z * z).T @ m
            total += np.stack([m.T @ m, zm, zm.T, z2m, z2m.T, z.T @ z])
        arrays = [pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), *[pa.array(t[left, right]) for t in total]]
        yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", *_SUMS])

    parts = numbers.mapInArrow(pair_sums, "i int, j int, " + ", ".join(f"{c} double" for c in _SUMS))
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS])
    n, sx, sy, sxx, syy, sxy = [F.col(c) for c in _SUMS]
    spread = F.greatest(n * sxx - sx * sx, F.lit(0.0)) * F.greatest(n * syy - sy * sy, F.lit(0.0))
    names = F.array(*[F.lit(c) for c in columns]) if columns else F.array().cast("array<string>")
    return sums.select(
        "i", "j", F.get(names, F.col("i")).alias("left"), F.get(names, F.col("j")).alias("right"),
        F.try_divide(n * sxy - sx * sy, F.sqrt(spread)).alias("corr"),
    )


def correlated_columns(df: DataFrame, columns: Sequence[str], limit: float = 0.95) -> DataFrame:
    """Columns some earlier column exceeds the limit with, and that earlier column."""
    hit = correlations(df, columns).where(F.abs("corr") > limit)
    return hit.groupBy(F.col("right").alias("column")).agg(F.min_by("left", "i").alias("because_of"))


def prune_correlated(df: DataFrame, columns: Sequence[str], limit: float = 0.95) -> list[str]:
    """The columns that stay; one row per column reaches the driver."""
    dropped = {r["column"] for r in correlated_columns(df, columns, limit).collect()}
    return [c for c in columns if c not in dropped]


def binned(df: DataFrame, columns: Sequence[str], ids: Sequence[str], carry: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Equal-frequency bins per column in long form; ties are told apart by id."""
    long = df.select(*ids, *carry, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [*ids, *carry], list(columns), "feature", "value"
    )
    have = long.where(F.col("value").isNotNull())
    placed = positions(have, ["feature"], [("value", True), *[(i, True) for i in ids]])
    return placed.withColumn("bin", F.floor(F.col("pos") * bins / F.col("n"))).drop("pos", "n")


def rank_by_mutual_info(
    df: DataFrame, columns: Sequence[str], target: str, ids: Sequence[str], k: int, bins: int = 10, continuous: bool = False
) -> DataFrame:
    """Mutual information of binned features and the target (binned when continuous), best k.

    The quick, binned estimate; :func:`rank_by_neighbour_info` uses nearest neighbours.
    """
    if continuous:
        label = binned(df, [target], ids, bins=bins).select(*ids, F.col("bin").alias("__y"))
        df = df.join(label, list(ids))
    else:
        df = df.withColumn("__y", F.col(target))
    cells = binned(df, columns, ids, ["__y"], bins).groupBy("feature", "bin", "__y").agg(F.count(F.lit(1)).alias("c"))
    # From here on one row per feature, bin and class.
    total = cells.groupBy("feature").agg(F.sum("c").alias("n"))
    px = cells.groupBy("feature", "bin").agg(F.sum("c").alias("cx"))
    py = cells.groupBy("feature", "__y").agg(F.sum("c").alias("cy"))
    joined = cells.join(total, "feature").join(px, ["feature", "bin"])
    joined = join_stats(joined, py, ["feature", "__y"])
    share = F.col("c") / F.col("n")
    scores = joined.groupBy("feature").agg(
        F.sum(share * F.ln(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))).alias("score")
    )
    return scores.orderBy(F.col("score").desc(), "feature").limit(k)


# Rows of a class that one task looks at for neighbours, besides k of them on either side.
NEIGHBOUR_ROWS = 50_000
# Rounding: nearer than the k-th neighbour means nearer by more than this share of its distance.
NEARER = 1e-9


def digamma(n: Column) -> Column:
    """The digamma function of whole numbers from one on, by its asymptotic series from n + 8."""
    x = n + F.lit(8.0)
    series = F.ln(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    for i in range(8):
        series = series - 1 / (n + F.lit(float(i)))
    return series


def neighbour_radius(long: DataFrame, group: Sequence[str], value: str, ids: Sequence[str], k: int) -> DataFrame:
    """Rows with ``n`` (rows of their group), ``near`` (neighbours asked for) and ``radius``, the distance to the last of them.

    Positions come from a range sort, so a group may hold any share of the
    rows; it is then cut into runs of rows, each with a halo of the ``k`` rows
    before and after it, and neighbours are among those.  A group of one row
    has no neighbour and is left out.
    """
    slices = slices_for(long.count())
    placed = positions(long, list(group), [(value, True), *[(i, True) for i in ids]], slices=slices).where(F.col("n") > 1)
    run, at = F.floor(F.col("pos") / NEIGHBOUR_ROWS), F.pmod(F.col("pos"), F.lit(NEIGHBOUR_ROWS))
    halo = F.array(run, F.when(at < k, run - 1), F.when(at >= NEIGHBOUR_ROWS - k, run + 1))
    runs = placed.withColumn("__own", run).withColumn("__run", F.explode(F.array_compact(halo))).repartition(slices, *group, "__run")
    w = Window.partitionBy(*group, "__run").orderBy("pos")
    x = F.col(value)
    away = [x - F.lag(value, i).over(w) for i in range(1, k + 1)] + [F.lead(value, i).over(w) - x for i in range(1, k + 1)]
    sorted_away = F.array_sort(F.array_compact(F.array(*away)))
    near = F.least(F.lit(k).cast("long"), F.col("n") - 1)
    found = runs.withColumn("near", near).withColumn("radius", F.get(sorted_away, F.col("near").cast("int") - 1))
    return found.where(F.col("__run") == F.col("__own")).drop("__run", "__own", "pos")


def count_within(rows: DataFrame, group: Sequence[str], value: str, radius: Column, ids: Sequence[str], name: str = "within") -> DataFrame:
    """``(group, ids, name)``: how many rows of the group lie within ``radius`` of each row, itself included.

    The ends of each row's interval are sorted among the rows, and running
    counts are read off at both ends: no join on a range.
    """
    group, ids = list(group), list(ids)
    x = F.col(value)
    # An interval starts before the rows at its lower end and stops behind those at its upper end.
    marks = F.array(
        F.struct((x - radius).alias("__at"), F.lit(0).alias("__kind"), F.lit(0).alias("__one")),
        F.struct(x.alias("__at"), F.lit(1).alias("__kind"), F.lit(1).alias("__one")),
        F.struct((x + radius).alias("__at"), F.lit(2).alias("__kind"), F.lit(0).alias("__one")),
    )
    ends = rows.select(*group, *ids, F.inline(marks))
    order = [("__at", True), ("__kind", True), *[(i, True) for i in ids]]
    slices = slices_for(3 * rows.count())
    counted = running_sums(ends, group, order, {"__upto": "__one"}, slices)
    sign = F.when(F.col("__kind") == 0, -F.col("__upto")).when(F.col("__kind") == 2, F.col("__upto"))
    # Dealt by a number of partitions too, so that what a task adds up is bounded by rows.
    marked = counted.where(F.col("__kind") != 1).repartition(slices, *group, *ids)
    return marked.groupBy(*group, *ids).agg(F.sum(sign).alias(name))


def rank_by_neighbour_info(df: DataFrame, columns: Sequence[str], target: str, ids: Sequence[str], k: int, neighbours: int = 3) -> DataFrame:
    """Mutual information of numbers and a class by nearest neighbours (Ross 2014), best k.

    For each row the distance to its ``neighbours``-th neighbour of the same
    class, and how many rows of any class are nearer than that.  Negative
    estimates count as zero, classes of one row are left out.
    """
    ids = list(ids)
    long = df.select(*ids, F.col(target).alias("__y"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [*ids, "__y"], list(columns), "feature", "value"
    )
    have = long.where(F.col("value").isNotNull() & F.col("__y").isNotNull())
    near = stage_table(neighbour_radius(have, ["feature", "__y"], "value", ids, neighbours), "neighbour-radius")
    within = count_within(near, ["feature"], "value", F.col("radius") * (1 - NEARER), ids)
    per_class = near.groupBy("feature", "__y").agg(F.count(F.lit(1)).alias("n"), F.first("near").alias("near"))
    classes = per_class.groupBy("feature").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") * (digamma(F.col("near")) - digamma(F.col("n")))).alias("known")
    )
    counts = within.groupBy("feature", "within").agg(F.count(F.lit(1)).alias("c"))
    spread = counts.groupBy("feature").agg(F.sum(F.col("c") * digamma(F.col("within"))).alias("spread"))
    score = digamma(F.col("rows")) + (F.col("known") - F.col("spread")) / F.col("rows")
    scores = classes.join(spread, "feature").select("feature", F.greatest(score, F.lit(0.0)).alias("score"))
    return scores.orderBy(F.col("score").desc(), "feature").limit(k)


def rank_by_f_test(df: DataFrame, columns: Sequence[str], target: str, k: int, continuous: bool = False) -> DataFrame:
    """ANOVA F for classes, regression F (from r squared) for numbers, best k."""
    columns = list(columns)
    if continuous:
        # Each feature counts the rows that its own correlation is taken over.
        both = lambda c: F.count_if(F.col(c).isNotNull() & F.col(target).isNotNull())
        wide = df.agg(*[F.struct(F.corr(c, target).alias("r"), both(c).alias("n")).alias(c) for c in columns])
        long = wide.unpivot([], columns, "feature", "s").select("feature", "s.*")
        r2 = F.col("r") * F.col("r")
        scores = long.select("feature", (F.try_divide(r2, 1 - r2) * (F.col("n") - 2)).alias("score"))
    else:
        per_class = df.groupBy(target).agg(
            *[F.struct(F.count(c).alias("n"), F.avg(c).alias("m"), F.var_pop(c).alias("v")).alias(c) for c in columns]
        )
        long = per_class.unpivot([target], columns, "feature", "s").select("feature", "s.*")
        nm = F.col("n") * F.col("m")
        sums = long.groupBy("feature").agg(
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("classes"),
            F.sum(F.col("n") * F.col("v")).alias("within"),
            (F.sum(nm * F.col("m")) - F.sum(nm) * F.sum(nm) / F.sum("n")).alias("between"),
        )
        f = F.try_divide(
            F.col("between") / (F.col("classes") - 1), F.col("within") / (F.col("n") - F.col("classes"))
        )
        scores = sums.select("feature", f.alias("score"))
    return scores.orderBy(F.col("score").desc_nulls_last(), "feature").limit(k)


def _recent(metrics: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*by, "metric").orderBy(F.col("period").desc())
    return metrics.withColumn("__back", F.row_number().over(w)).where(F.col("__back") <= n)


def baseline(metrics: DataFrame, first: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the first periods per metric; none before that many periods exist.

    Metric tables hold one row per period and metric.
    """
    w = Window.partitionBy(*by, "metric").orderBy("period")
    early = metrics.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= first)
    out = early.groupBy(*by, "metric").agg(F.avg("value").alias("baseline"), F.count(F.lit(1)).alias("__n"))
    return out.where(F.col("__n") == first).drop("__n")


def _worse_by(value: str = "value") -> Column:
    change = F.try_divide(F.col("baseline") - F.col(value), F.col("baseline"))
    signed = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -change).otherwise(change)
    return F.coalesce(signed, F.lit(0.0))


def degradation_alerts(metrics: DataFrame, limit: float = 0.1, first: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Periods from the ``first``-th on that are worse than the baseline by more than ``limit``."""
    w = Window.partitionBy(*by, "metric").orderBy("period")
    numbered = metrics.withColumn("__i", F.row_number().over(w)).where(F.col("__i") >= first).drop("__i")
    out = numbered.join(baseline(metrics, first, by), [*by, "metric"]).withColumn("degradation", _worse_by())
    return out.where(F.col("degradation") > limit)


def should_retrain(metrics: DataFrame, periods: int = 3, limit: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """True when the deciding metric was beyond the limit in each of the last periods."""
    base = baseline(metrics, 3, by)
    order = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in METRIC_PREFERENCE]), F.col("metric")), F.lit(0))
    order = F.when(order == 0, 99).otherwise(order)
    chosen = base.groupBy(*by).agg(F.min(F.struct(order.alias("o"), "metric", "baseline")).alias("m")).select(*by, "m.metric", "m.baseline")
    recent = _recent(metrics, periods, by).join(chosen, [*by, "metric"])
    return recent.groupBy(*by, "metric", "baseline").agg(
        (F.bool_and(_worse_by() > limit) & (F.count(F.lit(1)) == periods)).alias("should_retrain")
    )


def metric_summary(metrics: DataFrame, window: int = 10, limit: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """I8: mean, std, min, max and current value over the last periods, with alert counts."""
    recent = _recent(metrics, window, by)
    stats = recent.groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.max_by("value", "period").alias("current"),
        F.max("period").alias("__last"),
    )
    alerts = degradation_alerts(metrics, limit, by=by).groupBy(*by, "metric").agg(
        F.count(F.lit(1)).alias("__alerts"), F.max("period").alias("__last_alert")
    )
    out = stats.join(alerts, [*by, "metric"], "left")
    return out.select(
        *by,
        "metric",
        "mean",
        "std",
        "min",
        "max",
        "current",
        F.coalesce("__alerts", F.lit(0)).alias("total_alerts"),
        F.coalesce((F.col("__last") == F.col("__last_alert")).cast("int"), F.lit(0)).alias("recent_alerts"),
    )


def ks_drift(reference: DataFrame, new: DataFrame, columns: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and asymptotic p per feature; drifted when p < alpha."""
    part = lambda df, flag: df.select(*columns, F.lit(flag).alias("__reference"))
    both = part(reference, True).unionByName(part(new, False))
    out = ks_drift_by_window(both, F.col("__reference"), {0: ~F.col("__reference")}, columns, alpha)
    return out.drop("window")


def ks_drift_by_window(
    df: DataFrame, reference: Column, windows: Mapping[int, Column], columns: Sequence[str], alpha: float = 0.05
) -> DataFrame:
    """I9 for many samples against one: ``window, feature, n_ref, n_new, ks_statistic, p_value, drifted``.

    ``reference`` and ``windows`` are conditions on the rows, which may overlap.
    Equal values are counted before the sort, once for all samples; one range
    sort per call carries a running count of every sample, so the reference is
    neither copied nor sorted again for a window, and no feature is gathered in
    one task.  Samples without a value of a feature give no row.
    """
    columns, names = list(columns), list(windows)
    counted = {"__ref": reference, **{f"__w{i}": windows[n] for i, n in enumerate(names)}}
    flags = [F.coalesce(c, F.lit(False)).cast("int").alias(f) for f, c in counted.items()]
    # Feature names may hold dots, which unpivot would read as field access.
    plain = [f"__c{i}" for i in range(len(columns))]
    values = [F.col(f"`{c}`").cast("double").alias(p) for c, p in zip(columns, plain, strict=True)]
    wide = df.select(*values, *flags).where(F.greatest(*[F.col(f) for f in counted], F.lit(0)) > 0)
    long = wide.unpivot(list(counted), plain, "__feature", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("__feature", "value").agg(*[F.sum(f).alias(f) for f in counted])
    run = running_sums(counts, ["__feature"], [("value", True)], {f"__s{f}": f for f in counted})
    totals = run.groupBy("__feature").agg(*[F.max(f"__s{f}").alias(f"__n{f}") for f in counted])
    share = lambda f: F.try_divide(f"__s{f}", f"__n{f}")
    gaps = [F.max(F.abs(share("__ref") - share(f))).alias(f"__g{f}") for f in list(counted)[1:]]
    found = join_stats(run, totals, ["__feature"]).groupBy("__feature", *[f"__n{f}" for f in counted]).agg(*gaps)
    # One row per feature from here on.
    each = F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"__n__w{i}").alias("n_new"), F.col(f"__g__w{i}").alias("ks_statistic")) for i, n in enumerate(names)])
    table = F.array(*[F.lit(c) for c in columns])
    stat = found.select(
        F.get(table, F.substring("__feature", 4, 12).cast("int")).alias("feature"), F.col("__n__ref").alias("n_ref"), F.inline(each)
    ).where((F.col("n_ref") > 0) & (F.col("n_new") > 0))
    lam = F.sqrt(F.col("n_ref") * F.col("n_new") / (F.col("n_ref") + F.col("n_new"))) * F.col("ks_statistic")
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda a, k: a + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * F.col("__lam") * F.col("__lam")),
    )
    p = F.when(F.col("__lam") < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), terms)))
    tested = stat.withColumn("__lam", lam).withColumn("p_value", p).withColumn("drifted", F.col("p_value") < alpha)
    return tested.select("window", "feature", "n_ref", "n_new", "ks_statistic", "p_value", "drifted")


def classification_metrics(
    df: DataFrame, label: str, prediction: str, threshold: float | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy and precision, recall, F1 of class 1; a score column needs a threshold."""
    hit = F.col(prediction) == 1 if threshold is None else F.col(prediction) >= threshold
    true = F.col(label) == 1
    out = df.groupBy(*by).agg(
        F.avg((hit == true).cast("double")).alias("accuracy"),
        F.count_if(hit & true).alias("__tp"),
        F.count_if(hit).alias("__p"),
        F.count_if(true).alias("__t"),
    )
    zero = F.lit(0.0)
    return out.select(
        *by,
        "accuracy",
        F.coalesce(F.try_divide(F.col("__tp"), F.col("__p")), zero).alias("precision"),
        F.coalesce(F.try_divide(F.col("__tp"), F.col("__t")), zero).alias("recall"),
        F.coalesce(F.try_divide(2.0 * F.col("__tp"), F.col("__p") + F.col("__t")), zero).alias("f1"),
    )


def regression_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """RMSE and MAE."""
    gap = F.col(label) - F.col(prediction)
    return df.groupBy(*by).agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"))


def prediction_loss(df: DataFrame, predictions: Sequence[str], label: str, cohort: str = "cohort") -> DataFrame:
    """Mean absolute error per cohort and variant, and over all cohorts so far.

    The running part is a window over one row per cohort and variant.
    """
    predictions = list(predictions)
    sums = df.groupBy(cohort).agg(
        F.count(label).alias("__n"), *[F.sum(F.abs(F.col(label) - F.col(p))).alias(p) for p in predictions]
    )
    long = sums.unpivot([cohort, "__n"], predictions, "model", "__s")
    w = Window.partitionBy("model").orderBy(cohort).rowsBetween(Window.unboundedPreceding, 0)
    return long.select(
        cohort,
        "model",
        (F.col("__s") / F.col("__n")).alias("loss"),
        (F.sum("__s").over(w) / F.sum("__n").over(w)).alias("accumulated_loss"),
    )


@F.pandas_udf(T.DoubleType())
def _chi2_tail(statistic: pd.Series) -> pd.Series:
    return statistic.map(lambda x: None if pd.isna(x) else math.erfc(math.sqrt(x / 2)))


# Tasks get this function with its module, also where the package is not installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def mcnemar(df: DataFrame, label: str, models: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """McNemar's test with continuity correction for every model pair, from one aggregate pass.

    Pairs without a discordant row have no statistic.  The p-value is evaluated
    on the result, one row per pair.
    """
    right = {m: F.col(m) == F.col(label) for m in models}
    pairs = list(combinations(models, 2))
    wide = df.agg(
        *[F.count_if(right[a] & ~right[b]).alias(f"b{k}") for k, (a, b) in enumerate(pairs)],
        *[F.count_if(~right[a] & right[b]).alias(f"c{k}") for k, (a, b) in enumerate(pairs)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("model1"),
                F.lit(b).alias("model2"),
                F.col(f"b{k}").alias("only_first"),
                F.col(f"c{k}").alias("only_second"),
            )
            for k, (a, b) in enumerate(pairs)
        ]
    )
    b, c = F.col("only_first"), F.col("only_second")
    out = wide.select(F.inline(rows)).withColumn(
        "statistic", F.try_divide(F.pow(F.abs(b - c) - 1, 2), (b + c).cast("double"))
    )
    out = out.withColumn("p_value", _chi2_tail("statistic"))
    better = F.when(F.col("p_value") < alpha, F.when(b > c, F.col("model1")).otherwise(F.col("model2")))
    return out.withColumn("better", better)


def compare_models(results: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Results in order of the metric, best first, with their place (one row per model)."""
    w = Window.orderBy(F.col(metric).desc_nulls_last(), "model_name")
    return results.withColumn("place", F.row_number().over(w))


def is_improved(
    results: DataFrame, new: str, base: str, metric: str = "accuracy", threshold: float = 0.01
) -> DataFrame:
    """One row with both scores and whether new beats base by more than the threshold; none if one is missing."""
    pick = lambda name: F.max(F.when(F.col("model_name") == name, F.col(metric)))
    out = results.agg(pick(new).alias("new_score"), pick(base).alias("base_score"))
    gain = F.col("new_score") - F.col("base_score")
    return out.where(F.col("new_score").isNotNull() & F.col("base_score").isNotNull()).select(
        "new_score", "base_score", gain.alias("improvement"), (gain > threshold).alias("improved")
    )


def best_model(results: DataFrame, metric: str = "accuracy") -> DataFrame:
    """The row of the best model."""
    return results.orderBy(F.col(metric).desc_nulls_last(), "model_name").limit(1)


def agreement_correlation(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Correlation of the base models' predictions."""
    return correlations(df, models).select("left", "right", "corr")

