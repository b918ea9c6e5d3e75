"""Ranking, scoring and selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.ordered import (
    exact_percentiles,
    first_per_key,
    join_stats,
    tie_counts,
    top_per_group,
    with_group_stats,
)

# The slices of the top-k evaluation; "0~3" holds four rows.
TOP_SLICES = ((0, 3), (0, 7), (0, 15))
SECTOR_SLICES = ((0, 3), (0, 7))
GATE_PERCENTILE = 92


@dataclass(frozen=True)
class Plan:
    """One row of a plan table."""

    key: str
    diff: float
    weight: float = 1.0
    key_dir: str = "high"
    base: str = ">"
    base_dir: str = "0"


def _leading_rows(rows: DataFrame, group: Sequence[str], value: str, k: int) -> DataFrame:
    """Rows whose best-tie rank can be <= k: those not below the group's k-th largest value.

    The k-th row is found with a per-task cut before the shuffle, so the rest of
    the rows is filtered where it lies.  Nulls rank last.
    """
    kth = top_per_group(rows.select(*group, value), group, [(value, False)], k, "__rn").where(F.col("__rn") == k)
    edge = kth.select(*group, F.col(value).alias("__kth"), F.lit(True).alias("__full"))
    near = join_stats(rows, edge, group, "left")
    keep = F.col("__full").isNull() | F.col("__kth").isNull() | (F.col(value) >= F.col("__kth"))
    return near.where(keep).drop("__kth", "__full")


def _top_value_ranks(leading: DataFrame, group: Sequence[str], value: str, k: int) -> DataFrame:
    """Best-rank of the leading values: at most k distinct values can have rank <= k."""
    counts = leading.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__c"))
    top = top_per_group(counts, group, [(value, False)], k, "__rn")
    before = Window.partitionBy(*group).orderBy("__rn").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("__c").over(before), F.lit(0)) + 1
    return top.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rn", "__c")


def plan_score(
    df: DataFrame,
    key: str,
    k: int,
    base_score: float,
    diff: float,
    group: Sequence[str] = ("as_of",),
    all_ranks: bool = False,
) -> DataFrame:
    """F1: ``{key}_rank`` (ties share the best rank, nulls last) and ``{key}_score``.

    Rank r <= k scores ``base - (r-1)*diff``, all other rows 0.  Only the
    leading values are ranked, and ties are counted before the shuffle.
    Without ``all_ranks`` the rank is null beyond k.
    """
    group = list(group)
    if all_ranks:
        known = df.groupBy(*group).agg(F.count(key).alias("__known"))
        out = join_stats(tie_counts(df, group, key, ascending=False), known, group)
        out = out.withColumn("__rank", F.coalesce("n_before", "__known") + 1).drop("__known", "n_before", "n_equal")
    else:
        leading = _leading_rows(df.select(*group, key), group, key, k)
        out = join_stats(df, _top_value_ranks(leading, group, key, k), [*group, key], "left")
    score = F.when(F.col("__rank") <= k, F.lit(float(base_score)) - (F.col("__rank") - 1) * diff).otherwise(0.0)
    return out.withColumn(f"{key}_score", score).withColumnRenamed("__rank", f"{key}_rank")


def plan_score_weighted(
    df: DataFrame,
    key: str,
    k: int,
    base_score: float,
    diff: float,
    weight: float,
    group: Sequence[str] = ("as_of",),
    ids: Sequence[str] = ("symbol",),
) -> DataFrame:
    """F2: exactly the top k rows score ``weight * (base - i*diff)``; rank of the scores, -1 outside."""
    group, ids = list(group), list(ids)
    top = top_per_group(df.select(*group, *ids, key), group, [(key, False), *[(i, True) for i in ids]], k, "__rn")
    score = F.lit(float(weight)) * (F.lit(float(base_score)) - (F.col("__rn") - 1) * diff)
    scored = top.select(*group, *ids, score.alias("__score"))
    # At most k rows per group reach this window.
    rank = F.rank().over(Window.partitionBy(*group).orderBy(F.col("__score").desc()))
    out = join_stats(df, scored.withColumn("__rank", rank), [*group, *ids], "left")
    return (
        out.withColumn(f"{key}_score", F.coalesce("__score", F.lit(0.0)))
        .withColumn(f"{key}_rank", F.coalesce("__rank", F.lit(-1)))
        .drop("__score", "__rank")
    )


def total_score(
    df: DataFrame,
    plans: Sequence[Plan],
    k: int,
    base_score: float,
    group: Sequence[str] = ("as_of",),
    ids: Sequence[str] = ("symbol",),
) -> DataFrame:
    """the sum of all plan scores as ``score``, every plan in one pass over the long form."""
    group, ids = list(group), list(ids)
    keys = [p.key for p in plans]
    diffs = F.create_map(*[F.lit(x) for p in plans for x in (p.key, float(p.diff))])
    long = df.select(*group, *ids, *[F.col(c).cast("double").alias(c) for c in keys]).unpivot(
        [*group, *ids], keys, "__key", "__value"
    )
    leading = _leading_rows(long, [*group, "__key"], "__value", k)
    ranks = _top_value_ranks(leading, [*group, "__key"], "__value", k)
    points = F.lit(float(base_score)) - (F.col("__rank") - 1) * diffs[F.col("__key")]
    scored = join_stats(leading, ranks.withColumn("__points", points), [*group, "__key", "__value"])
    sums = scored.groupBy(*group, *ids).agg(F.sum("__points").alias("score"))
    out = join_stats(df.drop("score"), sums, [*group, *ids], "left")
    return out.withColumn("score", F.coalesce("score", F.lit(0.0)))


def check_plans(plans: Sequence[Plan], k: int, base_score: float) -> list[Plan]:
    """plans whose last rank would score below zero."""
    return [p for p in plans if base_score - p.diff * k < 0]


def check_plan_table(plans: DataFrame, k: int, base_score: float) -> DataFrame:
    """F4 over a plan table: the flag and the largest allowed step."""
    flagged = (F.lit(float(base_score)) - F.col("diff") * k) < 0
    return plans.withColumn("too_big", flagged).withColumn("limit", F.lit(base_score / k))


def top_n(
    df: DataFrame,
    n: int,
    score: str = "score",
    group: Sequence[str] = ("as_of",),
    ids: Sequence[str] = ("symbol",),
) -> DataFrame:
    """the n best rows per date, ties by id, with their row number ``rn``."""
    return top_per_group(df, list(group), [(score, False), *[(i, True) for i in ids]], n)


def picks(df: DataFrame, n: int, score: str = "score", date: str = "as_of", ids: Sequence[str] = ("symbol",)) -> DataFrame:
    """F5 for a replay: 2n reserves per date, n at the newest date."""
    newest = df.agg(F.max(date)).scalar()
    return top_n(df, 2 * n, score, [date], ids).where((F.col("rn") <= n) | (F.col(date) < newest))


def rank_columns(
    df: DataFrame, columns: Sequence[str], group: Sequence[str] = ("as_of",), ids: Sequence[str] = ("symbol",)
) -> DataFrame:
    """``{c}_rank`` descending, ties share the worst rank, null stays null."""
    group, ids, columns = list(group), list(ids), list(columns)
    long = df.select(*group, *ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [*group, *ids], columns, "__column", "__value"
    )
    # The rank lies with its row; only the row's own columns meet again.
    hit = tie_counts(long.where(F.col("__value").isNotNull()), [*group, "__column"], "__value", ascending=False)
    rank = F.col("n_before") + F.col("n_equal")
    wide = hit.groupBy(*group, *ids).agg(*[F.max(F.when(F.col("__column") == c, rank)).alias(f"{c}_rank") for c in columns])
    return join_stats(df, wide, [*group, *ids], "left")


def rank_stats(
    reports: DataFrame, rank_columns: Sequence[str], order: Sequence[tuple[str, bool]], report: str = "as_of", n: int = 100
) -> DataFrame:
    """per rank column the empty and zero counts, variance and mean over the first n rows of each report."""
    head = top_per_group(reports, [report], order, n, "__rn")
    long = head.select(*[F.col(c).cast("double").alias(c) for c in rank_columns]).unpivot(
        [], list(rank_columns), "column", "value"
    )
    zero = F.count_if(F.col("value") == 0)
    key = F.array_join(F.expr("slice(split(column, '_'), 1, greatest(size(split(column, '_')) - 2, 0))"), "_")
    return long.groupBy("column").agg(
        (zero + F.count_if(F.col("value").isNull())).alias("empty"),
        zero.alias("zero"),
        F.var_samp("value").alias("var"),
        F.avg("value").alias("avg"),
    ).withColumn("key", key)


def weights_from_ranks(stats: DataFrame, least_empty: float = 0.8, lowest_rank: float = 0.2) -> DataFrame:
    """F8: a plan table from F7: the least empty share, of those the lowest mean ranks, weighted 0..10.

    The input has one row per metric, so its windows are small.
    """
    everything = Window.partitionBy(F.lit(1))

    def lowest(df: DataFrame, column: str, share: float) -> DataFrame:
        place = F.row_number().over(everything.orderBy(F.col(column).asc_nulls_last(), "column"))
        size = F.count(F.lit(1)).over(everything)
        marked = df.withColumn("__p", place).withColumn("__n", size)
        return marked.where(F.col("__p") <= F.floor(F.col("__n") * share)).drop("__p", "__n")

    def scaled(column: str) -> Column:
        low, high = F.min(column).over(everything), F.max(column).over(everything)
        return F.try_divide(F.col(column) - low, high - low) * 10

    kept = lowest(lowest(stats, "empty", least_empty), "avg", lowest_rank)
    rank = F.count(F.lit(1)).over(everything.orderBy("avg").rangeBetween(Window.unboundedPreceding, 0))
    out = kept.withColumn("average_rank", rank)
    out = out.withColumn("norm_rank", scaled("average_rank")).withColumn("norm_var", scaled("var"))
    out = out.withColumn("weight_base", (10 - F.col("norm_var")) + (10 - F.col("norm_rank")))
    out = out.withColumn("weight", scaled("weight_base"))
    fixed = {"key_dir": "low", "diff": "10", "base": ">", "base_dir": "0"}
    return out.select("key", "weight", *[F.lit(v).alias(c) for c, v in fixed.items()])


def percentile_gates(
    df: DataFrame, probabilities: Mapping[str, str], percentile: float = GATE_PERCENTILE, cohort: Sequence[str] = ("cohort",)
) -> DataFrame:
    """for each (output, probability column) 1 where strictly above the cohort's percentile."""
    cohort = list(cohort)
    columns = list(probabilities.values())
    long = df.select(*cohort, *columns).unpivot(cohort, columns, "__column", "__p")
    cuts = exact_percentiles(long, [*cohort, "__column"], "__p", {"__cut": percentile / 100})
    wide = cuts.groupBy(*cohort).agg(
        *[F.max(F.when(F.col("__column") == c, F.col("__cut"))).alias(f"__cut_{c}") for c in columns]
    )
    joined = join_stats(df, wide, cohort, "left")
    gates = [
        F.coalesce((F.col(c) > F.col(f"__cut_{c}")).cast("int"), F.lit(0)).alias(g) for g, c in probabilities.items()
    ]
    return joined.select(*df.columns, *gates)


def gate_predictions(df: DataFrame, predictions: Sequence[str], gates: Sequence[str]) -> DataFrame:
    """prediction kept or -1: each gate alone, AND(1,3), AND(1,2), majority of (1,2,3)."""
    g = [F.col(c) == 1 for c in gates]
    votes = sum((F.col(c) for c in gates[2:4]), F.col(gates[1]))
    rules = {f"wbinary_{i}": g[i] for i in range(len(gates))}
    rules |= {
        "wbinary_ensemble": g[1] & g[3],
        "wbinary_ensemble2": g[1] & g[2],
        "wbinary_ensemble3": votes >= 2,
    }
    return df.select(
        "*", *[F.when(rule, F.col(p)).otherwise(F.lit(-1.0)).alias(f"{p}_{n}") for p in predictions for n, rule in rules.items()]
    )


def average_models(df: DataFrame, predictions: Sequence[str], label: str, name: str = "ai_pred_avg") -> DataFrame:
    """mean of the predictions and its absolute error."""
    mean = sum((F.col(p) for p in predictions[1:]), F.col(predictions[0])) / len(predictions)
    return df.withColumn(name, mean).withColumn(f"{name}_loss", F.abs(F.col(label) - F.col(name)))


def _in_slices(
    long: DataFrame, group: Sequence[str], value: str, ids: Sequence[str], slices: Sequence[tuple[int, int]]
) -> DataFrame:
    """The best rows of each group, once per slice ``__b`` holding their place."""
    deepest = max(e for _, e in slices) + 1
    top = top_per_group(long, group, [(value, False), *[(i, True) for i in ids]], deepest, "__rn")
    bounds = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in slices])
    within = F.filter(bounds, lambda b: (F.col("__rn") - 1 >= b["s"]) & (F.col("__rn") - 1 <= b["e"]))
    return top.withColumn("__b", F.explode(within))


def topk_eval(
    df: DataFrame,
    predictions: Sequence[str],
    realised: str,
    slices: Sequence[tuple[int, int]] = TOP_SLICES,
    cohort: Sequence[str] = ("cohort",),
    ids: Sequence[str] = ("id",),
) -> DataFrame:
    """per cohort, prediction column and slice the realised and predicted means, their gap and sign.

    A slice (s, e) holds the rows s..e, e - s + 1 of them; sums are divided by
    that size even when the cohort is smaller.
    """
    cohort, ids = list(cohort), list(ids)
    long = df.select(*cohort, *ids, realised, *[F.col(p).cast("double").alias(p) for p in predictions]).unpivot(
        [*cohort, *ids, realised], list(predictions), "model", "__pred"
    )
    cut = _in_slices(long, [*cohort, "model"], "__pred", ids, slices)
    size = F.col("__b.e") - F.col("__b.s") + 1
    keyed = cut.withColumn("krange", F.concat(F.col("__b.s"), F.lit("~"), F.col("__b.e"))).withColumn("__size", size)
    sums = keyed.groupBy(*cohort, "model", "krange", "__size").agg(
        F.sum(realised).alias("__real"), F.sum("__pred").alias("__sum")
    )
    real, pred = F.col("__real") / F.col("__size"), F.col("__sum") / F.col("__size")
    return sums.select(
        *cohort,
        "model",
        "krange",
        real.alias("avg_earning_per_stock"),
        pred.alias("cur_model_pred"),
        F.abs(pred - real).alias("loss_y_and_pred"),
        (pred > 0).cast("int").alias("cur_model_pred_ispositive"),
    )


def topk_by_sector(
    df: DataFrame,
    predictions: Sequence[str],
    realised: str,
    slices: Sequence[tuple[int, int]] = SECTOR_SLICES,
    cohort: Sequence[str] = ("cohort",),
    sector: str = "sector",
    ids: Sequence[str] = ("id",),
) -> DataFrame:
    """F12 inside each sector; rows without a sector are left out."""
    return topk_eval(df.where(F.col(sector).isNotNull()), predictions, realised, slices, [*cohort, sector], ids)


def latest_sector_picks(
    df: DataFrame, prediction: str, k: int, cohort: str = "cohort", sector: str = "sector", ids: Sequence[str] = ("id",)
) -> DataFrame:
    """the top k rows of each sector in the newest cohort."""
    newest = df.where(F.col(cohort) == df.agg(F.max(cohort)).scalar())
    return top_n(newest.where(F.col(sector).isNotNull()), k, prediction, [sector], ids)


def latest_sector_report(
    df: DataFrame,
    predictions: Sequence[str],
    slices: Sequence[tuple[int, int]] = TOP_SLICES,
    cohort: str = "cohort",
    sector: str = "sector",
    ids: Sequence[str] = ("id",),
) -> DataFrame:
    """for the newest cohort one row per sector, prediction column, slice and place ``i``."""
    ids = list(ids)
    newest = df.where((F.col(cohort) == df.agg(F.max(cohort)).scalar()) & F.col(sector).isNotNull())
    long = newest.select(sector, *ids, *[F.col(p).cast("double").alias(p) for p in predictions]).unpivot(
        [sector, *ids], list(predictions), "model", "pred"
    )
    cut = _in_slices(long, [sector, "model"], "pred", ids, slices)
    return cut.select(
        (F.col("__b.e") - F.col("__b.s")).alias("k"), sector, "model", (F.col("__rn") - 1 - F.col("__b.s")).alias("i"), *ids, "pred"
    )


def latest_per_symbol(df: DataFrame, order: str = "ordinal") -> DataFrame:
    """the newest fiscal row of each symbol."""
    return first_per_key(df, ["symbol"], [(order, False)])


def select_across_sectors(df: DataFrame, k: int, score: str = "predicted_score", ids: Sequence[str] = ("symbol",)) -> DataFrame:
    """the k best rows over all sectors, rows without a score dropped."""
    return df.where(F.col(score).isNotNull()).orderBy(F.col(score).desc(), *ids).limit(k)


def sector_distribution(selected: DataFrame, sector: str = "sector") -> DataFrame:
    """how many selected rows each sector has, and its share."""
    counts = selected.groupBy(sector).agg(F.count(F.lit(1)).alias("n"))
    return with_group_stats(counts, [], __all=F.sum("n")).withColumn("share", F.col("n") / F.col("__all")).drop("__all")
