"""Evaluation and latest-prediction plans over scored rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import quality, ranking, stats
from panelwright.operators.ordered import first_per_key
from panelwright.session import stage


def with_variants(
    df: DataFrame, probabilities: Sequence[str], predictions: Sequence[str], cohort: Sequence[str], label: str | None = None
) -> DataFrame:
    """Gates, gated predictions and the model average."""
    gates = {f"clsmodel_{i}_prediction": p for i, p in enumerate(probabilities)}
    gated = ranking.percentile_gates(df, gates, cohort=cohort)
    out = ranking.gate_predictions(gated, predictions, list(gates))
    if label is not None:
        return ranking.average_models(out, predictions, label)
    mean = sum((F.col(p) for p in predictions[1:]), F.col(predictions[0])) / len(predictions)
    return out.withColumn("ai_pred_avg", mean)


def variant_columns(predictions: Sequence[str]) -> list[str]:
    """Names of all prediction variants of ``with_variants``."""
    rules = [f"wbinary_{i}" for i in range(4)] + ["wbinary_ensemble", "wbinary_ensemble2", "wbinary_ensemble3"]
    return [*predictions, *[f"{p}_{r}" for p in predictions for r in rules], "ai_pred_avg"]


def evaluate_models(
    df: DataFrame,
    probabilities: Sequence[str],
    predictions: Sequence[str],
    label: str,
    realised: str,
    cohort: str = "cohort",
    ids: Sequence[str] = ("id",),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with all variants, losses per cohort, top-k report) over all test cohorts at once."""
    rows = stage(with_variants(df, probabilities, predictions, [cohort], label))
    columns = variant_columns(predictions)
    losses = stats.prediction_loss(rows, columns, label, cohort)
    return rows, losses, ranking.topk_eval(rows, columns, realised, cohort=[cohort], ids=ids)


def latest_prediction(
    df: DataFrame,
    probabilities: Sequence[str],
    predictions: Sequence[str],
    k: int,
    order: Sequence[str],
    features: Sequence[str],
    by: str = "ai_pred_avg",
    sparse: float = 0.6,
    score: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Newest row per symbol, sparse rows dropped, all variants, the best k by one of them.

    ``score`` adds the probability and prediction columns to the newest rows alone.
    """
    newest = first_per_key(df, ["symbol"], [(c, False) for c in order])
    kept = quality.drop_sparse_rows(newest, sparse, features)
    if score is not None:
        kept = score(kept)
    scored = with_variants(kept.withColumn("__all", F.lit(1)), probabilities, predictions, ["__all"]).drop("__all")
    return scored.orderBy(F.col(by).desc_nulls_last(), "symbol").limit(k)
