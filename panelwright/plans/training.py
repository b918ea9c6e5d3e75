"""Training plan: prune a labelled panel, fit both model families, score rows for the evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions import names
from panelwright.models import jobs
from panelwright.operators import quality
from panelwright.session import stage_table


@dataclass(frozen=True)
class Trained:
    """Fitted families, and the columns they read with their cleaned names."""

    columns: dict[str, str]
    classifiers: list[PipelineModel]
    regressors: list[PipelineModel]

    @property
    def probabilities(self) -> list[str]:
        return [f"p_up{i}" for i in range(len(self.classifiers))]

    @property
    def predictions(self) -> list[str]:
        return [f"pred{i}" for i in range(len(self.regressors))]

    def scored(self, df: DataFrame) -> DataFrame:
        """``df`` with ``p_up0``, ... and ``pred0``, ...; missing features are imputed as in training."""
        wide = df.select(
            F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"),
            *[F.col(f"`{c}`").alias(clean) for c, clean in self.columns.items()],
        )
        out = jobs.score_family(self.regressors, jobs.score_family(self.classifiers, wide, "p_up"), "pred")
        return out.select("__row.*", *self.probabilities, *self.predictions)


def train_models(
    df: DataFrame,
    features: Sequence[str],
    up: str,
    target: str,
    classifiers: Sequence[Any] | None = None,
    regressors: Sequence[Any] | None = None,
    sparse_column: float = 0.8,
    constant: float = 0.95,
    sparse_row: float = 0.6,
) -> Trained:
    """Drop sparse and constant features and sparse rows, then fit up/down classifiers on ``up`` and regressors on ``target``."""
    cleaned = names.clean_names(df.select(*[F.col(f"`{c}`") for c in features]))
    columns = dict(zip(features, cleaned.columns, strict=True))
    narrow = df.select(
        *[F.col(f"`{c}`").alias(clean) for c, clean in columns.items()], F.col(up).alias("__up"), F.col(target).alias("__target")
    )
    # Every pass and every model reads these few columns, not the panel.
    narrow = stage_table(narrow, "training")
    _, sparse = quality.drop_sparse_columns(narrow.select(*columns.values()), sparse_column)
    _, flat = quality.drop_constant_columns(narrow.select(*[c for c in columns.values() if c not in sparse]), constant)
    columns = {c: clean for c, clean in columns.items() if clean not in {*sparse, *flat}}
    if not columns:
        raise ValueError("no feature is left after pruning")
    left = list(columns.values())
    rows = quality.drop_sparse_rows(narrow, sparse_row, left)
    return Trained(
        columns,
        jobs.train_classifiers(rows, left, "__up", classifiers),
        jobs.train_regressors(rows, left, "__target", regressors),
    )
