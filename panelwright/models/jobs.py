"""Spark ML jobs over panel features.

Training is Spark ML's; the functions here prepare data, combine fits and turn
their outputs into tables.  Loops on the driver run over models, folds, windows
or sectors, never over rows.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import quality, splits, stats
from panelwright.session import checkpoint_dir, stage_table

SEED = 42
# The depths of the classifier and regressor families.
CLASSIFIER_DEPTHS = (8, 9, 10)
REGRESSOR_DEPTHS = (8, 10)
# Ranges of the parameter search.
SEARCH_SPACE = {"maxDepth": (6, 12), "stepSize": (0.01, 0.3), "maxIter": (500, 2000), "subsamplingRate": (0.6, 1.0)}
# Independent fits that run side by side.
PARALLEL_FITS = 4
# Rows of a partition a fit goes over. Vectors take few bytes in their files, which would be read as few, large tasks.
FIT_ROWS = 100_000
# Share of the rows, the newest, on which boosted models are watched while they grow.
WATCHED_SHARE = 0.2


def _vector(features: Sequence[str], impute: bool) -> list:
    """Stages from columns to a vector; missing values take the column's median when imputing."""
    if not impute:
        return [VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="skip")]
    filled = [f"__f{i}" for i in range(len(features))]
    return [
        Imputer(inputCols=list(features), outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="__features", handleInvalid="keep"),
    ]


def _stages(features: Sequence[str], estimator: Any, label: str, impute: bool) -> Pipeline:
    """Features to vector to estimator, with fixed internal column names."""
    return Pipeline(stages=[*_vector(features, impute), estimator.copy().setFeaturesCol("__features").setLabelCol(label)])


def _numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def concurrently(spark: SparkSession, tasks: Sequence[Callable[[], Any]], parallelism: int = PARALLEL_FITS) -> list:
    """Results of independent Spark jobs, in order, at most ``parallelism`` at a time.

    Each worker names a scheduler pool of its own, so that with
    ``spark.scheduler.mode=FAIR`` a long fit does not hold back the others.
    """
    if len(tasks) < 2 or parallelism < 2:
        return [task() for task in tasks]

    def run(i: int) -> Any:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fits-{i % parallelism}")
        return tasks[i]()

    pool = ThreadPool(min(parallelism, len(tasks)))
    try:
        return pool.map(inheritable_thread_target(spark)(run), range(len(tasks)), chunksize=1)
    finally:
        pool.close()


@dataclass(frozen=True)
class Vectors:
    """Feature vectors written once, read by any number of fits."""

    rows: DataFrame
    label: str
    stages: tuple
    parts: int = 1

    def dealt(self, where: Column | None = None) -> DataFrame:
        """The rows of a condition in partitions of about ``FIT_ROWS`` rows, for passes whose work goes by rows."""
        rows = self.rows if where is None else self.rows.where(where)
        return rows.repartition(self.parts) if self.parts > 1 else rows

    def fit(self, estimator: Any, where: Column | None = None) -> PipelineModel:
        """Fit on the rows of a condition; the result takes rows with plain columns, like that of ``fit``."""
        own = estimator.copy().setFeaturesCol("__features").setLabelCol(self.label)
        return PipelineModel([*self.stages, own.fit(self.dealt(where))])

    def score(self, models: Sequence[PipelineModel], names: Sequence[str], where: Column | None = None) -> DataFrame:
        """The staged rows with each model's output, without going through the plain columns again."""
        out = self.rows if where is None else self.rows.where(where)
        for model, name in zip(models, names, strict=True):
            last = model.stages[-1]
            made = [last.getPredictionCol()]
            value = F.col(last.getPredictionCol())
            if last.hasParam("probabilityCol"):
                value = vector_to_array(F.col(last.getProbabilityCol()))[1]
                made += [last.getProbabilityCol(), last.getRawPredictionCol()]
            out = last.transform(out).withColumn(name, value).drop(*made)
        return out.drop("__features")


def stage_vectors(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = (), impute: bool = False) -> Vectors:
    """Turn the rows with a label (and, without imputing, with all features) into vectors, in one written table.

    ``keep`` names columns that stay beside label and vector, such as a fold.
    """
    checkpoint_dir(df.sparkSession)
    rows = df.where(F.col(label).isNotNull()) if impute else quality.complete_cases(df, [*features, label])
    beside = [c for c in dict.fromkeys(keep) if c != label]
    named = {c: f"__x{i}" for i, c in enumerate(features)}
    plain = _numeric(rows.select(*features, label), [*features, label]) if impute else None
    ready = Pipeline(stages=_vector(features, impute)).fit(plain) if impute else PipelineModel(_vector(features, impute))
    # Features are read as numbers; a kept column of the same name stays as it is.
    kept = {c: f"__k{i}" for i, c in enumerate(beside)}
    wide = rows.select(*[F.col(c).alias(k) for c, k in kept.items()], F.col(label).cast("double").alias("__label"), *[F.col(c).cast("double").alias(x) for c, x in named.items()])
    wide = wide.withColumnsRenamed({x: c for c, x in named.items()})
    made = ready.transform(wide).select(*[F.col(k).alias(c) for c, k in kept.items()], F.col("__label").alias(label), "__features")
    staged = stage_table(made, "vectors")
    return Vectors(staged, label, tuple(ready.stages), -(-staged.count() // FIT_ROWS))


def fit(df: DataFrame, features: Sequence[str], estimator: Any, label: str, impute: bool = False) -> PipelineModel:
    """Fit on the rows with a label (and, without imputing, with all features)."""
    checkpoint_dir(df.sparkSession)
    rows = df.where(F.col(label).isNotNull()) if impute else quality.complete_cases(df, [*features, label])
    return _stages(features, estimator, label, impute).fit(_numeric(rows.select(*features, label), [*features, label]))


def score(model: PipelineModel, df: DataFrame, output: str, fill: bool = False) -> DataFrame:
    """Append the probability of class 1 (classifier) or the prediction (regressor) as ``output``.

    Rows with a missing feature are dropped by a model fitted without
    imputing; ``fill`` keeps them, scored as if the feature were zero.
    """
    used = [c for c in _inputs(model) if c in df.columns]
    renamed = {c: f"__in_{c}" for c in used}
    wide = _numeric(df.select("*", *[F.col(c).alias(n) for c, n in renamed.items()]), used)
    if fill:
        wide = wide.withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in used})
    out = model.transform(wide)
    last = model.stages[-1]
    value = F.col(last.getPredictionCol())
    if last.hasParam("probabilityCol"):
        value = vector_to_array(F.col(last.getProbabilityCol()))[1]
    rest = [F.col(renamed[c]).alias(c) if c in renamed else F.col(c) for c in df.columns]
    return out.select(*rest, value.alias(output))


def _inputs(model: PipelineModel) -> list[str]:
    first = model.stages[0]
    return list(first.getInputCols())


def classifier_family(trees: int = 100, depths: Sequence[int] = CLASSIFIER_DEPTHS, forest_depth: int = 8) -> list:
    """Boosted classifiers at three depths, and a forest as the fourth of another kind."""
    boosted = [GBTClassifier(maxIter=trees, maxDepth=d, stepSize=0.1, subsamplingRate=0.8, seed=SEED) for d in depths]
    return [*boosted, RandomForestClassifier(numTrees=trees, maxDepth=forest_depth, seed=SEED)]


def train_classifiers(df: DataFrame, features: Sequence[str], label: str, family: Sequence[Any] | None = None) -> list[PipelineModel]:
    """One up/down classifier per member of the family; missing features are imputed."""
    return [fit(df, features, e, label, impute=True) for e in (family or classifier_family())]


def regressor_family(trees: int = 100, depths: Sequence[int] = REGRESSOR_DEPTHS) -> list:
    """Boosted regressors at two depths."""
    return [GBTRegressor(maxIter=trees, maxDepth=d, stepSize=0.1, subsamplingRate=0.8, seed=SEED) for d in depths]


def train_regressors(df: DataFrame, features: Sequence[str], label: str, family: Sequence[Any] | None = None) -> list[PipelineModel]:
    """Regressors on the market-relative return."""
    return [fit(df, features, e, label, impute=True) for e in (family or regressor_family())]


@dataclass(frozen=True)
class Watched:
    """A boosted family that stopped growing on the newest rows, and how each member got there."""

    models: list[PipelineModel]
    report: DataFrame


def train_watched(
    df: DataFrame, features: Sequence[str], label: str, order: Sequence[str], family: Sequence[Any] | None = None, share: float = WATCHED_SHARE, impute: bool = True
) -> Watched:
    """Grow each boosted member on the older rows until its loss on the newest ``share`` no longer falls.

    A member without rounds, such as a forest, grows on all rows.  Missing
    features take the median of all rows.  The vectors are written once with
    the flag; the boosted members grow side by side, then the others one by
    one, since a forest holds a count per row and tree.  The report has a row per
    member: trees asked for and kept, rows grown and watched on, and the loss
    on the watched rows after each kept tree.
    """
    rows = df.where(F.col(label).isNotNull()) if impute else quality.complete_cases(df, [*features, label])
    vectors = stage_vectors(splits.time_holdout(rows, order, share, "__late"), features, label, ["__late"], impute)
    late = F.col("__late")
    n_rows, n_late = vectors.rows.agg(F.count(F.lit(1)), F.count_if(late)).first()

    def grow(estimator: Any) -> tuple[PipelineModel, tuple]:
        if not estimator.hasParam("validationIndicatorCol"):
            model = vectors.fit(estimator)
            trees = model.stages[-1].getNumTrees if hasattr(model.stages[-1], "getNumTrees") else 1
            return model, (trees, trees, n_rows, 0, [])
        model = vectors.fit(estimator.copy().setValidationIndicatorCol("__late") if n_late else estimator)
        last, watched = model.stages[-1], vectors.dealt(late)
        losses = []
        if n_late:
            losses = last.evaluateEachIteration(watched) if last.hasParam("probabilityCol") else last.evaluateEachIteration(watched, "squared")
        return model, (estimator.getMaxIter(), last.getNumTrees, n_rows - n_late, n_late, [float(v) for v in losses])

    members = list(family or classifier_family())
    boosted = [e.hasParam("validationIndicatorCol") for e in members]
    side_by_side = iter(concurrently(df.sparkSession, [lambda e=e: grow(e) for e, b in zip(members, boosted, strict=True) if b]))
    grown = [next(side_by_side) if b else grow(e) for e, b in zip(members, boosted, strict=True)]
    report = df.sparkSession.createDataFrame(
        [(i, *row) for i, (_, row) in enumerate(grown)], "member int, asked int, kept int, n_grown long, n_watched long, losses array<double>"
    )
    return Watched([model for model, _ in grown], report)


def score_family(models: Sequence[PipelineModel], df: DataFrame, prefix: str) -> DataFrame:
    """All models side by side: ``{prefix}0``, ``{prefix}1``, ..."""
    return reduce(lambda out, im: score(im[1], out, f"{prefix}{im[0]}"), enumerate(models), df)


def select(
    df: DataFrame, features: Sequence[str], label: str, method: str, k: int, ids: Sequence[str] = ("id",), continuous: bool = False, trees: int = 100
) -> list[str]:
    """Correlation pruning, then the k best features by ``mutual_info``, ``f_test``, ``rfe`` or ``tree_importance``."""
    kept = stats.prune_correlated(df, features)
    if method == "mutual_info":
        ranked = stats.rank_by_mutual_info(df, kept, label, ids, k, continuous=continuous)
    elif method == "f_test":
        ranked = stats.rank_by_f_test(df, kept, label, k, continuous=continuous)
    elif method == "tree_importance":
        ranked = rank_by_tree(df, kept, label, k, continuous, trees)
    elif method == "rfe":
        ranked = rfe(df, kept, label, k, continuous, trees).where(F.col("rank") == 1)
    else:
        return kept[:k]
    chosen = {r["feature"] for r in ranked.select("feature").collect()}
    return [c for c in kept if c in chosen]


def _forest(continuous: bool, trees: int) -> Any:
    kind = RandomForestRegressor if continuous else RandomForestClassifier
    return kind(numTrees=trees, seed=SEED)


def _importances(df: DataFrame, features: Sequence[str], label: str, continuous: bool, trees: int) -> dict[str, float]:
    model = fit(df, features, _forest(continuous, trees), label)
    return dict(zip(features, map(float, model.stages[-1].featureImportances.toArray()), strict=True))


def rfe(df: DataFrame, features: Sequence[str], label: str, k: int, continuous: bool = False, trees: int = 100) -> DataFrame:
    """I4: refit and drop the weakest, ``max(1, p // 20)`` at a time; rank 1 are the survivors."""
    left, dropped = list(features), []
    step = max(1, len(left) // 20)
    while len(left) > k:
        weights = _importances(df, left, label, continuous, trees)
        weakest = sorted(left, key=lambda c: (weights[c], c))[: min(step, len(left) - k)]
        dropped.append(weakest)
        left = [c for c in left if c not in weakest]
    rows = [(c, 1) for c in left]
    rows += [(c, 2 + i) for i, gone in enumerate(reversed(dropped)) for c in gone]
    return df.sparkSession.createDataFrame(rows, "feature string, rank int")


def rank_by_tree(df: DataFrame, features: Sequence[str], label: str, k: int, continuous: bool = False, trees: int = 100) -> DataFrame:
    """Forest importances, best k."""
    weights = _importances(df, features, label, continuous, trees)
    out = df.sparkSession.createDataFrame(list(weights.items()), "feature string, importance double")
    return out.orderBy(F.col("importance").desc(), "feature").limit(k)


@dataclass(frozen=True)
class SectorConfig:
    """How one sector is modelled."""

    features: tuple[str, ...]
    estimator: Any
    selection: str | None = None
    top_k: int = 8


@dataclass
class SectorModels:
    """Fitted sector models and the features each uses."""

    models: dict[str, PipelineModel] = field(default_factory=dict)
    features: dict[str, list[str]] = field(default_factory=dict)


def train_per_sector(df: DataFrame, configs: Mapping[str, SectorConfig], label: str, sector: str = "sector", ids: Sequence[str] = ("id",)) -> SectorModels:
    """One fit per configured sector on its own features; sectors without complete rows are skipped."""
    out = SectorModels()
    for name, config in configs.items():
        rows = quality.complete_cases(df.where(F.col(sector) == name), [*config.features, label])
        if rows.isEmpty():
            continue
        features = list(config.features)
        if config.selection:
            features = select(rows, features, label, config.selection, config.top_k, ids)
        out.features[name] = features
        out.models[name] = fit(rows, features, config.estimator, label)
    return out


def predict_per_sector(df: DataFrame, fitted: SectorModels, sector: str = "sector") -> DataFrame:
    """Every row once; ``predicted_score`` is null without a model or with a missing feature.

    A row meets its own sector's model only; the filter on the sector reaches
    the scan, so the branches together read each row about once where the data
    lies by sector.
    """
    none = F.lit(None).cast("double")
    known = F.coalesce(F.col(sector).isin(*fitted.models), F.lit(False))
    parts = [df.where(~known).select("*", none.alias("predicted_score"))]
    for name, model in fitted.models.items():
        missing = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in fitted.features[name]])
        own = score(model, df.where(F.col(sector) == name), "__score", fill=True)
        parts.append(own.select(*df.columns, F.when(~missing, F.col("__score")).alias("predicted_score")))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("predicted_class", (F.col("predicted_score") > 0.5).cast("int"))


@dataclass
class Stack:
    """Base models refitted on all rows, and the meta-learner over their outputs."""

    base: list[PipelineModel]
    meta: PipelineModel


META_LEARNERS = {
    "logistic": lambda: LogisticRegression(),
    "ridge": lambda: LinearRegression(regParam=1.0, elasticNetParam=0.0),
    "lasso": lambda: LinearRegression(regParam=1.0, elasticNetParam=1.0),
    "elasticnet": lambda: LinearRegression(regParam=1.0, elasticNetParam=0.5),
}


def _out_of_fold(vectors: Vectors, base: Sequence[Any], folds: int) -> DataFrame:
    """Each staged row with the outputs of the models that did not see its ``__fold``."""
    fold, names = F.col("__fold"), [f"base{i}" for i in range(len(base))]
    tasks = [lambda e=e, f=f: vectors.fit(e, fold != f) for f in range(folds) for e in base]
    models = concurrently(vectors.rows.sparkSession, tasks)
    parts = [vectors.score(models[f * len(base) : (f + 1) * len(base)], names, fold == f) for f in range(folds)]
    return reduce(DataFrame.unionByName, parts).drop("__fold")


def _with_fold(df: DataFrame, folds: int, ids: Sequence[str]) -> DataFrame:
    return df.withColumn("__fold", F.pmod(F.xxhash64(*ids), F.lit(folds)))


def held_out(df: DataFrame, features: Sequence[str], label: str, base: Sequence[Any], folds: int, ids: Sequence[str]) -> DataFrame:
    """Out-of-fold base predictions ``base0``, ``base1``, ...; the fold of a row is a hash of its ids.

    The rows are written once as vectors, and the fits of all folds read them side by side.
    """
    vectors = stage_vectors(_with_fold(df, folds, ids), features, label, [*df.columns, "__fold"])
    return _out_of_fold(vectors, base, folds).select(*df.columns, *[f"base{i}" for i in range(len(base))])


def stack(
    df: DataFrame, features: Sequence[str], label: str, base: Sequence[Any], meta: str = "logistic", folds: int = 5, ids: Sequence[str] = ("id",)
) -> Stack:
    """A meta-learner on held-out base predictions; a logistic one for classes."""
    vectors = stage_vectors(_with_fold(df, folds, ids), features, label, ["__fold"])
    names = [f"base{i}" for i in range(len(base))]
    outputs = _out_of_fold(vectors, base, folds)
    learner = fit(outputs, names, META_LEARNERS[meta](), label)
    return Stack(concurrently(df.sparkSession, [lambda e=e: vectors.fit(e) for e in base]), learner)


def predict_stack(fitted: Stack, df: DataFrame, output: str = "stacked") -> DataFrame:
    """The stack's prediction."""
    with_base = score_family(fitted.base, df, "base")
    return score(fitted.meta, with_base, output).drop(*[f"base{i}" for i in range(len(fitted.base))])


def vote(columns: Sequence[str], mode: str = "soft", weights: Sequence[float] | None = None) -> Column:
    """``hard`` majority of classes (a tie goes to 0), ``soft`` mean probability, ``mean`` of predictions; weighted."""
    weights = list(weights or [1.0] * len(columns))
    total = sum(weights)
    if mode == "hard":
        votes = reduce(lambda a, b: a + b, [(F.col(c) == 1).cast("int") * w for c, w in zip(columns, weights, strict=True)])
        return (votes > total / 2).cast("int")
    return reduce(lambda a, b: a + b, [F.col(c) * w for c, w in zip(columns, weights, strict=True)]) / total


def draw_trials(space: Mapping[str, tuple], trials: int, seed: int = SEED) -> list[dict[str, Any]]:
    """Seeded draws from integer ranges, float ranges or two choices."""
    rng = random.Random(seed)

    def one(low: Any, high: Any) -> Any:
        if isinstance(low, int) and isinstance(high, int):
            return rng.randint(low, high)
        if isinstance(low, float) and isinstance(high, float):
            return rng.uniform(low, high)
        return rng.choice([low, high])

    return [{name: one(*bounds) for name, bounds in space.items()} for _ in range(trials)]


def tune(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    estimator: Any,
    space: Mapping[str, tuple] = SEARCH_SPACE,
    trials: int = 10,
    folds: int = 3,
    parallelism: int = 2,
    classification: bool = True,
) -> tuple[dict[str, Any], DataFrame]:
    """Random search with cross-validation; best parameters and one row per trial.

    Classes are judged by accuracy, numbers by mean squared error (smaller is better).
    """
    draws = draw_trials(space, trials)
    maps = [{estimator.getParam(n): v for n, v in draw.items()} for draw in draws]
    vectors = stage_vectors(df, features, label).dealt()
    judge = (
        MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
        if classification
        else RegressionEvaluator(labelCol=label, metricName="mse")
    )
    search = CrossValidator(
        estimator=estimator.copy().setFeaturesCol("__features").setLabelCol(label),
        estimatorParamMaps=maps,
        evaluator=judge,
        numFolds=folds,
        parallelism=parallelism,
        seed=SEED,
    ).fit(vectors)
    scores = [float(s) for s in search.avgMetrics]
    best = max(range(trials), key=scores.__getitem__) if classification else min(range(trials), key=scores.__getitem__)
    table = df.sparkSession.createDataFrame(
        [(i, json.dumps(d), s, i == best) for i, (d, s) in enumerate(zip(draws, scores, strict=True))],
        "trial int, params string, score double, is_best boolean",
    )
    return draws[best], table


def _metrics(df: DataFrame, label: str, prediction: str, classification: bool) -> DataFrame:
    if classification:
        return stats.classification_metrics(df, label, prediction, 0.5)
    return stats.regression_metrics(df, label, prediction)


def cross_validate(
    df: DataFrame, features: Sequence[str], label: str, estimator: Any, order: Sequence[str], folds: int = 3, classification: bool = True
) -> tuple[DataFrame, PipelineModel]:
    """Time-ordered folds; mean and population std per metric, and a fit on everything.

    One table of vectors is written with the block of each row; a fold is a
    filter on it, and the fits of all folds and of the whole run side by side.
    """
    rows = quality.complete_cases(df, [*features, label])
    vectors = stage_vectors(splits.ts_blocks(rows, folds, order, "__block"), features, label, ["__block"])
    block = F.col("__block")
    tasks = [lambda f=f: vectors.fit(estimator, block < f) for f in range(1, folds + 1)]
    *models, whole = concurrently(df.sparkSession, [*tasks, lambda: vectors.fit(estimator)])
    held = [vectors.score([model], ["__p"], block == f) for f, model in enumerate(models, 1)]
    per_fold = reduce(DataFrame.unionByName, [_metrics(rows, label, "__p", classification) for rows in held])
    long = per_fold.unpivot([], per_fold.columns, "metric", "value")
    summary = long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return summary, whole


def feature_importance(model: PipelineModel, spark: SparkSession, n: int = 20) -> DataFrame:
    """The n most important features of a fitted tree model."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(w)) for name, w in zip(_inputs(model), weights, strict=True)]
    out = spark.createDataFrame(rows, "feature string, importance double")
    return out.orderBy(F.col("importance").desc(), "feature").limit(n)


def save_model(model: PipelineModel, spark: SparkSession, path: str, features: Sequence[str], task: str) -> None:
    """The model, and its feature names and task beside it."""
    model.write().overwrite().save(f"{path}/model")
    info = json.dumps({"features": list(features), "task": task})
    spark.createDataFrame([(info,)], "info string").write.mode("overwrite").text(f"{path}/info")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str], str]:
    """Model, feature names, task."""
    info = json.loads(spark.read.text(f"{path}/info").head()[0])
    return PipelineModel.load(f"{path}/model"), info["features"], info["task"]


def log_run(spark: SparkSession, path: str, name: str, params: Mapping[str, Any], metrics: Mapping[str, float], tags: Mapping[str, str] | None = None) -> None:
    """Append one run to the runs table."""
    row = [(name, {k: str(v) for k, v in params.items()}, {k: float(v) for k, v in metrics.items()}, dict(tags or {}))]
    schema = "run_name string, params map<string,string>, metrics map<string,double>, tags map<string,string>"
    spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(path)


def log_runs(runs: DataFrame, path: str) -> None:
    """Append many runs given as a table of the same columns."""
    runs.select("run_name", "params", "metrics", "tags").write.mode("append").parquet(path)


def compare_runs(spark: SparkSession, path: str, metric: str, n: int = 10) -> DataFrame:
    """The n best runs by a metric; the first is the best run."""
    runs = spark.read.parquet(path).withColumn("score", F.try_element_at("metrics", F.lit(metric)))
    return runs.where(F.col("score").isNotNull()).orderBy(F.col("score").desc(), "run_name").limit(n)


TrainFn = Callable[[DataFrame], Any]
EvaluateFn = Callable[[Any, DataFrame], Mapping[str, float]]


def model_functions(features: Sequence[str], label: str, estimator: Any, classification: bool = True) -> tuple[TrainFn, EvaluateFn]:
    """The usual train and evaluate functions for ``walk_forward``."""

    def train(rows: DataFrame) -> PipelineModel:
        return fit(rows, features, estimator, label)

    def evaluate(model: PipelineModel, rows: DataFrame) -> Mapping[str, float]:
        held = score(model, quality.complete_cases(rows, [*features, label]), "__p")
        return _metrics(held, label, "__p", classification).head().asDict()

    return train, evaluate
