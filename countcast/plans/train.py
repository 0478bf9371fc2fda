"""Training, tuning and comparing regressors on the log of a count."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.param import Param
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countcast.operators.features import (
    Kind,
    feature_stages,
    fit_features,
    fit_indexer,
    largest_arity,
    with_labels,
)
from countcast.operators.metrics import regression_metrics, with_best
from countcast.operators.split import split, with_fold
from countcast.plans import elastic_net
from countcast.plans.score import apply_models, stack_predictions
from countcast.spec import CountSpec
from countcast.workspace import stored

LINEAR = "Linear Regression"
FOREST = "Random Forest"
BOOSTED = "Gradient-Boosted Trees"

# Tuning grids and settings of the models to match.
REFERENCE_GRIDS = {
    LINEAR: {"regParam": [0.001, 0.01, 0.1], "elasticNetParam": [0.0, 0.5, 1.0]},
    FOREST: {"numTrees": [200], "maxDepth": [10, 15]},
    BOOSTED: {"maxIter": [100], "maxDepth": [5, 8], "stepSize": [0.05, 0.1]},
}
MAX_BINS = 150
FOLDS = 3
SEED = 42

# The same searches at a size for tests and small tables.
SMALL_GRIDS = {
    LINEAR: {"regParam": [0.001, 0.1], "elasticNetParam": [0.0]},
    FOREST: {"numTrees": [10], "maxDepth": [3, 6]},
    BOOSTED: {"maxIter": [8], "maxDepth": [3], "stepSize": [0.1, 0.3]},
}
# Fewer rows than this are not worth a task of their own in a pass of fitting; tables of more
# than MANY_TASKS such tasks have tasks of up to LARGE_TASK rows.
ROWS_PER_TASK, MANY_TASKS, LARGE_TASK = 10_000, 200, 1_000_000
# Megabytes of statistics a task may hold while growing trees. More means more tree nodes
# per pass over the data and so fewer passes; the trees are the same.
NODE_MEMORY = 1024
GRIDS = {"reference": REFERENCE_GRIDS, "small": SMALL_GRIDS}

ParamMaps = list[dict[Param, object]]


@dataclass
class Candidate:
    """A regressor, the features it wants and the settings to try."""

    name: str
    kind: Kind
    estimator: Estimator
    grid: ParamMaps = field(default_factory=lambda: [{}])
    scope: CountSpec | None = None  # the dimensions to learn from; default: all of them


@dataclass
class TrainingRun:
    models: dict[str, PipelineModel]
    metrics: DataFrame  # model, rmse, r2, mae, is_best
    tuning: DataFrame  # model, params, log_rmse: mean over the folds
    test: DataFrame
    spec: CountSpec
    best: str

    def predictions(self) -> DataFrame:
        """Test rows with the predictions of all models, one row per model."""
        scored, columns = apply_models(self.test, self.spec, self.models)
        return stack_predictions(scored, columns)


def param_grid(estimator: Estimator, values: Mapping[str, Sequence[object]]) -> ParamMaps:
    builder = ParamGridBuilder()
    for name, options in values.items():
        builder = builder.addGrid(estimator.getParam(name), list(options))
    return builder.build()


def candidates(preset: str = "reference") -> list[Candidate]:
    """Elastic-net regression on one-hot features; forest and boosted trees on indexes."""
    columns = {"featuresCol": "features", "labelCol": "label"}
    trees = {"maxBins": MAX_BINS, "maxMemoryInMB": NODE_MEMORY, "seed": SEED, **columns}
    linear = LinearRegression(maxIter=100, **columns)
    forest = RandomForestRegressor(featureSubsetStrategy="sqrt", **trees)
    boosted = GBTRegressor(subsamplingRate=0.8, **trees)
    grids = GRIDS[preset]
    return [
        Candidate(LINEAR, "linear", linear, param_grid(linear, grids[LINEAR])),
        Candidate(FOREST, "tree", forest, param_grid(forest, grids[FOREST])),
        Candidate(BOOSTED, "tree", boosted, param_grid(boosted, grids[BOOSTED])),
    ]


class KeyFoldValidator(CrossValidator):
    """Cross-validation over an existing fold column, selected by plain filters.

    The parent checks fold numbers with a row-at-a-time Python function; ours come from a
    hash and need no check, so fold selection stays inside the JVM.
    """

    def _kFold(self, dataset):
        fold = F.col(self.getFoldCol())
        return [
            (dataset.filter(fold != i), dataset.filter(fold == i)) for i in range(self.getNumFolds())
        ]


def tune(
    estimator: Estimator, grid: ParamMaps, rows: DataFrame, folds: int, parallelism: int
) -> tuple[Model, list[float]]:
    """Best setting by mean fold error, refitted on all rows; and each setting's error.

    A single setting needs no search and is fitted directly.
    """
    if len(grid) == 1:
        return estimator.fit(rows, grid[0]), []
    validator = KeyFoldValidator(
        estimator=estimator,
        estimatorParamMaps=grid,
        evaluator=RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="rmse"),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
        seed=SEED,
    )
    tuned = validator.fit(rows)
    return tuned.bestModel, list(tuned.avgMetrics)


def fit_candidates(
    train_rows: DataFrame,
    spec: CountSpec,
    models: Sequence[Candidate],
    folds: int = FOLDS,
    parallelism: int = 2,
    refit_features: bool = False,
) -> dict[str, tuple[PipelineModel, list[float]]]:
    """Tune and fit candidates on labelled rows with a ``fold`` column.

    Category labels are learned once per set of dimensions, and candidates wanting the
    same features share one in-memory copy for all their settings and folds; labels carry
    no target information. Errors of linear settings come from one pass of sums
    (``elastic_net``). ``refit_features`` tunes each whole chain per fold instead.
    Returns fitted chains (raw columns to prediction) with their settings' fold errors.
    """
    if refit_features:
        arities = {scope: largest_arity(fit_features(train_rows, scope, kind, fit_indexer(train_rows, scope))) for scope, kind in {(c.scope or spec, c.kind) for c in models}}
        return {
            c.name: tune(
                Pipeline(stages=[*feature_stages(c.scope or spec, c.kind), with_bins(c.estimator, arities[c.scope or spec] + 1)]),
                c.grid, train_rows, folds, parallelism,
            )
            for c in models
        }
    fitted: dict[str, tuple[PipelineModel, list[float]]] = {}
    indexers = {scope: fit_indexer(train_rows, scope) for scope in {c.scope or spec for c in models}}
    shared: dict[tuple[CountSpec, Kind], list[Candidate]] = {}
    for c in models:
        shared.setdefault((c.scope or spec, c.kind), []).append(c)
    for (scope, kind), group in shared.items():
        features = fit_features(train_rows, scope, kind, indexers[scope])
        indexed = features.transform(train_rows)
        ready = indexed.select("features", "label", "fold")
        ready.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for c in group:
                estimator = with_bins(c.estimator, largest_arity(features) + 1)
                columns = elastic_net.width(indexers[scope], scope)
                if len(c.grid) > 1 and elastic_net.tunable(estimator, c.grid, columns):
                    errors = elastic_net.tune_errors(indexed, indexers[scope], scope, estimator, c.grid)
                    regressor = estimator.fit(ready, c.grid[best_setting(errors)])
                else:
                    regressor, errors = tune(estimator, c.grid, ready, folds, parallelism)
                fitted[c.name] = PipelineModel(stages=[*features.stages, regressor]), errors
        finally:
            ready.unpersist()
    return {c.name: fitted[c.name] for c in models}


def best_setting(errors: Sequence[float]) -> int:
    """The first setting of least error; one that could not be measured counts as worst."""
    return min(range(len(errors)), key=lambda i: errors[i] if errors[i] == errors[i] else float("inf"))


def with_bins(estimator: Estimator, needed: int) -> Estimator:
    """A tree needs a bin per label and one for the unseen bucket."""
    if not estimator.hasParam("maxBins") or estimator.getOrDefault("maxBins") >= needed:
        return estimator
    return estimator.copy({estimator.getParam("maxBins"): needed})


def prepare(facts: DataFrame, spec: CountSpec, keys: Sequence[str], folds: int) -> DataFrame:
    """Rows fit for training: no null key or target, a usable year, a label and a fold."""
    rows = with_labels(facts.dropna(subset=list(keys)), spec)
    if spec.year_dim is not None:
        rows = rows.filter("numeric_year is not null")
    return with_fold(rows, keys, folds)


def partitions_for(rows: int) -> int:
    """Partitions of a training table: a matter of its size alone, never of cores or layout."""
    return max(1, min(-(-rows // ROWS_PER_TASK), max(MANY_TASKS, -(-rows // LARGE_TASK))))


def laid_out(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows in an order of their own: partitions by the keys' hash, sorted within.

    Bootstrap and subsample weights of trees are drawn partition by partition and row by row,
    so equal tables must stand in equal order for equal trees, however they were stored, read
    or repartitioned before. Rows with equal keys are ordered by their other columns.
    """
    others = [c for c in rows.columns if c not in keys]
    return rows.repartition(partitions_for(rows.count()), *keys).sortWithinPartitions(*keys, *others)


def train(
    facts: DataFrame,
    spec: CountSpec,
    models: Sequence[Candidate],
    keys: Sequence[str] | None = None,
    train_percent: int = 80,
    folds: int = FOLDS,
    parallelism: int = 2,
    refit_features: bool = False,
) -> TrainingRun:
    """Split, fit every candidate, and compare them on the held-out part.

    The facts are stored once in the shared folder, so that neither the many passes of
    iterative fitting nor a lost executor repeats the query that produced them. Long
    boosting runs cut their own lineage through the checkpoint folder.
    """
    spark = facts.sparkSession
    keys = list(keys or spec.dims)
    labelled = stored(prepare(facts, spec, keys, folds), "training")
    train_rows, test_rows = split(labelled, keys, train_percent)
    train_rows = laid_out(train_rows, keys)
    fitted = fit_candidates(train_rows, spec, models, folds, parallelism, refit_features)
    chains = {name: chain for name, (chain, _) in fitted.items()}
    tuning = [
        (c.name, describe_settings(settings), float(error))
        for c in models
        for settings, error in zip(c.grid, fitted[c.name][1])
    ]
    scored, columns = apply_models(test_rows, spec, chains)
    measured = with_best(regression_metrics(scored, columns)).collect()  # one row per model
    return TrainingRun(
        models=chains,
        metrics=spark.createDataFrame(
            measured, "model string, rmse double, r2 double, mae double, is_best boolean"
        ),
        tuning=spark.createDataFrame(tuning, "model string, params string, log_rmse double"),
        test=test_rows,
        spec=spec,
        best=next(r.model for r in measured if r.is_best),
    )


def describe_settings(settings: dict[Param, object]) -> str:
    return ", ".join(f"{p.name}={v}" for p, v in sorted(settings.items(), key=lambda kv: kv[0].name))


def feature_importance(spark: SparkSession, model: PipelineModel, spec: CountSpec) -> DataFrame:
    """``(feature, importance)`` of a tree model, least important first.

    One row per dimension plus the numeric year: as small as the model's feature list.
    """
    names = [*spec.dims, *([] if spec.year_dim is None else ["numeric_year"])]
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(w)) for name, w in zip(names, weights, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy("importance", "feature")
