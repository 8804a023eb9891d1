"""Training, evaluating and applying Spark ML models on feature tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from statistics import fmean, pstdev

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.plans.ranking import INDEX, SIZE, with_position
from salesmart.session import cut

SEED = 42
FEATURES, LABEL = "features", "label"

# fixed values: the search grid (a depth of 30 is Spark's deepest tree)
GRID = {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 20, 30], "minInstancesPerNode": [1, 2, 5]}
CLASS_METRICS = {"accuracy": "accuracy", "precision": "weightedPrecision",
                 "recall": "weightedRecall", "f1_score": "f1"}
NUMBER_METRICS = {"mse": "mse", "rmse": "rmse", "mae": "mae", "r2": "r2"}


@dataclass
class Trained:
    """A fitted pipeline with its figures as (metric, value) rows."""

    model: PipelineModel
    features: list[str]
    metrics: DataFrame
    importances: DataFrame | None = None
    extras: dict[str, float] = field(default_factory=dict)


def feature_stages(features: Sequence[str], categorical: Sequence[str] = ()) -> list:
    """Label encoding, null/NaN/infinity to 0, assembly, standardisation.

    All are fitted on the training data and travel with the model.
    """
    numeric = [c for c in features if c not in categorical]
    stages: list = []
    if categorical:
        stages.append(StringIndexer(
            inputCols=list(categorical), outputCols=[f"_{c}" for c in categorical],
            stringOrderType="alphabetAsc", handleInvalid="keep"))
    finite = ", ".join(
        f"CASE WHEN abs(CAST(`{c}` AS DOUBLE)) < double('infinity') THEN CAST(`{c}` AS DOUBLE) ELSE 0.0D END AS `_{c}`"
        for c in numeric)
    if finite:
        stages.append(SQLTransformer(statement=f"SELECT *, {finite} FROM __THIS__"))
    stages.append(VectorAssembler(inputCols=[f"_{c}" for c in features], outputCol="_raw"))
    stages.append(StandardScaler(inputCol="_raw", outputCol=FEATURES, withMean=True, withStd=True))
    return stages


def prepare_features(df: DataFrame, features: Sequence[str],
                     categorical: Sequence[str] = ()) -> tuple[PipelineModel, DataFrame]:
    """The fitted feature stages and the data with a ``features`` vector."""
    present = [c for c in features if c in df.columns]
    model = Pipeline(stages=feature_stages(present, [c for c in categorical if c in present])).fit(df)
    return model, model.transform(df)


def _dealt(df: DataFrame, keys: Sequence[str], stratify: str | None, seed: int) -> DataFrame:
    """Rows with their place in the order of a hash of their key, per class if asked; written once."""
    ticket = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]))
    return cut(with_position(df, [stratify] if stratify else [], [ticket, *[F.col(k) for k in keys]]))


def _in_test(share: float) -> Column:
    return F.col(INDEX) < F.ceil(F.col(SIZE) * F.lit(share))


def split(df: DataFrame, keys: Sequence[str], stratify: str | None = None,
          test_share: float = 0.2, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """A repeatable train/test split with an exact share, per class if asked.

    Rows are put in the order of a hash of their key; the first share of each
    class becomes the test set.
    """
    placed = _dealt(df, keys, stratify, seed)
    in_test = _in_test(test_share)
    return placed.where(~in_test).drop(INDEX, SIZE), placed.where(in_test).drop(INDEX, SIZE)


def _scores(predicted: DataFrame, evaluator: Evaluator, names: dict[str, str]) -> dict[str, float]:
    return {name: evaluator.copy({evaluator.metricName: metric}).evaluate(predicted) for name, metric in names.items()}


def class_metrics(predicted: DataFrame) -> DataFrame:
    """Accuracy and weighted precision, recall and F1 of (label, prediction) rows."""
    rows = predicted.select(F.col(LABEL).cast("double"), F.col("prediction").cast("double"))
    return _metric_rows(rows.sparkSession, _scores(rows, MulticlassClassificationEvaluator(labelCol=LABEL), CLASS_METRICS))


def number_metrics(predicted: DataFrame) -> DataFrame:
    """Squared, absolute and R2 figures of (label, prediction) rows."""
    rows = predicted.select(F.col(LABEL).cast("double"), F.col("prediction").cast("double"))
    return _metric_rows(rows.sparkSession, _scores(rows, RegressionEvaluator(labelCol=LABEL), NUMBER_METRICS))


def _metric_rows(spark: SparkSession, rows: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in rows.items()], "metric string, value double")


def _importances(spark: SparkSession, model, features: Sequence[str]) -> DataFrame | None:
    if not hasattr(model, "featureImportances"):
        return None
    weights = model.featureImportances.toArray()
    return spark.createDataFrame(
        [(name, float(w)) for name, w in zip(features, weights)], "feature string, importance double")


def _fold_scores(df: DataFrame, fold: Column, fit: Callable[[DataFrame], PipelineModel], scorer: Evaluator,
                 parallelism: int) -> list[float]:
    """The score on every fold of a model fitted on the others; none when all rows are in one fold."""
    present = sorted(r[0] for r in df.select(fold.alias("fold")).distinct().collect())  # as many as folds
    if len(present) < 2:
        return []

    def score(f: int) -> float:
        return scorer.evaluate(fit(df.where(fold != f)).transform(df.where(fold == f)))
    with ThreadPool(min(parallelism, len(present))) as pool:
        return pool.map(score, present)


def _fit_and_score(df: DataFrame, estimator: Estimator, features: list[str], categorical: Sequence[str],
                   keys: Sequence[str], stratify: str | None, evaluator: Evaluator, score: str,
                   names: dict[str, str], folds: int, grid: dict[str, list] | None,
                   parallelism: int) -> Trained:
    """Fit on the training share, measure on the rest and across folds of all rows.

    Folds are dealt in turn in the order of the split, so they hold each class
    alike.  With a grid, the search is repeated on the training rows of every
    fold, so no score is taken on rows that chose the parameters.
    """
    placed = _dealt(df, keys, stratify, SEED)
    train, test = placed.where(~_in_test(0.2)), placed.where(_in_test(0.2))
    pipeline = Pipeline(stages=[*feature_stages(features, categorical), estimator])
    scorer = evaluator.copy({evaluator.metricName: score})      # the larger the better
    builder = ParamGridBuilder()
    for name, values in (grid or {}).items():
        builder = builder.addGrid(getattr(estimator, name), values)
    choices = builder.build()
    inner = max(folds, 2)

    def fit(rows: DataFrame, turn: Column) -> PipelineModel:
        best = choices[0]
        if len(choices) > 1:
            found = [_fold_scores(rows, turn % inner, lambda part, c=choice: pipeline.fit(part, c), scorer, parallelism)
                     for choice in choices]
            if found[0]:
                best = max(zip(map(fmean, found), range(len(choices))), key=lambda f: (f[0], -f[1]))
                best = choices[best[1]]
        return pipeline.fit(rows, best)

    model = fit(train, F.col(INDEX))
    predicted = cut(model.transform(test).select(LABEL, "prediction"))
    figures = _scores(predicted, evaluator, names)
    if folds > 1:
        turn = F.floor(F.col(INDEX) / folds)
        scores = _fold_scores(placed, F.col(INDEX) % folds, lambda part: fit(part, turn), scorer,
                              1 if len(choices) > 1 else parallelism)
        if scores:
            figures |= {"cv_mean": fmean(scores), "cv_std": pstdev(scores)}
    spark = df.sparkSession
    return Trained(model, features, _metric_rows(spark, figures), _importances(spark, model.stages[-1], features))


def train_classifier(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str],
                     algorithm: str = "random_forest", categorical: Sequence[str] = (), tune: bool = False,
                     folds: int = 5, num_trees: int = 100, max_depth: int = 30,
                     grid: dict[str, list] | None = None, parallelism: int = 4) -> Trained:
    """Random forest or logistic regression with weighted metrics."""
    if algorithm == "random_forest":
        estimator = RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, numTrees=num_trees,
                                           maxDepth=max_depth, seed=SEED, cacheNodeIds=True)
    elif algorithm == "logistic_regression":
        estimator = LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, maxIter=1000)
    else:
        raise ValueError(f"Algorithm not supported: {algorithm}")
    search = (grid or GRID) if tune and algorithm == "random_forest" else None
    present = [c for c in features if c in df.columns]
    labelled = df.withColumn(LABEL, F.col(label).cast("double"))
    return _fit_and_score(
        labelled, estimator, present, categorical, keys, LABEL,
        MulticlassClassificationEvaluator(labelCol=LABEL), "f1", CLASS_METRICS, folds, search, parallelism)


def train_regressor(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str],
                    algorithm: str = "random_forest", categorical: Sequence[str] = (), folds: int = 5,
                    num_trees: int = 100, max_depth: int = 30, parallelism: int = 4) -> Trained:
    """Random forest or linear regression with squared, absolute and R2 figures."""
    if algorithm == "random_forest":
        estimator = RandomForestRegressor(featuresCol=FEATURES, labelCol=LABEL, numTrees=num_trees,
                                          maxDepth=max_depth, seed=SEED, cacheNodeIds=True)
    elif algorithm == "linear_regression":
        estimator = LinearRegression(featuresCol=FEATURES, labelCol=LABEL)
    else:
        raise ValueError(f"Algorithm not supported: {algorithm}")
    present = [c for c in features if c in df.columns]
    labelled = df.withColumn(LABEL, F.col(target).cast("double"))
    return _fit_and_score(
        labelled, estimator, present, categorical, keys, None,
        RegressionEvaluator(labelCol=LABEL), "r2", NUMBER_METRICS, folds, None, parallelism)


def train_clusters(df: DataFrame, features: Sequence[str], k: int = 5, starts: int = 10) -> Trained:
    """k-means on standardised features; the best of several starts by inertia."""
    present = [c for c in features if c in df.columns]
    prepared, vectors = prepare_features(df, present)
    vectors = cut(vectors)  # every start passes over it several times
    fits = [KMeans(featuresCol=FEATURES, k=k, seed=SEED + i).fit(vectors) for i in range(starts)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    spark = df.sparkSession
    figures = {"inertia": best.summary.trainingCost, "n_clusters": k, "n_samples": vectors.count()}
    return Trained(PipelineModel([*prepared.stages, best]), present, _metric_rows(spark, figures))


def cluster_centers(trained: Trained, spark: SparkSession) -> DataFrame:
    """One row per cluster with its centre in standardised units."""
    rows = [(i, *[float(x) for x in c]) for i, c in enumerate(trained.model.stages[-1].clusterCenters())]
    names = ", ".join(f"`{f}` double" for f in trained.features)
    return spark.createDataFrame(rows, f"cluster int, {names}")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict(model: PipelineModel, df: DataFrame, name: str = "prediction") -> DataFrame:
    """The data with the model's prediction; helper columns are removed."""
    scored = model.transform(df).withColumnRenamed("prediction", name)
    return scored.select(*df.columns, name)
