"""Regression and classification with Spark ML, and the learner prediction tasks.

The prepared rows are checkpointed once: every fit and fold then starts from files instead
of the plan that made them, and survives the loss of executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, LogisticRegressionModel, OneVsRest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.exprs import numeric_columns, q, rounded
from lectern.functions.ordering import exact_quantiles
from lectern.operators import forests
from lectern.operators.features import model_inputs
from lectern.session import cut_lineage, side_by_side

SEED = 42
#: Depth of a forest's trees if none is given; as deep as the engine's own trees may be.
DEPTH = 30
#: Bins of a column in boosting, the engine's number.
BINS = 32
#: Rows that are projected at once for the kernel machine, and that its fits together may keep in memory.
PIECE, WIDE_ROWS = 1000, 150_000
#: Classes of a target; more are refused, as the confusion matrix grows with their square.
MAX_CLASSES = 100

REGRESSION = ("linear", "ridge", "lasso", "random_forest", "gradient_boosting")
CLASSIFICATION = ("logistic", "random_forest", "gradient_boosting", "svm")
TASKS = {"logistic_regression": "logistic", "random_forest": "random_forest", "gradient_boosting": "gradient_boosting"}


def prepare(df: DataFrame, target: str, features: Sequence[str] | None, key: str) -> tuple[DataFrame, list[str]]:
    """Key, features and target (as `label`) of the rows without missing values."""
    if features:
        columns = [c for c in features if c in df.columns and c != target]
    else:
        columns = numeric_columns(df, {target, key})
    chosen = df.select(
        F.col(q(key)).alias("_key"),
        *[F.col(q(c)).cast("double").alias(c) for c in columns],
        F.col(q(target)).cast("double").alias("label"),
    )
    return chosen.dropna(subset=[*columns, "label"]), columns


def class_names(df: DataFrame, target: str) -> list:
    """The distinct labels in order; a target with more than MAX_CLASSES of them is refused."""
    found = [r[0] for r in df.select(F.col(q(target))).dropna().distinct().orderBy(F.col(q(target))).limit(MAX_CLASSES + 1).collect()]
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{target} has more than {MAX_CLASSES} classes")
    return found


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation; a constant column stays at zero."""
    row = df.agg(
        *[F.avg(q(c)).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(q(c)).alias(f"_s_{c}") for c in columns]
    )
    wide = df.crossJoin(F.broadcast(row))  # one row
    scale = {c: F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return wide.select(
        *[
            ((F.col(q(c)) - F.col(f"_m_{c}")) / scale[c]).alias(c) if c in columns else F.col(q(c))
            for c in df.columns
        ]
    )


def assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)


def _hash(seed: int):
    """A number below 2^52 per key: the same for any partitioning, and exact as a double."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("_key").cast("string")), F.lit(2**52))


def split(df: DataFrame, test_size: float = 0.2, seed: int = SEED, stratify: bool = False) -> DataFrame:
    """Add `_test`: a share of the rows chosen by the hash of their key, per label if stratified."""
    hashed = df.withColumn("_h", _hash(seed))
    keys = ["label"] if stratify else []
    edge = exact_quantiles(hashed.select(*keys, "_h"), "_h", {"_edge": test_size}, keys)
    # one row, or one per class: the rows stay where they are, as a shuffle by label would make one task of a class
    marked = hashed.join(F.broadcast(edge), "label") if stratify else hashed.crossJoin(F.broadcast(edge))
    return marked.withColumn("_test", F.col("_h") <= F.col("_edge")).drop("_h", "_edge")


def with_folds(df: DataFrame, folds: int, seed: int = SEED) -> DataFrame:
    return df.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_key").cast("string")), F.lit(folds)))


def regressor(kind: str, rows: int, spread: float = 1.0, trees: int = 100):
    """Estimator of a kind; `forests` grows the forests.

    Penalties of 1 refer to the sum of squares for ridge and to the mean for lasso. Spark
    scales the label by its deviation (`spread`) first, which the squared penalty must undo.
    """
    if kind == "linear":
        return LinearRegression(standardization=False)
    if kind == "ridge":
        return LinearRegression(regParam=spread / max(rows, 1), elasticNetParam=0.0, standardization=False)
    if kind == "lasso":
        return LinearRegression(regParam=1.0, elasticNetParam=1.0, standardization=False)
    if kind == "gradient_boosting":
        return GBTRegressor(maxIter=trees, maxDepth=3, stepSize=0.1, seed=SEED)
    raise ValueError(f"Unknown regression model: {kind}. Options: {list(REGRESSION)}")


def classifier(kind: str, rows: int, classes: int = 2, trees: int = 100):
    if kind == "logistic":
        return LogisticRegression(regParam=1.0 / max(rows, 1), standardization=False, maxIter=1000)
    if kind == "gradient_boosting":
        boosted = GBTClassifier(maxIter=trees, maxDepth=3, stepSize=0.1, seed=SEED)
        return boosted if classes == 2 else OneVsRest(classifier=boosted)
    if kind == "svm":
        flat = LinearSVC(regParam=1.0 / max(rows, 1), maxIter=100, standardization=False)
        return flat if classes == 2 else OneVsRest(classifier=flat)
    raise ValueError(f"Unknown classification model: {kind}. Options: {list(CLASSIFICATION)}")


def split_candidates(values: np.ndarray, most: int = BINS) -> np.ndarray:
    """Between all distinct values if they are at most `most`, else nearest to equal shares of the rows, as the engine's trees take them."""
    distinct, counts = np.unique(values, return_counts=True)
    middle = (distinct[:-1] + distinct[1:]) / 2
    if len(distinct) <= most:
        return middle
    upto = np.cumsum(counts)
    share, chosen = upto[-1] / most, []
    goal = share
    for i in range(1, len(distinct)):
        if abs(upto[i - 1] - goal) < abs(upto[i] - goal):
            chosen.append(i - 1)
            goal += share
    return middle[chosen]


class Boosted:
    """A boosted model of places between candidate splits, for rows with their columns."""

    def __init__(self, model: Model, columns: Sequence[str], points: list[np.ndarray]):
        self.model, self.columns, self.points = model, list(columns), points
        if hasattr(model, "featureImportances"):
            self.featureImportances = model.featureImportances

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(_placed(df, self.columns, self.points))


def _placed(df: DataFrame, columns: Sequence[str], points: list[np.ndarray]) -> DataFrame:
    """`features`: the number of candidates below each value."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def places(values: pd.DataFrame) -> pd.Series:
        found = [np.searchsorted(p, values.iloc[:, i].to_numpy()) for i, p in enumerate(points)]
        return pd.Series(list(np.stack(found, 1).astype(float)), dtype=object)

    return df.withColumn("features", array_to_vector(places(F.struct(*[F.col(q(c)) for c in columns]))))


def boosted(part: DataFrame, columns: Sequence[str], estimator, classes: int) -> Boosted:
    """Fit the engine's boosting to one weighted row for each combination of places that occurs (and class).

    A tree cannot tell rows apart that lie between the same candidate splits, so they have one residual and may be one row
    whose weight is their number; for regression its label is their mean, as splits and leaves depend on sums of the labels
    only. Candidates come from the columns of at most about SPLIT_ROWS rows, chosen by hash.
    """
    rows = part.count()
    label = part.schema["label"].metadata
    bits = F.pmod(F.xxhash64(F.lit(SEED), F.col("_key").cast("string"), *[F.col(q(c)) for c in columns], F.col("label")), F.lit(2**30))
    share = min(1.0, forests.SPLIT_ROWS / max(rows, 1))
    sample = part.where(bits < int(share * 2**30)).select(*[F.col(q(c)) for c in columns])
    points = [split_candidates(x) for x in sample.toPandas().to_numpy(float).T]  # about SPLIT_ROWS rows
    keys = ["features", "label"] if classes else ["features"]
    mean = [] if classes else [F.avg("label").alias("label")]
    placed = _placed(part, columns, points)
    cells = placed.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("_weight"), *mean)
    cells = cut_lineage(cells.select("features", "label", "_weight"))
    if label:
        cells = cells.withColumn("label", F.col("label").alias("label", metadata=label))
    return Boosted(estimator.setWeightCol("_weight").fit(cells), columns, points)


def rbf_features(df: DataFrame, columns: Sequence[str], size: int = 200, seed: int = SEED) -> DataFrame:
    """Random Fourier features of the RBF kernel with gamma = 1 / (columns * variance).

    A linear machine on them approximates the kernel machine; the error falls with `size`.
    """
    cells = F.array(*[F.col(q(c)).cast("double") for c in columns])
    spread = df.select(F.explode(cells).alias("v")).agg(F.var_pop("v").alias("v")).first()["v"]
    gamma = 1.0 / (len(columns) * spread) if spread else 1.0
    draw = np.random.default_rng(seed)
    weights = draw.normal(0.0, math.sqrt(2 * gamma), (len(columns), size))
    shift = draw.uniform(0.0, 2 * math.pi, size)

    # a task holds PIECE wide rows at once, not a whole batch of them
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            for i in range(0, len(v), PIECE):
                x = np.stack(v.iloc[i : i + PIECE].to_numpy())
                yield pd.Series(list(np.cos(x @ weights + shift) * math.sqrt(2.0 / size)))

    return df.withColumn("features", array_to_vector(project(cells)))


def importances(model: Model | np.ndarray, columns: Sequence[str], spark: SparkSession) -> DataFrame:
    """Tree importances, or absolute coefficients of linear models (their mean over several classes), largest first."""
    if isinstance(model, np.ndarray):  # of a forest
        weights = model
    elif hasattr(model, "featureImportances"):
        weights = model.featureImportances.toArray()
    elif isinstance(model, LogisticRegressionModel):  # one row for two classes, else one per class
        weights = np.abs(model.coefficientMatrix.toArray()).mean(0)
    elif hasattr(model, "coefficients"):
        weights = np.abs(model.coefficients.toArray())
    else:
        weights = np.zeros(0)
    rows = [(c, float(w)) for c, w in zip(columns, weights)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def confusion(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n")).orderBy("label", "prediction")


def quality(counts: list[tuple[float, float, int]]) -> dict[str, float]:
    """Accuracy, precision, recall and F1 from confusion counts; of class 1 if there are two, else weighted."""
    classes = sorted({c for a, b, _ in counts for c in (a, b)})
    total = sum(n for *_, n in counts) or 1

    def one(c: float) -> tuple[float, float, float, int]:
        hit = sum(n for a, b, n in counts if a == c and b == c)
        said = sum(n for _, b, n in counts if b == c)
        true = sum(n for a, _, n in counts if a == c)
        p, r = hit / said if said else 0.0, hit / true if true else 0.0
        return p, r, 2 * p * r / (p + r) if p + r else 0.0, true

    if len(classes) <= 2:
        p, r, f1, _ = one(1.0)
    else:
        each = [one(c) for c in classes]
        p, r, f1 = (sum(x[i] * x[3] for x in each) / total for i in range(3))
    return {"accuracy": sum(n for a, b, n in counts if a == b) / total, "precision": p, "recall": r, "f1": f1}


def _counts(predicted: DataFrame) -> list[tuple[float, float, int]]:
    # at most the square of the number of classes
    return [(r["label"], r["prediction"], r["n"]) for r in confusion(predicted).collect()]


def accuracy(predicted: DataFrame) -> float:
    return quality(_counts(predicted))["accuracy"]


def _summary(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame({k: [v] for k, v in values.items()}))


def fitted(
    data: DataFrame, columns: Sequence[str], model_type: str, fit: Callable[[DataFrame], Model], score: Callable[[DataFrame], float],
    folds: int, classes: int, trees: int, depth: int, score_all: bool = False, at_once: int | None = None,
) -> tuple[Model | np.ndarray, DataFrame, list[float]]:
    """The model (of a forest its importances), the scored test rows (or all rows), and the score of every fold."""
    if model_type == "random_forest":
        found, weights = forests.forest(data, columns, folds, classes, trees, depth, SEED, score_all)
        found = cut_lineage(found)
        return weights, found.where(F.col("_fit") == forests.MAIN), together(lambda i: score(found.where(F.col("_fit") == i)), folds)

    def one(i: int) -> Model | float:
        if i == folds:
            return fit(data.where(~F.col("_test")))
        return score(fit(data.where(F.col("_fold") != i)).transform(data.where(F.col("_fold") == i)))

    *hits, model = together(one, folds + 1, at_once)
    return model, cut_lineage(model.transform(data if score_all else data.where("_test"))), hits


def numbered(df: DataFrame) -> DataFrame:
    """Add `_id`, the number of a row; it lasts once the rows are written."""
    return df.withColumn("_id", F.monotonically_increasing_id())


def regression(
    df: DataFrame,
    target: str,
    key: str,
    features: Sequence[str] | None = None,
    model_type: str = "random_forest",
    test_size: float = 0.2,
    cv_folds: int = 5,
    trees: int = 100,
    depth: int = DEPTH,
) -> dict[str, DataFrame]:
    """Fit on the training part; quality on the test part and over folds, importances, predictions."""
    data, columns = prepare(df, target, features, key)
    data = cut_lineage(numbered(with_folds(split(assembled(cut_lineage(data), columns), test_size), cv_folds)))
    rows = data.agg(F.count_if(~F.col("_test")).alias("train"), F.count_if("_test").alias("test")).first()

    def fit(part: DataFrame) -> Model:
        size = part.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).first()
        found = regressor(model_type, size["n"], size["s"] or 1.0, trees)
        return boosted(part, columns, found, 0) if model_type == "gradient_boosting" else found.fit(part)

    model, tested, folds = fitted(
        data, columns, model_type, fit, RegressionEvaluator(metricName="r2").evaluate, cv_folds, 0, trees, depth
    )
    score = {m: RegressionEvaluator(metricName=m).evaluate(tested) for m in ("r2", "rmse", "mae")}
    spark = df.sparkSession
    metrics = _summary(
        spark, model_type=model_type, target=target, **score, cv_scores=folds, cv_mean=float(np.mean(folds)),
        train_size=rows["train"], test_size=rows["test"],
    )
    predictions = tested.select(F.col("_key").alias(key), "label", "prediction")
    return {"metrics": metrics, "importances": importances(model, columns, spark), "predictions": predictions}


def together(fold: Callable[[int], Model | float], folds: int, at_once: int | None = None) -> list:
    """What the folds (and the model of the training part) give; the engine runs their jobs side by side, `at_once` at most."""
    with ThreadPoolExecutor(max_workers=max(1, at_once or folds)) as pool:
        return list(pool.map(fold, range(folds)))


def _vectors(data: DataFrame, columns: list[str], model_type: str) -> DataFrame:
    return rbf_features(data, columns) if model_type == "svm" else assembled(data, columns)


def classification(
    df: DataFrame,
    target: str,
    key: str,
    features: Sequence[str] | None = None,
    model_type: str = "random_forest",
    test_size: float = 0.2,
    cv_folds: int = 5,
    trees: int = 100,
    depth: int = DEPTH,
) -> dict[str, DataFrame]:
    """Like `regression`, with a stratified split, a confusion matrix and class metrics.

    Labels may be of any kind. They are numbered in their order, and shown as text again in `confusion` and `predictions`
    where they are not whole numbers from 0 on; with two classes the second one is the positive one.
    """
    names = class_names(df, target)
    columns = [c for c in (features or numeric_columns(df, {target, key})) if c in df.columns and c != target]
    numbers = df.sparkSession.createDataFrame([(v, float(i)) for i, v in enumerate(names)], T.StructType([df.schema[target], T.StructField("_class", T.DoubleType())]))
    df = df.join(F.broadcast(numbers), target).drop(target)  # at most MAX_CLASSES rows
    data, columns = prepare(df, "_class", columns, key)
    data = _vectors(cut_lineage(data), columns, model_type)
    data = cut_lineage(numbered(with_folds(split(data, test_size, stratify=True), cv_folds)))
    rows = data.agg(
        F.count_if(~F.col("_test")).alias("train"), F.count_if("_test").alias("test"),
        F.countDistinct("label").alias("classes"),
    ).first()

    def fit(part: DataFrame) -> Model:
        found = classifier(model_type, part.count(), rows["classes"], trees)
        return boosted(part, columns, found, rows["classes"]) if model_type == "gradient_boosting" else found.fit(part)

    # each fit keeps its rows in memory, and those of the kernel machine are wide
    at_once = max(1, min(cv_folds + 1, WIDE_ROWS // max(1, rows["train"] + rows["test"]))) if model_type == "svm" else None
    model, tested, folds = fitted(data, columns, model_type, fit, accuracy, cv_folds, len(names), trees, depth, at_once=at_once)
    spark = df.sparkSession
    metrics = _summary(
        spark, model_type=model_type, target=target, **quality(_counts(tested)), cv_scores=folds,
        cv_mean=float(np.mean(folds)), train_size=rows["train"], test_size=rows["test"],
    )
    plain = names == list(range(len(names)))
    shown = lambda c: F.col(c) if plain else F.get(F.array(*[F.lit(str(v)) for v in names]), F.col(c).cast("int"))
    return {
        "metrics": metrics,
        "confusion": confusion(tested).withColumns({c: shown(c) for c in ("label", "prediction")}),
        "importances": importances(model, columns if model_type != "svm" else [], spark),
        "predictions": tested.select(F.col("_key").alias(key), shown("label").alias("label"), shown("prediction").alias("prediction")),
    }


def dropout_label(matrix: DataFrame, threshold: float = 25.0) -> DataFrame:
    low = (F.col("avg_progress") < threshold) & (F.col("courses_completed") == 0)
    return matrix.withColumn("_label", low.cast("int"))


def completion_label(matrix: DataFrame) -> DataFrame:
    return matrix.withColumn("_label", (F.col("courses_completed") > 0).cast("int"))


def high_performer_label(matrix: DataFrame, percentile: float = 75.0) -> DataFrame:
    """The matrix is written first, as the percentile, the classes and the rows are read from it one after another."""
    return _high_performers(cut_lineage(matrix), percentile)


def _high_performers(matrix: DataFrame, percentile: float = 75.0) -> DataFrame:
    edge = exact_quantiles(matrix, "avg_progress", {"_edge": percentile / 100})
    wide = matrix.crossJoin(F.broadcast(edge))  # one row
    return wide.withColumn("_label", (F.col("avg_progress") >= F.col("_edge")).cast("int")).drop("_edge")


def train_and_score(
    labelled: DataFrame, task: str, model_type: str = "random_forest", test_size: float = 0.2, cv_folds: int = 5,
    trees: int = 100, depth: int = DEPTH,
) -> dict[str, DataFrame]:
    """Fit a task on behaviour columns only, evaluate it, and score every learner.

    The flagged list is highest first for dropout and lowest first for the other tasks. If
    all learners have one label, there is only a metrics row with `error`.
    """
    return _trained(_task_rows(labelled, task, test_size, cv_folds), task, model_type, trees, depth)


@dataclass
class TaskRows:
    """Written rows of a task with their folds, its columns and the learners per label; or why it cannot be trained."""

    data: DataFrame
    columns: list[str]
    per: dict[float, int]
    folds: int = 0
    error: str | None = None


def _task_rows(labelled: DataFrame, task: str, test_size: float, cv_folds: int) -> TaskRows:
    columns = model_inputs(labelled, ["_label"])
    data, columns = prepare(labelled, "_label", columns, "email")
    data = standardised(cut_lineage(data), columns)
    per = {r["label"]: r["n"] for r in data.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(per) < 2:
        return TaskRows(data, columns, per, error=f"Only one class present for {task}. Cannot train.")
    if min(per.values()) < 2:
        return TaskRows(data, columns, per, error=f"A class of {task} has a single member. Cannot train.")
    # both classes are declared, as a fold may hold only one
    nominal = {"ml_attr": {"type": "nominal", "vals": ["0.0", "1.0"]}}
    data = data.withColumn("label", F.col("label").alias("label", metadata=nominal))
    folds = min(cv_folds, max(2, min(per.values())))
    data = cut_lineage(numbered(with_folds(split(assembled(data, columns), test_size, stratify=True), folds)))
    return TaskRows(data, columns, per, folds)


def _trained(rows: TaskRows, task: str, model_type: str, trees: int, depth: int) -> dict[str, DataFrame]:
    spark, data, columns, per, folds = rows.data.sparkSession, rows.data, rows.columns, rows.per, rows.folds
    if rows.error:
        return {"metrics": _summary(spark, task=task, error=rows.error)}
    kind = TASKS.get(model_type, "random_forest")

    def fit(part: DataFrame) -> Model:
        found = classifier(kind, part.count(), 2, trees)
        return boosted(part, columns, found, 2) if kind == "gradient_boosting" else found.fit(part)

    model, scored, hits = fitted(data, columns, kind, fit, accuracy, folds, 2, trees, depth, score_all=True)
    tested = scored.where("_test")
    auc = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", numBins=0).evaluate(tested)
    numbers = {**quality(_counts(tested)), "auc_roc": auc, "cv_mean_accuracy": np.mean(hits), "cv_std": np.std(hits)}
    metrics = _summary(
        spark, task=task, model_type=model_type, **{k: round(float(v), 4) for k, v in numbers.items()},
        positive=int(per.get(1.0, 0)), negative=int(per.get(0.0, 0)), features_used=columns,
    )
    name = f"{task}_probability"
    chance = rounded(vector_to_array("probability")[1], 3).alias(name)
    probabilities = scored.select(F.col("_key").alias("email"), chance)
    order = F.desc(name) if task == "dropout" else F.asc(name)
    return {
        "metrics": metrics,
        "confusion": confusion(tested),
        "importances": importances(model, columns, spark).withColumn("importance", rounded("importance", 4)),
        "probabilities": probabilities,
        "top_flagged": probabilities.orderBy(order, "email").limit(20),
    }


def all_predictions(
    matrix: DataFrame, model_type: str = "random_forest", test_size: float = 0.2, cv_folds: int = 5, trees: int = 100, depth: int = DEPTH
) -> dict[str, dict[str, DataFrame]]:
    """Dropout, completion and high performers from one learner matrix, which is written first.

    Their rows are prepared side by side. The fits of one task follow those of another, as each fit keeps its rows in memory.
    """
    matrix = cut_lineage(matrix)
    labels = {
        "dropout": dropout_label(matrix),
        "completion": completion_label(matrix),
        "high_performer": _high_performers(matrix),
    }
    ready = side_by_side(lambda task: _task_rows(labels[task], task, test_size, cv_folds), labels)
    return {task: _trained(rows, task, model_type, trees, depth) for task, rows in zip(labels, ready, strict=True)}


def prediction_metrics(predictions: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """Metrics rows of the tasks that could be trained."""
    out = None
    for parts in predictions.values():
        row = parts["metrics"]
        if "accuracy" in row.columns:
            out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no task could be trained")
    return out
