"""Learned column detection with Spark ML: labels, split, training, evaluation, scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.records import quoted
from ledgerloom.operators.features import feature_names
from ledgerloom.sources.files import base_name

SEED = 42
TEST_SHARE = 0.2
FEW_LABELS = 3
_BUCKETS = 4096


class NoTrainingData(ValueError):
    """There are no labelled columns, or no positive one among them."""


def labelled_set(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of the labelled files with label 1 on the named column.

    `labels` is (file_name, label_col), one row per file; unlabelled files drop out.
    """
    return (
        features.withColumn("file_name", base_name(F.col("file")))
        .join(labels.select("file_name", "label_col"), "file_name")
        .withColumn("label", (F.col("col") == F.col("label_col")).cast("double"))
        .drop("file_name", "label_col")
    )


def split(labelled: DataFrame, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Deterministic stratified split: adds `train` and `test` flags.

    The `share` of each label with the lowest hashes is the test set, exactly. Rows are
    counted per hash bucket and ranked within their bucket only, so no task sees a whole
    class. With fewer than two rows in a class, every row is used for both.
    """
    hashed = labelled.withColumn("_h", F.xxhash64("file", "col", F.lit(seed))).withColumn(
        "_b", F.pmod("_h", F.lit(_BUCKETS)).cast("int")
    )
    buckets = hashed.groupBy("label", "_b").agg(F.count(F.lit(1)).alias("_n"))
    # These windows run over the bucket counts, at most 4096 rows per label.
    by_label = W.partitionBy("label")
    before = F.sum("_n").over(by_label.orderBy("_b")) - F.col("_n")
    take = F.round(F.sum("_n").over(by_label) * share).cast("bigint") - before
    class_rows = lambda label: F.sum(
        F.when(F.col("label") == label, F.col("_n")).otherwise(0)
    ).over(W.partitionBy(F.lit(0)))
    few = (class_rows(1) < 2) | (class_rows(0) < 2)
    placed = buckets.select("label", "_b", take.alias("_take"), few.alias("_few"))
    inside = W.partitionBy("label", "_b").orderBy("_h", "file", "col")
    ranked = hashed.join(placed, ["label", "_b"]).withColumn(
        "_test", F.row_number().over(inside) <= F.col("_take")
    )
    return ranked.select(
        *labelled.columns,
        (F.col("_few") | ~F.col("_test")).alias("train"),
        (F.col("_few") | F.col("_test")).alias("test"),
    )


def fit(split_set: DataFrame, algorithm: str = "logistic", iterations: int = 100) -> PipelineModel:
    """Fit the detector on the training rows, positives weighted by negatives/positives."""
    rows = split_set.where("train")
    sizes = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("pos")
    ).first()
    if not sizes["n"]:
        raise NoTrainingData("No training data available")
    if not sizes["pos"]:
        raise NoTrainingData("No positive samples")
    weight = (sizes["n"] - sizes["pos"]) / sizes["pos"]
    weighted = rows.withColumn("weight", F.when(F.col("label") == 1, weight).otherwise(1.0))
    names = [c for c in feature_names(split_set) if c not in ("label", "train", "test")]
    assemble = VectorAssembler(inputCols=names, outputCol="raw_features")
    scale = StandardScaler(
        inputCol="raw_features", outputCol="features", withMean=True, withStd=True
    )
    if algorithm == "logistic":
        learner = LogisticRegression(weightCol="weight", maxIter=iterations, regParam=1e-4)
    elif algorithm == "gbt":
        learner = GBTClassifier(weightCol="weight", maxIter=iterations, seed=SEED)
    else:
        raise ValueError(f"unknown algorithm: {algorithm}")
    return Pipeline(stages=[assemble, scale, learner]).fit(weighted)


def confidence(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Scores (file, position, col, score) with score the probability in percent."""
    scored = model.transform(features)
    return scored.select(
        "file",
        F.col("position").cast("int").alias("position"),
        "col",
        (vector_to_array("probability")[1] * F.lit(100.0)).alias("score"),
    )


def model_table(model: PipelineModel) -> DataFrame:
    """A fitted logistic detector as a table: (feature, mean, std, weight) by feature, and a row with
    a null feature for the intercept. It can be stored, compared and scored by any SQL engine."""
    assemble, scale, learner = model.stages
    if not hasattr(learner, "coefficients"):
        raise ValueError("only a logistic detector is linear")
    rows = [(name, float(m), float(s), float(w)) for name, m, s, w in zip(
        assemble.getInputCols(), scale.mean, scale.std, learner.coefficients)]
    return SparkSession.active().createDataFrame(
        [*rows, (None, 0.0, 1.0, float(learner.intercept))],
        "feature string, mean double, std double, weight double")


def score_expression(table: DataFrame) -> Column:
    """The score in percent that a model_table gives a row of features, as one expression: nothing
    is shuffled and no learned object is sent. The table has a row per feature. Features that did
    not vary in training have no weight."""
    rows = table.orderBy(F.col("feature").isNull(), "feature").collect()
    total = F.lit(0.0)
    for r in rows:
        if r["feature"] is None:
            total = total + F.lit(r["weight"])
        elif r["std"] > 0:
            value = (F.col(quoted(r["feature"])) - F.lit(r["mean"])) / F.lit(r["std"])
            total = total + value * F.lit(r["weight"])
    return F.lit(100.0) / (F.lit(1.0) + F.exp(-total))


def table_confidence(table: DataFrame, features: DataFrame) -> DataFrame:
    """confidence() by a model_table."""
    return features.select("file", F.col("position").cast("int").alias("position"), "col",
                           score_expression(table).alias("score"))


def predictions(model: PipelineModel, split_set: DataFrame) -> DataFrame:
    """(label, predicted) of the test rows."""
    scored = model.transform(split_set.where("test"))
    return scored.select("label", F.col("prediction").alias("predicted"))


def evaluate(predicted: DataFrame) -> DataFrame:
    """One row: accuracy, precision, recall and F1 of class 1, denominators guarded."""
    hit = (F.col("label") == 1) & (F.col("predicted") == 1)
    counts = predicted.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == F.col("predicted")).alias("correct"),
        F.count_if(hit).alias("true_positives"),
        F.count_if(F.col("predicted") == 1).alias("predicted_positives"),
        F.count_if(F.col("label") == 1).alias("actual_positives"),
    )
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    rated = counts.select(
        "*",
        over("correct", "n").alias("accuracy"),
        over("true_positives", "predicted_positives").alias("precision"),
        over("true_positives", "actual_positives").alias("recall"),
    )
    both = F.col("precision") + F.col("recall")
    f1 = F.lit(2.0) * F.col("precision") * F.col("recall") / F.greatest(both, F.lit(1e-8))
    return rated.withColumn("f1", f1)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel | None:
    """The saved detector, or None when there is none at the path."""
    try:
        return PipelineModel.load(path)
    except Exception as e:
        if "does not exist" in str(e) or "PATH_NOT_FOUND" in str(e):
            return None
        raise


def validate_labels(files: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: files that have a label row, those with a non-empty label, and a verdict.

    fail without any valid label, warn with fewer than three, else ok.
    """
    valid = F.length(F.trim(F.coalesce("label_col", F.lit("")))) > 0
    names = files.select("file").distinct().select(base_name(F.col("file")).alias("file_name"))
    counts = names.join(labels.select("file_name", "label_col"), "file_name").agg(
        F.count(F.lit(1)).alias("labelled_files"), F.count_if(valid).alias("valid_labels")
    )
    verdict = (
        F.when(F.col("valid_labels") == 0, "fail")
        .when(F.col("valid_labels") < FEW_LABELS, "warn")
        .otherwise("ok")
    )
    return counts.withColumn("verdict", verdict)


def compare_with_labels(best: DataFrame, labels: DataFrame) -> DataFrame:
    """Expected and predicted column per labelled file."""
    named = labels.select("file_name", F.col("label_col").alias("expected"))
    found = best.withColumn("file_name", base_name(F.col("file")))
    return named.join(found, "file_name", "left").select(
        "file_name", "expected", F.col("col").alias("predicted"), F.col("score").alias("confidence"),
        F.coalesce(F.col("col") == F.col("expected"), F.lit(False)).alias("match"),
    )
