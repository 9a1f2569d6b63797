"""Node classification and its metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldgraph.functions.skew import HOT_ROWS, attach
from coldgraph.functions.vectors import dimension, list_array, matrix, rounded, sum_vectors
from coldgraph.session import materialize

MAX_CLASSES = 10_000


def neighbor_vote(
    neighbors: DataFrame,
    labels: DataFrame,
    weighting: str = "count",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``(id, pred, votes)``: label with the most neighbours, or the most 1/(1+dist).

    Ties go to the smallest label. ``labels(id, label)``; unlabelled neighbours don't vote.
    """
    if weighting not in ("count", "distance"):
        raise ValueError(f"unknown weighting {weighting}")
    known = labels.filter("label IS NOT NULL").select(F.col("id").alias("dst"), "label")
    # written once: attach counts its left side, which would run the search for neighbours twice
    neighbors = materialize(neighbors, "voters")
    voters = attach(neighbors, known, "dst", ["src"], hot_rows=hot_rows)
    vote = F.lit(1.0) if weighting == "count" else 1 / (1 + F.col("dist"))
    counted = voters.groupBy("src", "label").agg(rounded(F.sum(vote)).alias("votes"))
    best = F.max(F.struct("votes", (-F.col("label")).alias("label")))
    return counted.groupBy(F.col("src").alias("id")).agg(best.alias("best")).select(
        "id", (-F.col("best.label")).cast("int").alias("pred"), F.col("best.votes").alias("votes")
    )


def fit_classifier(
    reps: DataFrame, algo: str = "logistic", hidden: int = 32, seed: int = 0, iterations: int = 100
) -> PipelineModel:
    """Train on ``reps(id, x, label)``; rows without a label are left out."""
    train = _vectors(reps.filter("label IS NOT NULL"))
    scaler = StandardScaler(inputCol="vector", outputCol="scaled", withMean=True)
    if algo == "logistic":
        learner = LogisticRegression(
            featuresCol="scaled", predictionCol="prediction", regParam=1e-3, maxIter=iterations
        )
    elif algo == "mlp":
        classes = train.agg(F.max("label")).first()[0] + 1
        learner = MultilayerPerceptronClassifier(
            featuresCol="scaled",
            layers=[dimension(reps, "x"), hidden, classes],
            maxIter=iterations,
            seed=seed,
        )
    else:
        raise ValueError(f"unknown algorithm {algo}")
    return Pipeline(stages=[scaler, learner]).fit(train)


def _vectors(reps: DataFrame) -> DataFrame:
    return reps.withColumn("vector", array_to_vector("x"))


def predict(model: PipelineModel, reps: DataFrame) -> DataFrame:
    """``preds(id, label, pred)``."""
    label = F.col("label") if "label" in reps.columns else F.lit(None).cast("int")
    return model.transform(_vectors(reps)).select(
        "id", label.alias("label"), F.col("prediction").cast("int").alias("pred")
    )


def fit_logistic(reps: DataFrame, steps: int = 8, ridge: float = 0.0) -> np.ndarray:
    """Weights of a logistic regression on ``reps(x, label)`` with labels 0 and 1, the intercept last, by ``steps`` Newton steps from zero.

    Each task adds up one gradient and one (d + 1) x (d + 1) matrix per step; these sums alone are shuffled and reach the driver. Rows without
    a label are left out. ``ridge`` times the number of rows is added to the diagonal but for the intercept. A direction the data leave open stays at zero.
    """
    d = dimension(reps, "x") + 1
    known = reps.filter("label IS NOT NULL").select("x", F.col("label").cast("double").alias("y"))
    weights = np.zeros(d)
    for _ in range(steps):
        sums = np.zeros((d, d + 2))
        for r in sum_vectors(_newton_partials(known, weights), "p", "parts", d + 2, None, "parts").collect():
            sums[r["p"]] = r["parts"]
        penalty = ridge * sums[0, d + 1] * np.append(np.ones(d - 1), 0.0)
        step = np.linalg.lstsq(sums[:, :d] + np.diag(penalty), sums[:, d] - penalty * weights, rcond=1e-12)[0]
        weights = weights + step
    return weights


def _newton_partials(known: DataFrame, weights: np.ndarray) -> DataFrame:
    """``(p, parts)``: row p of the second derivative, then the gradient's entry and the number of rows; one set per task."""
    d = len(weights)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 2))
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([matrix(batch.column("x"), d - 1), np.ones(batch.num_rows)])
                p = _logistic(x @ weights)
                total[:, :d] += (x * (p * (1 - p))[:, None]).T @ x
                total[:, d] += x.T @ (batch.column("y").to_numpy() - p)
                total[:, d + 1] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), list_array(total)], names=["p", "parts"])

    return known.mapInArrow(partial, "p int, parts array<double>")


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def predict_logistic(weights: np.ndarray, reps: DataFrame) -> DataFrame:
    """``(id, score, pred)``: the probability of label 1, and whether it is 0.5 or more."""
    d = len(weights) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = _logistic(matrix(batch.column("x"), d) @ weights[:-1] + weights[-1])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["id", "score", "pred"])

    kind = reps.schema["id"].dataType.simpleString()
    return reps.select("id", "x").mapInArrow(run, f"id {kind}, score double, pred int")


def _safe(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(0.0)


def classification_report(preds: DataFrame, by: str | None = None) -> DataFrame:
    """``(grp, label, support, precision, recall, f1, accuracy)``, one row per class and group.

    ``label`` null: accuracy and macro means over the labels in truth or prediction.
    ``grp`` null: all groups together (one pass through grouping sets). Rows without a
    true label don't count.
    """
    group = F.col(by).cast("string") if by else F.lit(None).cast("string")
    cells = (
        preds.filter("label IS NOT NULL")
        .select(group.alias("grp"), "label", "pred")
        .groupBy("grp", "label", "pred")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if by:
        cells = (
            cells.groupingSets([["grp", "label", "pred"], ["label", "pred"]], "grp", "label", "pred")
            .agg(F.sum("n").alias("n"), F.grouping("grp").alias("total"))
        )
    else:
        cells = cells.withColumn("total", F.lit(1))
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("truth"), F.lit(0).cast("bigint").alias("guess")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("truth"), F.col("n").alias("guess")),
    )
    hit = F.when((F.col("label") == F.col("pred")) & (F.col("truth") > 0), F.col("n")).otherwise(0)
    per_class = (
        cells.select("total", "grp", "label", "pred", "n", F.inline(sides))
        .filter("class IS NOT NULL")
        .groupBy("total", "grp", "class")
        .agg(F.sum("truth").alias("truth"), F.sum("guess").alias("guess"), F.sum(hit).alias("hit"))
    )
    precision, recall = _safe(F.col("hit"), F.col("guess")), _safe(F.col("hit"), F.col("truth"))
    scored = per_class.select(
        "total", "grp", F.col("class").alias("label"), "truth", "hit",
        precision.alias("p"), recall.alias("r"),
        _safe(2 * F.col("hit"), F.col("truth") + F.col("guess")).alias("f"),
    )
    classes = scored.select(
        "grp", "label", F.col("truth").alias("support"),
        rounded(F.col("p")).alias("precision"), rounded(F.col("r")).alias("recall"),
        rounded(F.col("f")).alias("f1"), F.lit(None).cast("double").alias("accuracy"),
    )
    overall = scored.groupBy("total", "grp").agg(
        F.sum("truth").alias("support"),
        rounded(F.avg("p")).alias("precision"),
        rounded(F.avg("r")).alias("recall"),
        rounded(F.avg("f")).alias("f1"),
        rounded(F.sum("hit") / F.sum("truth")).alias("accuracy"),
    )
    return classes.unionByName(
        overall.select(
            "grp", F.lit(None).cast("int").alias("label"), "support", "precision", "recall", "f1", "accuracy"
        )
    )


def accuracy(preds: DataFrame) -> Column:
    """Share of rows with a true label whose prediction equals it; a missing one is wrong."""
    return F.avg(F.when(F.coalesce(F.col("label") == F.col("pred"), F.lit(False)), 1.0).otherwise(0.0))


def confusion_cells(preds: DataFrame) -> DataFrame:
    """``(label, pred, n)``: the filled cells of the confusion matrix, whatever the number of classes."""
    known = preds.filter("label IS NOT NULL AND pred IS NOT NULL")
    return known.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(preds: DataFrame) -> DataFrame:
    """``(label, pred_0, pred_1, ...)``: counts, one column per predicted class."""
    known = preds.filter("label IS NOT NULL AND pred IS NOT NULL")
    found = known.select("pred").distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} predicted classes")
    classes = sorted(r["pred"] for r in found)
    counted = known.groupBy("label").pivot("pred", classes).agg(F.count(F.lit(1)))
    return counted.select(
        "label", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"pred_{c}") for c in classes]
    )
