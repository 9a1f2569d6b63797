"""Node clustering and its scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel, PowerIterationClustering
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldgraph.functions.vectors import list_array, matrix, rounded, sum_vectors

MAX_GROUPS = 2000
STEP_VALUES = 4_000_000


def _vectors(coords: DataFrame) -> DataFrame:
    return coords.select("id", array_to_vector("z").alias("vector"))


def fit_clusters(coords: DataFrame, k: int, seed: int = 0, iterations: int = 40) -> KMeansModel:
    """K-means in spectral space."""
    learner = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="vector", predictionCol="cluster")
    return learner.fit(_vectors(coords))


def assign(model: KMeansModel, coords: DataFrame) -> DataFrame:
    """``clusters(id, cluster)``: nearest centre; cold nodes need no edges for it."""
    return model.transform(_vectors(coords)).select("id", "cluster")


def cluster(coords: DataFrame, k: int, seed: int = 0, iterations: int = 40) -> DataFrame:
    return assign(fit_clusters(coords, k, seed, iterations), coords)


def _nearest(centers: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each row; of equally near ones the first."""
    found = np.zeros(len(rows), dtype=np.int32)
    step = max(1, STEP_VALUES // centers.size)
    for a in range(0, len(rows), step):
        delta = rows[a : a + step, None, :] - centers[None, :, :]
        found[a : a + step] = (delta * delta).sum(axis=2).argmin(axis=1)
    return found


def assign_to(centers: np.ndarray, coords: DataFrame) -> DataFrame:
    """``clusters(id, cluster)`` by given centres: a narrow map."""
    shared = coords.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _nearest(shared.value, matrix(batch.column("z"), shared.value.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found)], names=["id", "cluster"])

    kind = coords.schema["id"].dataType.simpleString()
    return coords.select("id", "z").mapInArrow(run, f"id {kind}, cluster int")


def lloyd_step(centers: np.ndarray, coords: DataFrame) -> DataFrame:
    """``(cluster, n, center)``: the means of the rows nearest to each of the given centres.

    Each task adds its rows up to one partial per centre, so what is shuffled depends on the tasks and the k x d
    centres only. A centre without rows stays where it is (n = 0).
    """
    k, d = centers.shape
    spark = coords.sparkSession
    shared = spark.sparkContext.broadcast(centers)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, d)), np.zeros(k, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch.column("z"), d)
                found = _nearest(shared.value, rows)
                np.add.at(sums, found, rows)
                counts += np.bincount(found, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(counts), list_array(sums)], names=["cluster", "n", "sums"])

    partials = coords.select("z").mapInArrow(partial, "cluster int, n bigint, sums array<double>")
    added = sum_vectors(partials, "cluster", "sums", d, None, "sums", n=F.sum("n"))
    former = spark.createDataFrame([(j, c.tolist()) for j, c in enumerate(centers)], "cluster int, former array<double>")
    mean = F.when(F.col("n") > 0, F.transform("sums", lambda x: x / F.col("n"))).otherwise(F.col("former"))
    return former.join(added, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.coalesce(mean, "former").alias("center"))


def lloyd(centers: np.ndarray, coords: DataFrame, steps: int = 20, tolerance: float = 1e-6) -> np.ndarray:
    """Centres after at most ``steps`` steps, or once none moves by more than ``tolerance``; k x d numbers reach the driver."""
    for _ in range(steps):
        rows = sorted(lloyd_step(centers, coords).select("cluster", "center").collect())
        former, centers = centers, np.array([r["center"] for r in rows])
        if np.abs(centers - former).max() <= tolerance:
            break
    return centers


def power_iteration_clusters(edges: DataFrame, k: int, iterations: int = 20) -> DataFrame:
    """``clusters`` from adjacency alone: nodes without edges get none."""
    learner = PowerIterationClustering(
        k=k, maxIter=iterations, initMode="degree", srcCol="src", dstCol="dst", weightCol="weight"
    )
    return learner.assignClusters(edges).select("id", F.col("cluster").cast("int").alias("cluster"))


def contingency(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """``(cluster, label, n)`` over the nodes that have both."""
    known = labels.filter("label IS NOT NULL").select("id", "label")
    return clusters.join(known, "id").groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))


def clustering_scores(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """``(n, purity, nmi, ari)``: grouping sets over the contingency table, then one aggregate."""
    sets = (
        contingency(clusters, labels)
        .groupingSets([["cluster", "label"], ["cluster"], ["label"]], "cluster", "label")
        .agg(
            F.sum("n").alias("n"),
            F.max("n").alias("top"),
            F.grouping("cluster").alias("no_cluster"),
            F.grouping("label").alias("no_label"),
        )
    )
    whole = (F.col("no_cluster") == 0) & (F.col("no_label") == 0)
    by_cluster, by_label = F.col("no_label") == 1, F.col("no_cluster") == 1
    nlogn = F.col("n") * F.log("n")
    pairs = F.col("n") * (F.col("n") - 1) / 2

    def part(rows: Column, value: Column) -> Column:
        return F.sum(F.when(rows, value))

    joined = sets.agg(
        F.coalesce(part(whole, F.col("n")), F.lit(0)).alias("total"),
        part(whole, nlogn).alias("cells"),
        part(whole, pairs).alias("both"),
        part(by_cluster, F.col("top")).alias("top"),
        part(by_cluster, nlogn).alias("rows"),
        part(by_cluster, pairs).alias("row_pairs"),
        part(by_label, nlogn).alias("cols"),
        part(by_label, pairs).alias("col_pairs"),
    )
    n = F.col("total")
    h_rows = F.log(n) - F.col("rows") / n
    h_cols = F.log(n) - F.col("cols") / n
    mutual = F.log(n) + (F.col("cells") - F.col("rows") - F.col("cols")) / n
    all_pairs = n * (n - 1) / 2
    expected = F.col("row_pairs") * F.col("col_pairs") / F.when(all_pairs > 0, all_pairs)
    spread = (F.col("row_pairs") + F.col("col_pairs")) / 2 - expected
    nmi = F.when(h_rows + h_cols < 1e-12, 1.0).otherwise(
        mutual / F.when(h_rows + h_cols >= 1e-12, (h_rows + h_cols) / 2)
    )
    ari = F.when(F.coalesce(F.abs(spread) < 1e-12, F.lit(True)), 1.0).otherwise(
        (F.col("both") - expected) / F.when(spread != 0, spread)
    )
    return joined.filter(n > 0).select(
        n.alias("n"),
        rounded(F.col("top") / n).alias("purity"),
        rounded(F.greatest(nmi, F.lit(0.0))).alias("nmi"),
        rounded(ari).alias("ari"),
    )


def matched_accuracy(clusters: DataFrame, labels: DataFrame, groups: int = MAX_GROUPS) -> float:
    """Accuracy under the best one-to-one match of clusters and labels.

    Only the contingency table reaches the driver; ``groups`` states how many clusters or labels there are at most.
    """
    cells = contingency(clusters, labels).limit(groups * groups + 1).collect()
    rows = {c: i for i, c in enumerate(sorted({r["cluster"] for r in cells}))}
    columns = {c: i for i, c in enumerate(sorted({r["label"] for r in cells}))}
    if len(rows) > groups or len(columns) > groups:
        raise ValueError(f"more than {groups} clusters or labels")
    if not cells:
        return 0.0
    counts = np.zeros((max(len(rows), len(columns)),) * 2)
    for r in cells:
        counts[rows[r["cluster"]], columns[r["label"]]] = r["n"]
    return float(counts[np.arange(len(counts)), _best_match(-counts)].sum() / counts.sum())


def _best_match(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the cheapest one-to-one match (shortest augmenting paths)."""
    n = len(cost)
    row_price, column_price = np.zeros(n), np.zeros(n)
    row_of = np.full(n, -1)
    for row in range(n):
        reach = np.full(n, np.inf)
        previous = np.full(n, -1)
        done = np.zeros(n, dtype=bool)
        current_row, column = row, -1
        low = 0.0
        while True:
            slack = low + cost[current_row] - row_price[current_row] - column_price
            better = ~done & (slack < reach)
            reach[better] = slack[better]
            previous[better] = column
            column = int(np.where(done, np.inf, reach).argmin())
            low = reach[column]
            done[column] = True
            if row_of[column] < 0:
                break
            current_row = row_of[column]
        visited = done.copy()
        visited[column] = False
        row_price[row] += low
        row_price[row_of[visited]] += low - reach[visited]
        column_price[visited] -= low - reach[visited]
        while column >= 0:
            before = previous[column]
            row_of[column] = row if before < 0 else row_of[before]
            column = before
    match = np.empty(n, dtype=int)
    match[row_of] = np.arange(n)
    return match


def silhouette(coords: DataFrame, clusters: DataFrame) -> float:
    """Mean silhouette with squared Euclidean distance; needs no labels."""
    placed = _vectors(coords).join(clusters, "id").withColumn("cluster", F.col("cluster").cast("double"))
    evaluator = ClusteringEvaluator(featuresCol="vector", predictionCol="cluster")
    return evaluator.evaluate(placed)
