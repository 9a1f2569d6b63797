"""Every operator as a query over the given tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldgraph.functions.vectors import long_form, rounded
from coldgraph.operators import classify, cluster, graph, links, neighbors, represent, spectral
from coldgraph.plans import experiments
from coldgraph.session import materialize, new_path
from coldgraph.sources import tables
from coldgraph.sources.datasets import (
    EMBEDDING_DIM,
    nation_chain,
    planted_edges,
    planted_nodes,
    read,
    read_stream,
    retail_edges,
    retail_nodes,
)
from coldgraph.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SHARE = 0.2
K = 10
DIMS = 9
SHARES = (0.05, 0.1, 0.2, 0.5)
APPROX_FACTOR = 0.7


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _planted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = materialize(planted_nodes(spark, sf_dir), "nodes")
    return nodes, materialize(planted_edges(spark, sf_dir), "edges")


def _split(spark: SparkSession, sf_dir: str, share: float = SHARE) -> graph.ColdSplit:
    return graph.cold_split(*_planted(spark, sf_dir), share)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[rounded(F.col(c)).alias(c) if c in columns else c for c in df.columns])


# --- graph --------------------------------------------------------------------


@query
def load_nodes(spark, sf_dir):
    return long_form(planted_nodes(spark, sf_dir), "features", "id", "label")


@query
def node_report(spark, sf_dir):
    vectors = read(spark, sf_dir, "customer").withColumn(
        "vector", F.array(F.col("c_acctbal"), F.col("c_nationkey").cast("double"))
    )
    return tables.node_report(vectors, "c_custkey", "vector", "c_nationkey", dim=2)


@query
def normalize_edges(spark, sf_dir):
    return _rounded(retail_edges(spark, sf_dir), "weight")


@query
def symmetric_edges(spark, sf_dir):
    return _rounded(graph.symmetric(retail_edges(spark, sf_dir)), "weight")


@query
def degrees(spark, sf_dir):
    found = graph.degrees(retail_edges(spark, sf_dir), retail_nodes(spark, sf_dir, check=False))
    return _rounded(found, "weighted_degree")


@query
def detect_cold(spark, sf_dir):
    split = _split(spark, sf_dir)
    nodes = split.warm_nodes.unionByName(split.cold_nodes)
    return graph.detect_cold(nodes, split.warm_edges).select("id", "label")


@query
def cold_split(spark, sf_dir):
    edges = retail_edges(spark, sf_dir)
    split = graph.cold_split(retail_nodes(spark, sf_dir, check=False), edges, SHARE)
    return split.warm_edges.select("src", "dst", F.lit("warm").alias("part")).unionByName(
        split.truth.select("src", "dst", F.lit("truth").alias("part"))
    )


@query
def induced_subgraph(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    parts = read(spark, sf_dir, "part").filter("p_size <= 25")
    ids = customers.select((F.col("c_custkey") * 2).alias("id")).unionByName(
        parts.select((F.col("p_partkey") * 2 + 1).alias("id"))
    )
    edges = materialize(retail_edges(spark, sf_dir), "edges")
    return _rounded(graph.induced_subgraph(edges, ids), "weight")


@query
def knn_graph(spark, sf_dir):
    return neighbors.knn_graph(planted_nodes(spark, sf_dir), K)


def _incidence(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    return materialize(graph.incidence(lines, "l_partkey", "l_orderkey"), "incidence")


@query
def cooccurrence_degrees(spark, sf_dir):
    return graph.cooccurrence_degrees(_incidence(spark, sf_dir))


@query
def cooccurrence_sums(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 1000).alias("features"),
    )
    found = graph.cooccurrence_sums(_incidence(spark, sf_dir), parts, 2)
    return long_form(found, "sums", "id", "degree")


@query
def cooccurrence_weights(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    following = lines.select(
        "l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("next")
    )
    pairs = (
        lines.join(following, ["l_orderkey", "l_linenumber"])
        .filter("l_partkey <> next")
        .select(F.least("l_partkey", "next").alias("src"), F.greatest("l_partkey", "next").alias("dst"))
    )
    return graph.cooccurrence_weights(pairs, _incidence(spark, sf_dir))


@query
def save_load_edges(spark, sf_dir):
    path = new_path(spark, "saved-edges")
    tables.save_edges(retail_edges(spark, sf_dir), path, buckets=8)
    return _rounded(tables.load_edges(spark, path), "weight")


@query
def save_load_nodes(spark, sf_dir):
    path = new_path(spark, "saved-nodes")
    tables.save_bucketed(planted_nodes(spark, sf_dir), path, "id", 8)
    return long_form(tables.load_bucketed(spark, path), "features", "id", "label")


@query
def save_load_pruned(spark, sf_dir):
    """Edges of a few nodes, read from the buckets that hold them."""
    path = new_path(spark, "saved-links")
    tables.save_bucketed(graph.symmetric(retail_edges(spark, sf_dir)), path, "src", 8)
    return _rounded(tables.load_bucketed(spark, path, [2, 3, 20, 21]), "weight")


@query
def save_load_joined(spark, sf_dir):
    """Links and node labels, each saved by the node, joined without a shuffle."""
    links_path, nodes_path = new_path(spark, "saved-links"), new_path(spark, "saved-nodes")
    tables.save_bucketed(graph.symmetric(retail_edges(spark, sf_dir)).select("src", "dst"), links_path, "src", 8)
    tables.save_bucketed(retail_nodes(spark, sf_dir, check=False).select("id", "label"), nodes_path, "id", 8)
    labels = tables.load_bucketed(spark, nodes_path).where("label IS NOT NULL").withColumnRenamed("id", "src")
    return tables.load_bucketed(spark, links_path).join(labels, "src")


@query
def save_load_model(spark, sf_dir):
    """A map that is saved, loaded and applied; its coordinates are saved and loaded too."""
    model_path, coords_path = new_path(spark, "saved-model"), new_path(spark, "saved-coords")
    tables.save_table(_given_map().to_row(spark), model_path)
    model = spectral.SpectralMap.from_row(tables.load_table(spark, model_path))
    tables.save_bucketed(spectral.apply_spectral_map(model, planted_nodes(spark, sf_dir)), coords_path, "id", 8)
    return long_form(tables.load_bucketed(spark, coords_path), "z", "id")


# --- spectral -----------------------------------------------------------------


@query
def laplacian_entries(spark, sf_dir):
    edges = materialize(retail_edges(spark, sf_dir), "edges")
    return _rounded(spectral.laplacian_entries(edges, "sym"), "value")


@query
def laplacian_random_walk(spark, sf_dir):
    edges = materialize(retail_edges(spark, sf_dir), "edges")
    return spectral.laplacian_entries(edges, "rw")


@query
def laplacian_plain(spark, sf_dir):
    edges = materialize(retail_edges(spark, sf_dir), "edges")
    return _rounded(spectral.laplacian_entries(edges, "plain"), "value")


@query
def rayleigh_features(spark, sf_dir):
    nodes, edges = _planted(spark, sf_dir)
    coords = nodes.select("id", F.col("features").alias("z"))
    return _rounded(spectral.rayleigh(edges, coords), "value")


@query
def spectral_moments(spark, sf_dir):
    return _rounded(spectral.spectral_moments(*_planted(spark, sf_dir)), "value")


def _model(split: graph.ColdSplit) -> spectral.SpectralMap:
    return spectral.fit_spectral_map(split.warm_nodes, split.warm_edges, DIMS)


def _all(split: graph.ColdSplit) -> DataFrame:
    return split.warm_nodes.unionByName(split.cold_nodes)


@query
def spectral_map_coords(spark, sf_dir):
    split = _split(spark, sf_dir)
    return long_form(spectral.apply_spectral_map(_model(split), _all(split)), "z", "id")


@query
def spectral_map_eigenvalues(spark, sf_dir):
    model = _model(_split(spark, sf_dir)).to_row(spark)
    return model.select(F.posexplode("eigenvalues").alias("dim", "value"))


def _given_map() -> spectral.SpectralMap:
    """A map by an arithmetic rule, for results that SQL can repeat."""
    p, q = np.arange(EMBEDDING_DIM)[:, None], np.arange(4)[None, :]
    weights = ((p + 1) * (q + 3) % 7 - 3) / 10
    return spectral.SpectralMap((p[:, 0] % 5) / 50, weights, np.full(4, np.nan))


@query
def given_map_coords(spark, sf_dir):
    return long_form(spectral.apply_spectral_map(_given_map(), planted_nodes(spark, sf_dir)), "z", "id")


def _two_features(spark, sf_dir) -> DataFrame:
    """Customers and parts with the first two of their features."""
    return retail_nodes(spark, sf_dir, check=False).withColumn("features", F.slice("features", 1, 2))


@query
def retail_map_eigenvalues(spark, sf_dir):
    edges = materialize(retail_edges(spark, sf_dir), "edges")
    model = spectral.fit_spectral_map(_two_features(spark, sf_dir), edges, 2).to_row(spark)
    return _rounded(model.select(F.posexplode("eigenvalues").alias("dim", "value")), "value")


@query
def retail_regression(spark, sf_dir):
    """Weighted degree in hundreds, regressed on two features; predictions for every node."""
    edges = materialize(retail_edges(spark, sf_dir), "edges")
    nodes = _two_features(spark, sf_dir)
    target = graph.degrees(edges, nodes).select("id", F.array(F.col("weighted_degree") / 100).alias("z"))
    model = spectral.fit_by_regression(nodes, target)
    return long_form(spectral.apply_spectral_map(model, nodes), "z", "id")


def _part_column(spark, sf_dir, *columns: str) -> DataFrame:
    values = F.array(*[F.col(c).cast("double") for c in columns])
    return read(spark, sf_dir, "part").select((F.col("p_partkey") * 2 + 1).alias("id"), values.alias("z"))


@query
def part_similarity(spark, sf_dir):
    """Of two one-dimensional spaces: the absolute correlation."""
    a, b = _part_column(spark, sf_dir, "p_size"), _part_column(spark, sf_dir, "p_retailprice")
    return _rounded(spectral.subspace_similarity(a, b), "cosine")


@query
def part_orthonormality(spark, sf_dir):
    edges = materialize(retail_edges(spark, sf_dir), "edges")
    coords = _part_column(spark, sf_dir, "p_size", "p_retailprice")
    return _rounded(spectral.orthonormality(coords, graph.degrees(edges, coords)), "deviation")


def _long_solution(found: spectral.SpectralSolution, *columns: str) -> DataFrame:
    """``(id, pos, value)`` with the eigenvalue and residual of the dimension."""
    numbers = {"eigenvalue": found.values, "residual": found.residuals}
    of = [F.element_at(F.array(*[F.lit(x) for x in numbers[c]]), F.col("pos") + 1).alias(c) for c in columns]
    return long_form(found.coords, "z", "id").select("*", *of)


@query
def spectral_embedding(spark, sf_dir):
    _, edges = _planted(spark, sf_dir)
    return _long_solution(spectral.spectral_solution(edges, DIMS), "eigenvalue", "residual")


@query
def chain_embedding(spark, sf_dir):
    """A graph whose eigenvectors are known: nations in a chain, each with its customers around it."""
    found = spectral.spectral_solution(materialize(nation_chain(spark, sf_dir), "edges"), 4, tolerance=1e-11)
    return _rounded(_long_solution(found, "eigenvalue").withColumn("value", F.round("value", 5)), "eigenvalue")


@query
def random_features(spark, sf_dir):
    return long_form(spectral.random_features(planted_nodes(spark, sf_dir), 32, 0.5), "features", "id")


@query
def random_feature_map(spark, sf_dir):
    split = _split(spark, sf_dir)
    model = spectral.fit_spectral_map(
        split.warm_nodes, split.warm_edges, DIMS, lift_to=128, gamma=0.5
    )
    return long_form(spectral.apply_spectral_map(model, _all(split)), "z", "id")


@query
def fit_by_regression(spark, sf_dir):
    split = _split(spark, sf_dir)
    coords = materialize(spectral.spectral_embedding(split.warm_edges, DIMS), "coords")
    model = spectral.fit_by_regression(split.warm_nodes, coords)
    return long_form(spectral.apply_spectral_map(model, _all(split)), "z", "id")


@query
def subspace_similarity(spark, sf_dir):
    nodes, edges = _planted(spark, sf_dir)
    coords = materialize(spectral.spectral_embedding(edges, DIMS), "coords")
    mapped = spectral.apply_spectral_map(spectral.fit_spectral_map(nodes, edges, DIMS), nodes)
    return spectral.subspace_similarity(coords, mapped)


@query
def orthonormality(spark, sf_dir):
    nodes, edges = _planted(spark, sf_dir)
    coords = materialize(spectral.spectral_embedding(edges, DIMS), "coords")
    return _rounded(spectral.orthonormality(coords, graph.degrees(edges, nodes)), "deviation")


# --- neighbours ---------------------------------------------------------------


@query
def knn_features(spark, sf_dir):
    nodes = planted_nodes(spark, sf_dir)
    return neighbors.knn(nodes, nodes, K)


@query
def knn_cosine(spark, sf_dir):
    nodes = planted_nodes(spark, sf_dir)
    return neighbors.knn(nodes, nodes, K, "cosine")


@query
def knn_partitioned(spark, sf_dir):
    """The plan for a base too large to broadcast."""
    nodes = planted_nodes(spark, sf_dir)
    return neighbors.knn(nodes, nodes, K, broadcast_bytes=0)


@query
def knn_approx(spark, sf_dir):
    nodes = planted_nodes(spark, sf_dir)
    return neighbors.knn_approx(nodes, nodes, K, probes=8, factor=APPROX_FACTOR)


@query
def knn_all_cells(spark, sf_dir):
    """The approximate search with every cell visited."""
    nodes = planted_nodes(spark, sf_dir)
    return neighbors.knn_approx(nodes, nodes, K, probes=1_000_000)


def _feature_neighbors(split: graph.ColdSplit) -> DataFrame:
    return neighbors.knn(split.cold_nodes, split.warm_nodes, K)


@query
def neighbor_quality(spark, sf_dir):
    split = _split(spark, sf_dir)
    found = neighbors.neighbor_quality(
        _feature_neighbors(split), split.truth_pairs(), split.cold_nodes, split.warm_nodes, K
    )
    return _rounded(found, "precision", "recall")


@query
def compare_spaces(spark, sf_dir):
    split = _split(spark, sf_dir)
    nodes = _all(split)
    full = split.warm_edges.unionByName(split.truth)
    spaces = {
        "features": nodes.select("id", F.col("features").alias("z")),
        "spectral_map": spectral.apply_spectral_map(_model(split), nodes),
        "true_spectral_upper_bound": materialize(
            spectral.spectral_embedding(full, DIMS), "coords"
        ),
    }
    found = neighbors.compare_spaces(
        spaces, split.truth_pairs(), split.cold_nodes, split.warm_nodes, K
    )
    return _rounded(found, "precision", "recall")


@query
def compare_given_spaces(spark, sf_dir):
    split = _split(spark, sf_dir)
    nodes = _all(split)
    spaces = {
        "features": nodes.select("id", F.col("features").alias("z")),
        "given_map": spectral.apply_spectral_map(_given_map(), nodes),
    }
    found = neighbors.compare_spaces(spaces, split.truth_pairs(), split.cold_nodes, split.warm_nodes, K)
    return _rounded(found, "precision", "recall")


@query
def augment_edges(spark, sf_dir):
    split = _split(spark, sf_dir)
    return neighbors.augment_edges(split.warm_edges, _feature_neighbors(split), 0.5)


# --- representations ----------------------------------------------------------


@query
def propagate(spark, sf_dir):
    nodes, edges = _planted(spark, sf_dir)
    return long_form(represent.propagate(edges, nodes, 2), "x", "id")


@query
def propagate_random_walk(spark, sf_dir):
    nodes, edges = _planted(spark, sf_dir)
    return long_form(represent.propagate(edges, nodes, 1, "rw"), "x", "id")


@query
def hop_tokens(spark, sf_dir):
    nodes, edges = _planted(spark, sf_dir)
    hops = represent.hop_tokens(edges, nodes, 2)
    return long_form(hops.select("id", F.posexplode("tokens").alias("hop", "x")), "x", "id", "hop")


@query
def neighbor_sequence(spark, sf_dir):
    split = _split(spark, sf_dir)
    found = represent.neighbor_sequence(_feature_neighbors(split), split.warm_nodes, 5)
    steps = found.select("id", F.posexplode("sequence").alias("step", "x"))
    return long_form(steps, "x", "id", "step")


@query
def scan_sequence(spark, sf_dir):
    split = _split(spark, sf_dir)
    found = represent.neighbor_sequence(_feature_neighbors(split), split.warm_nodes, 5)
    return long_form(represent.scan_sequence(found, EMBEDDING_DIM, 0.5), "state", "id")


@query
def sage_mean(spark, sf_dir):
    split = _split(spark, sf_dir)
    return long_form(represent.sage_mean(split.warm_edges, _all(split), 5), "x", "id")


@query
def feature_baseline(spark, sf_dir):
    return long_form(represent.feature_baseline(planted_nodes(spark, sf_dir)), "x", "id")


@query
def cold_representation(spark, sf_dir):
    split = _split(spark, sf_dir)
    reps = represent.cold_representation(
        _model(split), split.warm_nodes, split.cold_nodes, split.warm_edges, "propagate"
    )
    return long_form(reps, "x", "id")


@query
def cold_representation_sequence(spark, sf_dir):
    split = _split(spark, sf_dir)
    reps = represent.cold_representation(
        _model(split), split.warm_nodes, split.cold_nodes, split.warm_edges, "sequence"
    )
    return long_form(reps, "x", "id")


def _given_representation(spark, sf_dir, method: str) -> DataFrame:
    split = _split(spark, sf_dir)
    reps = represent.cold_representation(
        _given_map(), split.warm_nodes, split.cold_nodes, split.warm_edges, method
    )
    return long_form(reps, "x", "id")


@query
def given_representation(spark, sf_dir):
    return _given_representation(spark, sf_dir, "propagate")


@query
def given_representation_tokens(spark, sf_dir):
    return _given_representation(spark, sf_dir, "tokens")


@query
def given_representation_sequence(spark, sf_dir):
    return _given_representation(spark, sf_dir, "sequence")


# --- classification -----------------------------------------------------------


def _vote_preds(split: graph.ColdSplit, weighting: str = "count") -> DataFrame:
    votes = classify.neighbor_vote(
        _feature_neighbors(split), split.warm_nodes.select("id", "label"), weighting
    )
    return split.cold_nodes.select("id", "label").join(votes, "id", "left")


@query
def neighbor_vote(spark, sf_dir):
    return _vote_preds(_split(spark, sf_dir))


@query
def neighbor_vote_distance(spark, sf_dir):
    return _vote_preds(_split(spark, sf_dir), "distance")


@query
def classification_report(spark, sf_dir):
    """Votes among all nodes, split into those held out (cold) and the others."""
    nodes = planted_nodes(spark, sf_dir)
    votes = classify.neighbor_vote(neighbors.knn(nodes, nodes, K), nodes.select("id", "label"))
    state = F.when(graph.held_out(F.col("id"), SHARE), "cold").otherwise("warm").alias("state")
    preds = nodes.select("id", "label", state).join(votes, "id", "left")
    return classify.classification_report(preds, "state")


@query
def confusion_matrix(spark, sf_dir):
    nodes = planted_nodes(spark, sf_dir)
    votes = classify.neighbor_vote(neighbors.knn(nodes, nodes, K), nodes.select("id", "label"))
    return classify.confusion_matrix(nodes.select("id", "label").join(votes, "id"))


@query
def confusion_cells(spark, sf_dir):
    """The size of each part against that of the next one."""
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("label"))
    following = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("label").alias("pred"))
    return classify.confusion_cells(parts.join(following, "p_partkey", "left"))


@query
def classifier_predict(spark, sf_dir):
    return experiments.spectral_classifier(_split(spark, sf_dir))


@query
def newton_classifier(spark, sf_dir):
    """Whether a part's brand number is odd, from size and price: the weights after three Newton steps."""
    odd = F.pmod(F.substring_index("p_brand", "#", -1).cast("int"), F.lit(2))
    x = F.array(F.col("p_size") / 50, F.col("p_retailprice") / 2000)
    weights = classify.fit_logistic(read(spark, sf_dir, "part").select(x.alias("x"), odd.alias("label")), 3)
    return _rounded(spark.createDataFrame(list(enumerate(weights.tolist())), "term int, weight double"), "weight")


@query
def classifier_mlp(spark, sf_dir):
    split = _split(spark, sf_dir)
    train = split.warm_nodes.select("id", F.col("features").alias("x"), "label")
    test = split.cold_nodes.select("id", F.col("features").alias("x"), "label")
    return classify.predict(classify.fit_classifier(train, "mlp", hidden=16, iterations=50), test)


@query
def cold_classification(spark, sf_dir):
    """Flagship: learn on the warm graph, label nodes without edges from their features."""
    split = _split(spark, sf_dir, 0.1)
    votes = experiments.spectral_vote(split, K, DIMS)
    return split.cold_nodes.select("id", "label").join(votes, "id", "left").select("id", "label", "pred")


# --- clustering ---------------------------------------------------------------


def _mapped(split: graph.ColdSplit) -> tuple[DataFrame, DataFrame]:
    model = _model(split)
    warm = spectral.apply_spectral_map(model, split.warm_nodes)
    return materialize(warm, "warm"), spectral.apply_spectral_map(model, split.cold_nodes)


@query
def cluster_nodes(spark, sf_dir):
    return cluster.cluster(_mapped(_split(spark, sf_dir))[0], 10)


@query
def assign_clusters(spark, sf_dir):
    warm, cold = _mapped(_split(spark, sf_dir))
    return cluster.assign(cluster.fit_clusters(warm, 10), cold)


def _given_centers() -> np.ndarray:
    return 0.3 * np.eye(10, EMBEDDING_DIM)


def _feature_coords(spark, sf_dir) -> DataFrame:
    return planted_nodes(spark, sf_dir).select("id", F.col("features").alias("z"))


@query
def assign_given(spark, sf_dir):
    """Clusters by given centres."""
    return cluster.assign_to(_given_centers(), _feature_coords(spark, sf_dir))


@query
def lloyd_given(spark, sf_dir):
    """One step of k-means from given centres."""
    return long_form(cluster.lloyd_step(_given_centers(), _feature_coords(spark, sf_dir)), "center", "cluster", "n")


@query
def power_iteration_clusters(spark, sf_dir):
    return cluster.power_iteration_clusters(_split(spark, sf_dir).warm_edges, 10)


@query
def clustering_scores(spark, sf_dir):
    """The vote's labels taken as clusters of the cold nodes."""
    split = _split(spark, sf_dir)
    found = _vote_preds(split).select("id", F.col("pred").alias("cluster"))
    return cluster.clustering_scores(found, split.cold_nodes)


@query
def spectral_clustering_scores(spark, sf_dir):
    split = _split(spark, sf_dir)
    warm, cold = _mapped(split)
    found = materialize(cluster.assign(cluster.fit_clusters(warm, 10), cold), "clusters")
    matched = cluster.matched_accuracy(found, split.cold_nodes)
    return cluster.clustering_scores(found, split.cold_nodes).withColumn("matched", F.lit(matched))


@query
def silhouette(spark, sf_dir):
    warm, _ = _mapped(_split(spark, sf_dir))
    value = cluster.silhouette(warm, cluster.cluster(warm, 10))
    return warm.agg(F.count(F.lit(1)).alias("n")).withColumn("silhouette", F.lit(value))


@query
def label_silhouette(spark, sf_dir):
    """The labels taken as clusters of the features."""
    nodes = planted_nodes(spark, sf_dir)
    coords = nodes.select("id", F.col("features").alias("z"))
    value = cluster.silhouette(coords, nodes.select("id", F.col("label").alias("cluster")))
    return _rounded(nodes.agg(F.count(F.lit(1)).alias("n")).withColumn("silhouette", F.lit(value)), "silhouette")


@query
def matched_accuracy(spark, sf_dir):
    """Parts in three groups by size against three by brand: the best of the six matches."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_brand")
    groups = parts.select("id", F.pmod("p_size", F.lit(3)).alias("cluster"))
    brand = F.substring_index("p_brand", "#", -1).cast("int")
    labels = parts.select("id", F.pmod(brand, F.lit(3)).alias("label"))
    value = cluster.matched_accuracy(groups, labels, 3)
    return _rounded(parts.agg(F.count(F.lit(1)).alias("n")).withColumn("matched", F.lit(value)), "matched")


# --- links --------------------------------------------------------------------


def _pairs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, training edges, and held-out edges with as many non-edges."""
    nodes, edges = _planted(spark, sf_dir)
    train, held = links.split_edges(edges, SHARE)
    negatives = links.negative_samples(nodes, edges, held, 2)
    return nodes, train, materialize(links.labelled_pairs(held, negatives), "pairs")


def _scored(spark, sf_dir, how="cosine") -> DataFrame:
    nodes, _, pairs = _pairs(spark, sf_dir)
    return links.score_links(pairs, nodes, how, "features")


@query
def split_edges(spark, sf_dir):
    train, held = links.split_edges(retail_edges(spark, sf_dir), SHARE)
    return train.select("src", "dst", F.lit("train").alias("part")).unionByName(
        held.select("src", "dst", F.lit("held").alias("part"))
    )


@query
def negative_samples(spark, sf_dir):
    nodes, edges = _planted(spark, sf_dir)
    _, held = links.split_edges(edges, SHARE)
    return links.negative_samples(nodes, edges, held, 2)


@query
def exact_negatives(spark, sf_dir):
    nodes, edges = _planted(spark, sf_dir)
    _, held = links.split_edges(edges, SHARE)
    return links.exact_negatives(nodes, edges, held, 2)


@query
def negative_deficits(spark, sf_dir):
    nodes, edges = _planted(spark, sf_dir)
    _, held = links.split_edges(edges, SHARE)
    return links.negative_deficits(nodes, edges, held, 2)


@query
def score_links(spark, sf_dir):
    return _scored(spark, sf_dir, "distance")


@query
def score_links_cosine(spark, sf_dir):
    return _scored(spark, sf_dir, "cosine")


@query
def topology_scores(spark, sf_dir):
    _, train, pairs = _pairs(spark, sf_dir)
    return links.topology_scores(pairs, train)


@query
def link_auc(spark, sf_dir):
    return links.link_auc(_scored(spark, sf_dir))


@query
def link_ap(spark, sf_dir):
    return links.link_ap(_scored(spark, sf_dir))


@query
def hits_at_k(spark, sf_dir):
    return links.hits_at_k(_scored(spark, sf_dir), 3)


@query
def mrr(spark, sf_dir):
    return links.mrr(_scored(spark, sf_dir))


@query
def recommend_links(spark, sf_dir):
    nodes, edges = _planted(spark, sf_dir)
    return links.recommend_links(nodes, nodes, edges, 5, column="features")


@query
def spectral_link_auc(spark, sf_dir):
    """Untrained: cold-warm pairs by cosine in the learned space; negatives pair the same cold ends with warm nodes."""
    split = _split(spark, sf_dir)
    true = split.truth_pairs()
    negatives = links.negative_samples(split.warm_nodes, split.truth.unionByName(split.warm_edges), true, 1)
    coords = spectral.apply_spectral_map(_model(split), _all(split))
    pairs = materialize(links.labelled_pairs(true, negatives), "pairs")
    return links.link_auc(links.score_links(pairs, coords, "cosine"))


@query
def link_model(spark, sf_dir):
    nodes, train, pairs = _pairs(spark, sf_dir)
    scored = links.score_links(pairs, nodes, "cosine", "features")
    inputs = materialize(scored.join(links.topology_scores(pairs, train), ["src", "dst"]), "inputs")
    return links.predict_links(links.fit_link_model(inputs), inputs)


# --- experiments --------------------------------------------------------------


@query
def cold_sweep_features(spark, sf_dir):
    return experiments.cold_sweep(
        *_planted(spark, sf_dir), SHARES, ["features_vote"], "planted"
    )


@query
def cold_sweep_spectral(spark, sf_dir):
    return experiments.cold_sweep(
        *_planted(spark, sf_dir), SHARES, ["spectral_vote"], "planted"
    )


@query
def cold_sweep_classifiers(spark, sf_dir):
    """Features alone, neighbour means and spectral representations over growing cold shares."""
    models = ["feature_classifier", "sage_classifier", "spectral_classifier"]
    return experiments.cold_sweep(*_planted(spark, sf_dir), SHARES, models, "planted")


def _both_datasets(spark, sf_dir, shares) -> DataFrame:
    """Votes by two metrics, on the planted features and on the raw embeddings."""
    nodes, edges = _planted(spark, sf_dir)
    raw = tables.load_nodes(
        read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", EMBEDDING_DIM, check=False
    )
    models = {
        "vote_euclidean": partial(experiments.features_vote, k=K, metric="euclidean"),
        "vote_cosine": partial(experiments.features_vote, k=K, metric="cosine"),
    }
    return experiments.cold_sweep(nodes, edges, shares, models, "planted").unionByName(
        experiments.cold_sweep(raw, edges, shares, models, "raw")
    )


@query
def results_grid(spark, sf_dir):
    return experiments.results_grid(_both_datasets(spark, sf_dir, SHARES), ["planted", "raw"])


@query
def sharpness(spark, sf_dir):
    return experiments.sharpness(_both_datasets(spark, sf_dir, SHARES))


# --- streams ------------------------------------------------------------------


def _event_stream(spark, sf_dir) -> DataFrame:
    rows = read_stream(spark, sf_dir, "events")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _node_stream(spark, sf_dir) -> DataFrame:
    rows = read_stream(spark, sf_dir, "embeddings")
    return tables.load_nodes(rows, "vec_id", "embedding", "label", EMBEDDING_DIM, check=False)


def _arrivals(events: DataFrame) -> DataFrame:
    return events.filter("event_type = 'signup'").select(F.col("user_id").alias("id"), "ts")


def _contacts(events: DataFrame) -> DataFrame:
    return events.filter("event_type IN ('click', 'purchase', 'view')").select(
        F.col("user_id").alias("src"), (-1 - F.col("event_id") % 50).alias("dst"), "ts"
    )


@query
def window_degrees(spark, sf_dir):
    stream = streams.stream_degrees(_contacts(_event_stream(spark, sf_dir)), "1 day", "1 hour")
    found, _ = streams.run_available(stream, "window-degrees")
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query
def cold_rate(spark, sf_dir):
    stream = streams.stream_cold_rate(
        _arrivals(_event_stream(spark, sf_dir)),
        _contacts(_event_stream(spark, sf_dir)),
        "1 day", 6 * 3600, "1 hour",
    )
    found, _ = streams.run_available(stream, "cold-rate")
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query
def stream_warm_up(spark, sf_dir):
    events = _event_stream(spark, sf_dir)
    stream = streams.stream_warm_up(
        _arrivals(events), _contacts(_event_stream(spark, sf_dir)), 3, 12 * 3600, "1 hour"
    )
    found, _ = streams.run_available(stream, "warm-up")
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query
def stream_embed(spark, sf_dir):
    model = _model(_split(spark, sf_dir))
    found, _ = streams.run_available(
        streams.stream_embed(model, _node_stream(spark, sf_dir)), "embedded"
    )
    return long_form(found, "z", "id")


@query
def stream_predict(spark, sf_dir):
    split = _split(spark, sf_dir)
    model = _model(split)
    warm = materialize(spectral.apply_spectral_map(model, split.warm_nodes), "warm")
    path = new_path(spark, "predicted")
    run = streams.stream_predict(
        model,
        _node_stream(spark, sf_dir),
        warm,
        split.warm_nodes.select("id", "label"),
        cluster.fit_clusters(warm, 10),
        path,
        f"{path}-log",
        K,
    )
    run.awaitTermination()
    return spark.read.parquet(f"{path}/predictions").select("id", "pred", "cluster")


def _given_prediction(spark, sf_dir, folder: str) -> DataFrame:
    split = _split(spark, sf_dir)
    warm = materialize(spectral.apply_spectral_map(_given_map(), split.warm_nodes), "warm")
    path = new_path(spark, "predicted")
    labels = split.warm_nodes.select("id", "label")
    centers = cluster.fit_clusters(warm, 10)
    streams.stream_predict(
        _given_map(), _node_stream(spark, sf_dir), warm, labels, centers, path, f"{path}-log", K
    ).awaitTermination()
    return spark.read.parquet(f"{path}/{folder}").drop("batch")


@query
def stream_embed_given(spark, sf_dir):
    stream = streams.stream_embed(_given_map(), _node_stream(spark, sf_dir))
    return long_form(streams.run_available(stream, "embedded")[0], "z", "id")


@query
def stream_predict_given(spark, sf_dir):
    return _given_prediction(spark, sf_dir, "predictions").select("id", "pred")


@query
def stream_links(spark, sf_dir):
    """Links recommended to arriving nodes, batch by batch."""
    return _given_prediction(spark, sf_dir, "neighbors").select("src", "dst", "rank", "dist")
