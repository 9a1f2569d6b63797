"""Cold-share experiments and their result tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coldgraph.functions.hashing import is_integer
from coldgraph.functions.vectors import rounded
from coldgraph.operators.classify import accuracy, fit_classifier, neighbor_vote, predict
from coldgraph.operators.graph import ColdSplit, cold_split, held_out
from coldgraph.operators.neighbors import knn, knn_nested
from coldgraph.operators.represent import cold_representation, feature_baseline, sage_mean
from coldgraph.operators.spectral import SpectralMap, apply_spectral_map, fit_nested_maps, fit_spectral_map
from coldgraph.session import materialize

RESULT_COLUMNS = ("dataset", "task", "model", "cold_share", "metric", "value")


def _with_truth(guesses: DataFrame, cold: DataFrame) -> DataFrame:
    """``preds`` of all cold nodes; a node without a guess has a null one."""
    return cold.select("id", "label").join(guesses.select("id", "pred"), "id", "left")


def features_vote(
    split: ColdSplit, k: int = 10, metric: str = "euclidean", shared: dict | None = None, **_
) -> DataFrame:
    """Labels of the nearest warm nodes in feature space; ``shared`` may hold these, as ``near(metric, src, dst, rank, dist)``."""
    if shared and "near" in shared:
        found = shared["near"].where((F.col("metric") == metric) & (F.col("rank") <= k)).drop("metric")
    else:
        found = knn(split.cold_nodes, split.warm_nodes, k, metric)
    return neighbor_vote(found, split.warm_nodes.select("id", "label"))


def _map(split: ColdSplit, dims: int, ridge: float, shared: dict | None) -> SpectralMap:
    """The split's spectral map; models that pass one ``shared`` dict fit it once."""
    if shared is None:
        shared = {}
    if (dims, ridge) not in shared:
        shared[dims, ridge] = fit_spectral_map(split.warm_nodes, split.warm_edges, dims, ridge)
    return shared[dims, ridge]


def spectral_vote(
    split: ColdSplit, k: int = 10, dims: int = 9, ridge: float = 1e-2, shared: dict | None = None, **_
) -> DataFrame:
    """Labels of the nearest warm nodes in the learned spectral space."""
    model = _map(split, dims, ridge, shared)
    warm = apply_spectral_map(model, split.warm_nodes)
    cold = apply_spectral_map(model, split.cold_nodes)
    return neighbor_vote(knn(cold, warm, k, column="z"), split.warm_nodes.select("id", "label"))


def _trained(reps: DataFrame, split: ColdSplit) -> DataFrame:
    reps = materialize(reps.select("id", "x"), "reps")
    train = reps.join(split.warm_nodes.select("id", "label"), "id")
    test = reps.join(split.cold_nodes.select("id", "label"), "id")
    return predict(fit_classifier(train), test)


def feature_classifier(split: ColdSplit, **_) -> DataFrame:
    """Classifier on own features; adjacency is ignored."""
    return _trained(feature_baseline(split.warm_nodes.unionByName(split.cold_nodes)), split)


def sage_classifier(split: ColdSplit, fanout: int = 10, **_) -> DataFrame:
    """Classifier on own features and neighbour means; cold nodes have no neighbours."""
    nodes = split.warm_nodes.unionByName(split.cold_nodes)
    return _trained(sage_mean(split.warm_edges, nodes, fanout), split)


def spectral_classifier(
    split: ColdSplit, k: int = 10, dims: int = 9, ridge: float = 1e-2, method: str = "tokens",
    shared: dict | None = None, **_,
) -> DataFrame:
    """Classifier on graph representations, cold nodes through predicted neighbours."""
    model = _map(split, dims, ridge, shared)
    reps = cold_representation(
        model, split.warm_nodes, split.cold_nodes, split.warm_edges, method, k
    )
    return _trained(reps, split)


MODELS: dict[str, Callable[..., DataFrame]] = {
    "features_vote": features_vote,
    "spectral_vote": spectral_vote,
    "feature_classifier": feature_classifier,
    "sage_classifier": sage_classifier,
    "spectral_classifier": spectral_classifier,
}


MAPPED = {spectral_vote, spectral_classifier}


def _model(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The function behind a model, which may be given with some of its options."""
    return run.func if isinstance(run, partial) else run


def _nested_neighbors(
    nodes: DataFrame, steps: list[float], models: Iterable[Callable[..., DataFrame]], options: dict
) -> DataFrame | None:
    """Neighbours of the cold nodes of all shares by features, for the models that vote by these; None if there are none."""
    votes = [{**getattr(run, "keywords", {}), **options} for run in models if _model(run) is features_vote]
    if not votes:
        return None
    integer = is_integer(nodes, "id")
    cold = [held_out(F.col("id"), share, integer) for share in steps]
    # Hold-out sets are nested: a node is warm at the smallest shares, its band of them.
    band = sum((F.when(c, 0).when(~c, 1) for c in cold), F.lit(0))
    metrics = sorted({v.get("metric", "euclidean") for v in votes})
    return materialize(knn_nested(nodes, band, max(v.get("k", 10) for v in votes), metrics), "nested")


def cold_sweep(
    nodes: DataFrame,
    edges: DataFrame,
    shares: Iterable[float],
    models: Iterable[str] | dict[str, Callable[..., DataFrame]] = tuple(MODELS),
    dataset: str = "graph",
    **options,
) -> DataFrame:
    """``results``: accuracy on cold rows of every model at every share.

    All models see the same nested splits; training, scaling and degrees use warm rows. The spectral maps of all shares come
    from one pass over the edges, the neighbours by features of all shares and metrics from one pass over the pairs of nodes.
    A model may be a ``partial`` of one of ``MODELS``.
    """
    shares = list(shares)
    chosen = models if isinstance(models, dict) else {name: MODELS[name] for name in models}
    nodes, edges = materialize(nodes, "sweep-nodes"), materialize(edges, "sweep-edges")
    result = None
    dims, ridge = options.get("dims", 9), options.get("ridge", 1e-2)
    known = {_model(run) for run in chosen.values()}
    maps = fit_nested_maps(nodes, edges, shares, dims, ridge) if MAPPED & known else {}
    steps = sorted(set(shares))
    near = _nested_neighbors(nodes, steps, chosen.values(), options) if steps else None
    for share in shares:
        split = cold_split(nodes, edges, share)
        shared = {(dims, ridge): maps[share]} if maps else {}
        if near is not None:
            shared["near"] = near.where(F.col("step") == steps.index(share)).drop("step")
        for name, run in chosen.items():
            own = {"shared": shared} if _model(run) in MODELS.values() else {}
            preds = _with_truth(run(split, **options, **own), split.cold_nodes).filter("label IS NOT NULL")
            row = preds.agg(rounded(accuracy(preds)).alias("value")).select(
                F.lit(dataset).alias("dataset"),
                F.lit("classification").alias("task"),
                F.lit(name).alias("model"),
                F.lit(float(share)).alias("cold_share"),
                F.lit("accuracy").alias("metric"),
                "value",
            )
            result = row if result is None else result.unionByName(row)
    if result is None:
        raise ValueError("no shares or no models")
    return result


def results_grid(results: DataFrame, datasets: list[str]) -> DataFrame:
    """``(task, metric, cold_share, model, <dataset>, <dataset>_best, ...)``.

    ``best`` flags the highest value of each column within (task, metric, share).
    """
    keys = ["task", "metric", "cold_share", "model"]
    grid = results.groupBy(*keys).pivot("dataset", datasets).agg(F.max("value"))
    for name in datasets:
        order = Window.partitionBy("task", "metric", "cold_share").orderBy(F.col(f"`{name}`").desc_nulls_last())
        grid = grid.withColumn(
            f"{name}_best", (F.rank().over(order) == 1) & F.col(f"`{name}`").isNotNull()
        )
    return grid


def sharpness(results: DataFrame) -> DataFrame:
    """``(dataset, task, model, metric, drop)``: value at the smallest share minus at the largest."""
    return results.groupBy("dataset", "task", "model", "metric").agg(
        rounded(F.min_by("value", "cold_share") - F.max_by("value", "cold_share")).alias("drop")
    )
