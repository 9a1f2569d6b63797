import numpy as np
import pytest

from pyspark.sql import functions as F

from coldgraph.operators import graph, represent, spectral
from coldgraph.operators.graph import symmetric
from tests.conftest import adjacency, features, rows


def dense_hops(edges, x, hops, norm="sym"):
    a = adjacency(edges, len(x)) + np.eye(len(x))
    d = a.sum(axis=1)
    p = a / np.sqrt(np.outer(d, d)) if norm == "sym" else a / d[:, None]
    out = [x]
    for _ in range(hops):
        out.append(p @ out[-1])
    return out


@pytest.mark.parametrize("norm", ["sym", "rw"])
@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_propagate_equals_matrix_powers(planted, norm, hot_rows):
    nodes, edges = planted
    got = features(represent.propagate(edges, nodes, 2, norm, hot_rows), "x")
    assert got == pytest.approx(dense_hops(edges, features(nodes), 2, norm)[2], abs=1e-9)


def test_hop_tokens_and_isolated_nodes(make):
    x = np.arange(8.0).reshape(4, 2)
    edges = make.edges([(0, 1, 2.0), (1, 2, 1.0), (2, 50, 1.0)])
    nodes = make.nodes(x)
    inside = make.edges([(0, 1, 2.0), (1, 2, 1.0)])
    want = dense_hops(inside, x, 2)
    for r in represent.hop_tokens(edges, nodes, 2).collect():
        for hop in range(3):
            assert r["tokens"][hop] == pytest.approx(want[hop][r["id"]])
    alone = represent.propagate(make.edges([]), nodes, 2)
    assert features(alone, "x") == pytest.approx(x)


def test_sequence_and_scan(spark, make):
    nodes = make.nodes([[1.0, 0.0], [2.0, 0.0], [4.0, 1.0]])
    found = spark.createDataFrame(
        [(9, 0, 1, 0.1), (9, 1, 2, 0.2), (9, 2, 3, 0.3)], "src bigint, dst bigint, rank int, dist double")
    sequence = represent.neighbor_sequence(found, nodes, 2, hot_rows=1)
    assert sequence.first()["sequence"] == [[2.0, 0.0], [1.0, 0.0]]
    assert represent.scan_sequence(sequence, 2, 0.5).first()["state"] == [2.0, 0.0]


def test_sage_samples_a_hub_and_gives_zeros_to_the_cold(make):
    edges = make.edges([(0, i) for i in range(1, 30)])
    nodes = make.nodes([[float(i)] for i in range(31)])
    got = {r["id"]: r["x"] for r in represent.sage_mean(edges, nodes, 4, hot_rows=3).collect()}
    picked = represent.sample_neighbors(edges, 4)
    hub = [r["dst"] for r in picked.filter("src = 0").collect()]
    assert len(hub) == 4 and got[0] == [0.0, sum(hub) / 4]
    assert got[5] == [5.0, 0.0] and got[30] == [30.0, 0.0]
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert rows(represent.sample_neighbors(edges, 4, seed=1)) != rows(picked)


@pytest.mark.parametrize("method", represent.METHODS)
def test_cold_representation_treats_all_nodes_alike(planted, method):
    nodes, edges = planted
    split = graph.cold_split(nodes, edges, 0.2)
    model = spectral.fit_spectral_map(split.warm_nodes, split.warm_edges, 5)
    args = (model, split.warm_nodes, split.cold_nodes, split.warm_edges, method)
    full = represent.cold_representation(*args, k=5)
    assert full.count() == nodes.count() and full.select("id").distinct().count() == nodes.count()
    none = represent.cold_representation(
        model, split.warm_nodes, split.cold_nodes.filter("id < 0"), split.warm_edges, method, k=5)
    if method == "propagate":
        plain = represent.propagate(split.warm_edges, split.warm_nodes, 2)
        assert features(none, "x") == pytest.approx(features(plain, "x"))
    else:
        assert none.count() == split.warm_nodes.count()


def test_neighbour_steps_move_rows_by_the_links_not_by_the_session(spark, make, monkeypatch):
    """Hops, sampled means and moment sums: few partitions whatever the session's number, each of which may emit a row per node; hubs are salted."""
    from coldgraph.functions import propagation

    rng = np.random.default_rng(3)
    pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 30, (200, 2)).tolist() if a != b} | {(0, i) for i in range(1, 30)}
    vectors = rng.normal(size=(30, 40))
    nodes, edges = make.nodes(vectors), make.edges(sorted(pairs))
    dealt = []

    class Seen(propagation.LinkTable):
        def __init__(self, *args, **options):
            super().__init__(*args, **options)
            dealt.append(self.partitions)

    monkeypatch.setattr(propagation, "LinkTable", Seen)
    monkeypatch.setattr(represent, "LinkTable", Seen)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        lifted = adjacency(edges, 30) + np.eye(30)
        scale = lifted.sum(axis=1)
        wanted = lifted / np.sqrt(np.outer(scale, scale)) @ vectors
        assert np.allclose(features(represent.propagate(edges, nodes, 1, hot_rows=5), "x"), wanted)
        means = features(represent.sage_mean(edges, nodes, 40, hot_rows=5), "x")[:, 40:]
        assert np.allclose(means, (lifted - np.eye(30)) @ vectors / (scale - 1)[:, None])
        sums = propagation.neighbor_sums(symmetric(edges), nodes.select("id", F.col("features").alias("x")), 40, 5)
        assert np.allclose(features(sums, "sums"), (lifted - np.eye(30)) @ vectors)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert dealt == [2, 2, 2]
