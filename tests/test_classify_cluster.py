import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from coldgraph.operators import classify, cluster, graph, spectral
from coldgraph.operators.cluster import _best_match
from coldgraph.session import materialize


def test_vote_ties_weights_and_missing_labels(spark):
    found = spark.createDataFrame(
        [(1, 10, 1, 0.0), (1, 11, 2, 3.0), (1, 12, 3, 3.0), (2, 13, 1, 1.0), (2, 10, 2, 1.0)],
        "src bigint, dst bigint, rank int, dist double")
    labels = spark.createDataFrame([(10, 7), (11, 2), (12, 2), (13, 5), (14, None)], "id bigint, label int")
    for hot_rows in (1, 1_000_000):
        count = classify.neighbor_vote(found, labels, hot_rows=hot_rows).orderBy("id").collect()
        assert [tuple(r) for r in count] == [(1, 2, 2.0), (2, 5, 1.0)]
    by_distance = classify.neighbor_vote(found, labels, "distance").orderBy("id").collect()
    assert [tuple(r) for r in by_distance] == [(1, 7, 1.0), (2, 5, 0.5)]


def test_report_and_confusion(spark):
    preds = spark.createDataFrame(
        [(1, 0, 0, "a"), (2, 0, 1, "a"), (3, 1, 1, "b"), (4, 1, 3, "b"), (5, None, 1, "b"), (6, 2, None, "b")],
        "id bigint, label int, pred int, grp string")
    report = {(r["grp"], r["label"]): r for r in classify.classification_report(preds, "grp").collect()}
    total = report[None, None]
    assert total["support"] == 5 and total["accuracy"] == 0.4
    assert report[None, 1]["precision"] == 0.5 and report[None, 1]["recall"] == 0.5
    assert report[None, 3]["support"] == 0 and report[None, 3]["f1"] == 0.0
    assert report[None, 2]["recall"] == 0.0
    assert total["f1"] == pytest.approx((2 / 3 + 0.5 + 0 + 0) / 4, abs=1e-6)
    assert report["a", None]["accuracy"] == 0.5
    alone = classify.classification_report(preds)
    assert alone.filter("label IS NULL").first()["accuracy"] == 0.4
    matrix = [tuple(r) for r in classify.confusion_matrix(preds).orderBy("label").collect()]
    assert matrix == [(0, 1, 1, 0), (1, 0, 1, 1)]


@pytest.mark.parametrize("algo", ["logistic", "mlp"])
def test_classifier_beats_the_majority(planted, algo):
    nodes, edges = planted
    split = graph.cold_split(nodes, edges, 0.5)
    reps = lambda df: df.selectExpr("id", "features AS x", "label")
    model = classify.fit_classifier(reps(split.warm_nodes), algo, iterations=40)
    preds = classify.predict(model, reps(split.cold_nodes))
    got = preds.agg(classify.accuracy(preds)).first()[0]
    top = split.cold_nodes.groupBy("label").count().agg({"count": "max"}).first()[0]
    assert got > top / split.cold_nodes.count()


def frame(spark, values, name):
    return spark.createDataFrame(list(enumerate(values)), f"id bigint, {name} int")


def scores_by_hand(u, v):
    n = len(u)
    cells = {(a, b): sum(1 for x, y in zip(u, v) if (x, y) == (a, b)) for a in set(u) for b in set(v)}
    cu = {a: u.count(a) for a in set(u)}
    cv = {b: v.count(b) for b in set(v)}
    h = lambda c: -sum(x / n * math.log(x / n) for x in c.values())
    mi = sum(x / n * math.log(x * n / (cu[a] * cv[b])) for (a, b), x in cells.items() if x)
    nmi = mi / ((h(cu) + h(cv)) / 2) if h(cu) + h(cv) else 1.0
    pairs = lambda c: sum(x * (x - 1) / 2 for x in c.values())
    expected = pairs(cu) * pairs(cv) / (n * (n - 1) / 2)
    spread = (pairs(cu) + pairs(cv)) / 2 - expected
    ari = (pairs(cells) - expected) / spread if spread else 1.0
    purity = sum(max(x for (a, _), x in cells.items() if a == c) for c in cu) / n
    return n, purity, nmi, ari


@pytest.mark.parametrize(
    "u, v",
    [([0, 0, 1, 1, 2, 2], [0, 0, 1, 1, 1, 2]), ([0, 0, 0], [1, 1, 1]), ([0, 1, 2, 3], [3, 2, 1, 0]),
     ([0] * 5 + [1] * 5, [0, 1] * 5), ([0, 0, 1], [1, 1, 1])],
)
def test_clustering_scores(spark, u, v):
    got = cluster.clustering_scores(frame(spark, u, "cluster"), frame(spark, v, "label")).first()
    assert tuple(got) == pytest.approx(scores_by_hand(u, v), abs=1e-6)


def test_match_is_the_best_one():
    rng = np.random.default_rng(0)
    for n in (1, 2, 4, 6):
        cost = rng.integers(0, 20, size=(n, n)).astype(float)
        best = min(cost[np.arange(n), list(p)].sum() for p in itertools.permutations(range(n)))
        assert cost[np.arange(n), _best_match(cost)].sum() == best


def test_matched_accuracy(spark):
    found = frame(spark, [5, 5, 5, 7, 7, 9], "cluster")
    assert cluster.matched_accuracy(found, frame(spark, [1, 1, 2, 2, 2, 2], "label")) == pytest.approx(4 / 6)
    assert cluster.matched_accuracy(found.filter("id < 0"), frame(spark, [1], "label")) == 0.0


def test_cold_nodes_are_clustered_without_edges(planted):
    nodes, edges = planted
    split = graph.cold_split(nodes, edges, 0.2)
    model = spectral.fit_spectral_map(split.warm_nodes, split.warm_edges, 9)
    warm = materialize(spectral.apply_spectral_map(model, split.warm_nodes), "warm")
    centers = cluster.fit_clusters(warm, 10)
    cold = cluster.assign(centers, spectral.apply_spectral_map(model, split.cold_nodes))
    assert cold.count() == split.cold_nodes.count()
    got = cluster.clustering_scores(cold, split.cold_nodes).first()
    shuffled = np.random.default_rng(0).permutation([r["label"] for r in split.cold_nodes.collect()])
    assert got["ari"] > 0.05 and cluster.matched_accuracy(cold, split.cold_nodes) > 2 * np.bincount(shuffled).max() / len(shuffled) / 2
    # Nearest centre, by hand.
    z = {r["id"]: np.array(r["z"]) for r in spectral.apply_spectral_map(model, split.cold_nodes).collect()}
    middle = np.array(centers.clusterCenters())
    for r in cold.collect():
        assert ((middle - z[r["id"]]) ** 2).sum(axis=1).argmin() == r["cluster"]
    by_edges = cluster.power_iteration_clusters(split.warm_edges, 10, 5)
    assert by_edges.join(split.cold_nodes, "id").count() == 0


def test_silhouette_by_hand(spark):
    points = [0.0, 1.0, 10.0, 12.0]
    coords = spark.createDataFrame([(i, [p]) for i, p in enumerate(points)], "id bigint, z array<double>")
    groups = frame(spark, [0, 0, 1, 1], "cluster")
    def value(i, own, other):
        a = (points[i] - points[own]) ** 2
        b = sum((points[i] - points[j]) ** 2 for j in other) / len(other)
        return (b - a) / max(a, b)
    want = np.mean([value(0, 1, [2, 3]), value(1, 0, [2, 3]), value(2, 3, [0, 1]), value(3, 2, [0, 1])])
    assert cluster.silhouette(coords, groups) == pytest.approx(want)


def test_lloyd_from_given_centres(spark, make):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(30, 2)), rng.normal(size=(30, 2)) + 8])
    coords = make.nodes(x).select("id", F.col("features").alias("z")).repartition(3)
    centers = np.array([[0.0, 1.0], [7.0, 7.0], [100.0, 100.0]])
    found = {r["id"]: r["cluster"] for r in cluster.assign_to(centers, coords).collect()}
    assert found == {i: int(i >= 30) for i in range(60)}
    step = {r["cluster"]: (r["n"], r["center"]) for r in cluster.lloyd_step(centers, coords).collect()}
    assert step[2] == (0, [100.0, 100.0])  # an empty cluster keeps its centre
    for j, part in enumerate((x[:30], x[30:])):
        assert step[j][0] == 30 and step[j][1] == pytest.approx(part.mean(axis=0))
    assert cluster.lloyd(centers, coords)[:2] == pytest.approx(np.array([x[:30].mean(axis=0), x[30:].mean(axis=0)]))
    tie = make.nodes([[5.0]]).select("id", F.col("features").alias("z"))
    assert cluster.assign_to(np.array([[6.0], [4.0]]), tie).first()["cluster"] == 0
    nothing = cluster.lloyd_step(centers, coords.filter("id < 0")).collect()
    assert sorted((r["cluster"], r["n"]) for r in nothing) == [(0, 0), (1, 0), (2, 0)]


def test_newton_steps_reach_the_maximum_of_the_likelihood(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.5, -0.7] + 0.3)))).astype(int)
    rows = [(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y))] + [(900, [0.0, 0.0], None)]
    reps = spark.createDataFrame(rows, "id bigint, x array<double>, label int").repartition(3)
    w = classify.fit_logistic(reps)
    full = np.column_stack([x, np.ones(400)])
    p = 1 / (1 + np.exp(-full @ w))
    assert np.abs(full.T @ (y - p)).max() < 1e-8
    got = {r["id"]: (r["score"], r["pred"]) for r in classify.predict_logistic(w, reps).collect()}
    assert len(got) == 401 and all(got[i][0] == pytest.approx(p[i]) and got[i][1] == (p[i] >= 0.5) for i in range(400))
    smaller = classify.fit_logistic(reps, ridge=0.1)
    assert np.abs(smaller[:2]).sum() < np.abs(w[:2]).sum()
