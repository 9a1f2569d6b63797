import numpy as np
import pytest
from pyspark.sql import functions as F

from coldgraph.functions.solvers import filter_roots, fix_signs, generalized_eigh
from coldgraph.functions.vectors import sum_vectors
from coldgraph.operators import graph, spectral
from coldgraph.sources.tables import load_table, save_table
from tests.conftest import adjacency, features

PATH4 = [(0, 1), (1, 2), (2, 3)]


def dense(entries, n):
    m = np.zeros((n, n))
    for r in entries.collect():
        m[r["i"], r["j"]] += r["value"]
    return m


def test_laplacians_of_a_path(make):
    edges = make.edges(PATH4)
    sym = dense(spectral.laplacian_entries(edges, "sym"), 4)
    assert np.linalg.eigvalsh(sym) == pytest.approx([0, 0.5, 1.5, 2], abs=1e-12)
    plain = dense(spectral.laplacian_entries(edges, "plain"), 4)
    assert np.allclose(plain, np.diag([1, 2, 2, 1]) - adjacency(edges, 4))
    assert np.allclose(dense(spectral.laplacian_entries(edges, "rw"), 4).sum(axis=1), 0)
    salted = dense(spectral.laplacian_entries(edges, "sym", hot_rows=1), 4)
    assert np.allclose(salted, sym)
    with pytest.raises(ValueError):
        spectral.laplacian_entries(edges, "odd")


@pytest.mark.parametrize("d", [3, 16, 21, 40])
def test_sum_vectors_of_any_length(spark, d):
    df = spark.range(50).select(
        (F.col("id") % 3).alias("k"), (F.col("id") * 0.5).alias("w"),
        F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: i * 1.0 + F.col("id")).alias("x"))
    for r in sum_vectors(df, "k", "x", d, "w", "s", n=F.count(F.lit(1))).collect():
        ids = [i for i in range(50) if i % 3 == r["k"]]
        assert r["s"] == pytest.approx([sum(0.5 * i * (p + i) for i in ids) for p in range(d)])
        assert r["n"] == len(ids)


def moments(nodes, edges):
    n, x = nodes.count(), features(nodes)
    a = adjacency(edges, n)
    d = a.sum(axis=1)
    return x.T @ (np.diag(d) - a) @ x, x.T @ (d[:, None] * x), d @ x / d.sum(), d.sum()


def test_moments_and_map_equal_numpy(planted):
    nodes, edges = planted
    laplacian, degree, mean, total = moments(nodes, edges)
    got = {(r["name"], r["p"], r["q"]): r["value"] for r in spectral.spectral_moments(nodes, edges).collect()}
    for p in range(64):
        assert got["mean", p, 0] == pytest.approx(mean[p], abs=1e-9)
        for q in range(64):
            assert got["laplacian", p, q] == pytest.approx(laplacian[p, q], abs=1e-8)
            assert got["degree", p, q] == pytest.approx(degree[p, q], abs=1e-8)
    model = spectral.fit_spectral_map(nodes, edges, 9)
    want = spectral.solve_spectral_map(laplacian, degree, mean, total, 9, 1e-2)
    assert model.eigenvalues == pytest.approx(want.eigenvalues, abs=1e-9)
    assert np.abs(model.weights) == pytest.approx(np.abs(want.weights), abs=1e-6)
    # D-orthonormal up to the ridge, and each eigenvalue is a Rayleigh quotient.
    z = (features(nodes) - mean) @ model.weights
    assert np.all(np.diff(model.eigenvalues) >= -1e-12)
    a = adjacency(edges, len(z))
    gram = z.T @ (a.sum(axis=1)[:, None] * z)
    assert np.abs(gram - np.diag(np.diag(gram))).max() < 0.05 * np.diag(gram).max()


def test_map_is_invariant_to_row_order_partitions_and_salting(planted):
    nodes, edges = planted
    flipped = graph.normalize_edges(
        edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "weight").repartition(7), "a", "b", "weight")
    one = spectral.fit_spectral_map(nodes, edges, 5)
    two = spectral.fit_spectral_map(nodes.repartition(5).orderBy(F.desc("id")), flipped, 5, hot_rows=10)
    assert one.weights == pytest.approx(two.weights, abs=1e-9)


def test_rayleigh_equals_brute_force(planted):
    nodes, edges = planted
    x, n = features(nodes), nodes.count()
    a = adjacency(edges, n)
    d = a.sum(axis=1)
    mu = d @ x / d.sum()
    want = [
        sum(a[i, j] * (x[i, p] - x[j, p]) ** 2 for i in range(n) for j in np.nonzero(a[i])[0] if i < j)
        / (d @ (x[:, p] - mu[p]) ** 2) for p in range(3)]
    coords = nodes.select("id", F.slice("features", 1, 3).alias("z"))
    got = [r["value"] for r in spectral.rayleigh(edges, coords).orderBy("dim").collect()]
    assert got == pytest.approx(want, abs=1e-9)


def test_apply_reads_no_edges(planted):
    nodes, edges = planted
    model = spectral.fit_spectral_map(nodes, edges, 4)
    coords = spectral.apply_spectral_map(model, nodes)
    plan = coords._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert features(coords, "z") == pytest.approx(model.transform(features(nodes)))


def test_model_round_trip(spark, planted, tmp_path):
    nodes, edges = planted
    for lift in (None, 16):
        model = spectral.fit_spectral_map(nodes, edges, 3, lift_to=lift)
        path = str(tmp_path / f"model-{lift}")
        save_table(model.to_row(spark), path)
        again = spectral.SpectralMap.from_row(load_table(spark, path))
        x = features(nodes)
        assert np.array_equal(again.transform(x), model.transform(x))


def test_isolated_warm_nodes_and_no_edges(make):
    nodes = make.nodes([[0.0, 1], [1, 0], [1, 1], [9, 9]])
    model = spectral.fit_spectral_map(nodes, make.edges([(0, 1), (1, 2)]), 1)
    assert spectral.apply_spectral_map(model, nodes).count() == 4
    with pytest.raises(ValueError, match="no edges"):
        spectral.fit_spectral_map(nodes, make.edges([]), 1)
    with pytest.raises(ValueError, match="exceeds"):
        spectral.fit_spectral_map(nodes, make.edges([(0, 1)]), 3)


def test_random_features_approximate_the_kernel(make):
    x = np.random.default_rng(1).normal(size=(12, 3))
    lifted = features(spectral.random_features(make.nodes(x), 6000, 0.3, seed=2))
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(lifted @ lifted.T - want).max() < 0.06


def test_regression_recovers_a_linear_map(spark, make):
    x = np.random.default_rng(3).normal(size=(50, 4))
    z = x @ np.random.default_rng(4).normal(size=(4, 2)) + [3.0, -1.0]
    coords = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(z)], "id bigint, z array<double>")
    model = spectral.fit_by_regression(make.nodes(x), coords, ridge=1e-12)
    assert model.transform(x) == pytest.approx(z, abs=1e-6)


def top_space(a, k):
    d = a.sum(axis=1)
    _, v = np.linalg.eigh(a / np.sqrt(np.outer(d, d)))
    return (v / np.sqrt(d)[:, None])[:, ::-1][:, 1 : k + 1]


def test_embedding_goes_on_to_its_tolerance(make):
    """A path of 13 nodes: eigenvalues cos(pi j / 12), eigenvectors cosines."""
    edges = make.edges([(i, i + 1) for i in range(12)])
    found = spectral.spectral_solution(edges, 3, oversample=2, tolerance=1e-10)
    assert found.values == pytest.approx(np.cos(np.pi * np.arange(1, 4) / 12), abs=1e-9)
    assert len(found.residuals) == 3 and max(found.residuals) <= 1e-10
    waves = np.cos(np.pi * np.outer(np.arange(13), np.arange(1, 4)) / 12) / 12**0.5
    assert np.abs(features(found.coords, "z")) == pytest.approx(np.abs(waves), abs=1e-8)


def test_tight_embedding_locks_and_stays_orthonormal(planted):
    nodes, edges = planted
    found = spectral.spectral_solution(edges, 5, tolerance=1e-8)
    assert max(found.residuals) <= 1e-8
    a = adjacency(edges, 500)
    d = a.sum(axis=1)
    want = np.linalg.eigvalsh(a / np.sqrt(np.outer(d, d)))[::-1][1:6]
    assert found.values == pytest.approx(want, abs=1e-10)
    assert spectral.orthonormality(found.coords, graph.degrees(edges, nodes)).first()[0] < 1e-6


def test_embedding_says_when_it_can_get_no_further(make):
    """All of a star's eigenvalues but two are zero: a narrow block can't hold them, yet each is found."""
    edges = make.edges([(0, i) for i in range(1, 40)])
    found = spectral.spectral_solution(edges, 2, oversample=1)
    assert found.values == pytest.approx([0, 0], abs=1e-3) and max(found.residuals) <= 1e-3


def test_embedding_separates_two_cliques(make):
    clique = [(i, j) for i in range(5) for j in range(i + 1, 5)]
    edges = make.edges(clique + [(i + 5, j + 5) for i, j in clique] + [(4, 5)])
    z = features(spectral.spectral_embedding(edges, 1), "z")[:, 0]
    assert len(set(np.sign(z[:5]))) == 1 and np.sign(z[0]) == -np.sign(z[9])
    want = top_space(adjacency(edges, 10), 1)[:, 0]
    assert np.abs(z / np.linalg.norm(z)) == pytest.approx(np.abs(want / np.linalg.norm(want)), abs=1e-6)


@pytest.mark.parametrize("hot_rows", [20, 1_000_000])
def test_embedding_spans_the_leading_space(spark, planted, hot_rows):
    _, edges = planted
    coords = spectral.spectral_embedding(edges, 6, hot_rows=hot_rows)
    a = adjacency(edges, 500)
    true = spark.createDataFrame(
        [(i, r.tolist()) for i, r in enumerate(top_space(a, 6))], "id bigint, z array<double>")
    cosines = [r["cosine"] for r in spectral.subspace_similarity(coords, true).collect()]
    assert len(cosines) == 6 and min(cosines) > 0.98
    nodes = planted[0]
    assert spectral.orthonormality(coords, graph.degrees(edges, nodes)).first()[0] < 1e-9


def test_subspace_similarity_ignores_rotation_and_scale(spark, make):
    x = np.random.default_rng(5).normal(size=(40, 3))
    turn = np.linalg.qr(np.random.default_rng(6).normal(size=(3, 3)))[0]
    frame = lambda m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id bigint, z array<double>")
    same = spectral.subspace_similarity(frame(x), frame(5 * x @ turn + 2))
    assert [r["cosine"] for r in same.collect()] == pytest.approx([1, 1, 1])


def test_small_solvers():
    b = np.array([[2.0, 0.3], [0.3, 1.0]])
    a = np.array([[1.0, 0.5], [0.5, 3.0]])
    values, vectors = generalized_eigh(a, b)
    assert np.allclose(a @ vectors, b @ vectors * values)
    assert np.allclose(vectors.T @ b @ vectors, np.eye(2))
    assert fix_signs(np.array([[1.0], [-2.0]]))[1, 0] == 2.0
    roots = filter_roots(0.4, 6)
    assert len(roots) == 6 and min(roots) > -1 and max(roots) < 0.4


def test_nested_maps_equal_those_of_each_share(planted):
    nodes, edges = planted
    shares = (0.5, 0.05, 0.2)
    found = spectral.fit_nested_maps(nodes, edges, shares, 4, hot_rows=50)
    assert sorted(found) == sorted(shares)
    for share in shares:
        split = graph.cold_split(nodes, edges, share)
        want = spectral.fit_spectral_map(split.warm_nodes, split.warm_edges, 4)
        assert found[share].eigenvalues == pytest.approx(want.eigenvalues, rel=1e-9)
        assert np.abs(found[share].weights) == pytest.approx(np.abs(want.weights), abs=1e-6)
    with pytest.raises(ValueError, match="share 0.9"):
        spectral.fit_nested_maps(nodes, edges.filter("src = 2"), (0.9,), 2)


def test_links_of_nodes_with_few_of_them_lie_in_more_partitions(spark):
    """A chain moves its links at most, so further partitions cost nothing; a dense graph moves a row per node and partition."""
    from coldgraph.functions.propagation import LinkTable

    chain = spark.range(4000).selectExpr("id AS src", "id + 1 AS dst", "1D AS weight")
    dense = spark.range(100).crossJoin(spark.range(40).withColumnRenamed("id", "t")).selectExpr("id AS src", "(id + t) % 100 AS dst", "1D AS weight")
    assert LinkTable(chain, part_rows=2400, least=1, kept=False, nodes=4000).partitions == 40
    assert LinkTable(dense, part_rows=2400, least=1, kept=False, nodes=100).partitions == 2
