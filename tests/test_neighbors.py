import numpy as np
import pytest
from pyspark.sql import functions as F

from coldgraph.operators import graph, neighbors
from coldgraph.session import materialize
from tests.conftest import features, rows


def brute(x, queries, k, metric):
    found = []
    for i in queries:
        if metric == "euclidean":
            dist = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        else:
            norms = np.sqrt((x**2).sum(axis=1)) * np.sqrt((x[i] ** 2).sum())
            dist = 1 - np.where(norms > 0, x @ x[i] / np.where(norms > 0, norms, 1), 0)
        dist = np.round(dist, 6)
        order = [j for j in np.lexsort((np.arange(len(x)), dist)) if j != i][:k]
        found += [(i, int(j), r + 1, abs(float(dist[j]))) for r, j in enumerate(order)]
    return sorted(found)


@pytest.fixture(scope="module")
def crowd():
    """A third are copies of one point; ties, zero vectors and clusters besides."""
    rng = np.random.default_rng(0)
    x = np.vstack([rng.integers(0, 4, size=(200, 3)).astype(float), rng.normal(size=(100, 3)) * 3])
    x[:100] = x[0]
    x[105] = x[250] = 0
    return x


@pytest.mark.parametrize("metric", neighbors.METRICS)
def test_both_plans_equal_brute_force(make, crowd, metric):
    base = make.nodes(crowd)
    queries = base.filter("id % 2 = 0")
    want = brute(crowd, range(0, 300, 2), 7, metric)
    one = rows(neighbors.knn(queries, base, 7, metric))
    cells = neighbors.knn(queries, base, 7, metric, broadcast_bytes=0, block_rows=16, hot_rows=20)
    assert [r[:3] for r in one] == [r[:3] for r in want]
    assert [r[3] for r in one] == pytest.approx([r[3] for r in want], abs=1e-6)
    assert rows(cells) == one


def test_cells_prune_in_clustered_data(make):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, 2)) * 100
    x = np.vstack([c + rng.normal(size=(20, 2)) for c in centers])
    base = make.nodes(x)
    assert rows(neighbors.knn(base, base, 3, broadcast_bytes=0)) == rows(neighbors.knn(base, base, 3))


def test_far_apart_values_keep_their_digits(make):
    x = np.array([[1e6, 0.0], [1e6, 1e-3], [1e6, 3e-3], [0.0, 0.0]])
    base = make.nodes(x)
    assert rows(neighbors.knn(base, base, 2)) == brute(x, range(4), 2, "euclidean")


def test_ties_few_bases_and_empty_base(make):
    base = make.nodes([[1, 0], [-1, 0], [0, 1], [0, -1]], ids=[9, 4, 7, 2])
    query = make.nodes([[0, 0]], ids=[100])
    assert rows(neighbors.knn(query, base, 3)) == [(100, 2, 1, 1.0), (100, 4, 2, 1.0), (100, 7, 3, 1.0)]
    assert neighbors.knn(query, base, 10).count() == 4
    assert neighbors.knn(base, base, 10, broadcast_bytes=0).count() == 12
    assert neighbors.knn(query, base.filter("id < 0"), 3).count() == 0
    with pytest.raises(ValueError):
        neighbors.knn(query, base, 3, "manhattan")


def test_approximate_recall_and_exact_limit(planted):
    nodes, _ = planted
    exact = {(r["src"], r["dst"]) for r in neighbors.knn(nodes, nodes, 10).collect()}
    recalls = []
    for probes in (4, 16, 10_000):
        found = {(r["src"], r["dst"]) for r in neighbors.knn_approx(nodes, nodes, 10, probes).collect()}
        recalls.append(len(exact & found) / len(exact))
    assert 0.3 < recalls[0] < recalls[1] and recalls[2] == 1.0


def test_copies_are_ranked_before_the_shuffle(make, crowd):
    plan = neighbors._copies(make.nodes(crowd), "features", 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_neighbor_quality(spark, make):
    found = spark.createDataFrame(
        [(1, 10, 1, 0.1), (1, 11, 2, 0.2), (2, 10, 1, 0.1), (2, 12, 2, 0.3)],
        "src bigint, dst bigint, rank int, dist double")
    truth = spark.createDataFrame([(1, 10), (1, 12), (2, 99)], "src bigint, dst bigint")
    nodes = make.nodes([[0.0]] * 3, ids=[1, 2, 3])
    base = make.nodes([[0.0]] * 3, ids=[10, 11, 12])
    row = neighbors.neighbor_quality(found, truth, nodes, base, 2).first()
    assert tuple(row) == (1, 2, 0.5, 0.5)


def test_augment_and_knn_graph(make, spark):
    found = spark.createDataFrame([(9, 1, 1, 0.0), (9, 2, 2, 0.0)], "src bigint, dst bigint, rank int, dist double")
    assert rows(neighbors.augment_edges(make.edges([(1, 2)]), found, 0.5)) == [
        (1, 2, 1.0), (1, 9, 0.5), (2, 9, 0.5)]
    line = make.nodes([[0.0], [1.0], [3.0]])
    assert rows(neighbors.knn_graph(line, 1)) == [(0, 1, 2.0), (1, 2, 1.0)]


def test_spectral_space_predicts_neighbors_better(planted):
    from coldgraph.operators.spectral import apply_spectral_map, fit_spectral_map, spectral_embedding
    from coldgraph.session import materialize

    nodes, edges = planted
    split = graph.cold_split(nodes, edges, 0.2)
    model = fit_spectral_map(split.warm_nodes, split.warm_edges, 9)
    spaces = {
        "features": nodes.select("id", F.col("features").alias("z")),
        "map": apply_spectral_map(model, nodes),
        "true": materialize(spectral_embedding(edges, 9), "true"),
    }
    table = neighbors.compare_spaces(spaces, split.truth_pairs(), split.cold_nodes, split.warm_nodes, 10)
    got = {r["space"]: r["precision"] for r in table.collect()}
    assert got["features"] < got["map"] < got["true"]


def test_cells_take_string_ids(make, crowd):
    named = make.nodes(crowd).withColumn("id", F.format_string("n%03d", "id"))
    one = rows(neighbors.knn(named, named, 5))
    cells = rows(neighbors.knn(named, named, 5, broadcast_bytes=0, block_rows=16, hot_rows=20))
    assert [r[:3] for r in cells] == [r[:3] for r in one]


def test_approximate_search_never_answers_short(make, crowd):
    base = make.nodes(crowd)
    found = neighbors.knn_approx(base, base, 20, probes=1, cells=60, block_rows=16)
    counts = {r["src"]: r["count"] for r in found.groupBy("src").count().collect()}
    assert counts == dict.fromkeys(range(len(crowd)), 20)


def test_distances_go_in_steps(make, crowd, monkeypatch):
    base = make.nodes(crowd)
    want = rows(neighbors.knn(base, base, 5, broadcast_bytes=0))
    assert [s for s in neighbors._steps(5, 2_000_000)] == [slice(0, 2), slice(2, 4), slice(4, 6)]
    monkeypatch.setattr(neighbors, "STEP_CELLS", 50)
    assert rows(neighbors.knn(base, base, 5, broadcast_bytes=0)) == want


def recall(found, exact):
    found, exact = ({(r["src"], r["dst"]) for r in x.collect()} for x in (found, exact))
    return len(found & exact) / len(exact)


def test_bounded_search_as_registered_reaches_its_recall(planted):
    from coldgraph.plans.catalog import APPROX_FACTOR

    nodes, _ = planted
    exact = neighbors.knn(nodes, nodes, 10)
    assert recall(neighbors.knn_approx(nodes, nodes, 10, probes=8, factor=APPROX_FACTOR), exact) >= 0.9


def test_cells_visited_do_not_grow_with_the_cells(make, monkeypatch):
    """Clustered data: four times the rows in twice the cells, and a query still visits few of them."""
    rng = np.random.default_rng(4)
    seen = {}
    opened = neighbors.CellTree.open_cells

    def count(tree, bounded, factor=1.0):
        cells = opened(tree, bounded, factor)
        seen[tree.filled] = cells.count() / bounded.count()
        return cells

    monkeypatch.setattr(neighbors.CellTree, "open_cells", count)
    for n in (400, 1600):
        x = rng.normal(size=(n // 20, 3))[rng.integers(0, n // 20, n)] * 100 + rng.normal(size=(n, 3)) * 0.1
        base = make.nodes(x)
        assert recall(neighbors.knn_approx(base, base, 5, probes=2, factor=0.7), neighbors.knn(base, base, 5)) >= 0.9
    small, large = sorted(seen)
    assert large > 1.5 * small and seen[large] < 1.5 * seen[small] + 1


@pytest.mark.parametrize("metric", neighbors.METRICS)
def test_cells_below_tops_meet_by_shuffle_when_they_are_many(make, crowd, monkeypatch, metric):
    base = make.nodes(crowd)
    want = rows(neighbors.knn(base, base, 4, metric))
    monkeypatch.setattr(neighbors, "CENTER_BYTES", 1500)
    index = neighbors.NeighborIndex(base, 4, metric, broadcast_bytes=0, block_rows=32, cells=80)
    assert index.tree.filled > 30 and rows(index.nearest(base)) == want


@pytest.mark.parametrize("metric", neighbors.METRICS)
def test_excluded_nodes_are_passed_over(spark, make, crowd, metric):
    """Hubs that exclude nearly all, copies among what is excluded, and queries outside the base."""
    base = make.nodes(crowd).filter("id < 290")
    queries = make.nodes(crowd).filter("id IN (0, 50, 105, 150, 280, 295)")
    barred = [(0, i) for i in range(1, 288)] + [(50, i) for i in range(0, 100, 2)] + [(150, i) for i in range(100, 250)] + [(295, i) for i in range(60)]
    excluded = spark.createDataFrame(barred, "src bigint, dst bigint")
    got = rows(neighbors.FreshIndex(base, metric, block_rows=16, hot_rows=20).nearest(queries, excluded, 6))
    want = []
    for i in (0, 50, 105, 150, 280, 295):
        gone = {j for s, j in barred if s == i}
        near = [r for r in brute(crowd, [i], 300, metric) if r[1] not in gone and r[1] < 290]
        near.sort(key=lambda r: r[2])
        want += [(i, j, n + 1, d) for n, (_, j, _, d) in enumerate(near[:6])]
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in sorted(want)], abs=1e-6)


def test_a_query_travels_to_groups_of_cells_not_to_each(make, spark):
    """Data without clusters, where all cells are open: visits follow the groups, and the answer is exact."""
    x = np.random.default_rng(5).normal(size=(600, 12))
    base = make.nodes(x)
    index = neighbors.NeighborIndex(base, 4, broadcast_bytes=0, block_rows=64, cells=150)
    asked = base.select(F.col("id").alias("qid"), F.col("features").alias("placed"), F.lit(None).cast("double").alias("bound"))
    visits = index.tree.open_cells(asked)
    groups = index.tree.cells.select("grp").distinct().count()
    listed = visits.agg(F.sum(F.size("cells"))).first()[0]
    assert index.tree.filled > 4 * groups and listed == 600 * index.tree.filled
    assert visits.count() == 600 * groups
    assert rows(index.nearest(base)) == rows(neighbors.knn(base, base, 4))


def test_one_partition_of_queries_is_the_work_of_many_tasks(make, monkeypatch):
    rng = np.random.default_rng(5)
    base = make.nodes(rng.normal(size=(400, 3))).coalesce(1)
    want = rows(neighbors.knn(base, base, 5))
    monkeypatch.setattr(neighbors, "TASK_PAIRS", 20_000)
    found = neighbors.knn(base, base, 5)
    assert found.rdd.getNumPartitions() == 8
    assert rows(found) == want


@pytest.mark.parametrize("metric", neighbors.METRICS)
@pytest.mark.parametrize("kind", ["spread", "ties", "far from zero", "huge", "copies", "zeros"])
def test_single_precision_only_chooses(kind, metric):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(9000, 6))
    if kind == "ties":
        x = rng.integers(0, 3, size=x.shape).astype(float)
    elif kind == "copies":
        x[1000:5000] = x[0]
    elif kind == "zeros":
        x[::40] = 0
    x = {"far from zero": x + 1e4, "huge": x * 1e25}.get(kind, x)
    asked = range(0, 9000, 300)
    q, b = neighbors.place(x[::300], metric, "query"), neighbors.place(x, metric, "base")
    at, hit, dist = neighbors.best_in_block(np.arange(0, 9000, 300), q, np.arange(9000), b, 7, metric, True)
    for i, a in enumerate(asked):
        exact = neighbors.finish(((b - q[i]) ** 2).sum(axis=1), metric)
        order = [j for j in np.lexsort((np.arange(9000), exact)) if j != a][:7]
        assert hit[at == i].tolist() == order
        assert dist[at == i].tolist() == exact[order].tolist()


def test_cells_seek_equal_vectors_once(spark, make):
    """Of a base's rows, the index reads a count, a first row and the copies."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    base = make.nodes(np.random.default_rng(7).normal(size=(200, 3)))
    watched = base.mapInArrow(count, base.schema)
    neighbors.NeighborIndex(watched, 3, broadcast_bytes=0, block_rows=16)
    assert seen.value <= 3 * 200


@pytest.mark.parametrize("block_rows", [40, 10_000])
def test_nested_splits_equal_a_search_each(spark, make, crowd, block_rows):
    """Copies, ties, zero vectors, repeated and named ids: the same rows as one search per split and metric."""
    twice = make.nodes(crowd).unionByName(make.nodes(crowd[:40])).unionByName(make.nodes(crowd[200:220] + 0.5, ids=range(200, 220)))
    named = make.nodes(crowd).withColumn("id", F.concat(F.lit("n"), F.col("id").cast("string")))
    for nodes, number in ((twice, F.col("id")), (named, F.substring("id", 2, 9).cast("int"))):
        band = F.when(number % 10 < 2, 0).when(number % 10 < 3, 1).when(number % 10 < 6, 2).when(number % 10 < 9, 3)
        banded = nodes.withColumn("band", band)
        found = neighbors.knn_nested(nodes, band, 6, neighbors.METRICS, block_rows=block_rows)
        assert found.columns == ["step", "metric", "src", "dst", "rank", "dist"]
        found = materialize(found, "t-nested")
        for step in range(3):
            for metric in neighbors.METRICS:
                want = neighbors.knn(banded.where(F.col("band") <= step), banded.where(F.col("band") > step), 6, metric)
                got = found.where((F.col("step") == step) & (F.col("metric") == metric)).select(*want.columns)
                assert rows(got) == rows(want) and got.count() > 300


def test_nested_splits_without_base_or_queries(make, crowd):
    nodes = make.nodes(crowd[:20])
    for band in (F.lit(0), F.lit(2), F.lit(None)):
        assert neighbors.knn_nested(nodes, band, 3, ["cosine"]).count() == 0
    with pytest.raises(ValueError):
        neighbors.knn_nested(nodes, F.lit(0), 3, ["manhattan"])
