import pytest
from pyspark.sql import functions as F

from coldgraph.functions.hashing import split_bucket
from coldgraph.functions.skew import attach, hot_ends, hot_keys
from coldgraph.operators import graph
from coldgraph.sources import tables
from coldgraph.sources.datasets import retail_edges, retail_nodes
from tests.conftest import SF, rows


def test_load_nodes_rejects_bad_rows_and_reports_them(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 2.0], 3), (2, [1.0], 1), (3, None, 1), (None, [1.0, 1.0], 1),
         (4, [1.0, float("nan")], 1), (5, [0.0, None], 1), (6, [5.0, 6.0], None)],
        "k bigint, v array<double>, y int",
    )
    assert rows(tables.load_nodes(df, "k", "v", "y"), "id", "features") == [
        (1, [1.0, 2.0]), (6, [5.0, 6.0])]
    report = tables.node_report(df, "k", "v", "y").first().asDict()
    assert report == {"rows": 7, "rejected": 5, "unlabelled": 1, "duplicate_ids": 0, "dim": 2}


def test_load_nodes_duplicate_id_and_missing_column(spark):
    df = spark.createDataFrame([(1, [1.0]), (1, [2.0])], "k bigint, v array<double>")
    with pytest.raises(ValueError, match="duplicate"):
        tables.load_nodes(df, "k", "v")
    with pytest.raises(ValueError, match="missing"):
        tables.load_nodes(df, "nope", "v")


def test_normalize_edges_dirty(spark):
    df = spark.createDataFrame(
        [(1, 1, 5.0), (2, 1, 1.0), (1, 2, 2.0), (None, 3, 1.0), (3, None, 1.0),
         (4, 5, 1.0), (5, 4, -1.0), (6, 7, -2.0), (8, 9, 0.5)],
        "a bigint, b bigint, w double",
    )
    assert rows(graph.normalize_edges(df, "a", "b", "w")) == [(1, 2, 3.0), (8, 9, 0.5)]
    assert rows(graph.normalize_edges(df, "a", "b")) == [
        (1, 2, 2.0), (4, 5, 2.0), (6, 7, 1.0), (8, 9, 1.0)]


def test_degrees_and_cold(make):
    edges = make.edges([(0, 1, 2.0), (1, 2, 3.0)])
    nodes = make.nodes([[0.0]] * 5)
    assert rows(graph.symmetric(edges)) == [(0, 1, 2.0), (1, 0, 2.0), (1, 2, 3.0), (2, 1, 3.0)]
    assert rows(graph.degrees(edges, nodes)) == [
        (0, 1, 2.0), (1, 2, 5.0), (2, 1, 3.0), (3, 0, 0.0), (4, 0, 0.0)]
    assert rows(graph.detect_cold(nodes, edges), "id") == [(3,), (4,)]
    empty = make.edges([])
    assert graph.detect_cold(nodes, empty).count() == 5
    assert graph.degrees(empty, nodes).agg(F.sum("degree")).first()[0] == 0


def test_cold_split_is_nested_and_leaks_nothing(planted):
    nodes, edges = planted
    former = set()
    for share in (0.05, 0.2, 0.5):
        split = graph.cold_split(nodes, edges, share)
        cold = {r["id"] for r in split.cold_nodes.collect()}
        assert former < cold
        former = cold
        assert all(r["src"] not in cold and r["dst"] not in cold for r in split.warm_edges.collect())
        assert split.warm_edges.count() + split.truth.count() == edges.count()
        assert all(r["src"] in cold and r["dst"] not in cold for r in split.truth_pairs().collect())
    assert graph.cold_split(nodes, edges, 0.0).cold_nodes.count() == 0
    assert graph.cold_split(nodes, edges, 1.0).warm_edges.count() == 0


def test_cold_split_string_ids(spark):
    nodes = spark.createDataFrame([(f"n{i}", [1.0], None) for i in range(200)],
                                  "id string, features array<double>, label int")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1.0) for i in range(199)],
                                  "src string, dst string, weight double")
    split = graph.cold_split(nodes, edges, 0.3)
    cold = {r["id"] for r in split.cold_nodes.collect()}
    assert 30 < len(cold) < 90
    assert all(r["src"] not in cold and r["dst"] not in cold for r in split.warm_edges.collect())


def test_induced_subgraph_salted_or_not(spark, make):
    edges = make.edges([(0, i) for i in range(1, 40)] + [(3, 4), (5, 9)])
    ids = spark.range(0, 10)
    want = [(0, i, 1.0) for i in range(1, 10)] + [(3, 4, 1.0), (5, 9, 1.0)]
    assert rows(graph.induced_subgraph(edges, ids)) == want
    assert rows(graph.induced_subgraph(edges, ids, hot_rows=5)) == want


def test_attach_salts_hot_keys_only(spark):
    left = spark.range(1000).select(
        F.when(F.col("id") < 400, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(1200).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    hot = hot_keys(left, "k", 50)
    assert [(r["key"], r["copies"]) for r in hot] == [(7, 8)]
    plain = rows(left.join(right, "k"), "k", "v", "w")
    assert rows(attach(left, right, "k", ["v"], hot_rows=50), "k", "v", "w") == plain
    kept = attach(left, right.filter("k <> 7"), "k", ["v"], "left", hot_rows=50)
    assert kept.count() == 1000 and kept.filter("w IS NULL").count() == 400


def test_hot_ends_in_one_pass(make):
    edges = make.edges([(0, i) for i in range(1, 30)] + [(i, 50) for i in range(1, 21)])
    hot = hot_ends(edges, hot_rows=10)
    assert [(r["key"], r["copies"]) for r in hot["src"]] == [(0, 3)]
    assert [(r["key"], r["copies"]) for r in hot["dst"]] == [(50, 2)]


@pytest.fixture(scope="module")
def occurrences(spark):
    """A third of all rows in one context."""
    rows_ = [(e, 0) for e in range(40)] + [(e % 40, 1 + e // 3) for e in range(80)] + [(1, 1), (1, 1)]
    return graph.incidence(spark.createDataFrame(rows_, "e bigint, c bigint"), "e", "c")


def _brute(occurrences):
    found = {(r["entity"], r["context"]) for r in occurrences.collect()}
    weights = {}
    for a, c in found:
        for b, d in found:
            if c == d and a != b:
                weights[a, b] = weights.get((a, b), 0) + 1
    return weights


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_cooccurrence_equals_the_pair_list(spark, make, occurrences, hot_rows):
    weights = _brute(occurrences)
    degree = {r["id"]: r["weighted_degree"] for r in graph.cooccurrence_degrees(occurrences, hot_rows).collect()}
    for e in range(40):
        assert degree[e] == sum(w for (a, _), w in weights.items() if a == e)
    nodes = make.nodes([[i, i * i % 7, 1.0] for i in range(40)])
    for r in graph.cooccurrence_sums(occurrences, nodes, 3, hot_rows).collect():
        for p in range(3):
            want = sum(w * [b, b * b % 7, 1.0][p] for (a, b), w in weights.items() if a == r["id"])
            assert r["sums"][p] == pytest.approx(want, abs=1e-9)
        assert r["degree"] == degree[r["id"]]
    pairs = spark.createDataFrame([(a, b) for a in range(10) for b in range(a + 1, 40)], "src bigint, dst bigint")
    for r in graph.cooccurrence_weights(pairs, occurrences, hot_rows).collect():
        assert r["weight"] == weights.get((r["src"], r["dst"]), 0)


def test_save_and_load_edges_by_bucket(spark, tmp_path):
    edges = retail_edges(spark, SF)
    tables.save_edges(edges, str(tmp_path / "edges"), buckets=4, files=2)
    assert rows(tables.load_edges(spark, str(tmp_path / "edges"))) == rows(edges)
    assert len(list((tmp_path / "edges").glob("bucket=*"))) == 4


def test_retail_nodes_cover_all_ends(spark):
    ends = graph.end_points(retail_edges(spark, SF))
    assert ends.join(retail_nodes(spark, SF), "id", "left_anti").count() == 0


def test_intermediate_tables_can_be_dropped(spark, make):
    from pathlib import Path

    from coldgraph import session

    kept = session.checkpoint_root(spark)
    folder = Path(f"{kept}/coldgraph-{spark.sparkContext.applicationId}")
    table = session.materialize(make.edges([(0, 1)]), "probe")
    assert rows(table) == [(0, 1, 1.0)] and list(folder.glob("probe-*"))
    before = session._application_folder
    session._application_folder = lambda s: f"{kept}/other-application"
    try:
        session.materialize(make.edges([(0, 1)]), "probe")
        session.drop_tables(spark)
        assert not Path(f"{kept}/other-application").exists() and list(folder.glob("probe-*"))
    finally:
        session._application_folder = before


def test_splits_take_large_ids(spark, make):
    big = 1 << 62
    nodes = make.nodes([[0.0]] * 4, ids=[big, big + 1, -big, 7])
    edges = make.edges([(-big, big), (7, big + 1)])
    split = graph.cold_split(nodes, edges, 0.5)
    assert split.warm_nodes.count() + split.cold_nodes.count() == 4
    bucket = {r[0]: r[1] for r in nodes.select("id", split_bucket(F.col("id"))).collect()}
    assert bucket == {i: i * 7919 % 1000 for i in bucket}


def test_hot_ends_are_ranked_by_end(make):
    edges = make.edges([(1, i) for i in range(10, 40)] * 3 + [(2, i) for i in range(10, 40)] * 2)
    hot = hot_ends(edges, hot_rows=2)
    assert {r["key"] for r in hot["src"]} == {1, 2} and {r["key"] for r in hot["dst"]} == set(range(10, 40))


@pytest.mark.parametrize("small_context", [1, 4, 32])
def test_cooccurrence_weights_of_small_and_large_contexts_together(spark, occurrences, small_context):
    weights = _brute(occurrences)
    sizes = {}
    for e, c in {tuple(r) for r in occurrences.select("entity", "context").collect()}:
        sizes[e] = sizes.get(e, 0) + 1
    asked = [(3, 5), (5, 3), (5, 3), (7, 7), (2, 900), (900, 900), (None, 4), (12, 30), (30, 11)]
    pairs = spark.createDataFrame(asked, "src bigint, dst bigint")
    twice = occurrences.unionByName(occurrences.limit(20))  # a repeated occurrence is one
    got = rows(graph.cooccurrence_weights(pairs.filter("src IS NOT NULL"), twice, small_context=small_context))
    want = {(a, b): float(sizes.get(a, 0) if a == b else weights.get((a, b), 0)) for a, b in asked if a is not None}
    assert got == sorted((a, b, w) for (a, b), w in want.items())
    unknown = graph.cooccurrence_weights(pairs.filter("src IS NULL"), twice, small_context=small_context).collect()
    assert [tuple(r) for r in unknown] == [(None, 4, 0.0)]


def test_cooccurrence_weights_list_no_neighbours_where_contexts_are_small(spark, monkeypatch):
    """A pair of entities with many small contexts each costs no row per context of an end."""
    def listed(*args, **options):
        raise AssertionError("neighbour lists of small contexts")

    monkeypatch.setattr(graph, "shared_neighbors", listed)
    occurrences = spark.createDataFrame([(e, c) for c in range(200) for e in (1, 2, 10 + c)], "entity bigint, context bigint")
    pairs = spark.createDataFrame([(1, 2), (1, 11), (11, 12)], "src bigint, dst bigint")
    assert rows(graph.cooccurrence_weights(pairs, occurrences)) == [(1, 2, 200.0), (1, 11, 1.0), (11, 12, 0.0)]
