"""Physical plans that must hold at scale, with broadcast joins switched off."""

import os
import time

import pytest
from pyspark.sql import functions as F

from coldgraph import session
from coldgraph.functions.propagation import LinkTable
from coldgraph.operators import graph, links, spectral
from coldgraph.session import materialize
from coldgraph.sources.datasets import retail_edges
from tests.conftest import SF


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    # What lies below a cached table was done once and isn't part of the query.
    lines, depth = [], None
    for line in text.splitlines():
        indent = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and indent > depth:
            continue
        depth = indent if "InMemoryRelation" in line else None
        lines.append(line)
    return "\n".join(lines)


def test_a_step_shuffles_only_its_partial_sums(planted):
    nodes, edges = planted
    table = LinkTable(materialize(graph.symmetric(edges), "l"))
    state = nodes.select("id", F.col("features")[0].alias("c0"))
    steps = [state]
    for _ in range(3):
        steps.append(spectral._step(table, steps[-1], 1, 0.1))
    counts = [plan(s).count("Exchange") for s in steps]
    table.release()
    # The start is laid out once; each step adds the exchange of its sums.
    assert counts[1] == 2 and counts[2] == 3 and counts[3] == 4


def test_links_are_cut_by_their_number(planted, spark):
    _, edges = planted
    links = materialize(graph.symmetric(edges), "l")
    rows = links.count()
    table = LinkTable(links, part_rows=500)
    sizes = table._links.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    with table.layout():
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == table.partitions == -(-rows // 500)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    table.release()
    assert sizes.sum() == rows and sizes.max() < 1500


def test_edges_are_read_once_for_both_directions(spark):
    edges = materialize(retail_edges(spark, SF), "e")
    assert plan(graph.symmetric(edges)).count("FileScan") == 1
    assert "Exchange" not in plan(graph.cold_split(edges.withColumnRenamed("src", "id"), edges, 0.2).warm_edges)


def test_scans_read_only_what_is_needed(spark):
    text = plan(retail_edges(spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in text
    assert "partial_sum" in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_top_k_is_cut_before_the_shuffle(spark):
    rows = [(1, i, float(i % 7), i % 2) for i in range(50)]
    scored = spark.createDataFrame(rows, "src bigint, dst bigint, score double, y int")
    assert plan(links.hits_at_k(scored, 3)).count("WindowGroupLimit") == 2


def test_no_operator_falls_back_to_a_cross_join(spark, planted):
    from coldgraph.operators import cluster, neighbors

    nodes, edges = planted
    pairs = materialize(edges.select("src", "dst", F.lit(1).alias("y")), "p")
    frames = [
        spectral.laplacian_entries(edges),
        spectral.spectral_moments(nodes, edges),
        links.link_auc(links.score_links(pairs, nodes, "dot", "features")),
        links.topology_scores(pairs, edges),
        cluster.clustering_scores(nodes.selectExpr("id", "label AS cluster"), nodes),
        neighbors.knn(nodes, nodes, 5, broadcast_bytes=0),
    ]
    for df in frames:
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_a_stored_table_is_pruned_and_joined_without_a_shuffle(spark, tmp_path):
    from coldgraph.sources.tables import load_bucketed, save_bucketed

    edges = spark.range(2000).select(F.pmod("id", F.lit(37)).alias("src"), F.col("id").alias("dst"))
    nodes = spark.range(37).select("id", (F.col("id") * 2).alias("label"))
    paths = [str(tmp_path / name) for name in ("edges", "nodes", "sized")]
    save_bucketed(edges, paths[0], "src", 8)
    save_bucketed(nodes, paths[1], "id", 8)
    save_bucketed(edges, paths[2], "src", files=2)
    some = load_bucketed(spark, paths[0], [5])
    execution = some._jdf.queryExecution()
    assert execution.toRdd().count() == edges.where("src = 5").count()
    # What the scan itself gave out: the rows of one bucket of eight.
    scanned = execution.executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()
    assert 0 < scanned < 800
    joined = load_bucketed(spark, paths[0]).join(load_bucketed(spark, paths[1]).withColumnRenamed("id", "src"), "src")
    assert "Exchange" not in plan(joined) and joined.count() == 2000 and joined.where("label <> 2 * src").isEmpty()
    assert sorted(map(tuple, load_bucketed(spark, paths[2]).collect())) == sorted(map(tuple, edges.collect()))
    with pytest.raises(ValueError, match="missing"):
        save_bucketed(edges, str(tmp_path / "x"), "id")


def test_a_step_moves_no_more_than_its_links_ask_for(spark):
    """The session's number of partitions is no floor: each partition may emit a row for every node."""
    links = spark.range(4000).selectExpr("id % 50 AS src", "id % 40 AS dst", "1.0D AS weight")
    table = LinkTable(links, least=1)
    try:
        assert table.partitions == 1
    finally:
        table.release()


def test_materialized_tables_leave_no_shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f.getName() for f in (all_files.apply(i) for i in range(all_files.size())) if f.getName().startswith("shuffle_")}
    all_files = files.getAllFiles()
    before = shuffles()
    found = session.materialize(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count(), "counted")
    for _ in range(50):
        all_files = files.getAllFiles()
        if shuffles() <= before:
            break
        time.sleep(0.2)
    assert shuffles() <= before and found.count() == 700


def test_embedding_keeps_only_the_tables_of_its_last_round(spark, monkeypatch):
    made = []

    def keep(df, name):
        made.append((name, session.materialize(df, name)))
        return made[-1][1]

    monkeypatch.setattr(spectral, "materialize", keep)
    edges = spark.range(60).selectExpr("id AS src", "(id + 1) % 60 AS dst").selectExpr("least(src, dst) AS src", "greatest(src, dst) AS dst", "1.0D AS weight")
    coords = spectral.spectral_embedding(edges, 2)
    left = [name for name, table in made if name in ("iterate", "block") and os.path.isdir(table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])]
    assert sum(name == "block" for name, _ in made) > 1 and left == ["block"] and coords.count() == 60
