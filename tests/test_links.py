import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from coldgraph.operators import graph, links, spectral
from coldgraph.session import materialize
from tests.conftest import rows


def scored(spark, values):
    return spark.createDataFrame([(i, 100 + i, float(s), y) for i, (s, y) in enumerate(values)],
                                 "src bigint, dst bigint, score double, y int")


def auc_by_hand(values):
    pos = [s for s, y in values if y]
    neg = [s for s, y in values if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def ap_by_hand(values):
    total, tp, seen, result = sum(y for _, y in values), 0, 0, 0.0
    for s in sorted({s for s, _ in values}, reverse=True):
        group = [y for t, y in values if t == s]
        tp, seen = tp + sum(group), seen + len(group)
        result += sum(group) / total * tp / seen
    return result


@pytest.mark.parametrize("steps", [2, 7, 256])
def test_auc_and_ap_with_ties_in_any_number_of_steps(spark, steps):
    rng = np.random.default_rng(0)
    values = [(round(float(s), 1), int(y)) for s, y in zip(rng.normal(size=300), rng.integers(0, 2, 300))]
    values += [(0.0, 0)] * 150
    df = scored(spark, values)
    auc, ap = links.link_auc(df, steps).first(), links.link_ap(df, steps).first()
    assert (auc["positives"], auc["negatives"]) == (sum(y for _, y in values), sum(1 - y for _, y in values))
    assert auc["auc"] == pytest.approx(auc_by_hand(values), abs=1e-6)
    assert ap["ap"] == pytest.approx(ap_by_hand(values), abs=1e-6)


def test_auc_all_tied_and_one_class(spark):
    assert links.link_auc(scored(spark, [(1.0, 1), (1.0, 0), (1.0, 0)])).first()["auc"] == 0.5
    row = links.link_auc(scored(spark, [(1.0, 1)])).first()
    assert tuple(row) == (1, 0, None)
    assert tuple(links.link_ap(scored(spark, [(1.0, 0)])).first()) == (0, 1, None)


def test_hits_and_mrr(spark):
    df = spark.createDataFrame(
        [(1, 5, 0.9, 0), (1, 6, 0.9, 1), (1, 7, 0.1, 1), (2, 5, 0.3, 1), (3, 5, 0.8, 0), (4, 1, 0.5, 1), (4, 2, 0.5, 1), (4, 3, 0.5, 0)],
        "src bigint, dst bigint, score double, y int")
    assert tuple(links.hits_at_k(df, 2).first()) == (3, pytest.approx((0.5 + 1 + 1) / 3, abs=1e-6))
    for hot_rows in (1, 1_000_000):
        assert tuple(links.mrr(df, hot_rows).first()) == (4, pytest.approx((0.5 + 1 + 0 + 1) / 4, abs=1e-6))


@pytest.mark.parametrize("hot_rows", [4, 1_000_000])
def test_topology_scores_by_hand(spark, make, hot_rows):
    pairs_ = [(0, i) for i in range(1, 12)] + [(1, 2), (2, 3), (1, 3), (4, 5)]
    edges = make.edges(pairs_)
    near = {}
    for a, b in pairs_:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    asked = [(0, 1), (0, 4), (1, 2), (4, 5), (6, 7), (1, 99), (98, 99)]
    got = links.topology_scores(spark.createDataFrame(asked, "src bigint, dst bigint"), edges, hot_rows)
    for r in got.collect():
        a, b = near.get(r["src"], set()), near.get(r["dst"], set())
        both = a & b
        assert r["common"] == len(both)
        assert r["jaccard"] == pytest.approx(len(both) / len(a | b) if a | b else 0, abs=1e-6)
        assert r["adamic_adar"] == pytest.approx(sum(1 / math.log(len(near[c])) for c in both), abs=1e-6)
        assert r["preferential"] == len(a) * len(b)
    assert got.count() == len(asked)


def test_negatives_are_no_edges(spark, planted, monkeypatch):
    nodes, edges = planted
    train, held = links.split_edges(edges, 0.2)
    assert train.count() + held.count() == edges.count()
    one = links.negative_samples(nodes, edges, held, 3)
    assert one.join(edges, ["src", "dst"]).count() == 0
    assert one.filter("src >= dst").count() == 0 and one.distinct().count() == one.count()
    assert one.count() > 2 * held.count()
    assert rows(one) == rows(links.negative_samples(nodes.repartition(5), edges, held.repartition(3), 3))
    assert rows(one) != rows(links.negative_samples(nodes, edges, held, 3, seed=1))
    # Many buckets: partners still come from everywhere.
    monkeypatch.setattr(links, "BUCKET_NODES", 16)
    many = links.negative_samples(nodes, edges, held, 3)
    assert many.join(edges, ["src", "dst"]).count() == 0
    ends = {r["id"] for r in graph.end_points(many).collect()}
    assert len(ends) > 450


def test_exact_negatives_fill_every_quota(spark, planted, monkeypatch):
    nodes, edges = planted
    _, held = links.split_edges(edges, 0.2)
    near = {}
    for r in edges.collect():
        near.setdefault(r.src, set()).add(r.dst)
        near.setdefault(r.dst, set()).add(r.src)
    asked = Counter(r.src for r in held.collect())

    def check(found, per_pos, ids, asked):
        got = {}
        for r in found.collect():
            assert r.dst != r.src and r.dst in ids and r.dst not in near.get(r.src, ())
            assert r.dst not in got.setdefault(r.src, set())
            got[r.src].add(r.dst)
        for src, positives in asked.items():
            free = len(ids - near.get(src, set()) - {src})
            assert len(got.get(src, ())) == min(positives * per_pos, free)
        assert set(got) <= set(asked)

    ids = {r.id for r in nodes.collect()}
    three = links.exact_negatives(nodes, edges, held, 3)
    check(three, 3, ids, asked)
    assert rows(three) == rows(links.exact_negatives(nodes.repartition(5), edges, held.repartition(3), 3))
    assert rows(three) != rows(links.exact_negatives(nodes, edges, held, 3, seed=1))
    assert links.negative_deficits(nodes, edges, held, 3).where("deficit > 0").count() == 0
    monkeypatch.setattr(links, "WALK", 3)
    monkeypatch.setattr(links, "BUCKET_NODES", 16)
    check(links.exact_negatives(nodes, edges, held, 3), 3, ids, asked)
    # More than there are: a hub linked to all but two nodes, repeated positives, a source that is no node.
    small = spark.range(12)
    hub = spark.createDataFrame([(0, i, 1.0) for i in range(1, 10)], "src long, dst long, weight double")
    near = {0: set(range(1, 10)), **{i: {0} for i in range(1, 10)}}
    positives = hub.select("src", "dst").unionByName(spark.createDataFrame([(3, 0), (3, 0), (99, 0)], "src long, dst long"))
    check(links.exact_negatives(small, hub, positives, 2), 2, set(range(12)), Counter(r.src for r in positives.collect()))
    lacking = {r.src: tuple(r)[1:] for r in links.negative_deficits(small, hub, positives, 2).collect()}
    assert lacking == {0: (18, 2, 16), 3: (4, 10, 0), 99: (2, 12, 0)}
    assert links.exact_negatives(small.limit(0), hub, positives).count() == 0
    assert links.exact_negatives(small, hub, positives.limit(0)).count() == 0


def test_scores(spark, make):
    nodes = make.nodes([[3.0, 4.0], [0.0, 0.0], [4.0, 3.0]])
    pairs = spark.createDataFrame([(0, 1, 1), (0, 2, 0)], "src bigint, dst bigint, y int")
    value = lambda how, hot=1_000_000: rows(links.score_links(pairs, nodes, how, "features", hot), "dst", "score")
    assert value("distance") == [(1, -5.0), (2, pytest.approx(-math.sqrt(2), abs=1e-6))]
    assert value("cosine") == [(1, 0.0), (2, 0.96)]
    assert value("dot") == value("dot", 1) == [(1, 0.0), (2, 24.0)]


def test_untrained_scores_work_on_cold_pairs_where_topology_is_blind(planted):
    nodes, edges = planted
    split = graph.cold_split(nodes, edges, 0.2)
    model = spectral.fit_spectral_map(split.warm_nodes, split.warm_edges, 9)
    true = split.truth_pairs()
    pairs = materialize(
        links.labelled_pairs(true, links.negative_samples(nodes, edges, true, 1)), "pairs")
    coords = spectral.apply_spectral_map(model, nodes)
    assert links.link_auc(links.score_links(pairs, coords, "cosine")).first()["auc"] > 0.6
    blind = links.topology_scores(pairs, split.warm_edges).join(pairs, ["src", "dst"])
    cold_ends = blind.filter(
        graph.held_out(F.col("src"), 0.2) | graph.held_out(F.col("dst"), 0.2))
    assert cold_ends.agg(F.max("common")).first()[0] == 0
    assert links.link_auc(cold_ends.withColumn("score", F.col("adamic_adar"))).first()["auc"] == 0.5


def test_trained_model_beats_chance(planted):
    nodes, edges = planted
    train, held = links.split_edges(edges, 0.2)
    pairs = materialize(
        links.labelled_pairs(held, links.negative_samples(nodes, edges, held, 1)), "pairs")
    inputs = materialize(
        links.score_links(pairs, nodes, "cosine", "features").join(
            links.topology_scores(pairs, train), ["src", "dst"]), "inputs")
    found = links.predict_links(links.fit_link_model(inputs), inputs)
    assert links.link_auc(found).first()["auc"] > 0.6


def test_recommendations_skip_known_links(make):
    nodes = make.nodes([[float(i)] for i in range(8)])
    known = make.edges([(0, i) for i in range(1, 6)] + [(6, 7)])
    got = rows(links.recommend_links(nodes, nodes, known, 2, column="features"))
    assert got == rows(
        links.recommend_links(nodes, nodes, known, 2, column="features", broadcast_bytes=0, block_rows=3))
    assert got == rows(links.recommend_links(nodes, nodes, known, 2, column="features", few=2, block_rows=3))
    assert [r[1] for r in got if r[0] == 0] == [6, 7]
    assert [r[1] for r in got if r[0] == 7] == [4, 5] or [r[1] for r in got if r[0] == 7] == [5, 4]
    assert [(r[1], r[2]) for r in got if r[0] == 3] == [(2, 1), (4, 2)]


@pytest.mark.parametrize("list_rows", [1, 3, 10_000])
def test_shared_neighbors_with_hubs_on_both_sides(spark, make, list_rows):
    joined = [(0, i) for i in range(2, 30)] + [(1, i) for i in range(2, 25)] + [(30, i) for i in range(2, 6)]
    asked = [(0, 1), (0, 30), (1, 30), (2, 3), (29, 30)]
    pairs = spark.createDataFrame(asked, "src bigint, dst bigint")
    found = graph.shared_neighbors(pairs, make.edges(joined), hot_rows=2, with_degree=False, list_rows=list_rows)
    near = {}
    for a, b in joined:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = sorted((a, b, c) for a, b in asked for c in near[a] & near[b])
    assert sorted(map(tuple, found.select("src", "dst", "via").collect())) == want


def test_walks_and_links_are_not_broadcast(planted, monkeypatch):
    """Their estimate is that of the rows they are made from, so they would reach every task whole."""
    from coldgraph.operators import links as operators

    plans = []

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(operators, "materialize", noted)
    nodes, edges = planted
    _, held = operators.split_edges(edges, 0.2)
    operators.exact_negatives(nodes, edges, held, 2)
    (plan,) = plans
    joins = [line for line in plan.splitlines() if "Join [" in line and ("LeftAnti" in line or "Join [pos" in line)]
    assert len(joins) == 2 and all("SortMergeJoin" in line for line in joins)
