"""Link prediction: splits, negatives, scores, metrics, recommendation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coldgraph.functions.hashing import MIX_INPUT, mix, mix_pair, pair_bucket
from coldgraph.functions.skew import HOT_ROWS, attach, attach_ends
from coldgraph.functions.vectors import PAIR_SCORES, rounded, score_pairs
from coldgraph.operators.graph import shared_neighbors, symmetric
from coldgraph.operators.neighbors import FreshIndex, NeighborIndex
from coldgraph.session import materialize

BUCKET_NODES = 65_536
MOST_BUCKETS = 1 << 24
TRIES = 4
LADDER_STEPS = 256
WALK = 4_096  # steps of a walk counted together

FEW_LINKS = 64


def split_edges(edges: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """(train, held out) edges by a hash of both ends; the ends stay in the graph."""
    out = pair_bucket(F.col("src"), F.col("dst")) < F.lit(1000 * share)
    return edges.filter(~out), edges.filter(out)


def numbered(nodes: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Nodes in hash buckets, numbered inside each: ``(id, bucket, place)``, bucket sizes, count.

    Picking a node by (bucket, place) needs no global order; a bucket holds about
    ``BUCKET_NODES`` nodes (more beyond 2^40 nodes).
    """
    buckets = min(MOST_BUCKETS, max(1, -(-nodes.count() // BUCKET_NODES)))
    bucket = F.pmod(F.shiftright(mix(F.col("id")), 8), F.lit(buckets))
    placed = nodes.select("id", bucket.alias("bucket")).withColumn(
        "place", F.row_number().over(Window.partitionBy("bucket").orderBy("id")) - 1
    )
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    return placed, sizes, buckets


def negative_samples(
    nodes: DataFrame,
    edges: DataFrame,
    positives: DataFrame,
    per_pos: int = 1,
    seed: int = 0,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``(src, dst)`` with src < dst: pairs that are no edge, up to ``per_pos`` per positive.

    Each positive keeps its ``src`` and draws a partner by hash, bucket and place by hashes of
    their own. A draw that hits an edge or the node itself is repeated, ``TRIES`` times in all; equal pairs
    of several draws count once, so some fewer than asked may come out. ``edges`` must hold all known edges.
    """
    placed, sizes, buckets = numbered(nodes)
    a = F.pmod(F.col("src"), F.lit(MIX_INPUT)) + F.lit(seed)
    b = F.pmod(F.col("dst"), F.lit(MIX_INPUT)) * (per_pos * TRIES) + F.col("t")
    draws = positives.select("src", "dst", F.explode(F.sequence(F.lit(0), F.lit(per_pos * TRIES - 1))).alias("t")).select(
        "src", "dst", "t", F.pmod(F.shiftright(mix_pair(a, b), 8), F.lit(buckets)).alias("bucket"), mix_pair(b, a).alias("h")
    )
    located = draws.join(sizes, "bucket")
    aimed = located.withColumn("place", F.pmod(F.shiftright("h", 4), F.col("size")).cast("int")).drop("h", "size")
    drawn = aimed.join(placed.withColumnRenamed("id", "other"), ["bucket", "place"]).filter(F.col("src") != F.col("other"))
    pairs = drawn.select(
        F.least("src", "other").alias("src"), F.greatest("src", "other").alias("dst"),
        F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), F.expr(f"t div {TRIES}").alias("n")).alias("draw"), "t",
    )
    fresh = pairs.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    first = fresh.groupBy("draw").agg(F.min_by(F.struct("src", "dst"), "t").alias("pair"))
    return first.select("pair.*").distinct()


def ring(nodes: DataFrame) -> DataFrame:
    """``(id, pos)``: all nodes in the order of a hash, numbered without gaps from the sizes of hash buckets."""
    buckets = min(MOST_BUCKETS, max(1, -(-nodes.count() // BUCKET_NODES)))
    placed = nodes.select("id", F.pmod(F.shiftright(mix(F.col("id")), 8), F.lit(buckets)).alias("bucket"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    offsets = sizes.select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(mix(F.col("id")), "id")) - 1
    return placed.withColumn("place", place).join(offsets, "bucket").select("id", (F.col("offset") + F.col("place")).alias("pos"))


def exact_negatives(nodes: DataFrame, edges: DataFrame, positives: DataFrame, per_pos: int = 1, seed: int = 0) -> DataFrame:
    """``(src, dst)``: for each ``src`` of ``positives`` exactly ``per_pos`` times as many distinct nodes as it has positives, none of them
    itself or a neighbour; all such nodes where there are fewer (``negative_deficits`` tells).

    A source walks a ring of all nodes in hash order from a hashed start. The first ``quota + degree + 1`` steps always hold the quota, so one round
    is enough, and all steps together are linear in edges and positives. Long walks are cut into pieces of ``WALK`` steps, so a hub is the work of many tasks. Repeated positives
    count each time. A pair may come from both of its ends. ``edges`` must hold all known edges, each once.
    """
    n = nodes.count()
    if not n:
        return positives.select("src", "dst").limit(0)
    taken = symmetric(edges).select("src", F.col("dst").alias("other"))
    degree = taken.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    asked = positives.groupBy("src").agg((F.count(F.lit(1)) * per_pos).alias("quota")).join(degree, "src", "left")
    a, b = mix_pair(F.col("src"), F.lit(seed)), mix_pair(F.lit(seed + 1), F.col("src"))
    steps = F.least(F.lit(n), F.col("quota") + F.coalesce("degree", F.lit(0)) + 1)
    walks = asked.select("src", "quota", steps.alias("steps"), F.pmod(a * F.lit(1 << 20) + F.shiftright(b, 12), F.lit(n)).alias("start"))
    pieces = walks.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("steps") - 1) / WALK))))
    # pieces are dealt out before they become steps, so that a hub's walk isn't one task's
    pieces = pieces.repartition("src", "piece").withColumn("first", F.col("piece") * WALK)
    walked = pieces.withColumn("i", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + WALK, "steps") - 1)))
    # merged, not broadcast: the planner takes walks and links for as small as they were before they became rows
    walked = walked.withColumn("pos", F.pmod(F.col("start") + F.col("i"), F.lit(n))).hint("merge")
    found = walked.join(ring(nodes).withColumnRenamed("id", "other"), "pos").where(F.col("src") != F.col("other")).hint("merge")
    free = materialize(found.join(taken, ["src", "other"], "left_anti").select("src", "other", "quota", "piece", "i"), "free")
    before = Window.partitionBy("src").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counted = free.groupBy("src", "piece").agg(F.count(F.lit(1)).alias("held"))
    counted = counted.select("src", "piece", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("src", "piece").orderBy("i")) + F.col("before")
    ranked = free.join(counted, ["src", "piece"]).withColumn("rank", rank)
    return ranked.where(F.col("rank") <= F.col("quota")).select("src", F.col("other").alias("dst"))


def negative_deficits(nodes: DataFrame, edges: DataFrame, positives: DataFrame, per_pos: int = 1) -> DataFrame:
    """``(src, asked, possible, deficit)`` of each source of ``positives``: negatives asked for, nodes that are neither itself nor a neighbour, and what is lacking."""
    n = nodes.count()
    near = symmetric(edges).select("src", F.col("dst").alias("id")).unionByName(positives.select("src", F.col("src").alias("id")).distinct())
    near = near.join(nodes.select("id"), "id", "left_semi").groupBy("src").agg(F.count(F.lit(1)).alias("near"))
    asked = positives.groupBy("src").agg((F.count(F.lit(1)) * per_pos).alias("asked")).join(near, "src", "left")
    possible = F.lit(n) - F.coalesce("near", F.lit(0))
    return asked.select("src", "asked", possible.alias("possible"), F.greatest(F.lit(0), F.col("asked") - possible).alias("deficit"))


def labelled_pairs(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """``(src, dst, y)``."""
    return positives.select("src", "dst", F.lit(1).alias("y")).unionByName(
        negatives.select("src", "dst", F.lit(0).alias("y"))
    )


def score_links(
    pairs: DataFrame, coords: DataFrame, how: str = "distance", column: str = "z",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Pairs with ``score``: -distance, cosine or dot; nothing is trained."""
    if how not in PAIR_SCORES:
        raise ValueError(f"unknown score {how}")
    sided = attach_ends(pairs, coords, column, ("a", "b"), hot_rows=hot_rows)
    return score_pairs(sided, "a", "b", how, pairs.columns)


def topology_scores(pairs: DataFrame, edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(src, dst, common, jaccard, adamic_adar, preferential)``; 0 for pairs with a cold end."""
    wanted = materialize(pairs.select("src", "dst").distinct(), "pairs")
    degree = symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    shared = shared_neighbors(wanted, edges, hot_rows)
    counted = shared.groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("common"), F.sum(1 / F.log("via_degree")).alias("adamic_adar")
    )
    sided = attach_ends(
        wanted, degree, "degree", ("src_degree", "dst_degree"), "left", hot_rows
    )
    a = F.coalesce("src_degree", F.lit(0))
    b = F.coalesce("dst_degree", F.lit(0))
    common = F.coalesce("common", F.lit(0))
    union = a + b - common
    return sided.join(counted, ["src", "dst"], "left").select(
        "src",
        "dst",
        common.alias("common"),
        rounded(F.when(union > 0, common / union).otherwise(0.0)).alias("jaccard"),
        rounded(F.coalesce("adamic_adar", F.lit(0.0))).alias("adamic_adar"),
        (a * b).alias("preferential"),
    )


LINK_INPUTS = ("score", "common", "jaccard", "adamic_adar", "preferential")


def fit_link_model(pairs: DataFrame, inputs: tuple[str, ...] = LINK_INPUTS) -> PipelineModel:
    """Trained comparator: logistic regression on ``(y, inputs...)``."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(inputs), outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
            LogisticRegression(featuresCol="scaled", labelCol="y", regParam=1e-4),
        ]
    ).fit(pairs)


def predict_links(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """``links(src, dst, score, y)`` with the model's probability as score."""
    bare = model.transform(pairs).drop("score")
    return bare.select("src", "dst", rounded(vector_to_array("probability")[1]).alias("score"), "y")


# --- metrics ------------------------------------------------------------------


def score_ladder(scored: DataFrame, steps: int = LADDER_STEPS) -> DataFrame:
    """``(score, pos, neg, pos_above, neg_above, pos_all, neg_all)`` per distinct score.

    Rows are counted per rounded score first (map-side), so tied rows become one. The
    running totals take two passes: scores are ranged into ``steps`` intervals by
    approximate quantiles, the interval totals are summed up, and only inside an
    interval a window runs. The quantiles decide the cost, not the result.
    """
    counted = materialize(
        scored.filter("score IS NOT NULL").groupBy(rounded(F.col("score")).alias("score")).agg(
            F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
        ),
        "scores",
    )
    shares = [i / steps for i in range(1, steps)]
    bounds = counted.agg(F.percentile_approx("score", shares, 10_000)).first()[0] or []
    ranged = _with_interval(counted, sorted(set(bounds)))
    totals = ranged.groupBy("step").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rows = sorted((r["step"], r["pos"], r["neg"]) for r in totals.collect())
    offsets, pos, neg = [], 0, 0
    for step, p, n in reversed(rows):
        offsets.append((step, pos, neg))
        pos, neg = pos + p, neg + n
    table = scored.sparkSession.createDataFrame(
        offsets, "step int, pos_before bigint, neg_before bigint"
    )
    within = (
        Window.partitionBy("step").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    )
    return ranged.join(F.broadcast(table), "step").select(
        "score",
        "pos",
        "neg",
        (F.col("pos_before") + F.coalesce(F.sum("pos").over(within), F.lit(0))).alias("pos_above"),
        (F.col("neg_before") + F.coalesce(F.sum("neg").over(within), F.lit(0))).alias("neg_above"),
        F.lit(pos).cast("bigint").alias("pos_all"),
        F.lit(neg).cast("bigint").alias("neg_all"),
    )


def _with_interval(counted: DataFrame, bounds: list[float]) -> DataFrame:
    splits = [-float("inf"), *(bounds or [0.0]), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="score", outputCol="interval")
    return cut.transform(counted).select(
        *counted.columns, F.col("interval").cast("int").alias("step")
    )


def link_auc(scored: DataFrame, steps: int = LADDER_STEPS) -> DataFrame:
    """``(positives, negatives, auc)``: ties count half; null without both classes."""
    ladder = score_ladder(scored, steps)
    below = F.col("neg_all") - F.col("neg_above") - F.col("neg")
    won = F.col("pos") * (below + F.col("neg") / 2)
    pairs = F.nullif(F.col("pos_all").cast("double") * F.col("neg_all"), F.lit(0.0))
    return _metric(ladder, F.sum(won / pairs), "auc")


def link_ap(scored: DataFrame, steps: int = LADDER_STEPS) -> DataFrame:
    """``(positives, negatives, ap)``: average precision, ties grouped by score."""
    ladder = score_ladder(scored, steps)
    taken_pos = F.col("pos_above") + F.col("pos")
    taken = taken_pos + F.col("neg_above") + F.col("neg")
    share = F.col("pos") / F.nullif(F.col("pos_all"), F.lit(0))
    return _metric(ladder, F.sum(share * taken_pos / taken), "ap")


def _metric(ladder: DataFrame, value: Column, name: str) -> DataFrame:
    return ladder.agg(
        F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("negatives"),
        rounded(value).alias(name),
    )


def hits_at_k(scored: DataFrame, k: int) -> DataFrame:
    """``(queries, hits)``: mean over ``src`` with true links of (true among the k best)/min(k, true).

    Order: score, then dst. The k-best filter runs before the shuffle too (window
    group limit): a query with many candidates moves k rows per task.
    """
    scored = materialize(scored.select("src", "dst", "score", "y"), "scored")
    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    best = scored.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    hits = best.groupBy("src").agg(F.count_if(F.col("y") == 1).alias("hits"))
    true = scored.filter("y = 1").groupBy("src").agg(F.count(F.lit(1)).alias("true_count"))
    share = F.coalesce("hits", F.lit(0)) / F.least(F.lit(k), F.col("true_count"))
    return true.join(hits, "src", "left").agg(
        F.count(F.lit(1)).alias("queries"), rounded(F.avg(share)).alias("hits")
    )


def mrr(scored: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(queries, mrr)``: mean of 1/rank of the best true link, 0 without one.

    The rank is one more than the number of candidates before that link, a combined
    count: no query's candidates are ever sorted.
    """
    scored = materialize(scored.select("src", "dst", "score", "y"), "scored")
    best = scored.filter("y = 1").groupBy("src").agg(
        F.min(F.struct((-F.col("score")).alias("key"), F.col("dst"))).alias("best")
    )
    ahead = attach(
        scored.select("src", "dst", F.struct((-F.col("score")).alias("key"), F.col("dst")).alias("at")),
        best, "src", ["dst"], how="left", hot_rows=hot_rows,
    )
    ranks = ahead.groupBy("src").agg(
        F.max("best").alias("best"), (F.count_if(F.col("at") < F.col("best")) + 1).alias("rank")
    )
    value = F.when(F.col("best").isNotNull(), 1 / F.col("rank")).otherwise(0.0)
    return ranks.agg(F.count(F.lit(1)).alias("queries"), rounded(F.avg(value)).alias("mrr"))


def recommend_links(
    cold: DataFrame, base: DataFrame, known: DataFrame, k: int, column: str = "z", few: int = FEW_LINKS, **options
) -> DataFrame:
    """``(src, dst, rank, dist)``: k nearest base nodes of each query that aren't linked yet.

    Exact. A query with at most ``few`` known links takes its k + few nearest and leaves the linked ones out. Better linked ones
    search incrementally: each resumes at a wider radius until k unlinked nodes are nearer than any cell it hasn't visited, and all is rows.
    """
    links = materialize(symmetric(known).select("src", "dst"), "known")
    linked = links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("m"))
    sized = materialize(cold.join(linked, "id", "left").select("id", column, (F.coalesce("m", F.lit(0)) > few).alias("many")), "sized")
    some, many = (sized.where(c).select("id", column) for c in (~F.col("many"), F.col("many")))
    found = NeighborIndex(base, k + few, column=column, **options).nearest(some)
    fresh = found.join(links, ["src", "dst"], "left_anti")
    order = Window.partitionBy("src").orderBy("dist", "dst")
    result = (
        fresh.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("src", "dst", "rank", "dist")
    )
    if many.isEmpty():
        return result
    kept = {o: options[o] for o in ("metric", "block_rows", "cells") if o in options}
    return result.unionByName(FreshIndex(base, column=column, **kept).nearest(many, links, k))
