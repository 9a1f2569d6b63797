"""Node representations: the data side of each model family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coldgraph.functions.hashing import mix_pair
from coldgraph.functions.propagation import FEW, LinkTable, neighbor_sums
from coldgraph.functions.skew import HOT_ROWS, attach, attach_ends
from coldgraph.functions.vectors import dimension
from coldgraph.operators.graph import induced_subgraph, symmetric
from coldgraph.operators.neighbors import augment_edges, knn
from coldgraph.operators.spectral import SpectralMap, apply_spectral_map
from coldgraph.session import materialize


def _propagation_links(
    edges: DataFrame, nodes: DataFrame, norm: str, hot_rows: int
) -> DataFrame:
    """Directed links of A + I scaled by D = weighted degree + 1, self-links included."""
    if norm not in ("sym", "rw"):
        raise ValueError(f"unknown norm {norm}")
    inside = materialize(induced_subgraph(edges, nodes, hot_rows), "induced")
    both = symmetric(inside)
    known = both.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree"))
    lifted = nodes.select("id").join(known, "id", "left").select(
        "id", (F.coalesce("degree", F.lit(0.0)) + 1).alias("degree")
    )
    sided = attach_ends(inside, lifted, "degree", ("src_degree", "dst_degree"), hot_rows=hot_rows)
    if norm == "sym":
        scale = F.sqrt(F.col("src_degree") * F.col("dst_degree"))
        scaled = symmetric(
            sided.select("src", "dst", (F.col("weight") / scale).alias("weight"))
        )
    else:
        ends = (("src", "dst"), ("dst", "src"))
        scaled = sided.select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.col(a).alias("src"),
                            F.col(b).alias("dst"),
                            (F.col("weight") / F.col(f"{b}_degree")).alias("weight"),
                        )
                        for a, b in ends
                    ]
                )
            )
        )
    own = lifted.select(
        F.col("id").alias("src"), F.col("id").alias("dst"), (1 / F.col("degree")).alias("weight")
    )
    return scaled.unionByName(own)


def _hops(edges: DataFrame, nodes: DataFrame, hops: int, norm: str, hot_rows: int):
    """Yield ``(id, x)`` after 1, 2, ... hops, each a written table: one join without
    shuffle and one combined aggregate per hop."""
    d = dimension(nodes, "features")
    links = LinkTable(
        materialize(_propagation_links(edges, nodes, norm, hot_rows), "hop-links"), hot_rows, least=FEW
    )
    try:
        state = nodes.select("id", F.col("features").alias("x"))
        for _ in range(hops):
            state = materialize(links.sums(state, d), "hop")
            yield state
    finally:
        links.release()


def propagate(
    edges: DataFrame, nodes: DataFrame, hops: int = 2, norm: str = "sym", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``(id, x)``: features averaged over the graph ``hops`` times with self-loops.

    ``sym`` is D^-1/2 (A + I) D^-1/2, ``rw`` D^-1 (A + I); an isolated node keeps its own
    features. Edges to ids without features are left out.
    """
    state = nodes.select("id", F.col("features").alias("x"))
    for state in _hops(edges, nodes, hops, norm, hot_rows):
        pass
    return state


def hop_tokens(
    edges: DataFrame, nodes: DataFrame, hops: int = 2, norm: str = "sym", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``(id, tokens ARRAY<ARRAY<DOUBLE>>)``: own features, then every hop's average."""
    tokens = nodes.select("id", F.array("features").alias("tokens"))
    for state in _hops(edges, nodes, hops, norm, hot_rows):
        tokens = tokens.join(state, "id").select(
            "id", F.concat("tokens", F.array("x")).alias("tokens")
        )
    return tokens


def neighbor_sequence(
    neighbors: DataFrame, nodes: DataFrame, k: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``(id, sequence)``: features of the k nearest neighbours, nearest last."""
    vectors = nodes.select(F.col("id").alias("dst"), "features")
    near = materialize(neighbors.filter(F.col("rank") <= k).select("src", "dst", "rank"), "near")
    placed = attach(near, vectors, "dst", ["src"], hot_rows=hot_rows)
    entries = F.array_sort(
        F.collect_list(F.struct((-F.col("rank")).alias("place"), F.col("features")))
    )
    return placed.groupBy(F.col("src").alias("id")).agg(entries.alias("entries")).select(
        "id", F.col("entries.features").alias("sequence")
    )


def scan_sequence(sequences: DataFrame, d: int, decay: float = 0.5) -> DataFrame:
    """``(id, state)``: h <- decay * h + x along the sequence, h = 0 before it."""
    zero = F.array_repeat(F.lit(0.0), d)

    def step(state: Column, x: Column) -> Column:
        return F.zip_with(state, x, lambda h, v: h * decay + v)

    return sequences.select("id", F.aggregate("sequence", zero, step).alias("state"))


def sage_mean(
    edges: DataFrame, nodes: DataFrame, fanout: int, seed: int = 0, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``(id, x)``: own features, then the mean over at most ``fanout`` sampled neighbours.

    Sampling is by hash order and repeatable. The rank filter runs before the
    shuffle too (window group limit), so a hub moves ``fanout`` rows per task.
    A node without neighbours has zeros in the second half.
    """
    d = dimension(nodes, "features")
    inside = induced_subgraph(edges, nodes, hot_rows)
    sampled = materialize(sample_neighbors(inside, fanout, seed), "sampled")
    drawn = sampled.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("weight"))
    means = neighbor_sums(drawn, nodes.select("id", F.col("features").alias("x")), d, hot_rows).select(
        "id", F.transform("sums", lambda s: s / F.col("degree")).alias("mean")
    )
    zeros = F.array_repeat(F.lit(0.0), d)
    return (
        nodes.select("id", "features")
        .join(means, "id", "left")
        .select("id", F.concat("features", F.coalesce("mean", zeros)).alias("x"))
    )


def sample_neighbors(edges: DataFrame, fanout: int, seed: int = 0) -> DataFrame:
    """``(src, dst)``: at most ``fanout`` neighbours of every node, by hash order."""
    order = Window.partitionBy("src").orderBy("place", "dst")
    placed = symmetric(edges).select(
        "src", "dst", mix_pair(F.col("src") + F.lit(seed), F.col("dst")).alias("place")
    )
    return (
        placed.withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= fanout)
        .select("src", "dst")
    )


def feature_baseline(nodes: DataFrame) -> DataFrame:
    """``(id, x)``: own features only."""
    return nodes.select("id", F.col("features").alias("x"))


METHODS = ("propagate", "tokens", "sequence")


def cold_representation(
    model: SpectralMap,
    warm_nodes: DataFrame,
    cold_nodes: DataFrame,
    edges: DataFrame,
    method: str = "propagate",
    k: int = 10,
    hops: int = 2,
    decay: float = 0.5,
    hot_rows: int = HOT_ROWS,
    **knn_options,
) -> DataFrame:
    """``(id, x)`` for warm and cold nodes alike, the cold ones through predicted neighbours.

    The map places cold nodes in spectral space from features alone, kNN among the warm
    nodes predicts their edges, and the same code as for warm nodes does the rest.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    warm = apply_spectral_map(model, warm_nodes)
    cold = apply_spectral_map(model, cold_nodes)
    nodes = warm_nodes.select("id", "features").unionByName(cold_nodes.select("id", "features"))
    if method == "sequence":
        found = knn(cold.unionByName(warm), warm, k, column="z", **knn_options)
        d = dimension(nodes, "features")
        scanned = scan_sequence(neighbor_sequence(found, nodes, k, hot_rows), d, decay)
        return scanned.select("id", F.col("state").alias("x"))
    found = knn(cold, warm, k, column="z", **knn_options)
    full = augment_edges(edges, found)
    if method == "tokens":
        return hop_tokens(full, nodes, hops, hot_rows=hot_rows).select(
            "id", F.flatten("tokens").alias("x")
        )
    return propagate(full, nodes, hops, hot_rows=hot_rows)
