"""Spectral embeddings of a graph, and the map from features into that space."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldgraph.functions.hashing import is_integer
from coldgraph.functions.propagation import FEW, PART_ROWS, LinkTable, neighbor_sums
from coldgraph.functions.skew import HOT_ROWS, attach_ends
from coldgraph.functions.solvers import filter_roots, fix_signs, generalized_eigh
from coldgraph.functions.vectors import collect_products, dimension, list_array, map_vectors, matrix, product_sums
from coldgraph.operators.graph import held_out, symmetric
from coldgraph.session import drop_table, materialize
from coldgraph.sources.tables import require

ONE = "array(1D)"
STALLED = 6
MOST_DEGREE = 24


def _with_degrees(edges: DataFrame, hot_rows: int) -> DataFrame:
    """Edges with the weighted degrees of both ends."""
    per_node = (
        symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree"))
    )
    return attach_ends(
        edges, per_node, "degree", ("src_degree", "dst_degree"), hot_rows=hot_rows
    )


def laplacian_entries(edges: DataFrame, kind: str = "sym", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(i, j, value)`` of D-A (``plain``), I-D^-1/2 A D^-1/2 (``sym``) or I-D^-1 A (``rw``)."""
    if kind not in ("plain", "sym", "rw"):
        raise ValueError(f"unknown Laplacian {kind}")
    sided = _with_degrees(edges, hot_rows)
    scale = {
        "plain": (F.lit(1.0), F.lit(1.0)),
        "sym": (F.sqrt(F.col("src_degree") * F.col("dst_degree")),) * 2,
        "rw": (F.col("src_degree"), F.col("dst_degree")),
    }[kind]
    off = sided.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("src").alias("i"),
                    F.col("dst").alias("j"),
                    (-F.col("weight") / scale[0]).alias("value"),
                ),
                F.struct(
                    F.col("dst").alias("i"),
                    F.col("src").alias("j"),
                    (-F.col("weight") / scale[1]).alias("value"),
                ),
            )
        )
    )
    diagonal = (
        symmetric(edges)
        .groupBy(F.col("src").alias("i"))
        .agg((F.sum("weight") if kind == "plain" else F.lit(1.0)).alias("value"))
        .select("i", F.col("i").alias("j"), "value")
    )
    return off.unionByName(diagonal)


def _summed_nodes(vectors: DataFrame, edges: DataFrame, d: int, hot_rows: int) -> DataFrame:
    """``(id, x, sums, degree)`` over the graph induced on the ids of ``vectors(id, x)``."""
    return neighbor_sums(symmetric(edges), vectors, d, hot_rows).join(vectors, "id")


def rayleigh(edges: DataFrame, coords: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(dim, value)``: sum of w(zi-zj)^2 over edges / D-weighted variance sum of z.

    Written with per-node neighbour sums, sum w(zi-zj)^2 = sum z(dz - Az), so
    the edges take part in one join and one combined aggregate only.
    """
    k = dimension(coords, "z")
    rows = _summed_nodes(coords.select("id", F.col("z").alias("x")), edges, k, hot_rows)
    elements = rows.select("degree", F.posexplode(F.arrays_zip("x", "sums")).alias("dim", "e"))
    d, z = F.col("degree"), F.col("e.x")
    parts = elements.groupBy("dim").agg(
        F.sum(z * (d * z - F.col("e.sums"))).alias("rough"),
        F.sum(d * z * z).alias("square"),
        F.sum(d * z).alias("first"),
        F.sum(d).alias("total"),
    )
    spread = F.col("square") - F.col("first") * F.col("first") / F.col("total")
    return parts.select("dim", F.when(spread > 0, F.col("rough") / spread).alias("value"))


def spectral_moments(
    nodes: DataFrame, edges: DataFrame, column: str = "features", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``(name, p, q, value)``: the d x d sums behind the spectral map.

    ``laplacian`` = sum over edges of w(xi-xj)(xi-xj)', ``degree`` = sum over nodes of
    d x x', and ``mean`` (q = 0), the degree-weighted mean. The first is computed as
    ``degree`` minus the sum of x (Ax)', for which one neighbour-sum step suffices; what
    leaves the tasks is one d x d partial each.
    """
    d = dimension(nodes, column)
    vectors = nodes.select("id", F.col(column).alias("x"))
    rows = _summed_nodes(vectors, edges, d, hot_rows).withColumn("one", F.expr(ONE))
    sums = materialize(_moment_sums(rows, d), "moments")
    weight = sums.filter("name = 'total'").first()
    per_cell = {
        name: F.sum(F.when(F.col("name") == name, F.col("value"))) for name in ("degree", "cross")
    }
    cells = sums.filter("name IN ('degree', 'cross')").groupBy("p", "q").agg(
        (per_cell["degree"] - per_cell["cross"]).alias("laplacian"),
        per_cell["degree"].alias("degree"),
    )
    square = cells.unpivot(["p", "q"], ["laplacian", "degree"], "name", "value")
    mean = sums.filter("name = 'first'").select(
        F.lit("mean").alias("name"), "p", "q", (F.col("value") / F.lit(weight["value"])).alias("value")
    )
    return square.select("name", "p", "q", "value").unionByName(mean)


def _moment_sums(rows: DataFrame, d: int) -> DataFrame:
    return product_sums(
        rows,
        {
            "degree": ("x", "x"),
            "cross": ("x", "sums"),
            "first": ("x", "one"),
            "total": ("one", "one"),
        },
        {"x": d, "sums": d, "one": 1},
        {"degree": "degree", "first": "degree", "total": "degree"},
    )


@dataclass(frozen=True)
class SpectralMap:
    """F: ``z = (lift(x) - mean) weights``. Constant in size, whatever the graph."""

    mean: np.ndarray
    weights: np.ndarray
    eigenvalues: np.ndarray
    frequencies: np.ndarray | None = None
    phases: np.ndarray | None = None

    @property
    def input_dim(self) -> int:
        return (self.frequencies if self.frequencies is not None else self.weights.T).shape[1]

    def transform(self, rows: np.ndarray) -> np.ndarray:
        if self.frequencies is not None:
            rows = lift(rows, self.frequencies, self.phases)
        return (rows - self.mean) @ self.weights

    def to_row(self, spark: SparkSession) -> DataFrame:
        """One-row table, ready for ``save_table``."""
        row = (
            self.mean.tolist(),
            self.weights.tolist(),
            self.eigenvalues.tolist(),
            None if self.frequencies is None else self.frequencies.tolist(),
            None if self.phases is None else self.phases.tolist(),
        )
        schema = (
            "mean array<double>, weights array<array<double>>, eigenvalues array<double>, "
            "frequencies array<array<double>>, phases array<double>"
        )
        return spark.createDataFrame([row], schema)

    @staticmethod
    def from_row(df: DataFrame) -> SpectralMap:
        row = require(df, "mean", "weights", "eigenvalues").first()
        optional = {
            name: None if row[name] is None else np.array(row[name])
            for name in ("frequencies", "phases")
        }
        return SpectralMap(
            np.array(row["mean"]), np.array(row["weights"]), np.array(row["eigenvalues"]), **optional
        )


def lift(rows: np.ndarray, frequencies: np.ndarray, phases: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / len(phases)) * np.cos(rows @ frequencies.T + phases)


def random_directions(d: int, m: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies (m x d) and phases whose cosines approximate exp(-gamma |x-y|^2)."""
    generator = np.random.default_rng(seed)
    frequencies = generator.normal(size=(m, d)) * np.sqrt(2 * gamma)
    return frequencies, generator.uniform(0, 2 * np.pi, size=m)


def random_features(
    nodes: DataFrame, m: int, gamma: float = 1.0, seed: int = 0, column: str = "features"
) -> DataFrame:
    """``(id, features)`` lifted to m random cosines, with which a linear map is non-linear in x."""
    d = dimension(nodes, column)
    frequencies, phases = random_directions(d, m, gamma, seed)
    return map_vectors(nodes, column, d, lambda x: lift(x, frequencies, phases), "features", "id")


def fit_spectral_map(
    nodes: DataFrame,
    edges: DataFrame,
    k: int,
    ridge: float = 1e-2,
    lift_to: int | None = None,
    gamma: float = 1.0,
    seed: int = 0,
    hot_rows: int = HOT_ROWS,
) -> SpectralMap:
    """Learn F: the k smoothest degree-orthonormal directions of the features on the graph.

    Features are the input; adjacency enters through the moment sums alone. Only
    d x d sums reach the driver. ``ridge`` is relative to the mean variance.
    """
    frequencies = phases = None
    if lift_to:
        d = dimension(nodes, "features")
        frequencies, phases = random_directions(d, lift_to, gamma, seed)
        nodes = map_vectors(
            nodes, "features", d, lambda x: lift(x, frequencies, phases), "features", "id"
        )
        d = lift_to
    else:
        d = dimension(nodes, "features")
    vectors = nodes.select("id", F.col("features").alias("x"))
    rows = _summed_nodes(vectors, edges, d, hot_rows).withColumn("one", F.expr(ONE))
    moments = collect_products(
        _moment_sums(rows, d),
        {"degree": (d, d), "cross": (d, d), "first": (d, 1), "total": (1, 1)},
    )
    total = moments["total"][0, 0]
    if total <= 0:
        raise ValueError("no edges between nodes with features: nothing to learn from")
    return solve_spectral_map(
        moments["degree"] - moments["cross"],
        moments["degree"],
        moments["first"][:, 0] / total,
        total,
        k,
        ridge,
        frequencies,
        phases,
    )


def fit_nested_maps(
    nodes: DataFrame, edges: DataFrame, shares: Sequence[float], k: int, ridge: float = 1e-2, hot_rows: int = HOT_ROWS
) -> dict[float, SpectralMap]:
    """``fit_spectral_map`` on the warm part of ``cold_split`` for every share, from one pass over the edges.

    Hold-out sets are nested: an edge is warm at the smallest shares up to some number of them, its band. Neighbour
    and moment sums are taken by band, and those of a share are the sums over the bands that reach it.
    """
    d = dimension(nodes, "features")
    steps = sorted(set(shares))
    integer = is_integer(edges, "src")
    cold = lambda share: held_out(F.col("src"), share, integer) | held_out(F.col("dst"), share, integer)
    bands = range(1, len(steps) + 1)
    band = sum((F.when(cold(share), 0).otherwise(1) for share in steps), F.lit(0))
    vectors = nodes.select("id", F.col("features").alias("x"))
    links = symmetric(edges).withColumn("band", band).where("band > 0")
    links = links.withColumn("end", F.struct("dst", "band"))
    summed = LinkTable(links, hot_rows, least=FEW, kept=False).sums(vectors, d, "sums", by="end", degree=F.sum("weight"))
    rows = summed.select(F.col("id.dst").alias("id"), F.col("id.band").alias("band"), "sums", "degree").join(vectors, "id")
    rows = rows.withColumn("one", F.expr(ONE))
    products, weights = {}, {}
    for b in bands:
        own = {f"degree{b}": ("x", "x", "degree"), f"cross{b}": ("x", "sums", None), f"first{b}": ("x", "one", "degree"), f"total{b}": ("one", "one", "degree")}
        for name, (left, right, weight) in own.items():
            products[name], weights[name] = (left, right), f"{weight or 'own'}_{b}"
        rows = rows.withColumns(
            {f"degree_{b}": F.when(F.col("band") == b, F.col("degree")).otherwise(0.0), f"own_{b}": F.when(F.col("band") == b, 1.0).otherwise(0.0)}
        )
    dims = {"x": d, "sums": d, "one": 1}
    shapes = {name: (dims[left], dims[right]) for name, (left, right) in products.items()}
    parts = collect_products(product_sums(rows, products, dims, weights), shapes)
    found = {}
    for place, share in enumerate(steps, 1):
        degree, cross, first, total = (sum(parts[f"{name}{b}"] for b in bands if b >= place) for name in ("degree", "cross", "first", "total"))
        if total[0, 0] <= 0:
            raise ValueError(f"no edges between warm nodes with features at share {share}: nothing to learn from")
        found[share] = solve_spectral_map(degree - cross, degree, first[:, 0] / total[0, 0], total[0, 0], k, ridge)
    return found


def solve_spectral_map(
    laplacian: np.ndarray,
    degree: np.ndarray,
    mean: np.ndarray,
    total: float,
    k: int,
    ridge: float,
    frequencies: np.ndarray | None = None,
    phases: np.ndarray | None = None,
) -> SpectralMap:
    d = len(mean)
    if k > d:
        raise ValueError(f"k = {k} exceeds the feature length {d}")
    spread = degree - total * np.outer(mean, mean)
    spread = spread + ridge * np.trace(spread) / d * np.eye(d)
    values, vectors = generalized_eigh(laplacian, spread)
    weights = fix_signs(vectors[:, :k]) * np.sqrt(total)
    return SpectralMap(mean, weights, values[:k], frequencies, phases)


def fit_by_regression(nodes: DataFrame, coords: DataFrame, ridge: float = 1e-6) -> SpectralMap:
    """The other route to F: ridge regression of known coordinates on the features."""
    d, k = dimension(nodes, "features"), dimension(coords, "z")
    rows = nodes.select("id", F.col("features").alias("x")).join(coords.select("id", "z"), "id")
    sums = collect_products(
        product_sums(
            rows.withColumn("one", F.expr(ONE)),
            {"xx": ("x", "x"), "xz": ("x", "z"), "x": ("x", "one"), "z": ("z", "one"), "n": ("one", "one")},
            {"x": d, "z": k, "one": 1},
            {},
        ),
        {"xx": (d, d), "xz": (d, k), "x": (d, 1), "z": (k, 1), "n": (1, 1)},
    )
    n = sums["n"][0, 0]
    if n == 0:
        raise ValueError("nodes and coords share no id")
    mean, target = sums["x"][:, 0] / n, sums["z"][:, 0] / n
    gram = sums["xx"] - n * np.outer(mean, mean)
    gram = gram + ridge * np.trace(gram) / d * np.eye(d)
    weights = np.linalg.solve(gram, sums["xz"] - n * np.outer(mean, target))
    # The intercept goes into the mean: (x - mean) W + target = (x - mean') W.
    shift = np.linalg.lstsq(weights.T, target, rcond=None)[0]
    return SpectralMap(mean - shift, weights, np.full(k, np.nan))


def apply_spectral_map(model: SpectralMap, nodes: DataFrame, *keep: str) -> DataFrame:
    """``(id, z)`` of any node from its features alone: a narrow map, no join, no shuffle."""
    require(nodes, "id", "features")
    return map_vectors(
        nodes, "features", model.input_dim, model.transform, "z", "id", *keep
    )


@dataclass
class SpectralSolution:
    """``coords(id, z)`` with, per dimension, the eigenvalue and the norm of A x - value * x."""

    coords: DataFrame
    values: list[float]
    residuals: list[float]


def spectral_embedding(edges: DataFrame, k: int, **options) -> DataFrame:
    """``(id, z)`` of ``spectral_solution``."""
    return spectral_solution(edges, k, **options).coords


def spectral_solution(
    edges: DataFrame,
    k: int,
    degree: int = 6,
    oversample: int = 4,
    tolerance: float = 1e-3,
    seed: int = 0,
    hot_rows: int = HOT_ROWS,
    part_rows: int = PART_ROWS,
) -> SpectralSolution:
    """Leading non-trivial eigenvectors of D^-1/2 A D^-1/2, scaled by D^-1/2, each with a residual of at most ``tolerance``.

    Chebyshev-filtered block iteration, the filter taken as a product of factors
    (A - root). A self-link of every node carries the root term, so a step reads the
    state once: one join without shuffle, one aggregate. Each round ends with a
    written table and a small Rayleigh-Ritz problem on the driver; one pass over that table gives the residuals.
    Vectors well below the tolerance are locked: they leave the block, and the rest is kept orthogonal to them, as to the
    trivial eigenvector, which is known from the start. Slow rounds double the degree of the filter. Rounds go on until
    the tolerance is reached. Only if ``STALLED`` of them in a row gain nothing (an eigenvalue inside a cluster that the block can't hold) does it end
    early, with a warning; the residuals then say how far it got.
    """
    weighted = _with_degrees(edges, hot_rows)
    off = weighted.select(
        "src",
        "dst",
        (F.col("weight") / F.sqrt(F.col("src_degree") * F.col("dst_degree"))).alias("weight"),
    )
    node_degrees = (
        symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree"))
    )
    base = materialize(node_degrees, "degrees")
    own = base.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(None).cast("double").alias("weight"))
    links = LinkTable(materialize(symmetric(off).unionByName(own), "links"), hot_rows, part_rows, least=1, nodes=base.count())
    try:
        with links.layout():
            return _filtered_iteration(base, links, k, k + oversample, degree, tolerance, seed)
    finally:
        links.release()


def _step(links: LinkTable, state: DataFrame, width: int, root: float, keep: bool = False):
    """State ``(id, c0..)`` times (A - root); ``keep`` also passes the former block on."""
    joined = links.join(state).withColumn("factor", F.coalesce("weight", F.lit(-root)))
    columns = [f"sum(factor * c{i}) AS c{i}" for i in range(width)]
    if keep:
        columns += [f"max(CASE WHEN weight IS NULL THEN c{i} END) AS p{i}" for i in range(width)]
    return joined.groupBy(F.col("dst").alias("id")).agg(*[F.expr(c) for c in columns])


def _filtered_iteration(base, links, k, width, degree, tolerance, seed) -> SpectralSolution:
    total = base.agg(F.sum("degree")).first()[0] or 1.0
    noise = [
        F.sqrt("degree") * (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(1 << 20)) / (1 << 20) - 0.5)
        for i in range(1, width + 1)
    ]
    blocks = base.select("id", *[c.alias(f"c{i}") for i, c in enumerate(noise)])
    # Locked unit vectors, the trivial one first, with their eigenvalues and residuals.
    locked = base.select("id", F.array(F.sqrt(F.col("degree") / total)).alias("l"))
    values, residuals = np.ones(1), np.zeros(1)
    cut, best, stalled = 0.0, np.inf, 0
    block = None
    while True:
        former = block
        state = blocks
        for root in filter_roots(cut, degree):
            state = _step(links, state, width, root)
        # One plain product A X, next to X, for the Rayleigh-Ritz sums.
        state = _step(links, state, width, 0.0, keep=True).selectExpr(
            "id",
            f"array({', '.join(f'p{i}' for i in range(width))}) AS x",
            f"array({', '.join(f'c{i}' for i in range(width))}) AS ax",
        )
        pair = materialize(state.join(locked, "id"), "iterate")
        known = len(values)
        shapes = {"g": (width, width), "h": (width, width), "c": (known, width), "e": (known, width)}
        products = {"g": ("x", "x"), "h": ("x", "ax"), "c": ("l", "x"), "e": ("l", "ax")}
        dims = {"x": width, "ax": width, "l": known}
        sums = collect_products(product_sums(pair, products, dims, {}), shapes)
        rotation, found = _ritz(sums["g"], sums["h"], sums["c"], sums["e"], values)
        rotated = _rotate(pair, width, known, sums["c"], rotation, values)
        norms = _residual_norms(rotated, found)
        wanted = min(k - known + 1, len(found))
        largest = norms[:wanted].max(initial=0.0)
        stalled = stalled + 1 if largest > 0.9 * best else 0
        # The first round filters with a blind cut, so a second one always follows.
        done = (largest <= tolerance and np.isfinite(best)) or stalled >= STALLED
        last = wanted if done else next((i for i in range(wanted) if norms[i] > tolerance / 10), wanted)
        block = materialize(
            rotated.select("id", F.concat("l", F.slice("x", 1, last)).alias("l"), F.slice("x", last + 1, len(found)).alias("x")), "block"
        )
        values, residuals = np.append(values, found[:last]), np.append(residuals, norms[:last])
        drop_table(pair)
        drop_table(former)
        if done:
            break
        if largest > 0.3 * best:
            degree = min(2 * degree, MOST_DEGREE)
        best = min(best, largest)
        # What lies within the tolerance of 1 need not be told apart, so the filter leaves no wider gap than that.
        cut = float(np.clip(found[-1], -0.5, max(0.95, 1 - tolerance)))
        width = len(found) - last
        locked = block.select("id", "l")
        blocks = block.selectExpr("id", *[f"x[{i}] AS c{i}" for i in range(width)])
    if largest > tolerance:
        warnings.warn(f"spectral_embedding: no gain in {STALLED} rounds, residual {largest:.3g}, tolerance {tolerance:.3g}", stacklevel=3)
    kept = len(values) - 1
    # The trivial vector is sqrt(degree / total).
    scaled = block.select("id", F.transform(F.slice("l", 2, kept), lambda x: x / (F.element_at("l", 1) * F.lit(total**0.5))).alias("z"))
    signs = F.array(*[F.lit(s) for s in _largest_signs(scaled, kept)])
    coords = scaled.select("id", F.zip_with("z", signs, lambda z, s: z * s).alias("z"))
    return SpectralSolution(coords, values[1:].tolist(), residuals[1:].tolist())


def _rotate(pair: DataFrame, width: int, known: int, inner: np.ndarray, rotation: np.ndarray, values: np.ndarray) -> DataFrame:
    """``(id, l, x, ax)``: the block made orthogonal to the locked vectors and turned; A l is taken as value * l."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, ax, l = (matrix(batch.column(c), n) for c, n in (("x", width), ("ax", width), ("l", known)))
                columns = [list_array(x @ rotation - l @ (inner @ rotation)), list_array(ax @ rotation - (l * values) @ (inner @ rotation))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("l"), *columns], names=["id", "l", "x", "ax"])

    kind = pair.schema["id"].dataType.simpleString()
    return pair.select("id", "l", "x", "ax").mapInArrow(turn, f"id {kind}, l array<double>, x array<double>, ax array<double>")


def _residual_norms(rotated: DataFrame, values: np.ndarray) -> np.ndarray:
    width = len(values)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                rest = matrix(batch.column("ax"), width) - matrix(batch.column("x"), width) * values
                total += (rest * rest).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], names=["dim", "square"])

    sums = rotated.select("x", "ax").mapInArrow(squares, "dim int, square double").groupBy("dim").agg(F.sum("square").alias("square"))
    norms = np.zeros(width)
    for r in sums.collect():
        norms[r["dim"]] = np.sqrt(r["square"])
    return norms


def _largest_signs(coords: DataFrame, k: int) -> list[float]:
    elements = coords.select("id", F.posexplode("z").alias("dim", "z"))
    largest = F.max_by("z", F.struct(F.round(F.abs("z"), 9), F.col("id")))
    rows = elements.groupBy("dim").agg(largest.alias("z")).collect()
    negative = {row["dim"] for row in rows if row["z"] < 0}
    return [-1.0 if i in negative else 1.0 for i in range(k)]


def _ritz(
    gram: np.ndarray, product: np.ndarray, inner: np.ndarray, cross: np.ndarray, values: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Rotation to Ritz vectors by falling value, after the locked vectors (``inner`` = L'X, ``cross`` = L'AX) are
    taken out; numerically dependent ones are left out."""
    gram = gram - inner.T @ inner
    product = product - inner.T @ cross - cross.T @ inner + inner.T @ (values[:, None] * inner)
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), np.finfo(float).tiny))
    gram = gram * np.outer(scale, scale)
    product = (product + product.T) / 2 * np.outer(scale, scale)
    weights, axes = np.linalg.eigh((gram + gram.T) / 2)
    keep = weights > 1e-10 * weights.max()
    whiten = axes[:, keep] / np.sqrt(weights[keep])
    found, vectors = np.linalg.eigh(whiten.T @ product @ whiten)
    order = np.argsort(-found)
    return scale[:, None] * (whiten @ vectors[:, order]), found[order]


def subspace_similarity(coords_a: DataFrame, coords_b: DataFrame) -> DataFrame:
    """``(angle, cosine)``: principal-angle cosines of two coordinate sets on their shared ids.

    Coordinates are centred first; three small Gram sums decide the rest.
    """
    ka, kb = dimension(coords_a, "z"), dimension(coords_b, "z")
    rows = (
        coords_a.select("id", F.col("z").alias("a"))
        .join(coords_b.select("id", F.col("z").alias("b")), "id")
        .withColumn("one", F.expr(ONE))
    )
    sums = collect_products(
        product_sums(
            rows,
            {"aa": ("a", "a"), "bb": ("b", "b"), "ab": ("a", "b"), "a": ("a", "one"), "b": ("b", "one"), "n": ("one", "one")},
            {"a": ka, "b": kb, "one": 1},
            {},
        ),
        {"aa": (ka, ka), "bb": (kb, kb), "ab": (ka, kb), "a": (ka, 1), "b": (kb, 1), "n": (1, 1)},
    )
    n = max(sums["n"][0, 0], 1.0)
    gram_a = sums["aa"] - sums["a"] @ sums["a"].T / n
    gram_b = sums["bb"] - sums["b"] @ sums["b"].T / n
    cross = sums["ab"] - sums["a"] @ sums["b"].T / n
    cosines = np.linalg.svd(
        _inverse_root(gram_a).T @ cross @ _inverse_root(gram_b), compute_uv=False
    )
    pairs = [(i, float(min(c, 1.0))) for i, c in enumerate(cosines)]
    return coords_a.sparkSession.createDataFrame(pairs, "angle int, cosine double")


def _inverse_root(gram: np.ndarray) -> np.ndarray:
    values, axes = np.linalg.eigh(gram)
    keep = values > 1e-10 * max(values.max(), 1e-300)
    return axes[:, keep] / np.sqrt(values[keep])


def orthonormality(coords: DataFrame, degrees: DataFrame) -> DataFrame:
    """``(deviation)``: largest off-diagonal of Z'DZ relative to its diagonal."""
    k = dimension(coords, "z")
    rows = coords.select("id", "z").join(degrees.select("id", "weighted_degree"), "id")
    gram = product_sums(rows, {"g": ("z", "z")}, {"z": k}, {"g": "weighted_degree"})
    diagonal = gram.filter("p = q").select("p", F.col("value").alias("dp"))
    other = diagonal.select(F.col("p").alias("q"), F.col("dp").alias("dq"))
    scaled = gram.join(F.broadcast(diagonal), "p").join(F.broadcast(other), "q")
    return scaled.agg(
        F.coalesce(
            F.max(
                F.when(
                    F.col("p") != F.col("q"), F.abs(F.col("value")) / F.sqrt(F.col("dp") * F.col("dq"))
                )
            ),
            F.lit(0.0),
        ).alias("deviation")
    )
