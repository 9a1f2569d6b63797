"""Nearest neighbours, exact and approximate, and what they are worth.

Exact kNN has two plans with the same result:

* the base is small (its bytes are counted first): it is broadcast as one matrix
  and every query batch is compared with it in a narrow map;
* otherwise the base is cut into cells around pivots, in two levels: every row goes to its nearest top pivot, and there
  to the nearest of that one's own cells, so it is measured against some of the pivots only and no list of cells has to fit
  into one place. Rounds of nearest cells bound each query's k-th distance; by the triangle inequality only cells that may hold something nearer are
  visited after that. Cells are cut into blocks on both sides, so that no task holds more than two blocks.

Equal vectors are collapsed before the second plan: of a group of copies only the
k + 1 smallest ids can be among the k nearest of anything (ties go to the smaller
id), so a group holding a third of all rows costs no more than one row.

``knn_nested`` answers ``knn`` for nested splits of one table, a task per pair of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from coldgraph.functions.skew import HOT_ROWS, MAX_HOT, attach
from coldgraph.functions.vectors import DIGITS, dimension, list_array, matrix
from coldgraph.operators.graph import normalize_edges
from coldgraph.session import materialize

BROADCAST_BYTES = 64 * 1024 * 1024
CENTER_BYTES = 64 * 1024 * 1024
STEP_CELLS = 4_000_000
BLOCK_ROWS = 4096
PRODUCT_ROWS = 32_768
PRODUCT_CELLS = 2_000_000
TASK_PAIRS = 500_000_000
VISIT_BYTES = 16 * 1024 * 1024
VISIT_HITS = 2_000_000
PROBES = 4
METRICS = ("euclidean", "cosine")


# --- kernels (inside tasks) ---------------------------------------------------


def place(rows: np.ndarray, metric: str, side: str) -> np.ndarray:
    """Vectors whose squared distances order the metric.

    Cosine: unit vectors, |u - v|^2 = 2 - 2 cos. Zero vectors have cosine 0 with
    everything, so each side gets an axis of its own for them.
    """
    if metric == "euclidean":
        return rows
    norms = np.sqrt((rows * rows).sum(axis=1))
    zero = norms == 0
    extra = np.zeros((len(rows), 2))
    extra[zero, 0 if side == "query" else 1] = 1.0
    return np.hstack([rows / np.where(zero, 1.0, norms)[:, None], extra])


def finish(squares: np.ndarray, metric: str) -> np.ndarray:
    return np.round(np.sqrt(squares) if metric == "euclidean" else squares / 2, DIGITS)


def best_in_block(
    q_ids: np.ndarray, q: np.ndarray, b_ids: np.ndarray, b: np.ndarray, k: int, metric: str,
    skip_self: bool,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, base position, rounded distance) of the k best of each query.

    A matrix product gives all squared distances with small errors; every base row
    within the error of the k-th is measured again element by element.
    """
    found = []
    for first in range(0, len(b), PRODUCT_ROWS):
        own = slice(first, first + PRODUCT_ROWS)
        at, hit, dist = _best_in_part(q_ids, q, b_ids[own], b[own], k, metric, skip_self)
        found.append((at, first + hit, dist))
    if not found:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0)
    if len(found) == 1:
        return found[0]
    return _k_best(*(np.concatenate(x) for x in zip(*found, strict=True)), b_ids, len(q), k)


def _k_best(rows: np.ndarray, cols: np.ndarray, dist: np.ndarray, b_ids: np.ndarray, count: int, k: int):
    """The k first hits of each of ``count`` queries by (distance, base id), in this order."""
    order = np.lexsort((b_ids[cols], dist, rows))
    rows, cols, dist = rows[order], cols[order], dist[order]
    first = np.searchsorted(rows, np.arange(count))
    keep = np.arange(len(rows)) - first[rows] < k
    return rows[keep], cols[keep], dist[keep]


def _best_in_part(
    q_ids: np.ndarray, q: np.ndarray, b_ids: np.ndarray, b: np.ndarray, k: int, metric: str, skip_self: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b_norms = (b * b).sum(axis=1)
    out_q, out_b, out_d = [], [], []
    wanted = k + 1 if skip_self else k
    short = _Short.of(b, wanted)
    step = max(1, PRODUCT_CELLS // len(b))
    for start in range(0, len(q), step):
        part = q[start : start + step]
        norms = (part * part).sum(axis=1)
        slack = 1e-12 * (norms + b_norms.max())
        near = short.candidates(part, slack, wanted, metric) if short else None
        if near is None:
            short = None  # nor will it tell the next rows apart
        if near is not None:
            rows, cols = near
        elif len(b) > wanted:
            rough = np.maximum(norms[:, None] + b_norms[None, :] - 2 * part @ b.T, 0)
            kth = np.partition(rough, wanted - 1, axis=1)[:, wanted - 1]
            rows, cols = np.nonzero(rough <= _reach(kth, slack, metric)[:, None])
        else:
            rows, cols = (x.ravel() for x in np.indices((len(part), len(b))))
        delta = part[rows] - b[cols]
        dist = finish((delta * delta).sum(axis=1), metric)
        if skip_self:
            other = q_ids[start + rows] != b_ids[cols]
            rows, cols, dist = rows[other], cols[other], dist[other]
        rows, cols, dist = _k_best(rows, cols, dist, b_ids, len(part), k)
        out_q.append(start + rows)
        out_b.append(cols)
        out_d.append(dist)
    if not out_q:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_b), np.concatenate(out_d)


def _reach(kth: np.ndarray, error: np.ndarray, metric: str) -> np.ndarray:
    """Squares up to which a row may have the k-th rounded distance, if squares are off by ``error`` at most."""
    if metric == "cosine":  # half the square is rounded, not its root
        return kth + 2 * error + 4 * 10.0**-DIGITS
    return (np.sqrt(np.maximum(kth + error, 0)) + 2 * 10.0**-DIGITS) ** 2 + error


class _Short:
    """Base rows in single precision around their mean, which only chooses the rows to be measured.

    The k-th smallest of the minima of column groups is no less than the k-th smallest of all, so no row is sorted.
    """

    def __init__(self, center: np.ndarray, moved: np.ndarray, squares: np.ndarray, groups: int):
        self.center, self.groups, self.largest = center, groups, squares.max()
        self.table = np.zeros((moved.shape[1] + 1, -(-len(moved) // groups) * groups), dtype=np.float32)
        self.table[:-1, : len(moved)] = moved.T
        self.table[-1] = np.inf  # columns that fill up the last group are never near
        self.table[-1, : len(moved)] = squares

    @staticmethod
    def of(b: np.ndarray, wanted: int) -> _Short | None:
        """None for few rows, or for numbers that single precision can't hold."""
        groups = max(256, 8 * wanted)
        if len(b) < 16 * groups:
            return None
        with np.errstate(over="ignore", invalid="ignore"):
            center = b.mean(axis=0)
            moved = b - center
            squares = (moved * moved).sum(axis=1)
        if not 1e-20 < squares.max() < 1e20:  # false for nan, too
            return None
        return _Short(center, moved, squares, groups)

    def candidates(self, part: np.ndarray, slack: np.ndarray, wanted: int, metric: str) -> tuple[np.ndarray, np.ndarray] | None:
        """(row, column) of all that may be among the ``wanted`` nearest; None if they are too many to tell apart here."""
        with np.errstate(over="ignore", invalid="ignore"):
            moved = part - self.center
            norms = (moved * moved).sum(axis=1)
        if not norms.max() < 1e20:
            return None
        error = slack + 4 * (part.shape[1] + 4) * 2.0**-24 * (norms + self.largest)
        rough = np.hstack([-2 * moved, np.ones((len(moved), 1))]).astype(np.float32) @ self.table
        rough = rough.reshape(len(rough), -1, self.groups)
        least = rough.min(axis=1)
        kth = np.partition(least, wanted - 1, axis=1)[:, wanted - 1].astype(float) + norms
        limit = np.nextafter((_reach(kth, error, metric) - norms).astype(np.float32), np.float32(np.inf))
        rows, group = np.nonzero(least <= limit[:, None])
        if len(rows) > 8 * wanted * len(part):
            return None
        hit, inner = np.nonzero(rough[rows, :, group] <= limit[rows, None])
        return None if len(hit) > 16 * wanted * len(part) else (rows[hit], inner * self.groups + group[hit])


# --- exact --------------------------------------------------------------------


def knn(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    metric: str = "euclidean",
    column: str = "features",
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``neighbors(src, dst, rank, dist)``: the k nearest base nodes of every query.

    Never the query itself; order (rounded distance, dst); fewer than k base nodes
    give fewer rows. ``dist`` is Euclidean, or 1 - cosine.
    """
    index = NeighborIndex(base, k, metric, column, broadcast_bytes, block_rows)
    return index.nearest(queries, hot_rows)


def knn_nested(
    nodes: DataFrame, band: Column, k: int, metrics: Sequence[str], column: str = "features", block_rows: int = PRODUCT_ROWS
) -> DataFrame:
    """``(step, metric, src, dst, rank, dist)``: ``knn`` of nested splits of ``nodes``, from one pass over the pairs.

    A node of band b is in the base of the steps 0 to b - 1 and a query from step b on; rows of one id share a band, and a
    null band takes no part. So a query of band a and a base row of band c > a meet in the steps a to c - 1 and are measured once per metric for
    all of these; of each band, a query's k best decide. Both sides are cut by band into blocks of about ``block_rows``, and a pair of blocks is a
    task: what a task holds is bounded, and no row goes to the driver.
    """
    for metric in metrics:
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric}")
    spark, kind = nodes.sparkSession, _type(nodes, "id")
    given = nodes.select("id", F.col(column).alias("vector"), band.cast("int").alias("band")).where("band IS NOT NULL")
    # Rows are numbered, since ids may repeat.
    rows = materialize(given.withColumn("row", F.monotonically_increasing_id()), "banded")
    counts = {r["band"]: r["n"] for r in rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = {b: -(-n // block_rows) for b, n in counts.items()}
    pairs, tasks, handed = [], 0, 0
    for low in sorted(blocks):
        for high in sorted(b for b in blocks if b > low):
            pairs.append((low, high, tasks, blocks[low], blocks[high]))
            tasks += blocks[low] * blocks[high]
            handed += counts[low] * blocks[high] * len(metrics)
    if not pairs or not metrics:
        return spark.createDataFrame([], f"step int, metric string, src {kind}, dst {kind}, rank int, dist double")
    d = dimension(rows, "vector")
    known = F.broadcast(spark.createDataFrame(pairs, "low int, high int, first int, q_parts int, b_parts int"))
    parts = F.element_at(F.create_map(*[F.lit(x) for b, n in blocks.items() for x in (b, n)]), F.col("band"))
    cut = rows.withColumn("part", F.pmod(F.xxhash64("row"), parts.cast("bigint")).cast("int"))

    def side(end: str, others: str, task: Column) -> DataFrame:
        laid = cut.join(known, F.col("band") == F.col(end)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        return laid.select(task.cast("int").alias("task"), F.lit(end == "high").alias("base"), "low", "high", "row", "id", "vector")

    first, part, other = F.col("first"), F.col("part"), F.col("other")
    asked = side("low", "b_parts", first + part * F.col("b_parts") + other)
    base = side("high", "q_parts", first + other * F.col("b_parts") + part)
    schema = f"row bigint, src {kind}, low int, high int, metric string, hits array<struct<dist: double, dst: {kind}>>"
    found = asked.unionByName(base).repartitionById(tasks, "task").mapInArrow(_nearest_in_blocks(k, tuple(metrics), d), schema)
    # By row, both sums of hits need no other shuffle.
    found = found.repartition(-(-handed // block_rows), "row")
    best = F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits")
    per_band = found.groupBy("row", "src", "metric", "low", "high").agg(best)
    steps = per_band.withColumn("step", F.explode(F.sequence(F.col("low"), F.col("high") - 1)))
    nearest = steps.groupBy("row", "src", "metric", "step").agg(best)
    return nearest.select("step", "metric", "src", F.posexplode("hits").alias("pos", "hit")).select(
        "step", "metric", "src", F.col("hit.dst").alias("dst"), (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.dist").alias("dist")
    )


def _nearest_in_blocks(k: int, metrics: tuple[str, ...], d: int):
    """For a partition that is one block of queries and one of base rows: each query's k best by metric. Copies on either side are measured once."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, base, vectors, base_vectors = [], [], [], []
        for batch in batches:
            own = batch.filter(batch.column("base"))
            if own.num_rows:
                base.append(own.column("id"))
                base_vectors.append(matrix(own.column("vector"), d))
            own = batch.filter(pc.invert(batch.column("base")))
            if own.num_rows:
                asked.append(own.select(["row", "id", "low", "high"]))
                vectors.append(matrix(own.column("vector"), d))
        if not asked or not base:
            return
        queries = pa.Table.from_batches(asked).combine_chunks()
        q, of = np.unique(np.concatenate(vectors), axis=0, return_inverse=True)
        ids = pa.chunked_array(base).combine_chunks()
        b, b_ids = np.concatenate(base_vectors), ids.to_numpy(zero_copy_only=False)
        kept = _smallest_copies(b_ids, b, k)
        b, b_ids = b[kept], b_ids[kept]
        for metric in metrics:
            at, hit, dist = best_in_block(np.arange(len(q)), place(q, metric, "query"), b_ids, place(b, metric, "base"), k, metric, skip_self=False)
            pairs = pa.StructArray.from_arrays([pa.array(dist), ids.take(pa.array(kept[hit]))], names=["dist", "dst"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(len(q) + 1)).astype(np.int32)), pairs)
            yield pa.RecordBatch.from_arrays(
                [*(queries.column(c).combine_chunks() for c in ("row", "id", "low", "high")), pa.array([metric] * queries.num_rows), lists.take(pa.array(of.ravel()))],
                names=["row", "src", "low", "high", "metric", "hits"],
            )

    return nearest


def _collect_matrix(df: DataFrame, column: str, d: int) -> tuple[np.ndarray, np.ndarray]:
    """A table whose size the caller has checked, as ids and one matrix."""
    table = df.select("id", column).toArrow()
    return table.column("id").to_numpy(), matrix(table.column(column), d)


def _nearest_in_matrix(queries: DataFrame, shared, id_type, k: int, metric: str, column: str, d: int):
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b_ids, b = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            q_ids = batch.column("id").to_numpy(zero_copy_only=False)
            q = place(matrix(batch.column(column), d), metric, "query")
            at, hit, dist = best_in_block(q_ids, q, b_ids, b, k, metric, skip_self=True)
            rank = np.arange(len(at)) - np.searchsorted(at, at) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids[at]), pa.array(b_ids[hit]), pa.array(rank.astype(np.int32)), pa.array(dist)],
                names=["src", "dst", "rank", "dist"],
            )

    return queries.select("id", column).mapInArrow(nearest, _schema(queries, id_type))


def _schema(queries: DataFrame, id_type) -> str:
    source = queries.schema["id"].dataType.simpleString()
    return f"src {source}, dst {id_type.simpleString()}, rank int, dist double"


def _smallest_copies(ids: np.ndarray, vectors: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the ``keep`` smallest ids of every distinct vector."""
    _, group = np.unique(vectors, axis=0, return_inverse=True)
    group = group.ravel()
    order = np.lexsort((ids, group))
    first = np.searchsorted(group[order], np.arange(group.max() + 1))
    return order[np.arange(len(order)) - first[group[order]] < keep]


def _distances(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    squares = (rows * rows).sum(axis=1)[:, None] + (centers * centers).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(squares - 2 * rows @ centers.T, 0))


def _steps(rows: int, centers: int) -> Iterator[slice]:
    """Slices of rows whose distances to all centers fit in memory."""
    size = max(1, STEP_CELLS // centers)
    return (slice(i, i + size) for i in range(0, rows, size))


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _copies(df: DataFrame, column: str, keep: int) -> DataFrame:
    """``(vector, ids)``: distinct vectors with their ``keep`` smallest ids.

    The rank filter is pushed below the shuffle (window group limit), so a group
    of copies moves at most ``keep`` rows per task.
    """
    order = Window.partitionBy("vector").orderBy("id")
    ranked = df.select("id", F.col(column).alias("vector")).withColumn(
        "n", F.row_number().over(order)
    )
    return (
        ranked.filter(F.col("n") <= keep)
        .groupBy("vector")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )


def _lower_bounds(dist: np.ndarray, near: np.ndarray, far: np.ndarray, factor: float) -> np.ndarray:
    """Least distance of a cell's rows, which lie between ``near`` and ``far`` from its pivot, to points ``dist`` from it.

    ``factor`` is the largest cosine, seen from the pivot, of the angle between the point and a row that counts: 1 leaves nothing out.
    """
    r = np.clip(factor * dist, near, far)
    return np.sqrt(np.maximum(dist * dist + r * r - 2 * factor * dist * r, 0))


class CellTree:
    """Base rows in cells of two levels: top pivots, which the driver holds, and cells below each of them, which are a table.

    ``rows(bid, placed, cell, grp, ...)`` are the base rows, ``cells(top, cell, pivot, n, near, far, slot, grp)`` the filled cells with the range of their rows'
    distances from the pivot. What a task holds of a top's cells is their number below that top, about the square root of all.
    Neighbouring cells of a top form groups of about ``visit_rows`` rows. A query travels once to a group, with a list of the cells it asks for there, and
    comes back with the best of all of them: where nearly all cells are open to all queries, what moves follows the groups, not the cells.
    """

    def __init__(self, rows: DataFrame, count: int, d: int, width: int, metric: str, block_rows: int, cells: int | None = None):
        """``rows``: bid, vector and what is to be kept; ``count``: about how many."""
        self.spark, self.width, self.metric, self.block_rows = rows.sparkSession, width, metric, block_rows
        self.visit_rows = max(block_rows, min(8 * block_rows, VISIT_BYTES // (8 * width)))
        kept = [c for c in rows.columns if c not in ("bid", "vector")]
        wanted = cells or max(1, round(count**0.5), count // block_rows)
        most = CENTER_BYTES // (8 * width)
        # Read for the tops, the leaves and the cells: without a table, equal vectors would be sought three times.
        placed = materialize(_placed(rows, d, metric, "base"), "placed")
        # Pivots by the hash of the id: their expected number is fixed, and which they are changes no exact result.
        buckets = 1 << 40
        drawn = F.pmod(F.xxhash64("bid"), F.lit(buckets))
        share = lambda n: drawn < F.lit(int(buckets * min(1.0, n / count)))
        tops = min(most, max(1, round(wanted**0.5)))
        chosen = placed.where(share(tops)).select("placed").limit(2 * tops + 64).toArrow()
        if not chosen.num_rows:
            chosen = placed.select("placed").limit(1).toArrow()
        self.tops = np.unique(matrix(chosen.column("placed"), width), axis=0)
        self.shared_tops = self.spark.sparkContext.broadcast(self.tops)
        own = [(t, row.tolist()) for t, row in enumerate(self.tops)]
        leaves = self._with_top(placed.where(share(wanted)).select("placed")).select("top", F.col("placed").alias("pivot"))
        leaves = leaves.unionByName(self.spark.createDataFrame(own, "top int, pivot array<double>")).distinct()
        number = F.row_number().over(Window.partitionBy("top").orderBy("pivot")).cast("long")
        leaves = materialize(leaves.withColumn("cell", F.shiftleft(F.col("top").cast("long"), 32) + number), "leaves")
        leaves = leaves.withColumns({"near": F.lit(0.0), "far": F.lit(0.0), "slot": F.lit(0)})

        def home(batch: pa.RecordBatch, numbers: np.ndarray, pivots: np.ndarray, near: np.ndarray, far: np.ndarray, slots: np.ndarray) -> Iterator[pa.RecordBatch]:
            x = matrix(batch.column("placed"), width)
            for part in _steps(len(x), len(pivots)):
                dist = _distances(x[part], pivots)
                nearest = dist.argmin(axis=1)
                columns = [batch.column(c).slice(part.start, len(nearest)) for c in ("bid", *kept, "placed", "top", "top_reach")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(numbers[nearest]), pa.array(dist[np.arange(len(nearest)), nearest])],
                    names=["bid", *kept, "placed", "top", "top_reach", "cell", "reach"],
                )

        columns = ", ".join(f"{c} {_type(rows, c)}" for c in ("bid", *kept))
        in_tops = self._with_top(placed.select("bid", *kept, "placed"))
        schema = f"{columns}, placed array<double>, top int, top_reach double, cell bigint, reach double"
        homed = materialize(self._below_tops(in_tops, leaves, "bid", home, schema), "cells")
        stats = homed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("reach").alias("near"), F.max("reach").alias("far"))
        before = F.sum("n").over(Window.partitionBy("top").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
        slot = F.floor(F.coalesce(before, F.lit(0)) / self.visit_rows).cast("int")
        cells = leaves.drop("near", "far", "slot").join(stats, "cell").withColumn("slot", slot)
        self.cells = materialize(cells.withColumn("grp", F.shiftleft(F.col("top").cast("long"), 32) + F.col("slot")), "cell-stats")
        # Two numbers per cell, of which there are about the square root of the rows.
        self.rows = homed.join(F.broadcast(self.cells.select("cell", "grp")), "cell")
        self.filled = self.cells.count()
        spans = homed.groupBy("top").agg(F.min("top_reach").alias("near"), F.max("top_reach").alias("far")).collect()
        self.open_tops = np.array(sorted(r["top"] for r in spans))
        by_top = {r["top"]: (r["near"], r["far"]) for r in spans}
        self.spans = np.array([by_top[t] for t in self.open_tops])

    def _with_top(self, placed: DataFrame) -> DataFrame:
        """``placed`` rows with their nearest top pivot and the distance to it."""
        shared, width = self.shared_tops, self.width

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column("placed"), width)
                    top, reach = np.zeros(len(x), dtype=np.int32), np.zeros(len(x))
                    for part in _steps(len(x), len(shared.value)):
                        dist = _distances(x[part], shared.value)
                        top[part], reach[part] = dist.argmin(axis=1), dist.min(axis=1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(top), pa.array(reach)], names=[*batch.schema.names, "top", "top_reach"])

        kept = ", ".join(f"{c} {_type(placed, c)}" for c in placed.columns)
        return placed.mapInArrow(assign, f"{kept}, top int, top_reach double")

    def _below_tops(self, rows: DataFrame, cells: DataFrame, key: str, each, schema: str) -> DataFrame:
        """``each(rows of one top, its cells' numbers, pivots, near, far, slots)`` for all tops that ``rows`` name.

        Cells that fit into ``CENTER_BYTES`` together are broadcast and nothing is shuffled; else rows and cells meet by top, rows in blocks.
        """
        width, names = self.width, [f.split(" ")[0] for f in schema.split(", ")]
        count = cells.count()

        def unpack(table: pa.Table | pa.RecordBatch):
            order = np.argsort(table.column("cell").to_numpy(), kind="stable")
            return tuple(
                x[order]
                for x in (table.column("cell").to_numpy(), matrix(table.column("pivot"), width), *(table.column(c).to_numpy() for c in ("near", "far", "slot")))
            )

        if count * (width + 5) * 8 <= CENTER_BYTES:
            own = unpack(cells.select("cell", "pivot", "near", "far", "slot").toArrow())
            shared = self.spark.sparkContext.broadcast((own, own[0] >> 32))

            def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                own, tops = shared.value
                for batch in batches:
                    top = batch.column("top").to_numpy()
                    order = np.argsort(top, kind="stable")
                    cuts = np.flatnonzero(np.diff(top[order])) + 1
                    for part in np.split(order, cuts) if len(order) else []:
                        a, b = np.searchsorted(tops, [top[part[0]], top[part[0]] + 1])
                        yield from each(batch.take(pa.array(part)), *(x[a:b] for x in own))

            return rows.mapInArrow(narrow, schema)

        sizes = rows.groupBy("top").agg(F.count(F.lit(1)).alias("n"))
        parts = F.broadcast(sizes.select("top", F.ceil(F.col("n") / self.block_rows).cast("int").alias("parts")))  # one row per top
        left = rows.join(parts, "top").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts").cast("bigint")).cast("int")).drop("parts")
        right = cells.join(parts, "top").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

        def meet(own: pa.Table, below: pa.Table) -> pa.Table:
            found = []
            if own.num_rows and below.num_rows:
                batch = own.combine_chunks().to_batches()[0]
                found = list(each(batch, *unpack(below)))
            return pa.Table.from_batches(found) if found else target.empty_table()

        target = pa.schema([(n, _ARROW[f.split(" ", 1)[1]]) if f.split(" ", 1)[1] in _ARROW else (n, to_arrow_type(rows.schema[n].dataType)) for n, f in zip(names, schema.split(", "), strict=True)])
        grid = ["top", "part"]
        columns = [c for c in left.columns if c != "part"]
        grouped = left.groupBy(*grid).cogroup(right.select(*grid, "cell", "pivot", "near", "far", "slot").groupBy(*grid))
        return grouped.applyInArrow(lambda a, b: meet(a.select(columns), b), schema)

    def nearest_cells(self, asked: DataFrame, probes: int) -> DataFrame:
        """``(qid, grp, cells)``: about the ``probes`` nearest filled cells of each query, from the nearest tops."""
        some = min(len(self.open_tops), 2 + 2 * -(-probes * len(self.open_tops) // self.filled))
        shared, width = self.spark.sparkContext.broadcast((self.open_tops, self.tops[self.open_tops])), self.width

        def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, pivots = shared.value
            for batch in batches:
                x = matrix(batch.column("placed"), width)
                for part in _steps(len(x), len(pivots)):
                    near = np.argsort(_distances(x[part], pivots), axis=1, kind="stable")[:, :some]
                    rows = np.repeat(np.arange(part.start, part.start + len(near)), some)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.take(pa.array(rows)).columns, pa.array(numbers[near.ravel()].astype(np.int32))], names=["qid", "placed", "top"]
                    )

        def cells(batch: pa.RecordBatch, numbers: np.ndarray, pivots: np.ndarray, near: np.ndarray, far: np.ndarray, slots: np.ndarray) -> Iterator[pa.RecordBatch]:
            x = matrix(batch.column("placed"), width)
            groups = (numbers >> 32 << 32) + slots
            for part in _steps(len(x), len(pivots)):
                dist = _distances(x[part], pivots)
                first = np.argsort(dist, axis=1, kind="stable")[:, :probes]
                rows = np.repeat(np.arange(len(first)), first.shape[1])
                hits = first.ravel()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("qid").take(pa.array(part.start + rows)), pa.array(groups[hits]), pa.array(_below(numbers[hits])), pa.array(dist[rows, hits])],
                    names=["qid", "grp", "cell", "dist"],
                )

        kind = _type(asked, "qid")
        in_tops = asked.select("qid", "placed").mapInArrow(tops, f"qid {kind}, placed array<double>, top int")
        found = self._below_tops(in_tops, self.cells, "qid", cells, f"qid {kind}, grp bigint, cell int, dist double")
        order = Window.partitionBy("qid").orderBy("dist", "grp", "cell")
        nearest = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= probes)
        return nearest.groupBy("qid", "grp").agg(F.collect_list("cell").alias("cells"))

    def all_cells(self, asked: DataFrame) -> DataFrame:
        """``(qid, grp, cells)`` of every group for every query; no list means all cells."""
        groups = F.broadcast(self.cells.select("grp").distinct())
        return asked.select("qid").crossJoin(groups).withColumn("cells", F.lit(None).cast("array<int>"))

    def open_cells(self, bounded: DataFrame, factor: float = 1.0) -> DataFrame:
        """``(qid, grp, cells)``: cells that may hold a base row within a query's bound (column bound; null: all), by group."""
        shared, width, metric = self.spark.sparkContext.broadcast((self.open_tops, self.tops[self.open_tops], self.spans)), self.width, self.metric

        def limit(batch: pa.RecordBatch) -> np.ndarray:
            bound = batch.column("bound").to_numpy(zero_copy_only=False).astype(float)
            if metric == "cosine":
                bound = np.sqrt(2 * bound + 10.0**-DIGITS)
            return np.where(np.isnan(bound), np.inf, bound) + 2 * 10.0**-DIGITS

        def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, pivots, span = shared.value
            for batch in batches:
                x, bound = matrix(batch.column("placed"), width), limit(batch)
                for part in _steps(len(x), len(pivots)):
                    least = _lower_bounds(_distances(x[part], pivots), span[:, 0], span[:, 1], 1.0)
                    rows, top = np.nonzero(least <= bound[part, None])
                    yield pa.RecordBatch.from_arrays(
                        [*batch.take(pa.array(part.start + rows)).columns, pa.array(numbers[top].astype(np.int32))], names=["qid", "placed", "bound", "top"]
                    )

        def cells(batch: pa.RecordBatch, numbers: np.ndarray, pivots: np.ndarray, near: np.ndarray, far: np.ndarray, slots: np.ndarray) -> Iterator[pa.RecordBatch]:
            x, bound = matrix(batch.column("placed"), width), limit(batch)
            cuts = [0, *(np.flatnonzero(np.diff(slots)) + 1), len(slots)]
            for part in _steps(len(x), len(pivots)):
                within = _lower_bounds(_distances(x[part], pivots), near, far, factor) <= bound[part, None]
                for a, b in zip(cuts, cuts[1:]):
                    rows, cell = np.nonzero(within[:, a:b])
                    if len(rows):
                        first = np.flatnonzero(np.diff(rows, prepend=-1))
                        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(rows)).astype(np.int32)), pa.array(_below(numbers[a + cell])))
                        group = np.full(len(first), (numbers[a] >> 32 << 32) + slots[a])
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("qid").take(pa.array(part.start + rows[first])), pa.array(group), lists], names=["qid", "grp", "cells"]
                        )

        kind = _type(bounded, "qid")
        in_tops = bounded.select("qid", "placed", "bound").mapInArrow(tops, f"qid {kind}, placed array<double>, bound double, top int")
        return self._below_tops(in_tops, self.cells, "qid", cells, f"qid {kind}, grp bigint, cells array<int>")

    def visit(self, visits: DataFrame, asked: DataFrame, keep: int, hot_rows: int) -> DataFrame:
        """``(qid, bid, dist)``: the ``keep`` best of every ``(qid, grp, cells)`` visit, or as many more as its column ``extra`` says.

        Visits and base rows are laid out on a grid of (group, query block, base block): a full group is many tasks' work. Rows of cells that a
        query hasn't asked for may be among its hits.
        """
        width, metric, block = self.width, self.metric, self.visit_rows
        sizes = self.cells.groupBy("grp").agg(F.sum("n").alias("n"))
        counted = materialize(visits.groupBy("grp").agg(F.count(F.lit(1)).alias("v")).join(sizes, "grp"), "visited")
        parts = counted.select("grp", F.ceil(F.col("v") / block).cast("int").alias("q_parts"), F.ceil(F.col("n") / block).cast("int").alias("b_parts"))
        hot = {
            c: counted.where(F.col(c) > hot_rows).orderBy(F.desc(c)).limit(MAX_HOT)
            .select(F.col("grp").alias("key"), F.ceil(F.col(c) / hot_rows).cast("int").alias("copies")).collect()
            for c in ("v", "n")
        }
        extra = F.col("extra").cast("int") if "extra" in visits.columns else F.lit(0)
        left = attach(visits.select("qid", "grp", "cells", extra.alias("extra")), parts, "grp", ["qid"], hot=hot["v"], hot_rows=hot_rows)
        left = (
            left.withColumn("q_part", F.pmod(F.xxhash64("qid"), F.col("q_parts").cast("bigint")).cast("int"))
            .join(asked.select("qid", F.col("placed").alias("q")), "qid")
            .withColumn("b_part", F.explode(F.sequence(F.lit(0), F.col("b_parts") - 1)))
            .select("grp", "q_part", "b_part", "qid", "cells", "extra", "q")
        )
        low = F.col("cell").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("cell")
        right = attach(self.rows.select("bid", F.col("placed").alias("b"), low, "grp"), parts, "grp", ["bid"], hot=hot["n"], hot_rows=hot_rows)
        right = (
            right.withColumn("b_part", F.pmod(F.xxhash64("bid"), F.col("b_parts").cast("bigint")).cast("int"))
            .withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)))
            .select("grp", "q_part", "b_part", "bid", "cell", "b")
        )

        def compare(q_table: pa.Table, b_table: pa.Table) -> pa.Table:
            target = pa.schema([("qid", q_table.schema.field("qid").type), ("bid", b_table.schema.field("bid").type), ("dist", pa.float64())])
            if not q_table.num_rows or not b_table.num_rows:
                return target.empty_table()
            b_table = b_table.sort_by("cell")
            cells, starts = np.unique(b_table.column("cell").to_numpy(), return_index=True)
            cuts = np.append(starts, b_table.num_rows)
            q_ids, b_ids = q_table.column("qid").to_numpy(), b_table.column("bid").to_numpy()
            q, b = matrix(q_table.column("q"), width), matrix(b_table.column("b"), width)
            more = q_table.column("extra").to_numpy()
            lists = q_table.column("cells").combine_chunks()
            step = max(1, VISIT_HITS // (len(cells) * (keep + int(more.max()))))
            found = []
            for start in range(0, len(q), step):
                own = slice(start, start + step)
                at, hit, dist = _visited(q_ids[own], q[own], lists[own], b_ids, b, cells, cuts, keep + int(more[own].max()), metric)
                kept = np.arange(len(at)) - np.searchsorted(at, at) < keep + more[own][at]
                at, hit, dist = start + at[kept], hit[kept], dist[kept]
                found.append(pa.table([pa.array(q_ids[at], target.field("qid").type), pa.array(b_ids[hit], target.field("bid").type), pa.array(dist)], schema=target))
            return pa.concat_tables(found)

        grid = ["grp", "q_part", "b_part"]
        grouped = left.groupBy(*grid).cogroup(right.groupBy(*grid))
        return grouped.applyInArrow(compare, f"qid {_type(visits, 'qid')}, bid {_type(self.rows, 'bid')}, dist double")


def _below(numbers: np.ndarray) -> np.ndarray:
    """Numbers of cells below their top."""
    return (numbers & ((1 << 32) - 1)).astype(np.int32)


def _visited(
    q_ids: np.ndarray, q: np.ndarray, lists: pa.Array, b_ids: np.ndarray, b: np.ndarray, cells: np.ndarray, cuts: np.ndarray, k: int, metric: str
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best_in_block`` over the listed cells of each query (no list: all), base rows lying by cell within ``cuts``.

    If most are listed, one product over all of the base is cheaper, and right as well: it only adds rows.
    """
    values = lists.flatten().to_numpy()
    if lists.null_count or 2 * len(values) >= len(q) * len(cells):
        return best_in_block(q_ids, q, b_ids, b, k, metric, skip_self=False)
    sizes = np.diff(lists.offsets.to_numpy())
    asking, at, hit, dist = np.repeat(np.arange(len(q)), sizes), [], [], []
    for i, cell in enumerate(cells):
        own = asking[values == cell]
        if len(own):
            base = slice(cuts[i], cuts[i + 1])
            of, to, far = best_in_block(q_ids[own], q[own], b_ids[base], b[base], k, metric, skip_self=False)
            at.append(own[of])
            hit.append(cuts[i] + to)
            dist.append(far)
    if not at:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    at, hit, dist = np.concatenate(at), np.concatenate(hit), np.concatenate(dist)
    order = np.lexsort((b_ids[hit], dist, at))
    return at[order], hit[order], dist[order]


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}


def _placed(df: DataFrame, d: int, metric: str, side: str) -> DataFrame:
    """``df`` with ``placed`` instead of ``vector``."""
    kept = [c for c in df.columns if c != "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = place(matrix(batch.column("vector"), d), metric, side)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), list_array(rows)], names=[*kept, "placed"])

    schema = ", ".join(f"{c} {_type(df, c)}" for c in kept)
    return df.select(*kept, "vector").mapInArrow(run, f"{schema}, placed array<double>")


class NeighborIndex:
    """A base prepared for many ``nearest`` calls of up to ``k``: one broadcast matrix, or cells.

    ``block_rows`` bounds what a task holds of either side; ``cells`` overrides the number of cells.
    """

    def __init__(
        self,
        base: DataFrame,
        k: int,
        metric: str = "euclidean",
        column: str = "features",
        broadcast_bytes: int = BROADCAST_BYTES,
        block_rows: int = BLOCK_ROWS,
        cells: int | None = None,
    ):
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric}")
        self.k, self.keep, self.metric, self.column = k, k + 1, metric, column
        self.block_rows = block_rows
        self.spark = base.sparkSession
        self.id_type = base.schema["id"].dataType
        self.rows = base.count()
        self.matrix = None
        if self.rows == 0:
            return
        self.d = dimension(base, column)
        if self.rows * (self.d + 3) * 8 <= broadcast_bytes:
            ids, vectors = _collect_matrix(base, column, self.d)
            kept = _smallest_copies(ids, vectors, self.keep)
            self.matrix = self.spark.sparkContext.broadcast((ids[kept], place(vectors[kept], metric, "base")))
            return
        self.width = self.d + 2 if metric == "cosine" else self.d
        distinct = _copies(base, column, self.keep).withColumn("bid", F.element_at("ids", 1))
        self.tree = CellTree(distinct, self.rows, self.d, self.width, metric, block_rows, cells)

    def nearest(
        self, queries: DataFrame, hot_rows: int = HOT_ROWS, k: int | None = None
    ) -> DataFrame:
        """Exact ``neighbors`` of ``queries(id, column)``; ``k`` may be below the index's own."""
        k = self.k if k is None else k
        if k > self.k:
            raise ValueError(f"the index was built for k = {self.k}")
        if self.rows == 0:
            return self.spark.createDataFrame([], _schema(queries, self.id_type))
        if self.matrix is not None:
            return _nearest_in_matrix(
                self._spread(queries), self.matrix, self.id_type, k, self.metric, self.column, self.d
            )
        return self.probe(queries, PROBES, 1.0, hot_rows, k)

    def _spread(self, queries: DataFrame) -> DataFrame:
        """Queries in as many tasks as their distances ask for: a file of one row group would be the work of one."""
        tasks = -(-queries.count() * self.rows // TASK_PAIRS)
        return queries.repartition(tasks, "id") if tasks > 1 else queries

    def probe(
        self, queries: DataFrame, probes: int, factor: float | None = None, hot_rows: int = HOT_ROWS, k: int | None = None
    ) -> DataFrame:
        """``neighbors`` from the ``probes`` nearest cells of each query, four times as many in each further round while these hold fewer than
        k + 1 vectors; then from all cells whose bound (``_lower_bounds`` with ``factor``) is within the k-th distance found. Without a factor it ends there."""
        k = self.k if k is None else k
        if self.rows == 0:
            return self.nearest(queries)
        vectors = queries.groupBy(F.col(self.column).alias("vector")).agg(F.min("id").alias("qid"))
        asked = materialize(_placed(vectors.select("qid", "vector", F.col("vector").alias("own")), self.d, self.metric, "query"), "asked")
        best = search(self.tree, asked, lambda visits, part: _best(self.tree.visit(visits, part, k + 1, hot_rows), k + 1), k + 1, probes, factor)
        return self._answer(best, asked, queries, k, hot_rows)

    def _answer(self, best: DataFrame, asked: DataFrame, queries: DataFrame, k: int, hot_rows: int):
        """From distinct vectors back to ids."""
        named = attach(best, self.tree.rows.select("bid", "ids"), "bid", ["qid"], hot_rows=hot_rows)
        # Of vectors behind enough ids at smaller distances none can count.
        needed = named.withColumn("nearer", _sum_nearer(F.size("ids"))).where(F.col("nearer") <= k)
        hits = needed.select("qid", "dist", F.explode(F.slice("ids", 1, k + 1)).alias("dst"))
        hits = _ranked(hits, "qid", k + 1)
        ordered = F.array_sort(F.collect_list(F.struct("dist", "dst")))
        answers = hits.groupBy("qid").agg(ordered.alias("hits")).join(asked.select("qid", F.col("own").alias("vector")), "qid").select("vector", "hits")
        given = queries.select(F.col("id").alias("src"), F.col(self.column).alias("vector"))
        found = attach(_keyed(given), _keyed(answers), ["key", "vector"], ["src"], hot_rows=hot_rows)
        others = F.filter("hits", lambda h: h["dst"] != F.col("src"))
        return found.select("src", F.posexplode(F.slice(others, 1, k)).alias("pos", "hit")).select(
            "src",
            F.col("hit.dst").alias("dst"),
            (F.col("pos") + 1).cast("int").alias("rank"),
            F.col("hit.dist").alias("dist"),
        )


def _sum_nearer(value: Column) -> Column:
    """Of a query's hits, the sum of ``value`` over those at smaller distances."""
    up_to = Window.partitionBy("qid").orderBy("dist").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(value).over(up_to) - F.sum(value).over(Window.partitionBy("qid", "dist"))


def _ranked(hits: DataFrame, query: str, keep: int) -> DataFrame:
    order = Window.partitionBy(query).orderBy("dist", "dst")
    return hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep).drop("n")


def search(tree: CellTree, asked: DataFrame, visit, needed: int, probes: int, factor: float | None) -> DataFrame:
    """The best of ``asked(qid, placed)`` by ``visit(visits, asked)``, which gives the best rows (qid, ..., dist) of its visits, in rounds.

    A round that leaves queries with fewer than ``needed`` rows is followed by one of four times as many cells for these, up to all. Then each resumes within the radius it has: all cells
    whose bound is within its last distance.
    """
    found, left, resumed = None, asked, asked
    while True:
        every = probes >= tree.filled
        visits = materialize(tree.all_cells(left) if every else tree.nearest_cells(left, probes), "visits")
        now = materialize(visit(visits, left), "near")
        full = now
        if not every:
            enough = now.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= needed).select("qid")
            full = now.join(enough, "qid", "left_semi")
        found = full if found is None else found.unionByName(full)
        if every:
            resumed = None if left is asked else asked.join(left.select("qid"), "qid", "left_anti")
            break
        left = materialize(left.join(enough, "qid", "left_anti"), "left")
        if left.isEmpty():
            break
        probes *= 4
    found = materialize(found, "found")
    if factor is None or resumed is None:
        return found
    bound = found.groupBy("qid").agg(F.max("dist").alias("bound"))
    bounded = resumed.select("qid", "placed").join(bound, "qid")
    again = visit(materialize(tree.open_cells(bounded, factor), "visits"), asked)
    keys = [c for c in found.columns if c not in ("qid", "dist")]
    # Cells of the rounds are visited again with the others of their group, so a row may come twice.
    both = found.unionByName(again).groupBy("qid", *keys).agg(F.min("dist").alias("dist"))
    order = Window.partitionBy("qid").orderBy("dist", *keys)
    return materialize(both.withColumn("n", F.row_number().over(order)).where(F.col("n") <= needed).drop("n").select(*found.columns), "best")


class FreshIndex:
    """Nearest base nodes that aren't excluded, as rows: no list grows with the number of exclusions.

    Copies of a vector are collapsed in groups of about ``block_rows``, whose ids are a table of their own.
    """

    def __init__(self, base: DataFrame, metric: str = "euclidean", column: str = "features", block_rows: int = BLOCK_ROWS, hot_rows: int = HOT_ROWS, cells: int | None = None):
        self.metric, self.column, self.hot_rows = metric, column, hot_rows
        self.rows = base.count()
        self.id_type = base.schema["id"].dataType
        self.spark = base.sparkSession
        if not self.rows:
            return
        self.d = dimension(base, column)
        given = _keyed(base.select("id", F.col(column).alias("vector")))
        large = given.groupBy("key", "vector").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
        parts = F.ceil(F.col("n") / block_rows).cast("bigint")
        tagged = attach(given, materialize(large, "copies"), ["key", "vector"], ["id"], "left", hot_rows=hot_rows)
        tagged = tagged.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), parts), F.lit(0)))
        group = Window.partitionBy("key", "vector", "salt")
        members = tagged.select("id", "vector", F.min("id").over(group).alias("bid"), F.row_number().over(group.orderBy("id")).alias("place"))
        members = materialize(members, "members")
        sizes = members.groupBy("bid").agg(F.count(F.lit(1)).alias("size"))
        groups = members.where("place = 1").select("bid", "vector").join(sizes, "bid")
        self.members = members.select(F.col("id").alias("dst"), "bid", "place")
        self.tree = CellTree(groups, self.rows, self.d, self.d + 2 if metric == "cosine" else self.d, metric, block_rows, cells)

    def nearest(self, queries: DataFrame, excluded: DataFrame, k: int) -> DataFrame:
        """``(src, dst, rank, dist)``: the k nearest of each query but itself and its ``excluded(src, dst)``; ids of queries are distinct.

        A visit hands on as many rows beyond k as the query has excluded rows in that group of cells, so what moves is bounded by k per visit and the
        exclusions themselves; of those left, k are kept before the next round.
        """
        if not self.rows:
            return self.spark.createDataFrame([], _schema(queries, self.id_type))
        tree, hot_rows = self.tree, self.hot_rows
        vectors = queries.select(F.col("id").alias("qid"), F.col(self.column).alias("vector"))
        asked = materialize(_placed(vectors, self.d, self.metric, "query"), "asked")
        own = vectors.select(F.col("qid").alias("src"), F.col("qid").alias("dst"))
        barred = excluded.select("src", "dst").join(vectors.select(F.col("qid").alias("src")), "src", "left_semi").unionByName(own).distinct()
        barred = materialize(attach(barred, self.members.select("dst", "bid"), "dst", ["src"], hot_rows=hot_rows), "barred")
        in_cells = attach(barred, tree.rows.select("bid", "grp"), "bid", ["src"], hot_rows=hot_rows)
        extra = materialize(in_cells.groupBy(F.col("src").alias("qid"), "grp").agg(F.count(F.lit(1)).alias("extra")), "extra")
        in_group = barred.groupBy(F.col("src").alias("qid"), "bid").agg(F.count(F.lit(1)).alias("gone"))

        def visit(visits: DataFrame, part: DataFrame) -> DataFrame:
            hits = tree.visit(visits.join(extra, ["qid", "grp"], "left").fillna(0, ["extra"]), part, k, hot_rows)
            sized = attach(hits, tree.rows.select("bid", "size"), "bid", ["qid"], hot_rows=hot_rows).join(in_group, ["qid", "bid"], "left").fillna(0, ["gone"])
            free = F.least(F.col("size") - F.col("gone"), F.lit(k))
            wanted = sized.withColumn("nearer", _sum_nearer(free)).where(F.col("nearer") < k)
            named = attach(wanted, self.members, "bid", ["qid"], hot_rows=hot_rows).where(F.col("place") <= F.col("gone") + k)
            fresh = named.join(barred.select(F.col("src").alias("qid"), "dst"), ["qid", "dst"], "left_anti")
            return _ranked(fresh.select("qid", "dst", "dist"), "qid", k)

        best = search(tree, asked, visit, k, PROBES, 1.0)
        order = Window.partitionBy("qid").orderBy("dist", "dst")
        return best.select(F.col("qid").alias("src"), "dst", F.row_number().over(order).cast("int").alias("rank"), "dist")


def knn_approx(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    probes: int = 8,
    cells: int | None = None,
    metric: str = "euclidean",
    column: str = "features",
    block_rows: int = BLOCK_ROWS,
    hot_rows: int = HOT_ROWS,
    factor: float | None = None,
) -> DataFrame:
    """``neighbors`` from some cells of each query only: the ``probes`` nearest, then, with a ``factor``, those whose bound
    is within the k-th distance found.

    Every base row stays in reach through its own cell. ``factor`` = 1 or ``probes`` >= the number of cells is exact; a smaller factor
    leaves out cells in which only rows at an unlikely angle could be nearer. Queries whose cells hold fewer than k rows go on to more of them.
    """
    return NeighborIndex(base, k, metric, column, 0, block_rows, cells).probe(queries, probes, factor, hot_rows)


def knn_graph(nodes: DataFrame, k: int, metric: str = "euclidean", **options) -> DataFrame:
    """Feature-similarity graph; a mutual pair of neighbours has weight 2."""
    return normalize_edges(knn(nodes, nodes, k, metric, **options), "src", "dst")


# --- quality ------------------------------------------------------------------


def neighbor_quality(
    neighbors: DataFrame, truth: DataFrame, queries: DataFrame, base: DataFrame, k: int
) -> DataFrame:
    """``(queries, without_truth, precision, recall)`` of the first k neighbours.

    ``truth(src, dst)``; only true neighbours inside ``base`` count. Macro mean over
    the queries that have some.
    """
    inside = base.select(F.col("id").alias("dst"))
    true = attach(truth.select("src", "dst").distinct(), inside, "dst", ["src"], "left_semi")
    per_query = true.groupBy("src").agg(F.count(F.lit(1)).alias("true_count"))
    hit = neighbors.filter(F.col("rank") <= k).join(true, ["src", "dst"], "left_semi")
    hits = hit.groupBy("src").agg(F.count(F.lit(1)).alias("hits"))
    asked = (
        queries.select(F.col("id").alias("src"))
        .join(per_query, "src", "left")
        .join(hits, "src", "left")
    )
    has_truth = F.col("true_count").isNotNull()
    found = F.coalesce("hits", F.lit(0))
    return asked.agg(
        F.count_if(has_truth).alias("queries"),
        F.count_if(~has_truth).alias("without_truth"),
        F.avg(F.when(has_truth, found / F.lit(k))).alias("precision"),
        F.avg(F.when(has_truth, found / F.col("true_count"))).alias("recall"),
    )


def compare_spaces(
    spaces: dict[str, DataFrame],
    truth: DataFrame,
    query_ids: DataFrame,
    base_ids: DataFrame,
    k: int,
    **options,
) -> DataFrame:
    """One ``neighbor_quality`` row per space ``(id, z)``.

    A space learned from *all* edges has seen the queries' own truth: name it so,
    it is an upper bound.
    """
    result = None
    for name, coords in spaces.items():
        queries = coords.join(query_ids.select("id"), "id", "left_semi")
        base = coords.join(base_ids.select("id"), "id", "left_semi")
        found = knn(queries, base, k, column="z", **options)
        row = neighbor_quality(found, truth, query_ids, base_ids, k).select(
            F.lit(name).alias("space"), "*"
        )
        result = row if result is None else result.unionByName(row)
    if result is None:
        raise ValueError("no spaces to compare")
    return result


def augment_edges(edges: DataFrame, neighbors: DataFrame, weight: float = 1.0) -> DataFrame:
    """Known edges plus predicted ones, so that any graph method runs on cold nodes."""
    predicted = neighbors.select("src", "dst", F.lit(weight).alias("weight"))
    return normalize_edges(
        edges.select("src", "dst", "weight").unionByName(predicted), "src", "dst", "weight"
    )


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.xxhash64("vector"))


def _best(found: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best hits per query; at most ``keep`` per visited block come in."""
    order = Window.partitionBy("qid").orderBy("dist", "bid")
    ranked = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= keep)
    return ranked.drop("n")
