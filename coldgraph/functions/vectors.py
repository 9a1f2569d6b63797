"""Column expressions and Arrow helpers for ``ARRAY<DOUBLE>`` vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 6
SUM_BLOCK = 16


def rounded(column: Column) -> Column:
    """Rounding rule of every distance and score: applied before ranking too."""
    return F.round(column, DIGITS)


def dimension(df: DataFrame, column: str) -> int:
    """Vector length, read from one row: all rows share it after ``load_nodes``."""
    row = df.select(F.size(column).alias("d")).first()
    if row is None:
        raise ValueError(f"no rows to take the length of {column} from")
    return row["d"]


def long_form(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """One row ``(keys, pos, value)`` per vector element, values rounded."""
    return df.select(*keys, F.posexplode(column).alias("pos", "value")).withColumn(
        "value", rounded(F.col("value"))
    )


def sum_vectors(
    df: DataFrame, key: str, column: str, d: int, weight: str | None, out: str, **extra: Column
) -> DataFrame:
    """``(key, out, extra...)``: element-wise sums of ``weight * column`` per key.

    Vectors are cut into blocks of ``SUM_BLOCK`` elements, and each block is summed
    as plain columns. Blocks combine map-side, unlike collected vectors, and the
    generated loop stays small enough for the JIT whatever the vector length.
    ``extra`` aggregates are taken once per key.
    """

    factor = "" if weight is None else f"`{weight}` * "
    counted = [c.alias(n) for n, c in extra.items()]
    if d <= SUM_BLOCK:
        sums = [F.expr(f"sum({factor}`{column}`[{i}]) AS s{i}") for i in range(d)]
        values = F.expr(f"array({', '.join(f's{i}' for i in range(d))})")
        return df.groupBy(key).agg(*sums, *counted).select(key, values.alias(out), *extra)
    blocks = ", ".join(
        f"struct({b} AS block, slice(`{column}`, {b * SUM_BLOCK + 1}, {SUM_BLOCK}) AS part)"
        for b in range(-(-d // SUM_BLOCK))
    )
    rest = [c for c in df.columns if c != column]
    return sum_blocks(df.select(*rest, F.expr(f"inline(array({blocks}))")), key, d, weight, out, **extra)


def sum_blocks(df: DataFrame, key: str, d: int, weight: str | None, out: str, **extra: Column) -> DataFrame:
    """``sum_vectors`` of vectors that come as rows ``(block, part)``, every block of a vector once."""
    factor = "" if weight is None else f"`{weight}` * "
    counted = [c.alias(n) for n, c in extra.items()]
    sums = [F.expr(f"sum({factor}get(part, {i})) AS s{i}") for i in range(SUM_BLOCK)]
    partial = df.groupBy(key, "block").agg(*sums, *counted)
    values = f"array({', '.join(f's{i}' for i in range(SUM_BLOCK))})"
    joined = partial.groupBy(key).agg(
        F.expr(f"array_sort(collect_list(struct(block, {values} AS values))) AS parts"),
        *[F.max(n).alias(n) for n in extra],
    )
    return joined.select(key, F.slice(F.flatten("parts.values"), 1, d).alias(out), *extra)


def matrix(array: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """Rows of an Arrow list column as a matrix, without per-row Python."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    values = array.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64, copy=False).reshape(len(array), d)


def list_array(rows: np.ndarray) -> pa.Array:
    n, d = rows.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * d)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).ravel()))


def map_vectors(
    df: DataFrame, column: str, d: int, fn: Callable[[np.ndarray], np.ndarray], out: str, *keys: str
) -> DataFrame:
    """Apply a matrix function to ``column`` batch by batch; works on streams too."""
    schema = ", ".join(
        f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys
    ) + f", `{out}` array<double>"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                result = list_array(fn(matrix(batch.column(column), d)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in keys), result], names=[*keys, out]
                )

    return df.select(*keys, column).mapInArrow(apply, schema)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(axis=1))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine similarity; 0 when either vector is zero."""
    norms = np.sqrt(_dots(a, a)) * np.sqrt(_dots(b, b))
    return np.where(norms > 0, _dots(a, b) / np.where(norms > 0, norms, 1.0), 0.0)


PAIR_SCORES = {
    "distance": lambda a, b: -_distances(a, b),
    "cosine": _cosines,
    "dot": _dots,
}


def score_pairs(df: DataFrame, a: str, b: str, how: str, keep: list[str]) -> DataFrame:
    """``(keep..., score)`` of two vector columns, a batch at a time in Arrow.

    Higher-order functions would walk the elements one by one outside the generated code.
    """
    score = PAIR_SCORES[how]
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = batch.column(a), batch.column(b)
            d = len(left[0])
            values = score(matrix(left, d), matrix(right, d)) + 0.0
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(np.round(values, DIGITS))],
                names=[*keep, "score"],
            )

    return df.select(*keep, a, b).mapInArrow(apply, schema + ", score double")


def product_sums(
    df: DataFrame, products: dict[str, tuple[str, str]], dims: dict[str, int], weight: dict[str, str]
) -> DataFrame:
    """Sums of outer products over all rows, one small matrix per name.

    For each ``name: (left, right)`` the rows give ``sum(w * left_p * right_q)``
    as ``(name, p, q, value)``. Every task adds up its rows with one matrix
    product per batch and emits a single partial per name, in packed matrix rows, so what is shuffled
    depends on the number of tasks and the dimensions, not on the rows. Matrix rows are spread
    over the tasks that add the partials up as they stream in.
    """
    columns = sorted({c for pair in products.values() for c in pair} | set(weight.values()))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {
            name: np.zeros((dims[a], dims[b])) for name, (a, b) in products.items()
        }
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = {
                c: matrix(batch.column(c), dims[c]) for pair in products.values() for c in pair
            }
            for name, (a, b) in products.items():
                left = blocks[a]
                if name in weight:
                    w = batch.column(weight[name]).to_numpy(zero_copy_only=False)
                    left = left * w[:, None]
                totals[name] += left.T @ blocks[b]
        for name, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(total)), pa.array(np.arange(len(total), dtype=np.int32)), list_array(total)],
                names=["name", "p", "parts"],
            )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            keys = zip(batch.column("name").to_pylist(), batch.column("p").to_pylist(), strict=True)
            for key, part in zip(keys, batch.column("parts"), strict=True):
                values = part.values.to_numpy()
                totals[key] = totals[key] + values if key in totals else values.copy()
        for (name, p), total in totals.items():
            n = len(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * n),
                    pa.array(np.full(n, p, dtype=np.int32)),
                    pa.array(np.arange(n, dtype=np.int32)),
                    pa.array(total),
                ],
                names=["name", "p", "q", "value"],
            )

    partials = df.select(*columns).mapInArrow(partial, "name string, p int, parts array<double>")
    return partials.repartition("name", "p").mapInArrow(add_up, "name string, p int, q int, value double")


def collect_products(sums: DataFrame, shapes: dict[str, tuple[int, int]]) -> dict[str, np.ndarray]:
    """Bring the summed matrices (dimension-sized, never row-sized) to the driver."""
    result = {name: np.zeros(shape) for name, shape in shapes.items()}
    for row in sums.collect():
        result[row["name"]][row["p"], row["q"]] = row["value"]
    return result
