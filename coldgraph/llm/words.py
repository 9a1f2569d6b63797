"""Words of whole texts in Arrow batches: each distinct word of a slice is touched once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 8_000_000


@dataclass
class Words:
    """Words of a slice of rows: row i has the words ``ids[bounds[i]:bounds[i + 1]]``."""

    first: int
    bounds: np.ndarray
    ids: np.ndarray
    distinct: list[bytes]

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; one row at least, so a row is never cut."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += int(size) + 1
    if start < len(sizes):
        yield start, len(sizes)


def words_of(texts: pa.Array, lower: bool, limit: int = SLICE_BYTES) -> Iterator[Words]:
    """Words are runs of bytes other than space and 0x09-0x0D; ``lower`` lower-cases A-Z. Null: none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for start, stop in slices(texts, limit):
        part = pc.fill_null(texts.slice(start, stop - start), "")
        if lower:
            part = pc.ascii_lower(part)
        listed = pc.ascii_split_whitespace(part)
        flat = listed.flatten()
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(listed).to_numpy(zero_copy_only=False))])
        full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        if not full.all():  # ends of a text that begin or end with a blank
            before = np.concatenate([[0], np.cumsum(full)])
            flat, bounds = flat.filter(pa.array(full)), before[bounds]
        coded = flat.dictionary_encode()
        yield Words(
            start,
            bounds.astype(np.int64),
            coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
            coded.dictionary.cast(pa.binary()).to_pylist(),
        )


def hashes(distinct: list[bytes], seed: int = 0) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, seed) for w in distinct), dtype=np.uint64, count=len(distinct))


def row_numbers(bounds: np.ndarray) -> np.ndarray:
    """For each word, the number of its row."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def batches(
    function: Callable[[pa.RecordBatch], pa.RecordBatch | None],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of one batch, for mapInArrow."""

    def each(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                out = function(batch)
                if out is not None:
                    yield out

    return each
