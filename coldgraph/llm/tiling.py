"""Benchmark decontamination by greedy string tiling.

Texts become tokens: words in lower case without leading and trailing marks. A document and a test item are compared if they
share a run of ``seed`` tokens. Then the longest matches of unmarked tokens are marked first, then shorter
ones down to ``seed`` tokens; matches of a given length are found by Karp-Rabin hashes running over
the unmarked stretches and checked token by token. The share of an item's tokens that are marked is its coverage, whatever order
the passages stand in.

Documents are never moved: each task holds a block of items of at most ``block_words`` words and scans whole
texts. More items than that are handled in further blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldgraph.llm.rows import column, text_of
from coldgraph.llm.words import words_of

SEED_WORDS = 5
COVERAGE = 0.5
BLOCK_WORDS = 1_000_000
FIRST_LENGTH = 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def token(word: str) -> str:
    """Lower case, without marks at the ends; may be empty."""
    start, stop = 0, len(word)
    while start < stop and not word[start].isalnum():
        start += 1
    while stop > start and not word[stop - 1].isalnum():
        stop -= 1
    return word[start:stop].lower()


def token_hashes(distinct: list[bytes]) -> np.ndarray:
    """One uint64 for each word; 0 for words without a token."""
    found = np.zeros(len(distinct), dtype=np.uint64)
    for i, w in enumerate(distinct):
        t = token(w.decode("utf-8", "replace"))
        if t:
            found[i] = xxhash.xxh64_intdigest(t) | 1
    return found


def tokens(text: str) -> np.ndarray:
    h = token_hashes(text.encode().split())
    return h[h != 0]


def running(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each window of ``length`` tokens: a polynomial modulo 2^64, by doubling."""
    if len(h) < length:
        return np.zeros(0, dtype=np.uint64)
    total, have, power = np.zeros(len(h) + 1, dtype=np.uint64), 0, h
    n, base = 1, BASE
    rest = length
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:  # append a window of n tokens to the have tokens so far
                keep = len(h) - have - n + 1
                total = total[:keep] * base + power[have : have + keep]
                have += n
            rest >>= 1
            if rest:
                keep = len(power) - n
                power = power[:keep] * base + power[n : n + keep]
                base = base * base
                n *= 2
    return total[: len(h) - length + 1]


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    """For each window, whether none of its tokens is marked."""
    upto = np.concatenate([[0], np.cumsum(marked)])
    return upto[length:] == upto[:-length]


def _matches(p: np.ndarray, t: np.ndarray, mp: np.ndarray, mt: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(length, i, j): maximal equal runs of unmarked tokens of at least ``length``."""
    if len(p) < length or len(t) < length:
        return []
    hp, ht = running(p, length), running(t, length)
    i_free = np.flatnonzero(_free(mp, length))
    j_free = np.flatnonzero(_free(mt, length))
    j_free = j_free[np.isin(ht[j_free], hp[i_free])]
    if not len(j_free):
        return []
    at: dict[int, list[int]] = {}
    for i in i_free.tolist():
        at.setdefault(int(hp[i]), []).append(i)
    found = []
    for j in j_free.tolist():
        for i in at[int(ht[j])]:
            if i and j and p[i - 1] == t[j - 1] and not mp[i - 1] and not mt[j - 1]:
                continue  # part of a run that begins earlier
            most = min(len(p) - i, len(t) - j)
            same = (p[i : i + most] == t[j : j + most]) & ~mp[i : i + most] & ~mt[j : j + most]
            n = most if same.all() else int(np.argmin(same))
            if n >= length:
                found.append((n, i, j))
    return found


def tiles(p: np.ndarray, t: np.ndarray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """(i, j, length): non-overlapping equal passages of item tokens ``p`` and text tokens ``t``, longest first."""
    mp, mt = np.zeros(len(p), dtype=bool), np.zeros(len(t), dtype=bool)
    found = []
    length = max(least, min(FIRST_LENGTH, len(p)))
    while True:
        matches = _matches(p, t, mp, mt, length)
        longest = max((n for n, _, _ in matches), default=0)
        if longest > 2 * length:
            length = longest
            continue
        for n, i, j in sorted(matches, key=lambda x: (-x[0], x[1], x[2])):
            if not mp[i : i + n].any() and not mt[j : j + n].any():
                mp[i : i + n] = mt[j : j + n] = True
                found.append((i, j, n))
        if matches:
            continue  # what overlapped a longer tile may still hold a shorter one
        if length == least:
            return found
        length = max(least, length // 2)


@dataclass
class Block:
    """Tokens of some test items and an index of their seeds."""

    ids: list
    items: list[np.ndarray]
    seed: int
    coverage: float

    def __post_init__(self) -> None:
        grams = [running(x, self.seed) for x in self.items]
        flat = np.concatenate([np.zeros(0, dtype=np.uint64), *grams])
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        order = np.argsort(flat, kind="stable")
        self.seeds, self.owner = flat[order], owner[order]
        self.screen = np.zeros(1 << 20, dtype=bool)
        self.screen[(self.seeds >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple]]]:
        """(row, [(item id, item tokens, covered, tiles)]) for rows that cover an item."""
        for part in words_of(texts, False):
            ids = token_hashes(part.distinct)[part.ids] if len(part.ids) else np.zeros(0, dtype=np.uint64)
            full = ids != 0
            bounds = np.concatenate([[0], np.cumsum(full)])[part.bounds]
            flat = ids[full]
            grams = running(flat, self.seed)
            at = np.flatnonzero(self.screen[(grams >> np.uint64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.seeds, grams[at]), max(0, len(self.seeds) - 1))
            at = at[self.seeds[place] == grams[at]] if len(self.seeds) else at[:0]
            rows = np.searchsorted(bounds, at, side="right") - 1
            inside = at + self.seed <= bounds[rows + 1]
            at, rows = at[inside], rows[inside]
            for row in np.unique(rows).tolist():
                text = flat[bounds[row] : bounds[row + 1]]
                got = np.unique(grams[at[rows == row]])
                lo, hi = np.searchsorted(self.seeds, got), np.searchsorted(self.seeds, got, side="right")
                owners = np.unique(np.concatenate([self.owner[a:b] for a, b in zip(lo, hi, strict=True)]))
                found = []
                for o in owners.tolist():
                    item = self.items[o]
                    run = tiles(item, text, self.seed)
                    covered = sum(n for _, _, n in run)
                    if covered >= self.coverage * len(item):
                        found.append((self.ids[o], len(item), covered, len(run)))
                if found:
                    yield part.first + row, found


def blocks(benchmark: DataFrame, item: str, text: str, seed: int, coverage: float, block_words: int) -> Iterator[Block]:
    """Items by blocks of bounded size. Items of fewer than ``seed`` tokens can't be told from chance and are left out."""
    ids, items, size = [], [], 0
    for row in benchmark.select(column(item), text_of(text)).toLocalIterator():
        found = tokens(row[1])
        if len(found) < seed:
            continue
        if items and size + len(found) > block_words:
            yield Block(ids, items, seed, coverage)
            ids, items, size = [], [], 0
        ids.append(row[0])
        items.append(found)
        size += len(found)
    if items:
        yield Block(ids, items, seed, coverage)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    item: str = "item_id",
    text: str = "text",
    seed: int = SEED_WORDS,
    coverage: float = COVERAGE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(key, item, item_words, covered_words, tiles, coverage) for each row of ``docs`` and item it covers enough.

    Null and empty texts cover nothing; repeated rows and items give repeated results; an empty table gives
    an empty result.
    """
    source = docs.select(column(key), text_of(text).alias("__text"))
    kind = benchmark.schema[item].dataType
    schema = (
        docs.select(column(key)).schema.add(item, kind).add("item_words", "long").add("covered_words", "long").add("tiles", "long")
    )
    item_type = benchmark.select(column(item)).limit(0).toArrow().schema.field(0).type

    def scan(block: Block):
        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                rows, found = [], []
                for row, got in block.hits(batch.column(1)):
                    rows += [row] * len(got)
                    found += got
                if rows:
                    ids, *numbers = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), pa.array(ids, item_type), *[pa.array(x, pa.int64()) for x in numbers]],
                        schema.names,
                    )

        return run

    out = None
    for block in blocks(benchmark, item, text, seed, coverage, block_words):
        found = source.mapInArrow(scan(block), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumn("coverage", F.col("covered_words") / F.col("item_words"))


def uncontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    seed: int = SEED_WORDS,
    coverage: float = COVERAGE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows of ``docs`` that cover no item, with all columns, in one pass over the texts for each block."""
    schema, names = docs.schema, docs.columns

    def scan(block: Block):
        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                keep = np.ones(batch.num_rows, dtype=bool)
                for row, _ in block.hits(batch.column(len(names))):
                    keep[row] = False
                left = batch.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays(left.columns[: len(names)], names)

        return run

    for block in blocks(benchmark, item, text, seed, coverage, block_words):
        docs = docs.select("*", text_of(text).alias("__text")).mapInArrow(scan(block), schema)
    return docs
