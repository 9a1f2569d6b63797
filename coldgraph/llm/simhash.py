"""SimHash near copies with Golay keys.

A 64-bit fingerprint is cut into segments A, B (23 bits) and C (18 bits). Of at most 3 errors either one
segment is free of them, or each has exactly one:

- A exact with the fuzzy keys of B, B exact with those of C, C exact with those of A. One of the
  three holds whenever a segment is exact: the next one has at most 2 errors, or the third is exact as well.
- One error each: fuzzy keys of A and B together, with either half of C exact.

So no pair within 3 bits is lost. Equal fingerprints are collapsed first. Rows of (key, fingerprint) are
sorted by key; members of one key are linked by a search that compares each member only with those
not reached yet and writes a tree, never all pairs. Keys with more than ``bucket_rows`` members go another
exact way, linear in the members: two fingerprints within 3 bits have a word within 1 bit of the one and
2 of the other, and all fingerprints within 2 bits of that word are linked to the smallest within 1 bit of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldgraph.llm.components import components
from coldgraph.llm.golay import fuzzy_keys, products
from coldgraph.llm.rows import column, text_of, with_row_digest
from coldgraph.session import materialize

ERRORS = 3
BUCKET_ROWS = 20_000
SEED = 42


def fingerprint(text: bytes, width: int = 3) -> int:
    """Unsigned SimHash of the ``width``-word shingles of a text, repeats included; no word: 0."""
    words = text.lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        found = np.array([h(joined, SEED)], dtype="<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
        found = np.fromiter((h(joined[a:b], SEED) for a, b in spans), dtype="<u8", count=len(words) - width + 1)
    ones = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(found), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", width: int = 3) -> DataFrame:
    """The columns ``keys`` and fp long (the fingerprint's bits)."""
    source = docs.select(*[column(k) for k in keys], text_of(text).alias("__text"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = batch.column(len(keys))
            found = np.fromiter(
                (fingerprint(t.as_buffer().to_pybytes(), width) for t in texts), dtype=np.uint64, count=len(texts)
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keys)], pa.array(found.view(np.int64))], [*batch.schema.names[: len(keys)], "fp"]
            )

    schema = source.drop("__text").schema.add("fp", "long")
    return source.mapInArrow(run, schema)


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each fingerprint (uint64)."""
    n = len(fp)
    v = fp.astype(np.uint64)
    a = (v & np.uint64((1 << 23) - 1)).astype(np.int64)
    b = (v >> np.uint64(23) & np.uint64((1 << 23) - 1)).astype(np.int64)
    c = (v >> np.uint64(46)).astype(np.int64)
    ka, kb, kc = fuzzy_keys(a), fuzzy_keys(b), fuzzy_keys(c, 18)
    rows, keys = [], []

    def add(table: int, row: np.ndarray, *parts: tuple[np.ndarray, int]) -> None:
        key = np.full(len(row), table, dtype=np.int64)
        for value, bits in parts:
            key = key << bits | value
        rows.append(row)
        keys.append(key)

    add(1, kb[0], (a[kb[0]], 23), (kb[1], 12))
    add(2, kc[0], (b[kc[0]], 23), (kc[1], 12))
    add(3, ka[0], (c[ka[0]], 23), (ka[1], 12))
    row, x, y = products(n, ka, kb)
    add(4, row, (x, 12), (y, 12), (c[row] & 511, 11))
    add(5, row, (x, 12), (y, 12), (c[row] >> 9, 11))
    return np.concatenate(rows), np.concatenate(keys)


def reached(fps: np.ndarray, errors: int = ERRORS) -> np.ndarray:
    """For each fingerprint (uint64), the place of the first member of its group under links of ``errors`` bits."""
    root = np.full(len(fps), -1, dtype=np.int64)
    rest = np.arange(len(fps))
    while len(rest):
        start, rest = rest[0], rest[1:]
        root[start] = start
        queue = [start]
        while queue and len(rest):
            near = np.bitwise_count(fps[rest] ^ fps[queue.pop()]) <= errors
            if near.any():
                found, rest = rest[near], rest[~near]
                root[found] = start
                queue.extend(found.tolist())
    return root


def _emit_keys(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(fps), 20_000):
            part = fps[i : i + 20_000]
            row, key = golay_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], ["key", "fp"])


def _linker(bucket_rows: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None  # members of the last key so far
        size, hot = 0, False

        def out(a: list[np.ndarray], b: list[np.ndarray], rest: bool) -> pa.RecordBatch:
            a, b = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(b), pa.array(np.full(len(a), rest))], ["u", "v", "rest"]
            )

        def links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            root = reached(fps.view(np.uint64))
            linked = root != np.arange(len(fps))
            return fps[linked], fps[root[linked]]

        for batch in stream:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
            found_a, found_b, rest = [], [], []

            def close() -> None:
                if hot:
                    rest.extend(held)
                elif size > 1:
                    x, y = links(np.concatenate(held))
                    found_a.append(x)
                    found_b.append(y)

            last = len(starts) - 1
            for j in np.flatnonzero((ends - starts > 1) | (np.arange(last + 1) == 0) | (np.arange(last + 1) == last)):
                s, e = starts[j], ends[j]
                if keys[s] != key:
                    close()
                    held, size, hot, key = [], 0, False, keys[s]
                held.append(fps[s:e].copy())
                size += e - s
                if size > bucket_rows:
                    hot = True
                    rest.extend(held)
                    held = []
            if found_a:
                yield out(found_a, found_b, False)
            if rest:
                yield out(rest, rest, True)
        found_a, found_b, rest = [], [], []
        if hot:
            rest = held
        elif size > 1:
            x, y = links(np.concatenate(held))
            found_a, found_b = [x], [y]
        if found_a:
            yield out(found_a, found_b, False)
        if rest:
            yield out(rest, rest, True)

    return run


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def dense_links(fps: DataFrame) -> DataFrame:
    """(u, v) for fingerprints of crowded keys, through the words around them; linear in their number."""
    near = [0, *(1 << i for i in range(64))]
    far = [1 << i | 1 << j for i, j in combinations(range(64), 2)]

    def around(masks: list[int]) -> DataFrame:
        mask = F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in masks]))
        return fps.select("fp", mask.alias("__m")).select("fp", F.col("fp").bitwiseXOR(F.col("__m")).alias("w"))

    hubs = around(near).groupBy("w").agg(F.min("fp").alias("hub"))
    found = around(near).unionByName(around(far)).join(hubs, "w")
    return found.where(F.col("fp") != F.col("hub")).select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()


def fingerprint_links(fps: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(u, v): trees that join all distinct fingerprints (column fp) within 3 bits of each other."""
    keyed = fps.select("fp").mapInArrow(_emit_keys, "key long, fp long")
    found = materialize(
        keyed.repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_linker(bucket_rows), "u long, v long, rest boolean")
        .distinct(),
        "simhash-links",
    )
    links = found.where(~F.col("rest")).select("u", "v")
    crowded = found.where("rest").select(F.col("u").alias("fp")).distinct()
    if crowded.isEmpty():
        return links
    return links.unionByName(dense_links(crowded))


def simhash_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """One row per row of ``docs``: the key, fingerprint string (16 hex digits), component_id (the
    smallest key that links of at most 3 bits reach).

    Null and blank texts have the fingerprint zero, linked like any other. A null key stays null and takes the
    component of its text's group (null if no key there is known). Repeated rows and keys are kept. An empty table gives an
    empty result.
    """
    marked = materialize(fingerprints(docs, [key], text, width), "simhash-fp")
    return _grouped(marked, key, bucket_rows).select(
        column(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("__low").alias("component_id")
    )


def _grouped(marked: DataFrame, key: str, bucket_rows: int) -> DataFrame:
    """``marked`` (with fp) plus __low: the smallest key in each component."""
    groups = materialize(marked.groupBy("fp").agg(F.min(column(key)).alias("__low")), "simhash-groups")
    roots = materialize(components(fingerprint_links(groups, bucket_rows)), "simhash-roots")
    rooted = groups.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "__low", F.coalesce("root", "fp").alias("__root")
    )
    lows = rooted.groupBy("__root").agg(F.min("__low").alias("__least"))
    labels = rooted.join(lows, "__root").select(F.col("fp").alias("__fp"), F.col("__least").alias("__low"))
    return marked.join(labels, F.col("fp") == F.col("__fp")).drop("__fp")


def one_of_each(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest key (nulls last), once."""
    tagged = with_row_digest(docs)
    marked = materialize(fingerprints(tagged, [key, "__h1", "__h2"], text, width), "simhash-fp")
    groups = materialize(marked.groupBy("fp").agg(F.min(column(key)).alias("__low")), "simhash-groups")
    return first_of_each(tagged, marked, components(fingerprint_links(groups, bucket_rows)), key)


def first_of_each(tagged: DataFrame, marked: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """The rows of ``tagged`` with the smallest key of each group; ``marked`` has fp of each row, ``roots`` joins fps to groups."""
    rooted = marked.join(roots, F.col("fp") == F.col("node"), "left")
    first = F.struct(column(key).isNull(), column(key), "__h1", "__h2")
    kept = rooted.groupBy(F.coalesce("root", "fp").alias("__root")).agg(F.min(first).alias("__first"))
    kept = kept.select(F.col("__first.__h1").alias("__h1"), F.col("__first.__h2").alias("__h2"))
    repeated = marked.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    stay = tagged.join(kept, ["__h1", "__h2"], "left_semi")
    single = stay.join(repeated, ["__h1", "__h2"], "left_anti")
    again = stay.join(repeated, ["__h1", "__h2"], "left_semi").dropDuplicates(["__h1", "__h2"])
    return single.unionByName(again).drop("__h1", "__h2")
