"""Near copies by SimHash and Golay keys, verified by the Jaccard similarity of word shingles.

Each distinct shingle set gets ``WORDS`` 64-bit SimHashes with seeds of their own. Two segments of 23 bits make up a table: each is decoded to
the codewords nearest to it and to its one-bit changes, about five, and each pair of codewords of the two segments is a key. A segment within 2
errors of its partner always shares a codeword with it, one with more errors often does; with ``TABLES`` tables a pair of similarity ``NUM / DEN`` that spreads
its errors evenly meets in one of them (the README states the measured recall). Candidates are verified exactly, so no link is false.

Rounds keep the number of pairs linear in that of the sets, also where many copies share many keys:

- first ``MERGES`` times, each set has one key per table (the codewords nearest to its segments) and carries its whole fingerprint; of the partners of other groups that
  fingerprints and sizes allow, the smallest and the nearest are verified, and groups grow. Large keys are cut into pieces, which loses nothing for good;
- then, with the groups found so far, the keys that hold sets of different groups that sizes and 32 bits allow are marked in a bitmap of all keys (12 MB). Only for these
  the fingerprints are shipped. In keys of at most ``small`` sets the pairs of different groups are candidates, each in the smallest key that both share.
  Larger keys with several groups are compared in blocks of bounded size that hold the sets themselves and write only links.

Candidates are verified on the whole sets, made again from the texts that are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldgraph.llm.components import components
from coldgraph.llm.golay import BITS, decode, fuzzy_keys, products
from coldgraph.llm.rows import column, text_of, with_row_digest
from coldgraph.llm.simhash import SEED, first_of_each
from coldgraph.session import materialize

WIDTH = 5
NUM, DEN = 4, 5
SMALL = 64
WORDS, TABLES = 5, 6
FAR, FAR_SKETCH = 64, 12  # of 320 and of 32 bits; two sets of the least similarity differ in 15 % on average, with a deviation of 2 %
BLOCK = 1_000_000  # shingles of one block
MAX_SLOT_BITS = 22  # at most so many words of 64 bits (32 MB) in the filter of asked texts
SEEN = 500_000
PIECE = 1_000_000  # rows of one key held at once
MERGES = 2
WINDOW = 256  # sets of one key compared with each other in a merging round
WIDE = [f"b{i}" for i in range(WORDS)]


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes (uint64) of the ``width``-word shingles; a shorter text is one shingle, no word: none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([h(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((h(joined[a:b], SEED) for a, b in spans), dtype=np.uint64, count=len(words) - width + 1))


def identity(found: np.ndarray) -> int:
    """Signed 64-bit digest of a shingle set."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


def alike(overlap: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sets of together ``sizes`` shingles that share ``overlap`` are similar enough."""
    return overlap * (NUM + DEN) >= NUM * sizes


def fingerprint_words(found: np.ndarray, words: int = WORDS) -> np.ndarray:
    """SimHashes (uint64) of a shingle set, one per seed."""
    out = np.zeros(words, dtype=np.uint64)
    for w in range(words):
        x = found ^ np.uint64((w + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(ones * 2 > len(found), bitorder="little").view(np.uint64)[0]
    return out


def segments(words: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` segments of 23 bits of each row of fingerprint words."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")[:, : count * BITS]
    return bits.reshape(len(words), count, BITS).astype(np.int64) @ (1 << np.arange(BITS))


def near_keys(words: np.ndarray, tables: int = TABLES) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): for each table the pairs of codewords of its two segments."""
    found = segments(words, 2 * tables)
    rows, keys = [], []
    for t in range(tables):
        row, x, y = products(len(words), fuzzy_keys(found[:, 2 * t]), fuzzy_keys(found[:, 2 * t + 1]))
        rows.append(row)
        keys.append(t << 24 | x << 12 | y)
    return np.concatenate(rows), np.concatenate(keys)


def centre_keys(words: np.ndarray, tables: int = TABLES) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): for each table the codewords nearest to its two segments."""
    found = decode(segments(words, 2 * tables))
    keys = np.stack([t << 24 | found[:, 2 * t] << 12 | found[:, 2 * t + 1] for t in range(tables)], axis=1)
    return np.repeat(np.arange(len(words)), tables), keys.ravel()


def _emit(keys_of, wide: bool, opened=None):
    """Of rows (fp, n, bits, label) one per key: (s, label, n, sketch), or with ``wide`` (s, id, n, label, fingerprint words); only of keys in the bitmap ``opened``."""
    names = ["s", "id", "n", "label", *WIDE] if wide else ["s", "label", "n", "sketch"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for a in range(0, batch.num_rows, 4_000):
                part = batch.slice(a, 4_000)
                words = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.uint64).reshape(-1, WORDS)
                row, key = keys_of(words)
                if opened is not None:
                    keep = _has(opened.value, key)
                    row, key = row[keep], key[keep]
                ids, sizes, labels = (part.column(i).to_numpy()[row] for i in (0, 1, 3))
                sizes = sizes.astype(np.int32)
                if wide:
                    columns = [ids, sizes, labels, *words.view(np.int64)[row].T]
                else:
                    columns = [labels, sizes, (words[:, -1] >> np.uint64(32)).astype(np.uint32).view(np.int32)[row]]
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), *map(pa.array, columns)], names)

    return run


def _has(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return (bitmap[keys >> 6] >> (keys & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _buckets(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(key, columns, whether it ends here) of rows sorted by the first column, keys with one row left out. A key of many rows comes in pieces."""
    held: list[np.ndarray] = []
    key, size, begun = None, 0, False
    for batch in stream:
        keys = batch.column(0).to_numpy()
        if not len(keys):
            continue
        every = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(1, batch.num_columns)])
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
        last = len(starts) - 1
        for j in np.flatnonzero((ends - starts > 1) | (np.arange(last + 1) == 0) | (np.arange(last + 1) == last)):
            if keys[starts[j]] != key:
                if size > 1 or begun:
                    yield key, np.concatenate(held, axis=1), True
                key, held, size, begun = keys[starts[j]], [], 0, False
            held.append(every[:, starts[j] : ends[j]].copy())
            size += ends[j] - starts[j]
            if size > PIECE:
                yield key, np.concatenate(held, axis=1), False
                held, size, begun = [np.zeros((len(every), 0), dtype=np.int64)], 0, True
    if held and (size > 1 or begun):
        yield key, np.concatenate(held, axis=1), True


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of sets (id, n, label, fingerprint words) of two sides, ``64 * WORDS + 1`` where they can't be similar enough or are one group."""
    d = sum(np.bitwise_count((a[k] ^ b[k]).view(np.uint64)).astype(np.int16) for k in range(3, 3 + WORDS))
    fit = alike(np.minimum(a[1], b[1]), a[1] + b[1]) & (a[2] != b[2]) & (d <= FAR)
    return np.where(fit, d, 64 * WORDS + 1)


def _partners(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, d) of wide rows sorted by key and id: for each set v of a key the smallest and the nearest set of other groups that it may be similar to."""
    for _, rows, _ in _buckets(stream):
        for a in range(0, rows.shape[1], WINDOW):
            part = rows[:, a : a + WINDOW] if a == 0 else np.concatenate([rows[:, :1], rows[:, a : a + WINDOW]], axis=1)
            if (part[2] == part[2, 0]).all():
                continue
            d = _apart(part[:, :, None], part[:, None, :])
            v = np.flatnonzero((d <= FAR).any(axis=0))
            if not len(v):
                continue
            u = np.concatenate([(d[:, v] <= FAR).argmax(axis=0), d[:, v].argmin(axis=0)])
            v = np.concatenate([v, v])
            new = np.unique(np.stack([u, v]), axis=1)
            columns = [part[0][new[0]], part[0][new[1]], d[new[0], new[1]].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["u", "v", "d"])


def _active(found: DataFrame) -> DataFrame:
    """(fp): the sets of the partners ``found``. Distances are mutual, so a set that is somebody's partner has partners in that key itself: v names all."""
    return found.select(F.col("v").alias("fp")).distinct()


def _open_keys(small: int):
    """Of rows (s, label, n, sketch) sorted by s the keys in which sets of different groups may be similar enough, or that have more than ``small`` sets of several groups."""

    def opened(rows: np.ndarray) -> np.ndarray:
        s, label, n, sketch = rows
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(s)]]))
        mixed = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
        found = [s[starts[mixed & (sizes > small)]]]
        rest = np.repeat(mixed & (sizes <= small), sizes)
        s, label, n, sketch = s[rest], label[rest], n[rest], sketch[rest]
        at = np.arange(len(s))
        for k in range(1, small):
            at = at[at + k < len(s)]
            at = at[s[at] == s[at + k]]
            if not len(at):
                break
            fit = (label[at] != label[at + k]) & alike(np.minimum(n[at], n[at + k]), n[at] + n[at + k])
            fit &= np.bitwise_count((sketch[at] ^ sketch[at + k]) & 0xFFFFFFFF) <= FAR_SKETCH
            found.append(s[at[fit]])
        return np.unique(np.concatenate(found))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = np.zeros((4, 0), dtype=np.int64), None
        for batch in chain(stream, [None]):
            rows, held = held, np.zeros((4, 0), dtype=np.int64)
            if batch is not None:
                more = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)])
                rows = np.concatenate([rows, more[:, more[0] != large]], axis=1)
                start = np.searchsorted(rows[0], rows[0, -1]) if rows.shape[1] else 0
                rows, held = rows[:, :start], rows[:, start:].copy()
                if held.shape[1] > PIECE:  # a key that goes on is known to be large
                    large, held = held[0, 0], np.zeros((4, 0), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.array([large], dtype=np.int32))], ["s"])
            if rows.shape[1] and len(keys := opened(rows)):
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32))], ["s"])

    return run


def key_bitmap(opened: DataFrame, tables: int) -> np.ndarray:
    """One bit for each of the 2^24 keys of each table, set for the keys (s) of ``opened``."""
    bit = F.expr("shiftleft(1L, s & 63)")
    got = opened.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    bitmap = np.zeros(tables << 18, dtype=np.uint64)
    bitmap[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return bitmap


def _pairs_apart(small: int, tables: int):
    """(s, u, v, n, label, rest) of wide rows sorted by key and id: the pairs with different labels that may be similar enough, in the smallest key they share,
    or with ``rest`` the sets (u) of a large key that has several labels."""
    names = ["s", "u", "v", "n", "label", "rest"]

    def first_shared(rows: np.ndarray, i: np.ndarray, j: np.ndarray, key: int) -> np.ndarray:
        used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        row, keys = near_keys(np.ascontiguousarray(rows[3:, used].T).view(np.uint64), tables)
        below = keys < key
        order = np.lexsort((keys[below], row[below]))
        row, keys = row[below][order], keys[below][order]
        cuts = np.searchsorted(row, np.arange(len(used) + 1))
        own = [set(keys[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return np.array([own[a].isdisjoint(own[b]) for a, b in zip(place[: len(i)], place[len(i) :], strict=True)], dtype=bool)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        broken = None  # key that comes in pieces
        for key, rows, whole in _buckets(stream):
            broken = key if not whole else broken
            if key == broken or rows.shape[1] > small:
                if key != broken and (rows[2] == rows[2, 0]).all():
                    continue
                m = rows.shape[1]
                columns = [np.full(m, key), rows[0], rows[0], rows[1], rows[2], np.ones(m, dtype=bool)]
            else:
                i, j = np.triu_indices(rows.shape[1], 1)
                d = _apart(rows[:, i], rows[:, j])
                # keys are marked by 32 bits: other pairs may have smaller keys that are not marked
                keep = (d <= FAR) & (np.bitwise_count((rows[-1, i] ^ rows[-1, j]) >> 32 & 0xFFFFFFFF) <= FAR_SKETCH)
                i, j = i[keep], j[keep]
                if len(i):
                    keep = first_shared(rows, i, j, key)
                    i, j = i[keep], j[keep]
                columns = [np.full(len(i), key), rows[0, i], rows[0, j], rows[1, i], rows[2, i], np.zeros(len(i), dtype=bool)]
            if len(columns[0]):
                columns[0] = columns[0].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return run


def asked_sets(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, sh) of at least the sets of the texts whose digests are asked for (column th).

    A filter of about 16 bits a text, 32 MB at most, goes to the tasks; what it lets through besides only costs its set. Other texts are read, not cut into shingles.
    """
    count = asked.count()
    slots = max(10, min(MAX_SLOT_BITS, (max(1, count) * 16 // 64).bit_length()))
    word = F.col("th").bitwiseAND((1 << slots) - 1)
    bit = F.expr(f"shiftleft(1L, cast(shiftright(th, {slots}) & 63 as int))")
    got = asked.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    table = np.zeros(1 << slots, dtype=np.uint64)
    table[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, seen = shared.value, set()
        for batch in stream:
            th = batch.column(1).to_numpy()
            asked_here = t[th & ((1 << slots) - 1)] >> (th >> slots & 63).astype(np.uint64) & np.uint64(1)
            ids, sets, size = [], [], 0
            for r in np.flatnonzero(asked_here).tolist():
                if th[r] in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(th[r])
                found = shingles(batch.column(0)[r].as_buffer().to_pybytes())
                ids.append(identity(found))
                sets.append(found.tobytes())
                size += len(sets[-1])
                if size > 16_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "sh"])
                    ids, sets, size = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "sh"])

    return texts.select("__text", "th").mapInArrow(run, "id long, sh binary").dropDuplicates(["id"])


def _verify(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        keep = np.zeros(batch.num_rows, dtype=bool)
        for r, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep[r] = alike(both, len(x) + len(y))
        yield batch.select([0, 1]).filter(pa.array(keep))


def block_links(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all similar sets of a block whose labels differ."""
    sizes = np.array([len(x) for x in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    _, group, rows = np.unique(labels, return_inverse=True, return_counts=True)
    largest, links = rows.argmax(), []
    mark = np.zeros(len(values), dtype=np.int64)
    for q in np.flatnonzero(group != largest):
        own = flat[starts[q] : starts[q] + sizes[q]]
        mark[own] = 1
        near = (group != group[q]) & alike(np.add.reduceat(mark[flat], starts), sizes + sizes[q])
        mark[own] = 0
        for g in np.unique(group[near]):
            links.append((ids[q], ids[np.flatnonzero(near & (group == g))[0]]))
        group[np.isin(group, group[near])] = group[q]
    return links


def _block_linker(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (s, i, j, id, label, sh) sorted by the first three."""
    key, held = None, []

    def out() -> Iterator[pa.RecordBatch]:
        if len({h[1] for h in held}) > 1:
            links = block_links(np.array([h[0] for h in held]), np.array([h[1] for h in held]), [h[2] for h in held])
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["u", "v"])

    for batch in stream:
        keys = list(zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True))
        ids, labels = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        for k, i, label, sh in zip(keys, ids, labels, batch.column(5), strict=True):
            if k != key:
                yield from out()
                key, held = k, []
            held.append((i, label, np.frombuffer(sh.as_py(), dtype=np.uint64)))
    yield from out()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    a, b = sets.select(F.col("id").alias("u"), F.col("sh").alias("x")), sets.select(F.col("id").alias("v"), F.col("sh").alias("y"))
    links = pairs.join(a, "u").join(b, "v").select("u", "v", "x", "y").mapInArrow(_verify, "u long, v long")
    return materialize(links, "similar-links")


def _labels(ids: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``ids`` with the root of column ``name`` as ``label``."""
    roots = materialize(components(links), "similar-roots").select(F.col("node").alias(name), "root")
    return ids.join(roots, name, "left").withColumn("label", F.coalesce("root", name)).drop("root")


def similar_links(texts: DataFrame, marked: DataFrame, small: int = SMALL, block: int = BLOCK, tables: int = TABLES) -> DataFrame:
    """(u, v): links that join the distinct shingle sets of ``texts`` (columns __text, th) that meet and are similar enough.

    ``marked`` has their fp, n, bits (fingerprint) and th (digest of the text).
    """
    each = materialize(
        marked.where("n > 0").groupBy("fp").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("th").alias("th")), "similar-sets"
    )
    wide = "s int, id long, n int, label long, " + ", ".join(f"{b} long" for b in WIDE)

    def sets_of(ids: DataFrame) -> DataFrame:
        return materialize(asked_sets(texts, each.join(ids.distinct(), "fp", "left_semi").select("th")), "similar-sets")

    # Groups grow by the smallest and the nearest partner of each set.
    labelled, sets, links = each.select("fp", "n", "bits", F.col("fp").alias("label")), None, None
    for _ in range(MERGES):
        keyed = labelled.mapInArrow(_emit(lambda words: centre_keys(words, tables), True), wide)
        keyed = keyed.repartition("s").sortWithinPartitions("s", "id")
        found = materialize(keyed.mapInArrow(_partners, "u long, v long, d int"), "similar-partners")
        if sets is None:
            active = materialize(_active(found), "similar-active")
            sets = sets_of(active)
        best = found.groupBy("v").agg(F.min("u").alias("a"), F.min(F.struct("d", "u")).alias("b"))
        best = best.select("v", F.explode(F.array("a", "b.u")).alias("u"))
        more = _verified(best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), sets)
        links = more if links is None else links.unionByName(more)
        labels = materialize(_labels(each.select("fp", "n", "bits"), links, "fp"), "similar-labels")
        labelled = labels.join(active, "fp", "left_semi")
    # What that leaves apart: keys with several groups first, then their sets.
    keyed = labels.mapInArrow(_emit(lambda words: near_keys(words, tables), False), "s int, label long, n int, sketch int")
    opened = materialize(keyed.repartition("s").sortWithinPartitions("s").mapInArrow(_open_keys(small), "s int"), "similar-open")
    shared = texts.sparkSession.sparkContext.broadcast(key_bitmap(opened, tables))
    keyed = labels.mapInArrow(_emit(lambda words: near_keys(words, tables), True, shared), wide)
    keyed = keyed.repartition("s").sortWithinPartitions("s", "id")
    schema = "s int, u long, v long, n long, label long, rest boolean"
    found = materialize(keyed.mapInArrow(_pairs_apart(small, tables), schema), "similar-apart")
    pairs = found.where(~F.col("rest")).select("u", "v")
    rest = found.where("rest").select("s", F.col("u").alias("id"), "n", "label")
    sets = sets_of(pairs.select(F.explode(F.array("u", "v")).alias("fp")).unionByName(rest.select(F.col("id").alias("fp"))))
    links = links.unionByName(_verified(pairs, sets))
    if rest.isEmpty():
        return links
    apart = rest.groupBy("s").agg(F.sum("n").alias("__n"), F.min("label").alias("__a"), F.max("label").alias("__b")).where("__a != __b")
    parts = F.ceil(F.col("__n") / block).cast("long")
    cells = rest.join(apart.select("s", parts.alias("__parts")), "s")
    cells = cells.withColumn("__own", F.pmod(F.xxhash64("id"), F.col("__parts")))
    cells = cells.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)))
    cells = cells.select("s", F.least("__own", "__other").alias("i"), F.greatest("__own", "__other").alias("j"), "id", "label")
    cells = cells.join(sets, "id").select("s", "i", "j", "id", "label", "sh").repartition("s", "i", "j").sortWithinPartitions("s", "i", "j")
    more = materialize(cells.mapInArrow(_block_linker, "u long, v long").distinct(), "similar-links")
    return links.unionByName(more)


def identities(texts: DataFrame, keys: list[str]) -> DataFrame:
    """The columns ``keys`` of ``texts`` (with __text), fp long (digest of the shingle set), n long (its size) and bits binary (its fingerprint)."""
    source = texts.select(*[column(k) for k in keys], "__text")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            ids, sizes, bits = [], [], []
            for t in batch.column(len(keys)):
                found = shingles(t.as_buffer().to_pybytes())
                ids.append(identity(found))
                sizes.append(len(found))
                bits.append(fingerprint_words(found).tobytes())
            arrays = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *arrays], schema.names)

    schema = source.drop("__text").schema.add("fp", "long").add("n", "long").add("bits", "binary")
    return source.mapInArrow(run, schema)


def one_of_similar(
    docs: DataFrame, key: str = "doc_id", text: str = "text", small: int = SMALL, block: int = BLOCK, tables: int = TABLES
) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of texts joined by a similarity of ``NUM / DEN`` or more the one with the smallest key
    (nulls last), once.

    Null, empty and blank texts are one group; a text of fewer than ``WIDTH`` words is one shingle. Texts with equal shingle sets are always one group,
    repeated rows stay once, ties between equal keys go by a digest of the row. Very long texts are cut into shingles whole. All columns are kept, whatever their names. An
    empty table gives an empty result.
    """
    tagged = with_row_digest(docs)
    texts = tagged.select(column(key).alias("__key"), "__h1", "__h2", text_of(text).alias("__text"), F.xxhash64(text_of(text)).alias("th"))
    marked = materialize(identities(texts, ["__key", "__h1", "__h2", "th"]), "similar-ids")
    links = similar_links(texts, marked, small, block, tables)
    return first_of_each(tagged, marked.drop("n", "bits", "th"), components(links), "__key")
