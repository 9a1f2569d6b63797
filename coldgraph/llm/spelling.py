"""Spelling variants: words one code point apart, found by a trie over letter-group counts.

Letters are dealt into groups, and a word becomes the vector of its counts per group. One replaced code point moves one
count up and one down, an inserted or deleted one moves a single count. The trie arranges words by successive counts. It is cut
at ``roots`` levels: each subtrie is a key of its own, so that Spark deals them out, and one task holds one at a time.

A word goes to the subtrie of its own first counts (``full``), and to those with one count less (``short``, with the group that gave
way). Two words within a budget of one surplus and one deficit meet at exactly one of these keys: full and full with the whole
budget left, full and short with one half of it spent, short and short of different groups with both spent. Below the
root a depth-first search spends what is left, and the words of the leaves it reaches are verified. Subtries of more than
``block`` words are cut into blocks; the words of a block also search the later ones.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldgraph.llm.rows import column
from coldgraph.session import materialize

MODULUS = 199
SHORTEST, LEAST = 6, 5
FACTOR = 5
GROUPS = 16
BLOCK = 20_000
LEAF = 4
HELD = 200_000  # distinct words a task counts before it hands them on
WHOLE = 4_000_000  # characters up to which the runs of a text are listed at once


def altered(run: str, start: int) -> str:
    """The run, without a code point where the rule says so; ``start`` is the crc32 of ``<doc_id>:``."""
    h = zlib.crc32(run.encode(), start)
    if h % MODULUS:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): the words of at least ``shortest`` code points with at least ``least`` occurrences in all texts."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{shortest},}}")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return found

        for batch in stream:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_buffer().to_pybytes().lower().decode("utf-8", "replace")
                start = zlib.crc32(f"{k}:".encode())
                found = runs.findall(t) if len(t) < WHOLE else (m.group() for m in runs.finditer(t))
                for word, n in Counter(found).items():
                    counts[altered(word, start)] += n
                if len(counts) > HELD:
                    yield out()
        if counts:
            yield out()

    source = docs.select(F.coalesce(column(key).cast("string"), F.lit("")), F.coalesce(column(text).cast("string"), F.lit("")))
    found = source.mapInArrow(run, "word string, n long").where(F.char_length("word") >= shortest)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> dict[str, int]:
    """Group of each letter: letters by frequency go to the group with the least so far. At most as many rows as letters reach the driver."""
    letter = F.explode(F.split("word", "")).alias("letter")
    counts = words.select(letter).groupBy("letter").agg(F.count(F.lit(1)).alias("n")).where("letter <> ''").orderBy(F.desc("n"), "letter").collect()
    load, group = [0] * groups, {}
    for r in counts:
        least = load.index(min(load))
        load[least] += r["n"]
        group[r["letter"]] = least
    return group


def vector(word: str, group: dict[str, int], groups: int) -> list[int]:
    counts = [0] * groups
    for c in word:
        counts[group.get(c, 0)] += 1
    return counts


def near(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    at = 0
    for x, y in zip(a, b):
        if x != y:
            break
        at += 1
    if len(a) == len(b):
        return at < len(a) and a[at + 1 :] == b[at + 1 :]
    return a[at:] == b[at + 1 :]


class Trie:
    """Words below one root, by the counts of successive groups; a leaf of few words is split only once it is full."""

    def __init__(self, depth: int):
        self.depth, self.root = depth, []

    def add(self, rest: list[int], entry: tuple) -> None:
        """``entry``: a tuple whose first item is ``rest``."""
        above, node, level = None, self.root, 0
        while isinstance(node, dict):
            above, c = node, rest[level]
            level += 1
            node = above.get(c)
            if node is None:
                node = above[c] = []
        node.append(entry)
        while len(node) > LEAF and level < self.depth:
            split: dict[int, list] = {}
            for e in node:
                split.setdefault(e[0][level], []).append(e)
            if above is None:
                self.root = split
            else:
                above[rest[level - 1]] = split
            above, node = split, split[rest[level]]
            level += 1

    def search(self, rest: list[int], surplus: int, deficit: int) -> Iterator[list]:
        """Leaves whose counts so far exceed those of ``rest`` by at most ``deficit``, or fall short of them by at most ``surplus``."""
        stack = [(self.root, 0, surplus, deficit)]
        while stack:
            node, level, s, d = stack.pop()
            if isinstance(node, list):
                yield node
                continue
            c = rest[level]
            if (child := node.get(c)) is not None:
                stack.append((child, level + 1, s, d))
            if s and (child := node.get(c - 1)) is not None:
                stack.append((child, level + 1, 0, d))
            if d and (child := node.get(c + 1)) is not None:
                stack.append((child, level + 1, s, 0))


class Subtrie:
    """The words of one block of a key. ``kind`` is the group whose count gave way, or -1."""

    def __init__(self, depth: int):
        self.full, self.short = Trie(depth), Trie(depth)

    def add(self, rest: list[int], kind: int, word: str, n: int) -> None:
        (self.full if kind < 0 else self.short).add(rest, (rest, kind, word, n))

    def search(self, rest: list[int], kind: int, word: str) -> Iterator[tuple[str, int]]:
        spent = kind >= 0
        for leaf in self.full.search(rest, 0 if spent else 1, 1):
            for _, _, other, n in leaf:
                if near(word, other):
                    yield other, n
        for leaf in self.short.search(rest, 0 if spent else 1, 0):
            for _, gave, other, n in leaf:
                if gave != kind and near(word, other):
                    yield other, n


def _emit_keys(group: dict[str, int], groups: int, roots: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            keys, kinds, words, counts = [], [], [], []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first = vector(word, group, groups)[:roots]
                for kind in (-1, *(i for i, c in enumerate(first) if c)):
                    if kind >= 0:
                        first[kind] -= 1
                    keys.append(",".join(map(str, first)))
                    if kind >= 0:
                        first[kind] += 1
                    kinds.append(kind)
                    words.append(word)
                    counts.append(n)
            for a in range(0, len(keys), 50_000):
                part = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[part]), pa.array(kinds[part], pa.int32()), pa.array(words[part]), pa.array(counts[part], pa.int64())],
                    ["key", "kind", "word", "n"],
                )

    return run


def _searcher(group: dict[str, int], groups: int, roots: int):
    """Near pairs of rows (key, block, guest, kind, word, n) sorted by the first three; guests search but don't stay."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, Subtrie(groups - roots)
        for batch in stream:
            a, na, b, nb = [], [], [], []
            rows = zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True)
            for k, block, guest, kind, word, n in rows:
                if (k, block) != key:
                    key, held = (k, block), Subtrie(groups - roots)
                rest = vector(word, group, groups)[roots:]
                for other, m in held.search(rest, kind, word):
                    a.append(word)
                    na.append(n)
                    b.append(other)
                    nb.append(m)
                if not guest:
                    held.add(rest, kind, word, n)
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(na, pa.int64()), pa.array(b), pa.array(nb, pa.int64())], ["a", "na", "b", "nb"]
                )

    return run


def root_levels(words: int, groups: int = GROUPS) -> int:
    """Levels above the cut: two more for each tenfold vocabulary, so that subtries keep their size."""
    return min(groups - 2, max(4, 2 * len(str(words)) - 4))


def near_pairs(words: DataFrame, roots: int | None = None, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """(a, na, b, nb): each pair of near words of ``words`` (word, n) once. ``words`` should be a written table."""
    roots = root_levels(words.count(), groups) if roots is None else roots
    group = letter_groups(words, groups)
    keyed = materialize(words.select("word", "n").mapInArrow(_emit_keys(group, groups, roots), "key string, kind int, word string, n long"), "spelling-keys")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    blocks = F.ceil(F.col("rows") / block).cast("int")
    own = F.pmod(F.xxhash64("word", "kind"), F.col("blocks").cast("long")).cast("int")
    dealt = keyed.join(sizes.select("key", blocks.alias("blocks")), "key").withColumn("own", own)
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)))
    dealt = dealt.select("key", "block", (F.col("block") != F.col("own")).alias("guest"), "kind", "word", "n")
    dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block", "guest")
    return dealt.mapInArrow(_searcher(group, groups, roots), "a string, na long, b string, nb long")


def followed(links: DataFrame, most: int, factor: int = FACTOR, least: int = LEAST) -> DataFrame:
    """(word, root): the last word that the forms of ``links`` (word, form) lead to.

    Each step multiplies the count by ``factor`` at least, so the longest way follows from the largest count, and
    doubling needs the logarithm of that.
    """
    steps, n = 0, least
    while n * factor <= most:
        steps, n = steps + 1, n * factor
    ways = links.select("word", F.col("form").alias("root"))
    reach = 1
    while reach < steps:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        ways, reach = materialize(ways, "spelling-ways"), reach * 2
    return ways


def variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST, factor: int = FACTOR,
    roots: int | None = None, groups: int = GROUPS, block: int = BLOCK,
) -> DataFrame:
    """word, form, root string; n, n_near, form_n long: one row per word.

    Null, empty and blank texts have no words. A null key counts as an empty one, repeated rows count each time, ties between
    forms go to the smallest word. A very long run is a word like any other. Other columns are not read. An empty table gives an empty result.
    """
    words = materialize(word_counts(docs, key, text, shortest, least), "spelling-words")
    pairs = near_pairs(words, roots, groups, block)
    other = F.struct((-F.col("m")).alias("less"), F.col("other").alias("form"))
    ends = F.array(
        F.struct(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("other"), F.col("nb").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("other"), F.col("na").alias("m")),
    )
    both = pairs.select(F.inline(ends)).select("word", "n", F.lit(1).cast("long").alias("near"), other.alias("best"))
    alone = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast(both.schema["best"].dataType).alias("best"))
    found = both.unionByName(alone).groupBy("word", "n").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    larger = -F.col("best.less") >= factor * F.col("n")
    found = found.select(
        "word", "n", "n_near", F.when(larger, F.col("best.form")).alias("form"), F.when(larger, -F.col("best.less")).alias("form_n")
    )
    found = materialize(found, "spelling-forms")
    most = words.agg(F.max("n")).first()[0] or 0
    ways = followed(found.where(F.col("form").isNotNull()), most, factor, least)
    found = found.join(ways, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
