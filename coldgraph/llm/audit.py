"""Interaction of filters: what each step of every order of five filters removes.

A document is the set of filters it fails (a mask). In an order, the document goes at the first filter of its mask. The orders that
begin with given filters are neighbours in lexicographic order, an interval of Lehmer ranks. So for each mask, step and beginning
outside the mask, one interval of orders removes the mask's documents there. Counts of masks are added where an interval
begins and subtracted where it ends; a running total over the ranks gives every removal. Documents are counted once, whatever the number of orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coldgraph.functions.skew import HOT_ROWS, MAX_HOT, attach
from coldgraph.llm.rows import column, text_of
from coldgraph.llm.words import row_numbers, words_of
from coldgraph.session import materialize

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]  # place: Lehmer rank
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
SYMBOLS = b"#$%&*|"
COPY = 1 << FILTERS.index("E")


def intervals() -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last): the orders in which documents of the mask go at the step."""
    found = []
    n = len(FILTERS)
    for step in range(1, n + 1):
        width = factorial(n - step)
        for first in range(0, len(ORDERS), width):
            *before, last = (1 << FILTERS.index(f) for f in ORDERS[first][:step])
            rest = [m for m in range(1 << n) if m & last and not any(m & b for b in before)]
            found += [(mask, step, first, first + width) for mask in rest]
    return found


def own_masks(texts: pa.Array) -> np.ndarray:
    """Bits of the filters that look at one text only."""
    masks = np.zeros(len(texts), dtype=np.int32)
    symbols = np.zeros(256, dtype=bool)
    symbols[list(SYMBOLS)] = True
    for words in words_of(texts, lower=False):
        rows = row_numbers(words.bounds)
        n = np.diff(words.bounds)
        pairs = np.unique(rows * max(1, len(words.distinct)) + words.ids)
        distinct = np.bincount(pairs // max(1, len(words.distinct)), minlength=words.rows)
        part = pc.fill_null(texts.slice(words.first, words.rows), "")
        points = pc.utf8_length(part).to_numpy(zero_copy_only=False)
        sizes = pc.binary_length(part).to_numpy(zero_copy_only=False)
        flat = np.frombuffer(b"".join(t.as_buffer() for t in part), dtype=np.uint8)
        ends = np.cumsum(sizes.astype(np.int64))
        capitals = np.concatenate([[0], np.cumsum((flat >= ord("A")) & (flat <= ord("Z")))])
        marks = np.concatenate([[0], np.cumsum(symbols[flat])])
        capitals, marks = (c[ends] - c[ends - sizes] for c in (capitals, marks))
        bits = (n < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * n, 100 * capitals > CAPITAL_PERCENT * points, marks > 0)
        masks[words.first : words.first + words.rows] = sum(b.astype(np.int32) << i for i, b in enumerate(bits))
    return masks


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """__key, part, __mask, times: the distinct rows with the bits of the failed filters and how often they occur."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(own_masks(batch.column(4)))], names)

    source = docs.select(
        column(key).alias("__key"),
        F.coalesce(column(part).cast("string"), F.lit("")).alias("part"),
        F.xxhash64(text_of(text)).alias("__h1"),
        F.xxhash64(F.lit(1), text_of(text)).alias("__h2"),
        text_of(text).alias("__text"),
    )
    schema = source.drop("__text").schema.add("__mask", "integer")
    names = schema.names
    found = source.mapInArrow(run, schema).groupBy(names).agg(F.count(F.lit(1)).alias("times"))
    found = materialize(found, "audit-rows")
    # The smallest key of each text that has several; hot texts are salted.
    copies = found.groupBy("__h1", "__h2").agg(F.min("__key").alias("__low"), F.count(F.lit(1)).alias("__rows")).where("__rows > 1")
    copies = materialize(copies, "audit-copies")
    hot = copies.where(F.col("__rows") > HOT_ROWS).groupBy(F.col("__h1").alias("key")).agg(F.sum("__rows").alias("n"))
    hot = hot.orderBy(F.desc("n"), "key").limit(MAX_HOT).select("key", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("copies")).collect()
    found = attach(found, copies.drop("__rows"), ["__h1", "__h2"], ["__key"], "left", hot)
    copy = F.coalesce(F.col("__key") > F.col("__low"), F.lit(False))
    return found.select("__key", "part", (F.col("__mask") + F.when(copy, COPY).otherwise(0)).alias("__mask"), "times")


def mask_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, __mask, docs, good, toxic: at most 32 rows per part."""
    known = labels.where(column(key).isNotNull()).groupBy(column(key).alias("__key")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("__good"), F.max((F.col("toxic") == 1).cast("int")).alias("__toxic")
    )
    found = masked(docs, key, text, part).groupBy("__key", "part", "__mask").agg(F.sum("times").alias("times"))
    keyed = found.where("__key IS NOT NULL").join(known, "__key", "left")
    free = found.where("__key IS NULL").select("*", F.lit(None).cast("int").alias("__good"), F.lit(None).cast("int").alias("__toxic"))
    of = lambda flag: F.sum(F.when(F.col(flag) == 1, F.col("times")).otherwise(0))
    counted = keyed.unionByName(free).groupBy("part", "__mask")
    return counted.agg(F.sum("times").alias("docs"), of("__good").alias("good"), of("__toxic").alias("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, filter_order string; step int; kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley long: all
    120 orders and 5 steps of each part.

    Null texts are empty, a null part is the empty string. A null key is neither smaller nor larger than another, so its
    text is never a copy nor makes others one, and it has no labels. Rows with one key and text are no copies of each other. Of
    several labels of one key the largest counts. An empty table has no parts and gives an empty result; further columns aren't read.
    """
    spark = docs.sparkSession
    n, orders = len(FILTERS), len(ORDERS)
    counts = materialize(mask_counts(docs, labels, key, text, part), "audit-masks")
    ends = [(m, s, r, sign) for m, s, a, b in intervals() for r, sign in ((a, 1), (b, -1)) if r < orders]
    ends = F.broadcast(spark.createDataFrame(ends, "__mask int, step int, rank int, sign int"))
    sums = ("docs", "good", "toxic")
    changes = counts.join(ends, "__mask").select("part", "step", "rank", *[(F.col("sign") * F.col(c)).alias(c) for c in sums])
    fails = [F.sum(F.when(F.col("__mask").bitwiseAND(1 << i) != 0, F.col("docs")).otherwise(0)) for i in range(n)]
    alone = [F.sum(F.when(F.col("__mask") == 1 << i, F.col("docs")).otherwise(0)) for i in range(n)]
    # Of the orders, a document goes at each filter of its mask equally often.
    worth = [
        F.sum(F.when(F.col("__mask").bitwiseAND(1 << i) != 0, F.col("docs") * (orders / F.bit_count("__mask")).cast("long")).otherwise(0))
        for i in range(n)
    ]
    parts = counts.groupBy("part").agg(
        F.sum("docs").alias("all"), F.array(*fails).alias("fails"), F.array(*alone).alias("alone"), F.array(*worth).alias("worth")
    )
    cells = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    cells = cells.select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("rank"), *[F.lit(0).cast("long").alias(c) for c in sums])
    summed = changes.unionByName(cells).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in sums])
    run = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    removed = summed.select("part", "step", "rank", *[F.sum(c).over(run).alias(c) for c in sums])
    gone = F.sum("docs").over(Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    removed = removed.withColumn("gone", gone).join(parts, "part")
    order = F.element_at(F.array(*[F.lit(o) for o in ORDERS]), F.col("rank") + 1)
    place = F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1)))
    of = lambda name: F.element_at(name, place)
    return removed.withColumn("filter_order", order).select(
        "part", "filter_order", "step", (F.col("all") - F.col("gone")).alias("kept"), F.col("docs").alias("removed"),
        (of("fails") - F.col("docs")).alias("redundant"), of("alone").alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), of("worth").alias("shapley"),
    )
