"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0 to n - 1 in the order of their digests (128 bits over all columns), so the number does
not depend on files, partitions or retries. A Feistel network on the grid of a x b >= n cells, with additions modulo
a and b instead of XOR, permutes the cells; a place beyond n is permuted again until it falls below n
(cycle walking). Fewer than a of the places lie beyond n, and the longest walk among them is found
beforehand, so the expression has exactly the steps that are needed. Place p goes to shard p mod k, slot p div k: the law is ``rows``.

Everything is built-in Spark functions. Equal rows are counted map-side and expanded again after
numbering, so no copy group meets in one task.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coldgraph.llm.rows import column, distinct_rows, expand, with_row_digest
from coldgraph.session import materialize

PRIME = 2_147_483_647
BUCKET_ROWS = 250_000


class Permutation:
    """A keyed permutation of 0 to n - 1; computable for any single number."""

    def __init__(self, n: int, seed: int, rounds: int = 8):
        if n > 1 << 60:
            raise ValueError("too many rows")
        self.n = n
        self.a = max(1, math.isqrt(max(0, n - 1)) + 1)
        self.b = max(1, -(-n // self.a))
        draw = random.Random(seed)
        self.keys = [(draw.randrange(1, PRIME), draw.randrange(1, PRIME)) for _ in range(rounds)]

    def once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i, (k1, k2) in enumerate(self.keys):
            if i % 2:
                right = (right + self._mix(left, k1, k2)) % self.b
            else:
                left = (left + self._mix(right, k1, k2)) % self.a
        return left * self.b + right

    @staticmethod
    def _mix(v: int, k1: int, k2: int) -> int:
        t = (v + k1) % PRIME
        t = (t * t + k2) % PRIME
        return t * t % PRIME

    def place(self, number: int) -> int:
        p = self.once(number)
        while p >= self.n:
            p = self.once(p)
        return p

    def _once(self, x: Column) -> Column:
        """``x`` permuted once. A fold over the round keys, so the expression stays small however it is inlined."""

        def mix(v: Column, k: Column) -> Column:
            t = (v + k["k1"]) % PRIME
            t = (t * t + k["k2"]) % PRIME
            return t * t % PRIME

        def turn(s: Column, k: Column) -> Column:
            left, right = s["l"], s["r"]
            moved = F.struct(left.alias("l"), ((right + mix(left, k)) % self.b).alias("r"))
            other = F.struct(((left + mix(right, k)) % self.a).alias("l"), right.alias("r"))
            return F.when(k["odd"], moved).otherwise(other)

        keys = F.array(
            *[
                F.struct(F.lit(k1).cast("long").alias("k1"), F.lit(k2).cast("long").alias("k2"), F.lit(i % 2 == 1).alias("odd"))
                for i, (k1, k2) in enumerate(self.keys)
            ]
        )
        start = F.struct(F.call_function("div", x, F.lit(self.b).cast("long")).alias("l"), (x % self.b).alias("r"))
        return F.aggregate(keys, start, turn, lambda s: s["l"] * self.b + s["r"])

    def walk(self, spark: SparkSession) -> int:
        """Steps after the first that the longest walk takes. Only places n to a*b - 1 can need one."""
        if not self.n:
            return 0
        beyond, steps = spark.range(self.n, self.a * self.b), 0
        while not beyond.isEmpty():
            steps += 1
            beyond = beyond.select(self._once(F.col("id")).alias("id")).where(F.col("id") >= self.n)
        return steps

    def apply(self, number: Column, walk: int) -> Column:
        """The place of ``number``, with ``walk`` steps of cycle walking."""
        place = self._once(number)
        if not walk:
            return place
        steps = F.sequence(F.lit(1), F.lit(walk))
        return F.aggregate(steps, place, lambda p, _: F.when(p >= self.n, self._once(p)).otherwise(p))


def number_rows(spark: SparkSession, groups: DataFrame, n: int) -> DataFrame:
    """(__h1, __h2, __copies, __start): the number of the first row of each group of equal rows.

    Groups are dealt to buckets by digest; running totals inside the buckets and over the
    short table of buckets make the numbers gapless.
    """
    buckets = max(1, min(n, max(64, n // BUCKET_ROWS)))
    dealt = groups.withColumn("__b", F.pmod("__h1", F.lit(buckets)))
    totals = dealt.groupBy("__b").agg(F.sum("__copies").alias("__total"))
    before = totals.select(
        "__b",
        (F.sum("__total").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__total")).alias(
            "__before"
        ),
    )
    inside = Window.partitionBy("__b").orderBy("__h1", "__h2").rowsBetween(Window.unboundedPreceding, 0)
    return (
        dealt.withColumn("__upto", F.sum("__copies").over(inside))
        .join(before, "__b")
        .select("__h1", "__h2", "__copies", (F.col("__before") + F.col("__upto") - F.col("__copies")).alias("__start"))
    )


def shard(docs: DataFrame, shards: int, seed: int = 42) -> DataFrame:
    """All rows and columns of ``docs`` plus law string ('rows'), shard int and slot long.

    Shards differ by one row at most; slots run from 0 without a gap. Null keys, empty and long texts and
    repeated rows are rows like any other; an empty table gives an empty result. The same rows
    and seed give the same multiset of rows, in any layout.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = docs.sparkSession
    docs = docs.drop("law", "shard", "slot")
    tagged = with_row_digest(docs)
    groups = materialize(tagged.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__copies")), "shard-rows")
    n = groups.agg(F.sum("__copies")).first()[0] or 0
    permutation = Permutation(n, seed)
    placed = expand(
        distinct_rows(tagged, docs.columns).join(number_rows(spark, groups, n), ["__h1", "__h2"]), "__copies"
    )
    place = permutation.apply(F.col("__start") + F.col("__i"), permutation.walk(spark))
    placed = placed.withColumn("__place", place)
    return placed.select(
        *[column(c) for c in docs.columns],
        F.lit("rows").alias("law"),
        (F.col("__place") % shards).cast("int").alias("shard"),
        F.expr(f"__place div {shards}").alias("slot"),
    )


def document_size(text: str = "text") -> Column:
    """UTF-8 bytes (null: none) plus 16."""
    return (F.coalesce(F.octet_length(column(text)), F.lit(0)).cast("long") + 16).alias("size")
