"""Weighted neighbour sums: the one graph step all others are made of."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldgraph.functions.skew import HOT_ROWS, hot_keys
from coldgraph.functions.vectors import SUM_BLOCK, sum_blocks, sum_vectors

PART_ROWS = 4_000_000
# Two are dealt out by key, so that the blocks of a step are tasks of their own; one would make all blocks one task.
FEW = 2
# Links per node from which a partition holds ``part_rows`` of them.
MANY_LINKS = 24
PARTITIONS = "spark.sql.shuffle.partitions"


def neighbor_sums(
    links: DataFrame, vectors: DataFrame, d: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``(id, sums, degree)``: sum of ``weight * x`` over a node's in-links.

    ``links(src, dst, weight)`` is directed, ``vectors(id, x)``. Sources without
    a vector don't count. The sums combine map-side before their shuffle, in as few tasks as the links allow.
    """
    table = LinkTable(links, hot_rows, least=FEW, kept=False)
    return table.sums(vectors, d, "sums", degree=F.sum("weight"))


class LinkTable:
    """Directed links laid out once by source and kept, for repeated steps.

    Node state arrives hashed on its id from the former step's aggregate, which is
    the layout the links have: the join of a step then needs no shuffle, only the
    partial sums move. The number of partitions follows from the number of links, so that one holds about ``part_rows`` of them
    at any size, or fewer where the number of ``nodes`` is given and these have few links; steps are run within ``layout()``, which makes the aggregates follow suit. Sources with
    more than ``hot_rows`` links (no more than ``part_rows``) are salted over several partitions. The kept blocks rest
    on a written or scanned table, so a lost executor only costs their recomputation. Links for one step needn't be ``kept``.
    """

    def __init__(
        self, links: DataFrame, hot_rows: int = HOT_ROWS, part_rows: int = PART_ROWS, least: int | None = None, kept: bool = True,
        nodes: int | None = None,
    ):
        spark = self._spark = links.sparkSession
        # A step moves up to a row per node and partition, so it moves less with ``least`` below the session's number.
        least = int(spark.conf.get(PARTITIONS)) if least is None else least
        hub = min(hot_rows, part_rows)
        counts = links.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
        total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        if nodes and total < MANY_LINKS * nodes:
            # A node's rows are as many as its links at most, however many partitions there are.
            part_rows = hub = max(1, min(hub, part_rows * total // (MANY_LINKS * nodes)))
        self.partitions = max(least, 1, -(-total // part_rows))
        hot = hot_keys(links, "src", hub) if most > hub else []
        self._copies = None
        keys = ["src"]
        if hot:
            schema = T.StructType(
                [links.schema["src"], T.StructField("copies", T.IntegerType())]
            )
            rows = [(r["key"], r["copies"]) for r in hot]
            self._copies = F.broadcast(spark.createDataFrame(rows, schema))
            spread = F.pmod(F.xxhash64("dst"), F.coalesce("copies", F.lit(1)).cast("bigint"))
            links = (
                links.join(self._copies, "src", "left")
                .withColumn("salt", spread.cast("int"))
                .drop("copies")
            )
            keys = ["src", "salt"]
        self._keys = keys
        if not kept:
            self._links = links.repartition(self.partitions, *keys)
            return
        laid_out = links.repartition(self.partitions, *keys).sortWithinPartitions(*keys)
        self._links = laid_out.persist(StorageLevel.MEMORY_AND_DISK)
        # Filled now: only a finished layout is known to the planner of the steps.
        self._links.count()

    @contextmanager
    def layout(self) -> Iterator[None]:
        """Plans made within deal their aggregates into as many partitions as the links have."""
        before = self._spark.conf.get(PARTITIONS)
        self._spark.conf.set(PARTITIONS, str(self.partitions))
        try:
            yield
        finally:
            self._spark.conf.set(PARTITIONS, before)

    def join(self, state: DataFrame) -> DataFrame:
        """Every link with the state row of its source (``id`` renamed to ``src``)."""
        return self._links.join(self._salted(state), self._keys)

    def _salted(self, state: DataFrame) -> DataFrame:
        state = state.withColumnRenamed("id", "src")
        if self._copies is None:
            return state
        copies = F.coalesce("copies", F.lit(1))
        return state.join(self._copies, "src", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")

    def sums(self, state: DataFrame, d: int, out: str = "x", by: str = "dst", **extra: Column) -> DataFrame:
        """``(id, out, extra...)``: sum of ``weight * x`` over the links of each value ``id`` of ``by``, with ``state(id, x)``.

        A task may hand on a row per node and block of columns, so fewer partitions move less. Every block is a branch of its own
        over the same links, which makes as many tasks as partitions times blocks.
        """
        kept = [F.col(by).alias("id"), "weight"]
        # dealt out here, not by the session's number; the source is left out behind the join, or the branches would share tasks
        if d <= SUM_BLOCK:
            near = self._salted(state.select("id", "x")).repartition(self.partitions, *self._keys)
            return sum_vectors(self._links.join(near, self._keys).select(*kept, "x"), "id", "x", d, "weight", out, **extra)
        branches = []
        for block in range(-(-d // SUM_BLOCK)):
            part = state.select("id", F.slice("x", block * SUM_BLOCK + 1, SUM_BLOCK).alias("part"))
            near = self._salted(part).repartition(self.partitions, *self._keys)
            branches.append(self._links.join(near, self._keys).select(*kept, F.lit(block).alias("block"), "part"))
        return sum_blocks(reduce(lambda a, b: a.unionAll(b), branches), "id", d, "weight", out, **extra)

    def release(self) -> None:
        self._links.unpersist()
