"""Arriving nodes: stateless inference, per-batch prediction, windowed statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from coldgraph.operators.classify import neighbor_vote
from coldgraph.operators.cluster import assign
from coldgraph.operators.neighbors import NeighborIndex
from coldgraph.operators.spectral import SpectralMap, apply_spectral_map
from coldgraph.session import new_path
from coldgraph.sources.tables import require

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, name: str) -> tuple[DataFrame, StreamingQuery]:
    """Run a stream over what its source holds now; the rows it appended, and the query."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/log")
        .trigger(availableNow=True)
        .start()
    )
    watch(query)
    return spark.read.schema(stream.schema).parquet(f"{path}/out"), query


def watch(query: StreamingQuery, seconds: float = 0.2) -> StreamingQuery:
    """Wait for the end of a query and note the late rows of every batch meanwhile: Spark itself remembers recent batches only."""
    query.late_by_batch = {}
    ended = False
    while not ended:
        ended = query.awaitTermination(seconds)
        query.late_by_batch.update(_late(query))
    return query


def _late(query: StreamingQuery) -> dict[int, int]:
    return {
        progress["batchId"]: sum(operator.get("numRowsDroppedByWatermark", 0) for operator in progress.get("stateOperators", []))
        for progress in query.recentProgress
    }


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped behind the watermark: over all batches of a watched query, else over the recent ones."""
    return sum((getattr(query, "late_by_batch", {}) | _late(query)).values())


def stream_embed(model: SpectralMap, nodes: DataFrame, *keep: str) -> DataFrame:
    """``(id, z, keep...)`` of arriving nodes: a narrow map, no state, no edges."""
    return apply_spectral_map(model, nodes, *keep)


def stream_predict(
    model: SpectralMap,
    nodes: DataFrame,
    base: DataFrame,
    labels: DataFrame,
    centers: KMeansModel,
    path: str,
    checkpoint: str,
    k: int = 10,
    **index_options,
) -> StreamingQuery:
    """Neighbours, class and cluster of each micro-batch against a warm snapshot ``base(id, z)``.

    The snapshot is indexed once, before the stream starts. Results are written below ``path`` as ``neighbors`` and ``predictions``, one folder per batch id that a
    repeated batch overwrites. The neighbours of new nodes are their recommended links.
    """
    require(base, "id", "z")

    index = NeighborIndex(base, k, column="z", **index_options)

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.dropDuplicates(["id"]).persist()  # a repeated id is one node
        coords = apply_spectral_map(model, batch)
        target = f"{path}/neighbors/batch={batch_id}"
        index.nearest(coords).write.mode("overwrite").parquet(target)
        found = batch.sparkSession.read.schema(
            "src bigint, dst bigint, rank int, dist double"
        ).parquet(target)
        (
            batch.select("id")
            .join(neighbor_vote(found, labels), "id", "left")
            .join(assign(centers, coords), "id", "left")
            .select("id", "pred", "cluster")
            .write.mode("overwrite")
            .parquet(f"{path}/predictions/batch={batch_id}")
        )
        batch.unpersist()

    return (
        nodes.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_degrees(edges: DataFrame, window: str, delay: str) -> DataFrame:
    """``(window_start, id, degree)`` per tumbling window of ``edges(src, dst, ts)``.

    Counts combine map-side; a window is emitted once the watermark has passed it, and
    rows behind the watermark are dropped (``late_rows`` counts them).
    """
    require(edges, "src", "dst", "ts")
    ends = edges.withWatermark("ts", delay).select("ts", F.explode(F.array("src", "dst")).alias("id"))
    counted = ends.groupBy(F.window("ts", window), "id").agg(F.count(F.lit(1)).alias("degree"))
    return counted.select(F.col("window.start").alias("window_start"), "id", "degree")


def _outer_edges(span_micros: int):
    """Keep, per batch, node and span of time, the first and the last edge.

    An interval of the span's length or more can't lie between two edges of one span without
    touching its first or last one, unless it holds none of them: no answer changes,
    and a hub hands two rows per span and batch to its join state.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("src").to_numpy(zero_copy_only=False)
            times = batch.column("edge_ts").cast(pa.int64()).to_numpy(zero_copy_only=False)
            spans = times // span_micros
            order = np.lexsort((times, spans, ids))
            change = (ids[order][1:] != ids[order][:-1]) | (spans[order][1:] != spans[order][:-1])
            first = np.concatenate([[True], change])
            last = np.concatenate([change, [True]])
            yield batch.take(pa.array(order[first | last]))

    return keep


def stream_cold_rate(
    nodes: DataFrame,
    edges: DataFrame,
    window: str,
    horizon_seconds: int,
    delay: str,
    slide: str | None = None,
) -> DataFrame:
    """``(window_start, arrivals, cold, rate)``: arrivals without an edge within the horizon.

    ``nodes(id, ts)``, ``edges(src, ts)``. A left-outer interval join keeps state for
    the horizon only; matches are folded per arrival before the windows are counted.
    """
    require(nodes, "id", "ts")
    require(edges, "src", "ts")
    arrivals = nodes.select("id", "ts", F.unix_micros("ts").alias("at")).withWatermark("ts", delay)
    contacts = edges.select("src", F.col("ts").alias("edge_ts"))
    outer = contacts.mapInArrow(_outer_edges(horizon_seconds * 1_000_000), contacts.schema)
    links = outer.withWatermark("edge_ts", delay)
    matched = arrivals.join(
        links,
        F.expr(f"id = src AND edge_ts >= ts AND edge_ts <= ts + INTERVAL {horizon_seconds} SECONDS"),
        "leftOuter",
    )
    per_arrival = matched.groupBy(F.window("ts", window, slide or window), "id", "at").agg(
        F.count("src").alias("links")
    )
    counted = per_arrival.groupBy("window").agg(
        F.count(F.lit(1)).alias("arrivals"), F.count_if(F.col("links") == 0).alias("cold")
    )
    return counted.select(
        F.col("window.start").alias("window_start"),
        "arrivals",
        "cold",
        F.round(F.col("cold") / F.col("arrivals"), 6).alias("rate"),
    )


# --- cold -> warm -------------------------------------------------------------

WARM_UP_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("degree", T.IntegerType()),
        T.StructField("ts", T.TimestampType()),
    ]
)


def _merged(times: list[int], min_degree: int) -> list[int]:
    """Sorted times, each at most ``min_degree`` times: more at one instant decide nothing."""
    times = sorted(times)
    return [t for i, t in enumerate(times) if i < min_degree or times[i - min_degree] != t]


def _needed(edges: list[int], arrivals: list[int], now: int, ttl_ms: int, min_degree: int) -> list[int]:
    """Sorted edge times that open or later arrivals can still need.

    Times before the watermark ``now`` are complete. Of these the latest ``min_degree`` suffice: an arrival that has as many in its ttl up to the watermark is
    warm at once or decided already, and one that has fewer has them among the latest. So a hub holds ``min_degree`` times and what lies above the watermark.
    """
    oldest = min([now, *arrivals[:1]]) - ttl_ms
    before = [t for t in edges if oldest <= t < now]
    return before[-min_degree:] + [t for t in edges if t >= now]


class _WarmUp(StatefulProcessor):
    """Per node: open arrivals, edge times they or later arrivals may need, and the end of the last decided ttl.

    Everything is decided by event time once the watermark has passed the instant of the
    decision, so the answer does not depend on how rows fall into batches.
    """

    def __init__(self, min_degree: int, ttl_ms: int):
        self.min_degree, self.ttl_ms = min_degree, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one state of all three: every call costs a trip to the JVM and back
        self.open = handle.getValueState("open", "arrivals array<bigint>, edges array<bigint>, closed bigint")

    def _held(self) -> tuple[list[int], list[int], int | None]:
        held = self.open.get()
        return (list(held[0]), list(held[1]), held[2]) if held is not None else ([], [], None)

    def _advance(self, key, arrivals: list[int], edges: list[int], closed: int | None, now: int) -> Iterator[pd.DataFrame]:
        """Decide what the watermark ``now`` has passed; keep the rest and set the next timer. All rows of a node come as one frame."""
        found, due = [], None
        arrivals = sorted(set(arrivals))
        while True:
            arrivals = [a for a in arrivals if closed is None or a > closed]
            if not arrivals:
                break
            arrival = arrivals[0]
            near = [t for t in edges if arrival - self.ttl_ms <= t <= arrival + self.ttl_ms]
            warm = len(near) >= self.min_degree
            due = max(arrival, near[self.min_degree - 1]) if warm else arrival + self.ttl_ms
            if due >= now:
                break
            found.append(("warm" if warm else "cold", self.min_degree if warm else len(near), due))
            closed, due = arrival + self.ttl_ms, None
        edges = _needed(edges, arrivals, now, self.ttl_ms, self.min_degree)
        if closed is not None and closed < now:
            closed = None
        if arrivals or edges or closed is not None:
            self.open.update((arrivals, edges, closed))
        else:
            self.open.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        wake = [x for x in (due, edges[-1] + self.ttl_ms if edges else None, closed) if x is not None]
        if wake:
            self.handle.registerTimer(max(now, due if due is not None else max(wake)) + 1)
        if found:
            yield self._rows(key, found)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrivals, edges, closed = self._held()
        for chunk in rows:
            ms = chunk["ts"].astype("datetime64[ms]").astype("int64")
            arrivals += ms[chunk["is_node"]].tolist()
            edges = _merged(edges + ms[~chunk["is_node"]].tolist(), self.min_degree)
        yield from self._advance(key, arrivals, edges, closed, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        arrivals, edges, closed = self._held()
        yield from self._advance(key, arrivals, edges, closed, timerValues.getCurrentWatermarkInMs())

    @staticmethod
    def _rows(key, found: list[tuple[str, int, int]]) -> pd.DataFrame:
        status, degree, ms = zip(*found, strict=True)
        return pd.DataFrame(
            {
                "id": [key[0]] * len(found),
                "status": status,
                "degree": np.array(degree, dtype=np.int32),
                "ts": pd.to_datetime(ms, unit="ms"),
            }
        )

    def close(self) -> None:
        pass


def _fewer_edges(min_degree: int):
    """Keep, per batch and node, the arrivals and at most ``min_degree`` edges of one millisecond."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            times = batch.column("ts").cast(pa.int64()).to_numpy(zero_copy_only=False) // 1000
            nodes = batch.column("is_node").to_numpy(zero_copy_only=False)
            order = np.lexsort((times, ids, nodes))
            new = np.ones(len(order), dtype=bool)
            for values in (ids, nodes, times):
                ranked = values[order]
                same = ranked[1:] == ranked[:-1]
                new[1:] = same & new[1:] if values is not ids else same
            new[1:] = ~new[1:]
            start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            kept = order[(np.arange(len(order)) - start < min_degree) | nodes[order]]
            yield batch.take(pa.array(np.sort(kept)))

    return keep


def stream_warm_up(
    nodes: DataFrame, edges: DataFrame, min_degree: int, ttl_seconds: int, delay: str
) -> DataFrame:
    """``(id, status, degree, ts)``: each arriving node once, when decided.

    An arrival is judged by the edges within the ttl before and after it: ``warm``, with degree
    ``min_degree``, at the ``min_degree``-th of them (at the arrival if that is later), else
    ``cold``, with their number, at the end of the ttl. A further arrival of the node within the ttl is the same arrival. Rows
    come out once the watermark has passed the decision, so they don't depend on the batches.
    State lives in RocksDB (this sets the session's state store) and is bounded by the ttl.
    """
    require(nodes, "id", "ts")
    require(edges, "src", "dst", "ts")
    spark = nodes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    arrivals = nodes.select(F.col("id").cast("bigint").alias("id"), "ts", F.lit(True).alias("is_node"))
    ends = edges.select(
        F.explode(F.array("src", "dst").cast("array<bigint>")).alias("id"), "ts", F.lit(False).alias("is_node")
    )
    rows = arrivals.unionByName(ends)
    fewer = rows.mapInArrow(_fewer_edges(min_degree), rows.schema)
    return (
        fewer.withWatermark("ts", delay)
        .groupBy("id")
        .transformWithStateInPandas(
            statefulProcessor=_WarmUp(min_degree, ttl_seconds * 1000),
            outputStructType=WARM_UP_SCHEMA,
            outputMode="Append",
            timeMode="EventTime",
        )
    )
