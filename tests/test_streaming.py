import datetime as dt
import glob
import os

import numpy as np
import pandas as pd
import pytest

from coldgraph.operators import classify, cluster, graph, neighbors, spectral
from coldgraph.plans.catalog import QUERIES
from coldgraph.session import materialize, new_path
from coldgraph.sources.datasets import read_stream
from coldgraph.streaming import streams
from tests.conftest import SF, rows

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


@pytest.fixture
def source(spark, tmp_path):
    """A file stream: each list of rows is one file, read as one batch."""

    def build(name, schema, *files):
        folder = str(tmp_path / name)
        for i, part in enumerate(files):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
            for f in glob.glob(f"{folder}/*.parquet"):
                if os.path.getmtime(f) > START.timestamp() + len(files):
                    os.utime(f, (START.timestamp() + i,) * 2)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return build


@pytest.fixture(scope="module")
def fitted(planted):
    nodes, edges = planted
    split = graph.cold_split(nodes, edges, 0.2)
    return split, spectral.fit_spectral_map(split.warm_nodes, split.warm_edges, 6)


@pytest.fixture
def node_stream(spark, planted, tmp_path):
    nodes = planted[0]
    folder = str(tmp_path / "nodes")
    nodes.repartition(3).write.parquet(folder)
    return spark.readStream.schema(nodes.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_embed_equals_batch(planted, fitted, node_stream):
    _, model = fitted
    found, _ = streams.run_available(streams.stream_embed(model, node_stream), "embed")
    want = rows(spectral.apply_spectral_map(model, planted[0]))
    for (id_, z), (want_id, want_z) in zip(rows(found), want, strict=True):
        assert id_ == want_id and z == pytest.approx(want_z, abs=1e-9)


def test_predict_equals_batch(spark, planted, fitted, node_stream):
    split, model = fitted
    warm = materialize(spectral.apply_spectral_map(model, split.warm_nodes), "warm")
    labels = split.warm_nodes.select("id", "label")
    centers = cluster.fit_clusters(warm, 4)
    path = new_path(spark, "predict")
    query = streams.stream_predict(model, node_stream, warm, labels, centers, path, f"{path}-log", 5)
    query.awaitTermination()
    coords = spectral.apply_spectral_map(model, planted[0])
    near = neighbors.knn(coords, warm, 5, column="z")
    assert rows(spark.read.parquet(f"{path}/neighbors"), "src", "dst", "rank", "dist") == rows(near)
    want = classify.neighbor_vote(near, labels).join(cluster.assign(centers, coords), "id")
    assert rows(spark.read.parquet(f"{path}/predictions"), "id", "pred", "cluster") == rows(
        want, "id", "pred", "cluster")


EDGE = "src bigint, dst bigint, ts timestamp"


def test_degrees_drop_and_count_late_rows(source):
    stream = source(
        "edges", EDGE,
        [(1, 2, at(5)), (1, 3, at(20)), (1, 2, at(200))],
        [(1, 4, at(210))],
        # Behind the watermark (170) that the first batch set and the second used.
        [(4, 5, at(10)), (1, 2, at(500))])
    found, query = streams.run_available(streams.stream_degrees(stream, "60 minutes", "30 minutes"), "degrees")
    assert rows(found) == [
        (at(0), 1, 2), (at(0), 2, 1), (at(0), 3, 1), (at(180), 1, 2), (at(180), 2, 1), (at(180), 4, 1)]
    assert streams.late_rows(query) == 2


def test_cold_rate(source):
    nodes = source("arrivals", "id bigint, ts timestamp", [(1, at(1)), (2, at(2)), (3, at(70)), (9, at(1000))])
    edges = source("links", EDGE, [(1, 7, at(3)), (1, 8, at(4)), (2, 7, at(40)), (3, 1, at(60)), (5, 6, at(1000))])
    found, _ = streams.run_available(
        streams.stream_cold_rate(nodes, edges, "60 minutes", 1800, "10 minutes"), "rate")
    assert rows(found) == [(at(0), 2, 1, 0.5), (at(60), 1, 1, 1.0)]


def test_warm_up_over_several_batches(source):
    nodes = source(
        "arrivals", "id bigint, ts timestamp",
        [(1, at(0)), (2, at(0)), (3, at(5))], [(8, at(100))], [(9, at(1000))], [(10, at(2000))])
    edges = source(
        "links", EDGE,
        [(1, 50, at(1))] + [(1, 51, at(2))] * 40 + [(2, 50, at(3))],
        [(2, 60, at(40)), (3, 60, at(90)), (3, 61, at(95))],
        [(9, 3, at(1000))],
        [(70, 71, at(2000))])
    found, _ = streams.run_available(
        streams.stream_warm_up(nodes, edges, 2, 3600, "1 minute"), "warm-up")
    assert rows(found) == [
        (1, "warm", 2, at(2)), (2, "warm", 2, at(40)), (3, "cold", 0, at(65)), (8, "cold", 0, at(160)),
        (9, "cold", 1, at(1060))]


def test_warm_up_forgets_nothing_inside_the_ttl(source):
    """Edges before the ttl don't push out fresh ones, and a second arrival within it adds no row."""
    nodes = source("arrivals", "id bigint, ts timestamp", [(1, at(70)), (1, at(90)), (2, at(303)), (9, at(2000))])
    edges = source(
        "links", EDGE, [(1, 50, at(0)), (1, 50, at(1)), (1, 50, at(50)), (1, 50, at(51)), (2, 60, at(0)), (2, 60, at(1))])
    found, _ = streams.run_available(streams.stream_warm_up(nodes, edges, 2, 3600, "1 minute"), "warm-up")
    assert rows(found) == [(1, "warm", 2, at(70)), (2, "cold", 0, at(363))]


@pytest.mark.parametrize("files", ["one", "ten", "shuffled"])
def test_warm_up_does_not_depend_on_batches(source, files):
    import random

    draw = random.Random(4)
    arrivals = sorted(((draw.randrange(12), at(draw.randrange(3000))) for _ in range(60)), key=lambda r: r[1])
    links = sorted(((draw.randrange(12), 90 + draw.randrange(3), at(draw.randrange(3000))) for _ in range(300)), key=lambda r: r[2])
    arrivals, links = [*arrivals, (99, at(9000))], [*links, (98, 97, at(9000))]

    def cut(table):
        if files == "one":
            return [table]
        parts = [table[i * len(table) // 10 : (i + 1) * len(table) // 10] for i in range(10)]
        if files == "shuffled":
            parts = draw.sample(parts[:-1], 9) + parts[-1:]
        return parts

    nodes = source("arrivals", "id bigint, ts timestamp", *cut(arrivals))
    edges = source("links", EDGE, *cut(links))
    found, _ = streams.run_available(streams.stream_warm_up(nodes, edges, 3, 3600, "4 days"), "warm-up")
    want = []
    for node in {i for i, _ in arrivals}:
        closed = None
        for arrival in sorted(t for i, t in arrivals if i == node):
            if closed is not None and arrival <= closed:
                continue
            closed = arrival + dt.timedelta(hours=1)
            near = sorted(t for a, b, t in links if node in (a, b) and abs(t - arrival) <= dt.timedelta(hours=1))
            due = max(arrival, near[2]) if len(near) >= 3 else closed
            if due < at(9000) - dt.timedelta(days=4):
                want.append((node, "warm" if len(near) >= 3 else "cold", min(3, len(near)), due))
    assert want and rows(found) == sorted(want)


def test_predict_takes_a_repeated_id_once(spark, planted, fitted, tmp_path):
    split, model = fitted
    warm = materialize(spectral.apply_spectral_map(model, split.warm_nodes), "warm")
    folder = str(tmp_path / "again")
    some = planted[0].limit(4)
    some.unionByName(some).unionByName(some).coalesce(1).write.parquet(folder)
    path = new_path(spark, "predict")
    stream = spark.readStream.schema(planted[0].schema).parquet(folder)
    streams.stream_predict(
        model, stream, warm, split.warm_nodes.select("id", "label"), cluster.fit_clusters(warm, 3), path, f"{path}-log", 5
    ).awaitTermination()
    assert spark.read.parquet(f"{path}/predictions").count() == 4


def test_outer_edges_change_no_answer():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    ids, times = rng.integers(0, 3, 3000), rng.integers(0, 20_000, 3000)
    ids[:1500] = 0
    batch = pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(times).cast(pa.timestamp("us"))], names=["src", "edge_ts"])
    horizon = 100
    (kept,) = streams._outer_edges(horizon)([batch])
    few_ids = kept.column("src").to_numpy()
    few = kept.column("edge_ts").cast(pa.int64()).to_numpy()
    assert kept.num_rows <= 2 * 3 * 200 < batch.num_rows
    for node in range(3):
        for arrival in range(0, 20_000, 37):
            inside = lambda t: bool(((t >= arrival) & (t <= arrival + horizon)).any())
            assert inside(times[ids == node]) == inside(few[few_ids == node])


def test_only_edges_that_can_matter_are_held():
    """What is held decides every later arrival as all edges would, and is bounded by the least degree below the watermark."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        m, ttl, now = int(rng.integers(1, 5)), int(rng.integers(1, 30)), 100
        edges = sorted(int(t) for t in rng.integers(40, 130, rng.integers(0, 40)))

        def decided(times, arrival):
            near = [t for t in times if arrival - ttl <= t <= arrival + ttl]
            return max(arrival, near[m - 1]) if len(near) >= m else (arrival + ttl, len(near))

        held = streams._needed(edges, [], now, ttl, m)
        assert sum(t < now for t in held) <= m
        assert all(decided(held, a) == decided(edges, a) for a in range(now, now + 60))
        for open_ in range(now - ttl, now):  # arrivals that wait: not decided before the watermark
            due = decided(edges, open_)
            if (due if isinstance(due, int) else due[0]) >= now:
                assert decided(streams._needed(edges, [open_], now, ttl, m), open_) == due


def test_late_rows_are_counted_over_all_batches():
    class Query:
        """Remembers the last two of its batches."""

        def __init__(self):
            self.done = 0

        def awaitTermination(self, seconds):
            self.done += 2
            return self.done >= 200

        @property
        def recentProgress(self):
            return [{"batchId": b, "stateOperators": [{"numRowsDroppedByWatermark": 1}, {}]} for b in range(self.done - 2, self.done)]

    query = streams.watch(Query(), 0)
    assert streams.late_rows(query) == 200


@pytest.mark.parametrize("form", ["file", "folder"])
def test_tables_stream_as_file_and_as_folder(spark, tmp_path, form):
    table = spark.range(100).repartition(3 if form == "folder" else 1)
    folder = tmp_path / "input"
    if form == "folder":
        table.write.parquet(f"{folder}/numbers.parquet")
    else:
        table.write.parquet(str(tmp_path / "parts"))
        folder.mkdir()
        os.link(glob.glob(f"{tmp_path}/parts/*.parquet")[0], f"{folder}/numbers.parquet")
    spark.range(7).write.parquet(f"{folder}/others.parquet")
    found, _ = streams.run_available(read_stream(spark, str(folder), "numbers"), "numbers")
    assert rows(found) == [(i,) for i in range(100)]


def test_queries_over_a_folder_equal_those_over_a_file(spark, tmp_path):
    spark.read.parquet(f"{SF}/embeddings.parquet").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("stream_embed_given", "stream_links"):
        want = rows(QUERIES[name](spark, SF))
        assert want and rows(QUERIES[name](spark, str(tmp_path))) == want


def test_warm_up_hands_on_one_frame_per_node_and_keeps_one_state():
    """Every frame and every state is a trip between Python and the JVM."""
    from types import SimpleNamespace

    held, timers = {}, []

    class State:
        def __init__(self, name):
            self.name = name

        def get(self):
            return held.get(self.name)

        def exists(self):
            return self.name in held

        def update(self, value):
            held[self.name] = value

        def clear(self):
            held.pop(self.name, None)

    handle = SimpleNamespace(
        getValueState=lambda name, schema: State(name), listTimers=lambda: iter(list(timers)),
        registerTimer=timers.append, deleteTimer=timers.remove,
    )
    run = streams._WarmUp(1, 1000)
    run.init(handle)
    stamps = pd.to_datetime([10_000, 20_000, 30_000, 20_500, 50_000], unit="ms")
    rows_in = pd.DataFrame({"id": 7, "ts": stamps, "is_node": [True, True, True, False, True]})
    assert list(run.handleInputRows((7,), iter([rows_in]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0))) == []
    assert len(held) == 1
    frames = list(run.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 40_000), None))
    assert len(frames) == 1
    assert frames[0]["status"].tolist() == ["cold", "warm", "cold"]
    assert frames[0]["degree"].tolist() == [0, 1, 0]
    assert (frames[0]["ts"].astype("datetime64[ms]").astype("int64")).tolist() == [11_000, 20_500, 31_000]
    assert len(held) == 1 and timers
