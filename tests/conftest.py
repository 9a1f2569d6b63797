import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from coldgraph.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session("8", 4, **{"spark.checkpoint.dir": shared})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Small tables by hand."""

    class Make:
        def edges(self, rows):
            rows = [(*r, 1.0) if len(r) == 2 else r for r in rows]
            return spark.createDataFrame(rows, "src bigint, dst bigint, weight double")

        def nodes(self, vectors, labels=None, ids=None):
            ids = range(len(vectors)) if ids is None else ids
            labels = [None] * len(vectors) if labels is None else labels
            rows = [
                (int(i), [float(x) for x in v], None if y is None else int(y))
                for i, v, y in zip(ids, vectors, labels)
            ]
            return spark.createDataFrame(rows, "id bigint, features array<double>, label int")

    return Make()


@pytest.fixture(scope="session")
def planted(spark):
    from coldgraph.session import materialize
    from coldgraph.sources.datasets import planted_edges, planted_nodes

    return (
        materialize(planted_nodes(spark, SF), "t-nodes"),
        materialize(planted_edges(spark, SF), "t-edges"),
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def adjacency(edges, n):
    a = np.zeros((n, n))
    for r in edges.collect():
        a[r["src"], r["dst"]] = a[r["dst"], r["src"]] = r["weight"]
    return a


def features(nodes, column="features"):
    found = sorted(nodes.select("id", column).collect())
    return np.array([r[1] for r in found])
