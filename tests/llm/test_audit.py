"""The filter audit against applying every order, and on odd input."""

import re
from collections import defaultdict
from itertools import permutations

import pytest

from coldgraph.functions import skew
from coldgraph.llm import audit

SCHEMA = "doc_id long, text string, source string, part string, docs string, __mask string"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(rows, labels):
    """Every order applied to every document."""
    good, toxic = ({k for k, *flags in labels if k is not None and flags[i] == 1} for i in (0, 1))
    texts = defaultdict(list)
    for k, text, _ in rows:
        if k is not None:
            texts[text or ""].append(k)
    docs = defaultdict(list)
    for k, text, part in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": re.search("[#$%&*|]", t) is not None,
            "E": k is not None and any(j < k for j in texts[t]),
        }
        docs[part or ""].append(({f for f in fails if fails[f]}, k in good, k in toxic))
    out = set()
    for part, own in docs.items():
        removed, lines = defaultdict(int), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                removed[f] += len(gone)
                fails = sum(f in d[0] for d in own)
                alone = sum(d[0] == {f} for d in own)
                lines.append((part, "".join(order), step, len(left), len(gone), fails - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out |= {(*line, removed[line[1][line[2] - 1]]) for line in lines}
    return out


@pytest.fixture(scope="module")
def odd():
    varied, same = " ".join(f"w{i}" for i in range(250)), " ".join(["again"] * 250)
    return [
        (1, None, "a"), (2, "", "a"), (None, "", "a"), (3, " \t\x0b\n ", None), (3, " \t\x0b\n ", None), (3, " \t\x0b\n ", "b"),
        (4, varied, "a"), (5, varied, "b"), (6, varied, "b"), (4, varied, None), (7, varied + " #", "a"), (8, same + " ÀÉ", "b"),
        (9, same.upper(), "b"), (10, "ABC | é", ""), (11, varied * 300, "a"), (12, "x" * 98 + "YZ", "c"), (13, "x" * 97 + "YZ", "c"),
        *[(k, "one hot text", "d") for k in range(100, 160)], *[(200, "one hot text", "d")] * 5, (-1, "one hot text", "e"),
    ]


LABELS = [(1, 1, 0), (1, 0, 1), (4, 1, 1), (6, None, 1), (9, 1, None), (None, 1, 1), (110, 0, 1), (111, 1, 0), (10_000, 1, 1), (3, 1, 0)]


@pytest.mark.parametrize("hot", [None, 5])
def test_audit_applies_every_order(spark, odd, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(audit, "HOT_ROWS", hot)
        monkeypatch.setattr(skew, "HOT_ROWS", hot)
    docs = spark.createDataFrame([(k, t, s, "p", None, "m") for k, t, s in odd], SCHEMA).repartition(4)
    found = audit.filter_audit(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))
    assert found.columns == COLUMNS
    got = [tuple(r) for r in found.collect()]
    assert len(got) == 6 * 600 and set(got) == plain(odd, LABELS)


def test_audit_of_nothing(spark, odd):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(none, labels).count() == 0
    docs = spark.createDataFrame([(k, t, s, "p", None, "m") for k, t, s in odd], SCHEMA)
    assert {tuple(r) for r in audit.filter_audit(docs, labels).collect()} == plain(odd, [])


def test_intervals_cover_each_order_once():
    for mask in range(1, 32):
        ranks = sorted(r for m, _, a, b in audit.intervals() if m == mask for r in range(a, b))
        assert ranks == list(range(120))
