"""Base spans against Python's matcher, the label model against drawn votes, added spans on planted texts, and odd input."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from coldgraph.llm import pii

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, kind string, start string, spans string, __row string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    """[(kind, start, end)] of the base rules, in their order."""
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and plain_luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                found.append((m.start(), rank, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


ODD = [
    (1, None), (2, ""), (3, " \t\n "), (None, "é😀 a@b.cc x"), (4, "a@b.c_d@e.f.g--h@i.j a.b@c a@.b @c.d x@y..z"),
    (4, "a@b.c_d@e.f.g--h@i.j a.b@c a@.b @c.d x@y..z"), (5, "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255 1.2.3 1..2.3.4 9.9.9.999999999999"),
    (6, "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 4111111111111112 0 00-0 123456789012345678901 000000000000"),
    (7, "+1 (826) 555-4081 +44 20 7946 0958. +1+2+33 4444 55555 ++49 (0)30.1234-56 +1 234 567 890 123 456 78"),
    (8, "+41111111111111111"), (9, "x" * 30_000 + "@" + "y" * 30_000 + ".z " + "a" * 60_000), (10, "1" * 60_000 + " " + "2." * 30_000),
    (11, "+1" + "(" * 60_000 + " +1" + " 2" * 20_000), (12, " ".join(f"u{i}@h{i}.org 10.0.{i % 256}.{i % 300}" for i in range(3000))),
    (13, "@".join(["aa.bb"] * 500)), (14, "ſ@K.com a@b.İ ١٢٣.١.١.١ é@b.cc"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "x", None, "y", "z") for k, t in ODD], SCHEMA)


def test_base_spans_are_those_of_the_plain_matcher(spark, docs):
    sample = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for table in (docs, sample):
        found = pii.personal_data(table)
        assert found.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
        rows = {}
        for r in found.collect():
            rows.setdefault(r.doc_id, []).append(r)
        expected = {}
        for r in table.collect():
            expected.setdefault(r.doc_id, []).append(plain(r.text))
        assert rows.keys() == expected.keys()
        for k, own in expected.items():
            key = lambda spans: (hashlib.sha256(joined(spans).encode()).hexdigest(), *(sum(s[0] == kind for s in spans) for kind in PATTERNS))
            assert sorted((r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows[k]) == sorted(map(key, own))
            for r in rows[k]:
                assert any(set(filter(None, joined(spans).split(","))) <= set(r.spans.split(",")) for spans in own)


def test_spans_are_added_where_context_speaks_for_them(spark):
    plain_rows = [(i, f"write to user{i}@mail{i}.example.com or call +1 (826) 555-{1000 + i} now") for i in range(60)]
    more = {
        100: ("mail john.doe (at) example (dot) com today", "email:5:36"),
        101: ("my phone 826-555-4081 is on", "phone:9:21"),
        102: ("card 4111.1111.1111.1111 was used", "card:5:24"),
        103: ("server at 10[.]20[.]30[.]40 answers", "ip:10:27"),
        104: ("call +1 (826) 555-4081 190.137.223.204 ok", "phone:5:22,ip:23:38"),
        105: ("card 4111.1111.1111.1112 was used", ""),
        106: ("version 2024-01-31 of order 1234-567-89", ""),
        107: ("they met at noon and dot the i", ""),
        108: ("at 12:30:45 it was 3:2", ""),
    }
    table = spark.createDataFrame(plain_rows + [(k, t) for k, (t, _) in more.items()], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(table).collect()}
    assert {k: got[k] for k in more} == {k: spans for k, (_, spans) in more.items()}
    assert all(got[i] == joined(plain(t)) for i, t in plain_rows)


def test_label_model_finds_who_is_right():
    """Votes drawn with known reliabilities: the model's probabilities of the patterns against those of Bayes' rule."""
    draw = np.random.default_rng(1)
    right = dict(zip(pii.LABELERS, (0.95, 0.9, 0.8, 0.75, 0.7, 0.6), strict=True))
    truth = draw.random(20_000) < 0.6
    votes = np.stack([np.where(draw.random(len(truth)) < r, 1, -1) * np.where(truth, 1, -1) for r in right.values()], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    found = pii.reliabilities([("ip", tuple(int(v) for v in p), int(n)) for p, n in zip(patterns, counts, strict=True)], rounds=500)
    prior, ratio = found["ip"]
    assert abs(1 / (1 + math.exp(-prior)) - 0.6) < 0.03
    for name, r in right.items():
        assert abs(ratio[name, 1] - math.log(r / (1 - r))) < 0.35 and abs(ratio[name, -1] + math.log(r / (1 - r))) < 0.35


def test_places_of_many_matches(spark):
    values = [3, 0, 5, 1] * 1000
    got = spark.range(1).select(pii.before_each(F.array_repeat(F.lit(7).cast("long"), 130)).alias("x"), pii.before_each(F.from_json(F.lit(str(values)), "array<bigint>")).alias("y")).first()
    assert got.x == [7 * i for i in range(130)]
    assert got.y == [0, *np.cumsum(values)[:-1].tolist()]


def test_no_rows(spark):
    assert pii.personal_data(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = pii.personal_data(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in blank] == [(1, 0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")]


def test_only_built_in_functions_run_on_rows(docs):
    plan = pii.personal_data(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
