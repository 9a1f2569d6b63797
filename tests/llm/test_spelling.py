"""Spelling variants against all pairs, and on odd input."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from coldgraph.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, form string"


def plain(rows):
    """{(word, form, root, n, n_near, form_n)} by comparing all pairs of words."""
    counts = Counter()
    for k, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in words if v != w and apart(v, w)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), form[w] and words[form[w]]))
    return out


@pytest.fixture(scope="module")
def drawn():
    """Texts of few letters, so that many words are near, with chains of forms."""
    draw = np.random.default_rng(3)
    rows = []
    for i in range(60):
        words = ["".join(draw.choice(list("abé"), draw.integers(5, 9), p=[0.48, 0.48, 0.04])) for _ in range(60)]
        rows.append((i, " ".join(words).title() if i % 2 else ", ".join(words)))
    chain = ["longword", "longwort", "longwart", "lonwart"]
    rows += [(None, " ".join([w] * 5 * 6**i)) for i, w in enumerate(chain)]
    return rows + [(7, None), (8, ""), (9, " \n"), (7, rows[0][1]), (7, rows[0][1])]


@pytest.mark.parametrize("roots, groups, block", [(None, 16, 20_000), (3, 5, 7), (1, 2, 3)])
def test_variants_are_those_of_all_pairs(spark, drawn, roots, groups, block):
    table = spark.createDataFrame([(k, t, "x", "y", None) for k, t in drawn], SCHEMA).repartition(5)
    found = spelling.variants(table, roots=roots, groups=groups, block=block)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in found.collect()]
    expected = plain(drawn)
    assert len(got) == len(expected) and set(got) == expected
    assert any(root not in (word, form) for word, form, root, *_ in got)


def test_each_near_pair_comes_once(spark, drawn):
    words = spelling.word_counts(spark.createDataFrame(drawn, "doc_id long, text string"))
    pairs = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(words, 3, 6, 11).collect()]
    assert len(pairs) == len(set(pairs)) > 100


def test_odd_texts(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None), (3, "a bc def", None, None, None)], SCHEMA)
    assert spelling.variants(blank).count() == 0
    run = "ab" * 50_000
    long = spark.createDataFrame([(i, f"{run} {run}x", None, None, None) for i in range(5)], SCHEMA)
    rows = {r.word: (r.form, r.root, r.n, r.n_near) for r in spelling.variants(long).collect()}
    assert rows == {run: (None, run, 5, 1), run + "x": (None, run + "x", 5, 1)}


def test_near():
    assert spelling.near("abcdef", "abcdeg") and spelling.near("abcdef", "abcde") and spelling.near("bcdef", "abcdef")
    assert not spelling.near("abcdef", "abcdef") and not spelling.near("abcdef", "badcef") and not spelling.near("abcd", "abcdef")


def test_deletions_follow_the_rule():
    found = [(i, w) for i in range(400) for w in ("example",) if spelling.altered(w, zlib.crc32(f"{i}:".encode())) != w]
    assert found and all(zlib.crc32(f"{i}:example".encode()) % 199 == 0 for i, _ in found)
