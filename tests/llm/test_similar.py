"""The pipeline's near copies against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from coldgraph.llm import similar

SF = "/root/testdata/sf0.001"


def plain_groups(rows):
    """{smallest key of each group} of (key, text), by the similarity of all pairs."""

    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(k, shingles(t)) for k, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a == b or len(a & b) * 5 >= 4 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(sets):
        groups.setdefault(find(i), []).append(k)
    return {min((k for k in g if k is not None), default=None) for g in groups.values()}, len(groups)


def near_limit():
    """Odd rows, and texts of single edits: many pairs lie close to the limit on either side."""
    draw = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    near = [(None, ""), (900, None), (901, " \n"), (902, "a b"), (903, "A  b"), (None, "only this one"), (903, "A  b"), (None, "only this one")]
    for i in range(120):
        words = list(base)
        for p in draw.choice(120, draw.integers(0, 5), replace=False):
            words[p] = f"x{draw.integers(1000)}"
        near.append((1000 + i, " ".join(words)))
    long = " ".join(f"v{i * i % 9973}" for i in range(60_000))
    return near + [(2000, long), (2001, long + " end"), (2002, long[: len(long) // 2])]


@pytest.mark.parametrize("small, block", [(64, 1_000_000), (2, 500)])
def test_near_copies_of_the_pipeline(spark, small, block):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    clashing = "doc_id long, text string, fp string, th long, __h1 string, n int"
    odd = spark.createDataFrame([(k, t, "f", None, "h", 1) for k, t in near_limit()], clashing.replace("__h1", "bits"))
    for table in (docs, odd):
        expected, groups = plain_groups([(r.doc_id, r.text) for r in table.collect()])
        got = similar.one_of_similar(table.repartition(5), small=small, block=block)
        assert got.columns == table.columns
        got = [r.doc_id for r in got.collect()]
        assert set(got) == expected and len(got) == groups
        if small == 64:
            assert sorted(map(str, got)) == sorted(str(r.doc_id) for r in corpus_pipeline.near_copies(spark, table, SF).collect())
    assert similar.one_of_similar(docs.limit(0)).count() == 0


def test_recall_of_keys_and_no_false_links():
    """Of all pairs of edited texts with the least similarity or more, nine of ten share a key."""
    draw = np.random.default_rng(8)
    sets = []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(200)]
        for _ in range(4):
            words = list(base)
            for p in draw.choice(200, draw.integers(1, 4), replace=False):
                words[p] = f"x{draw.integers(1_000_000)}"
            sets.append((g, similar.shingles(" ".join(words).encode())))
    row, key = similar.near_keys(np.stack([similar.fingerprint_words(s) for _, s in sets]))
    keys = [set(key[row == i].tolist()) for i in range(len(sets))]
    met = true = strangers = 0
    for i in range(len(sets)):
        for j in range(i):
            (g, a), (h, b) = sets[i], sets[j]
            if g != h:
                strangers += bool(keys[i] & keys[j])
            elif similar.alike(np.array(len(np.intersect1d(a, b))), np.array(len(a) + len(b))):
                true += 1
                met += bool(keys[i] & keys[j])
    assert true > 100 and met >= 0.9 * true and strangers < 200


def test_active_sets_without_a_row_per_end(spark):
    """The sets of all partners, from one end of the pairs: distances are mutual, in pieces of a large key too."""
    draw = np.random.default_rng(1)
    base = draw.integers(-(1 << 62), 1 << 62, similar.WORDS)
    rows = 600
    words = np.array([[b ^ (1 << int(draw.integers(60))) if draw.random() < 0.5 else b for b in base] for _ in range(rows)], dtype=np.int64)
    columns = [np.zeros(rows, np.int32), np.arange(rows), np.full(rows, 50, np.int32), np.arange(rows) // 2, *words.T]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["s", "id", "n", "label", *similar.WIDE])
    pairs = [(u, v, d) for b in similar._partners(iter([batch])) for u, v, d in zip(*[c.to_pylist() for c in b.columns], strict=True)]
    assert len(pairs) > rows and {u for u, _, _ in pairs} <= {v for _, v, _ in pairs}
    active = similar._active(spark.createDataFrame(pairs, "u long, v long, d int"))
    assert {r.fp for r in active.collect()} == {x for u, v, _ in pairs for x in (u, v)}
    assert "Generate" not in active._jdf.queryExecution().optimizedPlan().toString()
