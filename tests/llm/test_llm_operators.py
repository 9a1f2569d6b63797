"""Each operator against a plain version, and on odd input: nulls, empty and long texts, ties, repeated rows,
empty tables, extra columns with clashing names."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from coldgraph.llm import golay, interpolation, language, mixing, quality, rules, sharding, simhash, tiling, tokens, toxicity
from coldgraph.llm.queries import ORACLE, QUERIES
from coldgraph.llm.rows import labelled_sample
from coldgraph.session import new_path
from tests.llm.test_similar import plain_groups as similar_groups

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, fp string, size string, copies string"


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, a long text, ties, repeated rows, repeated keys, clashing columns."""
    long = " ".join(f"word{i % 700}" for i in range(60_000))
    rest = ("x",) * 5
    rows = [
        (1, None, "en", "a", None, *rest), (2, "", None, "a", 0, *rest), (3, " \t\n ", "en", None, 4, *rest),
        (None, "the same text of some words", "en", "b", 5, *rest), (4, "the same text of some words", "en", "b", 5, *rest),
        (5, long, "en", "a", len(long), *rest), (6, "one", "fr", "b", 3, *rest), (6, "été À l’école", "fr", "b", 3, *rest),
        (7, "\U0001f600 <|endoftext|> İstanbul ΟΔΟΣ é", "el", "c", 1, None, None, None, None, None),
        *[(8, "again and again and again and again", "en", "b", 9, *rest)] * 5,
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def apply_all(spark, docs, labels, benchmark):
    return {
        "shard": sharding.shard(docs, 3),
        "simhash": simhash.simhash_groups(docs),
        "language": language.languages(docs),
        "toxicity": toxicity.toxicity_scores(docs, labels),
        "quality": quality.quality_scores(docs, labels),
        "lm": interpolation.interpolated_scores(docs),
        "rules": rules.quality_rules(docs, labels),
        "tokens": tokens.token_counts(docs, TOKENIZER, new_path(spark, "cache"), True),
        "mix": mixing.mix(docs),
    }


def test_odd_rows_keep_their_number(spark, odd, labels, benchmark):
    n = odd.count()
    for name, result in apply_all(spark, odd, labels, benchmark).items():
        assert result.count() == n, name
    assert tiling.contamination(odd, benchmark).count() == 0
    assert tiling.uncontaminated(odd, benchmark).count() == n
    assert simhash.one_of_each(odd).columns == odd.columns
    assert mixing.mixed(odd).columns == odd.columns
    assert rules.kept_rows(odd, labels).columns == odd.columns


def test_empty_tables(spark, none, odd, docs, labels, benchmark):
    for name, result in apply_all(spark, none, labels.limit(0), benchmark.limit(0)).items():
        assert result.count() == 0, name
    for result in (simhash.one_of_each(none), mixing.mixed(none), rules.kept_rows(none, labels), tiling.uncontaminated(none, benchmark)):
        assert result.count() == 0 and result.columns == none.columns
    # nothing to learn from: constant scores, no rules
    assert toxicity.toxicity_scores(odd, labels.limit(0)).select("score").distinct().count() == 1
    assert quality.quality_scores(odd, labels.limit(0)).select("score").distinct().count() == 1
    assert rules.learn_rules(rules.statistics(docs, ["doc_id"]), labels.limit(0)).rules == ()
    assert {r.lang_pred for r in language.languages(odd.drop("lang").selectExpr("*", "string(null) lang")).collect()} == {"und"}
    assert tiling.contamination(docs, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 97, 1000])
def test_permutation(spark, n):
    p = sharding.Permutation(n, 42)
    column = p.apply(F.col("id"), p.walk(spark))
    got = spark.range(n).select("id", column.alias("place")).collect()
    assert sorted(r.place for r in got) == list(range(n))
    assert all(p.place(r.id) == r.place for r in got)


def test_shards(spark, docs, odd):
    for table, k in ((docs, 40), (odd, 4)):
        got = sharding.shard(table.repartition(5), k).collect()
        assert got and sorted(map(str, got)) == sorted(map(str, sharding.shard(table.coalesce(1), k).collect()))
        slots = {}
        for r in got:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots.get(i, [])) for i in range(k)]
        assert max(sizes) - min(sizes) <= 1 and {r.law for r in got} == {"rows"}
    many = spark.range(25_000).selectExpr("1L as doc_id", "'a' as text")
    counts = {r[0]: r[1] for r in sharding.shard(many, 7).groupBy("shard").count().collect()}
    assert sum(counts.values()) == 25_000 and max(counts.values()) - min(counts.values()) <= 1


def test_golay_keys_meet():
    draw = np.random.default_rng(3)
    for _ in range(300):
        x = int(draw.integers(0, 1 << 64, dtype=np.uint64))
        y = x
        for b in draw.choice(64, int(draw.integers(0, 4)), replace=False):
            y ^= 1 << int(b)
        row, key = simhash.golay_keys(np.array([x, y], dtype=np.uint64))
        assert set(key[row == 0]) & set(key[row == 1])
    every = golay.decode(np.arange(1 << 23, dtype=np.int64))
    assert np.bincount(every, minlength=4096).min() == np.bincount(every).max() == 2048


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_groups(rows):
    """({fingerprint: smallest key reachable}, number of groups)"""
    fps = sorted({f for _, f in rows})
    low = {f: min((k for k, g in rows if g == f and k is not None), default=None) for f in fps}
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, f in enumerate(fps):
        for g in fps[:i]:
            if (f ^ g).bit_count() <= 3:
                root[find(f)] = find(g)
    best = {}
    for f in fps:
        r = find(f)
        best[r] = min((x for x in (best.get(r), low[f]) if x is not None), default=None)
    return {f: best[find(f)] for f in fps}, len(best)


@pytest.mark.parametrize("bucket_rows", [20_000, 1])
def test_simhash_groups(spark, docs, odd, bucket_rows):
    near = spark.createDataFrame(
        [(100 + i, " ".join([*(f"w{j}" for j in range(400)), f"end{i}"])) for i in range(30)] + [(None, ""), (90, None)],
        "doc_id long, text string",
    )
    for table in (docs, odd, near):
        given_rows = [(r.doc_id, plain_fingerprint(r.text)) for r in table.select("doc_id", "text").collect()]
        group, groups = plain_groups(given_rows)
        expected = sorted((str(k), f"{f:016x}", str(group[f])) for k, f in given_rows)
        got = simhash.simhash_groups(table, bucket_rows=bucket_rows).collect()
        assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == expected
        stay = simhash.one_of_each(table, bucket_rows=bucket_rows).collect()
        assert {r.doc_id for r in stay} == set(group.values()) and len(stay) == groups


def test_language_on_held_out(docs):
    got = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))


def test_codewords_differ():
    for n in (2, 4, 6, 9, 20):
        code = language.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= max(1, code.shape[1] // 4) and (np.abs(code.sum(axis=0)) < n).all()


def test_language_and_labels_are_no_inputs(spark, docs, labels):
    """A changed lang, source or label of a held-out row changes no score."""
    held = "crc32(cast(doc_id as string)) % {} = {}"
    other = docs.selectExpr("doc_id", "text", f"if({held.format(4, 2)}, 'xx', lang) lang", "'s' source", "n_chars")
    a = {r.doc_id: (r.lang_pred, r.score) for r in language.languages(docs).collect()}
    assert a == {r.doc_id: (r.lang_pred, r.score) for r in language.languages(other).collect()}
    flipped = labels.selectExpr(
        "doc_id", f"if({held.format(5, 0)}, 1 - quality, quality) quality", f"if({held.format(5, 0)}, 1 - toxic, toxic) toxic"
    )
    no_lang = docs.selectExpr("doc_id", "text", "string(null) lang", "string(null) source")
    for score in (toxicity.toxicity_scores, quality.quality_scores):
        a = {r.doc_id: r.score for r in score(docs, labels).collect()}
        assert a == {r.doc_id: r.score for r in score(no_lang, flipped).collect()}


def auc(score, y):
    rank = score.rank()
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_scores_on_held_out(spark):
    big = "/root/testdata/sf0.1"
    labelled = spark.read.parquet(f"{big}/labels.parquet")
    some = spark.read.parquet(f"{big}/documents.parquet").join(labelled.select("doc_id"), "doc_id", "left_semi")
    truth = labelled.toPandas()
    for score, name, least in ((quality.quality_scores, "quality", 0.95), (toxicity.toxicity_scores, "toxic", 0.85)):
        got = score(some, labelled).toPandas().merge(truth, on="doc_id")
        held = got[got.held_out]
        assert auc(held.score, held[name]) > least and got.score.between(0, 1).all()
        assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))


def test_toxicity_learns_from_all_labelled_rows(spark):
    """A word of toxic texts that only rows beyond the 6,000 smallest key hashes hold is learned too, in one part and in several."""
    keys = spark.range(9_000).where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    order = F.row_number().over(Window.orderBy(F.xxhash64("id"), "id"))
    word = F.when(F.col("id") % 4 != 0, "calm").when(F.col("place") <= 6_000, "foul").otherwise("vile")
    table = keys.withColumn("place", order).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("some "), word, F.lit(" words here")).alias("text"), (F.col("id") % 4 == 0).cast("int").alias("toxic")
    )
    table = table.localCheckpoint()
    assert table.count() > 6_000
    asked = spark.createDataFrame([(1, "some vile words here"), (2, "some foul words here"), (3, "some calm words here")], "doc_id long, text string")
    found = toxicity.score_with(asked, toxicity.learn_toxicity(table, table), "doc_id", "text", 5, 0.5)
    assert {r.doc_id: r.predicted for r in found.collect()} == {1: 1, 2: 1, 3: 0}


def test_toxicity_long_text_folds_as_a_whole_one():
    draw = np.random.default_rng(0)
    own = [draw.integers(1, 1 << 63, 250_000).astype(np.uint64)]
    model = toxicity._constant(1, 1)
    trainer = toxicity.Trainer(toxicity._cut(model), np.full_like(toxicity._cut(model), 1e-2), (1.0, 1.0))
    first, second, starts = toxicity.padded(np.array([0, len(own[0])]), own[0])
    at, best = trainer._best(first, second, starts)
    values = model.convolve(first, second)
    assert np.allclose(best[0], values.max(axis=0)) and np.allclose(values[at[0], np.arange(values.shape[1])], best[0])
    h = toxicity.unpacked(toxicity.packed(own[0]))
    assert all((a == b).all() for a, b in zip(toxicity.padded(np.array([0, len(h)]), h), (first, second, starts), strict=True))


def test_dual_coordinate_descent_separates():
    from coldgraph.llm.linear import dual_coordinate_descent

    draw = np.random.default_rng(0)
    rows = [np.unique(np.append(draw.integers(2, 50, 10), i % 2)) for i in range(200)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(200)])
    w, b = dual_coordinate_descent(rows, np.ones(50), y)
    assert all(y[i] * (w[rows[i]].sum() + b) > 0 for i in range(200))


def test_interpolation(docs, odd):
    for table in (docs, odd):
        rows = [(r.doc_id, r.text or "") for r in table.select("doc_id", "text").collect()]
        split = [(k, [w.encode() for w in words(re.sub("[A-Z]", lambda m: m[0].lower(), t))] + [b""]) for k, t in rows]
        fold = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 10
        count = Counter(w for k, ws in split if fold(k) for w in ws)
        n, v = sum(count.values()), len(count)
        expected = sorted(
            (str(k), fold(k) == 0, len(ws), sum(count[w] > 0 for w in ws), n,
             round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 5))
            for k, ws in split
        )
        got = interpolation.interpolated_scores(table).collect()
        assert sorted((str(r[0]), *r[1:5], round(r.base_score, 5)) for r in got) == expected
        small = interpolation.interpolated_scores(table, block_bytes=20_000, shard_bytes=30_000).collect()
        key = lambda r: (str(r[0]), *r[1:5], round(r.base_score, 6))
        for a, b in zip(sorted(got, key=key), sorted(small, key=key), strict=True):
            assert a.score == pytest.approx(b.score, rel=1e-9) and a.score < 0
    got = interpolation.interpolated_scores(docs).where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum()


def test_interpolation_holds_few_words_as_objects():
    texts = pa.array([" ".join(f"w{i}x{j}" for j in range(1000)) for i in range(300)])
    tracemalloc.start()
    try:
        bounds, h, before = interpolation.tokens(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(h) == 300 * 1001 and len(set(h.tolist())) == 300_001
    assert peak < 60 * len(h)


def test_interpolation_is_a_distribution():
    """Over all words and one unseen, the shares of a context sum to one."""
    texts = ["a b a c", "a b b", "c a b"] * 4
    bounds, h, before = interpolation.tokens(pa.array(texts))
    types = np.unique(h)
    word = Counter(h.tolist())
    pair = Counter(zip(before.tolist(), h.tolist()))
    weights = interpolation.learn_weights(np.array([(2 * 40_000 + 20_000) * 40_000 + 20_000]), np.array([3.0]))
    for context in types.tolist():
        c = word[context]
        if context == int(interpolation.END):
            continue
        w = weights[interpolation.bucket_of(np.array([c]))[0]]
        total = sum(w[0] * pair[context, t] / c + w[1] * word[t] / len(h) + w[2] / (len(types) + 1) for t in types.tolist())
        assert total + w[2] / (len(types) + 1) == pytest.approx(1)


def plain_statistics(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + d for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [line for line in text.split("\n") if words(line)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)]


def test_rules(docs, odd, labels):
    for table in (docs, odd):
        expected = []
        for r in table.select("doc_id", "text").collect():
            s = plain_statistics(r.text)
            expected.append((str(r.doc_id), *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
        got = rules.quality_rules(table, labels).collect()
        assert sorted((str(r[0]), *r[1:7]) for r in got) == sorted(expected)
        assert not any(r.kept and r.base_failed for r in got)
        assert rules.kept_rows(table, labels).count() == sum(r.kept for r in got)
    learned = rules.learn_rules(rules.statistics(docs, ["doc_id"]), labels)
    judged = rules.quality_rules(docs, labels).join(labels, "doc_id").where("not base_failed").toPandas()
    assert learned.rules and judged[judged.quality == 1].kept.mean() > 0.97


def test_samples_hold_one_row_of_a_repeated_key(spark, docs, labels, monkeypatch):
    """A key that very many rows share doesn't grow what is collected."""
    one = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).select("doc_id")
    first = docs.join(one, "doc_id").orderBy(F.length("text").desc()).limit(1)
    again = docs.unionByName(first.crossJoin(spark.range(500)).drop("id").select(docs.columns))
    sample = labelled_sample(again, labels, "quality", 1000)
    assert sample.columns == ["__key", "__text", "__label"]
    assert sorted(sample.collect()) == sorted(labelled_sample(docs, labels, "quality", 1000).collect())
    sizes = []
    learn = rules.learn
    monkeypatch.setattr(rules, "learn", lambda x, y: sizes.append(len(x)) or learn(x, y))
    lists = [rules.learn_rules(rules.statistics(d, ["doc_id"]), labels) for d in (docs, again)]
    assert lists[0] == lists[1] and sizes[0] == sizes[1]


def test_decision_list_is_ordered_and_pruned():
    draw = np.random.default_rng(1)
    x = draw.random((900, len(rules.FEATURES)))
    reject = (x[:, 1] > 0.8) | ((x[:, 2] > 0.5) & (x[:, 3] <= 0.3))
    learned = rules.learn(x, reject)
    met = np.zeros(len(x), dtype=bool)
    for rule in learned.rules:
        met |= rules._covers(list(rule), x)
    assert (met == reject).mean() > 0.95 and 2 <= len(learned.rules) <= 6


def test_tokens(spark, docs, odd, texts):
    cache = new_path(spark, "cache")
    for table in (docs, odd, docs):
        rows = table.select("doc_id", "text").collect()
        exact = tokens.encode_counts(TOKENIZER, [r.text or "" for r in rows])
        expected = sorted((str(r.doc_id), len((r.text or "").encode()), n, n > 2048) for r, n in zip(rows, exact))
        got = tokens.token_counts(table, TOKENIZER, cache, True).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == expected
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()  # hits were not encoded again
    piece = public_tokenizers.path("piece_bpe_32k.model")
    some = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs.limit(5), piece, cache).collect()}
    assert some == {k: tokens.encode_counts(piece, [texts[k]])[0] for k in some}


def test_tokens_of_a_shared_content_are_salted(spark):
    rows = [(i, "one text that very many rows share" if i % 3 else f"text {i}") for i in range(90)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted(zip((i for i, _ in rows), tokens.encode_counts(TOKENIZER, [t for _, t in rows])))
    got = tokens.token_counts(table, TOKENIZER, new_path(spark, "cache"), True, hot_rows=10)
    assert "__salt" in got._jdf.queryExecution().toString()
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == expected


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85  '`<|>aAσΣ́s"))))
def test_counts_by_word_equal_the_library(text):
    assert tokens.count_by_word(TOKENIZER, pa.array([text]))[0] == tokens.encode_counts(TOKENIZER, [text])[0]


def test_mix(spark, docs, odd):
    import duckdb

    with duckdb.connect() as c:
        c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
        expected = c.sql(ORACLE["op9_mixing"]).df().sort_values("doc_id").reset_index(drop=True)
    got = mixing.mix(docs.repartition(7)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got[expected.columns] == expected).all().all()
    for table in (docs, odd):
        rows = mixing.mix(table).join(table.select("doc_id", "source").distinct(), "doc_id").toPandas() if table is docs else None
        mixed = mixing.mix(table).toPandas()
        assert (mixed.taken == mixed["copies"] * mixed["size"]).all() and (mixed["copies"] <= 3).all()
        assert mixing.mixed(table).count() == mixed["copies"].sum()
        if rows is not None:
            for _, own in rows.groupby("source"):
                assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max()
                assert own.target.iloc[0] <= 3 * own.source_size.iloc[0]


def test_tiles():
    p = np.arange(1, 31, dtype=np.uint64)
    t = np.concatenate([p[20:], [99] * 5, p[:20], [98]]).astype(np.uint64)
    assert tiling.tiles(p, t) == [(0, 15, 20), (20, 0, 10)]
    assert tiling.tiles(p, np.zeros(0, dtype=np.uint64)) == []
    same = np.full(40, 7, dtype=np.uint64)
    assert sum(n for _, _, n in tiling.tiles(same[:30], same)) == 30
    h = np.random.default_rng(0).integers(0, 1 << 62, 50).astype(np.uint64)
    for k in (1, 2, 3, 5, 7, 20):
        plain = []
        for i in range(len(h) - k + 1):
            v = 0
            for x in h[i : i + k]:
                v = (v * int(tiling.BASE) + int(x)) % (1 << 64)
            plain.append(v)
        assert [int(x) for x in tiling.running(h, k)] == plain


def plain_covered(item, text):
    """Greedy tiling by trying all pairs."""
    p, t = list(tiling.tokens(item)), list(tiling.tokens(text))
    mp, mt = [False] * len(p), [False] * len(t)
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not mp[i + n] and not mt[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < tiling.SEED_WORDS:
            return sum(mp)
        mp[i : i + n] = [True] * n
        mt[j : j + n] = [True] * n


def test_contamination(spark, docs, benchmark):
    items = {r.item_id: r.text for r in benchmark.collect()}
    w = next(t for t in items.values() if len(words(t)) >= 24).split()
    turned = " ".join([*w[12:], "and", "between", *w[:12], "end"])
    planted = spark.createDataFrame([(1, turned), (1, turned), (2, None), (3, ""), (None, turned.upper()), (4, " ".join(w[:7]))], "doc_id long, text string")
    for table in (planted, docs.select("doc_id", "text").limit(60)):
        expected = []
        for r in table.collect():
            t = list(tiling.tokens(r.text or ""))
            grams = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
            for k, item in items.items():
                p = list(tiling.tokens(item))
                if len(p) >= 5 and grams & {tuple(p[i : i + 5]) for i in range(len(p) - 4)}:
                    covered = plain_covered(item, r.text or "")
                    if covered >= 0.5 * len(p):
                        expected.append((str(r.doc_id), k, len(p), covered))
        for block_words in (1_000_000, 50):
            got = tiling.contamination(table, benchmark, block_words=block_words).collect()
            assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got) == sorted(expected)
        clean = tiling.uncontaminated(table, benchmark, block_words=50)
        assert clean.count() == table.count() - sum(Counter(k for k, *_ in expected).keys().__contains__(str(r.doc_id)) for r in table.collect())


def test_queries_and_pipeline(spark):
    import corpus_pipeline

    assert len(QUERIES) == 13 and [name for name, _ in corpus_pipeline.STAGES]
    base = spark.read.parquet(f"{SF}/documents.parquet")
    source = docs = base
    left = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        left.append([r.doc_id for r in docs.collect()])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == source.columns
    kept = {r.doc_id for r in rules.quality_rules(base, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    assert set(left[0]) == kept
    alike, _ = similar_groups([(r.doc_id, r.text) for r in base.collect() if r.doc_id in kept])
    assert sorted(left[1]) == sorted(alike)
    leaked = {r.doc_id for r in tiling.contamination(base, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert sorted(left[2]) == sorted(set(left[1]) - leaked)
    assert max(Counter(left[3]).values()) <= 3 and sorted(left[3]) == sorted(left[4])
