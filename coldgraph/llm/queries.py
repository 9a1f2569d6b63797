"""The operators as queries over the given tables, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldgraph.llm import audit, interpolation, language, mixing, pii, quality, rules, sharding, simhash, spelling, tiling, tokens, toxicity
from coldgraph.llm.rows import text_of
from coldgraph.session import new_path

SHARDS = 40
TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: doc_id, size, text_crc32, law, shard, slot, grown_shard (null)."""
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", sharding.document_size(), F.crc32(text_of().cast("binary")).alias("text_crc32")
    )
    return sharding.shard(docs, SHARDS).withColumn("grown_shard", F.lit(None).cast("int"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous."""
    return language.languages(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return interpolation.interpolated_scores(_table(spark, sf_dir, "documents"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; the cache starts empty."""
    return tokens.token_counts(
        _table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), new_path(spark, "token-cache"), by_word=True
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, item_words, covered_words, tiles, coverage."""
    return tiling.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    return pii.personal_data(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding, op2_simhash, op3_language, op4_toxicity, op5_quality,
        op6_interpolation, op7_rules, op8_tokens, op9_mixing, op10_tiling, op11_audit, op12_spelling, op13_pii,
    )
}

ORACLE = {
    "op9_mixing": r"""
WITH d AS (
  SELECT doc_id, source, (source IS NULL)::INT AS unknown, coalesce(source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':7:' || coalesce(text, '')), 1, 13))::BIGINT + 0.5::DOUBLE)
           / 4503599627370496::DOUBLE AS u
  FROM documents),
g AS (SELECT *, floor(sqrt(size::DOUBLE))::BIGINT AS lean FROM d),
s AS (
  SELECT unknown, src, sum(size)::BIGINT AS total, sum(size * lean)::BIGINT AS leaning,
         [5, 2, 1][(row_number() OVER (ORDER BY unknown, src) - 1) % 3 + 1] AS w
  FROM g GROUP BY unknown, src),
o AS (
  SELECT *, row_number() OVER by_fill AS place,
         (sum(total) OVER ())::DOUBLE AS everything,
         3 * ((sum(total) OVER by_fill)::BIGINT - total) AS held,
         (sum(w) OVER ())::BIGINT - (sum(w) OVER by_fill)::BIGINT + w AS others
  FROM s WINDOW by_fill AS (ORDER BY total::DOUBLE / w, unknown, src ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (everything - held) / others AS level FROM o),
f AS (SELECT *, total * 3 > level * w AS free FROM l),
t AS (
  SELECT unknown, src, total, leaning,
         CASE WHEN free THEN w * (SELECT arg_min(level, place) FROM f WHERE free) ELSE (total * 3)::DOUBLE END AS target
  FROM f),
p AS (
  SELECT g.*, t.total, t.target,
         CASE WHEN t.total > 0 THEN floor(t.target / t.total)::BIGINT ELSE 0 END AS whole,
         t.leaning
  FROM g JOIN t USING (unknown, src)),
q AS (
  SELECT *, target - whole * total AS rest,
         CASE WHEN leaning > 0 THEN (target - whole * total) * lean / leaning ELSE 0 END AS p FROM p),
r AS (
  SELECT *, CASE WHEN p >= 1 THEN 0 ELSE 1 END AS later,
         CASE WHEN p >= 1 THEN u WHEN p <= 0 THEN 1.0::DOUBLE
              ELSE (u / (1 - u)) * ((1 - p) / p) / (1 + (u / (1 - u)) * ((1 - p) / p)) END AS rank
  FROM q),
c AS (
  SELECT *, (sum(size) OVER (PARTITION BY unknown, src ORDER BY later, rank, u, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT - size AS start
  FROM r),
e AS (SELECT *, whole + CASE WHEN size > 0 AND start + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END AS copies FROM c)
SELECT doc_id, size, total AS source_size, target, copies::BIGINT AS copies, (copies * size)::BIGINT AS taken FROM e
""",
    "op11_audit": r"""
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
k AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT d.part, coalesce(k.good, 0) AS good, coalesce(k.toxic, 0) AS toxic,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * len(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS mask
  FROM d LEFT JOIN k ON d.doc_id = k.doc_id),
g AS (SELECT part, mask, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
x AS (
  SELECT g.*, filter_order, step, filter_order[step] AS f,
         contains(mask, filter_order[step]) AS fails,
         coalesce(len(list_filter(string_split(filter_order[1:step - 1], ''), lambda c: c <> '' AND contains(mask, c))), 0) > 0 AS before
  FROM g, steps)
SELECT part, filter_order, step,
       sum(CASE WHEN NOT fails AND NOT before THEN docs ELSE 0 END)::BIGINT AS kept,
       sum(CASE WHEN fails AND NOT before THEN docs ELSE 0 END)::BIGINT AS removed,
       sum(CASE WHEN fails AND before THEN docs ELSE 0 END)::BIGINT AS redundant,
       sum(CASE WHEN mask = f THEN docs ELSE 0 END)::BIGINT AS unique_fails,
       sum(CASE WHEN fails AND NOT before THEN good ELSE 0 END)::BIGINT AS good_lost,
       sum(CASE WHEN fails AND NOT before THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
       (sum(sum(CASE WHEN fails AND NOT before THEN docs ELSE 0 END)) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM x GROUP BY part, filter_order, step, f
""",
    "op12_spelling": r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents),
long_runs AS (SELECT doc_id, run, count(*) AS times FROM runs WHERE len(run) >= 6 GROUP BY doc_id, run),
bytes AS (
  SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
                   ELSE [192 | (unicode(c)::BIGINT >> 6), 128 | (unicode(c)::BIGINT & 63)] END)) AS b
  FROM long_runs),
hashed AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    flatten(list_transform(b, lambda x: [x & 1, (x >> 1) & 1, (x >> 2) & 1, (x >> 3) & 1, (x >> 4) & 1, (x >> 5) & 1, (x >> 6) & 1, x >> 7]))),
    lambda h, bit: xor(h >> 1, 3988292384 * (xor(h, bit) & 1)))) AS h
  FROM bytes),
results AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM results WHERE len(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
holes AS (
  SELECT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS shorter, substr(word, 1, i - 1) || '?' || substr(word, i + 1) AS pattern
  FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b USING (pattern) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.shorter = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.shorter = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.m >= 5 * w.n THEN (SELECT min(other) FROM pairs p WHERE p.word = w.word AND p.m = b.m) END AS form,
         CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
ways AS (
  SELECT word, word AS root, 0 AS steps FROM forms
  UNION ALL SELECT ways.word, forms.form, steps + 1 FROM ways JOIN forms ON ways.root = forms.word WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, w.root, f.n::BIGINT AS n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM forms f JOIN (SELECT word, arg_max(root, steps) AS root FROM ways GROUP BY word) w USING (word)
""",
}
