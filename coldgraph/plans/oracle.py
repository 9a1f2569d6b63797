"""The same queries in plain SQL over the given tables, for checking results.

Written without regard to scale: pairs are enumerated and distances compared by
brute force, which is what makes these statements an independent check.
"""

from __future__ import annotations

NODES = """
emb AS (
  SELECT vec_id AS id, label,
         list_transform(embedding, lambda x, i: x::DOUBLE + CASE WHEN i - 1 = label THEN 0.3 ELSE 0.0 END) AS features
  FROM embeddings)"""

EDGES = """
cand AS (
  SELECT a.vec_id AS i, a.label AS i_label, (a.vec_id + t.t * 7919) % n.n AS j
  FROM embeddings a, range(1, 97) t(t), (SELECT count(*) AS n FROM embeddings) n),
edges AS (
  SELECT least(i, j) AS src, greatest(i, j) AS dst, count(*)::DOUBLE AS weight
  FROM cand JOIN embeddings b ON b.vec_id = cand.j
  WHERE i <> j AND (i_label = b.label OR (i * 7919 + j * 104729) % 1000 < 28)
  GROUP BY 1, 2),
sym AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)"""

RETAIL = """
lines AS (
  SELECT o_custkey * 2 AS customer, l_partkey * 2 + 1 AS part, l_quantity AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
edges AS (
  SELECT least(customer, part) AS src, greatest(customer, part) AS dst, sum(quantity) AS weight
  FROM lines GROUP BY 1, 2 HAVING sum(quantity) > 0),
sym AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)"""

INCIDENCE = "inc AS (SELECT DISTINCT l_partkey AS entity, l_orderkey AS context FROM lineitem)"


def cold(id_: str, share: float) -> str:
    return f"({id_} * 7919) % 1000 < {1000 * share}"


def split(share: float) -> str:
    return f"""
warm AS (SELECT * FROM emb WHERE NOT ({cold('id', share)})),
cold AS (SELECT * FROM emb WHERE {cold('id', share)}),
wedges AS (SELECT * FROM edges WHERE NOT ({cold('src', share)}) AND NOT ({cold('dst', share)})),
truth AS (SELECT src, dst FROM sym WHERE {cold('src', share)} AND NOT ({cold('dst', share)}))"""


def knn(queries: str, base: str, k: int, metric: str = "euclidean", name: str = "knn",
        column: str = "features") -> str:
    dist = {
        "euclidean": f"list_distance(q.{column}, b.{column})",
        "cosine": f"1 - list_cosine_similarity(q.{column}, b.{column})",
    }[metric]
    return f"""
{name} AS (
  SELECT src, dst, rank::INTEGER AS rank, dist FROM (
    SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM (
      SELECT q.id AS src, b.id AS dst, round({dist}, 6) AS dist
      FROM {queries} q JOIN {base} b ON q.id <> b.id))
  WHERE rank <= {k})"""


def votes(found: str, labels: str, weight: str = "1.0", name: str = "votes") -> str:
    return f"""
{name} AS (
  SELECT id, pred, votes FROM (
    SELECT id, label AS pred, votes, row_number() OVER (PARTITION BY id ORDER BY votes DESC, label) AS n FROM (
      SELECT k.src AS id, l.label, round(sum({weight}), 6)::DOUBLE AS votes
      FROM {found} k JOIN {labels} l ON l.id = k.dst GROUP BY 1, 2))
  WHERE n = 1)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def long(table: str, column: str, *keys: str) -> str:
    named = ", ".join(keys)
    return f"""SELECT {named}, (pos - 1)::INTEGER AS pos, round({column}[pos], 6) AS value
FROM (SELECT *, unnest(range(1, len({column}) + 1)) AS pos FROM {table})"""


def elements(table: str, column: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT id, pos, {column}[pos] AS v
  FROM (SELECT id, {column}, unnest(range(1, len({column}) + 1)) AS pos FROM {table}))"""


WITH_DEGREE = """
deg AS MATERIALIZED (SELECT src AS id, sum(weight) AS d FROM sym GROUP BY 1),
eld AS MATERIALIZED (SELECT id, pos, v, d FROM el JOIN deg USING (id))"""
DIFFERENCES = """
ends AS MATERIALIZED (
  SELECT src, dst, weight, a.features AS fa, b.features AS fb
  FROM edges JOIN emb a ON a.id = src JOIN emb b ON b.id = dst),
diff AS MATERIALIZED (
  SELECT src, dst, weight, pos, fa[pos] - fb[pos] AS v
  FROM (SELECT *, unnest(range(1, len(fa) + 1)) AS pos FROM ends))"""

PROPAGATION = """
deg AS (
  SELECT emb.id, 1 + coalesce(sum(weight), 0) AS d FROM emb LEFT JOIN sym ON sym.src = emb.id GROUP BY 1),
links AS (
  SELECT s.src, s.dst, s.weight / {scale} AS weight
  FROM sym s JOIN deg a ON a.id = s.src JOIN deg b ON b.id = s.dst
  UNION ALL SELECT id, id, 1 / d FROM deg)"""
SYM_SCALE = PROPAGATION.format(scale="sqrt(a.d * b.d)")
RW_SCALE = PROPAGATION.format(scale="b.d")


def hop(before: str, after: str) -> str:
    return f"""
{after} AS (
  SELECT l.dst AS id, pos, sum(l.weight * x.v) AS v FROM links l JOIN {before} x ON x.id = l.src GROUP BY 1, 2)"""


MIX = "(((({0}) % 2147483648) * 2654435761) % 4294967296)"


def mix_pair(a: str, b: str) -> str:
    return MIX.format(f"({MIX.format(a)} >> 3) + {MIX.format(b)}")


HELD = "(src * 7919 + dst * 104729) % 1000 < 200"
PAIRS = f"""
train AS (SELECT * FROM edges WHERE NOT ({HELD})),
held AS (SELECT * FROM edges WHERE {HELD}),
bucketed AS (
  SELECT id, ({MIX.format('id')} >> 8) % ((SELECT count(*) FROM emb) + 65535 - ((SELECT count(*) FROM emb) + 65535) % 65536 >> 16) AS bucket
  FROM emb),
numbered AS (
  SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY id) - 1 AS place,
         count(*) OVER (PARTITION BY bucket) AS size FROM bucketed),
sizes AS (SELECT DISTINCT bucket, size FROM numbered),
draws AS (
  SELECT src, dst, t, {mix_pair('src', 'dst * 8 + t')} AS h, {mix_pair('dst * 8 + t', 'src')} AS g FROM held, range(0, 8) r(t)),
aimed AS (
  SELECT src, dst, t, s.bucket, (g >> 4) % s.size AS place
  FROM draws JOIN sizes s ON s.bucket = (h >> 8) % (SELECT 1 + max(bucket) FROM sizes)),
tried AS (
  SELECT least(a.src, n.id) AS src, greatest(a.src, n.id) AS dst,
         row_number() OVER (PARTITION BY a.src, a.dst, t // 4 ORDER BY t) AS n
  FROM aimed a JOIN numbered n USING (bucket, place)
  WHERE a.src <> n.id
    AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = least(a.src, n.id) AND e.dst = greatest(a.src, n.id))),
negatives AS (SELECT DISTINCT src, dst FROM tried WHERE n = 1),
pairs AS (SELECT src, dst, 1 AS y FROM held UNION ALL SELECT src, dst, 0 FROM negatives)"""


def scored(expression: str) -> str:
    return f"""
scored AS (
  SELECT p.src, p.dst, p.y, round({expression}, 6) AS score
  FROM pairs p JOIN emb a ON a.id = p.src JOIN emb b ON b.id = p.dst)"""


COSINE = scored("list_cosine_similarity(a.features, b.features)")


def sweep(shares: tuple[float, ...], models: dict[str, str], table: str, dataset: str) -> list[str]:
    """One CTE chain per (share, model); the last is named ``res_<dataset>``."""
    parts, rows = [], []
    for s, share in enumerate(shares):
        tag = f"{dataset}{s}"
        parts.append(f"\nw_{tag} AS (SELECT * FROM {table} WHERE NOT ({cold('id', share)}))")
        parts.append(f"\nc_{tag} AS (SELECT * FROM {table} WHERE {cold('id', share)})")
        for m, (model, metric) in enumerate(models.items()):
            parts.append(knn(f"c_{tag}", f"w_{tag}", 10, metric, f"k_{tag}_{m}"))
            parts.append(votes(f"k_{tag}_{m}", f"w_{tag}", name=f"v_{tag}_{m}"))
            rows.append(
                f"SELECT '{dataset}' AS dataset, 'classification' AS task, '{model}' AS model, "
                f"{share}::DOUBLE AS cold_share, 'accuracy' AS metric, "
                f"round(avg(CASE WHEN v.pred = c.label THEN 1.0 ELSE 0.0 END), 6) AS value "
                f"FROM c_{tag} c LEFT JOIN v_{tag}_{m} v ON v.id = c.id WHERE c.label IS NOT NULL"
            )
    parts.append(f"\nres_{dataset} AS (" + "\nUNION ALL ".join(rows) + ")")
    return parts


RAW = "\nraw AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS features FROM embeddings)"
BOTH_MODELS = {"vote_euclidean": "euclidean", "vote_cosine": "cosine"}
BOTH = [
    NODES, RAW,
    *sweep((0.05, 0.1, 0.2, 0.5), BOTH_MODELS, "emb", "planted"),
    *sweep((0.05, 0.1, 0.2, 0.5), BOTH_MODELS, "raw", "raw"),
    "\nres AS (SELECT * FROM res_planted UNION ALL SELECT * FROM res_raw)",
]


def report(predictions: str) -> str:
    """Per-class and overall scores of ``predictions(grp, label, pred)``, by group and in all."""
    return with_(*predictions) + """,
grouped AS (
  SELECT 0 AS total, grp, label, pred FROM preds UNION ALL SELECT 1, NULL, label, pred FROM preds),
classes AS (
  SELECT DISTINCT total, grp, label AS class FROM grouped UNION
  SELECT DISTINCT total, grp, pred FROM grouped WHERE pred IS NOT NULL),
per AS (
  SELECT c.total, c.grp, c.class,
         count(*) FILTER (g.label = c.class) AS truth,
         count(*) FILTER (g.pred = c.class) AS guess,
         count(*) FILTER (g.label = c.class AND g.pred = c.class) AS hit
  FROM classes c JOIN grouped g ON g.total = c.total AND g.grp IS NOT DISTINCT FROM c.grp
  GROUP BY 1, 2, 3),
sc AS (
  SELECT *, CASE WHEN guess > 0 THEN hit / guess ELSE 0 END AS p,
         CASE WHEN truth > 0 THEN hit / truth ELSE 0 END AS r,
         CASE WHEN truth + guess > 0 THEN 2 * hit / (truth + guess) ELSE 0 END AS f FROM per)
SELECT grp, class AS label, truth AS support, round(p, 6) AS precision, round(r, 6) AS recall,
       round(f, 6) AS f1, NULL::DOUBLE AS accuracy FROM sc
UNION ALL
SELECT grp, NULL, sum(truth)::BIGINT, round(avg(p), 6), round(avg(r), 6), round(avg(f), 6),
       round(sum(hit) / sum(truth), 6) FROM sc GROUP BY total, grp"""


LADDER = """,
lad AS (SELECT score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM scored GROUP BY 1),
tot AS (SELECT sum(pos) AS p, sum(neg) AS n FROM lad)"""

PLANTED = with_(NODES, EDGES)
SPLIT = with_(NODES, EDGES, split(0.2))
SPLIT_KNN = with_(NODES, EDGES, split(0.2), knn("cold", "warm", 10))
SPLIT_VOTE = with_(NODES, EDGES, split(0.2), knn("cold", "warm", 10), votes("knn", "warm"))
ALL_VOTE = [NODES, knn("emb", "emb", 10), votes("knn", "emb")]



def given_map(table: str, name: str) -> str:
    """Coordinates ``z`` of ``table`` by the catalog's arithmetic map."""
    return f"""
{name} AS (
  SELECT id, any_value(label) AS label, any_value(features) AS features, list(v ORDER BY q) AS z FROM (
    SELECT id, q, any_value(label) AS label, any_value(features) AS features,
           sum((features[p + 1] - (p % 5) / 50) * (((p + 1) * (q + 3)) % 7 - 3) / 10) AS v
    FROM {table}, range(0, 64) p(p), range(0, 4) q(q) GROUP BY id, q)
  GROUP BY id)"""


def quality(found: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT count(*) FILTER (n > 0) AS queries, count(*) FILTER (n = 0) AS without_truth,
         round(avg(h / 10) FILTER (n > 0), 6) AS precision, round(avg(h / n) FILTER (n > 0), 6) AS recall FROM (
    SELECT c.id, (SELECT count(*) FROM truth t WHERE t.src = c.id) AS n,
           (SELECT count(*) FROM truth t JOIN {found} k ON k.src = t.src AND k.dst = t.dst WHERE t.src = c.id) AS h
    FROM cold c))"""


GIVEN = [NODES, EDGES, split(0.2), given_map("warm", "gwarm"), given_map("cold", "gcold")]
GIVEN_HOPS = [
    *GIVEN, knn("gcold", "gwarm", 10, column="z"), """
allsym AS (
  SELECT src, dst, sum(weight) AS weight FROM (
    SELECT src, dst, weight FROM wedges UNION ALL SELECT dst, src, weight FROM wedges
    UNION ALL SELECT src, dst, 1.0 FROM knn UNION ALL SELECT dst, src, 1.0 FROM knn) GROUP BY 1, 2)""",
    SYM_SCALE.replace("sym", "allsym"), elements("emb", "features", "h0"), hop("h0", "h1"), hop("h1", "h2"),
]
RETAIL_FEATURES = """
f AS MATERIALIZED (
  SELECT c_custkey * 2 AS id, c_acctbal::DOUBLE / 1000 AS a, c_nationkey::DOUBLE AS b FROM customer UNION ALL
  SELECT p_partkey * 2 + 1, p_retailprice::DOUBLE / 1000, p_size::DOUBLE FROM part),
fd AS MATERIALIZED (SELECT f.id, a, b, d FROM f JOIN (SELECT src AS id, sum(weight)::DOUBLE AS d FROM sym GROUP BY 1) USING (id))"""

NEAREST_CENTER = """
centers AS (SELECT j, list_transform(range(0, 64), lambda p: CASE WHEN p = j THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) AS z FROM range(0, 10) t(j)),
nearest AS (SELECT id, features, j FROM (
  SELECT id, features, j, row_number() OVER (PARTITION BY id ORDER BY list_distance(features, z), j) AS n FROM emb, centers) WHERE n = 1)"""

def newton(step: int) -> str:
    """Weights ``a, b, c`` (intercept last) after one more step, by Cramer's rule for the 3 x 3 system."""
    det = lambda *m: f"({m[0]}*({m[4]}*{m[8]}-{m[5]}*{m[7]})-{m[1]}*({m[3]}*{m[8]}-{m[5]}*{m[6]})+{m[2]}*({m[3]}*{m[7]}-{m[4]}*{m[6]}))"
    whole = det("aa", "ab", "ac", "ab", "bb", "bc", "ac", "bc", "cc")
    solved = (
        det("ga", "ab", "ac", "gb", "bb", "bc", "gc", "bc", "cc"),
        det("aa", "ga", "ac", "ab", "gb", "bc", "ac", "gc", "cc"),
        det("aa", "ab", "ga", "ab", "bb", "gb", "ac", "bc", "gc"),
    )
    sums = ", ".join(f"sum(h * {x}{y}) AS {n}" for n, x, y in (
        ("aa", "x1", "*x1"), ("ab", "x1", "*x2"), ("ac", "x1", ""), ("bb", "x2", "*x2"), ("bc", "x2", ""), ("cc", "1", "")))
    return f"""
s{step} AS (
  SELECT any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, {sums}, sum(x1 * (y - p)) AS ga, sum(x2 * (y - p)) AS gb, sum(y - p) AS gc
  FROM (SELECT *, p * (1 - p) AS h FROM (SELECT *, 1 / (1 + exp(-(a * x1 + b * x2 + c))) AS p FROM rows_, w{step - 1}))),
w{step} AS (SELECT a + {solved[0]} / {whole} AS a, b + {solved[1]} / {whole} AS b, c + {solved[2]} / {whole} AS c FROM s{step})"""


ORACLE: dict[str, str] = {
    "newton_classifier": with_(
        """rows_ AS (SELECT p_size::DOUBLE / 50 AS x1, p_retailprice::DOUBLE / 2000 AS x2, split_part(p_brand, '#', 2)::INTEGER % 2 AS y FROM part),
w0 AS (SELECT 0::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS c)""",
        newton(1), newton(2), newton(3),
    ) + "SELECT unnest([0, 1, 2])::INTEGER AS term, round(unnest([a, b, c]), 6) AS weight FROM w3",
    "chain_embedding": """
        WITH ranked AS (SELECT c_custkey * 2 AS id, dense_rank() OVER (ORDER BY c_nationkey) - 1 AS place FROM customer),
        chain AS (SELECT max(place) AS n FROM ranked),
        nodes AS (SELECT id, place, TRUE AS outer_node FROM ranked UNION ALL SELECT DISTINCT place * 2 + 1, place, FALSE FROM ranked),
        waves AS (SELECT j, n, pi() * j / n AS angle, (cos(pi() * j / n) + sqrt(cos(pi() * j / n) ** 2 + 3)) / 3 AS value
                  FROM chain, range(1, 5) t(j)),
        signs AS (SELECT j, sign(arg_max(cos(angle * place), id)) AS sign FROM ranked, waves
                  WHERE round(abs(cos(angle * place)), 9) = 1 GROUP BY j)
        SELECT id, (j - 1)::INTEGER AS pos, round(value, 6) AS eigenvalue,
               round(sign * cos(angle * place) * CASE WHEN outer_node THEN 1 / value ELSE 1 END
                     / sqrt(1.5 * n + n / (2 * value ** 2)), 5) AS value
        FROM nodes, waves JOIN signs USING (j)""",
    "matched_accuracy": """
        WITH cells AS (
          SELECT p_size % 3 AS c, split_part(p_brand, '#', 2)::INTEGER % 3 AS l, count(*) AS n FROM part GROUP BY 1, 2),
        matches AS (
          SELECT a, b, 3 - a - b AS c FROM range(0, 3) x(a), range(0, 3) y(b) WHERE a <> b)
        SELECT (SELECT sum(n) FROM cells)::BIGINT AS n, round(max(hit) / (SELECT sum(n) FROM cells), 6) AS matched FROM (
          SELECT m.a, m.b, sum(n) AS hit FROM matches m JOIN cells k
            ON k.l = CASE k.c WHEN 0 THEN m.a WHEN 1 THEN m.b ELSE m.c END GROUP BY 1, 2)""",
    "laplacian_plain": with_(RETAIL) + """
        SELECT src AS i, dst AS j, round(-weight, 6)::DOUBLE AS value FROM sym
        UNION ALL SELECT src, src, round(sum(weight), 6)::DOUBLE FROM sym GROUP BY 1""",
    "given_map_coords": with_(NODES, given_map("emb", "g")) + long("g", "z", "id"),
    "stream_embed_given": with_(
        "raw AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS features FROM embeddings)",
        given_map("raw", "g"),
    ) + long("g", "z", "id"),
    "stream_links": with_(*GIVEN, RAW, given_map("raw", "g"), knn("g", "gwarm", 10, column="z")) + "SELECT * FROM knn",
    "stream_predict_given": with_(
        *GIVEN, RAW, given_map("raw", "g"), knn("g", "gwarm", 10, column="z"), votes("knn", "warm")
    ) + "SELECT g.id, v.pred FROM g LEFT JOIN votes v ON v.id = g.id",
    "knn_all_cells": with_(NODES, knn("emb", "emb", 10)) + "SELECT * FROM knn",
    "compare_given_spaces": with_(
        *GIVEN, knn("cold", "warm", 10, name="k1"), knn("gcold", "gwarm", 10, column="z", name="k2"),
        quality("k1", "q1"), quality("k2", "q2"),
    ) + "SELECT 'features' AS space, * FROM q1 UNION ALL SELECT 'given_map', * FROM q2",
    "given_representation": with_(*GIVEN_HOPS) + "SELECT id, (pos - 1)::INTEGER AS pos, round(v, 6) AS value FROM h2",
    "given_representation_tokens": with_(*GIVEN_HOPS) + """
        SELECT id, (64 * hop + pos - 1)::INTEGER AS pos, round(v, 6) AS value FROM (
          SELECT 0 AS hop, * FROM h0 UNION ALL SELECT 1, * FROM h1 UNION ALL SELECT 2, * FROM h2)""",
    "given_representation_sequence": with_(
        *GIVEN, "gall AS (SELECT * FROM gcold UNION ALL SELECT * FROM gwarm)", knn("gall", "gwarm", 10, column="z"),
        elements("warm", "features", "el"),
    ) + """
        SELECT k.src AS id, (pos - 1)::INTEGER AS pos, round(sum(v * pow(0.5, rank - 1)), 6) AS value
        FROM knn k JOIN el ON el.id = k.dst GROUP BY 1, 2""",
    "retail_map_eigenvalues": with_(RETAIL, RETAIL_FEATURES, """
        l AS (
          SELECT sum(weight * (x.a - y.a) * (x.a - y.a)) AS aa, sum(weight * (x.a - y.a) * (x.b - y.b)) AS ab,
                 sum(weight * (x.b - y.b) * (x.b - y.b)) AS bb
          FROM edges JOIN f x ON x.id = src JOIN f y ON y.id = dst),
        m AS (SELECT sum(d) AS t, sum(d * a) / sum(d) AS a, sum(d * b) / sum(d) AS b FROM fd),
        c AS (SELECT sum(d * (fd.a - m.a) * (fd.a - m.a)) AS aa, sum(d * (fd.a - m.a) * (fd.b - m.b)) AS ab,
                     sum(d * (fd.b - m.b) * (fd.b - m.b)) AS bb FROM fd, m),
        s AS (SELECT aa + 0.01 * (aa + bb) / 2 AS aa, ab, bb + 0.01 * (aa + bb) / 2 AS bb FROM c),
        q AS (SELECT s.aa * s.bb - s.ab * s.ab AS two, l.aa * s.bb + l.bb * s.aa - 2 * l.ab * s.ab AS one,
                     l.aa * l.bb - l.ab * l.ab AS zero FROM l, s)""") + """
        SELECT 0::INTEGER AS dim, round((one - sqrt(one * one - 4 * two * zero)) / (2 * two), 6) AS value FROM q
        UNION ALL SELECT 1, round((one + sqrt(one * one - 4 * two * zero)) / (2 * two), 6) FROM q""",
    "retail_regression": with_(RETAIL, RETAIL_FEATURES, """
        y AS (SELECT f.id, f.a, f.b, coalesce(d, 0) / 100 AS y FROM f LEFT JOIN fd USING (id)),
        m AS (SELECT avg(a) AS a, avg(b) AS b, avg(y) AS y FROM y),
        c AS (SELECT sum((y.a - m.a) * (y.a - m.a)) AS aa, sum((y.a - m.a) * (y.b - m.b)) AS ab,
                     sum((y.b - m.b) * (y.b - m.b)) AS bb, sum((y.a - m.a) * (y.y - m.y)) AS ay,
                     sum((y.b - m.b) * (y.y - m.y)) AS by_ FROM y, m),
        r AS (SELECT aa + 1e-6 * (aa + bb) / 2 AS aa, ab, bb + 1e-6 * (aa + bb) / 2 AS bb, ay, by_ FROM c),
        w AS (SELECT (bb * ay - ab * by_) / (aa * bb - ab * ab) AS a, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS b FROM r)""") + """
        SELECT y.id, 0::INTEGER AS pos, round(m.y + (y.a - m.a) * w.a + (y.b - m.b) * w.b, 6) AS value FROM y, m, w""",
    "part_similarity": """
        SELECT 0::INTEGER AS angle, round(abs(corr(p_size::DOUBLE, p_retailprice::DOUBLE)), 6) AS cosine FROM part""",
    "part_orthonormality": with_(RETAIL) + """
        SELECT round(abs(sum(d * a * b)) / sqrt(sum(d * a * a) * sum(d * b * b)), 6) AS deviation FROM (
          SELECT p_size::DOUBLE AS a, p_retailprice::DOUBLE AS b, sum(weight)::DOUBLE AS d
          FROM part JOIN sym ON src = p_partkey * 2 + 1 GROUP BY p_partkey, p_size, p_retailprice)""",
    "label_silhouette": with_(NODES, """
        away AS (
          SELECT x.id, x.label AS own, y.label AS label, sum(pow(list_distance(x.features, y.features), 2)) AS total, count(*) AS n
          FROM emb x JOIN emb y ON true GROUP BY 1, 2, 3),
        near AS (
          SELECT id, max(n) FILTER (label = own) AS size, sum(total) FILTER (label = own) AS inside,
                 min(total / n) FILTER (label <> own) AS b FROM away GROUP BY 1),
        pt AS (SELECT size, inside / (size - 1) AS a, b FROM near)""") + """
        SELECT count(*) AS n, round(avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM pt""",
    "load_nodes": with_(NODES) + long("emb", "features", "id", "label"),
    "node_report": """
        SELECT count(*) AS rows, 0::BIGINT AS rejected, count(*) FILTER (c_nationkey IS NULL) AS unlabelled,
               count(*) - count(DISTINCT c_custkey) AS duplicate_ids, 2 AS dim FROM customer""",
    "normalize_edges": with_(RETAIL) + "SELECT src, dst, round(weight, 6) AS weight FROM edges",
    "symmetric_edges": with_(RETAIL) + "SELECT src, dst, round(weight, 6) AS weight FROM sym",
    "save_load_edges": with_(RETAIL) + "SELECT src, dst, round(weight, 6) AS weight FROM edges",
    "save_load_nodes": with_(NODES) + long("emb", "features", "id", "label"),
    "save_load_pruned": with_(RETAIL) + "SELECT src, dst, round(weight, 6) AS weight FROM sym WHERE src IN (2, 3, 20, 21)",
    "save_load_joined": with_(RETAIL) + """
        SELECT src, dst, c_nationkey::INTEGER AS label FROM sym JOIN customer ON src = c_custkey * 2 WHERE c_nationkey IS NOT NULL""",
    "save_load_model": with_(NODES, given_map("emb", "g")) + long("g", "z", "id"),
    "confusion_cells": """
        SELECT a.p_size AS label, b.p_size AS pred, count(*) AS n
        FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_size IS NOT NULL AND b.p_size IS NOT NULL GROUP BY 1, 2""",
    "assign_given": with_(NODES, NEAREST_CENTER) + "SELECT id, j::INTEGER AS cluster FROM nearest",
    "lloyd_given": with_(NODES, NEAREST_CENTER, """
        parts AS (SELECT j, p, count(*) AS n, avg(features[p + 1]) AS v FROM nearest, range(0, 64) t(p) GROUP BY 1, 2)""") + """
        SELECT c.j::INTEGER AS cluster, p.p::INTEGER AS pos, coalesce(n, 0) AS n, round(coalesce(v, c.z[p.p + 1]), 6) AS value
        FROM centers c CROSS JOIN range(0, 64) p(p) LEFT JOIN parts ON parts.j = c.j AND parts.p = p.p""",
    "degrees": with_(RETAIL) + """
        SELECT n.id, count(s.src) AS degree, round(coalesce(sum(s.weight), 0), 6) AS weighted_degree
        FROM (SELECT c_custkey * 2 AS id FROM customer UNION ALL SELECT p_partkey * 2 + 1 FROM part) n
        LEFT JOIN sym s ON s.src = n.id GROUP BY 1""",
    "detect_cold": SPLIT + """
        SELECT id, label FROM emb
        WHERE id NOT IN (SELECT src FROM wedges UNION SELECT dst FROM wedges)""",
    "cold_split": with_(RETAIL) + f"""
        SELECT src, dst, CASE WHEN {cold('src', 0.2)} OR {cold('dst', 0.2)} THEN 'truth' ELSE 'warm' END AS part
        FROM edges""",
    "induced_subgraph": with_(RETAIL, """
        ids AS (SELECT c_custkey * 2 AS id FROM customer WHERE c_mktsegment = 'BUILDING'
                UNION ALL SELECT p_partkey * 2 + 1 FROM part WHERE p_size <= 25)""") + """
        SELECT src, dst, round(weight, 6) AS weight FROM edges
        WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)""",
    "knn_graph": with_(NODES, knn("emb", "emb", 10)) + """
        SELECT least(src, dst) AS src, greatest(src, dst) AS dst, count(*)::DOUBLE AS weight
        FROM knn GROUP BY 1, 2""",
    "cooccurrence_degrees": with_(INCIDENCE) + """
        SELECT a.entity AS id, count(b.entity)::DOUBLE AS weighted_degree
        FROM inc a LEFT JOIN inc b ON b.context = a.context AND b.entity <> a.entity GROUP BY 1""",
    "cooccurrence_sums": with_(INCIDENCE) + """
        SELECT id, degree, pos::INTEGER AS pos, round(CASE pos WHEN 0 THEN a ELSE b END, 6) AS value FROM (
          SELECT x.entity AS id, count(y.entity)::DOUBLE AS degree, coalesce(sum(p_size), 0)::DOUBLE AS a,
                 coalesce(sum(p_retailprice / 1000), 0) AS b
          FROM inc x LEFT JOIN inc y ON y.context = x.context AND y.entity <> x.entity
          LEFT JOIN part ON p_partkey = y.entity GROUP BY 1), range(0, 2) r(pos)""",
    "cooccurrence_weights": with_(INCIDENCE, """
        pairs AS (
          SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS src, greatest(a.l_partkey, b.l_partkey) AS dst
          FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
          WHERE a.l_partkey <> b.l_partkey)""") + """
        SELECT p.src, p.dst, count(*)::DOUBLE AS weight
        FROM pairs p JOIN inc a ON a.entity = p.src JOIN inc b ON b.entity = p.dst AND b.context = a.context
        GROUP BY 1, 2""",
    "laplacian_entries": with_(RETAIL, "deg AS (SELECT src AS id, sum(weight) AS d FROM sym GROUP BY 1)") + """
        SELECT s.src AS i, s.dst AS j, round(-s.weight / sqrt(a.d * b.d), 6) AS value
        FROM sym s JOIN deg a ON a.id = s.src JOIN deg b ON b.id = s.dst
        UNION ALL SELECT id, id, 1.0 FROM deg""",
    "laplacian_random_walk": with_(RETAIL, "deg AS (SELECT src AS id, sum(weight) AS d FROM sym GROUP BY 1)") + """
        SELECT s.src AS i, s.dst AS j, -s.weight / a.d AS value FROM sym s JOIN deg a ON a.id = s.src
        UNION ALL SELECT id, id, 1.0 FROM deg""",
    "rayleigh_features": with_(NODES, EDGES, elements("emb", "features", "el"), WITH_DEGREE, DIFFERENCES, """
        mu AS (SELECT pos, sum(d * v) / sum(d) AS m FROM eld GROUP BY 1),
        den AS (SELECT pos, sum(d * (v - m) * (v - m)) AS s FROM eld JOIN mu USING (pos) GROUP BY 1),
        num AS (SELECT pos, sum(weight * v * v) AS r FROM diff GROUP BY 1)""") + """
        SELECT (pos - 1)::INTEGER AS dim, round(r / s, 6) AS value FROM num JOIN den USING (pos)""",
    "spectral_moments": with_(NODES, EDGES, elements("emb", "features", "el"), WITH_DEGREE, DIFFERENCES, """
        dcol AS MATERIALIZED (SELECT pos, list(v ORDER BY src, dst) AS c, list(weight * v ORDER BY src, dst) AS wc
                              FROM diff GROUP BY 1),
        ncol AS MATERIALIZED (SELECT pos, list(v ORDER BY id) AS c, list(d * v ORDER BY id) AS wc FROM eld GROUP BY 1)""") + """
        SELECT 'laplacian' AS name, (x.pos - 1)::INTEGER AS p, (y.pos - 1)::INTEGER AS q,
               round(list_dot_product(x.wc, y.c), 6) AS value FROM dcol x, dcol y
        UNION ALL
        SELECT 'degree', (x.pos - 1)::INTEGER, (y.pos - 1)::INTEGER, round(list_dot_product(x.wc, y.c), 6)
        FROM ncol x, ncol y
        UNION ALL
        SELECT 'mean', (pos - 1)::INTEGER, 0, round(sum(d * v) / sum(d), 6) FROM eld GROUP BY 2""",
    "knn_features": with_(NODES, knn("emb", "emb", 10)) + "SELECT * FROM knn",
    "knn_cosine": with_(NODES, knn("emb", "emb", 10, "cosine")) + "SELECT * FROM knn",
    "knn_partitioned": with_(NODES, knn("emb", "emb", 10)) + "SELECT * FROM knn",
    "neighbor_quality": SPLIT_KNN + """,
        per AS (
          SELECT c.id, (SELECT count(*) FROM truth t WHERE t.src = c.id) AS n,
                 (SELECT count(*) FROM truth t JOIN knn k ON k.src = t.src AND k.dst = t.dst WHERE t.src = c.id) AS h
          FROM cold c)
        SELECT count(*) FILTER (n > 0) AS queries, count(*) FILTER (n = 0) AS without_truth,
               round(avg(h / 10) FILTER (n > 0), 6) AS precision, round(avg(h / n) FILTER (n > 0), 6) AS recall
        FROM per""",
    "augment_edges": SPLIT_KNN + """
        SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(weight) AS weight FROM (
          SELECT src, dst, weight FROM wedges UNION ALL SELECT src, dst, 0.5 FROM knn) GROUP BY 1, 2""",
    "propagate": with_(NODES, EDGES, SYM_SCALE, elements("emb", "features", "h0"), hop("h0", "h1"), hop("h1", "h2"))
    + "SELECT id, (pos - 1)::INTEGER AS pos, round(v, 6) AS value FROM h2",
    "propagate_random_walk": with_(NODES, EDGES, RW_SCALE, elements("emb", "features", "h0"), hop("h0", "h1"))
    + "SELECT id, (pos - 1)::INTEGER AS pos, round(v, 6) AS value FROM h1",
    "hop_tokens": with_(NODES, EDGES, SYM_SCALE, elements("emb", "features", "h0"), hop("h0", "h1"), hop("h1", "h2")) + """
        SELECT id, hop::INTEGER AS hop, (pos - 1)::INTEGER AS pos, round(v, 6) AS value FROM (
          SELECT 0 AS hop, * FROM h0 UNION ALL SELECT 1, * FROM h1 UNION ALL SELECT 2, * FROM h2)""",
    "neighbor_sequence": SPLIT_KNN + ",seq AS (SELECT k.src AS id, (5 - k.rank)::INTEGER AS step, w.features AS x FROM knn k JOIN warm w ON w.id = k.dst WHERE k.rank <= 5)"
    + long("seq", "x", "id", "step"),
    "scan_sequence": SPLIT_KNN + "," + elements("warm", "features", "el") + """
        SELECT k.src AS id, (pos - 1)::INTEGER AS pos, round(sum(v * pow(0.5, rank - 1)), 6) AS value
        FROM knn k JOIN el ON el.id = k.dst WHERE rank <= 5 GROUP BY 1, 2""",
    "sage_mean": SPLIT + "," + elements("emb", "features", "el") + f""",
        ws AS (SELECT src, dst FROM wedges UNION ALL SELECT dst, src FROM wedges),
        pick AS (
          SELECT src, dst FROM (
            SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY {mix_pair('src', 'dst')}, dst) AS n FROM ws)
          WHERE n <= 5),
        mean AS (SELECT src AS id, pos, avg(v) AS v FROM pick JOIN el ON el.id = dst GROUP BY 1, 2)
        SELECT id, (pos - 1)::INTEGER AS pos, round(v, 6) AS value FROM el
        UNION ALL
        SELECT el.id, (el.pos + 63)::INTEGER, round(coalesce(mean.v, 0), 6)
        FROM el LEFT JOIN mean ON mean.id = el.id AND mean.pos = el.pos""",
    "feature_baseline": with_(NODES) + long("emb", "features", "id"),
    "neighbor_vote": SPLIT_VOTE + "SELECT c.id, c.label, v.pred, v.votes FROM cold c LEFT JOIN votes v ON v.id = c.id",
    "neighbor_vote_distance": with_(
        NODES, EDGES, split(0.2), knn("cold", "warm", 10), votes("knn", "warm", "1 / (1 + dist)")
    ) + "SELECT c.id, c.label, v.pred, v.votes FROM cold c LEFT JOIN votes v ON v.id = c.id",
    "classification_report": report([*ALL_VOTE, f"""
        preds AS (SELECT CASE WHEN {cold('e.id', 0.2)} THEN 'cold' ELSE 'warm' END AS grp, e.label, v.pred
                  FROM emb e LEFT JOIN votes v ON v.id = e.id)"""]),
    "confusion_matrix": with_(*ALL_VOTE) + "SELECT e.label, "
    + ", ".join(f"count(*) FILTER (v.pred = {c}) AS pred_{c}" for c in range(10))
    + " FROM emb e JOIN votes v ON v.id = e.id GROUP BY 1",
    "clustering_scores": SPLIT_VOTE + """,
        cells AS (SELECT v.pred AS c, k.label AS l, count(*) AS n FROM votes v JOIN cold k ON k.id = v.id GROUP BY 1, 2),
        tot AS (SELECT sum(n) AS n FROM cells),
        cs AS (SELECT c, sum(n) AS n, max(n) AS top FROM cells GROUP BY 1),
        ls AS (SELECT l, sum(n) AS n FROM cells GROUP BY 1),
        hc AS (SELECT -sum(cs.n / tot.n * ln(cs.n / tot.n)) AS h, sum(cs.n * (cs.n - 1) / 2) AS p, sum(top) AS top FROM cs, tot),
        hl AS (SELECT -sum(ls.n / tot.n * ln(ls.n / tot.n)) AS h, sum(ls.n * (ls.n - 1) / 2) AS p FROM ls, tot),
        mi AS (SELECT sum(cells.n / tot.n * ln(cells.n * tot.n / (cs.n * ls.n))) AS i, sum(cells.n * (cells.n - 1) / 2) AS p
               FROM cells JOIN cs ON cs.c = cells.c JOIN ls ON ls.l = cells.l, tot)
        SELECT tot.n::BIGINT AS n, round(hc.top / tot.n, 6) AS purity, round(mi.i / ((hc.h + hl.h) / 2), 6) AS nmi,
               round((mi.p - hc.p * hl.p / (tot.n * (tot.n - 1) / 2))
                     / ((hc.p + hl.p) / 2 - hc.p * hl.p / (tot.n * (tot.n - 1) / 2)), 6) AS ari
        FROM tot, hc, hl, mi""",
    "split_edges": with_(RETAIL) + f"SELECT src, dst, CASE WHEN {HELD} THEN 'held' ELSE 'train' END AS part FROM edges",
    "negative_samples": with_(NODES, EDGES, PAIRS) + "SELECT src, dst FROM negatives",
    "exact_negatives": with_(NODES, EDGES, PAIRS, f"""
        ring AS (SELECT id, row_number() OVER (ORDER BY bucket, {MIX.format('id')}, id) - 1 AS pos FROM bucketed),
        near AS (SELECT src, count(*) AS degree FROM sym GROUP BY 1),
        asked AS (SELECT src, 2 * count(*) AS quota FROM held GROUP BY 1),
        whole AS (SELECT count(*) AS n FROM emb),
        walks AS (
          SELECT src, quota, ({mix_pair('src', '0')} * 1048576 + ({mix_pair('1', 'src')} >> 12)) % n AS start,
                 unnest(range(0, least(n, quota + coalesce(degree, 0) + 1))) AS i
          FROM asked LEFT JOIN near USING (src), whole),
        free AS (
          SELECT w.src, r.id AS dst, quota, row_number() OVER (PARTITION BY w.src ORDER BY i) AS k
          FROM (SELECT src, quota, i, (start + i) % n AS pos FROM walks, whole) w JOIN ring r USING (pos)
          WHERE r.id <> w.src AND NOT EXISTS (SELECT 1 FROM sym s WHERE s.src = w.src AND s.dst = r.id))""")
    + "SELECT src, dst FROM free WHERE k <= quota",
    "negative_deficits": with_(NODES, EDGES, PAIRS, """
        asked AS (SELECT src, 2 * count(*) AS asked FROM held GROUP BY 1),
        near AS (SELECT src, count(*) AS degree FROM sym GROUP BY 1),
        room AS (SELECT src, asked, (SELECT count(*) FROM emb) - 1 - degree AS possible FROM asked JOIN near USING (src))""")
    + "SELECT src, asked, possible, greatest(0, asked - possible) AS deficit FROM room",
    "score_links": with_(NODES, EDGES, PAIRS, scored("-list_distance(a.features, b.features)"))
    + "SELECT src, dst, y, score FROM scored",
    "score_links_cosine": with_(NODES, EDGES, PAIRS, COSINE) + "SELECT src, dst, y, score FROM scored",
    "topology_scores": with_(NODES, EDGES, PAIRS, """
        ts AS (SELECT src, dst FROM train UNION ALL SELECT dst, src FROM train),
        deg AS (SELECT src AS id, count(*) AS d FROM ts GROUP BY 1),
        com AS (SELECT p.src, p.dst, count(*) AS common, sum(1 / ln(d.d)) AS aa
                FROM pairs p JOIN ts a ON a.src = p.src JOIN ts b ON b.src = p.dst AND b.dst = a.dst
                JOIN deg d ON d.id = a.dst GROUP BY 1, 2)""") + """
        SELECT p.src, p.dst, coalesce(common, 0) AS common,
               round(CASE WHEN coalesce(a.d, 0) + coalesce(b.d, 0) - coalesce(common, 0) > 0
                     THEN coalesce(common, 0) / (coalesce(a.d, 0) + coalesce(b.d, 0) - coalesce(common, 0)) ELSE 0 END, 6) AS jaccard,
               round(coalesce(aa, 0), 6) AS adamic_adar, coalesce(a.d, 0) * coalesce(b.d, 0) AS preferential
        FROM pairs p LEFT JOIN deg a ON a.id = p.src LEFT JOIN deg b ON b.id = p.dst
        LEFT JOIN com ON com.src = p.src AND com.dst = p.dst""",
    "link_auc": with_(NODES, EDGES, PAIRS, COSINE) + LADDER + """
        SELECT tot.p::BIGINT AS positives, tot.n::BIGINT AS negatives,
               round((SELECT sum(a.pos * (CASE WHEN b.score < a.score THEN b.neg WHEN b.score = a.score THEN b.neg / 2 ELSE 0 END))
                      FROM lad a, lad b) / (tot.p * tot.n), 6) AS auc FROM tot""",
    "link_ap": with_(NODES, EDGES, PAIRS, COSINE) + LADDER + """,
        cum AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(pos + neg) OVER (ORDER BY score DESC) AS taken FROM lad)
        SELECT tot.p::BIGINT AS positives, tot.n::BIGINT AS negatives, round(sum(cum.pos / tot.p * tp / taken), 6) AS ap
        FROM cum, tot GROUP BY tot.p, tot.n""",
    "hits_at_k": with_(NODES, EDGES, PAIRS, COSINE) + """,
        ranked AS (SELECT src, y, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS n FROM scored),
        per AS (SELECT src, count(*) FILTER (y = 1) AS t, count(*) FILTER (y = 1 AND n <= 3) AS h FROM ranked GROUP BY 1)
        SELECT count(*) AS queries, round(avg(h / least(3, t)), 6) AS hits FROM per WHERE t > 0""",
    "mrr": with_(NODES, EDGES, PAIRS, COSINE) + """,
        ranked AS (SELECT src, y, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS n FROM scored),
        per AS (SELECT src, min(n) FILTER (y = 1) AS first FROM ranked GROUP BY 1)
        SELECT count(*) AS queries, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM per""",
    "recommend_links": with_(NODES, EDGES, """
        fresh AS (SELECT q.id AS src, b.id AS dst, round(list_distance(q.features, b.features), 6) AS dist
                  FROM emb q JOIN emb b ON b.id <> q.id
                  WHERE NOT EXISTS (SELECT 1 FROM sym WHERE sym.src = q.id AND sym.dst = b.id))""") + """
        SELECT src, dst, rank::INTEGER AS rank, dist FROM (
          SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM fresh) WHERE rank <= 5""",
    "cold_sweep_features": with_(
        NODES, *sweep((0.05, 0.1, 0.2, 0.5), {"features_vote": "euclidean"}, "emb", "planted")
    ) + "SELECT * FROM res_planted",
    "results_grid": with_(*BOTH, """
        grid AS (SELECT task, metric, cold_share, model, max(value) FILTER (dataset = 'planted') AS planted,
                        max(value) FILTER (dataset = 'raw') AS raw FROM res GROUP BY 1, 2, 3, 4)""") + """
        SELECT *, planted = max(planted) OVER (PARTITION BY task, metric, cold_share) AS planted_best,
               raw = max(raw) OVER (PARTITION BY task, metric, cold_share) AS raw_best FROM grid""",
    "sharpness": with_(*BOTH) + """
        SELECT dataset, task, model, metric,
               round(max(value) FILTER (cold_share = 0.05) - max(value) FILTER (cold_share = 0.5), 6) AS "drop"
        FROM res GROUP BY 1, 2, 3, 4""",
    "window_degrees": """
        WITH contacts AS (
          SELECT user_id AS src, -1 - event_id % 50 AS dst, ts FROM events WHERE event_type IN ('click', 'purchase', 'view')),
        ends AS (SELECT src AS id, ts FROM contacts UNION ALL SELECT dst, ts FROM contacts)
        SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, id, count(*) AS degree FROM ends
        WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM contacts)
        GROUP BY 1, 2""",
    "cold_rate": """
        WITH contacts AS (
          SELECT user_id AS src, ts FROM events WHERE event_type IN ('click', 'purchase', 'view')),
        arrivals AS (SELECT DISTINCT user_id AS id, ts FROM events WHERE event_type = 'signup'),
        flagged AS (
          SELECT id, ts, EXISTS (SELECT 1 FROM contacts c WHERE c.src = id AND c.ts >= arrivals.ts
                                 AND c.ts <= arrivals.ts + INTERVAL 6 HOUR) AS linked FROM arrivals)
        SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS arrivals,
               count(*) FILTER (NOT linked) AS cold, round(count(*) FILTER (NOT linked) / count(*), 6) AS rate
        FROM flagged
        WHERE date_trunc('day', ts) + INTERVAL 31 HOUR <= (SELECT max(ts) FROM events)
        GROUP BY 1""",
    "stream_warm_up": """
        WITH RECURSIVE arrivals AS (SELECT DISTINCT user_id AS id, date_trunc('millisecond', ts) AS ts FROM events WHERE event_type = 'signup'),
        contacts AS (SELECT user_id AS src, date_trunc('millisecond', ts) AS ts FROM events WHERE event_type IN ('click', 'purchase', 'view')),
        opened AS (
          SELECT id, min(ts) AS ts FROM arrivals GROUP BY id
          UNION ALL
          SELECT o.id, (SELECT min(a.ts) FROM arrivals a WHERE a.id = o.id AND a.ts > o.ts + INTERVAL 12 HOUR)
          FROM opened o WHERE o.ts IS NOT NULL),
        near AS (
          SELECT o.id, o.ts, c.ts AS edge_ts, row_number() OVER (PARTITION BY o.id, o.ts ORDER BY c.ts) AS n
          FROM opened o LEFT JOIN contacts c
            ON c.src = o.id AND c.ts BETWEEN o.ts - INTERVAL 12 HOUR AND o.ts + INTERVAL 12 HOUR
          WHERE o.ts IS NOT NULL),
        judged AS (
          SELECT id, ts, count(edge_ts) AS edges, max(edge_ts) FILTER (n = 3) AS third FROM near GROUP BY id, ts),
        decided AS (
          SELECT id, CASE WHEN edges >= 3 THEN 'warm' ELSE 'cold' END AS status, least(edges, 3)::INT AS degree,
                 CASE WHEN edges >= 3 THEN greatest(ts, third) ELSE ts + INTERVAL 12 HOUR END AS ts
          FROM judged)
        SELECT id, status, degree, ts::TIMESTAMP AS ts FROM decided
        WHERE ts < (SELECT date_trunc('millisecond', max(ts)) FROM events WHERE event_type IN ('signup', 'click', 'purchase', 'view')) - INTERVAL 1 HOUR""",
}
