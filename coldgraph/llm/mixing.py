"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weight's share of all words, held to ``cap`` times its own words. Each document is
taken floor(target / source words) times for certain. For the rest, document i gets the inclusion
probability p_i = rest * g_i / sum(g * words) with g = floor(sqrt(words)) (longer documents carry more
words for one place in the sample), and documents are ranked by u / (1 - u) divided by p / (1 - p), u being
a uniform number from the digest of key, seed and text. The sample is the head of that order
whose words come nearest to the rest, so a source misses its target by at most half a document.

The order is never sorted as a whole: words are summed for ranges of the rank, and only the range at the edge
needs the exact order. All is built-in functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coldgraph.llm.rows import column, distinct_rows, expand, text_of, with_row_digest
from coldgraph.session import materialize

WORD = r"[^ \t\n\x0B\f\r]+"
RANGES = 4096


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(column(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: int) -> DataFrame:
    """``sizes`` (__no, __src, __size, ...; one row per source) plus __target.

    Sources in the order of code points, the unknown last, get the weights in turn. Sources sorted by
    cap over weight are held from the first on while their cap is at most what the rest of the total
    would give them.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy("__no", "__src")) - 1, F.lit(len(weights))) + 1
    w = sizes.withColumn("__w", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), turn.cast("int")))
    by = Window.orderBy(F.col("__size") / F.col("__w"), "__no", "__src")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    w = w.withColumn("__total", F.sum("__size").over(whole) * F.lit(float(share)))
    held = cap * (F.sum("__size").over(upto) - F.col("__size"))
    left = F.sum("__w").over(whole) - F.sum("__w").over(upto) + F.col("__w")
    w = w.withColumn("__level", (F.col("__total") - held) / left)
    w = w.withColumn("__free", F.col("__size") * F.lit(cap) > F.col("__level") * F.col("__w"))
    w = w.withColumn("__place", F.row_number().over(by))
    level = F.min_by(F.when(F.col("__free"), F.col("__level")), F.when(F.col("__free"), F.col("__place"))).over(whole)
    target = F.when(F.col("__free"), F.col("__w") * level).otherwise((F.col("__size") * F.lit(cap)).cast("double"))
    return w.withColumn("__target", target).drop("__w", "__total", "__level", "__free", "__place")


def _plan(
    docs: DataFrame, key: str, text: str, source: str, weights: Sequence[int], share: float, cap: int, seed: int
) -> DataFrame:
    """One row per group of equal rows: digests, key, size, source size, target, whole copies, how many rows get one more."""
    digest = F.md5(
        F.concat(F.coalesce(column(key).cast("string"), F.lit("")), F.lit(f":{seed}:"), text_of(text)).cast("binary")
    )
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = with_row_digest(docs).select(
        "__h1", "__h2", column(key).alias("__key"), word_count(text).alias("__words"), u.alias("__u"),
        column(source).isNull().cast("int").alias("__no"), F.coalesce(column(source).cast("string"), F.lit("")).alias("__src"),
    )
    rows = rows.groupBy("__h1", "__h2").agg(
        F.count(F.lit(1)).alias("__copies"), *[F.first(c).alias(c) for c in ("__key", "__words", "__u", "__no", "__src")]
    )
    rows = materialize(rows, "mix-rows").withColumn("__g", F.floor(F.sqrt(F.col("__words").cast("double"))).cast("long"))
    mass = F.col("__words") * F.col("__copies")
    sizes = rows.groupBy("__no", "__src").agg(F.sum(mass).alias("__size"), F.sum(mass * F.col("__g")).alias("__lean"))
    targets = source_targets(sizes, weights, share, cap)
    targets = targets.withColumn(
        "__whole", F.when(F.col("__size") > 0, F.floor(F.col("__target") / F.col("__size"))).otherwise(0).cast("long")
    ).withColumn("__rest", F.col("__target") - F.col("__whole") * F.col("__size"))
    targets = materialize(targets, "mix-targets")
    rows = rows.join(targets, ["__no", "__src"])
    p = F.when(F.col("__lean") > 0, F.col("__rest") * F.col("__g") / F.col("__lean")).otherwise(0.0)
    odds = F.col("__u") / (1 - F.col("__u")) * ((1 - F.col("__p")) / F.col("__p"))
    rank = F.when(F.col("__p") >= 1, F.col("__u")).when(F.col("__p") <= 0, F.lit(1.0)).otherwise(odds / (1 + odds))
    part = F.floor(F.col("__rank") * RANGES) + F.when(F.col("__p") >= 1, 0).otherwise(RANGES)
    rows = rows.withColumn("__p", p).withColumn("__rank", rank).withColumn("__part", part.cast("long"))
    by = Window.partitionBy("__no", "__src").orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.groupBy("__no", "__src", "__part").agg(F.sum(mass).alias("__mass"))
    parts = parts.withColumn("__before", F.sum("__mass").over(by) - F.col("__mass")).drop("__mass")
    inside = (
        Window.partitionBy("__no", "__src", "__part")
        .orderBy("__rank", "__u", "__h1", "__h2")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    start = F.col("__before") + F.sum(mass).over(inside) - mass
    rows = rows.join(parts, ["__no", "__src", "__part"]).withColumn("__start", start)
    # a row is taken if its middle lies within the rest
    more = F.floor((F.col("__rest") - F.col("__start") - F.col("__words") / 2) / F.col("__words")) + 1
    more = F.when(F.col("__words") > 0, F.greatest(F.lit(0), F.least(F.col("__copies"), more))).otherwise(0)
    return rows.withColumn("__more", more.cast("long"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.0,
    cap: int = 3,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: the key, size, source_size, target (its source's), copies, taken (words).

    Null or blank texts have size 0 and take no words; a null source is a source of its own, ordered last. Of
    equal rows as many get one more copy as the order allows. An empty table gives an empty result.
    """
    plan = _plan(docs, key, text, source, weights, share, cap, seed)
    each = expand(plan, "__copies").withColumn(
        "__times", F.col("__whole") + F.when(F.col("__i") < F.col("__more"), 1).otherwise(0)
    )
    return each.select(
        F.col("__key").alias(key),
        F.col("__words").alias("size"),
        F.col("__size").cast("long").alias("source_size"),
        F.col("__target").alias("target"),
        F.col("__times").cast("long").alias("copies"),
        (F.col("__times") * F.col("__words")).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, cap: int = 3, seed: int = 7, **names) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    names = {"key": "doc_id", "text": "text", "source": "source"} | names
    plan = _plan(docs, names["key"], names["text"], names["source"], weights, share, cap, seed)
    times = plan.select("__h1", "__h2", (F.col("__whole") * F.col("__copies") + F.col("__more")).alias("__times"))
    rows = distinct_rows(with_row_digest(docs), docs.columns).join(times.where("__times > 0"), ["__h1", "__h2"])
    return expand(rows, "__times").select(*[column(c) for c in docs.columns])
