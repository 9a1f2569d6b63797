"""Joins that hold when one key carries a large part of the rows.

``attach`` looks up attributes (one or a few rows per key on the right) for a
large left side. Keys above ``HOT_ROWS`` left rows are salted: the left rows of
such a key are spread over ``copies`` salts and its right rows are repeated for
each salt. At most ``MAX_HOT`` keys are salted, so the list of hot keys has a
fixed bound and may be broadcast; a key outside the top ``MAX_HOT`` holds less
than 1/``MAX_HOT`` of the rows and stays whole. No row is dropped either way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_ROWS = 1_000_000
MAX_HOT = 65_536


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> list[Row]:
    """The (at most ``MAX_HOT``) keys with more than ``hot_rows`` rows and their salt counts.

    Counting is partial-aggregated per input split, so a hot key shuffles one
    row per split.
    """
    counts = df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.filter((F.col("n") > hot_rows) & F.col("key").isNotNull())
        .orderBy(F.desc("n"))
        .limit(MAX_HOT)
        .select("key", F.ceil(F.col("n") / hot_rows).cast("int").alias("copies"))
        .collect()
    )


def hot_ends(
    df: DataFrame, ends: Sequence[str] = ("src", "dst"), hot_rows: int = HOT_ROWS
) -> dict[str, list[Row]]:
    """``hot_keys`` of several columns of one type, from one pass over ``df``; each end has its own ranking."""
    values = F.array(*[F.struct(F.lit(e).alias("end"), F.col(e).alias("key")) for e in ends])
    counts = df.select(F.inline(values)).groupBy("end", "key").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("end").orderBy(F.desc("n"), "key"))
    found = (
        counts.filter((F.col("n") > hot_rows) & F.col("key").isNotNull())
        .withColumn("place", place)
        .filter(F.col("place") <= MAX_HOT)
        .select("end", "key", F.ceil(F.col("n") / hot_rows).cast("int").alias("copies"))
        .collect()
    )
    return {e: [r for r in found if r["end"] == e] for e in ends}


def attach_ends(
    pairs: DataFrame,
    per_node: DataFrame,
    value: str,
    names: tuple[str, str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``pairs(src, dst, ...)`` with the ``value`` of both ends, looked up in ``per_node(id, value)``.

    ``pairs`` should be a table or cheap to read: it is counted once for the hot ends.
    """
    hot = hot_ends(pairs, hot_rows=hot_rows)
    result = pairs
    for end, other, name in (("src", "dst", names[0]), ("dst", "src", names[1])):
        named = per_node.select(F.col("id").alias(end), F.col(value).alias(name))
        result = attach(result, named, end, [other], how, hot[end], hot_rows)
    return result


def attach(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    hot: list[Row] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``left`` with ``right`` on ``on``; hot values of the first key are salted.

    ``spread`` names the left columns whose hash picks the salt: rows of one hot
    key must differ in them. ``hot`` may hold a former ``hot_keys(left, ...)``
    result when the same left side is joined again and again.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if hot is None:
        hot = hot_keys(left, keys[0], hot_rows)
    if not hot:
        return left.join(right, keys, how)
    spark = left.sparkSession
    key_type = left.schema[keys[0]].dataType
    schema = T.StructType(
        [T.StructField(keys[0], key_type), T.StructField("__copies", T.IntegerType())]
    )
    table = F.broadcast(spark.createDataFrame([(r["key"], r["copies"]) for r in hot], schema))
    copies = F.coalesce(F.col("__copies"), F.lit(1))
    salted_left = (
        left.join(table, keys[0], "left")
        .withColumn("__salt", F.pmod(F.xxhash64(*spread), copies.cast("bigint")).cast("int"))
        .drop("__copies")
    )
    salted_right = (
        right.join(table, keys[0], "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), copies - 1)))
        .drop("__copies")
    )
    return salted_left.join(salted_right, [*keys, "__salt"], how).drop("__salt")
