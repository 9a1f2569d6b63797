"""Small helpers on rows: folds, row digests, samples of labelled rows, repeated rows.

Names used inside start with ``__``; a column of the input with the name of an output is
replaced by the output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 10_000


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str = "text") -> Column:
    return F.coalesce(column(name).cast("string"), F.lit(""))


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as an empty text."""
    return F.crc32(F.coalesce(column(key).cast("string"), F.lit("")).cast("binary")) % modulus


def with_row_digest(df: DataFrame) -> DataFrame:
    """Add 128 bits (``__h1``, ``__h2``) over all columns, nulls told apart."""
    parts: list[Column] = []
    for field in df.schema.fields:
        c = column(field.name)
        kind = field.dataType.simpleString()
        parts += [c.isNull(), F.to_json(F.struct(c)) if "map<" in kind or kind == "variant" else c]
    return df.withColumns({"__h1": F.xxhash64(*parts), "__h2": F.xxhash64(F.lit(1), *parts)})


def distinct_rows(tagged: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each row digest. Equal rows meet map-side, however many there are."""
    return tagged.groupBy("__h1", "__h2").agg(*[F.first(column(c)).alias(c) for c in columns])


def expand(df: DataFrame, copies: str, index: str = "__i") -> DataFrame:
    """Each row ``copies`` times, numbered from 0. Large counts are dealt out in chunks."""
    one = df.where(column(copies) == 1).withColumn(index, F.lit(0).cast("long"))
    last = column(copies).cast("long") - 1
    few = df.where((column(copies) > 1) & (column(copies) <= CHUNK)).withColumn(
        index, F.explode(F.sequence(F.lit(0).cast("long"), last))
    )
    many = (
        df.where(column(copies) > CHUNK)
        .withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{copies}` - 1) div {CHUNK}"))))
        .repartition("__h1", "__chunk")
        .withColumn(
            index,
            F.explode(
                F.sequence(F.col("__chunk") * CHUNK, F.least(last, F.col("__chunk") * CHUNK + (CHUNK - 1)))
            ),
        )
        .drop("__chunk")
    )
    return one.unionByName(few).unionByName(many)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, text, label) of at most ``rows`` labelled rows.

    The rows with the smallest hash of their key are taken, so that reruns agree. Only these keys,
    whose number is the bound, are broadcast; of the texts only theirs are shuffled. A key with several labels is
    taken once, with the largest, a key with several texts once, with the smallest.
    """
    known = labels.select(column(key).alias("__key"), column(label).cast("int").alias("__label"))
    ids = (
        known.where(F.col("__key").isNotNull() & F.col("__label").isNotNull())
        .groupBy("__key")
        .agg(F.max("__label").alias("__label"))
        .orderBy(F.xxhash64("__key"), "__key")
        .limit(rows)
    )
    texts = docs.select(column(key).alias("__key"), text_of(text).alias("__text"))
    found = texts.join(F.broadcast(ids), "__key").groupBy("__key", "__label").agg(F.min("__text").alias("__text"))
    return found.select("__key", "__text", "__label")
