"""Node table intake and Parquet sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_COLUMNS = ("id", "features", "label")
EDGE_COLUMNS = ("src", "dst", "weight")
BUCKET_ROWS = 4_000_000
LAYOUT = "_layout"


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df


def _shape(df: DataFrame, id: str, features: str, label: str | None) -> DataFrame:
    require(df, id, features, *([label] if label else []))
    label_column = F.col(label).cast("int") if label else F.lit(None).cast("int")
    return df.select(
        F.col(id).alias("id"),
        F.col(features).cast("array<double>").alias("features"),
        label_column.alias("label"),
    )


def _usable(d: int):
    """True for an id with ``d`` finite features."""
    bad_element = F.exists("features", lambda x: x.isNull() | F.isnan(x))
    return (
        F.col("id").isNotNull()
        & F.col("features").isNotNull()
        & (F.size("features") == d)
        & ~bad_element
    )


def node_report(
    df: DataFrame, id: str, features: str, label: str | None = None, dim: int | None = None
) -> DataFrame:
    """One row of intake counts: rows, rejected, unlabelled, duplicate_ids, dim.

    ``dim`` defaults to the most frequent vector length. Rows are first counted
    per id (with map-side combine), so a repeated id is one row from then on.
    """
    nodes = _shape(df, id, features, label)
    if dim is None:
        lengths = nodes.filter("features IS NOT NULL").groupBy(F.size("features").alias("d"))
        row = lengths.count().orderBy(F.desc("count"), "d").limit(1).first()
        dim = row["d"] if row else 0
    usable = F.coalesce(_usable(dim), F.lit(False))
    per_id = nodes.groupBy("id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(usable).alias("kept"),
        F.count_if(usable & F.col("label").isNull()).alias("unlabelled"),
    )
    return per_id.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("rows") - F.col("kept")), F.lit(0)).alias("rejected"),
        F.coalesce(F.sum("unlabelled"), F.lit(0)).alias("unlabelled"),
        F.count_if(F.col("kept") > 1).alias("duplicate_ids"),
        F.lit(dim).alias("dim"),
    )


def load_nodes(
    df: DataFrame,
    id: str,
    features: str,
    label: str | None = None,
    dim: int | None = None,
    check: bool = True,
) -> DataFrame:
    """``nodes(id, features ARRAY<DOUBLE>, label INT)``.

    Rows with a null id or with null, wrong-length or non-finite features are
    left out (``node_report`` counts them). With ``check`` a repeated id raises;
    pass ``dim`` and ``check=False`` to stay lazy, e.g. on a stream.
    """
    if check or dim is None:
        report = node_report(df, id, features, label, dim).first()
        if check and report["duplicate_ids"]:
            raise ValueError(f"{report['duplicate_ids']} duplicate node ids")
        dim = report["dim"]
    return _shape(df, id, features, label).filter(_usable(dim))


def save_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Sink for nodes, coords, predictions and results."""
    df.write.mode(mode).parquet(path)


def save_edges(
    edges: DataFrame, path: str, buckets: int = 64, files: int = 1, mode: str = "errorifexists"
) -> None:
    """Edges in hash buckets of ``dst``, so that a reader may prune by bucket.

    ``files`` tasks share one bucket (spread by ``src``): a hub's bucket need not
    go through a single task.
    """
    require(edges, *EDGE_COLUMNS)
    bucket = F.pmod(F.xxhash64("dst"), F.lit(buckets)).cast("int")
    part = F.pmod(F.xxhash64("src"), F.lit(files)).cast("int")
    (
        edges.withColumn("bucket", bucket)
        .repartition(buckets * files, "bucket", part)
        .write.mode(mode)
        .partitionBy("bucket")
        .parquet(path)
    )


def load_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    return require(spark.read.parquet(path), *columns)


def load_edges(spark: SparkSession, path: str) -> DataFrame:
    return load_table(spark, path, *EDGE_COLUMNS).select(*EDGE_COLUMNS)


def save_bucketed(df: DataFrame, path: str, key: str, buckets: int | None = None, files: int = 1) -> None:
    """A table in hash buckets of ``key``, sorted by it, that ``load_bucketed`` prunes and joins without a shuffle.

    The number of buckets follows from the rows (``BUCKET_ROWS``) unless it is given; tables of one number join without a
    shuffle. ``files`` tasks share one bucket, so that a hub's rows need not go through a single task.
    """
    require(df, key)
    if buckets is None:
        buckets = 1 << max(0, (-(-df.count() // BUCKET_ROWS) - 1).bit_length())
    spread = [F.pmod(F.xxhash64(*df.columns), F.lit(files))] if files > 1 else []
    name = _table_name()
    laid_out = df.repartition(buckets * files, key, *spread).sortWithinPartitions(key)
    laid_out.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    spark = df.sparkSession
    spark.sql(f"DROP TABLE {name}")  # the name only; the files stay
    layout = spark.createDataFrame([(key, buckets)], "key string, buckets int")
    layout.coalesce(1).write.parquet(f"{path}/{LAYOUT}")


def load_bucketed(spark: SparkSession, path: str, ids: list | None = None) -> DataFrame:
    """The table of ``save_bucketed``; with ``ids`` only these keys, from the files of their buckets."""
    layout = spark.read.parquet(f"{path}/{LAYOUT}").first()
    key, name = layout["key"], _table_name()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
        f"INTO {layout['buckets']} BUCKETS LOCATION '{path}'"
    )
    table = spark.table(name)
    return table if ids is None else table.where(F.col(key).isin(list(ids)))


def _table_name() -> str:
    return f"coldgraph_{uuid.uuid4().hex}"
