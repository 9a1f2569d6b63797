"""Graphs that Spark derives from the given tables.

``planted_graph`` links the rows of ``embeddings``: row ``i`` is a candidate
partner of the ``PLANT_OFFSETS`` rows at fixed offsets from it, and the pair is
kept if the labels agree or an arithmetic hash of the pair is small. Work and
size are linear in the table, and any SQL engine can repeat the rule.

``nation_chain`` is a graph whose spectrum is known in closed form.

``retail_graph`` is the bipartite graph of customers and the parts on their
orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coldgraph.functions.hashing import SPLIT_PRIME, pair_bucket
from coldgraph.operators.graph import normalize_edges
from coldgraph.sources.tables import load_nodes

# Fixed values of the planted graph.
PLANT_OFFSETS = 96
PLANT_NOISE = 28
PLANT_LIFT = 0.3
EMBEDDING_DIM = 64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table as a file stream, be it one file or a folder of them.

    A pattern of one match names it: a file source takes a plain path as a folder only, and a filter of file names
    would leave out the files of a folder.
    """
    return spark.readStream.schema(read(spark, sf_dir, table).schema).parquet(f"{sf_dir}/{table}.parque[t]")


def planted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as DOUBLE with ``PLANT_LIFT`` added at position ``label``."""
    vectors = read(spark, sf_dir, "embeddings").withColumn(
        "features",
        F.transform(
            F.col("embedding").cast("array<double>"),
            lambda x, i: x + F.when(i == F.col("label"), PLANT_LIFT).otherwise(0.0),
        ),
    )
    return load_nodes(vectors, "vec_id", "features", "label", dim=EMBEDDING_DIM, check=False)


def planted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    n = labels.count()
    offsets = F.sequence(F.lit(1), F.lit(PLANT_OFFSETS))
    candidates = labels.select(
        F.col("vec_id").alias("i"), F.col("label").alias("i_label"), F.explode(offsets).alias("t")
    ).withColumn("j", F.pmod(F.col("i") + F.col("t") * F.lit(SPLIT_PRIME), F.lit(n)))
    other = labels.select(F.col("vec_id").alias("j"), F.col("label").alias("j_label"))
    kept = candidates.join(other, "j").filter(
        (F.col("i_label") == F.col("j_label")) | (pair_bucket(F.col("i"), F.col("j")) < PLANT_NOISE)
    )
    return normalize_edges(kept, "i", "j")


def retail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(customer, part, quantity)`` with disjoint ids: customers even, parts odd."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        (F.col("o_custkey") * 2).alias("customer"),
        (F.col("l_partkey") * 2 + 1).alias("part"),
        F.col("l_quantity").alias("quantity"),
    )


def retail_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_edges(retail_lines(spark, sf_dir), "part", "customer", "quantity")


def retail_nodes(spark: SparkSession, sf_dir: str, check: bool = True) -> DataFrame:
    """Customers (label: nation) and parts (unlabelled), three features each."""
    customers = read(spark, sf_dir, "customer").select(
        (F.col("c_custkey") * 2).alias("key"),
        F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double"), F.lit(1.0)).alias(
            "vector"
        ),
        F.col("c_nationkey").alias("nation"),
    )
    parts = read(spark, sf_dir, "part").select(
        (F.col("p_partkey") * 2 + 1).alias("key"),
        F.array(F.col("p_retailprice") / 1000, F.col("p_size").cast("double"), F.lit(0.0)).alias(
            "vector"
        ),
        F.lit(None).cast("int").alias("nation"),
    )
    return load_nodes(customers.unionByName(parts), "key", "vector", "nation", dim=3, check=check)


def nation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with customers (odd ids, by rank) in a chain, each linked to its customers (even ids).

    The links of one nation's customers weigh 1 together, 1/2 at the ends of the chain. Then the eigenvectors of the
    normalized adjacency are cosines along the chain, whatever the number of customers.
    """
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    counts = customers.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey")).join(counts, "c_nationkey")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("c_nationkey")) - 1
    ranked = nations.withColumn("place", place)  # one row per nation
    last = ranked.count() - 1
    total = F.when(F.col("place").isin(0, last), 0.5).otherwise(1.0)
    shares = ranked.select("c_nationkey", (F.col("place") * 2 + 1).cast("long").alias("a"), (total / F.col("n")).alias("weight"))
    around = customers.join(shares, "c_nationkey").select("a", (F.col("c_custkey") * 2).alias("b"), "weight")
    chain = ranked.where(F.col("place") < last).select(
        (F.col("place") * 2 + 1).cast("long").alias("a"), (F.col("place") * 2 + 3).cast("long").alias("b"), F.lit(1.0).alias("weight")
    )
    return normalize_edges(around.unionByName(chain), "a", "b", "weight")
