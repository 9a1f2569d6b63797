"""Graph construction: edges, degrees, cold nodes, splits, co-occurrence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldgraph.functions.hashing import is_integer, split_bucket
from coldgraph.functions.skew import HOT_ROWS, attach, attach_ends, hot_ends, hot_keys
from coldgraph.functions.vectors import sum_vectors
from coldgraph.session import materialize
from coldgraph.sources.tables import require

LIST_ROWS = 10_000
SMALL_CONTEXT = 32


def normalize_edges(df: DataFrame, src: str, dst: str, weight: str | None = None) -> DataFrame:
    """Undirected ``edges(src, dst, weight)``, ``src < dst`` and unique.

    Self-loops and null ends are dropped, repeated and reversed pairs summed,
    pairs whose total isn't positive dropped.
    """
    require(df, src, dst, *([weight] if weight else []))
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    pairs = df.filter(F.col(src) != F.col(dst)).select(
        F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"), w.alias("weight")
    )
    return pairs.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).filter("weight > 0")


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, from one pass over the edges."""
    forward = F.struct("src", "dst", "weight")
    backward = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight"))
    return edges.select(F.inline(F.array(forward, backward)))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, degree, weighted_degree)`` of all nodes; 0 for isolated ones."""
    counted = (
        symmetric(edges)
        .groupBy(F.col("src").alias("id"))
        .agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted_degree"))
    )
    return (
        nodes.select("id")
        .join(counted, "id", "left")
        .select(
            "id",
            F.coalesce("degree", F.lit(0)).alias("degree"),
            F.coalesce("weighted_degree", F.lit(0.0)).alias("weighted_degree"),
        )
    )


def end_points(edges: DataFrame) -> DataFrame:
    """Distinct ids with an edge; combined map-side, so hubs shuffle as single rows."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def detect_cold(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    return nodes.join(end_points(edges), "id", "left_anti")


def held_out(id_: Column, share: float, integer: bool = True) -> Column:
    """The hold-out rule: a function of the id alone, nested in ``share``."""
    bucket = split_bucket(id_) if integer else F.pmod(F.xxhash64(id_), F.lit(1000))
    return bucket < F.lit(1000 * share)


@dataclass(frozen=True)
class ColdSplit:
    """``truth`` holds every edge that touches a cold node."""

    warm_nodes: DataFrame
    cold_nodes: DataFrame
    warm_edges: DataFrame
    truth: DataFrame
    share: float

    def truth_pairs(self) -> DataFrame:
        """Removed edges between a cold and a warm node as ``(src=cold, dst=warm, weight)``."""
        integer = is_integer(self.truth, "src")
        both = symmetric(self.truth)
        return both.filter(
            held_out(F.col("src"), self.share, integer)
            & ~held_out(F.col("dst"), self.share, integer)
        )


def cold_split(nodes: DataFrame, edges: DataFrame, share: float) -> ColdSplit:
    """Hold out nodes as cold and remove *all* their edges from training.

    The rule needs no join: whether an end is cold follows from its id.
    """
    cold_node = held_out(F.col("id"), share, is_integer(nodes, "id"))
    integer = is_integer(edges, "src")
    cold_edge = held_out(F.col("src"), share, integer) | held_out(F.col("dst"), share, integer)
    return ColdSplit(
        nodes.filter(~cold_node),
        nodes.filter(cold_node),
        edges.filter(~cold_edge),
        edges.filter(cold_edge),
        share,
    )


def induced_subgraph(edges: DataFrame, ids: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Edges with both ends in ``ids(id)``."""
    keep = ids.select("id").distinct()
    hot = hot_ends(edges, hot_rows=hot_rows)
    for end, other in (("src", "dst"), ("dst", "src")):
        named = keep.withColumnRenamed("id", end)
        edges = attach(edges, named, end, [other], "left_semi", hot[end], hot_rows)
    return edges.select("src", "dst", "weight")


# --- co-occurrence -----------------------------------------------------------
#
# Entities that share a context (parts on one order) are neighbours with weight
# = number of shared contexts. That adjacency is B B' minus its diagonal, B being
# the entity-context incidence, and it is never written out: a context with a
# third of all rows would square. Degrees, neighbour sums and the weights of
# given pairs come from B itself, exactly and in linear space; only contexts of
# a few entities form their pairs, for the weights.


def incidence(df: DataFrame, entity: str, context: str) -> DataFrame:
    """Distinct ``(entity, context)``."""
    require(df, entity, context)
    pairs = df.select(F.col(entity).alias("entity"), F.col(context).alias("context"))
    return pairs.filter("entity IS NOT NULL AND context IS NOT NULL").distinct()


def star_edges(pairs: DataFrame) -> DataFrame:
    """Bipartite edges entity-context: entities get even, contexts odd ids."""
    return pairs.select(
        (F.col("entity") * 2).alias("entity"), (F.col("context") * 2 + 1).alias("context")
    ).transform(lambda df: normalize_edges(df, "entity", "context"))


def cooccurrence_degrees(pairs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(id, weighted_degree)``: sum over an entity's contexts of (context size - 1)."""
    sizes = pairs.groupBy("context").agg(F.count(F.lit(1)).alias("size"))
    sized = attach(pairs, sizes, "context", ["entity"], hot_rows=hot_rows)
    return sized.groupBy(F.col("entity").alias("id")).agg(
        F.sum(F.col("size") - 1).cast("double").alias("weighted_degree")
    )


def cooccurrence_sums(
    pairs: DataFrame, nodes: DataFrame, d: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``(id, sums, degree)``: features summed over co-occurring entities, by weight.

    Sum over contexts of (context total - own features); contexts are totalled
    with map-side combine, then read back once per incidence. Only entities that
    have features count.
    """
    vectors = nodes.select(F.col("id").alias("entity"), F.col("features").alias("x"))
    hot = hot_keys(pairs, "entity", hot_rows)
    placed = attach(pairs, vectors, "entity", ["context"], hot=hot)
    totals = sum_vectors(placed, "context", "x", d, None, "total", size=F.count(F.lit(1)))
    known = attach(pairs, vectors.select("entity"), "entity", ["context"], "left_semi", hot)
    read_back = attach(known, totals, "context", ["entity"], hot_rows=hot_rows)
    gathered = sum_vectors(
        read_back,
        "entity",
        "total",
        d,
        None,
        "sums",
        degree=F.sum(F.col("size") - 1).cast("double"),
        contexts=F.count(F.lit(1)),
    )
    without_own = F.zip_with("sums", "x", lambda s, x: s - F.col("contexts") * x)
    return gathered.join(vectors, "entity").select(
        F.col("entity").alias("id"), without_own.alias("sums"), "degree"
    )


def shared_neighbors(
    pairs: DataFrame, edges: DataFrame, hot_rows: int = HOT_ROWS, with_degree: bool = True,
    list_rows: int = LIST_ROWS,
) -> DataFrame:
    """``(src, dst, via[, via_degree])``: the shared neighbours of each given pair.

    Each pair lists the neighbours of its end with the *smaller* degree and looks
    the other end up, so a hub in many pairs is not expanded. Lists of more than ``list_rows`` neighbours
    are cut into pieces that pairs meet one by one, and ends of very many pairs are salted, so a hub
    on both sides is the work of many tasks.
    """
    both = symmetric(edges)
    degree = materialize(
        both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree")), "degrees"
    )
    wanted = materialize(pairs.select("src", "dst").distinct(), "pairs")
    sized = attach_ends(
        wanted, degree, "degree", ("src_degree", "dst_degree"), hot_rows=hot_rows
    )
    src_small = F.col("src_degree") <= F.col("dst_degree")
    oriented = sized.select(
        "src",
        "dst",
        F.when(src_small, F.col("src")).otherwise(F.col("dst")).alias("small"),
        F.when(src_small, F.col("dst")).otherwise(F.col("src")).alias("large"),
        F.explode(F.sequence(F.lit(0), _pieces(F.least("src_degree", "dst_degree"), list_rows) - 1)).alias("piece"),
    )
    hubs = degree.filter(F.col("degree") > list_rows).select("id", _pieces(F.col("degree"), list_rows).alias("pieces"))
    piece = F.pmod(F.xxhash64("via"), F.coalesce("pieces", F.lit(1)).cast("bigint")).cast("int")
    from_small = both.select(F.col("src").alias("id"), F.col("dst").alias("via")).join(hubs, "id", "left").select(
        F.col("id").alias("small"), "via", piece.alias("piece")
    )
    oriented = materialize(oriented, "oriented")
    listed = attach(oriented, from_small, ["small", "piece"], ["large"], hot_rows=hot_rows)
    links = both.select(F.col("src").alias("large"), F.col("dst").alias("via"))
    found = materialize(
        listed.join(links, ["large", "via"], "left_semi").select("src", "dst", "via"), "shared"
    )
    if not with_degree:
        return found
    via_degree = degree.select(F.col("id").alias("via"), F.col("degree").alias("via_degree"))
    return attach(found, via_degree, "via", ["src", "dst"], hot_rows=hot_rows)


def _pieces(degree: Column, list_rows: int) -> Column:
    return F.ceil(degree / list_rows).cast("int")


def cooccurrence_weights(
    pairs: DataFrame, occurrences: DataFrame, hot_rows: int = HOT_ROWS, small_context: int = SMALL_CONTEXT
) -> DataFrame:
    """Number of shared contexts of given entity pairs ``(src, dst)``; 0 where none.

    Contexts of at most ``small_context`` entities form their pairs, half of that per occurrence at most, which meet the given ones in one
    aggregate. Larger contexts would square: given pairs look them up as shared neighbours. ``occurrences`` should be a table, it is read several times.
    """
    kept = occurrences.filter("entity IS NOT NULL AND context IS NOT NULL").select("entity", "context")
    sizes = kept.groupBy("context").agg(F.count(F.lit(1)).alias("size"))
    large = materialize(sizes.filter(F.col("size") > small_context).select("context"), "large")
    turned = F.col("src") > F.col("dst")
    asked = pairs.select(
        F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("a"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("b"),
        F.when(turned, 2).otherwise(1).alias("ways"), F.lit(0).cast("bigint").alias("n"),
    )
    counts = []
    if not large.isEmpty():
        asked = materialize(asked.groupBy("a", "b", "n").agg(F.bit_or("ways").alias("ways")), "pairs")
        stars = materialize(star_edges(kept.join(large, "context", "left_semi")), "stars")
        ends = asked.select((F.col("a") * 2).alias("src"), (F.col("b") * 2).alias("dst"))
        shared = shared_neighbors(ends, stars, hot_rows, with_degree=False).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
        halved = [(F.col(end) / 2).cast("bigint").alias(name) for end, name in (("src", "a"), ("dst", "b"))]
        counts.append(shared.select(*halved, "n"))
        kept = kept.join(large, "context", "left_anti")
    # a sorted list per small context, the later entities of each of its entries
    lists = kept.groupBy("context").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    entry = lists.select("entities", F.posexplode("entities").alias("place", "a"))
    later = F.slice("entities", F.col("place") + 2, F.size("entities"))
    counts.append(entry.select("a", F.explode(later).alias("b"), F.lit(1).cast("bigint").alias("n")))
    small = lists.select(F.explode("entities").alias("entity"))
    own = small.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    counts.append(own.select(F.col("entity").alias("a"), F.col("entity").alias("b"), "n"))
    rows = asked
    for found in counts:
        rows = rows.unionByName(found.withColumn("ways", F.lit(0)))
    summed = rows.groupBy("a", "b").agg(F.sum("n").cast("double").alias("weight"), F.bit_or("ways").alias("ways")).filter("ways > 0")
    ways = F.when(F.col("ways") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array("ways"))
    src, dst = (F.when(F.col("way") == 1, F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a")))
    return summed.select("a", "b", "weight", F.explode(ways).alias("way")).select(
        src.cast(pairs.schema["src"].dataType).alias("src"), dst.cast(pairs.schema["dst"].dataType).alias("dst"), "weight"
    )
