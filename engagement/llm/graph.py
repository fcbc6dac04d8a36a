"""Connected components of edges that lie in a distributed table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step of alternating stars: links a node's neighbours to the smallest of them.

    ``edges`` has (a, b) with a > b. The large step looks at neighbours in both directions
    and links the larger ones; the small step looks at smaller neighbours only.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("least"))
        least = least.select("u", F.least("u", "least").alias("m"))
        linked = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).join(least, "u")
        linked = pairs.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            pairs.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return linked.where("a > b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node can reach.

    Nodes are longs; nodes without a link to another node are left out. Rows with a null
    end count for nothing, repeated edges once, and no edges give an empty result. Works
    by alternating large and small stars (Kiveris et al. 2014): every round is two
    aggregations and two key joins on rows no wider than an edge, written to the shared
    folder. No round can grow the table beyond twice the edges, and nothing but its size
    and a checksum comes to the driver.
    """
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(edges.distinct())
    before = None
    while True:
        state = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
        ).first()
        if before == state or not state["n"]:
            break
        before = state
        large = stored(_stars(edges, True))
        small = stored(_stars(large, False))
        dropped(edges, large)
        edges = small
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
