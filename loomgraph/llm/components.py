"""Connected components by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import forget, stored

_LIMIT = 100


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (greater ones, or smaller ones) go to the least of node and neighbours.

    Minima are combined before the shuffle; the join back to a node of very many
    neighbours is one that Spark can split.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # edges point from the greater to the smaller node
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        linked = edges.join(least, "u")
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the undirected ``links``: component is its least node.

    Rounds are written to the shared folder, so that lineage stays short and a lost
    executor costs a round at most; their number grows with the logarithm of the
    longest chain.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = stored(edges, "links")
    seen = None
    for _ in range(_LIMIT):
        before, edges = edges, stored(_star(_star(edges, True), False), "stars")
        forget(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("links have not come to rest")
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
