"""Connected components by alternating star contractions over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

__all__ = ["connected_components"]


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of an edge: the component is its smallest node.

    A large-star step hangs the larger neighbours of every node on the smallest neighbour, a
    small-star step hangs the smaller ones (and the node) there; the pair is repeated until no
    edge changes, which takes a number of rounds logarithmic in the longest path. Neighbour
    sets are only ever reduced to their minimum, so the degree of a hub costs no memory. Each
    round is cut to the shared folder. Null ends, self loops and repeated edges are ignored;
    nodes without an edge to another node do not appear.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter(F.col("x") != F.col("y"))
    e = cut(e.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    before = _fingerprint(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(hung.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = _fingerprint(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
