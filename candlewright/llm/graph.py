"""Connected components of a table of links."""

from pyspark.sql import functions as F

from candlewright.llm.common import release, stored


def _smallest(pairs):
    """(u, v) plus the smallest neighbour m of each u.

    The minimum is written first, so that the join is one of two plain exchanges and
    adaptive execution can split a node with very many links.
    """
    lowest = stored(pairs.groupBy("u").agg(F.min("v").alias("m")))
    return pairs.join(lowest, "u"), lowest


def _state(edges):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links):
    """Label every node of ``links`` (long columns a, b) with the smallest node it reaches.

    Large-star and small-star steps alternate until the links form stars around the
    smallest node of each component; the number of rounds grows with the logarithm of
    the longest path. Returns (node, component); nulls and self links are ignored, an
    empty table gives an empty one.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .distinct())
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        met, low = _smallest(both)
        large = stored(met.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        met, low2 = _smallest(large)
        small = stored(met.select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        ).alias("e")).select("e.*").where("u <> v").distinct())
        release(edges, low, large, low2)
        edges, after = small, _state(small)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
