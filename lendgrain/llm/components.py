"""Connected components of a graph given by its edges, as repeated joins over edge tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.llm.shared import cut


def components(edges: DataFrame) -> DataFrame:
    """edges: two long columns a and b. Gives (a, b): b is the smallest node that a reaches, for every a that is not it.

    Alternates the large-star and small-star steps until the edges are stars. Every step aggregates before its
    shuffle and joins a node's neighbours with one row, so a node with very many neighbours is split by the
    adaptive skew join.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = sign(e)
    while state[0]:
        both = e.unionAll(e.select("b", "a")).toDF("u", "v")
        least = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))  # cut, so that the join deals out both sides
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        e = cut(small.select("e.a", "e.b").where("a <> b").distinct())
        before, state = state, sign(e)
        if state == before:
            break
    return e


def sign(e: DataFrame):
    """Number of edges and a checksum of them."""
    return tuple(e.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(a, b)), 0)")).first())
