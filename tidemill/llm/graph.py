"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MOST_ROUNDS = 100


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); the component is its least node. Ends of edges may be of any
    one type with an order; rows with a null end or equal ends join nothing, and an empty list gives no rows. Repeated
    edges count once.

    Rounds of large-star and small-star: every node's larger neighbours, then its smaller ones, are linked to the least
    neighbour, until nothing changes; a path of n nodes takes some log(n) rounds, and a RuntimeError tells of
    MOST_ROUNDS that weren't enough. Least neighbours are partial minima before each shuffle, and are written, as is
    each round: so a join's sides are plain shuffles, of which Spark splits the one where a hub's edges are. The driver
    sees a count and a checksum.
    """

    def stamp(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        return (r[0], r[1])

    def least(e: DataFrame, of: Column) -> DataFrame:
        return C.written(e.groupBy("a").agg(F.min(of).alias("m")), "edges-least")

    now = edges.toDF("a", "b").where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = C.written(now, "edges")
    mark = stamp(now)
    for _ in range(MOST_ROUNDS):
        if not mark[0]:
            break
        both = now.union(now.select("b", "a"))
        large = both.join(least(both, F.least("a", "b")), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = C.written(large, "edges-large")
        small = large.join(least(large, F.col("b")), "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        new = C.written(small.select("e.a", F.col("e.m").alias("b")).where("a != b").distinct(), "edges")
        last, mark, now = mark, stamp(new), new
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
