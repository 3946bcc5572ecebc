"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step replaces a node's edges by edges to the least id it knows: a grouped minimum joined back, broadcast for the few
nodes that may have a large part of all edges, so the edges of no node are gathered in one place. The edges end as one
star for each component. Every round is written to the shared folder, so lineage stays short and a lost executor costs a
re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.store import joined_by_key, released, written


def large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("k"))
    return joined_by_key(both, least, "a", "k", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k"))
    moved = joined_by_key(down, least, "a", "k", total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def signed(edges: DataFrame) -> tuple:
    """Number of edges and a sum over them, which tell whether a round changed any."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id and root (the least id reachable) of every node that has an edge and is not a root itself. edges: a, b."""
    spark = edges.sparkSession
    now = written(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "edges")
    sign = n, _ = signed(now)
    for _ in range(rounds):
        before, star = now, written(large_star(now, n), "edges")
        now = written(small_star(star, n), "edges")  # large_star makes a row of each edge at most
        released(spark, before, star)
        before, sign = sign, signed(now)
        if sign == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        n = sign[0]
    raise RuntimeError("components did not settle")
