"""Cluster membership: failure detection, incarnations, probe targets, gossip."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def failures(probes: DataFrame, node: str, ts: str, order: str, timeout: str) -> DataFrame:
    """A node is suspected at the first nack of a run and dead at suspicion + timeout unless an ack comes before; rows
    (node, suspected_at, dead_at) of the suspicions that ended in death. probes has ``ack`` (boolean)."""
    w = Window.partitionBy(node).orderBy(ts, order)
    before = F.lag("ack").over(w)
    next_ack = F.min(F.when(F.col("ack"), F.col(ts))).over(w.rowsBetween(1, Window.unboundedFollowing))
    dead = F.col(ts) + F.expr(f"interval {timeout}")
    runs = probes.withColumn("_before", before).withColumn("_next", next_ack).withColumn("dead_at", dead)
    first = runs.where(~F.col("ack") & F.coalesce("_before", F.lit(True)))
    return first.where(F.col("_next").isNull() | (F.col("_next") >= F.col("dead_at"))).select(node, F.col(ts).alias("suspected_at"), "dead_at")


def removals(dead: DataFrame, now: str, after: str) -> DataFrame:
    """The dead members (dead_at; see failures) that a second timeout has removed by ``now``, with removed_at."""
    gone = F.col("dead_at") + F.expr(f"interval {after}")
    return dead.withColumn("removed_at", gone).where(F.col("removed_at") <= F.lit(now).cast("timestamp_ntz"))


def alive_count(members: DataFrame) -> DataFrame:
    return members.agg(F.count_if(F.col("state") == "alive").alias("alive"))


def incarnations(updates: DataFrame, node: str, order: str) -> DataFrame:
    """State of each node after its updates (state, incarnation) in order: alive needs a higher incarnation, suspect an
    equal or higher one, dead is final. Until death a node's incarnation is the highest that it was told, so what each
    update meets is a running maximum, and no history meets in one row."""
    before = Window.partitionBy(node).orderBy(order, "state", "incarnation").rowsBetween(Window.unboundedPreceding, -1)
    told = updates.withColumn("_held", F.greatest(F.lit(-1).cast("long"), F.max("incarnation").over(before))).withColumn("_dead", F.coalesce(F.bool_or(F.col("state") == "dead").over(before), F.lit(False)))
    takes = F.when(F.col("_dead"), False).when(F.col("state") == "alive", F.col("incarnation") > F.col("_held")).when(F.col("state") == "suspect", F.col("incarnation") >= F.col("_held")).otherwise(True)
    last = F.max(F.when(takes, F.struct(F.col(order).alias("o"), F.col("state").alias("state"), F.col("incarnation").alias("i"))))
    highest = F.greatest(F.lit(-1).cast("long"), F.max(F.when(~F.col("_dead"), F.col("incarnation"))))
    ended = told.groupBy(node).agg(last.alias("_last"), highest.alias("incarnation"))
    return ended.select(node, F.when(F.col("_last").isNull(), "alive").otherwise(F.col("_last.state")).alias("state"), "incarnation")


def probe_targets(members: DataFrame, own: int, node: str = "node_id") -> DataFrame:
    return members.where((F.col(node) != own) & (F.col("state") != "dead"))


def random_alive(members: DataFrame, own: int, seed: int, node: str = "node_id") -> DataFrame:
    return members.where((F.col(node) != own) & (F.col("state") == "alive")).orderBy(F.rand(seed)).limit(1)


def gossip_batch(queue: DataFrame, order: str, most: int = 8) -> DataFrame:
    """The next updates to send, oldest first."""
    return queue.orderBy(order).limit(most)
