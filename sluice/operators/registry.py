"""An observed-remove registry: entries (name, pid, tag, timestamp, node_id) and tombstones (tag)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def winners(entries: DataFrame) -> DataFrame:
    """The last writer of each name, by (timestamp, node_id, tag); the tag settles what the two leave equal."""
    best = entries.groupBy("name").agg(F.max_by(F.struct("pid", "tag", "timestamp", "node_id"), F.struct("timestamp", "node_id", "tag")).alias("w"))
    return best.select("name", "w.*")


def merge(entries: DataFrame, remote: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Entries of both replicas, once each by tag, without the removed ones. Idempotent and order-free."""
    return entries.unionByName(remote).dropDuplicates(["tag"]).join(tombstones.select("tag").distinct(), "tag", "left_anti")


def merge_tombstones(*sets: DataFrame) -> DataFrame:
    out = sets[0].select("tag")
    for s in sets[1:]:
        out = out.unionByName(s.select("tag"))
    return out.distinct()


def unregister(entries: DataFrame, tombstones: DataFrame, condition) -> DataFrame:
    """Tombstones with those of the entries that match the condition (a name, a process or a node)."""
    return merge_tombstones(tombstones, entries.where(condition))


def export(entries: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The full state as deltas: an add for each entry and a remove for each tombstone."""
    adds = entries.select(F.lit("add").alias("op"), "name", "tag", "pid", "timestamp", "node_id")
    removes = tombstones.select(F.lit("remove").alias("op"), "tag")
    return adds.unionByName(removes, allowMissingColumns=True)


def unregistered_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many names a removal took away."""
    return before.select("name").distinct().join(after.select("name").distinct(), "name", "left_anti").agg(F.count("*").alias("names"))
