"""Process groups as bags of memberships, and link sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(members: DataFrame, joins: DataFrame) -> DataFrame:
    """One more membership for each join, also of a process that is in already."""
    return members.unionByName(joins)


def leave_groups(members: DataFrame, leaves: DataFrame) -> DataFrame:
    """One membership less for each leave."""
    return members.exceptAll(leaves)


def failed_leaves(members: DataFrame, leaves: DataFrame) -> DataFrame:
    """Leaves of memberships that did not exist."""
    return leaves.exceptAll(members)


def remove_processes(members: DataFrame, gone: DataFrame, *key: str) -> DataFrame:
    """All memberships of the processes (or nodes) in gone are dropped."""
    return members.join(gone.select(*key).distinct(), list(key), "left_anti")


def member_counts(members: DataFrame, group: str) -> DataFrame:
    return members.groupBy(group).agg(F.count("*").alias("members"))


def local_members(members: DataFrame, node: int) -> DataFrame:
    return members.where(F.col("node_id") == node)


def broadcast_to_groups(messages: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """One copy of a message for each membership of its group."""
    return messages.join(members, group)


def link(links: DataFrame, added: DataFrame) -> DataFrame:
    return links.unionByName(added).distinct()


def unlink(links: DataFrame, removed: DataFrame) -> DataFrame:
    return links.distinct().exceptAll(removed.distinct())


def listing(members: DataFrame, group: str, *key: str) -> DataFrame:
    """Each group with how many distinct members it has and how many memberships."""
    return members.groupBy(group).agg(F.count_distinct(*key).alias("processes"), F.count("*").alias("memberships"))
