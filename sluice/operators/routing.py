"""Delivery of messages by process, name, group and node."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.sources.shared import written


#: A strategy that says for each message what becomes of it, in a column ``route``.
Router = Callable[[DataFrame], DataFrame]


def routed(messages: DataFrame, router: Router, outlets: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Messages by a router's choice through the outlet of that name; one without an outlet is an error of its row."""
    chosen = router(messages)
    parts = [outlet(chosen.where(F.col("route") == name)) for name, outlet in outlets.items()]
    lost = chosen.where(~F.coalesce(F.col("route").isin(*outlets), F.lit(False))).withColumn("error", F.lit("no route"))
    for part in parts:
        lost = lost.unionByName(part, allowMissingColumns=True)
    return lost


def process_count(processes: DataFrame) -> DataFrame:
    return processes.agg(F.count("*").alias("processes"))


def deliver(messages: DataFrame, processes: DataFrame, key: str) -> DataFrame:
    """Messages whose destination exists, with its columns."""
    return messages.join(processes, key)


def dead_letters(messages: DataFrame, processes: DataFrame, key: str) -> DataFrame:
    """Messages whose destination does not exist."""
    return messages.join(processes, key, "left_anti")


def local_or_remote(rows: DataFrame, node: Column, own: int) -> DataFrame:
    return rows.withColumn("route", F.when(node == own, "local").otherwise("remote"))


def send_named(messages: DataFrame, names: DataFrame) -> DataFrame:
    """Messages by name to the process that holds it; names has one row a name (see registry.winners)."""
    return messages.join(names, "name", "left").withColumn("error", F.when(F.col("pid").isNull(), "unknown name"))


def replies(calls: DataFrame, answers: DataFrame, request: str, within: str) -> DataFrame:
    """Every call with its first answer in time (reply_at), or a null and ``timed_out``. Equal calls are so many rows.

    Calls and answers are dealt together by ranges of request and time and written once, so that a request with many
    rows is split over tasks and no call meets more than one answer: within a range the next answer is carried backwards,
    and where there is none, it is the first of the ranges behind (a row for each request and range)."""
    names = calls.columns
    c = calls.select(F.col(request).alias("_key"), F.col("ts").alias("_ts"), F.lit(None).cast(answers.schema["ts"].dataType).alias("_reply"), F.struct(*[F.col(n) for n in names]).alias("_call"))
    a = answers.where(F.col(request).isNotNull() & F.col("ts").isNotNull()).select(F.col(request).alias("_key"), F.col("ts").alias("_ts"), F.col("ts").alias("_reply"))
    rows = c.unionByName(a, allowMissingColumns=True)
    dealt = written(rows.repartitionByRange("_key", "_ts").withColumn("_range", F.spark_partition_id()), "replies")
    behind = Window.partitionBy("_key").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("_key", "_range").agg(F.min("_reply").alias("_first"))
    later = firsts.select("_key", "_range", F.min("_first").over(behind).alias("_later")).where("_later IS NOT NULL")
    own = Window.partitionBy("_key", "_range").orderBy(F.desc("_ts"), F.col("_reply").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    first = dealt.withColumn("_next", F.min("_reply").over(own)).where("_call IS NOT NULL").join(later, ["_key", "_range"], "left").withColumn("_next", F.coalesce("_next", "_later"))
    reply = F.when(F.col("_next") <= F.col("_ts") + F.expr(f"interval {within}"), F.col("_next"))
    return first.select("_call.*", reply.alias("reply_at")).withColumn("timed_out", F.col("reply_at").isNull())
