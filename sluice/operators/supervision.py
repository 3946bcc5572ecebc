"""Supervisors: restart sets, restart intensity, child counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.ordering import position_in


def restart_set(children: DataFrame, failures: DataFrame) -> DataFrame:
    """Children (sup, idx) to restart for each failure (sup, idx, strategy): the failed one, all, or it and those after
    it. Temporary children that had finished are restarted like the rest. A failed child that restarts alone meets itself
    only."""
    f = failures.select("sup", F.col("idx").alias("failed"), "strategy")
    alone = f.where("strategy = 'one_for_one'").withColumn("idx", F.col("failed")).join(children.select("sup", "idx"), ["sup", "idx"])
    hit = (F.col("strategy") == "one_for_all") | (F.col("strategy") == "rest_for_one") & (F.col("idx") >= F.col("failed"))
    many = children.select("sup", "idx").join(f.where("strategy IN ('one_for_all', 'rest_for_one')"), "sup").where(hit)
    return alone.select("sup", "failed", "strategy", "idx").unionByName(many.select("sup", "failed", "strategy", "idx"))


def restart_intensity(restarts: DataFrame, key: str, ts: str, window: str, most: int) -> DataFrame:
    """Restarts in the trailing window (its edge included) and whether one more is allowed; most = 0 never restarts."""
    counted = restarts.withColumn("recent", F.expr(f"count(*) OVER (PARTITION BY {key} ORDER BY {ts} RANGE BETWEEN INTERVAL {window} PRECEDING AND CURRENT ROW)"))
    return counted.withColumn("allowed", (F.col("recent") <= most) & F.lit(most > 0))


def child_counts(children: DataFrame, sup: str) -> DataFrame:
    return children.groupBy(sup).agg(F.count_if(F.col("state") == "running").alias("active"), F.count("*").alias("total"))


def lifecycle(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last state of every dynamic child: start, restart -> running; terminate, exit -> stopped; remove -> gone."""
    last = events.groupBy(key).agg(F.max_by("kind", order).alias("kind"), F.count_if(F.col("kind") == "restart").alias("restarts"))
    state = F.when(F.col("kind").isin("start", "restart"), "running").when(F.col("kind") == "remove", "gone").otherwise("stopped")
    return last.select(key, state.alias("state"), "restarts")


def stop_order(children: DataFrame, sup: str, idx: str) -> DataFrame:
    """Children with their place in the shutdown, last started first. A supervisor with many children is split over
    tasks."""
    return position_in(children, sup, F.desc(idx), name="stop_at", count="children").drop("children")
