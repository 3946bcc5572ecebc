"""Sources and sinks of a pipeline: tables, pushed rows, interval and delayed rows, stages and terminal consumers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A pull source: each trigger asks for a bounded number of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def pipeline(source: DataFrame, *stages: Stage) -> DataFrame:
    """source through each stage in turn: one lazy plan."""
    return reduce(lambda df, stage: stage(df), stages, source)


def merged(*sources: DataFrame) -> DataFrame:
    """Rows of several producers, with the producer's number in ``producer``."""
    return reduce(DataFrame.unionByName, (s.withColumn("producer", F.lit(i)) for i, s in enumerate(sources)))


def injected(df: DataFrame, node: int) -> DataFrame:
    """df as sent from outside: the sender is process 0 of node."""
    return df.withColumn("sender", F.struct(F.lit(node).cast("long").alias("node_id"), F.lit(0).cast("long").alias("local_id")))


def interval(spark: SparkSession, start: str, end: str, step: str) -> DataFrame:
    """One row (tick, at) for each step from start to end, the first tick left out."""
    grid = spark.range(1).select(F.posexplode(F.expr(f"sequence(timestamp_ntz'{start}', timestamp_ntz'{end}', interval {step})")).alias("tick", "at"))
    return grid.where("tick > 0").select(F.col("tick").cast("long").alias("tick"), "at")


def delayed(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """df with due_at, the time a one-shot message is due."""
    return df.withColumn("due_at", F.col(ts) + F.expr(f"interval {delay}"))


def until_cancelled(df: DataFrame, ts: str, cancelled_at: Column) -> DataFrame:
    """Rows before the cancellation; all rows where it is null."""
    return df.where(cancelled_at.isNull() | (F.col(ts) < cancelled_at))


def every(df: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Run job on each micro-batch of a stream, one after the other."""
    return df.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(**trigger).start()
