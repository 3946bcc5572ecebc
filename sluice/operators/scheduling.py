"""Work distribution: worker choice, response-time averages, ordered results, capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.values import load_score
from sluice.operators.folds import fold
from sluice.operators.ordering import position_in


def pick_worker(workers: DataFrame, registered: str = "worker") -> DataFrame:
    """The least loaded worker: by (in_flight + 1) * max(average, 1), then completed, then the column that tells the order
    of registration."""
    load = load_score(F.col("in_flight"), F.col("avg_us"))
    return workers.agg(F.min_by("worker", F.struct(load, F.col("completed"), F.col(registered))).alias("worker"), F.min(load).alias("load"))


def registered(changes: DataFrame, worker: str, order: str, kind: str) -> DataFrame:
    """The workers in the registry after all changes (register, unregister) in order, with the order value of the
    registration that holds; registering again renews it."""
    last = changes.where(F.col(kind).isin("register", "unregister")).groupBy(worker).agg(F.max_by(F.struct(F.col(kind).alias("kind"), F.col(order).alias("o")), order).alias("l"))
    return last.where("l.kind = 'register'").select(worker, F.col("l.o").alias("registered"))


def response_average(samples: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Per key, the integer moving average: the first sample, then (3 * sample + 7 * average) div 10 in order, and the
    number of samples. A timed out task counts as a sample of its timeout."""

    def step(acc: tuple | None, _: int, x: int | None) -> tuple[tuple, None]:
        average, n = acc or (None, 0)
        return (x if average is None or x is None else (3 * x + 7 * average) // 10, n + 1), None

    return fold(samples.withColumn(value, F.col(value).cast("long")), key, order, value, step, "avg_us long, completed long", finish=lambda acc: acc)


def counters(events: DataFrame, key: str) -> DataFrame:
    """In-flight and completed tasks from started and finished rows (kind +1 or -1)."""
    return events.groupBy(key).agg(F.sum("step").alias("in_flight"), F.count_if(F.col("step") < 0).alias("completed"))


def map_tasks(items: DataFrame, order: str, result: Column, failed: Column, took: Column | None = None, timeout: int | None = None) -> DataFrame:
    """items with result (null where the task failed or timed out), error and the input position ``seq``."""
    late = F.lit(False) if took is None else took > timeout
    error = F.when(failed, "failed").when(late, "timeout")
    return items.withColumn("error", error).withColumn("result", F.when(error.isNull(), result)).withColumn("seq", F.col(order))


def within_capacity(workers: DataFrame, order: str, most: int) -> DataFrame:
    """The workers that fit a registry of ``most``, first come first served."""
    return workers.orderBy(order).limit(most)


def drain_stats(phases: DataFrame, key: str) -> DataFrame:
    """Per key: stopped, drained, time of the longest phase (ms) and whether any phase timed out."""
    return phases.groupBy(key).agg(F.sum("stopped").alias("stopped"), F.sum("drained").alias("drained"), F.max("ms").alias("longest_ms"), F.bool_or("timed_out").alias("timed_out"))


def drain_phases(tasks: DataFrame, key: str, phase: str, took_ms: str, limits: dict[str, int]) -> DataFrame:
    """Per key and phase: tasks that ended within the phase's time limit (drained), those it stopped, the phase's length
    (ms, at most its limit) and whether it timed out. A phase without a limit in limits is not run."""
    limit = F.coalesce(*[F.when(F.col(phase) == p, F.lit(ms).cast("long")) for p, ms in limits.items()])
    rows = tasks.withColumn("_limit", limit).where("_limit IS NOT NULL")
    late = F.col(took_ms) > F.col("_limit")
    return rows.groupBy(key, phase).agg(F.count_if(~late).alias("drained"), F.count_if(late).alias("stopped"), F.max(F.least(F.col(took_ms), F.col("_limit"))).cast("long").alias("ms"), F.bool_or(late).alias("timed_out"))


def assigned(tasks: DataFrame, workers: DataFrame, attempt: str = "attempt") -> DataFrame:
    """tasks (seq, tries: an array of workers in order of preference) with the first live worker, or the error
    ``no worker``; dead workers are passed over."""
    tried = tasks.select("seq", F.posexplode_outer("tries").alias(attempt, "worker")).join(workers.where("alive").select("worker", F.lit(True).alias("_alive")), "worker", "left")
    first = tried.groupBy("seq").agg(F.min_by("worker", F.when(F.col("_alive"), F.col(attempt))).alias("worker"), F.max("_alive").alias("_alive"))
    return first.select("seq", F.when(F.col("_alive"), F.col("worker")).alias("worker"), F.when(F.col("_alive").isNull(), "no worker").alias("error"))


PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def percentiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Exact p50, p95, p99 and p99.9 of value (linear between neighbours): values are ranked in ranges of key and value,
    so a key of any size is split over tasks, and two rows for each percentile are kept."""
    ranked = position_in(rows.where(F.col(value).isNotNull()).select(key, value), key, value, name="rank", count="n")
    rest = {name: (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p) for name, p in PERCENTILES.items()}
    low = {name: F.floor((F.col("n") - 1) * p) + 1 for name, p in PERCENTILES.items()}
    near = [(F.col("rank") == low[name]) | (F.col("rank") == low[name] + 1) for name in PERCENTILES]
    held = ranked.where(near[0] | near[1] | near[2] | near[3])
    parts = [F.sum(F.when(F.col("rank") == low[name], F.col(value) * (1 - rest[name])).when(F.col("rank") == low[name] + 1, F.col(value) * rest[name])) for name in PERCENTILES]
    return held.groupBy(key).agg(*[F.round(x, 3).alias(name) for x, name in zip(parts, PERCENTILES, strict=True)], F.max("n").alias("n"))


def percentile_sketch(rows: DataFrame, key: str, value: str, accuracy: int = 10_000) -> DataFrame:
    """p50, p95, p99 and p99.9 of value from mergeable sketches, one pass and one small row a task and key; a rank is off
    by at most one part in accuracy of the key's rows."""
    return rows.groupBy(key).agg(*[F.percentile_approx(value, p, accuracy).alias(name) for name, p in PERCENTILES.items()], F.count(value).alias("n"))
