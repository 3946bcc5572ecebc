"""Applications: start and stop order of a dependency graph, configuration, and small recursive tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources.shared import written


def start_order(spark: SparkSession, apps: DataFrame, needs: DataFrame) -> DataFrame:
    """Depth of every app (app) so that all it needs (app, dep) starts before it: a level a round, of the apps all of
    whose needs are placed. Rounds are as many as levels, whatever the number of paths. A cycle raises an error."""
    placed, waiting = None, written(apps.select("app").distinct(), "apps")
    edges = needs.select("app", "dep").distinct().join(waiting.select(F.col("app").alias("dep")), "dep", "left_semi")
    depth, left = 0, waiting.count()
    while left:
        open_ = edges.join(waiting.select(F.col("app").alias("dep")), "dep", "left_semi").select("app").distinct()
        level = waiting.join(open_, "app", "left_anti").select("app", F.lit(depth).cast("long").alias("depth"))
        placed = written(level if placed is None else placed.unionByName(level), "placed")
        waiting = written(waiting.join(placed, "app", "left_anti"), "apps")
        depth, before, left = depth + 1, left, waiting.count()
        if left == before:
            raise ValueError("dependency cycle")
    return placed if placed is not None else apps.select("app", F.lit(0).cast("long").alias("depth"))


def stop_order(started: DataFrame) -> DataFrame:
    """The reverse of start_order's result, as a rank."""
    return started.select("app", (-F.col("depth")).alias("rank"))


def settings(env: DataFrame, app: str, key: str, default: str) -> DataFrame:
    """A key of each app's settings (a map column ``env``), or the default."""
    return env.select(app, F.coalesce(F.try_element_at("env", F.lit(key)), F.lit(default)).alias("value"))


def fetched(env: DataFrame, app: str, key: str) -> DataFrame:
    """A key of each app's settings, or the error ``missing``."""
    value = F.try_element_at("env", F.lit(key))
    return env.select(app, value.alias("value"), F.when(value.isNull(), "missing").alias("error"))


def put(env: DataFrame, app: str, changes: DataFrame) -> DataFrame:
    """env with each change (app, ord, key, value) in order: a value is set, a null value deletes its key. Apps without
    settings get some."""
    last = changes.groupBy(app, "key").agg(F.max_by(F.struct("value"), "ord").alias("v"))
    new = last.groupBy(app).agg(F.map_from_entries(F.collect_list(F.struct("key", F.col("v.value").alias("value")))).alias("_new"))
    joined = env.select(app, "env").join(new, app, "full")
    nothing = F.create_map().cast("map<string,string>")
    old, fresh = F.coalesce("env", nothing), F.coalesce("_new", nothing)
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(fresh, k))
    return joined.select(app, F.map_concat(kept, F.map_filter(fresh, lambda _, v: v.isNotNull())).alias("env"))


def all_settings(env: DataFrame, app: str) -> DataFrame:
    """A row (app, key, value) for each setting."""
    return env.select(app, F.explode("env"))


def fibonacci(spark: SparkSession, most: int = 92) -> DataFrame:
    """n and fib(n) for 0 to most (92 is the last that fits)."""
    if not 0 <= most <= 92:
        raise ValueError("n must be 0 to 92")
    return spark.sql(f"""
        WITH RECURSIVE f(n, a, b) AS (
            SELECT 0L, 0L, 1L UNION ALL SELECT n + 1, b, CASE WHEN n < 91 THEN a + b ELSE b END FROM f WHERE n < {most}
        ) SELECT n, a AS result FROM f""")


def computed(requests: DataFrame, n: str, table: DataFrame) -> DataFrame:
    """requests with result from the table, or an error where n is out of its range."""
    looked = requests.join(F.broadcast(table.withColumnRenamed("n", n)), n, "left")
    return looked.withColumn("error", F.when(F.col("result").isNull(), "n out of range"))
