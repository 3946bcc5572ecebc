import shutil
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from sluice.operators import machines, membership
from sluice.plans.catalogue import CONNECTION
from sluice.sources import feeds
from sluice.streaming import processors as P

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def stream(spark, tmp_path):
    """The events in three files, in order of time, as a stream with a watermark; and as a table."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", P.PROVIDER)
    table = spark.read.parquet(EVENTS).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("value"))
    for i in range(3):
        part = table.where((F.col("seq") >= i * 334) & (F.col("seq") < (i + 1) * 334)).coalesce(1)
        part.write.parquet(f"{tmp_path}/w{i}")
        (tmp_path / "in").mkdir(exist_ok=True)
        shutil.copy(next((tmp_path / f"w{i}").glob("*.parquet")), tmp_path / "in" / f"{i}.parquet")
    return feeds.stream_table(spark, f"{tmp_path}/in", table.schema).withWatermark("ts", "0 seconds"), table


def run(df, tmp_path, mode):
    name = f"out_{tmp_path.name}".replace("-", "_")
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_agent_equals_the_window(stream, tmp_path):
    live, table = stream
    got = {(r.key, r.seq): r.state for r in run(P.agent(live), tmp_path, "append").collect()}
    want = {(r.key, r.seq): r.state for r in machines.agent(table, "key", "seq", "value").collect()}
    assert got == want


def test_machine_equals_the_fold(stream, tmp_path):
    live, table = stream
    last = run(P.machine(live, CONNECTION, "off"), tmp_path, "update").groupBy("key").agg(F.max_by(F.struct("state", "changes", "handled"), "handled").alias("m"))
    got = {r.key: tuple(r.m) for r in last.collect()}
    want = {r.key: (r.state, r.changes, r.handled) for r in machines.machine(table, "key", "seq", "kind", CONNECTION, "off").collect()}
    assert got == want


def test_detector_equals_the_window_form(stream, tmp_path):
    live, table = stream
    probes = live.select("key", "ts", (F.col("kind") != "error").alias("ack"))
    got = {(r.key, r.suspected_ms, r.dead_ms) for r in run(P.detector(probes, timedelta(hours=8)), tmp_path, "append").collect()}
    batch = membership.failures(table.withColumn("ack", F.col("kind") != "error"), "key", "ts", "seq", "8 HOURS")
    last = table.agg(F.unix_millis(F.max("ts"))).first()[0]
    want = {(r.key, r.s, r.d) for r in batch.select("key", F.unix_millis("suspected_at").alias("s"), F.unix_millis("dead_at").alias("d")).collect() if r.d < last}
    assert want <= got and all(d >= last for _, _, d in got - want)


def test_postponed_events_and_state_timers(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", P.PROVIDER)
    rows = [(1, 1, "send", "2024-01-01 00:00:00"), (1, 2, "send", "2024-01-01 00:00:01"), (1, 3, "open", "2024-01-01 00:00:02"), (2, 4, "open", "2024-01-01 00:00:03"), (9, 5, "send", "2024-01-01 00:05:00")]
    schema = "key long, seq long, kind string, ts timestamp"
    for i, part in enumerate((rows[:4], rows[4:], [(9, 6, "send", "2024-01-01 00:06:00")])):
        spark.createDataFrame([(k, s, e, None) for k, s, e, _ in part], "key long, seq long, kind string, ts string").drop("ts").join(spark.createDataFrame([(s, t) for _, s, _, t in part], "seq long, t string"), "seq").select("key", "seq", "kind", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/w{i}")
        (tmp_path / "in").mkdir(exist_ok=True)
        shutil.copy(next((tmp_path / f"w{i}").glob("*.parquet")), tmp_path / "in" / f"{i}.parquet")
    live = feeds.stream_table(spark, f"{tmp_path}/in", schema).withWatermark("ts", "0 seconds")
    table = {("closed", "open"): "opening", ("opening", "opened"): "ready", ("ready", "send"): "ready", ("ready", "idle"): "closed"}
    out = run(P.machine(live, table, "closed", postponed=frozenset(["send"]), timeouts_ms={"ready": (60_000, "idle")}, internal={"opening": "opened"}), tmp_path, "update")
    got = [(r.key, r.state, r.changes, r.handled) for r in out.where("key < 9").collect()]
    assert (1, "ready", 2, 4) in got and (2, "ready", 2, 2) in got  # an internal event opened them; both waiting sends were handled then
    assert (1, "closed", 3, 5) in got and (2, "closed", 3, 3) in got  # a minute later the timer closed them
