"""Whole jobs: results on all rows, where a query's SQL or a small fixture would not show what is missing."""

import datetime as dt
import random

import duckdb
import pytest

from sluice.operators import machines, membership, routing
from sluice.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DIR}/events.parquet'")
    return con


def test_every_click_gets_a_reply_or_a_timeout(spark, duck):
    within = "r.ts >= c.ts AND r.ts <= c.ts + INTERVAL 1 DAY"
    want = duck.execute(f"SELECT c.event_id, min(r.ts) FILTER ({within}) FROM (FROM events WHERE event_type = 'click') c LEFT JOIN (FROM events WHERE event_type = 'purchase') r USING (user_id) GROUP BY ALL").fetchall()
    got = catalogue.QUERIES["reply_timeout"](spark, DIR).collect()
    assert sorted((r.event_id, r.reply_at, r.timed_out) for r in got) == sorted((i, at, at is None) for i, at in want)


def test_replies_across_ranges_of_one_request(spark):
    at = lambda m: None if m is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    calls = [(i, 7, at(i)) for i in range(0, 4000, 2)] + [(-1, None, at(3)), (-2, 7, None), (-3, 8, at(0)), (-4, 9, at(5)), (-4, 9, at(5))]
    answers = [(7, at(m)) for m in (1000, 1000, 2500, 3990)] + [(None, at(4)), (7, None), (8, at(61)), (9, at(5))]
    c = spark.createDataFrame(calls, "id long, k long, ts timestamp_ntz").repartition(5)
    a = spark.createDataFrame(answers, "k long, ts timestamp_ntz")
    want = []  # equal calls are calls of their own
    for i, k, ts in calls:
        first = min((t for q, t in answers if None not in (q, t, ts) and q == k and ts <= t <= ts + dt.timedelta(hours=1)), default=None)
        want.append((i, k, ts, first, first is None))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many ranges
    try:
        got = routing.replies(c, a, "k", "1 HOUR").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_unregistered_names_of_every_signup(spark, tmp_path):
    rows = [(1, 1, "signup", 5.0), (2, 1, "signup", 40.0), (3, 2, "signup", 7.0), (50, 2, "signup", 9.0), (4, 3, "signup", 1.0), (5, 4, "view", 2.0), (100, 5, "signup", 6.0), (101, 5, "signup", 31.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert catalogue.QUERIES["unregistered_names"](spark, str(tmp_path)).first().names == 2  # 2 and 3; 1 and 5 have entries left


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_machine_of_a_key_with_many_chunks(spark):
    table = {("off", "go"): "wait", ("wait", "ok"): "on", ("on", "err"): "off", ("wait", "err"): "off"}
    rng = random.Random(4)
    rows = [(k, i, rng.choice(["go", "ok", "err", "other", None])) for k, n in (("hot", 20_000), ("a", 3), (None, 9)) for i in range(n)]
    want = {}
    for k, _, e in rows:
        state, changes, handled = want.get(k, ("off", 0, 0))
        to = table.get((state, e), state)
        want[k] = to, changes + (to != state), handled + 1
    rng.shuffle(rows)
    df = machines.machine(spark.createDataFrame(rows, "k string, o long, e string"), "k", "o", "e", table, "off")
    assert {r.k: (r.state, r.changes, r.handled) for r in df.collect()} == want
    assert "rangepartitioning" in plan(df)  # a key's rows are split


def test_incarnations_without_a_history_in_one_row(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice(["alive", "suspect", "left", None] + ["dead"] * (k % 2 and i > 3)), rng.choice([None, -2, -1, 0, 1, 2, 3])) for k in range(300) for i in range(rng.randrange(1, 9))]
    want = {}
    for k, _, s, n in rows:
        state, held = want.get(k, ("alive", -1))
        takes = state != "dead" and (n is not None and n > held if s == "alive" else n is not None and n >= held if s == "suspect" else True)
        want[k] = (s, max(held, held if n is None else n)) if takes else (state, held)
    df = membership.incarnations(spark.createDataFrame(rows, "k long, o long, state string, incarnation long"), "k", "o")
    assert {r.k: (r.state, r.incarnation) for r in df.collect()} == want
    assert "collect_list" not in plan(df)


def test_folds_carry_one_accumulator_over_batches(spark):
    rng = random.Random(9)
    rows = [(k, i, rng.choice([None, 0, 1, 5, 2**60 + 1])) for k, n in (("hot", 30_000), ("a", 3), (None, 9), ("b", 1)) for i in range(n)]
    average, asked, held = {}, [], {}
    for k, i, v in rows:
        acc, n = average.get(k, (None, 0))
        average[k] = (v if acc is None or v is None else (3 * v + 7 * acc) // 10, n + 1)
        held[k] = held.get(k, 0) + (v or 0)
        if held[k] >= 12:
            asked.append((k, i, held[k]))
            held[k] = 0
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o long, v long")
    from sluice.operators import dispatch, scheduling

    assert {r.k: (r.avg_us, r.completed) for r in scheduling.response_average(df, "k", "o", "v").collect()} == average
    assert sorted(((r.k, r.o, r.asked) for r in dispatch.reask_points(df, "k", "o", "v", 12).collect()), key=str) == sorted(asked, key=str)
    assert dispatch.reask_points(df.limit(0), "k", "o", "v", 12).count() == 0 == scheduling.response_average(df.limit(0), "k", "o", "v").count()


def test_positions_totals_and_as_of_values_over_many_ranges(spark):
    from sluice.operators import ordering

    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.randint(0, 400), rng.choice([None, rng.randint(-5, 9)])) for _ in range(3000)]
    df = spark.createDataFrame([(k, o, v, i) for i, (k, o, v) in enumerate(rows)], "range string, o long, v long, at long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ordering.position_in(df, "range", "o", "at").collect()
        totals = ordering.running_total(df, "v", "o", "at", name="sum").collect()
        carried = ordering.carried(df, "v", "o", "at").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted((o, i) for i, (_, o, _) in enumerate(rows))
    seen, total, last, want = {}, 0, None, {}
    for o, i in order:
        k, _, v = rows[i]
        seen[k] = seen.get(k, 0) + 1
        total, last = total + (v or 0), last if v is None else v
        want[i] = (seen[k], total, last)
    assert {r.at: r.pos for r in placed} == {i: w[0] for i, w in want.items()} and all(r.n == seen[r.range] for r in placed)
    assert {r.at: r["sum"] for r in totals} == {i: w[1] for i, w in want.items()}
    assert {r.at: r.v for r in carried} == {i: w[2] for i, w in want.items()}


def test_dispatch_to_many_consumers(spark):
    from sluice.operators import dispatch

    rng = random.Random(3)
    consumers = [(i, o, rng.choice([0, 0, 1, 3, 40])) for i, o in enumerate(rng.sample(range(900), 300))]
    c = spark.createDataFrame(consumers, "tag long, ord int, demand long")
    e = spark.range(2000).selectExpr("id * 3 AS seq", "id AS place")
    want, at = {}, 0
    for tag, _, demand in sorted(consumers, key=lambda x: x[1]):
        for k in range(at, min(at + demand, 2000)):
            want[3 * k] = tag
        at += demand
    assert {r.seq: r.tag for r in dispatch.by_demand(e, c, "seq").collect()} == {3 * k: want.get(3 * k) for k in range(2000)}
    lossy = dispatch.to_all(e, c, "seq", lossless=False).collect()
    assert sorted((r.tag, r.seq) for r in lossy) == sorted((tag, 3 * k) for tag, _, d in consumers for k in range(d))
    none = c.withColumn("demand", dispatch.F.lit(0).cast("long"))
    assert dispatch.kept_by_producer(e, none).count() == 2000 and dispatch.kept_by_producer(e, c).count() == 0 == dispatch.to_all(e, none, "seq", lossless=False).count()


def test_start_order_of_layers_takes_a_round_a_level(spark):
    from sluice.plans import apps

    layers = [[f"{i}-{j}" for j in range(4)] for i in range(12)]  # 4 ** 11 paths
    needs = [(a, b) for up, low in zip(layers[1:], layers, strict=False) for a in up for b in low]
    got = apps.start_order(spark, spark.createDataFrame([(a,) for layer in layers for a in layer], "app string"), spark.createDataFrame(needs, "app string, dep string"))
    assert {r.app: r.depth for r in got.collect()} == {a: i for i, layer in enumerate(layers) for a in layer}


def test_sketched_percentiles_are_within_their_error(spark):
    from sluice.operators import scheduling

    df = spark.range(50_000).selectExpr("id % 2 AS k", "(id * 7919) % 50000 AS v")
    exact, near = ({r.k: r for r in f(df, "k", "v").collect()} for f in (scheduling.percentiles, scheduling.percentile_sketch))
    assert all(abs(exact[k][p] - near[k][p]) <= 50_000 / 10_000 + 2 for k in (0, 1) for p in scheduling.PERCENTILES) and exact[0].n == near[0].n == 25_000
