"""Small inputs with rows derived by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sluice.functions import payload, values
from sluice.operators import dispatch, groups, machines, membership, ordering, registry, routing, scheduling, supervision
from sluice.plans import apps
from sluice.sources import feeds


def events(spark, n):
    return spark.range(n).select(F.col("id").alias("seq"))


def consumers(spark, *demands):
    return spark.createDataFrame([(10 + i, i, d) for i, d in enumerate(demands)], "tag long, ord int, demand long")


@pytest.mark.parametrize(("n", "demands", "want"), [(3, [5], [10] * 3), (5, [3, 3], [10, 10, 10, 11, 11]), (4, [1, 0, 2], [10, 12, 12, None]), (0, [2], [])])
def test_demand_dispatch(spark, n, demands, want):
    got = dispatch.by_demand(events(spark, n), consumers(spark, *demands), "seq").orderBy("seq").collect()
    assert [r.tag for r in got] == want and [r.pos for r in got] == list(range(1, n + 1))


def test_broadcast_dispatch(spark):
    lossy = dispatch.to_all(events(spark, 5), consumers(spark, 2, 0), "seq", lossless=False).collect()
    assert sorted((r.tag, r.seq) for r in lossy) == [(10, 0), (10, 1)]
    assert dispatch.to_all(events(spark, 5), consumers(spark, 2, 0)).count() == 10


def test_demand_is_validated():
    assert dispatch.check_demand(1000, 500) == (1000, 500)
    for bad in ((2, 4), (5, 0)):
        with pytest.raises(ValueError):
            dispatch.check_demand(*bad)


def test_positions_of_many_ranges(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    got = ordering.with_position(df, "k").collect()
    assert len(got) == 1000 and all(r.pos == r.k + 1 for r in got)


def test_pipeline_of_counter_doubler_collector(spark):
    doubled = feeds.pipeline(events(spark, 4), lambda d: d.select((F.col("seq") * 2).alias("n")), lambda d: d.where("n > 0"))
    assert sorted(r.n for r in doubled.collect()) == [2, 4, 6]
    got = spark.createDataFrame([('{"k": 3}',), ('{"k": "x"}',), ("null",), (None,), ("not json",)], "p string").select(values.variant_long(F.col("p"), "$.k").alias("n"))
    assert [r.n for r in got.collect()] == [3, 0, 0, 0, 0]
    assert feeds.injected(events(spark, 1), 7).first().sender == (7, 0)
    assert feeds.interval(spark, "2024-01-01 00:00:00", "2024-01-01 00:00:03", "1 second").count() == 3


def test_tasks_keep_input_order_and_errors(spark):
    items = spark.createDataFrame([(i, i, i == 3, 10 * i) for i in range(1, 7)], "seq long, n long, bad boolean, ms long")
    got = scheduling.map_tasks(items, "seq", F.col("n") * 2, F.col("bad"), F.col("ms"), 55).orderBy("seq").collect()
    assert [(r.result, r.error) for r in got] == [(2, None), (4, None), (None, "failed"), (8, None), (10, None), (None, "timeout")]


def test_worker_choice_and_average(spark):
    w = spark.createDataFrame([(1, 0, 50, 9), (2, 1, 0, 3), (3, 0, 0, 5), (4, 0, 1, 5)], "worker long, in_flight long, avg_us long, completed long")
    assert scheduling.pick_worker(w).first().worker == 3  # loads 50, 2, 1, 1; a tie by completed, then registration
    s = spark.createDataFrame([("a", 1, 100), ("a", 2, 201), ("a", 3, 0), ("b", 1, 7)], "k string, o long, v long")
    assert {r.k: r.avg_us for r in scheduling.response_average(s, "k", "o", "v").collect()} == {"a": (7 * ((3 * 201 + 700) // 10)) // 10, "b": 7}


ENTRY = "name string, pid string, tag string, timestamp long, node_id long"


def test_registry_convergence_and_last_writer(spark):
    a = spark.createDataFrame([("counter", "1.10", "t1", 100, 1), ("leader", "1.1", "t3", 100, 1)], ENTRY)
    b = spark.createDataFrame([("logger", "2.20", "t2", 200, 2), ("leader", "2.1", "t4", 200, 2), ("leader", "1.1", "t3", 100, 1)], ENTRY)
    none = spark.createDataFrame([], "tag string")
    left, right = registry.merge(a, b, none), registry.merge(b, a, none)
    assert sorted(left.collect()) == sorted(right.collect()) and left.count() == 4
    assert {r.name: r.pid for r in registry.winners(left).collect()} == {"counter": "1.10", "logger": "2.20", "leader": "2.1"}
    gone = registry.unregister(left, none, "pid = '2.1'")
    after = registry.merge(left, left, gone)
    assert {r.name: r.pid for r in registry.winners(after).collect()}["leader"] == "1.1"
    assert registry.merge(after, b, gone).where("tag = 't4'").count() == 0
    assert registry.export(after, gone).groupBy("op").count().orderBy("op").collect() == [("add", 3), ("remove", 1)]
    assert registry.unregistered_names(left, after).first().names == 0


def test_ties_between_writers_are_settled(spark):
    e = spark.createDataFrame([("cache", "1", "x", 5, 1), ("cache", "2", "y", 5, 1)], ENTRY)
    assert registry.winners(e).first().pid == "2" and registry.winners(e.orderBy(F.desc("tag"))).first().pid == "2"


def test_groups_are_bags(spark):
    s = "grp string, pid long, node_id long"
    m = spark.createDataFrame([("g", 1, 1), ("g", 1, 1), ("h", 2, 2)], s)
    one = spark.createDataFrame([("g", 1, 1), ("g", 9, 1)], s)
    assert {r.grp: r.members for r in groups.member_counts(groups.leave_groups(m, one), "grp").collect()} == {"g": 1, "h": 1}
    assert [r.pid for r in groups.failed_leaves(m, one).collect()] == [9]
    msgs = spark.createDataFrame([("g", "hello")], "grp string, text string")
    assert groups.broadcast_to_groups(msgs, m, "grp").count() == 2
    assert groups.remove_processes(m, one, "pid").count() == 1 and groups.local_members(m, 2).count() == 1
    assert groups.unlink(groups.link(m, one), one).count() == 1


def test_routing(spark):
    p = spark.createDataFrame([(1, "a")], "pid long, name string")
    m = spark.createDataFrame([(1, "x"), (999999, "y")], "pid long, text string")
    assert routing.deliver(m, p, "pid").count() == 1 and routing.dead_letters(m, p, "pid").first().text == "y"
    named = spark.createDataFrame([("test_service",), ("nobody",)], "name string")
    got = {r.name: (r.pid, r.error) for r in routing.send_named(named, spark.createDataFrame([("test_service", 42)], "name string, pid long")).collect()}
    assert got == {"test_service": (42, None), "nobody": (None, "unknown name")}


def test_supervision(spark):
    kids = spark.createDataFrame([("s", i) for i in range(4)], "sup string, idx long")
    for strategy, want in (("one_for_one", [1]), ("one_for_all", [0, 1, 2, 3]), ("rest_for_one", [1, 2, 3])):
        f = spark.createDataFrame([("s", 1, strategy)], "sup string, idx long, strategy string")
        assert sorted(r.idx for r in supervision.restart_set(kids, f).collect()) == want
    t = [dt.datetime(2024, 1, 1, 0, 0, s) for s in (0, 5, 6, 11)]
    r = spark.createDataFrame([("s", x) for x in t], "sup string, ts timestamp")
    got = supervision.restart_intensity(r, "sup", "ts", "5 SECONDS", 2).orderBy("ts").collect()
    assert [(x.recent, x.allowed) for x in got] == [(1, True), (2, True), (2, True), (2, True)]  # the window's edge counts
    assert not supervision.restart_intensity(r, "sup", "ts", "5 SECONDS", 0).where("allowed").count()
    life = spark.createDataFrame([(1, 1, "start"), (1, 2, "exit"), (1, 3, "restart"), (2, 1, "start"), (2, 2, "terminate"), (3, 1, "start"), (3, 2, "remove")], "id long, o long, kind string")
    assert {x.id: (x.state, x.restarts) for x in supervision.lifecycle(life, "id", "o").collect()} == {1: ("running", 1), 2: ("stopped", 0), 3: ("gone", 0)}


def test_counter_server_and_connection_machine(spark):
    c = spark.createDataFrame([("k", i, kind) for i, kind in enumerate(["inc", "inc", "reset", "inc"])], "key string, seq long, kind string")
    got = machines.counter(c, "key", "seq", F.lit(1), F.col("kind") == "reset").orderBy("seq").collect()
    assert [r.total for r in got] == [1, 2, 0, 1]
    table = {("down", "connect"): "connecting", ("connecting", "ok"): "up", ("up", "lost"): "down"}
    e = spark.createDataFrame([("k", i, x) for i, x in enumerate(["connect", "lost", "ok", "send", "lost", "connect"])], "key string, seq long, kind string")
    assert tuple(machines.machine(e, "key", "seq", "kind", table, "down").first()) == ("k", "connecting", 4, 6)
    s = spark.createDataFrame([("k", i, x) for i, x in enumerate(["a", "suspend", "b", "c", "resume", "d", "suspend", "e"])], "key string, seq long, kind string")
    assert [r.handled_at for r in machines.suspended(s, "key", "seq", "kind", "suspend", "resume").orderBy("seq").collect()] == [0, 1, 4, 4, 4, 5, 6, None]
    q = spark.createDataFrame([("k", 0, 1, "info"), ("k", 0, 2, "call"), ("k", 0, 3, "system"), ("k", 1, 4, "continue"), ("k", 0, 5, "call")], "key string, tick long, seq long, kind string")
    assert [r.seq for r in machines.served_order(q, "key", "tick", "kind", "seq").orderBy("served").collect()] == [3, 2, 5, 1, 4]


def test_reask_points(spark):
    b = spark.createDataFrame([("c", i, n) for i, n in enumerate([2, 2, 1, 4, 1, 5])], "key string, o long, n long")
    assert [(r.o, r.asked) for r in dispatch.reask_points(b, "key", "o", "n", 4).orderBy("o").collect()] == [(1, 4), (3, 5), (5, 6)]


def test_failure_detector_and_incarnations(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    p = spark.createDataFrame([(1, 0, False, at(0)), (1, 1, True, at(3)), (2, 2, False, at(0)), (2, 3, False, at(6)), (3, 4, False, at(0)), (3, 5, True, at(5))], "node long, seq long, ack boolean, ts timestamp")
    assert sorted((r.node, r.dead_at) for r in membership.failures(p, "node", "ts", "seq", "5 SECONDS").collect()) == [(2, at(5)), (3, at(5))]
    u = [(1, "alive", 1), (1, "suspect", 1), (1, "alive", 1), (1, "suspect", 0), (2, "dead", 0), (2, "alive", 9), (3, "suspect", 2), (3, "alive", 3)]
    df = spark.createDataFrame([(n, i, s, inc) for i, (n, s, inc) in enumerate(u)], "node long, o long, state string, incarnation long")
    assert {r.node: (r.state, r.incarnation) for r in membership.incarnations(df, "node", "o").collect()} == {1: ("suspect", 1), 2: ("dead", 0), 3: ("alive", 3)}


def test_start_order_of_a_diamond_and_a_cycle(spark):
    a = spark.createDataFrame([(x,) for x in ("top", "left", "right", "base")], "app string")
    n = spark.createDataFrame([("top", "left"), ("top", "right"), ("left", "base"), ("right", "base")], "app string, dep string")
    got = {r.app: r.depth for r in apps.start_order(spark, a, n).collect()}
    assert got == {"base": 0, "left": 1, "right": 1, "top": 2}
    with pytest.raises(Exception, match="cycle"):
        apps.start_order(spark, a, n.union(spark.createDataFrame([("base", "top")], n.schema))).collect()


def test_frames_backoff_and_compute(spark):
    df = spark.createDataFrame([(1, b'{"dest": 42}', b"hello"), (2**40, b"", b"")], "request long, header binary, payload binary")
    data = df.select("request", "header", "payload", values.frame(F.lit(1), F.lit(1), F.col("request"), F.col("header"), F.col("payload")).alias("d"))
    for r in data.select("*", values.unframed(F.col("d")).alias("f"), values.unframed(F.expr("substring(d, 1, length(d) - 1)")).alias("short")).collect():
        assert (r.f.version, r.f.kind, r.f.request, r.f.header, r.f.payload, r.short) == (1, "send", r.request, r.header, r.payload, None)
    assert data.first().d[:18] == b"\x01\x01" + (1).to_bytes(8, "big") + (12).to_bytes(4, "big") + (5).to_bytes(4, "big")
    assert [r.ms for r in spark.range(40).select(values.backoff_ms(F.col("id")).alias("ms")).where("ms < 30000").collect()] == [1000, 2000, 4000, 8000, 16000]
    n = spark.createDataFrame([(-1,), (0,), (20,), (92,), (93,)], "n long")
    got = {r.n: (r.result, r.error) for r in apps.computed(n, "n", apps.fibonacci(spark)).collect()}
    assert got == {-1: (None, "n out of range"), 0: (0, None), 20: (6765, None), 92: (7540113804746346429, None), 93: (None, "n out of range")}


def test_message_pack_payloads(spark):
    cases = {
        b"\xc0": "null", b"\xa5hello": '"hello"', b"\x81\xa3key\x2a": '{"key": 42}', b"\xc4\x04\xde\xad\xbe\xef": '"deadbeef"', b"\x92\x01\x91\x02": "[1, [2]]", b"\xff": "-1", b"\xd1\xff\x00": "-256",
        b"\xcf" + b"\xff" * 8: "18446744073709551615", b"\xcb" + bytes.fromhex("3ff8000000000000"): "1.5", b"\x82\x01\xc3\xa1a\xc2": '{"1": true, "a": false}', b"\xd4\x05\x0a": '{"type": 5, "data": "0a"}',
        b"\xd9\x01x": '"x"', b"\xdc\x00\x01\x07": "[7]", b"\xa5hel": None, b"\xc1": None, b"\x01\x01": None, b"": None,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "d binary").select("d", payload.message_json(F.col("d")).alias("j"))
    got = {None if r.d is None else bytes(r.d): r.j for r in df.collect()}
    assert got == cases | {None: None}
    assert df.where("d = x'81a36b65792a'").select(F.try_variant_get(F.parse_json("j"), "$.key", "bigint").alias("n")).first().n == 42
