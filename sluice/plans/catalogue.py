"""Registered queries over the driver's tables, each with the SQL that gives the same rows.

Roles: ``events`` are messages (event_id is their order, user_id their key or process, event_type their kind, props their
dynamic payload), ``customer`` is the process table, ``lineitem`` gives children, workers and failures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import values
from sluice.operators import dispatch, groups, machines, membership, ordering, registry, routing, scheduling, supervision
from sluice.plans import apps
from sluice.sources import feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


read = feeds.read_table
#: A given list of consumers: tag, order and demand, one of them without demand.
CONSUMERS = [(101, 1, 300), (102, 2, 500), (103, 3, 0), (104, 4, 1000)]
CONSUMERS_SQL = "(VALUES (101, 1, 300), (102, 2, 500), (103, 3, 0), (104, 4, 1000)) c(tag, ord, demand)"


def consumers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONSUMERS, "tag long, ord int, demand long")


@query(f"""
    WITH spans AS (SELECT tag, sum(demand) OVER (ORDER BY ord) - demand AS lo, sum(demand) OVER (ORDER BY ord) AS hi FROM {CONSUMERS_SQL}),
    e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS pos FROM events WHERE event_type <> 'error')
    SELECT e.event_id, CAST(e.pos AS BIGINT) AS pos, CAST(s.tag AS BIGINT) AS tag FROM e LEFT JOIN spans s ON e.pos > s.lo AND e.pos <= s.hi""")
def demand_dispatch(spark, sf):
    events = feeds.pipeline(read(spark, sf, "events"), lambda e: e.where("event_type <> 'error'"), lambda e: e.select("event_id"))
    return dispatch.by_demand(events, consumers(spark), "event_id").select("event_id", "pos", "tag")


@query(f"SELECT event_id, CAST(tag AS BIGINT) AS tag FROM events, {CONSUMERS_SQL}")
def broadcast_lossless(spark, sf):
    return dispatch.to_all(read(spark, sf, "events").select("event_id"), consumers(spark)).select("event_id", "tag")


@query(f"SELECT event_id, CAST(tag AS BIGINT) AS tag FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM events) e, {CONSUMERS_SQL} WHERE rn <= demand")
def broadcast_lossy(spark, sf):
    return dispatch.to_all(read(spark, sf, "events").select("event_id"), consumers(spark), "event_id", lossless=False).select("event_id", "tag")


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS pos FROM events")
def monotone_ids(spark, sf):
    return ordering.with_position(read(spark, sf, "events").select("event_id", "ts"), "ts", "event_id").select("event_id", "pos")


@query("SELECT event_id, 2 * coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS doubled, 2 * coalesce(TRY_CAST(json_extract_string(props, '$.missing') AS BIGINT), 7) AS fallback FROM events")
def stage_map(spark, sf):
    e = read(spark, sf, "events")
    return e.select("event_id", (2 * values.variant_long(F.col("props"), "$.k")).alias("doubled"), (2 * values.variant_long(F.col("props"), "$.missing", 7)).alias("fallback"))


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 50")
def stage_filter(spark, sf):
    return read(spark, sf, "events").where("event_type = 'purchase' AND value > 50").select("event_id", "user_id", "value")


@query("SELECT l_orderkey, l_partkey, CAST(unnest(range(1, l_linenumber + 1)) AS INTEGER) AS copy FROM lineitem WHERE l_returnflag = 'R'")
def stage_flat_map(spark, sf):
    rows = read(spark, sf, "lineitem").where("l_returnflag = 'R'")
    return rows.select("l_orderkey", "l_partkey", F.explode(F.sequence(F.lit(1), "l_linenumber")).alias("copy"))


@query("SELECT CAST(producer AS INTEGER) AS producer, count(*) AS n FROM (SELECT 0 AS producer FROM events WHERE event_type = 'view' UNION ALL SELECT 1 FROM events WHERE event_type = 'click') GROUP BY producer")
def merge_producers(spark, sf):
    e = read(spark, sf, "events")
    return feeds.merged(e.where("event_type = 'view'"), e.where("event_type = 'click'")).groupBy("producer").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(user_id % 8 AS BIGINT) AS part FROM events")
def partition_mod(spark, sf):
    return dispatch.by_key(read(spark, sf, "events").select("event_id", "user_id"), values.partition_mod(F.col("user_id"), 8), 8).select("event_id", "part")


@query("SELECT event_id, CAST(CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 8 AS BIGINT) AS part FROM events")
def partition_hash(spark, sf):
    return dispatch.by_key(read(spark, sf, "events").select("event_id", "user_id"), values.partition_hash(F.col("user_id"), 8), 8).select("event_id", "part")


def processes(spark, sf):
    return read(spark, sf, "customer").where("c_custkey % 10 <> 3").withColumnRenamed("c_custkey", "pid")


def messages(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_custkey").alias("pid"), "o_orderkey")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 10 <> 3")
def deliver(spark, sf):
    return routing.deliver(messages(spark, sf), processes(spark, sf), "pid").select("o_orderkey", "c_name")


@query("SELECT o_orderkey, o_custkey AS pid FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3)")
def dead_letters(spark, sf):
    return routing.dead_letters(messages(spark, sf), processes(spark, sf), "pid").select("o_orderkey", "pid")


@query("SELECT c_custkey, '<' || n_regionkey || '.' || c_custkey || '>' AS pid, CASE WHEN n_regionkey = 1 THEN 'local' ELSE 'remote' END AS route FROM customer JOIN nation ON c_nationkey = n_nationkey")
def local_remote_split(spark, sf):
    both = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    routed = routing.local_or_remote(both, F.col("n_regionkey"), 1)
    return routed.select("c_custkey", values.pid_text(F.col("n_regionkey"), F.col("c_custkey")).alias("pid"), "route")


@query("SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS pos FROM events")
def mailbox_fifo(spark, sf):
    return dispatch.mailbox(read(spark, sf, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "pos")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 50 AS accepted FROM events")
def mailbox_overflow(spark, sf):
    return dispatch.mailbox(read(spark, sf, "events"), "user_id", "ts", "event_id", capacity=50).select("event_id", "accepted")


ENTRIES = "SELECT 'svc' || (user_id % 20) AS name, event_id AS pid, md5(CAST(event_id AS VARCHAR)) AS tag, epoch_us(ts) // 86400000000 AS timestamp, user_id % 3 AS node_id, event_type, event_id FROM events"


def entries(spark, sf):
    """Names, pids, tags and day-grained times, so that writers tie."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    e = read(spark, sf, "events")
    return e.select(F.concat(F.lit("svc"), (F.col("user_id") % 20).cast("string")).alias("name"), F.col("event_id").alias("pid"), F.md5(F.col("event_id").cast("string").cast("binary")).alias("tag"), day.cast("long").alias("timestamp"), (F.col("user_id") % 3).alias("node_id"), "event_type", "event_id")


@query(f"SELECT name, arg_max(pid, row(timestamp, node_id, tag)) AS pid, arg_max(tag, row(timestamp, node_id, tag)) AS tag FROM ({ENTRIES}) GROUP BY name")
def registry_lookup(spark, sf):
    return registry.winners(entries(spark, sf)).select("name", "pid", "tag").orderBy("name")


@query(f"""
    WITH e AS ({ENTRIES}), live AS (SELECT DISTINCT ON (tag) * FROM (SELECT * FROM e WHERE event_id % 3 > 0 UNION ALL SELECT * FROM e WHERE event_id % 3 < 2) WHERE tag NOT IN (SELECT tag FROM e WHERE event_type = 'error'))
    SELECT name, count(*) AS entries, arg_max(pid, row(timestamp, node_id, tag)) AS pid FROM live GROUP BY name""")
def registry_merge(spark, sf):
    e = entries(spark, sf)
    live = registry.merge(e.where("event_id % 3 > 0"), e.where("event_id % 3 < 2"), e.where("event_type = 'error'"))
    return registry.winners(live).select("name", "pid").join(live.groupBy("name").agg(F.count("*").alias("entries")), "name").select("name", "entries", "pid")


@query(f"WITH e AS ({ENTRIES}) SELECT 'add' AS op, name, tag, pid FROM e WHERE event_type = 'signup' UNION ALL SELECT 'remove', NULL, tag, NULL FROM (SELECT DISTINCT tag FROM e WHERE event_type = 'error' OR name = 'svc7')")
def registry_export(spark, sf):
    e = entries(spark, sf)
    dead = registry.unregister(e, e.where("event_type = 'error'"), "name = 'svc7'")
    return registry.export(e.where("event_type = 'signup'"), dead).select("op", "name", "tag", "pid")


@query("SELECT count(*) AS names FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') a WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 30)")
def unregistered_names(spark, sf):
    e = read(spark, sf, "events").where("event_type = 'signup'").withColumn("name", F.col("user_id"))
    return registry.unregistered_names(e, e.where("value > 30"))


def members(spark, sf, kind):
    e = read(spark, sf, "events").where(F.col("event_type") == kind)
    return e.select((F.col("user_id") % 25).alias("grp"), (F.col("event_id") % 4).alias("pid"))


GRP = "SELECT user_id % 25 AS grp, event_id % 4 AS pid FROM events WHERE event_type = '{}'"


@query(f"SELECT grp, count(*) AS members FROM ({GRP.format('view')} UNION ALL {GRP.format('signup')}) GROUP BY grp")
def group_join(spark, sf):
    return groups.member_counts(groups.join_groups(members(spark, sf, "view"), members(spark, sf, "signup")), "grp")


@query(f"SELECT grp, count(*) AS members FROM ({GRP.format('view')} EXCEPT ALL {GRP.format('error')}) GROUP BY grp")
def group_leave(spark, sf):
    return groups.member_counts(groups.leave_groups(members(spark, sf, "view"), members(spark, sf, "error")), "grp")


@query(f"SELECT grp, pid, count(*) AS failed FROM ({GRP.format('error')} EXCEPT ALL {GRP.format('view')}) GROUP BY grp, pid")
def group_failed_leave(spark, sf):
    return groups.failed_leaves(members(spark, sf, "view"), members(spark, sf, "error")).groupBy("grp", "pid").agg(F.count("*").alias("failed"))


@query("SELECT user_id AS one, event_id % 11 AS other FROM events WHERE event_type IN ('click', 'view') EXCEPT SELECT user_id, event_id % 11 FROM events WHERE event_type = 'purchase'")
def link_sets(spark, sf):
    def pairs(kind):
        return read(spark, sf, "events").where(F.col("event_type") == kind).select(F.col("user_id").alias("one"), (F.col("event_id") % 11).alias("other"))

    return groups.unlink(groups.link(pairs("click"), pairs("view")), pairs("purchase"))


@query("SELECT grp, count(*) AS members FROM (SELECT user_id % 25 AS grp, event_id % 4 AS pid FROM events WHERE event_type = 'view') WHERE pid NOT IN (1, 3) GROUP BY grp")
def remove_processes(spark, sf):
    gone = read(spark, sf, "events").where("event_id % 2 = 1").select((F.col("event_id") % 4).alias("pid"))
    return groups.member_counts(groups.remove_processes(members(spark, sf, "view"), gone, "pid"), "grp")


@query("SELECT n_name, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE n_regionkey = 2")
def group_broadcast(spark, sf):
    sent = read(spark, sf, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("grp"), "n_name")
    return groups.broadcast_to_groups(sent, read(spark, sf, "supplier").select(F.col("s_nationkey").alias("grp"), "s_suppkey"), "grp").select("n_name", "s_suppkey")


@query("SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 3")
def group_local(spark, sf):
    nations = read(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("node_id"))
    return groups.local_members(read(spark, sf, "supplier").join(nations, "s_nationkey"), 3).select("s_suppkey")


@query("WITH w AS (SELECT l_suppkey AS worker, count(*) FILTER (l_linestatus = 'O') AS in_flight, CAST(max(l_quantity) AS BIGINT) AS avg_us, count(*) FILTER (l_returnflag = 'A') AS completed FROM lineitem GROUP BY l_suppkey) SELECT arg_min(worker, row((in_flight + 1) * greatest(avg_us, 1), completed, worker)) AS worker, min((in_flight + 1) * greatest(avg_us, 1)) AS load FROM w")
def pick_worker(spark, sf):
    w = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("worker")).agg(F.count_if(F.col("l_linestatus") == "O").alias("in_flight"), F.max("l_quantity").cast("long").alias("avg_us"), F.count_if(F.col("l_returnflag") == "A").alias("completed"))
    return scheduling.pick_worker(w)


@query("SELECT user_id, count(*) AS completed, list_reduce(list(CAST(round(value * 1000) AS BIGINT) ORDER BY event_id), lambda acc, x: (3 * x + 7 * acc) // 10) AS avg_us FROM events GROUP BY user_id")
def worker_ema(spark, sf):
    e = read(spark, sf, "events").withColumn("us", F.round(F.col("value") * 1000).cast("long"))
    return scheduling.response_average(e, "user_id", "event_id", "us")


@query("SELECT user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END) AS BIGINT) AS in_flight, count(*) FILTER (event_type = 'purchase') AS completed FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id")
def worker_counters(spark, sf):
    e = read(spark, sf, "events").where("event_type IN ('click', 'purchase')")
    return scheduling.counters(e.withColumn("step", F.when(F.col("event_type") == "purchase", -1).otherwise(1)), "user_id")


@query("SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 7")
def worker_capacity(spark, sf):
    return scheduling.within_capacity(read(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", 7)


CHILDREN = "SELECT l_orderkey AS sup, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS idx, l_returnflag, l_linestatus FROM lineitem"


def children(spark, sf):
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return dispatch.mailbox(read(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "sup"), "sup", *order).withColumnRenamed("pos", "idx")


@query(f"""
    WITH c AS ({CHILDREN}), f AS (SELECT sup, idx AS failed, CASE sup % 3 WHEN 0 THEN 'one_for_one' WHEN 1 THEN 'one_for_all' ELSE 'rest_for_one' END AS strategy FROM c WHERE l_returnflag = 'R')
    SELECT c.sup, CAST(failed AS BIGINT) AS failed, strategy, CAST(c.idx AS BIGINT) AS idx FROM c JOIN f ON c.sup = f.sup AND (strategy = 'one_for_all' OR (strategy = 'one_for_one' AND c.idx = failed) OR (strategy = 'rest_for_one' AND c.idx >= failed))""")
def restart_set(spark, sf):
    c = children(spark, sf)
    strategy = F.element_at(F.array(*map(F.lit, ("one_for_one", "one_for_all", "rest_for_one"))), (F.col("sup") % 3 + 1).cast("int"))
    return supervision.restart_set(c.select("sup", "idx"), c.where("l_returnflag = 'R'").select("sup", "idx", strategy.alias("strategy")))


@query("SELECT event_id, CAST(n AS BIGINT) AS recent, n <= 2 AS allowed FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error')")
def restart_intensity(spark, sf):
    e = read(spark, sf, "events").where("event_type = 'error'")
    return supervision.restart_intensity(e, "user_id", "ts", "6 HOURS", 2).select("event_id", "recent", "allowed")


@query("""
    SELECT kind, reason, count(*) AS n, CASE kind WHEN 'permanent' THEN TRUE WHEN 'transient' THEN reason NOT IN ('normal', 'shutdown') ELSE FALSE END AS restart FROM (
        SELECT CASE l_returnflag WHEN 'R' THEN 'permanent' WHEN 'A' THEN 'transient' ELSE 'temporary' END AS kind, CASE l_linenumber % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'shutdown' ELSE 'crash' END AS reason FROM lineitem) GROUP BY ALL""")
def should_restart(spark, sf):
    kind = F.when(F.col("l_returnflag") == "R", "permanent").when(F.col("l_returnflag") == "A", "transient").otherwise("temporary")
    reason = F.when(F.col("l_linenumber") % 3 == 0, "normal").when(F.col("l_linenumber") % 3 == 1, "shutdown").otherwise("crash")
    rows = read(spark, sf, "lineitem").select(kind.alias("kind"), reason.alias("reason"))
    return rows.groupBy("kind", "reason").agg(F.count("*").alias("n")).withColumn("restart", values.should_restart(F.col("kind"), F.col("reason")))


@query("SELECT l_orderkey AS sup, count(*) FILTER (l_linestatus = 'O') AS active, count(*) AS total FROM lineitem GROUP BY l_orderkey")
def child_counts(spark, sf):
    state = F.when(F.col("l_linestatus") == "O", "running").otherwise("stopped")
    return supervision.child_counts(read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sup"), state.alias("state")), "sup")


@query("SELECT event_type AS sup, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS BIGINT) AS stop_at FROM events")
def shutdown_order(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("sup"), "event_id")
    return supervision.stop_order(e, "sup", "event_id")


KIND = "CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'restart' WHEN 'click' THEN 'exit' WHEN 'error' THEN 'terminate' ELSE 'remove' END"


@query(f"SELECT user_id, CASE arg_max({KIND}, event_id) WHEN 'start' THEN 'running' WHEN 'restart' THEN 'running' WHEN 'remove' THEN 'gone' ELSE 'stopped' END AS state, count(*) FILTER (event_type = 'view') AS restarts FROM events GROUP BY user_id")
def child_lifecycle(spark, sf):
    return supervision.lifecycle(read(spark, sf, "events").select("user_id", "event_id", F.expr(KIND).alias("kind")), "user_id", "event_id")


@query("""
    SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, part ORDER BY event_id) AS BIGINT) AS total
    FROM (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS part FROM events)""")
def counter_reset(spark, sf):
    return machines.counter(read(spark, sf, "events"), "user_id", "event_id", F.lit(1), F.col("event_type") == "error").select("event_id", "total")


@query("SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS state FROM events")
def agent_state(spark, sf):
    e = read(spark, sf, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return machines.agent(e, "user_id", "event_id", "cents").select("event_id", "state")


SERVER = "CASE event_type WHEN 'view' THEN 'info' WHEN 'click' THEN 'cast' WHEN 'purchase' THEN 'call' WHEN 'error' THEN 'system' ELSE 'continue' END"


@query(f"SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id // 500, list_position(['continue', 'system', 'call', 'cast', 'info'], {SERVER}), event_id) AS BIGINT) AS served FROM events")
def server_priority(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", F.expr("event_id div 500").alias("tick"), F.expr(SERVER).alias("kind"))
    return machines.served_order(e, "user_id", "tick", "kind", "event_id").select("event_id", "served")


@query("""
    WITH s AS (SELECT *, arg_max(event_type, event_id) FILTER (event_type IN ('error', 'signup')) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last,
        min(event_id) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS following FROM events)
    SELECT event_id, CASE WHEN last = 'error' THEN following ELSE event_id END AS handled_at FROM s""")
def suspend_resume(spark, sf):
    return machines.suspended(read(spark, sf, "events"), "user_id", "event_id", "event_type", "error", "signup").select("event_id", "handled_at")


#: A connection: signup connects, view confirms, error disconnects from either.
CONNECTION = {("off", "signup"): "connecting", ("connecting", "view"): "on", ("connecting", "error"): "off", ("on", "error"): "off"}


@query("""
    SELECT user_id, r.state AS state, CAST(r.changes AS BIGINT) AS changes, CAST(r.handled AS BIGINT) AS handled FROM (
        SELECT user_id, list_reduce(list({'e': event_type, 'state': '', 'changes': 0, 'handled': 0} ORDER BY event_id), lambda acc, x: {
            'e': x.e,
            'state': CASE WHEN acc.state = 'off' AND x.e = 'signup' THEN 'connecting' WHEN acc.state = 'connecting' AND x.e = 'view' THEN 'on' WHEN acc.state IN ('connecting', 'on') AND x.e = 'error' THEN 'off' ELSE acc.state END,
            'changes': acc.changes + CASE WHEN (acc.state = 'off' AND x.e = 'signup') OR (acc.state = 'connecting' AND x.e = 'view') OR (acc.state IN ('connecting', 'on') AND x.e = 'error') THEN 1 ELSE 0 END,
            'handled': acc.handled + 1}, {'e': '', 'state': 'off', 'changes': 0, 'handled': 0}) AS r FROM events GROUP BY user_id)""")
def fsm_fold(spark, sf):
    return machines.machine(read(spark, sf, "events"), "user_id", "event_id", "event_type", CONNECTION, "off")


@query("SELECT event_id, ts + INTERVAL 12 HOURS AS fires_at FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events) WHERE following IS NULL OR following > ts + INTERVAL 12 HOURS")
def event_timeout(spark, sf):
    return machines.event_timeouts(read(spark, sf, "events"), "user_id", "ts", "event_id", "12 HOURS").select("event_id", "fires_at")


@query("""
    SELECT event_id, due AS fires_at FROM (SELECT event_id, ts + CASE event_type WHEN 'signup' THEN INTERVAL 6 HOURS WHEN 'error' THEN INTERVAL 2 HOURS END AS due, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following
    FROM events WHERE event_type IN ('signup', 'view', 'error')) WHERE due IS NOT NULL AND (following IS NULL OR following > due)""")
def state_timeout(spark, sf):
    changes = read(spark, sf, "events").where("event_type IN ('signup', 'view', 'error')")
    return machines.state_timeouts(changes, "user_id", "ts", "event_id", "event_type", {"signup": "6 HOURS", "error": "2 HOURS"}).select("event_id", "fires_at")


TIMERS = "SELECT user_id, 't' || (event_id % 3) AS name, arg_max(event_type, event_id) AS kind, arg_max(ts, event_id) + INTERVAL 1 HOUR AS deadline FROM events GROUP BY ALL"


@query(f"SELECT user_id, arg_min(name, row(deadline, name)) AS name, min(deadline) AS deadline FROM ({TIMERS}) WHERE kind <> 'error' GROUP BY user_id")
def next_timer(spark, sf):
    name = F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string"))
    kind = F.when(F.col("event_type") == "error", "cancel").otherwise("set")
    actions = read(spark, sf, "events").select("user_id", "event_id", name.alias("name"), kind.alias("kind"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("deadline"))
    return machines.next_deadline(machines.named_timers(actions, "user_id", "event_id"), "user_id")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN min(event_id) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS replayed_at FROM events")
def postpone_replay(spark, sf):
    return machines.postponed(read(spark, sf, "events"), "user_id", "event_id", "event_type", "click", "signup").select("event_id", "replayed_at")


@query("""
    WITH p AS (SELECT user_id, ts, event_id, event_type <> 'error' AS ack FROM events), w AS (SELECT *, lag(ack) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before,
        min(ts) FILTER (ack) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ack FROM p)
    SELECT user_id, ts AS suspected_at, ts + INTERVAL 8 HOURS AS dead_at FROM w WHERE NOT ack AND coalesce(before, TRUE) AND (next_ack IS NULL OR next_ack >= ts + INTERVAL 8 HOURS)""")
def failure_detector(spark, sf):
    probes = read(spark, sf, "events").withColumn("ack", F.col("event_type") != "error")
    return membership.failures(probes, "user_id", "ts", "event_id", "8 HOURS")


STATE = "CASE WHEN event_type = 'error' AND value > 95 THEN 'dead' WHEN event_type IN ('error', 'click') THEN 'suspect' ELSE 'alive' END"


@query(f"""
    SELECT user_id, r.state AS state, CAST(r.inc AS BIGINT) AS incarnation FROM (SELECT user_id, list_reduce(list({{'state': {STATE}, 'inc': event_id % 17}} ORDER BY event_id), lambda acc, u:
        CASE WHEN acc.state = 'dead' THEN acc WHEN u.state = 'alive' AND u.inc <= acc.inc THEN acc WHEN u.state = 'suspect' AND u.inc < acc.inc THEN acc ELSE {{'state': u.state, 'inc': greatest(u.inc, acc.inc)}} END,
        {{'state': 'alive', 'inc': CAST(-1 AS BIGINT)}}) AS r FROM events GROUP BY user_id)""")
def incarnation_merge(spark, sf):
    u = read(spark, sf, "events").select("user_id", "event_id", F.expr(STATE).alias("state"), (F.col("event_id") % 17).alias("incarnation"))
    return membership.incarnations(u, "user_id", "event_id")


LAST = f"SELECT user_id AS node_id, arg_max({STATE}, event_id) AS state FROM events GROUP BY user_id"


def last_state(spark, sf):
    return read(spark, sf, "events").groupBy(F.col("user_id").alias("node_id")).agg(F.max_by(F.expr(STATE), "event_id").alias("state"))


@query(f"SELECT node_id, state FROM ({LAST}) WHERE node_id <> 5 AND state <> 'dead'")
def probe_targets(spark, sf):
    return membership.probe_targets(last_state(spark, sf), 5)


@query()
def random_alive_member(spark, sf):
    return membership.random_alive(last_state(spark, sf), 5, seed=3)


@query("""
    SELECT c.event_id, min(r.ts) FILTER (r.ts >= c.ts AND r.ts <= c.ts + INTERVAL 1 DAY) AS reply_at, min(r.ts) FILTER (r.ts >= c.ts AND r.ts <= c.ts + INTERVAL 1 DAY) IS NULL AS timed_out
    FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') c LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'purchase') r ON c.user_id = r.user_id GROUP BY c.event_id""")
def reply_timeout(spark, sf):
    e = read(spark, sf, "events")
    calls = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return routing.replies(calls, e.where("event_type = 'purchase'"), "user_id", "1 DAY").select("event_id", "reply_at", "timed_out")


@query("SELECT CAST(i AS BIGINT) AS tick, TIMESTAMP '2024-01-01 00:00:00' + i * INTERVAL 7 MINUTES AS at FROM range(1, 206) t(i)")
def interval_source(spark, sf):
    return feeds.interval(spark, "2024-01-01 00:00:00", "2024-01-01 23:55:00", "7 minutes")


@query("SELECT event_id, ts + INTERVAL 90 SECONDS AS due_at FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'")
def delayed_send(spark, sf):
    e = feeds.until_cancelled(read(spark, sf, "events"), "ts", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return feeds.delayed(e, "ts", "90 seconds").select("event_id", "due_at")


@query("SELECT CAST(i AS BIGINT) AS attempt, CAST(least(1000 * (1::BIGINT << least(i, 30)), 30000) AS BIGINT) AS ms FROM range(0, 70) t(i)")
def backoff(spark, sf):
    return spark.range(70).select(F.col("id").alias("attempt"), values.backoff_ms(F.col("id")).alias("ms"))


@query("WITH RECURSIVE f(n, a, b) AS (SELECT 0::BIGINT, 0::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, b, CASE WHEN n < 91 THEN a + b ELSE b END FROM f WHERE n < 92) SELECT n, a AS result FROM f")
def fib(spark, sf):
    return apps.fibonacci(spark)


@query("WITH RECURSIVE f(n, a, b) AS (SELECT 0::BIGINT, 0::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, b, CASE WHEN n < 91 THEN a + b ELSE b END FROM f WHERE n < 92) SELECT event_id, a AS result, CASE WHEN a IS NULL THEN 'n out of range' END AS error FROM events LEFT JOIN f ON event_id % 120 - 10 = n")
def compute_guard(spark, sf):
    requests = read(spark, sf, "events").select("event_id", (F.col("event_id") % 120 - 10).alias("n"))
    return apps.computed(requests, "n", apps.fibonacci(spark)).select("event_id", "result", "error")


#: A given graph: each app and what it needs.
NEEDS = [("left", "base"), ("right", "base"), ("top", "left"), ("top", "right"), ("web", "top"), ("web", "log")]
APPS = ["base", "left", "right", "top", "web", "log"]


@query("""
    WITH RECURSIVE need(app, dep) AS (VALUES ('left', 'base'), ('right', 'base'), ('top', 'left'), ('top', 'right'), ('web', 'top'), ('web', 'log')),
    app(a) AS (VALUES ('base'), ('left'), ('right'), ('top'), ('web'), ('log')), walk(app, depth) AS (SELECT a, 0 FROM app UNION ALL SELECT n.app, w.depth + 1 FROM walk w JOIN need n ON n.dep = w.app)
    SELECT app, CAST(max(depth) AS BIGINT) AS depth FROM walk GROUP BY app""")
def start_order(spark, sf):
    return apps.start_order(spark, spark.createDataFrame([(a,) for a in APPS], "app string"), spark.createDataFrame(NEEDS, "app string, dep string"))


@query("SELECT p_partkey AS app, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE 'none' END AS value FROM part")
def app_env(spark, sf):
    env = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("brand"), "p_brand")).otherwise(F.create_map(F.lit("size"), F.col("p_size").cast("string")))
    return apps.settings(read(spark, sf, "part").select(F.col("p_partkey").alias("app"), env.alias("env")), "app", "brand", "none")


@query("SELECT o_orderkey AS seq, CASE WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_totalprice > 200000 THEN 'timeout' END AS error, CASE WHEN o_orderstatus <> 'P' AND o_totalprice <= 200000 THEN o_orderkey * 2 END AS result FROM orders")
def async_map(spark, sf):
    o = read(spark, sf, "orders")
    return scheduling.map_tasks(o, "o_orderkey", F.col("o_orderkey") * 2, F.col("o_orderstatus") == "P", F.col("o_totalprice"), 200_000).select("seq", "error", "result").orderBy("seq")


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 8")
def gossip_drain(spark, sf):
    return membership.gossip_batch(read(spark, sf, "events").select("event_id", "event_type"), "event_id")


@query("SELECT user_id, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS stopped, CAST(count(*) FILTER (event_type <> 'error') AS BIGINT) AS drained, max(CAST(round(value * 100) AS BIGINT)) AS longest_ms, bool_or(value > 99) AS timed_out FROM events GROUP BY user_id")
def drain_stats(spark, sf):
    off = (F.col("event_type") == "error").cast("long")
    phases = read(spark, sf, "events").select("user_id", off.alias("stopped"), (1 - off).alias("drained"), F.round(F.col("value") * 100).cast("long").alias("ms"), (F.col("value") > 99).alias("timed_out"))
    return scheduling.drain_stats(phases, "user_id")


@query("SELECT event_type, round(quantile_cont(c, 0.5), 3) AS p50, round(quantile_cont(c, 0.95), 3) AS p95, round(quantile_cont(c, 0.99), 3) AS p99, round(quantile_cont(c, 0.999), 3) AS p999, count(*) AS n FROM (SELECT event_type, round(value * 100) AS c FROM events) GROUP BY event_type")
def latency_percentiles(spark, sf):
    return scheduling.percentiles(read(spark, sf, "events").select("event_type", F.round(F.col("value") * 100).alias("c")), "event_type", "c")


@query("""
    SELECT user_id, r.o AS event_id, CAST(r.asked AS BIGINT) AS asked FROM (SELECT user_id, unnest(list_filter(folds, lambda f: f.asked > 0)) AS r FROM (
        SELECT user_id, list_transform(range(1, len(l) + 1), lambda i: list_reduce(l[1:i], lambda acc, x: {'o': x.o, 'n': CASE WHEN acc.n + x.n >= 12 THEN 0 ELSE acc.n + x.n END, 'asked': CASE WHEN acc.n + x.n >= 12 THEN acc.n + x.n ELSE 0 END}, {'o': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'asked': CAST(0 AS BIGINT)})) AS folds
        FROM (SELECT user_id, list({'o': event_id, 'n': event_id % 7, 'asked': CAST(0 AS BIGINT)} ORDER BY event_id) AS l FROM events GROUP BY user_id)))""")
def reask_points(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 7).alias("size"))
    return dispatch.reask_points(e, "user_id", "event_id", "size", 12)


FRAME_BYTES = "unhex('0101' || lpad(hex(event_id), 16, '0') || lpad(hex(octet_length(encode(event_type))), 8, '0') || lpad(hex(octet_length(encode(props))), 8, '0') || hex(encode(event_type)) || hex(encode(props)))"


@query(f"SELECT event_id, sha256({FRAME_BYTES}) AS fingerprint, 'send' AS kind, event_id AS request, event_type AS header, props AS payload FROM events")
def frame_roundtrip(spark, sf):
    e = read(spark, sf, "events")
    data = values.frame(F.lit(1), F.lit(1), F.col("event_id"), F.col("event_type").cast("binary"), F.col("props").cast("binary"))
    back = e.select("event_id", data.alias("data")).select("event_id", values.fingerprint(F.col("data")).alias("fingerprint"), values.unframed(F.col("data")).alias("f"))
    return back.select("event_id", "fingerprint", F.col("f.kind").alias("kind"), F.col("f.request").alias("request"), F.col("f.header").cast("string").alias("header"), F.col("f.payload").cast("string").alias("payload"))


@query("SELECT user_id % 25 AS grp, count(DISTINCT event_id % 4) AS processes, count(*) AS memberships FROM events WHERE event_type = 'view' GROUP BY 1")
def group_listing(spark, sf):
    return groups.listing(members(spark, sf, "view"), "grp", "pid")


PHASE = "CASE event_type WHEN 'view' THEN 'announce' WHEN 'click' THEN 'drain' WHEN 'error' THEN 'stop' END"


@query(f"""
    WITH t AS (SELECT user_id, {PHASE} AS phase, CAST(round(value * 100) AS BIGINT) AS ms, CASE event_type WHEN 'view' THEN 5000 WHEN 'click' THEN 8000 WHEN 'error' THEN 3000 END AS most FROM events WHERE event_type IN ('view', 'click', 'error'))
    SELECT user_id, phase, count(*) FILTER (ms <= most) AS drained, count(*) FILTER (ms > most) AS stopped, CAST(max(least(ms, most)) AS BIGINT) AS ms, bool_or(ms > most) AS timed_out FROM t GROUP BY user_id, phase""")
def drain_phases(spark, sf):
    t = read(spark, sf, "events").select("user_id", F.expr(PHASE).alias("phase"), F.round(F.col("value") * 100).cast("long").alias("took"))
    return scheduling.drain_phases(t, "user_id", "phase", "took", {"announce": 5000, "drain": 8000, "stop": 3000})


@query("""
    SELECT o_orderkey AS seq, CASE WHEN o_custkey % 10 <> 3 THEN o_custkey WHEN (o_custkey + 1) % 10 <> 3 AND (o_custkey + 1) IN (SELECT c_custkey FROM customer) THEN o_custkey + 1 END AS worker,
        CASE WHEN o_custkey % 10 = 3 AND (o_custkey + 1) NOT IN (SELECT c_custkey FROM customer) THEN 'no worker' END AS error FROM orders""")
def task_retry(spark, sf):
    tasks = read(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.array(F.col("o_custkey"), F.col("o_custkey") + 1).alias("tries"))
    workers = read(spark, sf, "customer").select(F.col("c_custkey").alias("worker"), (F.col("c_custkey") % 10 != 3).alias("alive"))
    return scheduling.assigned(tasks, workers)


@query(f"WITH w AS (SELECT name, arg_max(pid, row(timestamp, node_id, tag)) AS pid FROM ({ENTRIES}) GROUP BY name) SELECT event_id, pid, CASE WHEN pid IS NULL THEN 'unknown name' END AS error FROM events LEFT JOIN w ON w.name = 'svc' || (event_id % 25)")
def send_named(spark, sf):
    sent = read(spark, sf, "events").select("event_id", F.concat(F.lit("svc"), (F.col("event_id") % 25).cast("string")).alias("name"))
    return routing.send_named(sent, registry.winners(entries(spark, sf)).select("name", "pid")).select("event_id", "pid", "error")


@query("""
    WITH RECURSIVE need(app, dep) AS (VALUES ('left', 'base'), ('right', 'base'), ('top', 'left'), ('top', 'right'), ('web', 'top'), ('web', 'log')),
    app(a) AS (VALUES ('base'), ('left'), ('right'), ('top'), ('web'), ('log')), walk(app, depth) AS (SELECT a, 0 FROM app UNION ALL SELECT n.app, w.depth + 1 FROM walk w JOIN need n ON n.dep = w.app)
    SELECT app, CAST(-max(depth) AS BIGINT) AS rank FROM walk GROUP BY app""")
def app_stop_order(spark, sf):
    return apps.stop_order(start_order(spark, sf))


def part_env(spark, sf):
    env = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type")).otherwise(F.create_map(F.lit("size"), F.col("p_size").cast("string")))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("app"), env.alias("env"))


@query("SELECT p_partkey AS app, CASE WHEN p_size % 3 = 0 THEN p_brand END AS value, CASE WHEN p_size % 3 <> 0 THEN 'missing' END AS error FROM part")
def app_env_fetch(spark, sf):
    return apps.fetched(part_env(spark, sf), "app", "brand")


@query("""
    SELECT p_partkey AS app, 'brand' AS key, 'Other' AS value FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'brand', p_brand FROM part WHERE p_partkey % 2 = 1 AND p_size % 3 = 0
    UNION ALL SELECT p_partkey, 'type', p_type FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part WHERE p_size % 3 <> 0 AND p_partkey % 2 = 1""")
def app_env_changes(spark, sf):
    """Put a brand twice and delete the size of every second part, then list all settings."""
    rows = read(spark, sf, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("app"))
    changes = F.inline(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("key"), F.lit(v).alias("value")) for i, (k, v) in enumerate([("brand", "First"), ("size", None), ("brand", "Other")])]))
    return apps.all_settings(apps.put(part_env(spark, sf), "app", rows.select("app", changes)), "app")


CHANGE = "CASE event_type WHEN 'signup' THEN 'register' WHEN 'view' THEN 'register' WHEN 'error' THEN 'unregister' END"


@query(f"SELECT user_id, arg_max(event_id, event_id) AS registered, count(*) OVER () AS workers FROM (SELECT user_id, arg_max({CHANGE}, event_id) AS kind, max(event_id) AS event_id FROM events WHERE event_type IN ('signup', 'view', 'error') GROUP BY user_id) WHERE kind = 'register' GROUP BY user_id")
def worker_registry(spark, sf):
    """The list of registered workers, with their number."""
    listed = scheduling.registered(read(spark, sf, "events").withColumn("kind", F.expr(CHANGE)), "user_id", "event_id", "kind")
    return listed.withColumn("workers", listed.agg(F.count("*")).scalar())


@query(f"SELECT count(*) FILTER (state = 'alive') AS alive FROM ({LAST})")
def alive_count(spark, sf):
    return membership.alive_count(last_state(spark, sf))


@query("SELECT count(*) AS processes FROM customer WHERE c_custkey % 10 <> 3")
def process_count(spark, sf):
    return routing.process_count(processes(spark, sf))


@query(f"WITH s AS (SELECT tag, demand, coalesce(sum(demand) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM {CONSUMERS_SQL}), e AS (SELECT count(*) AS n FROM events WHERE event_type = 'error') SELECT CAST(tag AS BIGINT) AS tag, CAST(demand - least(demand, greatest(n - lo, 0)) AS BIGINT) AS pending FROM s, e")
def pending_demand(spark, sf):
    asked = consumers(spark)
    dealt = dispatch.by_demand(read(spark, sf, "events").where("event_type = 'error'").select("event_id"), asked, "event_id")
    return dispatch.pending_demand(asked, dealt)


@query("SELECT count(*) AS kept FROM events WHERE event_type = 'error'")
def broadcast_leftover(spark, sf):
    """No consumer has demand, so the producer keeps all."""
    return dispatch.kept_by_producer(read(spark, sf, "events").where("event_type = 'error'"), consumers(spark).withColumn("demand", F.lit(0))).agg(F.count("*").alias("kept"))


@query(SQL["failure_detector"].replace("SELECT user_id, ts AS suspected_at, ts + INTERVAL 8 HOURS AS dead_at", "SELECT user_id, ts + INTERVAL 8 HOURS AS dead_at, ts + INTERVAL 8 HOURS + INTERVAL 30 HOURS AS removed_at") + " AND ts + INTERVAL 38 HOURS <= TIMESTAMP '2024-01-20 00:00:00'")
def dead_removal(spark, sf):
    return membership.removals(failure_detector(spark, sf), "2024-01-20 00:00:00", "30 HOURS").select("user_id", "dead_at", "removed_at")


AGENT = "CASE event_type WHEN 'view' THEN 'get' WHEN 'click' THEN 'update' WHEN 'purchase' THEN 'get_and_update' WHEN 'signup' THEN 'cast' ELSE CASE WHEN event_id % 7 = 0 THEN 'stop' ELSE 'get' END END"


@query(f"""
    WITH a AS (SELECT event_id, user_id, {AGENT} AS kind, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
    s AS (SELECT *, coalesce(bool_or(kind = 'stop') OVER w, FALSE) AS over FROM a WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    h AS (SELECT *, coalesce(sum(CASE WHEN NOT over AND kind IN ('update', 'cast', 'get_and_update') THEN cents END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM s)
    SELECT event_id, CASE WHEN NOT over AND kind IN ('get', 'get_and_update') THEN CAST(held AS BIGINT) END AS answer, CASE WHEN over THEN 'stopped' END AS error FROM h""")
def agent_calls(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", F.expr(AGENT).alias("kind"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return machines.agent_calls(e, "user_id", "event_id", "kind", "cents").select("event_id", "answer", "error")


@query(f"""
    WITH s AS ({SQL["suspend_resume"].replace("SELECT *, arg_max(event_type", "SELECT events.*, arg_max(event_type").replace("SELECT event_id, CASE WHEN", "SELECT event_id, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents, CASE WHEN")}),
    p AS (SELECT *, CASE WHEN event_type = 'view' THEN event_id ELSE handled_at END AS place FROM s)
    SELECT event_id, CAST(state AS BIGINT) AS state FROM (SELECT *, coalesce(sum(CASE WHEN event_type <> 'view' THEN cents END) OVER (PARTITION BY user_id ORDER BY place, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state FROM p WHERE place IS NOT NULL) WHERE event_type = 'view'""")
def inspect_suspended(spark, sf):
    e = read(spark, sf, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return machines.inspected(e, "user_id", "event_id", "event_type", "cents", "error", "signup", "view").select("event_id", "state")


@query("SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS sent_ms, CASE WHEN event_id % 300 = 0 THEN '0.250ms' WHEN event_id % 300 < 100 THEN (event_id % 300) || '.25ms' ELSE (event_id % 300) || 'ms' END AS took, coalesce(json_extract_string(props, '$.missing'), 'none') AS label FROM events")
def clock_and_text(spark, sf):
    e = read(spark, sf, "events")
    return e.select("event_id", values.clock_ms(F.col("ts")).alias("sent_ms"), values.ms_text(F.col("event_id") % 300 + F.lit(0.25)).alias("took"), values.variant_text(F.col("props"), "$.missing", "none").alias("label"))


@query("SELECT event_id, CAST(0 AS BIGINT) AS sender_process, CAST(7 AS BIGINT) AS sender_node FROM events WHERE event_type = 'signup'")
def external_injection(spark, sf):
    sent = feeds.injected(read(spark, sf, "events").where("event_type = 'signup'"), 7)
    return sent.select("event_id", F.col("sender.local_id").alias("sender_process"), F.col("sender.node_id").alias("sender_node"))


@query("SELECT event_id, route, CASE WHEN route = 'none' THEN 'no route' END AS error FROM (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'local' WHEN user_id % 3 = 1 THEN 'remote' ELSE 'none' END AS route FROM events)")
def router_plugin(spark, sf):
    router = lambda m: m.withColumn("route", F.when(F.col("user_id") % 3 == 0, "local").when(F.col("user_id") % 3 == 1, "remote").otherwise("none"))
    keep = lambda m: m
    return routing.routed(read(spark, sf, "events"), router, {"local": keep, "remote": keep}).select("event_id", "route", "error")


@query(SQL["demand_dispatch"] + " WHERE s.tag IS NOT NULL")
def dispatcher_plugin(spark, sf):
    events = read(spark, sf, "events").where("event_type <> 'error'").select("event_id")
    given, _ = dispatch.dispatched(events, consumers(spark), lambda e, c: dispatch.by_demand(e, c, "event_id"))
    return given.select("event_id", "pos", "tag")
