"""Servers, agents and state machines as ordered folds or windows (batch). sluice.streaming has the stateful forms."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.names import free_names

#: Rows of one key that are folded in one row; a power of two.
CHUNK = 1 << 12


def counter(events: DataFrame, key: str, order: str, value: Column, reset: Column) -> DataFrame:
    """A running sum that a reset row sets back to zero (a reset adds nothing)."""
    w = Window.partitionBy(key).orderBy(order)
    part = events.withColumn("_part", F.sum(reset.cast("long")).over(w))
    own = Window.partitionBy(key, "_part").orderBy(order)
    return part.withColumn("total", F.sum(F.when(reset, 0).otherwise(value)).over(own)).drop("_part")


def agent(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The state of a cell after every update (a running sum)."""
    return events.withColumn("state", F.sum(value).over(Window.partitionBy(key).orderBy(order)))


def agent_calls(events: DataFrame, key: str, order: str, kind: str, value: str) -> DataFrame:
    """What a cell answers: ``get`` its state, ``update`` and ``cast`` nothing (they add value), ``get_and_update`` the
    state before it adds value. The first ``stop`` ends the cell: what follows has the error ``stopped``."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    stopped, held = free_names(events.columns, "stopped", "held")
    adds = F.when(F.col(kind).isin("update", "cast", "get_and_update"), F.col(value))
    told = events.withColumn(stopped, F.coalesce(F.bool_or(F.col(kind) == "stop").over(before), F.lit(False)))
    told = told.withColumn(held, F.coalesce(F.sum(F.when(~F.col(stopped), adds)).over(before), F.lit(0)))
    answer = F.when(~F.col(stopped) & F.col(kind).isin("get", "get_and_update"), F.col(held))
    return told.withColumn("answer", answer).withColumn("error", F.when(F.col(stopped), "stopped")).drop(stopped, held)


def inspected(events: DataFrame, key: str, order: str, kind: str, value: str, suspend: str, resume: str, inspect: str) -> DataFrame:
    """The rows of kind inspect with the server's state (the sum of value over what it has handled). A suspended server
    answers them at once; what waits for its resume isn't in the state."""
    handled, at = free_names(events.columns, "handled_at", "at")
    seen = suspended(events, key, order, kind, suspend, resume).withColumnRenamed("handled_at", handled)
    asks = F.col(kind) == inspect
    placed = seen.withColumn(at, F.when(asks, F.col(order)).otherwise(F.col(handled))).where(F.col(at).isNotNull())
    done = Window.partitionBy(key).orderBy(at, order).rowsBetween(Window.unboundedPreceding, 0)
    state = F.coalesce(F.sum(F.when(~asks, F.col(value))).over(done), F.lit(0))
    return placed.withColumn("state", state).where(asks).drop(handled, at)


def served_order(calls: DataFrame, key: str, tick: str, kind: str, seq: str) -> DataFrame:
    """The order in which a server handles what waits at each tick: continue, system, call, cast, info; then FIFO."""
    rank = F.array_position(F.array(*map(F.lit, ("continue", "system", "call", "cast", "info"))), F.col(kind))
    return calls.withColumn("served", F.row_number().over(Window.partitionBy(key).orderBy(tick, rank, seq)).cast("long"))


def suspended(events: DataFrame, key: str, order: str, kind: str, suspend: str, resume: str) -> DataFrame:
    """handled_at: the order value at which each row is handled, which for rows that arrive while suspended is the next
    resume (null if none comes)."""
    w = Window.partitionBy(key).orderBy(order)
    last = F.max(F.when(F.col(kind).isin(suspend, resume), F.struct(F.col(order), F.col(kind)))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(F.when(F.col(kind) == resume, F.col(order))).over(w.rowsBetween(0, Window.unboundedFollowing))
    off = F.coalesce(last[kind] == suspend, F.lit(False))
    return events.withColumn("handled_at", F.when(off, following).otherwise(F.col(order)))


def machine(events: DataFrame, key: str, order: str, kind: str, table: Mapping[tuple[str, str], str], start: str) -> DataFrame:
    """Final state, number of state changes and of handled events of each key's machine; table: (state, event) to next
    state, other events keep the state.

    Rows are dealt by ranges of key and order and cut into chunks of at most CHUNK rows; a chunk of a key becomes its
    transition map (from each state, the state after it and the changes on the way), and a key's maps are applied in
    order. A key with many rows is split over tasks, and what meets in one row is a chunk, or a map for each chunk."""
    pairs = F.create_map(*[F.lit(x) for (s, e), n in table.items() for x in (f"{s}|{e}", n)])
    states = list(dict.fromkeys([start, *(s for s, _ in table), *table.values()]))
    end = lambda state, changes: F.struct(state.alias("state"), changes.alias("changes"))

    def step(acc: Column, row: Column) -> Column:
        def moved(x: Column) -> Column:
            target = F.coalesce(F.try_element_at(pairs, F.concat_ws("|", x["state"], row["kind"])), x["state"])
            return end(target, x["changes"] + (target != x["state"]).cast("long"))

        return F.transform(acc, moved)

    def apply(acc: Column, chunk: Column) -> Column:
        to = F.element_at(chunk["ends"], F.array_position(F.array(*map(F.lit, states)), acc["state"]).cast("int"))
        return end(to["state"], acc["changes"] + to["changes"])

    dealt = events.select(F.col(key), F.col(order).alias("_order"), F.col(kind).alias("kind")).repartitionByRange(key, "_order", "kind").sortWithinPartitions(key, "_order", "kind")
    numbered = dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_chunk", F.shiftright("_at", CHUNK.bit_length() - 1))
    rows = F.array_sort(F.collect_list(F.struct("_at", "kind")))
    maps = numbered.groupBy(key, "_chunk").agg(F.aggregate(rows, F.array(*[end(F.lit(s), F.lit(0).cast("long")) for s in states]), step).alias("ends"), F.count("*").alias("n"))
    chunks = F.array_sort(F.collect_list(F.struct("_chunk", "ends")))
    return maps.groupBy(key).agg(F.aggregate(chunks, end(F.lit(start), F.lit(0).cast("long")), apply).alias("m"), F.sum("n").alias("handled")).select(key, "m.*", "handled")


def event_timeouts(events: DataFrame, key: str, ts: str, order: str, after: str) -> DataFrame:
    """Times at which an event timer fires: it is set by every row and cancelled by the next row of the key."""
    following = F.lead(ts).over(Window.partitionBy(key).orderBy(ts, order))
    due = F.col(ts) + F.expr(f"interval {after}")
    timed = events.withColumn("fires_at", due).withColumn("_next", following)
    return timed.where(F.col("_next").isNull() | (F.col("_next") > F.col("fires_at"))).drop("_next")


def state_timeouts(changes: DataFrame, key: str, ts: str, order: str, state: str, after: Mapping[str, str]) -> DataFrame:
    """Times at which the timer of a state fires: it belongs to the state entered and ends with it."""
    due = F.coalesce(*[F.when(F.col(state) == s, F.col(ts) + F.expr(f"interval {d}")) for s, d in after.items()])
    left = F.lead(ts).over(Window.partitionBy(key).orderBy(ts, order))
    timed = changes.withColumn("fires_at", due).withColumn("_next", left)
    return timed.where(F.col("fires_at").isNotNull() & (F.col("_next").isNull() | (F.col("_next") > F.col("fires_at")))).drop("_next")


def named_timers(actions: DataFrame, key: str, order: str) -> DataFrame:
    """Timers that are set after all actions (name, kind set/cancel, deadline): the last action on a name counts."""
    last = actions.groupBy(key, "name").agg(F.max_by(F.struct("kind", "deadline"), order).alias("l"))
    return last.where(F.col("l.kind") == "set").select(key, "name", "l.deadline")


def next_deadline(timers: DataFrame, key: str) -> DataFrame:
    return timers.groupBy(key).agg(F.min_by("name", F.struct("deadline", "name")).alias("name"), F.min("deadline").alias("deadline"))


def postponed(events: DataFrame, key: str, order: str, kind: str, postpone: str, change: str) -> DataFrame:
    """replayed_at: the order value of the state change after which each postponed row is handled again, FIFO (null if no
    change comes). States change on rows of kind ``change``, whatever the state."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    following = F.min(F.when(F.col(kind) == change, F.col(order))).over(w)
    return events.withColumn("replayed_at", F.when(F.col(kind) == postpone, following))
