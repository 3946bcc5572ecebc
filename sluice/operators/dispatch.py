"""Dispatch of ordered events to consumers: by demand, to all, by key; takes, capacities and re-ask points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.names import free_names
from sluice.operators.folds import fold
from sluice.operators.ordering import carried, running_total, with_position

#: A strategy that gives events (a total order is its own matter) a consumer's tag, null for what the producer keeps.
Dispatcher = Callable[[DataFrame, DataFrame], DataFrame]
#: Events in a block of a lossy broadcast, and how many a bounded take sorts by keeping the best of each task.
BLOCK, TAKE = 1 << 10, 100_000


def dispatched(events: DataFrame, consumers: DataFrame, dispatcher: Dispatcher) -> tuple[DataFrame, DataFrame]:
    """What a dispatcher delivers, and what it leaves with the producer."""
    dealt = dispatcher(events, consumers)
    if "tag" not in dealt.columns:
        raise ValueError("a dispatcher names each event's consumer in tag")
    return dealt.where("tag IS NOT NULL"), dealt.where("tag IS NULL").drop("tag")


def by_demand(events: DataFrame, consumers: DataFrame, order: str) -> DataFrame:
    """Each consumer (tag, ord, demand), in ord order, takes as many of the next events as it asked for. Every event
    appears once, with pos and tag; events beyond all demand have a null tag (the producer keeps them). Positions and
    spans of demand meet in ranges of their common order: no event is compared with more than one span."""
    (event, span, place) = free_names([*events.columns, "pos"], "event", "span", "place")
    spans = running_total(consumers.where("demand > 0").select("tag", "ord", "demand"), "demand", "ord", "tag", name="hi")
    marks = spans.select((F.col("hi") - F.col("demand") + 1).alias(place), F.struct("tag", "hi").alias(span))
    placed = with_position(events, order)
    rows = placed.select(F.col("pos").alias(place), F.struct("*").alias(event)).unionByName(marks, allowMissingColumns=True)
    met = carried(rows, span, place, F.col(event).isNotNull()).where(F.col(event).isNotNull())
    return met.select(f"{event}.*", F.when(F.col(place) <= F.col(span)["hi"], F.col(span)["tag"]).alias("tag"))


def pending_demand(consumers: DataFrame, dealt: DataFrame) -> DataFrame:
    """What each consumer (tag, demand) still waits for after by_demand's result."""
    taken = dealt.where("tag IS NOT NULL").groupBy("tag").agg(F.count("*").alias("taken"))
    return consumers.join(taken, "tag", "left").select("tag", (F.col("demand") - F.coalesce("taken", F.lit(0))).alias("pending"))


def to_all(events: DataFrame, consumers: DataFrame, order: str | None = None, lossless: bool = True) -> DataFrame:
    """Every event to every consumer. lossless=False gives each only the first ``demand`` events in order; what is
    beyond a consumer's demand is dropped and a consumer without demand gets nothing. Where no consumer has demand the
    producer keeps all events: see kept_by_producer."""
    if lossless:
        return events.withColumn("tag", F.explode(tags_of(consumers)))
    most = consumers.agg(F.coalesce(F.max("demand"), F.lit(0))).first()[0]
    block, want = free_names([*events.columns, "pos", "tag"], "block", "want")
    placed = with_position(first_in_order(events, order, most) if most <= TAKE else events, order).withColumn(block, F.expr(f"(pos - 1) div {BLOCK}"))
    asked = consumers.where("demand > 0").select("tag", F.col("demand").alias(want), F.explode(F.expr(f"sequence(0L, (demand - 1) div {BLOCK})")).alias(block))
    return placed.join(asked, block).where(F.col("pos") <= F.col(want)).drop(block, want)


def tags_of(consumers: DataFrame) -> Column:
    """The consumers' tags as one value (consumers are a given list, which the plan holds)."""
    return consumers.select("tag").coalesce(1).agg(F.collect_list("tag")).scalar()


def kept_by_producer(events: DataFrame, consumers: DataFrame) -> DataFrame:
    """The events that a lossy broadcast leaves with the producer: all if no consumer has demand, else none."""
    asked = consumers.agg(F.coalesce(F.bool_or(F.col("demand") > 0), F.lit(False))).scalar()
    return events.where(~asked)


def by_key(events: DataFrame, part: Column, n: int) -> DataFrame:
    """Rows dealt to n partitions by a partition number, which stays in ``part``."""
    return events.withColumn("part", part).repartition(n, "part")


def first_in_order(events: DataFrame, order: str, most: int) -> DataFrame:
    """The first ``most`` rows in order (a bounded take)."""
    return events.orderBy(order).limit(most)


def mailbox(events: DataFrame, dest: str, *order: str, capacity: int | None = None) -> DataFrame:
    """FIFO position of every row in its destination's mailbox; with a capacity, ``accepted`` says whether it fits."""
    out = events.withColumn("pos", F.row_number().over(Window.partitionBy(dest).orderBy(*order)).cast("long"))
    return out if capacity is None else out.withColumn("accepted", F.col("pos") <= capacity)


def reask_points(batches: DataFrame, key: str, order: str, size: str, least: int) -> DataFrame:
    """Where a consumer asks again: once the rows received since the last ask reach ``least``, for that many. Returns key,
    order and asked."""

    def step(held: int | None, at: int, n: int | None) -> tuple[int, tuple | None]:
        held = (held or 0) + (n or 0)
        return (0, (at, held)) if held >= least else (held, None)

    return fold(batches.withColumn(size, F.col(size).cast("long")), key, order, size, step, f"{order} long, asked long")


def check_demand(most: int, least: int) -> tuple[int, int]:
    """A consumer's largest and smallest demand; a smallest above the largest would stall it."""
    if not 0 < least <= most:
        raise ValueError(f"demand {least} to {most}")
    return most, least
