"""Structured Streaming forms of the stateful operators, on transformWithState (needs the RocksDB state store).

Each takes a streaming DataFrame with a watermark on its timestamp where it uses event time, and returns the stream of
results. Within a micro-batch a key's rows are taken in event order; across batches, in order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_order(batches: Iterator[pd.DataFrame], order: str) -> Iterator:
    """A key's rows of one micro-batch in order; a micro-batch's share of a key is bounded by the source's rate."""
    parts = [b for b in batches if len(b)]
    if parts:
        yield from pd.concat(parts).sort_values(order, kind="stable").itertuples(index=False)


class Machine(StatefulProcessor):
    """A state machine: transitions (state, event) to state; postponed events wait in a list and are replayed, first come
    first served, after the next change of state; a state's timer belongs to the state entered and ends with it;
    entering a state of ``internal`` appends that event to what is waiting to be handled."""

    def __init__(self, transitions: Mapping[tuple[str, str], str], start: str, postponed: frozenset = frozenset(), timeouts_ms: Mapping[str, tuple[int, str]] | None = None, internal: Mapping[str, str] | None = None) -> None:
        self.transitions, self.start, self.postponed = dict(transitions), start, frozenset(postponed)
        self.timeouts, self.internal = dict(timeouts_ms or {}), dict(internal or {})

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cell = handle.getValueState("cell", "state string, changes long, handled long, deadline long")
        self.waiting = handle.getListState("waiting", "kind string")

    def read(self) -> tuple[str, int, int, int]:
        return tuple(self.cell.get()) if self.cell.exists() else (self.start, 0, 0, 0)

    def enter(self, cell: tuple, target: str, now_ms: int) -> tuple[str, int, int, int]:
        state, changes, handled, deadline = cell
        if deadline:
            self.handle.deleteTimer(deadline)
            deadline = 0
        if target in self.timeouts:
            deadline = now_ms + self.timeouts[target][0]
            self.handle.registerTimer(deadline)
        return target, changes + 1, handled, deadline

    def take(self, cell: tuple, kind: str, now_ms: int) -> tuple:
        """One event, and after a change of state those that waited; a replayed event may wait again."""
        queue = [kind]
        while queue:
            kind = queue.pop(0)
            target = self.transitions.get((cell[0], kind))
            if target is None and kind in self.postponed:
                self.waiting.appendValue((kind,))
                continue
            cell = (cell[0], cell[1], cell[2] + 1, cell[3])
            if target is not None and target != cell[0]:
                cell = self.enter(cell, target, now_ms)
                queue = [k for (k,) in self.waiting.get()] + queue + ([self.internal[target]] if target in self.internal else [])
                self.waiting.clear()
        return cell

    def rows(self, key: tuple, cell: tuple) -> Iterator[pd.DataFrame]:
        self.cell.update(cell)
        yield pd.DataFrame({"key": [key[0]], "state": [cell[0]], "changes": [cell[1]], "handled": [cell[2]]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cell = self.read()
        for r in in_order(rows, "seq"):
            cell = self.take(cell, r.kind, pd.Timestamp(r.ts).value // 1_000_000)
        yield from self.rows(key, cell)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cell = self.read()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if cell[3] == at and cell[0] in self.timeouts:
            cell = (cell[0], cell[1], cell[2], 0)
            cell = self.take(cell, self.timeouts[cell[0]][1], at)
        yield from self.rows(key, cell)

    def close(self) -> None:
        pass


class Detector(StatefulProcessor):
    """Failure detection: the first nack starts a suspicion, an ack ends it, and a suspicion of ``timeout`` is a death,
    reported once by an event-time timer."""

    def __init__(self, timeout: timedelta) -> None:
        self.timeout_ms = int(timeout.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.suspected = handle.getValueState("suspected", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = self.suspected.get()[0] if self.suspected.exists() else 0
        dead: list[int] = []
        for r in in_order(rows, "ts"):
            now = pd.Timestamp(r.ts).value // 1_000_000
            if at > 0 and now >= at + self.timeout_ms:
                self.handle.deleteTimer(at + self.timeout_ms)
                dead.append(at)
                at = 0 if r.ack else -1  # dead: a further nack starts nothing until an ack comes
            if r.ack:
                if at > 0:
                    self.handle.deleteTimer(at + self.timeout_ms)
                at = 0
            elif at == 0:
                at = now
                self.handle.registerTimer(at + self.timeout_ms)
        self.suspected.update((at,))
        yield self.deaths(key, dead)

    def deaths(self, key: tuple, at: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([key[0]] * len(at), dtype="int64"), "suspected_ms": pd.Series(at, dtype="int64"), "dead_ms": pd.Series([a + self.timeout_ms for a in at], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.suspected.get()[0] if self.suspected.exists() else 0
        if at > 0 and at + self.timeout_ms == expiredTimerInfo.getExpiryTimeInMs():
            self.suspected.update((-1,))
            yield self.deaths(key, [at])
        else:
            yield self.deaths(key, [])

    def close(self) -> None:
        pass


class Cell(StatefulProcessor):
    """An agent: a number that updates add to; emits it after every update."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.total.get()[0] if self.total.exists() else 0
        seqs, states = [], []
        for r in in_order(rows, "seq"):
            n += int(r.value)
            seqs.append(r.seq)
            states.append(n)
        self.total.update((n,))
        yield pd.DataFrame({"key": [key[0]] * len(seqs), "seq": seqs, "state": states})

    def close(self) -> None:
        pass


def machine(events: DataFrame, transitions: Mapping[tuple[str, str], str], start: str, **options) -> DataFrame:
    """events: key long, seq long, kind string, ts timestamp. Emits each key's state after every batch and timer."""
    mode = "EventTime" if options.get("timeouts_ms") else "None"
    return events.groupBy("key").transformWithStateInPandas(Machine(transitions, start, **options), "key long, state string, changes long, handled long", "Update", mode)


def detector(probes: DataFrame, timeout: timedelta) -> DataFrame:
    """probes: key long, ts timestamp (with a watermark), ack boolean. Emits (key, suspected_ms, dead_ms)."""
    return probes.groupBy("key").transformWithStateInPandas(Detector(timeout), "key long, suspected_ms long, dead_ms long", "Append", "EventTime")


def agent(updates: DataFrame) -> DataFrame:
    """updates: key long, seq long, value long. Emits (key, seq, state)."""
    return updates.groupBy("key").transformWithStateInPandas(Cell(), "key long, seq long, state long", "Append", "None")
