"""Event-time order for keyed state machines: rows that arrive out of order, over micro-batches, are worked through in order.

Rows wait in list state until the watermark has passed them; an event-time timer then
hands them to the machine, sorted. A machine can set a deadline of its own, which fires
between events as they would have come.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .limits import LADDER, PROMOTE_AFTER


class Machine:
    """State machine of one key. Times are microseconds.

    state: DDL of its state, a tuple that begins as `start`; payload: DDL of what a row
    brings besides its time; out: DDL of what it emits, without the key.
    """

    state: str
    start: tuple
    payload: str
    out: str

    def step(self, state: tuple, at: int, payload: tuple) -> tuple[tuple, list[tuple]]:
        """The state after a row, and what is emitted."""
        raise NotImplementedError

    def deadline(self, state: tuple) -> int | None:
        """When expire() is due if no row comes before."""
        return None

    def expire(self, state: tuple, at: int) -> tuple[tuple, list[tuple]]:
        return state, []


_KINDS = {"long": int, "int": int, "boolean": bool, "string": str, "double": float}


def names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


@dataclass
class Throttle(Machine):
    """Emits a row only if the last one emitted is `gap` old or older."""

    gap: int
    state, start, payload, out = "last long", (None,), "event_id long", "event_id long"

    def step(self, state, at, payload):
        if state[0] is not None and at - state[0] < self.gap:
            return state, []
        return (at,), [payload]


@dataclass
class HostPolicy(Machine):
    """The scan strategy of a host: a rung up after PROMOTE_AFTER failed scans in a row, unless an operator has pinned it.

    Rows are outcomes (kind 'images', or the kind of failure) or an operator's words:
    'pin' with a strategy, 'release' to go on by itself, 'reset' to the first rung. A
    success resets the count of failures (confidence) and not the rung; failures while
    pinned, and on the last rung, go on counting. Every row emits the policy after it.
    """

    state, start = "rung int, confidence int, pinned boolean, good long, bad long, last string", (0, 0, False, 0, 0, None)
    payload, out = "event_id long, kind string, strategy string", "event_id long, strategy string, confidence int, pinned boolean, good long, bad long, last_outcome string"

    def step(self, state, at, payload):
        rung, confidence, pinned, good, bad, last = state
        event, kind, strategy = payload
        if kind == "pin":
            rung, pinned = LADDER.index(strategy) if strategy in LADDER else rung, True
        elif kind == "release":
            pinned = False
        elif kind == "reset":
            rung, confidence, pinned = 0, 0, False
        elif kind == "images":
            confidence, good, last = 0, good + 1, kind
        else:
            confidence, bad, last = confidence + 1, bad + 1, kind
            if not pinned and confidence >= PROMOTE_AFTER and rung < len(LADDER) - 1:
                rung, confidence = rung + 1, 0
        state = (rung, confidence, pinned, good, bad, last)
        return state, [(event, LADDER[rung], confidence, pinned, good, bad, last)]


@dataclass
class Heartbeats(Machine):
    """A job's heartbeats: a row is written if the last one written is `gap` old or older; a job silent for `idle` is reported once, with event -1, at the time its patience ends."""

    gap: int
    idle: int
    state, start, payload = "written long, seen long, failed boolean", (None, None, False), "event_id long"
    out = "event_id long, what string, at long"

    def step(self, state, at, payload):
        written, _, _ = state
        write = written is None or at - written >= self.gap
        return (at if write else written, at, False), [(payload[0], "heartbeat", at)] if write else []

    def deadline(self, state):
        return None if state[1] is None or state[2] else state[1] + self.idle

    def expire(self, state, at):
        return (state[0], state[1], True), [(-1, "idle", at)]


@dataclass
class Cache(Machine):
    """Look-ups in caches with a time to live each, in seconds: a hit if the key was loaded less than that ago, or else it is loaded now; kind 'invalidate' empties them."""

    ttls: tuple[int, ...]
    payload, out = "event_id long, kind string", "event_id long, hits array<boolean>"
    state, start = "loaded array<long>", ([],)

    def step(self, state, at, payload):
        event, kind = payload
        loaded = list(state[0]) or [-1] * len(self.ttls)
        if kind == "invalidate":
            return ([-1] * len(self.ttls),), []
        hits = [t >= 0 and at - t < ttl * 1_000_000 for t, ttl in zip(loaded, self.ttls)]
        return ([t if hit else at for t, hit in zip(loaded, hits)],), [(event, hits)]

    def deadline(self, state):
        """When the last entry is too old, the state goes."""
        ends = [t + ttl * 1_000_000 for t, ttl in zip(state[0], self.ttls) if t >= 0]
        return max(ends, default=None)

    def expire(self, state, at):
        return self.start, []


@dataclass
class Buffer(Machine):
    """A write buffer: rows are held back until there are `size` of them, or a row of kind 'close' comes; then all are emitted with the number and the time of the flush."""

    size: int
    payload, out = "event_id long, kind string", "event_id long, flush int, flushed_at long"
    state, start = "held array<long>, flushes int", ([], 0)

    def step(self, state, at, payload):
        held, flushes = [*state[0], *([] if payload[1] == "close" else [payload[0]])], state[1]
        if len(held) < self.size and payload[1] != "close":
            return (held, flushes), []
        return ([], flushes + bool(held)), [(event, flushes + 1, at) for event in held]


@dataclass
class Claim(Machine):
    """A job's row of the queue: pending until the first claim, which wins; later claims lose until the row is given back (kind 'release')."""

    payload, out = "event_id long, kind string", "event_id long, won boolean"
    state, start = "owner long", (None,)

    def step(self, state, at, payload):
        if payload[1] == "release":
            return self.start, []
        return (payload[0],) if state[0] is None else state, [(payload[0], state[0] is None)]


class LiveCache(StatefulProcessor):
    """Look-ups in processing time, with Spark's own time to live: one value a key, and one a key and name.

    Rows: the key, a name and a value to load on a miss. Emits whether the value and the
    named entry were there. Spark drops what was written longer ago.
    """

    def __init__(self, key: str, value_ms: int, entry_ms: int) -> None:
        self.key, self.value_ms, self.entry_ms = key, value_ms, entry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "loaded string", self.value_ms)
        self.entries = handle.getMapState("entries", "name string", "loaded string", self.entry_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for frame in rows:
            for name, loaded in zip(frame["name"], frame["loaded"]):
                whole, named = self.value.exists(), self.entries.containsKey((name,))
                if not whole:
                    self.value.update((loaded,))
                if not named:
                    self.entries.updateValue((name,), (loaded,))
                out.append((key[0], name, whole, named, self.value.get()[0], self.entries.getValue((name,))[0]))
        yield pd.DataFrame(out, columns=[self.key, "name", "value_hit", "entry_hit", "value", "entry"])

    def close(self) -> None:
        pass


def live_cache(rows: DataFrame, key: str, value_seconds: float, entry_seconds: float) -> DataFrame:
    """rows: the key (long), name and loaded. In processing time; state goes by TTL."""
    p = LiveCache(key, int(value_seconds * 1000), int(entry_seconds * 1000))
    return rows.groupBy(key).transformWithStateInPandas(p, f"{key} long, name string, value_hit boolean, entry_hit boolean, value string, entry string", "append", "processingTime")


class InOrder(StatefulProcessor):
    """Runs a machine over the rows of a key in the order of (at, payload)."""

    def __init__(self, machine: Machine, key: str) -> None:
        self.machine, self.columns = machine, [key, *names(machine.out)]
        self.fields = ["at", *names(machine.payload)]
        self.kinds = [int, *(_KINDS[x.split()[1]] for x in machine.payload.split(", "))]  # pandas holds integers as floats where some are missing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("machine", self.machine.state)
        self.waiting = handle.getListState("waiting", f"at long, {self.machine.payload}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:  # one Arrow batch at a time
            new = [tuple(None if pd.isna(x) else kind(x) for kind, x in zip(self.kinds, r)) for r in frame[self.fields].itertuples(index=False, name=None)]
            self.waiting.appendList(new)
            first = min([r[0] for r in new] + ([first] if first is not None else []))
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((r for r in held if r[0] <= until), key=lambda r: tuple((x is not None, x) for x in r))
        rest = [r for r in held if r[0] > until]
        m, out = self.machine, []
        state = tuple(self.own.get()) if self.own.exists() else m.start

        def expired(state: tuple, before: int) -> tuple:
            while (end := m.deadline(state)) is not None and end <= before:
                state, rows = m.expire(state, end)
                out.extend(rows)
            return state

        for at, *payload in due:
            state, rows = m.step(expired(state, at), at, tuple(payload))
            out.extend(rows)
        state = expired(state, until)
        if state == m.start:
            self.own.clear()
        else:
            self.own.update(state)
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        ends = [r[0] for r in rest] + ([end] if (end := m.deadline(state)) is not None else [])
        if ends:
            self.handle.registerTimer(min(ends) // 1000 + 1)
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=self.columns)

    def close(self) -> None:
        pass


def in_order(rows: DataFrame | list[DataFrame], key: str, machine: Machine, delay: str) -> DataFrame:
    """What the machine emits for each key of one stream or of several, whose rows are `delay` late at most.

    rows: the key (long), a timestamp column ts and the columns of machine.payload. The
    slowest of several streams sets the pace. Rows later than that are dropped by the
    watermark, as in any event-time operator; a key's waiting rows are bounded by the delay.
    """
    parts = [x.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).select(key, "ts", micros().alias("at"), *names(machine.payload)) for x in (rows if isinstance(rows, list) else [rows])]
    x = parts[0]
    for p in parts[1:]:
        x = x.union(p)
    return x.groupBy(key).transformWithStateInPandas(InOrder(machine, key), f"{key} long, {machine.out}", "append", "eventTime")


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))
