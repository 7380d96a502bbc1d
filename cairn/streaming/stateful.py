"""Streams whose state waits for time to pass: events are taken in order once the watermark has reached them, and what is due then happens between them.

Needs the RocksDB state store:
spark.sql.streaming.stateStore.providerClass =
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider

Each key keeps a list of events that the watermark has not reached, a map of
deadlines by name, and a value.  One timer of Spark stands at the earliest of
these.  Events older than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from cairn.streaming.tiles import NEW, STATE, step


class InOrder(StatefulProcessor):
    """Takes a key's events by time `us` (ties by `kind`), and its deadlines; at one time events come first.

    A subclass names the events' columns, the value's schema and output
    columns, and handles event(), which may return rows, and due().
    """

    event_schema = "us long, kind string"
    value_schema = "n long"
    output: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.event_schema)
        self.deadlines = handle.getMapState("deadlines", "name string", "us long")
        self.value = handle.getValueState("value", self.value_schema)
        self.names = [f.strip().split(" ")[0] for f in self.event_schema.split(",")]

    def event(self, key: tuple, value: tuple | None, event: dict) -> tuple[tuple | None, list[tuple]]:
        """The next value and rows to emit."""
        raise NotImplementedError

    def due(self, key: tuple, value: tuple | None, name: str, us: int) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def set_deadline(self, name: str, us: int | None) -> None:
        if us is None:
            self.pending.pop(name, None)
        else:
            self.pending[name] = us

    def advance(self, key: tuple, events: list[tuple], timers: TimerValues) -> Iterator[pd.DataFrame]:
        """Take all that the watermark has reached, in order."""
        until = timers.getCurrentWatermarkInMs() * 1000
        value = tuple(self.value.get()) if self.value.exists() else None
        self.pending = {name[0]: us[0] for name, us in self.deadlines.iterator()} if self.deadlines.exists() else {}
        before = set(self.pending)
        events = sorted(events, key=lambda e: (e[0], e[1]))
        rows, at = [], 0
        while True:
            name, us = min(self.pending.items(), key=lambda d: (d[1], d[0]), default=(None, None))
            if at < len(events) and events[at][0] <= until and (us is None or events[at][0] <= us):
                value, made = self.event(key, value, dict(zip(self.names, events[at])))
                at += 1
            elif us is not None and us <= until:
                del self.pending[name]
                value, made = self.due(key, value, name, us)
            else:
                break
            rows += made
        left = events[at:]
        self.waiting.put(left) if left else self.waiting.clear()
        for name in before - set(self.pending):
            self.deadlines.removeKey((name,))
        for name, us in self.pending.items():
            self.deadlines.updateValue((name,), (us,))
        self.value.clear() if value is None else self.value.update(value)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        nearest = min([*self.pending.values(), *[e[0] for e in left[:1]]], default=None)
        if nearest is not None:
            self.handle.registerTimer(max(-(-nearest // 1000), timers.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(rows, columns=list(self.output))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        plain = lambda v: None if v is None or v != v else v.item() if isinstance(v, np.generic) else v
        for frame in rows:
            held += [tuple(plain(v) for v in row) for row in frame[self.names].itertuples(index=False, name=None)]
        yield from self.advance(key, held, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.advance(key, [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else [], timerValues)

    def close(self) -> None:
        pass


class Event:
    """What tiles.step reads of an event."""

    def __init__(self, kind: str, generation: int | None = None, quality: float | None = None, ok: bool | None = None):
        self.kind, self.generation, self.quality, self.ok = kind, generation, quality, ok


class TileLoads(InOrder):
    """Phases of one tile: its own transitions end and its own touches expire."""

    event_schema = "us long, kind string, generation long, quality double, ok boolean"
    value_schema = STATE
    output = ("tile", "us", "phase", "generation", "quality", "displayed", "pending")

    def __init__(self, transition_us: int, grace_us: int, idle_us: int):
        self.transition_us, self.grace_us, self.idle_us = transition_us, grace_us, idle_us

    def changed(self, key: tuple, value: tuple, event: Event, us: int) -> tuple[tuple, list[tuple]]:
        new, changed = step(value, event)
        # A payload that waits is shown when its transition is over; one that is swapped or dropped takes its transition along.
        if new[4] is None:
            self.set_deadline("promote", None)
        elif new[4] != value[4] or event.kind == "result" and changed:
            self.set_deadline("promote", us + self.transition_us)
        return new, [(key[0], us, *new)] if changed else []

    def event(self, key: tuple, value: tuple | None, event: dict) -> tuple[tuple, list[tuple]]:
        us = event["us"]
        if event["kind"] == "touch":
            self.set_deadline("expire", us + self.grace_us)
        self.set_deadline("forget", us + self.idle_us)
        return self.changed(key, value or NEW, Event(event["kind"], event["generation"], event["quality"], event["ok"]), us)

    def due(self, key: tuple, value: tuple | None, name: str, us: int) -> tuple[tuple | None, list[tuple]]:
        if name == "forget":
            self.set_deadline("promote", None)
            self.set_deadline("expire", None)
            return None, []
        return self.changed(key, value or NEW, Event(name), us)


def micros(duration: str) -> int:
    return int(pd.Timedelta(duration).total_seconds() * 1_000_000)


def tile_loads(events: DataFrame, late: str = "1 minute", transition: str = "3.5 seconds", grace: str = "1.5 seconds", idle_for: str = "1 hour") -> DataFrame:
    """Every change (tile, ts, phase, generation, quality, displayed, pending) of every tile, from events (tile, ts, kind, generation, quality, ok), in order of time.

    As in tiles.step, with times of its own: a payload that came is displayed
    once its transition is over, unless an epoch, an expiry or a newer payload
    comes first; a tile that nothing touches for `grace` expires; its state goes
    after idle_for without events, and it starts anew if it comes back.
    """
    schema = "tile string, us long, phase string, generation long, quality double, displayed double, pending double"
    timed = events.withWatermark("ts", late).select("tile", "ts", F.unix_micros("ts").alias("us"), "kind", F.col("generation").cast("long").alias("generation"), "quality", "ok")
    found = timed.groupBy("tile").transformWithStateInPandas(TileLoads(micros(transition), micros(grace), micros(idle_for)), schema, "Append", "EventTime")
    return found.select("tile", F.timestamp_micros("us").alias("ts"), "phase", "generation", "quality", "displayed", "pending")


class Gestures(InOrder):
    """Velocity of one track's gestures, each ended by a pause."""

    event_schema = "us long, kind string, dx double, dy double"
    value_schema = "start long, last long, n long, vx double, vy double"
    output = ("track", "start_us", "end_us", "n_moves", "vx", "vy")

    def __init__(self, idle_us: int, smooth: float, longest: float):
        self.idle_us, self.smooth, self.longest = idle_us, smooth, longest

    def event(self, key: tuple, value: tuple | None, event: dict) -> tuple[tuple, list[tuple]]:
        us = event["us"]
        self.set_deadline("end", us + self.idle_us)
        if value is None:
            return (us, us, 1, 0.0, 0.0), []
        start, last, n, vx, vy = value
        dt = (us - last) / 1e6
        if 0 < dt <= self.longest:
            share = 1 - float(np.exp(-dt / self.smooth))
            vx, vy = vx + (event["dx"] / dt - vx) * share, vy + (event["dy"] / dt - vy) * share
        return (start, us, n + 1, vx, vy), []

    def due(self, key: tuple, value: tuple | None, name: str, us: int) -> tuple[None, list[tuple]]:
        return None, [(key[0], value[0], value[1], value[2], value[3], value[4])] if value else []


def gesture_velocities(moves: DataFrame, idle: str = "1 second", late: str = "1 second", smooth_ms: float = 90.0, longest: float = 0.25) -> DataFrame:
    """(track, start_us, end_us, n_moves, vx, vy) of every gesture of moves (track, ts, dx, dy), once a pause of `idle` has ended it; the velocity is that of frames.smoothed_velocity."""
    timed = moves.withWatermark("ts", late).select("track", "ts", F.unix_micros("ts").alias("us"), F.lit("move").alias("kind"), F.coalesce(F.col("dx").cast("double"), F.lit(0.0)).alias("dx"), F.coalesce(F.col("dy").cast("double"), F.lit(0.0)).alias("dy"))
    kind = moves.schema["track"].dataType.simpleString()
    return timed.groupBy("track").transformWithStateInPandas(Gestures(micros(idle), smooth_ms / 1000, longest), f"track {kind}, start_us long, end_us long, n_moves long, vx double, vy double", "Append", "EventTime")
