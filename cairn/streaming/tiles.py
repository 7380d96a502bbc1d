"""Streaming forms of tile visibility: intervals, first touches and load phases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHASES = "tile string, ts timestamp, phase string, generation long, quality double, displayed double, pending double"
STATE = "phase string, generation long, quality double, displayed double, pending double"
NEW = ("idle", 0, 1.0, None, None)


def alive_intervals(touches: DataFrame, gap: str, late: str) -> DataFrame:
    """(tile, start, end, n_touches) of touches (tile, ts) at most `gap` apart, once the watermark has passed them."""
    found = touches.withWatermark("ts", late).groupBy("tile", F.session_window("ts", gap)).agg(F.count("*").alias("n_touches"))
    return found.select("tile", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_touches")


def first_touches(touches: DataFrame, late: str) -> DataFrame:
    """The first touch of each tile, which starts its load."""
    return touches.withWatermark("ts", late).dropDuplicatesWithinWatermark(["tile"])


def step(state: tuple, event) -> tuple[tuple, bool]:
    """The next (phase, generation, quality, displayed, pending) of a tile, and whether it changed.

    A tile's first event of any kind registers it, idle and in generation 0.
    touch: an idle tile starts to load.  epoch: a new generation starts, idle,
    and a pending payload is dropped.  expire: the load is dropped, and its
    generation with it, or the payload of a tile that was ready.  result: ends the
    load of its own generation, and its payload waits for its transition;
    results of older generations are ignored.  promote: the transition is done
    and the pending payload is displayed.  disable: nothing lossy is left, and
    touches start no load until enable.
    """
    phase, generation, quality, displayed, pending = state
    new = state
    if event.kind == "touch" and phase == "idle":
        new = ("loading", generation, quality, displayed, pending)
    elif event.kind == "epoch" and phase != "off":
        new = ("idle", generation + 1, event.quality, displayed, None)
    elif event.kind == "expire" and phase != "off":
        new = ("idle", generation + (phase == "loading"), quality, None, None)
    elif event.kind == "result" and phase == "loading" and event.generation == generation:
        new = ("ready", generation, quality, displayed, quality) if event.ok else ("failed", generation, quality, displayed, pending)
    elif event.kind == "promote" and pending is not None:
        new = (phase, generation, quality, pending, None)
    elif event.kind == "disable":
        new = ("off", generation + (phase == "loading"), quality, None, None)
    elif event.kind == "enable" and phase == "off":
        new = ("idle", generation, quality, None, None)
    return new, new != state


def phases(events: DataFrame, late: str = "1 minute", idle_for: str = "1 hour") -> DataFrame:
    """Every change of phase of every tile, from events (tile, ts, kind, generation, quality, ok).

    Events of a tile within one batch are taken in time order.  A tile's state
    goes once the watermark is idle_for past its last event; if it comes back, it starts
    anew.
    """
    pause = int(pd.Timedelta(idle_for).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = []
        if state.hasTimedOut:
            state.remove()
        else:
            now = tuple(state.get) if state.exists else NEW
            batch = pd.concat(list(frames)).sort_values(["ts", "kind"], kind="stable")
            for event in batch.itertuples():
                now, changed = step(tuple(None if v != v else v for v in now), event)
                if changed:
                    rows.append((key[0], event.ts, *now))
            state.update(now)
            last = int(batch["ts"].max().timestamp() * 1000) + pause
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["tile", "ts", "phase", "generation", "quality", "displayed", "pending"])

    return events.withWatermark("ts", late).groupBy("tile").applyInPandasWithState(run, PHASES, STATE, "append", "EventTimeTimeout")


def debounced(steps: DataFrame, idle: str, late: str) -> DataFrame:
    """(track, start, end, n_steps) of gestures: steps at most `idle` apart, once the watermark has passed them."""
    found = steps.withWatermark("ts", late).groupBy("track", F.session_window("ts", idle)).agg(F.count("*").alias("n_steps"))
    return found.select("track", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_steps")


def reconciled(events: DataFrame, late: str = "1 minute", idle_for: str = "1 hour") -> DataFrame:
    """(tile, ts, action): what makes the loaded set follow the desired one, from events (tile, ts, kind: want, drop, loaded).

    A wanted tile that isn't loaded or on its way is to be added.  A load
    that ends looks at the desired set again: what was dropped meanwhile, like
    a loaded tile that is dropped, is to be removed.  State goes after idle_for without
    events.
    """
    pause = int(pd.Timedelta(idle_for).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = []
        if state.hasTimedOut:
            state.remove()
        else:
            wanted, asked, loaded = state.get if state.exists else (False, False, False)
            batch = pd.concat(list(frames)).sort_values(["ts", "kind"], kind="stable")
            for event in batch.itertuples():
                wanted = event.kind == "want" or (wanted and event.kind != "drop")
                if event.kind == "loaded":
                    asked, loaded = False, True
                if wanted and not (asked or loaded):
                    asked = True
                    rows.append((key[0], event.ts, "add"))
                elif loaded and not wanted:
                    loaded = False
                    rows.append((key[0], event.ts, "remove"))
            state.update((wanted, asked, loaded))
            state.setTimeoutTimestamp(max(int(batch["ts"].max().timestamp() * 1000) + pause, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["tile", "ts", "action"])

    return events.withWatermark("ts", late).groupBy("tile").applyInPandasWithState(run, "tile string, ts timestamp, action string", "wanted boolean, asked boolean, loaded boolean", "append", "EventTimeTimeout")
