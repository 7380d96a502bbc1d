"""Ordered computations on frames and track points (track, ix, ts).

All of them take a track's order in stretches (cairn.operators.ordered): sums
are carried over from stretch to stretch, and rows near a cut are copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scalars import smoothstep
from cairn.operators.ordered import so_far, with_neighbours


def look_ahead(points: DataFrame, value: str, stride: int = 3, samples: int = 9) -> DataFrame:
    """Mean of the points stride, 2 * stride, ... ahead, as far as the track goes; null at its end."""
    names = {f"_ahead_{k}": (value, stride * k) for k in range(1, samples + 1)}
    ahead = F.array_compact(F.array(*names))
    total = F.aggregate(ahead, F.lit(0.0), lambda s, x: s + x)
    return with_neighbours(points, names).withColumn("ahead", F.when(F.size(ahead) > 0, total / F.size(ahead))).drop(*names)


def frame_delta(points: DataFrame, longest: float) -> DataFrame:
    """Seconds since the frame before, at most `longest`; 0 on the first and on those without a time."""
    timed = with_neighbours(points.withColumn("_us", F.unix_micros("ts")), {"_before": ("_us", -1)})
    dt = F.least((F.col("_us") - F.col("_before")) / F.lit(1e6), F.lit(longest))
    return timed.withColumn("dt", F.coalesce(dt, F.lit(0.0))).select(*[c for c in points.columns if c != "dt"], "dt")


def running_sum(frames: DataFrame, value: Column, name: str) -> DataFrame:
    """frames with the exact sum of value so far."""
    return so_far(frames, {name: ("sum", value.cast("decimal(38,10)"))}).withColumn(name, F.col(name).cast("double"))


def accumulated_phase(frames: DataFrame, speed: float) -> DataFrame:
    """Phase that grows by speed * dt each frame."""
    return running_sum(frames, F.col("dt") * speed, "phase")


def morph_progress(frames: DataFrame, duration: float) -> DataFrame:
    """Share of a transition of `duration` seconds done by each frame, at most 1."""
    return running_sum(frames, F.col("dt"), "progress").withColumn("progress", F.least(F.col("progress") / duration, F.lit(1.0)))


def promoted(frames: DataFrame, duration: float, pending: str, displayed: str) -> DataFrame:
    """frames with progress, and what is displayed: the pending value from the frame on at which its transition is done."""
    return morph_progress(frames, duration).withColumn("shown", F.when(F.col("progress") >= 1, F.col(pending)).otherwise(F.col(displayed)))


def smoothed_velocity(moves: DataFrame, dx: str, dy: str, smooth_ms: float = 90.0, longest: float = 0.25) -> DataFrame:
    """(track, vx, vy): velocity at the end of each gesture, each move's own drawn in by 1 - exp(-dt / tau); moves with no time or over `longest` seconds between them count for nothing.

    Drawing in one move after another weighs each by the decay over the time
    of those after it, so the fold is a sum; times so far come from stretches
    of a gesture and its whole time is joined back.
    """
    tau = smooth_ms / 1000
    timed = with_neighbours(moves.withColumn("_us", F.unix_micros("ts")), {"_before": ("_us", -1)})
    timed = timed.withColumn("_dt", (F.col("_us") - F.col("_before")) / F.lit(1e6)).filter((F.col("_dt") > 0) & (F.col("_dt") <= longest))
    timed = timed.select("track", "ix", "ts", "_dt", F.col(dx).cast("double").alias("_dx"), F.col(dy).cast("double").alias("_dy"))
    whole = timed.groupBy("track").agg(F.sum(F.col("_dt").cast("decimal(38,10)")).cast("double").alias("_whole"))
    at = running_sum(timed, F.col("_dt"), "_t").join(whole, "track")
    weight = (1 - F.exp(-F.col("_dt") / tau)) * F.exp((F.col("_t") - F.col("_whole")) / tau)
    return at.groupBy("track").agg(*[F.sum(weight * F.col(d) / F.col("_dt")).alias(v) for v, d in (("vx", "_dx"), ("vy", "_dy"))])


def coasting(frames: DataFrame, speed: str, damping: float = 7.0, least: float = 24.0) -> DataFrame:
    """Frames (track, ix, ts, dt, speed at release) while the view still coasts, with velocity: the speed decays by exp(-damping * dt) a frame and stops below `least`."""
    out = running_sum(frames, F.col("dt"), "_so_far")
    before = F.col("_so_far") - F.col("dt")
    return out.withColumn("velocity", F.col(speed) * F.exp(-damping * before)).filter(F.col("velocity") >= least).drop("_so_far")


def smooth_zoom(start: Column, target: Column, step: Column, smooth_ms: float = 90.0, near: float = 0.5) -> Column:
    """Distance after `step` frames of zooming: a fixed share of the way left each frame, until less than `near` is left.

    The frame that comes within `near` is the last to move.
    """
    left = F.abs(target - start)
    rate = 20 / smooth_ms
    last = F.when(left < near, 1).otherwise(F.floor(F.log(left / near) * (1 / rate)) + 1)
    return target - (target - start) * F.exp(-rate * F.least(step, last))


def wheel_gestures(steps: DataFrame, idle_ms: int = 80, cooldown_ms: int = 180) -> DataFrame:
    """(track, start_us, end_us, n_steps) of wheel gestures: steps at most idle_ms apart; a gesture that begins within the cooldown after another's end is left out.

    The end of a gesture is its last step and the idle time.  The cooldown
    counts from the gesture just before, also where that one was left out.
    """
    found = steps.groupBy("track", F.session_window("ts", f"{idle_ms} milliseconds")).agg(F.count("*").alias("n_steps"))
    out = found.select("track", F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "n_steps")
    before = F.lag("end_us").over(Window.partitionBy("track").orderBy("start_us"))
    return out.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("start_us") >= F.col("_before") + cooldown_ms * 1000)).drop("_before")


def changes(points: DataFrame, key: str) -> DataFrame:
    """Rows whose key differs from the row before; the first of a track counts."""
    found = with_neighbours(points.withColumn("_one", F.lit(1)), {"_before": (key, -1), "_any": ("_one", -1)})
    return found.filter(F.col("_any").isNull() | ~F.col(key).eqNullSafe(F.col("_before"))).drop("_before", "_any", "_one")


def pulse(points: DataFrame, clock: float, rate: float = 0.02, lift: float = 100.0) -> DataFrame:
    """pulse: a wave that runs along each track, smoothstep over the last tenth of its phase; lift_z: the height it adds."""
    ends = points.groupBy("track").agg(F.unix_micros(F.min("ts")).alias("_first"), F.unix_micros(F.max("ts")).alias("_last"))
    first, last = F.col("_first"), F.col("_last")
    share = F.when(last > first, (F.unix_micros("ts") - first) / (last - first)).otherwise(0.0) - F.lit(rate * clock)
    out = points.join(ends, "track").withColumn("pulse", smoothstep(0.9, 1.0, share - F.floor(share)))
    return out.withColumn("lift_z", F.col("pulse") * lift).drop("_first", "_last")


def newest_generation(rows: DataFrame, key: str, generation: str) -> DataFrame:
    """Rows of the newest generation of their key: late results of older ones go."""
    newest = rows.groupBy(key).agg(F.max(generation).alias("_newest"))
    return rows.join(newest, key).filter(F.col(generation) == F.col("_newest")).drop("_newest")


def evicted(rows: DataFrame, by: list[str], recency: list[Column], size: str, budget: float) -> DataFrame:
    """rows with running bytes from the latest touch on, and whether they are over the budget."""
    window = Window.partitionBy(*by).orderBy(*recency).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.sum(F.col(size).cast("decimal(38,4)")).over(window).cast("double")
    return rows.withColumn("held", held).withColumn("evict", F.col("held") > budget)


def state_key(rows: DataFrame, key: str, order: str, part: Column) -> DataFrame:
    """The parts of each key joined by | in the given order; a key's parts meet in one array, as a view's visible tiles do."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["p"]), "|").alias("state_key"))
