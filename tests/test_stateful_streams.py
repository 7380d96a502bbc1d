"""Streams with timers: order, late events, restarts and expiry."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cairn.streaming import stateful

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "tile string, s double, kind string, generation long, quality double, ok boolean"


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def put(spark, rows, schema, path):
    """One more file of the stream."""
    made = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).drop("s")
    made.coalesce(1).write.mode("append").parquet(path)
    return made.schema


def run(spark, build, schema, folder, name):
    """All files so far, one a batch; state and sink are those of the runs before."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = build(source).writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").queryName(name).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.read.parquet(f"{folder}/out")


def test_tile_loads(rocks, tmp_path):
    folder = f"file://{tmp_path}"
    row = lambda tile, s, kind, generation=0, quality=1.0, ok=True: (tile, float(s), kind, generation, quality, ok)
    # Out of order within and across files; `b` is left alone and expires.
    schema = put(rocks, [row("a", 2, "result"), row("a", 1, "touch"), row("b", 1, "touch")], EVENT, f"{folder}/in")
    put(rocks, [row("a", 4, "epoch", 0, 0.5), row("a", 3, "touch"), row("a", 5, "touch")], EVENT, f"{folder}/in")
    build = lambda source: stateful.tile_loads(source, "3 seconds", "10 seconds", "4 seconds", "1 minute")
    run(rocks, build, schema, folder, "first")
    # After a restart: the result of the new generation, one of the old, a touch that is too late, and time to pass.
    put(rocks, [row("a", 6, "result", 0), row("a", 7, "result", 1), row("a", 8, "touch")], EVENT, f"{folder}/in")
    put(rocks, [row("c", 30, "touch")], EVENT, f"{folder}/in")
    run(rocks, build, schema, folder, "second")
    put(rocks, [row("a", 9, "touch"), row("c", 40, "touch")], EVENT, f"{folder}/in")
    put(rocks, [row("d", 200, "touch")], EVENT, f"{folder}/in")
    out = run(rocks, build, schema, folder, "third")
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.tile, r.ts)):
        got.setdefault(r.tile, []).append((r.ts.timestamp(), r.phase, r.generation, r.quality, r.displayed, r.pending))
    assert got["a"] == [
        (1, "loading", 0, 1.0, None, None), (2, "ready", 0, 1.0, None, 1.0), (4, "idle", 1, 0.5, None, None), (5, "loading", 1, 0.5, None, None),
        (7, "ready", 1, 0.5, None, 0.5), (12, "idle", 1, 0.5, None, None),
    ]
    assert got["b"] == [(1, "loading", 0, 1.0, None, None), (5, "idle", 1, 1.0, None, None)]
    # `c` starts a load at 30, which expires at 34; the next touch finds it idle; it is forgotten a minute after.
    assert got["c"] == [(30, "loading", 0, 1.0, None, None), (34, "idle", 1, 1.0, None, None), (40, "loading", 1, 1.0, None, None), (44, "idle", 2, 1.0, None, None)]


def test_transition_ends_by_itself(rocks, tmp_path):
    folder = f"file://{tmp_path}"
    rows = [("a", 1.0, "touch", 0, 1.0, True), ("a", 2.0, "result", 0, 1.0, True), ("z", 60.0, "touch", 0, 1.0, True)]
    schema = put(rocks, rows, EVENT, f"{folder}/in")
    out = run(rocks, lambda s: stateful.tile_loads(s, "1 second", "3 seconds", "40 seconds"), schema, folder, "transition")
    assert sorted((r.ts.timestamp(), r.phase, r.displayed, r.pending) for r in out.filter("tile = 'a'").collect()) == [(1, "loading", None, None), (2, "ready", None, 1.0), (5, "ready", 1.0, None), (41, "idle", None, None)]


def test_gesture_velocities(rocks, tmp_path):
    folder, rng = f"file://{tmp_path}", random.Random(3)
    times = sorted({round(rng.uniform(10, 13), 3) for _ in range(30)} | {round(rng.uniform(20, 21), 3) for _ in range(9)})
    moves = [("t", s, rng.uniform(-5, 5), rng.uniform(-5, 5)) for s in times] + [("u", 11.0, 1.0, 1.0)]
    mixed = moves[:]
    rng.shuffle(mixed)
    schema = None
    for part in (mixed[:14], mixed[14:27], mixed[27:], [("end", 100.0, 0.0, 0.0)]):
        schema = put(rocks, part, "track string, s double, dx double, dy double", f"{folder}/in")
    out = run(rocks, lambda s: stateful.gesture_velocities(s, "1500 milliseconds", "20 seconds"), schema, folder, "velocities").collect()
    want = []
    for own in ([m for m in moves if m[0] == "t" and m[1] < 15], [m for m in moves if m[0] == "t" and m[1] > 15], moves[-1:]):
        vx = vy = 0.0
        for a, b in zip(own, own[1:]):
            dt = (round(b[1] * 1e6) - round(a[1] * 1e6)) / 1e6
            if 0 < dt <= 0.25:
                share = 1 - math.exp(-dt / 0.09)
                vx, vy = vx + (b[2] / dt - vx) * share, vy + (b[3] / dt - vy) * share
        want.append((own[0][0], len(own), round(vx, 6), round(vy, 6)))
    assert sorted((r.track, r.n_moves, round(r.vx, 6), round(r.vy, 6)) for r in out) == sorted(want)
