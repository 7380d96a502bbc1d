"""Order in stretches: every cut of tracks gives the rows of plain order; queries on tracks agree with their SQL when stretches are short."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cairn.operators import ordered
from cairn.plans.queries import ORACLE_SQL, QUERIES
from tests_support import db, rows_of

CUT_QUERIES = "track_decimate playhead_positions playhead_asof playhead_interp running_stats lookahead_smooth frame_phase coasting transitions change_detect gesture_velocity svg_paths".split()


@pytest.mark.parametrize("name", CUT_QUERIES)
def test_queries_in_short_stretches(spark, monkeypatch, name):
    plain, cuts = ordered.stretches, []

    def short(points, rows, most):
        found = plain(points, 7, 400)
        cuts.append(found.cut)
        return found

    monkeypatch.setattr(ordered, "stretches", short)
    got, want = QUERIES[name](spark, db.folder), db.connection().sql(ORACLE_SQL[name])
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())
    assert cuts and all(c is not None for c in cuts)


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.choice([None, *range(200)]), rng.choice([None, *map(float, range(9))])) for i in range(600)]
    rows += [(None, 1000, 5, 1.0), ("one", 1001, None, 2.0)]
    frame = spark.createDataFrame(rows, "track string, ix long, s long, v double")
    return rows, frame.select("track", "ix", F.timestamp_seconds("s").alias("ts"), "v").repartition(3)


def by_track(rows):
    out = defaultdict(list)
    for track, ix, s, v in sorted(rows, key=lambda r: (-1 if r[2] is None else r[2], r[1])):
        if track is not None:
            out[track].append((ix, s, v))
    return out


@pytest.mark.parametrize("size, most", [(10, 1000), (1, 5000), (100, 3), (10**6, 10)])
def test_ranks_sums_and_neighbours(points, size, most):
    rows, frame = points
    tracks = by_track(rows)
    ranks = {r.ix: (r._i, r._n) for r in ordered.ranked(frame, rows=size, most=most).collect()}
    near = {r.ix: (r.a, r.b, r.c) for r in ordered.with_neighbours(frame, {"a": ("v", 1), "b": ("ix", 4), "c": ("ix", -2)}, rows=size, most=most).collect()}
    sums = {r.ix: (r.n, r.low, r.high, r.total) for r in ordered.so_far(frame, {"n": ("count", F.col("v")), "low": ("min", F.col("v")), "high": ("max", F.col("v")), "total": ("sum", F.col("v").cast("decimal(38,4)"))}, rows=size, most=most).collect()}
    assert len(ranks) == len(near) == len(sums) == sum(map(len, tracks.values()))
    for found in tracks.values():
        get = lambda k, c: found[k][c] if 0 <= k < len(found) else None  # noqa: B023, E731
        for k, (ix, _, _) in enumerate(found):
            assert ranks[ix] == (k, len(found))
            assert near[ix] == (get(k + 1, 2), get(k + 4, 0), get(k - 2, 0))
            so_far = [v for _, _, v in found[: k + 1] if v is not None]
            n, low, high, total = sums[ix]
            assert (n, low, high) == (len(so_far), min(so_far, default=None), max(so_far, default=None)) and (total is None or float(total) == sum(so_far))


def test_long_track_is_spread(points):
    found = ordered.stretches(points[1], 20, 100)
    sizes = [r["count"] for r in found.rows.filter("track = 'hot'").groupBy("_stretch").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 80
    assert found.cut.count() <= 100


def test_as_of(points, spark):
    rows, frame = points
    probes = [(i, t, s) for i, (t, s) in enumerate([("hot", k / 2) for k in range(-4, 420, 3)] + [("a", 50.0), ("none", 1.0), ("one", 9.0), (None, 3.0), ("b", None)])]
    asked = spark.createDataFrame(probes, "id long, track string, s double").select("id", "track", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))
    want = {}
    for i, t, s in probes:
        if t is not None and s is not None:
            before = [(x[2], x[1], x[3]) for x in rows if x[0] == t and x[2] is not None and x[2] <= s]
            want[i] = max(before, key=lambda x: x[:2])[1:] if before else (None, None)
    for size in (10, 10**6):
        got = {r.id: (r.at_ix, r.at_v) for r in ordered.as_of(asked, frame.withColumn("ix", F.col("ix")), ["ix", "v"], rows=size).collect()}
        assert got == want


def test_empty(points):
    none = points[1].filter("ix < 0")
    assert ordered.ranked(none).count() == ordered.so_far(none, {"n": ("count", F.col("v"))}).count() == ordered.with_neighbours(none, {"a": ("v", 1)}).count() == 0
