"""Operators that SQL doesn't reach: meshes, view sheds, configurations and their edges, against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import geodesy, scalars
from cairn.operators import frames, mesh, raster


@pytest.mark.parametrize("kind", ["random", "lattice", "line", "repeated"])
def test_triangles_are_delaunay(kind):
    rng = np.random.default_rng(2)
    x, y = {"random": rng.random((2, 120)), "lattice": np.array(np.meshgrid(np.arange(8.0), np.arange(7.0))).reshape(2, -1), "line": np.array([np.arange(9.0), np.arange(9.0) * 2]), "repeated": np.repeat(rng.random((2, 30)), 3, axis=1)}[kind]
    p = np.stack([x, y], 1)
    found = mesh.triangles(x, y)
    area = 0.0
    for a, b, c in found:
        (ax, ay), (bx, by), (cx, cy) = p[a], p[b], p[c]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        assert d > 0
        area += d / 4
        ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
        uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
        assert (np.hypot(x - ux, y - uy) > math.hypot(ax - ux, ay - uy) - 1e-6).all()
    # Euler: a triangulation that fills the hull of n points, h of them on it, has 2n - 2 - h triangles.
    if kind == "lattice":
        assert len(found) == 2 * 7 * 6 and area == pytest.approx(42)
    if kind == "line":
        assert len(found) == 0
    assert len(set().union(*map(set, found.tolist()), set())) in (0, len(np.unique(p, axis=0)))


def test_cells_are_triangulated_apart(spark):
    rows = [(c, i, float(i % 3), float(i // 3)) for c in ("a", "b") for i in range(9)]
    got = mesh.triangulate(spark.createDataFrame(rows, "cell string, vid long, x double, y double")).collect()
    assert {c: sum(r.cell == c for r in got) for c in "ab"} == {"a": 8, "b": 8}
    assert mesh.triangulate(spark.createDataFrame(rows[:2], "cell string, vid long, x double, y double")).count() == 0


@pytest.mark.parametrize(
    "given, want",
    [
        ({}, (10000, 2048, 3.4, 2)),
        ({"source_height": 3.0, "scale": 0.75}, (10000, 2048, 2.25, 0.75)),
        ({"radius": 1.0, "map_size": 32.0, "near": 100.0}, (10, 256, 5, 2)),
        ({"near": float("nan"), "radius": float("inf")}, (10000, 2048, 3.4, 2)),
    ],
)
def test_viewshed_configurations(spark, given, want):
    c = scalars.viewshed_config(*[F.lit(given.get(k)).cast("double") for k in ("radius", "map_size", "near", "scale", "source_height")])
    assert spark.range(1).select(c.alias("c")).first().c == pytest.approx(want)


def test_half_floats(spark):
    values = [0.0, -0.0, 1.0, -2.0, 65504.0, 65519.9, 65520.0, 1e9, -1e9, 2.0**-24, 2.0**-25, 2.0**-14, 1 + 2.0**-11, float("inf"), float("nan")]
    bits = [0, 0x8000, 0x3C00, 0xC000, 0x7BFF, 0x7BFF, 0x7C00, 0x7C00, 0xFC00, 1, 0, 0x0400, 0x3C01, 0x7C00, 0x7E00]
    got = spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", scalars.float_to_half(F.col("v")).alias("b")).orderBy("i").collect()
    assert [r.b for r in got] == bits


def test_known_places(spark):
    """The published example of the guide, and the way back."""
    got = geodesy.to_osgb(spark.createDataFrame([(52.65798, 1.71605)], "lat double, lon double"))
    got = got.withColumn("ref", geodesy.grid_reference(F.col("east"), F.col("north"), 6)).first()
    assert math.hypot(got.east - 651409.9, got.north - 313177.3) < 1.5 and got.ref == "TG514131"
    back = geodesy.to_wgs(geodesy.to_osgb(spark.createDataFrame([(51.0 + i / 9, -3.0 + i / 7) for i in range(20)], "a double, b double"), "a", "b")).collect()
    assert all(abs(r.lat - r.a) < 2e-7 and abs(r.lon - r.b) < 2e-7 for r in back)


def test_smooth_zoom_steps(spark):
    now, want = 900.0, []
    moving = True
    for _ in range(60):
        want.append(now)
        if moving:
            now += (100 - now) * (1 - math.exp(-20 / 90))
            moving = abs(100 - now) >= 0.5
    got = spark.range(60).select("id", frames.smooth_zoom(F.lit(900.0), F.lit(100.0), F.col("id")).alias("d")).orderBy("id").collect()
    assert [r.d for r in got] == pytest.approx(want)


def test_recode_failures_are_rows(spark):
    rows = [(1, [5, 9, 1000], 0.0), (2, [], 0.1), (3, [1], 1.0), (4, [5, 9, 1000], 0.5), (5, None, 0.5)]
    got = {r.tile: r for r in raster.recode(spark.createDataFrame(rows, "tile int, px array<int>, q double"), "px", "q").collect()}
    assert [got[i].status for i in range(1, 6)] == ["ok", "error", "error", "ok", "error"] and got[1].lossy == [5, 9, 1000] and got[4].lossy == [0, 0, 1024 - 1024 % 64]


@pytest.mark.parametrize("strip_points", [40, 150])
@pytest.mark.parametrize("kind", ["random", "clusters", "columns"])
def test_strips_give_the_triangles_of_the_whole(spark, kind, strip_points):
    rng = np.random.default_rng(12)
    x, y = {"random": rng.random((2, 700)), "clusters": rng.normal(size=(2, 700)) * 0.02 + rng.integers(0, 4, 700), "columns": np.stack([rng.integers(0, 9, 700) + rng.random(700) * 1e-9, rng.random(700)])}[kind]
    frame = spark.createDataFrame([("a", i, float(x[i]), float(y[i])) for i in range(700)] + [("b", i, float(i % 2), float(i)) for i in range(5)] + [(None, 1, 0.0, 0.0), ("a", 9999, float("nan"), 1.0)], "sheet string, vid long, x double, y double").repartition(3)
    got = mesh.triangulate(frame, "sheet", strip_points=strip_points).collect()
    turn = lambda t: tuple(t[t.index(min(t)) :] + t[: t.index(min(t))])
    want = sorted(turn(t) for t in mesh.triangles(x, y).tolist())
    assert [(r.a, r.b, r.c) for r in sorted((r for r in got if r.sheet == "a"), key=lambda r: r.tid)] == want
    assert sum(r.sheet == "b" for r in got) == 3 and sorted(r.tid for r in got if r.sheet == "a") == list(range(len(want)))


def test_strips_through_a_lattice_fill_it(spark):
    rows = [("a", i, float(i % 20), float(i // 20)) for i in range(400)]
    got = mesh.triangulate(spark.createDataFrame(rows, "cell string, vid long, x double, y double"), strip_points=60).collect()
    area = lambda a, b, c: ((b % 20 - a % 20) * (c // 20 - a // 20) - (b // 20 - a // 20) * (c % 20 - a % 20)) / 2
    assert len(got) == 2 * 19 * 19 and all(area(r.a, r.b, r.c) == 0.5 for r in got)
