"""Picks against the ground sampled very finely and solved cell by cell."""

import math

import numpy as np
import pytest

from cairn.operators import picking


def ground(h, x, y):
    i, j = math.floor(x), math.floor(y)
    if not (0 <= i < h.shape[1] - 1 and 0 <= j < h.shape[0] - 1):
        return math.nan
    u, v = x - i, y - j
    return h[j, i] * (1 - u) * (1 - v) + h[j, i + 1] * u * (1 - v) + h[j + 1, i] * (1 - u) * v + h[j + 1, i + 1] * u * v


def brute(h, ray, far, steps=40_000):
    """The first of many steps that is not above the ground, refined by halving."""
    at = lambda t: ray[2] + ray[5] * t - ground(h, ray[0] + ray[3] * t, ray[1] + ray[4] * t)
    for k in range(steps + 1):
        t = far * k / steps
        if at(t) <= 0:
            low, high = far * max(0, k - 1) / steps, t
            for _ in range(60):
                middle = (low + high) / 2
                low, high = (low, middle) if at(middle) <= 0 else (middle, high)
            return high
    return None


@pytest.mark.parametrize("width, height, blocks", [(6, 5, (4, 2)), (24, 30, ()), (4, 3, (3,))])
def test_rays(spark, width, height, blocks):
    rng = np.random.default_rng(8)
    h = np.round(rng.random((30, 24)) * 20 + 20 * np.sin(np.arange(24) / 4), 2)
    h[14, 7] = np.nan
    rows = [(tx, ty, h[ty * height : (ty + 1) * height, tx * width : (tx + 1) * width].ravel().tolist()) for ty in range(30 // height) for tx in range(24 // width)]
    tiles = spark.createDataFrame(rows, "tx int, ty int, pixels array<double>").repartition(3)
    rays = [(i, rng.uniform(-3, 26), rng.uniform(-3, 32), rng.uniform(10, 50), *rng.uniform(-1, 1, 2), rng.uniform(-2, 0.1)) for i in range(60)]
    # Straight down; along lines of samples; over a corner; level; below the ground; still; outside.
    rays += [(100, 5.5, 7.25, 90.0, 0.0, 0.0, -3.0), (101, 3.0, 2.0, 50.0, 1.0, 0.0, -1.0), (102, 0.0, 0.0, 60.0, 1.0, 1.0, -2.5), (103, 0.5, 9.5, 21.0, 1.0, 0.0, 0.0), (104, 9.5, 9.5, -90.0, 1.0, 1.0, 0.0), (105, 9.5, 9.5, -90.0, 0.0, 0.0, 0.0), (106, 99.0, 9.5, 10.0, 1.0, 0.0, -1.0)]
    rays = [(i, *map(float, r)) for i, *r in rays] + [(107, None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rays, "ray long, x double, y double, z double, vx double, vy double, vz double")
    got = {r.ray: r for r in picking.terrain_picks(frame, tiles, width, height, 45.0, blocks).collect()}
    assert len(got) == len(rays) and got[107].t is None and got[106].reason == "empty-pixel" and got[104].t == got[105].t == 0
    for r in rays[:-1]:
        want = brute(h, r[1:], 45.0, 6_000)
        have = got[r[0]].t
        if want is not None:  # steps may pass over a thin ridge that the ray does meet
            assert have is not None and have <= want + 1e-6, r
        if have is not None:
            x, y, z = got[r[0]].hit_x, got[r[0]].hit_y, got[r[0]].hit_z
            here = [g for g in (ground(h, x + a, y + b) for a in (-1e-9, 1e-9) for b in (-1e-9, 1e-9)) if not math.isnan(g)]
            assert have == 0 or min(abs(z - g) for g in here) < 1e-4 or want is not None and abs(have - want) < 1e-6, r
    assert sum(r.t is not None for r in got.values()) > 20


def test_a_thin_ridge_is_met(spark):
    h = np.zeros((4, 64))
    h[:, 33] = 100.0
    tiles = spark.createDataFrame([(tx, 0, h[:, tx * 8 : tx * 8 + 8].ravel().tolist()) for tx in range(8)], "tx int, ty int, pixels array<double>")
    rays = spark.createDataFrame([("low", 0.0, 1.5, 99.0, 40.0, 0.0, 0.0), ("high", 0.0, 1.5, 101.0, 40.0, 0.0, 0.0)], "ray string, x double, y double, z double, vx double, vy double, vz double")
    got = {r.ray: r for r in picking.terrain_picks(rays, tiles, 8, 4, 1.5).collect()}
    assert got["low"].hit_x == pytest.approx(32.99) and got["high"].t is None
    assert picking.terrain_picks(rays, tiles.filter("tx > 50"), 8, 4, 1.5).filter("t IS NOT NULL").count() == 0
