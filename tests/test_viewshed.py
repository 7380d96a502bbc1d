"""View sheds across tiles against rays walked one step at a time over the joined raster."""

import math

import numpy as np
import pytest

from cairn.operators import viewshed


def brute(h, x, y, eye, radius):
    """Cells seen from (x, y), each by the ray of the square's edge that passes it closest."""
    rows, columns = h.shape
    inside = lambda a, b: 0 <= a < columns and 0 <= b < rows and not math.isnan(h[b, a])
    base, reach, seen = h[y, x] + eye, math.ceil(radius), set()
    for cy in range(rows):
        for cx in range(columns):
            dx, dy = cx - x, cy - y
            n = max(abs(dx), abs(dy))
            if not inside(cx, cy) or math.sqrt(dx * dx + dy * dy) > radius:
                continue
            if n == 0:
                seen.add((cx, cy))
                continue
            east = abs(dx) >= abs(dy)
            main, j = (dx, dy) if east else (dy, dx)
            p = math.floor(j * reach / n + 0.5)
            horizon = -math.inf
            for k in range(1, n):
                m = p * k / reach
                lo = math.floor(m)
                ends = [(x + int(math.copysign(k, main)), y + lo + d) if east else (x + lo + d, y + int(math.copysign(k, main))) for d in (0, 1)]
                if not inside(*ends[0]) or m > lo and not inside(*ends[1]):
                    continue
                a = h[ends[0][1], ends[0][0]]
                z = a + (h[ends[1][1], ends[1][0]] - a) * (m - lo) if m > lo else a
                horizon = max(horizon, (z - base) / math.sqrt(k * k + m * m))
            if (h[cy, cx] - base) / math.sqrt(dx * dx + dy * dy) >= horizon:
                seen.add((cx, cy))
    return seen


def tiles_of(spark, h, width, height, missing=()):
    rows = [(tx, ty, h[ty * height : (ty + 1) * height, tx * width : (tx + 1) * width].ravel().tolist()) for ty in range(h.shape[0] // height) for tx in range(h.shape[1] // width) if (tx, ty) not in missing]
    return spark.createDataFrame(rows, "tx int, ty int, pixels array<double>").repartition(3)


@pytest.mark.parametrize("width, height, missing", [(7, 5, ()), (35, 30, ()), (5, 6, ((2, 2), (0, 4)))])
def test_every_cell(spark, width, height, missing):
    rng = np.random.default_rng(5)
    h = np.round(rng.random((30, 35)) * 40 + 30 * np.sin(np.arange(35) / 5))
    h[rng.random(h.shape) < 0.03] = np.nan
    for tx, ty in missing:
        h[ty * height : (ty + 1) * height, tx * width : (tx + 1) * width] = np.nan
    # In the middle, at edges of tiles and of the raster, over nodata, outside.
    eyes = [(i, int(x), int(y), 6.0, r) for i, (x, y, r) in enumerate([(17, 15, 12.5), (6, 4, 9.0), (7, 5, 40.0), (0, 0, 60.0), (34, 29, 7.3), (20, 0, 1.0), (13, 29, 25.0)])]
    dark = tuple(int(v[0]) for v in np.nonzero(np.isnan(h)))
    eyes += [(90, dark[1], dark[0], 5.0, 9.0), (91, -3, 4, 5.0, 9.0), (92, 300, 4, 5.0, 9.0)]
    got = viewshed.viewsheds(tiles_of(spark, h, width, height, missing), spark.createDataFrame(eyes, "observer long, x int, y int, eye double, radius double"), width, height).collect()
    seen = {}
    for r in got:
        cells = np.flatnonzero(r.visible)
        seen.setdefault(r.observer, set()).update((r.tx * width + c % width, r.ty * height + c // width) for c in cells.tolist())
    for i, x, y, eye, radius in eyes[:7]:
        if not np.isnan(h[y, x]):
            assert seen[i] == brute(h, x, y, eye, radius), i
    assert not {90, 91, 92} & set(seen)


def test_wall_hides_the_next_tiles(spark):
    h = np.zeros((8, 32))
    h[:, 9] = 100
    h[3, 30] = 500
    got = viewshed.viewsheds(tiles_of(spark, h, 8, 8), spark.createDataFrame([("eye", 1, 3, 2.0, 30.0)], "observer string, x int, y int, eye double, radius double"), 8, 8)
    seen = {r.tx * 8 + c % 8 + 100 * (c // 8) for r in got.collect() for c in np.flatnonzero(r.visible).tolist()}
    # The wall itself and the tower behind it, nothing else east of the wall.
    assert {c % 100 for c in seen} == {*range(10), 30} and 330 in seen


def test_empty_tables(spark):
    eyes = spark.createDataFrame([(1, 0, 0, 1.0, 5.0)], "observer long, x int, y int, eye double, radius double")
    none = tiles_of(spark, np.zeros((4, 4)), 4, 4).filter("tx > 5")
    assert viewshed.viewsheds(none, eyes, 4, 4).count() == 0
    assert viewshed.viewsheds(tiles_of(spark, np.zeros((4, 4)), 4, 4), eyes.filter("observer > 5"), 4, 4).count() == 0
