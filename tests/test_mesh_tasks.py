"""Cells of a mesh are dealt to several tasks and meshed once; the order of points follows the shape of the cloud."""

import numpy as np
from cairn.operators import mesh


def test_cells_are_meshed_once_in_several_tasks(spark):
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(f"c{k}", i, float(x), float(y)) for k in range(12) for i, (x, y) in enumerate(rng.random((30, 2)))], "cell string, vid long, x double, y double")
    got = mesh.triangulate(points)
    # What was meshed lies in the shared folder, a file for each task that had cells.
    assert len(got.inputFiles()) > 1
    rows = got.collect()
    assert len({r.cell for r in rows}) == 12 and len({(r.cell, r.tid) for r in rows}) == len(rows)


def test_snake_follows_the_cloud():
    """In a strip of a cell, and in a flat cloud, steps from point to point are as short as in a square."""
    rng = np.random.default_rng(6)
    for wide, high in ((mesh.STEPS, mesh.STEPS), (mesh.STEPS // 256, mesh.STEPS), (mesh.STEPS, 500)):
        xy = np.stack([rng.integers(0, wide, 4000), rng.integers(0, high, 4000)], 1)
        order = mesh.snake(xy)
        steps = np.hypot(*np.diff(xy[order], axis=0).T)
        assert sorted(order) == list(range(4000)) and np.median(steps) < 3 * max(np.sqrt(wide * high / 4000), wide / 4000)


def test_flat_lattices_are_filled():
    """Euler: 2n - 2 - h triangles of n points, h of them on the hull."""
    x, y = np.arange(600.0) % 200 * 1000, np.arange(600.0) // 200
    assert len(mesh.triangles(x, y)) == 2 * 600 - 2 - 402
