"""Picking: where rays first meet the ground, exactly.

The ground is a raster of samples at whole places, in tiles; between four
samples it is bilinear, so a ray meets it where a quadratic has a root.  Rays
go down a pyramid of highest samples: blocks of tiles, then tiles.  At each
level a ray is cut at the level's grid lines into stretches, which meet their
block by an equi-join and go on only where they come down to its highest
sample.  What is left meets the tiles' samples, a row for a tile and some
hundred rays, and the earliest root of a ray is its hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators.viewshed import column, with_halo

#: Rays in a row with the samples of a tile, on average.
TOGETHER = 500


def stretches(rays: DataFrame, width: float, height: float) -> DataFrame:
    """rays (x, y, vx, vy, from, to, ...) cut at the lines of a grid: a row for each cell (bx, by) on the way, with its own from and to."""

    def lines(at: str, speed: str, size: float) -> Column:
        # Times at which the ray crosses the lines strictly inside of its stretch.
        a, b = (F.col(at) + F.col(speed) * F.col("from")) / size, (F.col(at) + F.col(speed) * F.col("to")) / size
        first, last = F.floor(F.least(a, b)).cast("int") + 1, F.ceil(F.greatest(a, b)).cast("int") - 1
        times = F.transform(F.sequence(first, last), lambda k: (k * F.lit(float(size)) - F.col(at)) / F.col(speed))
        return F.when((F.col(speed) != 0) & (first <= last), times).otherwise(F.array().cast("array<double>"))

    cuts = F.array_sort(F.concat(F.array("from"), lines("x", "vx", width), lines("y", "vy", height), F.array("to")))
    pieces = F.inline(F.arrays_zip(F.slice("_cuts", F.lit(1), F.size("_cuts") - 1).alias("_a"), F.slice("_cuts", F.lit(2), F.size("_cuts") - 1).alias("_b")))
    others = [c for c in rays.columns if c not in ("from", "to", "bx", "by")]
    cut = rays.withColumn("_cuts", cuts).select(*others, pieces)
    middle = lambda at, speed, size: F.floor((F.col(at) + F.col(speed) * (F.col("_a") + F.col("_b")) / 2) / size).cast("int")
    return cut.select(*others, F.col("_a").alias("from"), F.col("_b").alias("to"), middle("x", "vx", width).alias("bx"), middle("y", "vy", height).alias("by"))


def first_hit(grid: np.ndarray, ray: np.ndarray, start: float, end: float, slack: float = 1e-9) -> float | None:
    """The first time in start .. end at which a ray (x, y, z, vx, vy, vz) is not above the bilinear ground of a grid of samples; None if there is none.

    A root may lie outside of its cell by slack * (1 + time), which is rounding.
    """
    x, y, z, vx, vy, vz = ray
    times = [np.array([start, end])]
    for at, speed in ((x, vx), (y, vy)):
        if speed:
            low, high = sorted((at + speed * start, at + speed * end))
            times.append((np.arange(np.floor(low) + 1, np.ceil(high)) - at) / speed)
    times = np.sort(np.clip(np.concatenate(times), start, end))
    a, b = times[:-1], times[1:]
    middle = (a + b) / 2
    i = np.clip(np.floor(x + vx * middle).astype(int), 0, grid.shape[1] - 2)
    j = np.clip(np.floor(y + vy * middle).astype(int), 0, grid.shape[0] - 2)
    corners = np.stack([grid[j, i], grid[j, i + 1], grid[j + 1, i], grid[j + 1, i + 1]])
    low = np.flatnonzero(np.minimum(z + vz * a, z + vz * b) <= corners.max(axis=0))  # NaN: no ground
    if not len(low):
        return None
    a, b, (h, hx, hy, hxy) = a[low], b[low], corners[:, low]
    u, v, bend = x - i[low], y - j[low], h - hx - hy + corners[3, low]
    # Height of the ray over the ground: p t^2 + q t + r.
    p = -bend * vx * vy
    q = vz - (hx - h) * vx - (hy - h) * vy - bend * (u * vy + v * vx)
    r = z - h - (hx - h) * u - (hy - h) * v - bend * u * v
    below = (p * a + q) * a + r <= 0
    with np.errstate(divide="ignore", invalid="ignore"):
        s = -0.5 * (q + np.where(q < 0, -1, 1) * np.sqrt(q * q - 4 * p * r))
        roots = np.stack([np.where(p != 0, s / p, np.nan), np.where(s != 0, r / s, np.nan)])
    over = slack * (1 + np.abs(b))
    roots = np.where((roots >= a - over) & (roots <= b + over), np.clip(roots, a, b), np.inf)
    hit = np.where(below, a, roots.min(axis=0)).min()
    return float(hit) if np.isfinite(hit) else None


def terrain_picks(rays: DataFrame, tiles: DataFrame, width: int, height: int, far: float, blocks: tuple[int, ...] = (8,), slack: float = 1e-9) -> DataFrame:
    """rays (ray, x, y, z, vx, vy, vz) with t, hit_x, hit_y, hit_z and reason (`hit` or `empty-pixel`): the first point of t = 0 .. far that is not above the ground.

    x and y in samples, z as the heights; tiles: (tx, ty, pixels), samples row
    by row, NaN or null for nodata; sample (x, y) lies in tile (x div width, y
    div height).  blocks: sizes of the pyramid's blocks over single tiles, in
    tiles, falling.  There is no ground next to nodata and beyond the last
    samples.  Rays with a null part, and those that stay above, have nulls;
    ray is a key.  A ray that starts below the ground is hit at 0.  slack: by how
    much of its time a root may miss its cell; with 0 a ray that only touches the
    ground on a line between cells is hit or not as rounding has it.
    """
    tiles = with_halo(tiles.select(F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), F.transform("pixels", lambda v: v.cast("double")).alias("pixels")), width, height)
    cells = [F.col("pixels"), *[F.coalesce(c, F.array().cast("array<double>")) for c in ("_east", "_south", "_corner")]]
    highest = tiles.select("tx", "ty", F.array_max(F.filter(F.concat(*cells), lambda v: ~F.isnan(v))).alias("_high")).filter("_high IS NOT NULL")
    parts = [F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")]
    left = rays.select("ray", *parts).dropna().withColumns({"from": F.lit(0.0), "to": F.lit(float(far))})
    for size in (*blocks, 1):
        level = highest.groupBy(F.floor(F.col("tx") / size).cast("int").alias("bx"), F.floor(F.col("ty") / size).cast("int").alias("by")).agg(F.max("_high").alias("_high"))
        low = F.least(F.col("z") + F.col("vz") * F.col("from"), F.col("z") + F.col("vz") * F.col("to"))
        left = stretches(left, size * width, size * height).join(level, ["bx", "by"]).filter(low <= F.col("_high")).drop("_high")
    left = left.withColumnsRenamed({"bx": "tx", "by": "ty"})
    shares = left.groupBy("tx", "ty").agg(F.ceil(F.count("*") / TOGETHER).alias("_shares"))
    share = F.pmod(F.xxhash64("ray"), F.col("_shares")).alias("_share")
    asked = left.join(shares, ["tx", "ty"]).groupBy("tx", "ty", share).agg(F.collect_list(F.struct("ray", "x", "y", "z", "vx", "vy", "vz", "from", "to")).alias("_rays"))
    met = tiles.join(asked.drop("_share"), ["tx", "ty"])
    key = rays.schema["ray"]

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                tx, ty = (batch.column(batch.schema.get_field_index(c))[n].as_py() for c in ("tx", "ty"))
                grid = np.full((height + 1, width + 1), np.nan)
                for place, name in (((slice(-1), slice(-1)), "pixels"), ((slice(-1), -1), "_east"), ((-1, slice(-1)), "_south"), ((slice(-1, None), slice(-1, None)), "_corner")):
                    if (found := column(batch, name, n)) is not None:
                        grid[place] = found.reshape(grid[place].shape)
                listed = batch.column(batch.schema.get_field_index("_rays"))[n].values
                numbers = np.stack([listed.field(c).to_numpy() for c in ("x", "y", "z", "vx", "vy", "vz", "from", "to")], 1)
                numbers[:, 0] -= tx * width
                numbers[:, 1] -= ty * height
                times = pa.array([first_hit(grid, r[:6], r[6], r[7], slack) for r in numbers], pa.float64())
                yield pa.RecordBatch.from_arrays([listed.field("ray"), times], ["ray", "t"])

    first = met.mapInArrow(hits, T.StructType([key, T.StructField("t", T.DoubleType())])).groupBy("ray").agg(F.min("t").alias("t"))
    out = rays.join(first, "ray", "left")
    point = [(F.col(c) + F.col(f"v{c}") * F.col("t")).alias(f"hit_{c}") for c in "xyz"]
    return out.select(*[out[c] for c in rays.columns], "t", *point, F.when(F.col("t").isNotNull(), "hit").otherwise("empty-pixel").alias("reason"))
