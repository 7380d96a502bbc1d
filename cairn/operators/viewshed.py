"""View sheds over a raster of tiles: which cells each of many eyes sees, within radii that cross any number of tiles.

Rays run from an eye's cell to every cell on the edge of the square of its
radius.  Step k of a ray lies k cells off on its main axis, between two cells
on the other; its height is interpolated there.  A cell is seen if its slope
from the eye is not below that of any nearer step of the ray that passes it
closest.  A step belongs to the tile of its nearest cell, so a ray crosses a
tile in one run of steps, and maxima can be taken in two levels:

1. each (eye, tile) pair gives the steepest step of each ray within the tile;
2. a window over the few tiles of a ray gives the horizon with which it enters
   each of them;
3. each pair walks its rays again from these horizons and marks its cells.

Tiles don't wait for each other, and no task holds more than one tile with the
edge cells of its four neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Directions of the main axis: east, west, south, north (rows of a raster count downwards).
SIDES = ((1, 0), (-1, 0), (0, 1), (0, -1))


def with_halo(tiles: DataFrame, width: int, height: int) -> DataFrame:
    """tiles (tx, ty, pixels) with the cells of their neighbours along the edges: _west, _east (columns), _north, _south (rows), _corner (one cell, south-east); null where there is no tile."""
    column = lambda x: F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: F.get("pixels", y * width + x))
    sent = [("_west", 1, 0, column(width - 1)), ("_east", -1, 0, column(0)), ("_north", 0, 1, F.slice("pixels", (height - 1) * width + 1, width)), ("_south", 0, -1, F.slice("pixels", 1, width)), ("_corner", -1, -1, F.slice("pixels", 1, 1))]
    edges = F.inline(F.array(*[F.struct((F.col("tx") + dx).alias("tx"), (F.col("ty") + dy).alias("ty"), F.lit(name).alias("edge"), cells.alias("cells")) for name, dx, dy, cells in sent]))
    halo = tiles.select(edges).groupBy("tx", "ty").agg(*[F.max(F.when(F.col("edge") == name, F.col("cells"))).alias(name) for name, *_ in sent])
    return tiles.join(halo, ["tx", "ty"], "left")


def padded(row: dict, width: int, height: int) -> np.ndarray:
    """A tile's heights with a border of one cell; NaN where there are none."""
    out = np.full((height + 2, width + 2), np.nan)
    for place, cells in (((slice(1, -1), slice(1, -1)), row["pixels"]), ((slice(1, -1), 0), row["_west"]), ((slice(1, -1), -1), row["_east"]), ((0, slice(1, -1)), row["_north"]), ((-1, slice(1, -1)), row["_south"])):
        if cells is not None:
            out[place] = cells.reshape(out[place].shape)
    return out


def walk(cells: np.ndarray, west: int, north: int, reach: int, base: float, entering: dict[int, np.ndarray] | None, radius: float) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Rays of an eye through one tile.

    cells: the tile with its border; its first cell lies at (west, north) from
    the eye; base: height of the eye.  entering: by side, the horizon of each
    ray (-reach .. reach); None: nothing.  Gives by side the first step of each
    ray within the tile (0: none) and its steepest step, and the cells seen.
    """
    height, width = cells.shape[0] - 2, cells.shape[1] - 2
    seen = np.zeros((height, width), bool)
    if west <= 0 < west + width and north <= 0 < north + height:
        seen[-north, -west] = True
    rays, found = np.arange(-reach, reach + 1), {}
    for side, (ex, ey) in enumerate(SIDES):
        # The tile turned so that rays go along its second axis.
        grid = cells if ex else cells.T
        main, other, length, span = (west, north, width, height) if ex else (north, west, height, width)
        sign = ex + ey
        low, high = max(1, main if sign > 0 else -(main + length - 1)), min(reach, main + length - 1 if sign > 0 else -main)
        if low > high or other > high or other + span - 1 < -high:
            continue
        first, peak = np.zeros(len(rays), np.int32), np.full(len(rays), -np.inf)
        horizon = np.full(len(rays), -np.inf) if entering is None else entering.get(side, np.full(len(rays), -np.inf)).copy()
        for k in range(low, high + 1):
            line = grid[:, sign * k - main + 1]
            # Cells at this step, by the ray that passes closest; corners belong to rays east and west.
            if entering is not None:
                most = k if ex else k - 1
                j = np.arange(max(other, -most), min(other + span - 1, most) + 1)
                if len(j):
                    nearest = np.floor(j * reach / k + 0.5).astype(np.int64)
                    far = np.sqrt(np.float64(k * k) + j * j)
                    mine = line[j - other + 1]
                    ok = ((mine - base) / far >= horizon[nearest + reach]) & (far <= radius)
                    if ex:
                        seen[j - other, sign * k - main] = ok
                    else:
                        seen[sign * k - main, j - other] = ok
            at = rays * k / reach
            place = np.floor(at + 0.5).astype(np.int64)
            mine = (place >= other) & (place < other + span)
            at, lower = at[mine], np.floor(at[mine]).astype(np.int64)
            share = at - lower
            a = line[lower - other + 1]
            b = line[np.minimum(lower - other + 2, span + 1)]
            z = np.where(share > 0, a + (b - a) * share, a)
            slope = (z - base) / np.sqrt(np.float64(k * k) + at * at)
            slope = np.where(np.isnan(slope), -np.inf, slope)
            horizon[mine] = np.maximum(horizon[mine], slope)
            peak[mine] = np.maximum(peak[mine], slope)
            first[mine & (first == 0)] = k
        found[side] = (first, peak)
    return found, seen


def column(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray | None:
    """An array cell as numpy, by its flat values."""
    values = batch.column(batch.schema.get_field_index(name))[row]
    return np.asarray(values.values.to_numpy(zero_copy_only=False), float) if values.is_valid else None


def viewsheds(tiles: DataFrame, observers: DataFrame, width: int, height: int) -> DataFrame:
    """(observer, tx, ty, visible): for each eye and each tile that its radius reaches, a flag for each cell of the tile.

    tiles: (tx, ty, pixels), pixels row by row, NaN or null for nodata; cell
    (x, y) of the raster lies in tile (x div width, y div height).  observers:
    (observer, x, y, eye, radius), x and y in cells, eye over the ground, radius
    in cells, 1 at least.  An eye outside of the raster or over nodata gives no
    rows.  Nodata is not seen and hides nothing.  tiles is read three times
    and should be stored; the pairs of an eye with its tiles are few and small
    next to the tiles, and where one tile has very many eyes Spark's skew join
    deals them out.
    """
    pixels = F.transform("pixels", lambda v: v.cast("double"))
    tiles = tiles.select(F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), pixels.alias("pixels"))
    eyes = observers.select("observer", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("eye").cast("double").alias("eye"), F.col("radius").cast("double").alias("radius"), F.ceil("radius").cast("int").alias("reach"))
    tile = lambda c, size: F.floor(F.col(c) / size).cast("int")
    ground = F.get("pixels", F.pmod("y", F.lit(height)) * width + F.pmod("x", F.lit(width)))
    based = eyes.withColumns({"tx": tile("x", width), "ty": tile("y", height)}).join(tiles, ["tx", "ty"]).select("observer", "x", "y", "radius", "reach", (ground + F.col("eye")).alias("base"))
    based = based.filter(F.col("base").isNotNull() & ~F.isnan("base") & (F.col("reach") >= 1))
    reached = lambda c, size: F.explode(F.sequence(F.floor((F.col(c) - F.col("reach")) / size).cast("int"), F.floor((F.col(c) + F.col("reach")) / size).cast("int")))
    pairs = based.withColumn("tx", reached("x", width)).withColumn("ty", reached("y", height))
    asked = with_halo(tiles, width, height).join(pairs, ["tx", "ty"])
    key = observers.schema["observer"]

    def prepared(batch: pa.RecordBatch, i: int) -> tuple:
        row = {c: batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("observer", "tx", "ty", "x", "y", "radius", "reach", "base")}
        cells = padded({c: column(batch, c, i) for c in ("pixels", "_west", "_east", "_north", "_south")}, width, height)
        return row, cells, row["tx"] * width - row["x"], row["ty"] * height - row["y"]

    def horizons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, cells, west, north = prepared(batch, i)
                for side, (first, peak) in walk(cells, west, north, row["reach"], row["base"], None, row["radius"])[0].items():
                    rays = np.flatnonzero(first)
                    if len(rays):
                        same = lambda v, kind=None: pa.array([v], kind).take(pa.array(np.zeros(len(rays), np.int64)))
                        yield pa.RecordBatch.from_arrays([same(row["observer"], batch.schema.field("observer").type), same(row["tx"], pa.int32()), same(row["ty"], pa.int32()), same(side, pa.int32()), pa.array(rays.astype(np.int32)), pa.array(first[rays]), pa.array(peak[rays])], ["observer", "tx", "ty", "side", "ray", "first", "peak"])

    run_of = T.StructType([key, *T.StructType.fromDDL("tx int, ty int, side int, ray int, first int, peak double").fields])
    order = Window.partitionBy("observer", "side", "ray").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    entering = asked.mapInArrow(horizons, run_of).withColumn("horizon", F.max("peak").over(order)).filter("horizon IS NOT NULL AND horizon > double('-inf')")
    # One array of at most 8 * reach + 4 rays for each pair.
    entering = entering.groupBy("observer", "tx", "ty").agg(F.collect_list("side").alias("_side"), F.collect_list("ray").alias("_ray"), F.collect_list("horizon").alias("_horizon"))
    again = asked.join(entering, ["observer", "tx", "ty"], "left")

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row, cells, west, north = prepared(batch, i)
                enter = {}
                if (sides := column(batch, "_side", i)) is not None:
                    rays, values = column(batch, "_ray", i).astype(np.int64), column(batch, "_horizon", i)
                    for side in np.unique(sides).astype(int):
                        enter[side] = np.full(2 * row["reach"] + 1, -np.inf)
                        enter[side][rays[sides == side]] = values[sides == side]
                seen = walk(cells, west, north, row["reach"], row["base"], enter, row["radius"])[1].ravel()
                out.append(pa.array(seen))
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(out) if out else pa.array([], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in ("observer", "tx", "ty")], lists], ["observer", "tx", "ty", "visible"])

    result = T.StructType([key, *T.StructType.fromDDL("tx int, ty int, visible array<boolean>").fields])
    return again.mapInArrow(flags, result)
