"""Operators on row-major pixel arrays and grids; each reads its own row only, without a shuffle, but for a grid's pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share_equal(pixels: str, at: Column, shift: int) -> Column:
    """Share of the positions `at` whose pixel equals the one `shift` further; 0 without positions."""
    same = F.filter(at, lambda i: F.get(F.col(pixels), i).eqNullSafe(F.get(F.col(pixels), i + shift)))
    return F.when(F.size(at) > 0, F.size(same) / F.size(at)).otherwise(0.0)


def lattice(width: int, xs: range, ys: range) -> Column:
    """Positions of a lattice as a constant array."""
    return F.array(*[F.lit(y * width + x) for y in ys for x in xs]) if len(xs) and len(ys) else F.array().cast("array<int>")


def mirror_scores(tiles: DataFrame, pixels: str, width: int, height: int) -> DataFrame:
    """How far the lower half repeats the upper one, and the right half the left one above and below."""
    h2, w2 = height // 2, width // 2
    step = max(1, width // 24)
    inner = max(1, w2 // 12)
    xs, ys = range(inner, w2 - inner, inner), range(inner, h2 - inner, inner)
    return tiles.withColumns({
        "vertical": share_equal(pixels, lattice(width, range(0, width, step), range(0, h2, step)), h2 * width),
        "top": share_equal(pixels, lattice(width, xs, ys), w2),
        "bottom": share_equal(pixels, lattice(width, xs, range(h2 + ys.start, h2 + ys.stop, inner)), w2),
    })


def repair_choice(quality: Column) -> Column:
    """What mirror_scores() call for: the top left quadrant, the top half, or nothing."""
    both = (F.col("top") > 0.75) & (F.col("bottom") > 0.75)
    weak = (quality >= 0.5) & ((F.col("top") > 0.75) | (F.col("bottom") > 0.75) | (F.col("vertical") > 0.55))
    return F.when(both, "quadrant").when(F.col("vertical") > 0.75, "half").when(weak, "quadrant").otherwise("none")


def resample(tiles: DataFrame, pixels: str, source: tuple[int, int], target: tuple[int, int], bilinear: bool) -> DataFrame:
    """tiles with (pos, v): pixels of the target size (width, height), nearest or interpolated."""
    (sw, sh), (tw, th) = source, target
    out = tiles.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(tw * th - 1))))
    fx = (F.col("pos") % tw) * F.lit(float(sw - 1)) / F.lit(float(max(1, tw - 1)))
    fy = F.floor(F.col("pos") / tw) * F.lit(float(sh - 1)) / F.lit(float(max(1, th - 1)))
    px = lambda x, y: F.get(F.col(pixels), (y * sw + x).cast("int")).cast("double")
    if not bilinear:
        return out.withColumn("v", px(F.least(F.floor(fx + 0.5), F.lit(sw - 1)), F.least(F.floor(fy + 0.5), F.lit(sh - 1))))
    x0, y0 = F.floor(fx), F.floor(fy)
    x1, y1 = F.least(x0 + 1, F.lit(sw - 1)), F.least(y0 + 1, F.lit(sh - 1))
    above = px(x0, y0) + (px(x1, y0) - px(x0, y0)) * (fx - x0)
    below = px(x0, y1) + (px(x1, y1) - px(x0, y1)) * (fx - x0)
    return out.withColumn("v", above + (below - above) * (fy - y0))


def expand(pixels: Column, width: int, source: tuple[int, int], target: tuple[int, int]) -> Column:
    """The upper left source (width, height) of a raster, interpolated to the target size, as an array."""
    (sw, sh), (tw, th) = source, target
    px = lambda x, y: F.get(pixels, (y * width + x).cast("int")).cast("double")

    def at(pos: Column) -> Column:
        fx = (pos % tw) * F.lit(float(sw - 1)) / F.lit(float(max(1, tw - 1)))
        fy = F.floor(pos / tw) * F.lit(float(sh - 1)) / F.lit(float(max(1, th - 1)))
        x0, y0 = F.floor(fx), F.floor(fy)
        x1, y1 = F.least(x0 + 1, F.lit(sw - 1)), F.least(y0 + 1, F.lit(sh - 1))
        # Each corner by its own distances, summed from the last to the first, so that results equal the SQL's to the last bit.
        near = lambda f, k: 1 - F.abs(k - f)
        one = lambda x, y, i, j: px(x, y) * near(fx, i) * near(fy, j)
        return one(x1, y1, x0 + 1, y0 + 1) + one(x0, y1, x0, y0 + 1) + one(x1, y0, x0 + 1, y0) + one(x0, y0, x0, y0)

    return F.transform(F.sequence(F.lit(0), F.lit(tw * th - 1)), at)


def repaired(tiles: DataFrame, pixels: str, width: int, height: int, quality: Column) -> DataFrame:
    """tiles with their pixels mended as repair_choice() says: the quadrant or half that isn't a copy fills the tile."""
    out = mirror_scores(tiles, pixels, width, height).withColumn("repair", repair_choice(quality))
    whole = F.col(pixels)
    mended = F.when(F.col("repair") == "quadrant", expand(whole, width, (width // 2, height // 2), (width, height))).when(F.col("repair") == "half", expand(whole, width, (width, height // 2), (width, height)))
    return out.withColumn(pixels, mended.otherwise(F.transform(whole, lambda v: v.cast("double")))).drop("vertical", "top", "bottom")


def slopes(pixels: str, width: int) -> Column:
    """(dx, dy) of every pixel: change of height to the right and to the next row; null at the edge."""
    px = F.col(pixels)
    rise = lambda v, i, shift: F.get(px, i + shift).cast("double") - v.cast("double")
    return F.transform(px, lambda v, i: F.struct(F.when((i + 1) % width != 0, rise(v, i, 1)).alias("dx"), rise(v, i, width).alias("dy")))


def steepness(pixels: str, width: int) -> Column:
    """Steepness of every pixel from its slopes(): their length over the root of 2."""
    return F.transform(slopes(pixels, width), lambda s: F.sqrt(s["dx"] * s["dx"] + s["dy"] * s["dy"]) * F.lit(0.70710678118654757))


def normals(pixels: str, width: int, spacing: float = 1.0) -> Column:
    """Unit normal of the surface at every pixel, from its slopes(); null at the edge."""

    def normal(s: Column) -> Column:
        gx, gy = s["dx"] / spacing, s["dy"] / spacing
        size = F.sqrt(gx * gx + gy * gy + 1)
        return F.when(size.isNotNull(), F.struct((-gx / size).alias("x"), (-gy / size).alias("y"), (1 / size).alias("z")))

    return F.transform(slopes(pixels, width), normal)


def nodata_clean(tiles: DataFrame, pixels: str, limit: float, fill: float) -> DataFrame:
    """Tiles with any valid sample, their samples above the limit set to fill."""
    return tiles.filter(F.exists(pixels, lambda v: v < limit)).withColumn(pixels, F.transform(pixels, lambda v: F.when(v > limit, F.lit(fill)).otherwise(v)))


def height_range(pixels: str, samples: int = 5000) -> Column:
    """(low, high) of the sampled valid heights; (0, 1) where there is none or no span."""
    step = F.greatest(F.floor(F.size(pixels) / samples), F.lit(1))
    valid = F.filter(pixels, lambda v, i: (i % step == 0) & ~F.isnan(v) & (v > -199) & (v < 3000))
    low, high = F.array_min(valid), F.array_max(valid)
    return F.when(high > low, F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"))).otherwise(F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")))


def grid_triangles(grids: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Two triangles for each cell of each vertex grid, vertices numbered height * x + y; both hold the cell's first and last corner.

    tid numbers a grid's triangles, down its columns of cells; grids of fewer
    than two vertices a side have none.
    """
    w, h = F.col(width), F.col(height)
    cell = grids.filter((w > 1) & (h > 1)).withColumn("_id", F.explode(F.sequence(F.lit(0).cast("long"), ((w - 1) * (h - 1) - 1).cast("long"))))
    a = F.floor(F.col("_id") / (h - 1)) * h + F.col("_id") % (h - 1)
    corner = lambda t, p, q, r: F.struct((F.col("_id") * 2 + t).alias("tid"), p.alias("a"), q.alias("b"), r.alias("c"))
    two = F.array(corner(0, a, a + h, a + h + 1), corner(1, a, a + h + 1, a + 1))
    return cell.select(*grids.columns, F.inline(two))


def reversed_winding(triangles: DataFrame) -> DataFrame:
    """Triangles (a, b, c) that face the other way."""
    return triangles.withColumns({"a": F.col("c"), "c": F.col("a")})


def cells(areas: DataFrame, size: int) -> DataFrame:
    """Corners (east, north) of the grid cells of each area (first_column, columns, first_row, rows)."""
    run = lambda first, n: F.explode(F.transform(F.sequence(F.col(first), F.col(first) + F.col(n) - 1), lambda i: i * size))
    others = [c for c in areas.columns if c not in ("first_column", "columns", "first_row", "rows")]
    some = areas.filter("columns > 0 AND rows > 0")
    return some.withColumn("east", run("first_column", "columns")).withColumn("north", run("first_row", "rows")).select(*others, "east", "north")


def windows(rasters: DataFrame, size: int) -> DataFrame:
    """(x, y, left, top, right, bottom) of the whole windows of each raster (width, height)."""
    whole = lambda c: F.floor(F.col(c) / size).cast("int")
    areas = rasters.withColumns({"first_column": F.lit(0), "first_row": F.lit(0), "columns": whole("width"), "rows": whole("height")})
    found = cells(areas, size).withColumnsRenamed({"east": "left", "north": "top"})
    return found.withColumns({"x": F.floor(F.col("left") / size).cast("int"), "y": F.floor(F.col("top") / size).cast("int"), "right": F.col("left") + size, "bottom": F.col("top") + size})


def lod_levels(tiles: DataFrame, levels: int = 12, size: int = 4096) -> DataFrame:
    """Each tile at every level of detail: vertices a side, spacing, and level as a share."""
    out = tiles.withColumn("lod", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    width = F.floor(F.lit(size) / F.pow(F.lit(2.0), F.col("lod"))).cast("int")
    return out.withColumns({"width": width, "eps": 1 / (width - 1).cast("double"), "lod_share": F.col("lod") / F.lit(float(levels))})
