"""Operators that match points with grid cells, and selections with catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scalars import cell_corner


def cell_lookup(points: DataFrame, catalog: DataFrame, origin: tuple[float, float], size: float) -> DataFrame:
    """points (east, north) with the catalog row of their cell, or nulls: an equi-join on the cell's corner.

    Catalyst broadcasts the catalog where its size is known to be small.
    """
    keyed = points.withColumns({"xll": cell_corner(F.col("east"), origin[0], size), "yll": cell_corner(F.col("north"), origin[1], size)})
    return keyed.join(catalog, ["xll", "yll"], "left")


def selected(catalog: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return catalog.join(ids, key, "left_semi")


def sync_difference(loaded: DataFrame, desired: DataFrame, key: str) -> DataFrame:
    """Keys to add and to remove so that loaded becomes desired."""
    add = desired.select(key).distinct().join(loaded, key, "left_anti").withColumn("action", F.lit("add"))
    return add.unionByName(loaded.select(key).distinct().join(desired, key, "left_anti").withColumn("action", F.lit("remove")))


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in just one of both: toggling the members b of a set a."""
    return sync_difference(a, b, key).select(key)


def best_source(sources: Column, fallback: Column, order: tuple[str, ...] = ("2000", "1000", "500")) -> Column:
    """The first non-empty file among the resolutions in order, else the fallback."""
    return F.coalesce(*[F.nullif(F.element_at(sources, F.lit(k)), F.lit("")) for k in order], fallback)


def tile_window(name: Column, size: int = 4096) -> Column:
    """Pixels (left, top, right, bottom) of a tile named xxx_yyy."""
    x, y = F.substring(name, 1, 3).cast("int") * size, F.substring(name, 5, 3).cast("int") * size
    return F.struct(x.alias("left"), y.alias("top"), (x + size).alias("right"), (y + size).alias("bottom"))


def window_corner(window: Column, left: float, bottom: float, pixel: float = 10.0) -> tuple[Column, Column]:
    """Lower left corner of a window in a raster whose box begins at left and whose rows count from bottom upwards."""
    return window["left"] * pixel + left, bottom - window["bottom"] * pixel


def not_yet_made(wanted: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """The rows of wanted whose key begins no name of made (a column `name`): work that is still to do.

    Names hold the key up to the last part, _min..., so equal keys meet in an
    anti-join.
    """
    done = made.select(F.regexp_replace("name", r"_min.*$", "").alias(key)).distinct()
    return wanted.join(done, key, "left_anti")


def visible(tiles: DataFrame, *flags: str) -> DataFrame:
    """tiles of which all flags hold; a missing flag doesn't."""
    for flag in flags:
        tiles = tiles.filter(F.coalesce(F.col(flag), F.lit(False)))
    return tiles


def as_tracks(catalog: DataFrame) -> DataFrame:
    """What a track catalog says to draw: url, colour, height offset."""
    return catalog.select(F.col("gpx_url").alias("url"), "colour", "height_offset")


def nearest_observer(tiles: DataFrame, observers: DataFrame, radius: float, cell: float | None = None) -> DataFrame:
    """tiles (tile, east, north, camera_distance) with lod_distance: that of the nearest observer within radius if it is less.

    Observers are dealt to the cells of a grid that their radius reaches, and
    tiles meet those of their own cell by an equi-join.
    """
    size = cell or radius
    near = observers.select(F.col("east").alias("_e"), F.col("north").alias("_n"))
    reach = lambda c: F.explode(F.sequence(F.floor((c - radius) / size), F.floor((c + radius) / size)))
    dealt = near.withColumn("_ce", reach(F.col("_e"))).withColumn("_cn", reach(F.col("_n")))
    keyed = tiles.withColumns({"_ce": F.floor(F.col("east") / size), "_cn": F.floor(F.col("north") / size)})
    far = F.hypot(F.col("east") - F.col("_e"), F.col("north") - F.col("_n"))
    met = keyed.join(dealt, ["_ce", "_cn"]).withColumn("_far", far).filter(F.col("_far") <= radius).groupBy("tile").agg(F.min("_far").alias("_far"))
    return tiles.join(met, "tile", "left").withColumn("lod_distance", F.least("camera_distance", F.col("_far"))).drop("_far")


def lod_table(levels: DataFrame) -> DataFrame:
    """Levels of detail (distance, insert_ix, ...) in the order they were put in: by distance, the earlier of ties first, numbered from 0.

    A table of a dozen rows.
    """
    return levels.withColumn("level", F.row_number().over(Window.orderBy(F.abs("distance"), "insert_ix")) - 1)


def tile_corner(name: Column, origin: tuple[int, int] = (80000, 624040), size: int = 40960) -> tuple[Column, Column]:
    """Lower left corner of a tile named xxx_yyy: columns count from the west, rows from the north."""
    return origin[0] + F.substring(name, 1, 3).cast("int") * size, origin[1] - F.substring(name, 5, 3).cast("int") * size
