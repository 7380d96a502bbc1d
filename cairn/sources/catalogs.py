"""Tile catalogs as JSON objects keyed "xll, yll": scan and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = "struct<xllcorner: double, yllcorner: double, nrows: int, ncols: int, source_filename: string, min_ele: double, max_ele: double, valid_percent: double, sources: map<string, string>>"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row for each tile, with its key."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, {TILE}>").alias("tiles"))
    return whole.select(F.explode("tiles").alias("key", "tile")).select("key", "tile.*")


def catalog_json(tiles: DataFrame) -> DataFrame:
    """A catalog (xllcorner, yllcorner, nrows, ncols, source_filename) as one JSON object, tiles in key order; for catalogs, which are small."""
    key = F.concat_ws(", ", F.col("xllcorner").cast("long").cast("string"), F.col("yllcorner").cast("long").cast("string"))
    entry = F.struct(key.alias("key"), F.struct("xllcorner", "yllcorner", "nrows", "ncols", "source_filename").alias("value"))
    return tiles.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))


def sidecars(tiles: DataFrame) -> DataFrame:
    """(name, value): the JSON of each tile, named after its file."""
    return tiles.select(F.concat(F.col("source_filename"), F.lit(".json")).alias("name"), F.to_json(F.struct("xllcorner", "yllcorner", "nrows", "ncols", "source_filename")).alias("value"))


def write_sidecars(tiles: DataFrame, path: str) -> None:
    """One folder of JSON for each tile, called <tile>.json."""
    sidecars(tiles).withColumnRenamed("name", "tile").write.partitionBy("tile").text(path)


TRACK = "id string, title string, region string, gpx_url string, colour int, height_offset double"


def track_catalog(lines: DataFrame, text: str = "value") -> DataFrame:
    """(id, title, region, gpx_url, colour, height_offset) of track catalogs as text: an object a line, or an array of them; what is neither has no rows."""
    several = F.from_json(F.col(text), f"array<struct<{TRACK}>>")  # an object alone counts as an array of one
    return lines.select(F.explode(several).alias("t")).select("t.*").filter("id IS NOT NULL")
