"""GPX tracks and routes, from files by Spark's XML reader or from a column of text, with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "array<struct<_lat: double, _lon: double, ele: double, time: timestamp, name: string, desc: string>>"
SCHEMA = f"""_creator string, metadata struct<name: string, time: timestamp>,
    trk array<struct<name: string, trkseg: array<struct<trkpt: {POINT}>>>>, rte array<struct<name: string, rtept: {POINT}>>"""


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document, with its path as `doc`."""
    return spark.read.format("xml").option("rowTag", "gpx").schema(SCHEMA).load(path).withColumn("doc", F.input_file_name())


def parse_gpx(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """The same from a table of documents as text; doc names them."""
    parsed = F.from_xml(F.col(text), SCHEMA, {"rowTag": "gpx"})
    return docs.select(F.col(doc).alias("doc"), parsed.alias("_g")).select("doc", "_g.*")


def with_tracks(gpx: DataFrame) -> DataFrame:
    """gpx; reading a document without any track or route fails."""
    checked = F.when(F.coalesce(F.size("trk"), F.lit(0)) + F.coalesce(F.size("rte"), F.lit(0)) > 0, F.col("trk")).otherwise(F.raise_error(F.concat(F.lit("no track or route in "), F.col("doc").cast("string"))))
    return gpx.withColumn("trk", checked)


def track_points(gpx: DataFrame) -> DataFrame:
    """(doc, kind, segment_ix, point_ix, lat, lon, ele, ts, name, description): track points, or route points where a document has no track.

    Segments count through all tracks of a document.  A route has no clock: its points are a millisecond apart.
    """
    track = F.flatten(F.transform("trk", lambda t: F.transform(F.coalesce(t["trkseg"], F.array()), lambda s: s["trkpt"])))
    route = F.transform("rte", lambda r: r["rtept"])
    kind = F.when(F.col("trk").isNotNull(), "track").otherwise("route")
    segments = gpx.select("doc", kind.alias("kind"), F.posexplode(F.coalesce(track, route)).alias("segment_ix", "points"))
    p = segments.select("doc", "kind", "segment_ix", F.posexplode("points").alias("point_ix", "p"))
    clock = F.when(F.col("kind") == "route", F.timestamp_millis(F.col("point_ix").cast("long"))).otherwise(F.col("p.time"))
    return p.select("doc", "kind", "segment_ix", "point_ix", F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), "p.ele", clock.alias("ts"), "p.name", F.col("p.desc").alias("description"))


def metadata(gpx: DataFrame) -> DataFrame:
    """Creator, and the first name and time that stand anywhere in each document: its own, else of a track or a point, tracks before routes."""
    points = lambda parts: F.flatten(F.transform(parts, lambda s: F.coalesce(s, F.array().cast(POINT))))
    segments = F.flatten(F.transform("trk", lambda t: F.transform(F.coalesce(t["trkseg"], F.array()), lambda s: s["trkpt"])))
    in_tracks, in_routes = points(segments), points(F.transform("rte", lambda r: r["rtept"]))
    first = lambda values: F.get(F.array_compact(values), F.lit(0))
    of_points = lambda parts, field: first(F.transform(parts, lambda p: p[field]))
    names = [first(F.transform("trk", lambda t: t["name"])), of_points(in_tracks, "name"), first(F.transform("rte", lambda r: r["name"])), of_points(in_routes, "name")]
    times = [of_points(in_tracks, "time"), of_points(in_routes, "time")]
    return gpx.select("doc", F.col("_creator").alias("creator"), F.coalesce("metadata.name", *names).alias("name"), F.coalesce("metadata.time", *times).alias("ts"))
