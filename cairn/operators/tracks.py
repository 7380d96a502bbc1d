"""Operators on track points (track, ix, ts, lat, lon, ele): one row a point.

What needs the order of a track takes it in stretches (cairn.operators.ordered),
so a track may hold much of a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.formats import tenths
from cairn.operators.ordered import as_of, ranked, so_far, with_neighbours


def elapsed(points: DataFrame) -> DataFrame:
    """points with whole milliseconds since the first point of their track; a missing time is 0.

    Starts are aggregated before the shuffle and joined back, so Spark can
    split a track that holds much of the table.  Rows without a track are left
    out.
    """
    first = points.groupBy("track").agg(F.min("ts").alias("_first"))
    out = points.join(first, "track").withColumn("elapsed_ms", F.coalesce(F.floor((F.unix_micros("ts") - F.unix_micros("_first")) / 1000), F.lit(0)))
    return out.drop("_first")


def bounds(points: DataFrame) -> DataFrame:
    """Bounding box, end time and size of each track; partial aggregates before the shuffle."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))]
    return points.groupBy("track").agg(*ends, F.floor((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1000).alias("end_ms"), F.count("*").alias("n_points"))


def decimate(points: DataFrame, most: int) -> DataFrame:
    """Every ceil(n / most)-th point of tracks with more than `most`."""
    step = F.greatest(F.ceil(F.col("_n") / F.lit(most)), F.lit(1))
    return ranked(points, "point_ix").withColumn("point_ix", F.col("point_ix").cast("int")).filter(F.col("point_ix") % step == 0).drop("_n")


def playhead(points: DataFrame, time: float, rate: float = 0.02) -> DataFrame:
    """(track, ele, lat, lon): where a head that runs round each track stands, between its point and the next; the last is followed by the first.

    The head's place is a share of the number of points.  A track meets in one
    aggregate of its two points.
    """
    numbered = ranked(points)
    place = F.col("_n") * F.lit(time * rate)
    place = place - F.floor(place / F.col("_n")) * F.col("_n")
    placed = numbered.withColumns({"_at": F.floor(place), "_share": place - F.floor(place)})
    first, second = F.col("_i") == F.col("_at"), F.col("_i") == (F.col("_at") + 1) % F.col("_n")
    value = lambda side, c: F.max(F.when(side, F.col(c)))
    two = placed.filter(first | second).groupBy("track").agg(F.max("_share").alias("_share"), *[value(s, c).alias(f"_{k}_{c}") for k, s in (("a", first), ("b", second)) for c in ("lat", "lon", "ele")])
    return two.select("track", *[(F.col(f"_a_{c}") + (F.col(f"_b_{c}") - F.col(f"_a_{c}")) * F.col("_share")).alias(c) for c in ("lat", "lon", "ele")])


def playhead_at(heads: DataFrame, points: DataFrame) -> DataFrame:
    """heads (track, ts, ...) with lat, lon and ele of their track at that time, between the last point before and the next; null before the first, the last point's from then on."""
    with_next = with_neighbours(points, {f"next_{c}": (c, 1) for c in ("ts", "lat", "lon", "ele")})
    values = ["lat", "lon", "ele", "next_ts", "next_lat", "next_lon", "next_ele"]
    found = as_of(heads, with_next, values)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    share = F.when(us("at_next_ts") > us("at_ts"), (us("ts") - us("at_ts")) / (us("at_next_ts") - us("at_ts"))).otherwise(0.0)
    return found.select(*[c for c in heads.columns if c not in values], *[(F.col(f"at_{c}") + F.coalesce(F.col(f"at_next_{c}") - F.col(f"at_{c}"), F.lit(0.0)) * share).alias(c) for c in ("lat", "lon", "ele")])


def midpoints(points: DataFrame) -> DataFrame:
    """Elevation half way to the next point; null at the end of a track."""
    return with_neighbours(points, {"_next": ("ele", 1)}).withColumn("mid_ele", (F.col("ele") + F.col("_next")) / 2).drop("_next")


def running_stats(points: DataFrame) -> DataFrame:
    """points with last, least, greatest and mean elevation so far; last is the point's own."""
    ele = F.col("ele")
    out = so_far(points, {"min_ele": ("min", ele), "max_ele": ("max", ele), "_sum": ("sum", ele.cast("decimal(38,10)")), "_n": ("count", ele)})
    return out.withColumns({"last_ele": ele, "mean_ele": F.col("_sum").cast("double") / F.col("_n")}).drop("_sum", "_n")


def svg_paths(points: DataFrame, width: float, height: float, padding: float = 3.0, most: int = 180) -> DataFrame:
    """(track, path): each track as an SVG path in pixels, decimated, centred, to one scale; empty with fewer than two points."""
    kept = decimate(points, most)
    whole = Window.partitionBy("track")
    lat, lon = F.col("lat"), F.col("lon")
    span = lambda c: F.when(F.max(c).over(whole) > F.min(c).over(whole), F.max(c).over(whole) - F.min(c).over(whole)).otherwise(1e-6)
    out = kept.withColumns({"_h": span("lat"), "_w": span("lon"), "_north": F.max("lat").over(whole), "_west": F.min("lon").over(whole)})
    inner_w, inner_h = width - 2 * padding, height - 2 * padding
    out = out.withColumn("_scale", F.least(inner_w / F.col("_w"), inner_h / F.col("_h")))
    x = padding + (inner_w - F.col("_w") * F.col("_scale")) / 2 + (lon - F.col("_west")) * F.col("_scale")
    y = padding + (inner_h - F.col("_h") * F.col("_scale")) / 2 + (F.col("_north") - lat) * F.col("_scale")
    text = F.concat(tenths(x), F.lit(","), tenths(y))
    # At most `most` points of a track meet here.
    parts = F.array_sort(F.collect_list(F.struct(F.col("point_ix"), F.when(F.col("point_ix") == 0, F.concat(F.lit("M"), text)).otherwise(F.concat(F.lit("L"), text)).alias("p"))))
    path = F.array_join(F.transform(parts, lambda p: p["p"]), "")
    return out.groupBy("track").agg(F.when(F.count("*") >= 2, path).otherwise("").alias("path"))


def sessions(points: DataFrame, gap: str) -> DataFrame:
    """Visibility intervals: touches of a track at most `gap` apart."""
    return points.groupBy("track", F.session_window("ts", gap)).agg(F.count("*").alias("n_touches")).select(
        "track", F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "n_touches"
    )
