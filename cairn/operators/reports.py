"""Benchmark statistics, their report, and checks that two results agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bench_stats(samples: DataFrame, name: str, value: str) -> DataFrame:
    """Least, greatest, mean, median and population deviation of each name's samples, to three decimals."""
    v = F.col(value)
    r = lambda c: F.round(c, 3)
    return samples.groupBy(name).agg(r(F.min(v)).alias("low"), r(F.max(v)).alias("high"), r(F.sum(v.cast("decimal(38,10)")).cast("double") / F.count(v)).alias("mean"), r(F.percentile(v, 0.5)).alias("median"), r(F.stddev_pop(v)).alias("stdev"), F.count("*").alias("iterations"))


def bench_report(stats: DataFrame, name: str, reference: str) -> DataFrame:
    """stats with speedup against the reference's mean (1 if there is none) and a line of text."""
    base = F.broadcast(stats.filter(F.col(name) == reference).select(F.col("mean").alias("_base")).limit(1))
    out = stats.join(base, how="left").withColumn("speedup", F.coalesce(F.col("_base") / F.col("mean"), F.lit(1.0))).drop("_base")
    line = F.format_string("%-20s %9.3f %9.3f %9.3f %9.3f %9.3f %8.2fx", F.col(name).cast("string"), "mean", "median", "low", "high", "stdev", "speedup")
    return out.withColumn("line", line)


def geometry_counts(meshes: DataFrame, coordinates: str, triangles: str) -> DataFrame:
    """meshes with the points and triangles of their packed arrays."""
    return meshes.withColumns({"n_points": (F.size(coordinates) / 3).cast("long"), "n_triangles": (F.size(triangles) / 3).cast("long")})


def parity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys whose row counts in a and b differ, with both."""
    count = lambda df, n: df.groupBy(key).agg(F.count("*").alias(n))
    both = count(a, "n_a").join(count(b, "n_b"), key, "full").na.fill(0, ["n_a", "n_b"])
    return both.filter("n_a <> n_b")


def level_histogram(tiles: DataFrame, level: str) -> DataFrame:
    return tiles.groupBy(level).agg(F.count("*").alias("n_tiles"))


def first_rows(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The n first rows in an order; each task keeps n, so no full sort moves."""
    return rows.orderBy(*order).limit(n)


def snapshot(rows: DataFrame, key: str, parts: dict[str, list[str]]) -> DataFrame:
    """(key, snapshot): columns as nested JSON, one object for each part; parts without any value are left out."""
    some = lambda columns: reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])
    objects = [F.when(some(columns), F.struct(*columns)).alias(name) for name, columns in parts.items()]
    return rows.select(key, F.to_json(F.struct(*objects)).alias("snapshot"))
