"""Queries over the driver's tables, which stand for tracks, tiles and rasters, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import raster, reports, spatial, tracks
from cairn.plans import more_queries, terrain_queries
from cairn.plans.proxies import read, track_points


def recode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("epoch"), F.col("l_extendedprice").alias("source_bytes"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("encoded_bytes"),
        F.col("l_tax").alias("rmse"), F.col("l_discount").alias("max_abs"), F.col("l_quantity").alias("pixels"), F.floor(F.col("l_quantity") * F.col("l_tax")).alias("identical"),
    )


def tile_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tiles' keys, their order lines as tiles: alive below a discount, loading from a tax on, else ready, failed or idle."""
    phase = F.when(F.col("l_tax") >= 0.08, "loading").when(F.col("l_returnflag") == "A", "idle").when(F.col("l_returnflag") == "N", "ready").otherwise("failed")
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("layer"), (F.col("l_discount") < 0.05).alias("alive"), phase.alias("phase"))


def track_elapsed(spark, sf_dir):
    return tracks.elapsed(track_points(spark, sf_dir)).select("track", "ix", "elapsed_ms")


def track_bounds(spark, sf_dir):
    return tracks.bounds(track_points(spark, sf_dir))


def track_decimate(spark, sf_dir):
    return tracks.decimate(track_points(spark, sf_dir), 5).select("track", "ix", "point_ix")


def playhead_interp(spark, sf_dir):
    return tracks.midpoints(track_points(spark, sf_dir)).select("track", "ix", F.round("mid_ele", 6).alias("mid_ele"))


def running_stats(spark, sf_dir):
    return tracks.running_stats(track_points(spark, sf_dir)).select("track", "ix", "last_ele", "min_ele", "max_ele", F.round("mean_ele", 6).alias("mean_ele"))


def alive_sessions(spark, sf_dir):
    return tracks.sessions(track_points(spark, sf_dir), "10 hours").select("track", "start_us", "n_touches")


def recode_report(spark, sf_dir):
    return raster.recode_report(recode_stats(spark, sf_dir), "epoch")


def recode_status(spark, sf_dir):
    tiles = tile_states(spark, sf_dir)
    found = [raster.load_status(tiles, "layer", before).withColumn("before", F.lit(before)) for before in ("idle", "running", "done")]
    return found[0].unionByName(found[1]).unionByName(found[2])


def height_error(spark, sf_dir):
    lossy = F.transform("embedding", lambda v: F.round(v.cast("double"), 1))
    t = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", lossy.alias("lossy"))
    out = raster.height_error(t, "embedding", "lossy")
    return out.select("vec_id", "n_pixels", "n_identical", *[F.round(c, 8).alias(c) for c in ("rmse", "mean_abs", "max_abs")], *[F.round(f"{c}_norm", 12).alias(f"{c}_norm") for c in ("rmse", "mean_abs", "max_abs")])


def height_error_metres(spark, sf_dir):
    lossy = F.transform("embedding", lambda v: F.round(v.cast("double"), 1))
    span = (F.col("vec_id") % 5 - 1).cast("double") * 100
    t = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.slice(lossy, 1, 50).alias("lossy"), span.alias("span"))
    out = raster.height_error(t, "embedding", "lossy", F.col("span"))
    return out.select("vec_id", "n_pixels", *[F.round(f"{c}_norm", 10).alias(f"{c}_norm") for c in ("rmse", "mean_abs", "max_abs")])


def pixel_stats(spark, sf_dir):
    bad = F.transform("embedding", lambda v, i: F.when((F.col("vec_id") + i) % 9 == 0, F.lit(-200.0)).otherwise(v.cast("double")))
    out = raster.pixel_stats(read(spark, sf_dir, "embeddings").select("vec_id", bad.alias("px")), "vec_id", "px")
    return out.withColumn("mean", F.round("mean", 8))


def sample_stats(spark, sf_dir):
    out = raster.sample_stats(read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("px")), "px")
    return out.select("vec_id", "low", "high", F.round("mean", 8).alias("mean"))


def viewshed_los(spark, sf_dir):
    seen = raster.row_sight(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 8, 0.05)
    cells = seen.select("vec_id", F.posexplode("visible").alias("pos", "visible"))
    return cells.select("vec_id", F.expr("pos div 8").cast("int").alias("y"), (F.col("pos") % 8).alias("x"), "visible")


def cell_lookup(spark, sf_dir):
    tiles = read(spark, sf_dir, "part").select("p_partkey", F.expr("80000 + 40960 * (p_partkey % 14)").cast("double").alias("xll"), F.expr("624040 - 40960 * (floor(p_partkey / 14) % 16)").cast("double").alias("yll"))
    # A catalog has one row a cell.
    tiles = tiles.groupBy("xll", "yll").agg(F.min("p_partkey").alias("p_partkey"))
    points = read(spark, sf_dir, "orders").select("o_orderkey", (80000 + F.col("o_totalprice")).alias("east"), (9640 + F.col("o_custkey") * 40).cast("double").alias("north"))
    return spatial.cell_lookup(points, tiles, (80000.0, 9640.0), 40960.0).select("o_orderkey", "xll", "yll", "p_partkey")


def track_selection(spark, sf_dir):
    chosen = read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return spatial.selected(read(spark, sf_dir, "customer"), chosen, "c_custkey").select("c_custkey", "c_name")


def track_sync_diff(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "value")
    return spatial.sync_difference(e.filter("event_type = 'click'").select("user_id"), e.filter("event_type <> 'click' AND value > 80").select("user_id"), "user_id")


def half_decode(spark, sf_dir):
    """Patterns over all 65536; those that are no number have value 0 and their kind."""
    v = S.half_to_float(((F.col("event_id") * 7919) % 65536).cast("int"))
    kind = F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == -float("inf"), "-inf").otherwise("finite")
    return read(spark, sf_dir, "events").select("event_id", kind.alias("kind"), F.when(kind == "finite", v + 0.0).otherwise(0.0).alias("v"))


def denormalise(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.round(S.codebook_to_metres((F.col("p_partkey") * 31) % 65536, F.col("p_size").cast("double"), F.col("p_size") + F.col("p_retailprice") / 10), 6).alias("metres"))


def quality_clamp(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.round(S.clamp_quality(F.col("value") / 100), 8).alias("q"))


def lod_level(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", S.lod_level(F.col("o_totalprice"), 1000.0).alias("level"))


def lod_histogram(spark, sf_dir):
    return reports.level_histogram(lod_level(spark, sf_dir), "level")


def contour_band(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.round(S.contour_phase(F.col("value"), 5.0), 6).alias("phase"), F.round(S.smoothstep(0.0, 50.0, F.col("value")), 6).alias("edge"))


def odd_option(remainder: int, value):
    """value, but null, NaN and infinite for some parts."""
    k = (F.col("p_partkey") + remainder) % 7
    return F.when(k == 0, F.lit(None).cast("double")).when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("inf"))).otherwise(value)


def viewshed_config(spark, sf_dir):
    c = S.viewshed_config(odd_option(0, F.col("p_size") * 5.0 - 60), odd_option(1, F.col("p_size") * 200.5), odd_option(2, F.col("p_retailprice") / 100 - 5), odd_option(3, F.col("p_size") / 10.0 - 1), odd_option(4, F.col("p_size") / 3.0))
    return read(spark, sf_dir, "part").select("p_partkey", c.alias("c")).select("p_partkey", "c.radius", "c.map_size", F.round("c.near", 6).alias("near"), "c.near_scale")


def format_bytes(spark, sf_dir):
    n = F.when(F.col("p_partkey") % 50 == 0, F.lit(float("inf"))).otherwise((F.col("p_partkey") * F.col("p_partkey") * 1024).cast("double"))
    return read(spark, sf_dir, "part").select("p_partkey", S.format_bytes(n).alias("shown"), S.colour_to_css(F.col("p_partkey") * 104729).alias("css"))


def bench_stats(spark, sf_dir):
    return reports.bench_stats(read(spark, sf_dir, "events"), "event_type", "value")


QUERIES = {f.__name__: f for f in (
    track_bounds, track_elapsed, track_decimate, playhead_interp, running_stats, alive_sessions, recode_report, recode_status, height_error, height_error_metres, pixel_stats, sample_stats, viewshed_los, cell_lookup, track_selection,
    track_sync_diff, half_decode, denormalise, quality_clamp, lod_level, lod_histogram, contour_band, viewshed_config, format_bytes, bench_stats,
)}

P = "WITH p AS (SELECT user_id AS track, event_id AS ix, ts, 50 + (event_id * 37 % 5000) / 1000e0 AS lat, -5 + (event_id * 91 % 6000) / 1000e0 AS lon, value AS ele FROM events)"
R = "WITH r AS (SELECT l_linenumber AS epoch, l_extendedprice AS s, l_extendedprice * (1 - l_discount) AS e, l_tax AS rmse, l_discount AS max_abs, l_quantity AS px, CAST(floor(l_quantity * l_tax) AS BIGINT) AS same FROM lineitem)"
T = """WITH t AS (SELECT l_partkey AS layer, l_discount < 0.05 AS alive, CASE WHEN l_tax >= 0.08 THEN 'loading' WHEN l_returnflag = 'A' THEN 'idle' WHEN l_returnflag = 'N' THEN 'ready' ELSE 'failed' END AS phase FROM lineitem),
n AS (SELECT layer, count(*) FILTER (alive) AS total, count(*) FILTER (alive AND phase = 'loading') AS pending, count(*) FILTER (alive AND phase = 'ready') AS completed, count(*) FILTER (alive AND phase = 'failed') AS failed FROM t GROUP BY layer)"""
C = "WITH c AS (SELECT vec_id, CAST(floor((i - 1) / 8) AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))"
LOD = "CAST(CASE WHEN o_totalprice <= 0 THEN 0 ELSE least(greatest(floor(log2(o_totalprice / 1000e0)) + 3, 0), 11) END AS INTEGER)"
ORACLE_SQL = {
    "track_bounds": f"{P} SELECT track, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS end_ms, count(*) AS n_points FROM p GROUP BY track",
    "track_elapsed": f"{P} SELECT track, ix, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY track))) // 1000 AS elapsed_ms FROM p",
    "track_decimate": f"{P} SELECT track, ix, CAST(k AS INTEGER) AS point_ix FROM (SELECT track, ix, row_number() OVER (PARTITION BY track ORDER BY ts, ix) - 1 AS k, count(*) OVER (PARTITION BY track) AS n FROM p) WHERE k % CAST(ceil(n / 5.0) AS BIGINT) = 0",
    "playhead_interp": f"{P} SELECT track, ix, round((ele + lead(ele) OVER (PARTITION BY track ORDER BY ts, ix)) / 2, 6) AS mid_ele FROM p",
    "running_stats": f"{P} SELECT track, ix, ele AS last_ele, min(ele) OVER w AS min_ele, max(ele) OVER w AS max_ele, round(CAST(sum(CAST(ele AS DECIMAL(38,10))) OVER w AS DOUBLE) / count(ele) OVER w, 6) AS mean_ele FROM p WINDOW w AS (PARTITION BY track ORDER BY ts, ix ROWS UNBOUNDED PRECEDING)",
    "alive_sessions": f"{P}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY track ORDER BY ts, ix)) < 36000000000 THEN 0 ELSE 1 END AS fresh FROM p), h AS (SELECT *, sum(fresh) OVER (PARTITION BY track ORDER BY ts, ix ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT track, epoch_us(min(ts)) AS start_us, count(*) AS n_touches FROM h GROUP BY track, s",
    "recode_report": f"{R}, d AS (SELECT epoch, count(*) AS n, CAST(sum(CAST(s AS DECIMAL(38,10))) AS DOUBLE) AS s, CAST(sum(CAST(e AS DECIMAL(38,10))) AS DOUBLE) AS e, CAST(sum(CAST(rmse * px AS DECIMAL(38,10))) AS DOUBLE) AS w, CAST(sum(CAST(px AS DECIMAL(38,10))) AS DOUBLE) AS px, CAST(sum(CAST(same AS DECIMAL(38,10))) AS DOUBLE) AS same, max(rmse) AS max_rmse, max(max_abs) AS max_abs FROM r GROUP BY epoch) SELECT epoch, n AS tile_count, round(s, 4) AS total_source, round(e, 4) AS total_encoded, round(CASE WHEN s > 0 THEN e / s ELSE 0 END, 6) AS ratio, round(CASE WHEN px > 0 THEN w / px ELSE 0 END, 6) AS mean_rmse, round(CASE WHEN px > 0 THEN same / px ELSE 0 END, 6) AS identical_fraction, max_rmse, max_abs FROM d",
    "recode_status": f"{T} SELECT n.*, before, CASE WHEN before = 'idle' THEN 'idle' WHEN pending > 0 THEN 'running' WHEN total > 0 THEN 'done' ELSE before END AS status FROM n, (VALUES ('idle'), ('running'), ('done')) AS b(before)",
    "height_error": f"{C}, d AS (SELECT vec_id, abs(v - round(v, 1)) AS a FROM c), g AS (SELECT vec_id, CAST(count(*) AS INTEGER) AS n_pixels, CAST(count(*) FILTER (a = 0) AS INTEGER) AS n_identical, sqrt(avg(a * a)) AS r, avg(a) AS m, max(a) AS x FROM d GROUP BY vec_id) SELECT vec_id, n_pixels, n_identical, round(r, 8) AS rmse, round(m, 8) AS mean_abs, round(x, 8) AS max_abs, round(r / 65536, 12) AS rmse_norm, round(m / 65536, 12) AS mean_abs_norm, round(x / 65536, 12) AS max_abs_norm FROM g",
    "height_error_metres": f"{C}, d AS (SELECT vec_id, abs(v - round(v, 1)) AS a, CASE WHEN vec_id % 5 > 1 THEN (vec_id % 5 - 1) * 100e0 ELSE 1e0 END AS s FROM c WHERE 8 * y + x < 50) SELECT vec_id, CAST(count(*) AS INTEGER) AS n_pixels, round(sqrt(avg(a * a)) / min(s), 10) AS rmse_norm, round(avg(a) / min(s), 10) AS mean_abs_norm, round(max(a) / min(s), 10) AS max_abs_norm FROM d GROUP BY vec_id",
    "pixel_stats": f"{C}, p AS (SELECT vec_id, 8 * y + x AS i, v, (vec_id + 8 * y + x) % 9 = 0 AS bad FROM c), g AS (SELECT vec_id, min(v) FILTER (NOT bad) AS low, max(v) FILTER (NOT bad) AS high, round(avg(v) FILTER (NOT bad), 8) AS mean, CAST(count(*) FILTER (bad) AS INTEGER) AS n_bad FROM p GROUP BY vec_id) SELECT g.vec_id, low, high, mean, CAST(min(i) FILTER (v = low AND NOT bad) AS INTEGER) AS argmin, CAST(min(i) FILTER (v = high AND NOT bad) AS INTEGER) AS argmax, n_bad FROM g JOIN p USING (vec_id) GROUP BY ALL",
    "sample_stats": f"{C} SELECT vec_id, min(v) AS low, max(v) AS high, round(avg(v), 8) AS mean FROM c GROUP BY vec_id",
    "viewshed_los": f"{C}, s AS (SELECT *, CASE WHEN x > 0 THEN (v - (first_value(v) OVER (PARTITION BY vec_id, y ORDER BY x) + 0.05e0)) / x END AS slope FROM c) SELECT vec_id, y, x, coalesce(slope >= max(slope) OVER (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS visible FROM s",
    "cell_lookup": "WITH t AS (SELECT min(p_partkey) AS p_partkey, CAST(80000 + 40960 * (p_partkey % 14) AS DOUBLE) AS xll, CAST(624040 - 40960 * (CAST(floor(p_partkey / 14) AS BIGINT) % 16) AS DOUBLE) AS yll FROM part GROUP BY 2, 3), o AS (SELECT o_orderkey, 80000e0 + floor((80000 + o_totalprice - 80000e0) / 40960e0) * 40960e0 AS xll, 9640e0 + floor((9640 + o_custkey * 40 - 9640e0) / 40960e0) * 40960e0 AS yll FROM orders) SELECT o_orderkey, o.xll, o.yll, p_partkey FROM o LEFT JOIN t ON o.xll = t.xll AND o.yll = t.yll",
    "track_selection": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "track_sync_diff": "WITH l AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), d AS (SELECT DISTINCT user_id FROM events WHERE event_type <> 'click' AND value > 80) SELECT user_id, 'add' AS action FROM (SELECT * FROM d EXCEPT SELECT * FROM l) UNION ALL SELECT user_id, 'remove' AS action FROM (SELECT * FROM l EXCEPT SELECT * FROM d)",
    "half_decode": "WITH b AS (SELECT event_id, (event_id * 7919) % 65536 AS w FROM events), h AS (SELECT *, CASE WHEN w >= 32768 THEN -1e0 ELSE 1e0 END AS s, (w % 32768) // 1024 AS e, w % 1024 AS m FROM b) SELECT event_id, CASE WHEN e < 31 THEN 'finite' WHEN m > 0 THEN 'nan' WHEN s > 0 THEN 'inf' ELSE '-inf' END AS kind, CASE WHEN e = 31 THEN 0e0 WHEN e = 0 THEN s * m * pow(2e0, -24) + 0e0 ELSE s * pow(2e0, e - 15) * (1 + m / 1024e0) END AS v FROM h",
    "denormalise": "SELECT p_partkey, round(p_size + ((p_partkey * 31) % 65536) / 65536e0 * (CASE WHEN p_retailprice > 0 THEN p_size + p_retailprice / 10 - p_size ELSE 1 END), 6) AS metres FROM part",
    "quality_clamp": "SELECT event_id, round(least(greatest(value / 100, 0e0), 0.9999e0), 8) AS q FROM events",
    "lod_level": f"SELECT o_orderkey, {LOD} AS level FROM orders",
    "lod_histogram": f"SELECT {LOD} AS level, count(*) AS n_tiles FROM orders GROUP BY 1",
    "contour_band": "WITH e AS (SELECT event_id, value, least(greatest(value / 50e0, 0e0), 1e0) AS t FROM events) SELECT event_id, round((value - floor(value / 5e0) * 5e0) / 5e0, 6) AS phase, round(t * t * (3 - 2 * t), 6) AS edge FROM e",
    "viewshed_config": """WITH o AS (SELECT p_partkey, CASE WHEN p_partkey % 7 > 2 THEN p_size * 5e0 - 60 END AS r, CASE WHEN (p_partkey + 1) % 7 > 2 THEN p_size * 200.5e0 END AS m, CASE WHEN (p_partkey + 2) % 7 > 2 THEN p_retailprice / 100 - 5 END AS n, CASE WHEN (p_partkey + 3) % 7 > 2 THEN p_size / 10e0 - 1 END AS c, CASE WHEN (p_partkey + 4) % 7 > 2 THEN p_size / 3e0 END AS h FROM part),
d AS (SELECT p_partkey, greatest(10e0, coalesce(r, 10000e0)) AS radius, greatest(0e0, coalesce(c, 2e0)) AS near_scale, n, coalesce(h, 1.7e0) AS h, coalesce(m, 2048e0) AS m FROM o)
SELECT p_partkey, radius, CAST(greatest(256, least(8192, floor(m + 0.5e0))) AS INTEGER) AS map_size, round(greatest(0.01e0, least(coalesce(n, h * near_scale), radius * 0.5e0)), 6) AS near, near_scale FROM d""",
    "format_bytes": "WITH b AS (SELECT p_partkey, CAST(p_partkey * p_partkey * 1024 AS DOUBLE) AS n FROM part), u AS (SELECT *, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 ELSE 3 END AS k FROM b), v AS (SELECT *, n / pow(1024e0, k) AS x FROM u) SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 OR n <= 0 THEN '0 B' ELSE (CASE WHEN x < 10 THEN printf('%.2f', floor(x * 100 + 0.5e0) / 100) WHEN x < 100 THEN printf('%.1f', floor(x * 10 + 0.5e0) / 10) ELSE printf('%.0f', floor(x + 0.5e0)) END) || ' ' || ['B', 'KB', 'MB', 'GB'][k + 1] END AS shown, '#' || printf('%06x', (p_partkey * 104729) & 16777215) AS css FROM v",
    "bench_stats": "SELECT event_type, round(min(value), 3) AS low, round(max(value), 3) AS high, round(CAST(sum(CAST(value AS DECIMAL(38,10))) AS DOUBLE) / count(value), 3) AS mean, round(median(value), 3) AS median, round(stddev_pop(value), 3) AS stdev, count(*) AS iterations FROM events GROUP BY event_type",
}

QUERIES |= more_queries.QUERIES | terrain_queries.QUERIES
ORACLE_SQL |= more_queries.ORACLE_SQL | terrain_queries.ORACLE_SQL
