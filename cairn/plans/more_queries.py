"""Further queries over the driver's tables: grids, frames, sets and formats, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.functions import formats
from cairn.operators import frames, grids, raster, reports, spatial
from cairn.plans.proxies import read, track_points


def tile_name():
    return F.concat(formats.zero_pad(F.col("p_partkey") % 14), F.lit("_"), formats.zero_pad(F.expr("floor(p_partkey / 14) % 16")))


def lookahead_smooth(spark, sf_dir):
    return frames.look_ahead(track_points(spark, sf_dir), "ele").select("track", "ix", F.round("ahead", 6).alias("ahead"))


def frame_phase(spark, sf_dir):
    out = frames.accumulated_phase(frames.frame_delta(track_points(spark, sf_dir), 36000.0), 3.0)
    return out.select("track", "ix", F.round("dt", 6).alias("dt"), F.round("phase", 6).alias("phase"))


def morph_progress(spark, sf_dir):
    return frames.morph_progress(frames.frame_delta(track_points(spark, sf_dir), 36000.0), 100000.0).select("track", "ix", F.round("progress", 6).alias("progress"))


def change_detect(spark, sf_dir):
    points = read(spark, sf_dir, "events").select(F.col("user_id").alias("track"), F.col("event_id").alias("ix"), "ts", "event_type")
    return frames.changes(points, "event_type").select("track", "ix", "event_type")


def playhead_pulse(spark, sf_dir):
    return frames.pulse(track_points(spark, sf_dir), 7.0).select("track", "ix", F.round("pulse", 6).alias("pulse"), F.round("lift_z", 4).alias("lift_z"))


def epoch_guard(spark, sf_dir):
    return frames.newest_generation(read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), "l_partkey", "l_linenumber")


def working_set(spark, sf_dir):
    out = frames.evicted(read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], "o_totalprice", 500000.0)
    return out.select("o_orderkey", F.round("held", 2).alias("held"), "evict")


def state_key(spark, sf_dir):
    return frames.state_key(read(spark, sf_dir, "events"), "user_id", "event_id", F.concat_ws(":", F.col("event_id").cast("string"), "event_type"))


def mirror_scores(spark, sf_dir):
    tiles = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * 4)).alias("px"))
    out = grids.mirror_scores(tiles, "px", 8, 8).withColumn("repair", grids.repair_choice(F.lit(0.5)))
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in ("vertical", "top", "bottom")], "repair")


def resample_nearest(spark, sf_dir):
    return grids.resample(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", (8, 8), (4, 4), False).select("vec_id", "pos", F.round("v", 6).alias("v"))


def resample_bilinear(spark, sf_dir):
    return grids.resample(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", (8, 8), (5, 5), True).select("vec_id", "pos", F.round("v", 6).alias("v"))


def surface_steepness(spark, sf_dir):
    tiles = read(spark, sf_dir, "embeddings").select("vec_id", F.arrays_zip(grids.steepness("embedding", 8).alias("s"), grids.normals("embedding", 8, 0.5).alias("n")).alias("z"))
    cells = tiles.select("vec_id", F.posexplode("z").alias("pos", "z"))
    return cells.select("vec_id", F.expr("pos div 8").cast("int").alias("y"), (F.col("pos") % 8).alias("x"), F.round("z.s", 6).alias("steepness"), *[F.round(f"z.n.{c}", 6).alias(f"normal_{c}") for c in "xyz"])


def nodata_clean(spark, sf_dir):
    """Heights of both signs up to some thousands: above 3000 filled, range from every fourth pixel."""
    tiles = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 12000).alias("px"))
    out = grids.nodata_clean(tiles, "px", 3000.0, -200.0).withColumn("r", grids.height_range("px", 16))
    return out.select("vec_id", F.size(F.filter("px", lambda v: v == -200)).alias("n_filled"), F.round("r.low", 6).alias("low"), F.round("r.high", 6).alias("high"))


def tile_lod_expand(spark, sf_dir):
    return grids.lod_levels(read(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", "lod", "width", F.round("eps", 8).alias("eps"), F.round("lod_share", 8).alias("lod_share"))


def grid_generate(spark, sf_dir):
    """The cells of an area around each supplier."""
    areas = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") - 10).alias("first_column"), (F.col("s_suppkey") % 4).cast("int").alias("columns"), (F.col("s_suppkey") % 11 - 5).cast("int").alias("first_row"), F.lit(3).alias("rows"))
    return grids.cells(areas, 10000)


def grid_triangles(spark, sf_dir):
    made = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 5).cast("long").alias("width"), (F.col("p_partkey") % 4 + 1).alias("height"))
    return grids.grid_triangles(made).select("p_partkey", "tid", "a", "b", "c")


def toggle_symdiff(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "value")
    return spatial.symmetric_difference(e.filter("event_type = 'click'"), e.filter("event_type <> 'click' AND value > 80"), "user_id")


def union_intersect(spark, sf_dir):
    orders, customers = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), read(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    return orders.unionByName(customers).distinct().withColumn("kind", F.lit("union")).unionByName(orders.intersect(customers).withColumn("kind", F.lit("both")))


def resolution_fallback(spark, sf_dir):
    none = F.lit(None).cast("string")
    sources = F.create_map(F.lit("500"), F.col("p_brand"), F.lit("1000"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(none), F.lit("2000"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_name")))
    return read(spark, sf_dir, "part").select("p_partkey", spatial.best_source(sources, F.col("p_name")).alias("file"))


def keys_and_paths(spark, sf_dir):
    url = F.concat(F.when(F.col("p_size") % 2 == 0, "/ltile/").otherwise("/tile/"), tile_name())
    key = formats.cache_key(url, F.col("p_size") % 3)
    x, y = spatial.tile_corner(tile_name())
    return read(spark, sf_dir, "part").select("p_partkey", key.alias("cache_key"), S.is_lossy_key(key).alias("lossy"), formats.last_segment(url).alias("label"), x.cast("long").alias("xll"), y.cast("long").alias("yll"))


def option_defaults(spark, sf_dir):
    v = F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("double")).when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return read(spark, sf_dir, "events").select("event_id", S.finite_or(v, 2.0).alias("v"))


def compression_metrics(spark, sf_dir):
    price = F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col("l_extendedprice"))
    pixels = F.when(F.col("l_quantity") > 5, F.col("l_quantity")).otherwise(0.0)
    stats = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", price.alias("source_bytes"), (F.col("l_extendedprice") * F.col("l_discount")).alias("encoded_bytes"), pixels.alias("pixels"))
    return raster.compression_metrics(stats).select("l_orderkey", "l_linenumber", "ratio", "savings", "encoded_kb", "bytes_per_pixel", "source_bytes_per_pixel")


def encoding_pairs(spark, sf_dir):
    """Every line as the full encoding of a tile, its successor in the order as the lossy one."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("bytes"))
    url = lambda k: F.concat_ws("/", F.col("l_orderkey").cast("string"), k.cast("string"))
    full = lines.select(url(F.col("l_linenumber")).alias("url"), F.lit(1.0).alias("q"), "bytes")
    lossy = lines.select(url(F.col("l_linenumber") - 1).alias("url"), F.lit(0.1).alias("q"), "bytes")
    return raster.encoding_pairs(full.unionByName(lossy), "url", "q", 0.1)


def roundtrip_rmse(spark, sf_dir):
    bad = F.transform("embedding", lambda v, i: F.when((F.col("vec_id") + i) % 11 == 0, F.lit(3.4e38)).otherwise(v.cast("double")))
    near = F.transform("embedding", lambda v, i: F.when((F.col("vec_id") + i) % 11 == 0, F.lit(-200.0)).otherwise(F.round(v.cast("double"), 1)))
    tiles = read(spark, sf_dir, "embeddings").select("label", bad.alias("a"), near.alias("b"))
    return raster.round_trip_rmse(tiles, "label", "a", "b").select("label", F.round("rmse", 6).alias("rmse"))


def top_tiles(spark, sf_dir):
    return reports.first_rows(read(spark, sf_dir, "events").select("event_id", "value"), 64, F.desc("value"), F.col("event_id"))


def wheel_and_angle(spark, sf_dir):
    v = F.col("value")
    return read(spark, sf_dir, "events").select("event_id", F.round(S.wheel_scale(v - 50), 6).alias("scale"), F.round(S.wrap_angle(v), 6).alias("angle"), F.round(S.bias(v / 1000, 0.3), 6).alias("bias"), F.round(S.gain(v / 1000, 0.3), 6).alias("gain"))


def hsv_rgb(spark, sf_dir):
    rgb = S.hsv_to_rgb((F.col("event_id") % 97) / F.lit(97.0), F.lit(0.75), F.lit(0.5))
    return read(spark, sf_dir, "events").select("event_id", *[F.round(c, 6).alias(k) for k, c in rgb.items()])


def dual_height_blend(spark, sf_dir):
    v, u, w = F.col("value"), (F.col("event_id") % 10) / F.lit(10.0), (F.col("event_id") % 13) / F.lit(13.0)
    lossy = S.morphed(F.floor(v).cast("double"), F.ceil(v).cast("double"), (F.col("event_id") % 5 - 1) / F.lit(3.0))
    share = S.blend_share(F.col("event_id") % 4, 0.25, u, w, 2.0)
    return read(spark, sf_dir, "events").select("event_id", F.round(share, 6).alias("share"), F.round(S.blended_height(v, lossy, share, 1.5), 6).alias("h"))


def number_parsing(spark, sf_dir):
    text = F.when(F.col("p_size") % 4 == 0, F.col("p_brand")).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5e1"), F.col("p_brand")))
    return read(spark, sf_dir, "part").select("p_partkey", S.parse_number(text).alias("v"))


def codebook_presets(spark, sf_dir):
    code = (F.col("p_partkey") * 7919 % 65536 - 32768).cast("int")
    return read(spark, sf_dir, "part").select("p_partkey", S.signed_to_code(code).alias("code"), S.preset_is_active(F.col("p_size") / 50, F.lit(0.3), 0.9999).alias("active"))


QUERIES = {f.__name__: f for f in (
    lookahead_smooth, frame_phase, morph_progress, change_detect, playhead_pulse, epoch_guard, working_set, state_key, mirror_scores, resample_nearest, resample_bilinear, surface_steepness, nodata_clean, tile_lod_expand,
    grid_generate, grid_triangles, toggle_symdiff, union_intersect, resolution_fallback, keys_and_paths, option_defaults, compression_metrics, encoding_pairs, roundtrip_rmse, top_tiles, wheel_and_angle, hsv_rgb,
    dual_height_blend, number_parsing, codebook_presets,
)}

P = "WITH p AS (SELECT user_id AS track, event_id AS ix, ts, value AS ele FROM events)"
D = f"{P}, d AS (SELECT *, coalesce(least((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY track ORDER BY ts, ix)) / 1e6, 36000e0), 0e0) AS dt FROM p)"
C = "WITH c AS (SELECT vec_id, CAST(floor((i - 1) / 8) AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))"
SO_FAR = "OVER (PARTITION BY track ORDER BY ts, ix ROWS UNBOUNDED PRECEDING)"
LEADS = ", ".join(f"lead(ele, {3 * k}) OVER w AS a{k}" for k in range(1, 10))
SUM, COUNT = (op.join(f"coalesce({x.format(k=k)}, 0)" for k in range(1, 10)) for op, x in ((" + ", "a{k}"), (" + ", "a{k} * 0 + 1")))
NAME = "lpad(CAST(p_partkey % 14 AS VARCHAR), 3, '0') || '_' || lpad(CAST(CAST(floor(p_partkey / 14) AS BIGINT) % 16 AS VARCHAR), 3, '0')"
MIRROR = "SELECT a.vec_id, CAST(count(*) FILTER (a.v = b.v) AS DOUBLE) / count(*) AS s FROM q a JOIN q b ON a.vec_id = b.vec_id AND b.x = a.x + {dx} AND b.y = a.y + {dy} WHERE {where} GROUP BY a.vec_id"
RGB = ((5, "r"), (3, "g"), (1, "b"))
HUES = ", ".join(f"({n} + (event_id % 97) / 97e0 * 6) - floor(({n} + (event_id % 97) / 97e0 * 6) / 6) * 6 AS k{n}" for n, _ in RGB)
CHANNELS = ", ".join(f"round(0.5e0 - 0.375e0 * greatest(least(k{n}, 4 - k{n}, 1e0), 0e0), 6) AS {c}" for n, c in RGB)
ORACLE_SQL = {
    "lookahead_smooth": f"{P}, l AS (SELECT track, ix, {LEADS} FROM p WINDOW w AS (PARTITION BY track ORDER BY ts, ix)) SELECT track, ix, CASE WHEN a1 IS NOT NULL THEN round(({SUM}) / ({COUNT}), 6) END AS ahead FROM l",
    "frame_phase": f"{D} SELECT track, ix, round(dt, 6) AS dt, round(CAST(sum(CAST(dt * 3 AS DECIMAL(38,10))) {SO_FAR} AS DOUBLE), 6) AS phase FROM d",
    "morph_progress": f"{D} SELECT track, ix, round(least(CAST(sum(CAST(dt AS DECIMAL(38,10))) {SO_FAR} AS DOUBLE) / 100000e0, 1e0), 6) AS progress FROM d",
    "change_detect": "SELECT track, ix, event_type FROM (SELECT user_id AS track, event_id AS ix, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type",
    "playhead_pulse": f"{P}, m AS (SELECT track, ix, epoch_us(ts) AS t, epoch_us(min(ts) OVER (PARTITION BY track)) AS a, epoch_us(max(ts) OVER (PARTITION BY track)) AS b FROM p), s AS (SELECT track, ix, CASE WHEN b > a THEN (t - a) / CAST(b - a AS DOUBLE) ELSE 0e0 END - 0.14e0 AS s FROM m), u AS (SELECT track, ix, least(greatest((s - floor(s) - 0.9e0) / 0.1e0, 0e0), 1e0) AS u FROM s) SELECT track, ix, round(u * u * (3 - 2 * u), 6) AS pulse, round(u * u * (3 - 2 * u) * 100, 4) AS lift_z FROM u",
    "epoch_guard": "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY l_partkey) AS m FROM lineitem) WHERE l_linenumber = m",
    "working_set": "WITH h AS (SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(38,4))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS h FROM orders) SELECT o_orderkey, round(h, 2) AS held, h > 500000 AS evict FROM h",
    "state_key": "SELECT user_id, string_agg(event_id || ':' || event_type, '|' ORDER BY event_id) AS state_key FROM events GROUP BY user_id",
    "mirror_scores": f"{C}, q AS (SELECT vec_id, x, y, floor(v * 4) AS v FROM c), a AS ({MIRROR.format(dx=0, dy=4, where='a.y < 4')}), t AS ({MIRROR.format(dx=4, dy=0, where='a.x IN (1, 2) AND a.y IN (1, 2)')}), b AS ({MIRROR.format(dx=4, dy=0, where='a.x IN (1, 2) AND a.y IN (5, 6)')}) SELECT vec_id, round(a.s, 6) AS vertical, round(t.s, 6) AS top, round(b.s, 6) AS bottom, CASE WHEN t.s > 0.75 AND b.s > 0.75 THEN 'quadrant' WHEN a.s > 0.75 THEN 'half' WHEN t.s > 0.75 OR b.s > 0.75 OR a.s > 0.55 THEN 'quadrant' ELSE 'none' END AS repair FROM a JOIN t USING (vec_id) JOIN b USING (vec_id)",
    "resample_nearest": "SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(CAST(embedding[CAST(floor(floor(pos / 4) * 7e0 / 3e0 + 0.5e0) * 8 + floor((pos % 4) * 7e0 / 3e0 + 0.5e0) AS INTEGER) + 1] AS DOUBLE), 6) AS v FROM embeddings, range(16) r(pos)",
    "resample_bilinear": f"{C}, o AS (SELECT pos, (pos % 5) * 7e0 / 4e0 AS fx, floor(pos / 5) * 7e0 / 4e0 AS fy FROM range(25) r(pos)), k AS (SELECT *, floor(fx) AS x0, floor(fy) AS y0 FROM o), j AS (SELECT c.vec_id, k.pos, sum(c.v * greatest(0e0, 1 - abs(c.x - fx)) * greatest(0e0, 1 - abs(c.y - fy))) AS v FROM k JOIN c ON c.x BETWEEN x0 AND x0 + 1 AND c.y BETWEEN y0 AND y0 + 1 GROUP BY c.vec_id, k.pos) SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(v, 6) AS v FROM j",
    "surface_steepness": f"{C}, n AS (SELECT *, lead(v) OVER (PARTITION BY vec_id, y ORDER BY x) - v AS dx, lead(v) OVER (PARTITION BY vec_id, x ORDER BY y) - v AS dy FROM c) SELECT vec_id, y, x, round(sqrt(dx * dx + dy * dy) * 0.70710678118654757e0, 6) AS steepness, round(-2 * dx / sqrt(4 * dx * dx + 4 * dy * dy + 1), 6) AS normal_x, round(-2 * dy / sqrt(4 * dx * dx + 4 * dy * dy + 1), 6) AS normal_y, round(1 / sqrt(4 * dx * dx + 4 * dy * dy + 1), 6) AS normal_z FROM n",
    "nodata_clean": f"{C}, f AS (SELECT vec_id, (8 * y + x) % 4 = 0 AS sampled, v * 12000 AS v FROM c), g AS (SELECT vec_id, CAST(count(*) FILTER (v > 3000) AS INTEGER) AS n_filled, min(v) FILTER (sampled AND v > -199 AND v < 3000) AS low, max(v) FILTER (sampled AND v > -199 AND v < 3000) AS high FROM f GROUP BY vec_id HAVING min(v) < 3000) SELECT vec_id, n_filled, CASE WHEN high > low THEN round(low, 6) ELSE 0 END AS low, CASE WHEN high > low THEN round(high, 6) ELSE 1 END AS high FROM g",
    "tile_lod_expand": "SELECT p_partkey, CAST(lod AS INTEGER) AS lod, CAST(4096 >> lod AS INTEGER) AS width, round(1e0 / ((4096 >> lod) - 1), 8) AS eps, round(lod / 12e0, 8) AS lod_share FROM part, (SELECT CAST(i AS INTEGER) AS lod FROM range(12) r(i))",
    "grid_generate": "WITH a AS (SELECT s_suppkey, s_nationkey - 10 AS c, s_suppkey % 11 - 5 AS r, unnest(range(s_suppkey % 4)) AS i FROM supplier) SELECT s_suppkey, CAST((c + i) * 10000 AS INTEGER) AS east, CAST((r + j) * 10000 AS INTEGER) AS north FROM a, range(3) AS q(j)",
    "grid_triangles": "WITH g AS (SELECT p_partkey, p_size % 5 AS w, p_partkey % 4 + 1 AS h FROM part), x AS (SELECT *, unnest(range(w - 1)) AS x FROM g), c AS (SELECT *, unnest(range(h - 1)) AS y FROM x), t AS (SELECT p_partkey, x * (h - 1) + y AS id, x * h + y AS a, h FROM c) SELECT p_partkey, id * 2 AS tid, a, a + h AS b, a + h + 1 AS c FROM t UNION ALL SELECT p_partkey, id * 2 + 1, a, a + h + 1, a + 1 FROM t",
    "toggle_symdiff": "WITH l AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), d AS (SELECT DISTINCT user_id FROM events WHERE event_type <> 'click' AND value > 80) (SELECT * FROM d EXCEPT SELECT * FROM l) UNION ALL (SELECT * FROM l EXCEPT SELECT * FROM d)",
    "union_intersect": "WITH c AS (SELECT c_custkey AS key FROM customer WHERE c_acctbal > 0) SELECT key, 'union' AS kind FROM (SELECT o_custkey AS key FROM orders UNION SELECT key FROM c) UNION ALL SELECT key, 'both' FROM (SELECT o_custkey AS key FROM orders INTERSECT SELECT key FROM c)",
    "resolution_fallback": "SELECT p_partkey, coalesce(CASE WHEN p_size % 2 <> 0 THEN nullif(p_name, '') END, CASE WHEN p_size % 3 = 0 THEN nullif(p_type, '') END, nullif(p_brand, ''), p_name) AS file FROM part",
    "keys_and_paths": f"WITH n AS (SELECT p_partkey, p_size, {NAME} AS name FROM part), k AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN '/ltile/' ELSE '/tile/' END || name || '@q=' || (p_size % 3) AS k FROM n) SELECT p_partkey, k AS cache_key, NOT ends_with(k, '@q=1') AS lossy, name AS label, CAST(80000 + 40960 * (p_partkey % 14) AS BIGINT) AS xll, CAST(624040 - 40960 * (CAST(floor(p_partkey / 14) AS BIGINT) % 16) AS BIGINT) AS yll FROM k",
    "option_defaults": "SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 2e0 ELSE value END AS v FROM events",
    "compression_metrics": "WITH m AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 0e0 ELSE l_extendedprice END AS s, l_extendedprice * l_discount AS e, CASE WHEN l_quantity > 5 THEN l_quantity ELSE 0 END AS px FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN s > 0 THEN e / s ELSE 0 END AS ratio, CASE WHEN s > 0 THEN 1 - e / s ELSE 0 END AS savings, e / 1024 AS encoded_kb, CASE WHEN px > 0 THEN e / px ELSE 0 END AS bytes_per_pixel, CASE WHEN px > 0 THEN s / px ELSE 0 END AS source_bytes_per_pixel FROM m",
    "encoding_pairs": "SELECT a.l_orderkey || '/' || a.l_linenumber AS url, a.l_extendedprice AS full_bytes, b.l_extendedprice AS lossy_bytes FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1",
    "roundtrip_rmse": f"{C}, d AS (SELECT vec_id, CASE WHEN (vec_id + 8 * y + x) % 11 = 0 THEN 0e0 ELSE v - round(v, 1) END AS d FROM c) SELECT label, round(sqrt(avg(d * d)), 6) AS rmse FROM d JOIN embeddings USING (vec_id) GROUP BY label",
    "top_tiles": "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 64",
    "wheel_and_angle": "SELECT event_id, round(CASE WHEN value < 50 THEN (1 + exp(-abs((value - 50) * 0.01e0))) / 2 ELSE 2 / (1 + exp(-abs((value - 50) * 0.01e0))) END, 6) AS scale, round(value - floor((value + pi()) / (2 * pi())) * (2 * pi()), 6) AS angle, round(CASE WHEN value <= 0 THEN 0 ELSE pow(value / 1000, ln(0.3e0) / ln(0.5e0)) END, 6) AS bias, round(CASE WHEN value / 1000 < 0.5e0 THEN CASE WHEN value <= 0 THEN 0 ELSE pow(2 * (value / 1000), ln(0.7e0) / ln(0.5e0)) END / 2 ELSE 1 - CASE WHEN value >= 1000 THEN 0 ELSE pow(2 - 2 * (value / 1000), ln(0.7e0) / ln(0.5e0)) END / 2 END, 6) AS gain FROM events",
    "hsv_rgb": f"WITH k AS (SELECT event_id, {HUES} FROM events) SELECT event_id, {CHANNELS} FROM k",
    "dual_height_blend": """WITH e AS (SELECT event_id, value AS v, (event_id % 10) / 10e0 AS u, (event_id % 13) / 13e0 AS w, (event_id % 5 - 1) / 3e0 AS m FROM events),
l AS (SELECT *, CASE WHEN m <= 0 THEN floor(v) ELSE floor(v) * (1 - least(m, 1e0)) + ceil(v) * least(m, 1e0) END AS lossy, CASE event_id % 4 WHEN 0 THEN 0.25e0 WHEN 1 THEN least(greatest(0.25e0 * (0.5e0 + 0.5e0 * sin((u + w * 0.7e0) * 12 + 2 * 0.5e0)), 0e0), 1e0) WHEN 2 THEN CASE WHEN u < 0.25e0 THEN 1e0 ELSE 0e0 END ELSE 0e0 END AS share FROM e)
SELECT event_id, round(share, 6) AS share, round(v + (lossy - v) * share * 1.5e0, 6) AS h FROM l""",
    "number_parsing": "SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN (p_size + 0.5e0) * 10 END AS v FROM part",
    "codebook_presets": "SELECT p_partkey, CAST(p_partkey * 7919 % 65536 AS INTEGER) AS code, abs(p_size / 50e0 - 0.3e0) <= 0.9999e0 * 0.02e0 AS active FROM part",
}
