"""Operators on elevation rasters held as arrays, and on recode results."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators.grids import repaired


def exact(c: Column) -> Column:
    """For sums that don't depend on the order of rows."""
    return c.cast("decimal(38,10)")


def height_error(tiles: DataFrame, full: str, lossy: str, scale: Column | float = 65536.0) -> DataFrame:
    """Error of a lossy array against the full one, over the shorter length, also over scale (1 where that isn't positive); no shuffle."""
    n = F.least(F.size(full), F.size(lossy))
    d = F.zip_with(F.slice(full, 1, n), F.slice(lossy, 1, n), lambda a, b: a.cast("double") - b.cast("double"))
    total = lambda f: F.aggregate(F.transform("_d", f), F.lit(0.0), lambda s, x: s + x)
    count = F.when(F.size("_d") > 0, F.size("_d"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    raw = {"rmse": zero(F.sqrt(total(lambda x: x * x) / count)), "mean_abs": zero(total(F.abs) / count), "max_abs": zero(F.array_max(F.transform("_d", F.abs)))}
    scale = scale if isinstance(scale, Column) else F.lit(scale)
    out = tiles.withColumn("_d", d).withColumns({"n_pixels": F.size("_d"), "n_identical": F.size(F.filter("_d", lambda x: x == 0)), **raw})
    return out.withColumns({f"{k}_norm": F.col(k) / F.when(scale > 0, scale).otherwise(1.0) for k in raw}).drop("_d")


def compression_metrics(stats: DataFrame) -> DataFrame:
    """stats (source_bytes, encoded_bytes, pixels) with ratio, savings, kilobytes and bytes a pixel; 0 where there is no source or pixel."""
    some = F.col("source_bytes") > 0
    ratio = F.when(some, F.col("encoded_bytes") / F.col("source_bytes")).otherwise(0.0)
    per_pixel = lambda c: F.when(F.col("pixels") > 0, F.col(c) / F.col("pixels")).otherwise(0.0)
    return stats.withColumns({"ratio": ratio, "savings": F.when(some, 1 - ratio).otherwise(0.0), "encoded_kb": F.col("encoded_bytes") / 1024, "bytes_per_pixel": per_pixel("encoded_bytes"), "source_bytes_per_pixel": per_pixel("source_bytes")})


def recode_report(stats: DataFrame, key: str) -> DataFrame:
    """Bytes, ratio, pixel-weighted error and identical share of recoded tiles for each key; partial sums before the shuffle."""
    over = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b).cast("double")).otherwise(0.0), 6)
    sums = {"_source": "source_bytes", "_encoded": "encoded_bytes", "_pixels": "pixels", "_identical": "identical"}
    found = stats.groupBy(key).agg(
        F.count("*").alias("tile_count"), *[F.sum(exact(F.col(c))).alias(k) for k, c in sums.items()], F.sum(exact(F.col("rmse") * F.col("pixels"))).alias("_weighted"), F.max("rmse").alias("max_rmse"), F.max("max_abs").alias("max_abs")
    )
    return found.select(
        key, "tile_count", F.round(F.col("_source").cast("double"), 4).alias("total_source"), F.round(F.col("_encoded").cast("double"), 4).alias("total_encoded"), over("_encoded", "_source").alias("ratio"),
        over("_weighted", "_pixels").alias("mean_rmse"), over("_identical", "_pixels").alias("identical_fraction"), "max_rmse", "max_abs",
    )


def load_status(tiles: DataFrame, key: str, before: str = "running") -> DataFrame:
    """Alive tiles by phase for each key, and the phase of the whole after `before`.

    idle stays: it is left by a start only.  While tiles load it is running,
    with any alive tile and none loading it is done, and without one it stays.
    """
    n = {name: F.count_if(F.col("alive") & (F.col("phase") == p)) for name, p in (("pending", "loading"), ("completed", "ready"), ("failed", "failed"))}
    counts = tiles.groupBy(key).agg(F.count_if("alive").alias("total"), *[v.alias(k) for k, v in n.items()])
    status = F.when(F.col("pending") > 0, "running").when(F.col("total") > 0, "done").otherwise(before)
    return counts.withColumn("status", F.lit("idle") if before == "idle" else status)


def sample_stats(tiles: DataFrame, pixels: str) -> DataFrame:
    """tiles with low, high and mean of all their samples."""
    total = F.aggregate(F.transform(pixels, lambda v: v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return tiles.withColumns({"low": F.array_min(pixels), "high": F.array_max(pixels), "mean": F.when(F.size(pixels) > 0, total / F.size(pixels))})


def pixel_stats(tiles: DataFrame, key: str, pixels: str, bad: float = -200.0) -> DataFrame:
    """Least, greatest and mean sample of each tile with their positions (the first of ties); samples equal to `bad` are counted and left out."""
    valid = F.filter(pixels, lambda v: v != bad)
    at = lambda c: F.array_position(F.col(pixels), c).cast("int") - 1
    out = sample_stats(tiles.withColumn("_valid", valid), "_valid")
    return out.select(key, "low", "high", "mean", at(F.col("low")).alias("argmin"), at(F.col("high")).alias("argmax"), (F.size(pixels) - F.size("_valid")).alias("n_bad"))


def round_trip_rmse(tiles: DataFrame, key: str, original: str, decoded: str, bad_above: float = 3e8, fill: float = -200.0) -> DataFrame:
    """Root of the mean squared error of decoded arrays for each key; nodata of the original counts as fill."""
    clean = F.transform(original, lambda v: F.when(v > bad_above, F.lit(fill)).otherwise(v.cast("double")))
    squares = F.zip_with(clean, decoded, lambda a, b: (b.cast("double") - a) * (b.cast("double") - a))
    sums = tiles.select(key, F.aggregate(squares, F.lit(0.0), lambda s, x: s + x).alias("_s"), F.size(original).alias("_n"))
    return sums.groupBy(key).agg(F.sqrt(F.sum("_s") / F.sum("_n")).alias("rmse"))


def encoding_pairs(encodings: DataFrame, key: str, quality: str, lossy: float, full: float = 1.0) -> DataFrame:
    """Full and lossy encoding of each key side by side: their other columns as full_* and lossy_*."""
    rest = [c for c in encodings.columns if c not in (key, quality)]
    side = lambda q, name: encodings.filter(F.col(quality) == q).select(key, *[F.col(c).alias(f"{name}_{c}") for c in rest])
    return side(full, "full").join(side(lossy, "lossy"), key)


def row_sight(tiles: DataFrame, pixels: str, width: int, eye: float) -> DataFrame:
    """tiles with `visible`, an array of flags: no cell nearer on its row stands at a steeper slope from the eye over the row's first cell.

    Each tile is read where it lies, as an array; nothing is shuffled.
    """

    def flags(row: Column) -> Column:
        slope = F.transform(row, lambda v, x: F.when(x > 0, (v - (row[0] + eye)) / x))
        state = F.struct(F.lit(None).cast("double").alias("most"), F.array().cast("array<boolean>").alias("seen"))
        step = lambda s, v: F.struct(F.greatest(s["most"], v).alias("most"), F.array_append(s["seen"], F.coalesce(v >= s["most"], F.lit(True))).alias("seen"))
        return F.aggregate(slope, state, step, lambda s: s["seen"])

    rows = F.transform(F.sequence(F.lit(0), F.floor(F.size(pixels) / width).cast("int") - 1), lambda y: F.transform(F.slice(pixels, y * width + 1, width), lambda v: v.cast("double")))
    return tiles.withColumn("visible", F.flatten(F.transform(rows, flags)))


def recode(tiles: DataFrame, pixels: str, quality: str) -> DataFrame:
    """tiles with the outcome of a lossy round trip: status, error, source_bytes, encoded_bytes, lossy (the decoded samples).

    Stands in for the image codec: samples are rounded to a step of
    2^(12 * quality) and packed.  Failures are data: a tile without samples
    has status `error` and its reason, and the others go on.
    """

    def one(samples: list | None, q: float | None) -> dict:
        if not samples:
            return {"status": "error", "error": "no samples"}
        if q is None or not 0 <= q < 1:
            return {"status": "error", "error": f"quality {q} is not in 0 .. 1"}
        codes = np.array(samples, np.int32)
        step = int(round(2 ** (12 * q)))
        coded = (codes + step // 2) // step
        return {"status": "ok", "source_bytes": len(zlib.compress(codes.tobytes())), "encoded_bytes": len(zlib.compress(coded.astype(np.int32).tobytes())), "lossy": (coded * step).tolist()}

    kind = pa.struct([("status", pa.string()), ("error", pa.string()), ("source_bytes", pa.int64()), ("encoded_bytes", pa.int64()), ("lossy", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([one(v, q) for v, q in zip(batch.column(pixels).to_pylist(), batch.column(quality).to_pylist())], kind)
            for i, field in enumerate(kind):
                batch = batch.append_column(field.name, found.field(i))
            yield batch

    added = T.StructType.fromDDL("status string, error string, source_bytes long, encoded_bytes long, lossy array<int>").fields
    return tiles.mapInArrow(run, T.StructType([*tiles.schema.fields, *added]))


def recode_chain(tiles: DataFrame, pixels: str, width: int, height: int, quality: str) -> DataFrame:
    """tiles recoded, mended and measured in one pass: the columns of recode(), repair (what was mended in the decoded samples), and those of height_error() and compression_metrics() against the original.

    A tile that fails to recode keeps its status and error, with nulls for the
    rest; the others go on.  Nothing is shuffled.
    """
    coded = recode(tiles, pixels, quality)
    mended = repaired(coded, "lossy", width, height, F.coalesce(F.col(quality), F.lit(0.0)))
    ok = F.col("status") == "ok"
    mended = mended.withColumns({"repair": F.when(ok, F.col("repair")), "pixels": F.size("lossy")})
    measured = compression_metrics(height_error(mended, pixels, "lossy"))
    kept = [c for c in coded.columns if c not in ("source_bytes", "encoded_bytes")]
    return measured.select(*kept, *[F.when(ok, F.col(c)).alias(c) for c in measured.columns if c not in kept])
