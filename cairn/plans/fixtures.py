"""Small files made from the driver's tables, so that readers have something to read: archives, images, GPX and GeoJSON texts."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.sources.shared import fresh_folder, spread


def shape_archives(parts: DataFrame, faults: bool = False) -> DataFrame:
    """(path, content): a zipped shapefile for each brand, with a point for each part at (p_partkey, p_size).

    Even sizes have a z of their own, every seventh row of attributes is
    deleted, every fifth blank.  faults: brands that end in 2 are no archives,
    those in 3 hold no shapes, in the last record of those in 4 bytes are missing.
    """

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("p_partkey")
        shp, values = bytearray(100), bytearray()
        for i, (k, size) in enumerate(zip(rows["p_partkey"], rows["p_size"])):
            record = struct.pack("<i3d", 11, k, size, k / 2) if size % 2 == 0 else struct.pack("<i2d", 1, k, size)
            shp += struct.pack(">2i", i + 1, len(record) // 2) + record
            values += (b"*" if size % 7 == 0 else b" ") + (b"" if size % 5 == 0 else str(size * 10).encode()).rjust(8)
        field = b"Prop_Value\0" + b"N" + bytes(4) + bytes([8]) + bytes(15)
        dbf = struct.pack("<4xIHH", len(rows), 65, 9).ljust(32, b"\0") + field + b"\r" + values
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            if not faults or key[0][-1] != "3":
                z.writestr("data/POINTS.SHP", shp[:-4] if faults and key[0][-1] == "4" else shp)
            z.writestr("data/points.dbf", dbf)
        return pd.DataFrame({"path": [key[0]], "content": [out.getvalue()[::-1] if faults and key[0][-1] == "2" else out.getvalue()]})

    return spread(parts.select("p_brand", "p_partkey", "p_size"), "p_brand").groupBy("p_brand").applyInPandas(build, "path string, content binary")


def tiff_image(samples: np.ndarray, tile: int, origin: tuple[float, float], pixel: float) -> bytes:
    """A tiled TIFF file of 32-bit floats with its place on the ground."""
    h, w = samples.shape
    tiles = [samples[y : y + tile, x : x + tile].astype("<f4").tobytes() for y in range(0, h, tile) for x in range(0, w, tile)]
    n = len(tiles)
    entries = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 32), (259, 3, 1, 1), (322, 4, 1, tile), (323, 4, 1, tile), (339, 3, 1, 3)]
    base = 8 + 2 + 12 * (len(entries) + 4) + 4
    body = struct.pack("<3d", pixel, pixel, 0) + struct.pack("<6d", 0, 0, 0, *origin, 0)
    starts = [base + len(body) + 8 * n + sum(map(len, tiles[:i])) for i in range(n)]
    lists = struct.pack(f"<{n}I", *starts) + struct.pack(f"<{n}I", *map(len, tiles))
    entries += [(324, 4, n, base + len(body) if n > 1 else starts[0]), (325, 4, n, base + len(body) + 4 * n if n > 1 else len(tiles[0])), (33550, 12, 3, base), (33922, 12, 6, base + 24)]
    directory = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)
    return struct.pack("<2sHI", b"II", 42, 8) + directory + body + lists + b"".join(tiles)


#: Vectors on a side of a mosaic, and samples on a side of a vector.
MOSAIC, CELL = 16, 8


def tiff_mosaics(embeddings: DataFrame) -> str:
    """A folder in the shared store with an image m<k>.tif of each 256 vectors, in tiles of 32 x 32; vector v is the 8 x 8 square of number v % 256, -200 where there is none.

    A task writes each image whole under its own name, so a repeated task
    leaves the same file.
    """
    folder = fresh_folder(embeddings.sparkSession, "mosaics")

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        samples = np.full((MOSAIC * CELL, MOSAIC * CELL), -200, np.float32)
        for v, values in zip(rows["vec_id"], rows["embedding"]):
            y, x = divmod(v % MOSAIC**2, MOSAIC)
            samples[y * CELL : (y + 1) * CELL, x * CELL : (x + 1) * CELL] = np.array(values, np.float32).reshape(CELL, CELL)
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path)
        with system.open_output_stream(f"{path}/m{key[0]}.tif") as out:
            out.write(tiff_image(samples, 32, (80000.0, 624040.0), 10.0))
        return pd.DataFrame({"n": [len(rows)]})

    embeddings.select("vec_id", "embedding", F.expr(f"vec_id div {MOSAIC**2}").alias("k")).groupBy("k").applyInPandas(write, "n long").agg(F.sum("n")).first()
    return folder


def half_files(tiles: DataFrame, bits: str) -> DataFrame:
    """(path, content): bits as little-endian 16-bit numbers."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "content": [np.array(b, "<u2").tobytes() for b in frame["bits"]]})

    return tiles.select(F.col("vec_id").cast("string").alias("path"), F.col(bits).alias("bits")).mapInPandas(build, "path string, content binary")


def gpx_texts(events: DataFrame) -> DataFrame:
    """(doc, text): each user's events as one GPX document; a route for every fifth user, else a track with a segment for clicks and one for the rest."""
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    inner = lambda tag, clock: F.concat(F.lit(f'<{tag} lat="'), (F.col("event_id") % 90).cast("string"), F.lit('" lon="'), (F.col("event_id") % 7).cast("string"), F.lit('"><ele>'), F.col("value").cast("string"), F.lit("</ele>"), clock, F.lit(f"</{tag}>"))
    routes = F.col("user_id") % 5 == 0
    point = F.when(routes, inner("rtept", F.concat(F.lit("<name>"), F.col("event_type"), F.lit("</name>")))).otherwise(inner("trkpt", F.concat(F.lit("<time>"), stamp, F.lit("</time>"))))
    listed = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_type") == "click").alias("click"), point.alias("p")))).alias("ps"))
    join = lambda keep: F.array_join(F.transform(F.filter("ps", keep) if keep else F.col("ps"), lambda x: x["p"]), "")
    track = F.concat(F.lit("<trk><trkseg>"), join(lambda x: x["click"]), F.lit("</trkseg></trk><trk><name>rest</name><trkseg>"), join(lambda x: ~x["click"]), F.lit("</trkseg></trk>"))
    body = F.when(routes, F.concat(F.lit("<rte>"), join(None), F.lit("</rte>"))).otherwise(track)
    return listed.select(F.col("user_id").alias("doc"), F.concat(F.lit('<gpx creator="me">'), body, F.lit("</gpx>")).alias("text"))


def geojson_texts(parts: DataFrame) -> DataFrame:
    """(doc, text): a feature collection for each part, of another geometry for each remainder of its key by 8."""
    k, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    two, three = F.concat(F.lit("["), k, F.lit(","), s, F.lit("]")), F.concat(F.lit("["), k, F.lit(","), s, F.lit(",7]"))
    wrap = lambda kind, body: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), body, F.lit("}"))
    bracket = lambda c, n: F.concat(F.lit("[" * n), c, F.lit("]" * n))
    pair = F.concat(two, F.lit(","), three)
    kind = F.col("p_partkey") % 8
    both = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), wrap("Point", two), F.lit(',{"type":"GeometryCollection","geometries":['), wrap("LineString", bracket(pair, 1)), F.lit("]}]}"))
    shape = (
        F.when(kind == 0, wrap("Point", three)).when(kind == 1, wrap("MultiPoint", bracket(pair, 1))).when(kind == 2, wrap("LineString", bracket(pair, 1))).when(kind == 3, wrap("MultiLineString", bracket(pair, 2)))
        .when(kind == 4, wrap("Polygon", bracket(pair, 2))).when(kind == 5, wrap("MultiPolygon", bracket(pair, 3))).when(kind == 6, both).otherwise("null")
    )
    height = F.when(F.col("p_size") % 3 == 0, s).when(F.col("p_size") % 3 == 1, F.concat(F.lit('" '), s, F.lit('.5 "'))).otherwise('"tall"')
    text = F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"PROP_VALUE":'), height, F.lit('},"geometry":'), shape, F.lit("}]}"))
    return parts.select(F.col("p_partkey").alias("doc"), F.when(F.col("p_partkey") % 2 == 0, text).otherwise(F.concat(F.lit("["), text, F.lit("]"))).alias("text"))
