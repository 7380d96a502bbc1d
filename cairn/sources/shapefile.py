"""Contour points from zipped shapefiles: archives are decoded in tasks, joined and filtered as DataFrames.

What can't be read is a row like any other, with `error` and nothing else of
its kind, so one bad archive doesn't stop the others; results() tells for each
archive how it went.
"""

from __future__ import annotations

import io
import os
import struct
import zipfile
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.formats import strict_number
from cairn.operators.mesh import triangulate
from cairn.sources.shared import stored

HEIGHT_FIELD = "prop_value"
#: Shape types (fixed values): single points, point lists, lists in parts; the higher ones carry z.
SINGLE, LISTS, PARTS, WITH_Z = (1, 11), (8, 18), (3, 5, 13, 15), (11, 13, 15, 18)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


#: Rows of a file that go to Spark at once.
SLICE = 20_000


def slices(n: int) -> Iterator[slice]:
    """Parts of n rows, at least one."""
    return (slice(at, at + SLICE) for at in range(0, max(n, 1), SLICE))


MEMBER = "archive string, stem string, ext string, content binary, error string"
POINT = "archive string, stem string, record_ix long, point_ix long, x double, y double, z double, error string"


#: What an archive that can't be opened raises, and one without shapes.
UNREADABLE = (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, ValueError)


def member_files(content: bytes) -> dict[tuple[str, str], bytes]:
    """The .shp and .dbf members of an archive by (stem, extension), in small letters; the last of members of one name counts."""
    found = {}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for entry in z.infolist():
            stem, ext = os.path.splitext(os.path.basename(entry.filename).lower())
            if not entry.is_dir() and ext in (".shp", ".dbf"):
                found[stem, ext[1:]] = z.read(entry)
    if not any(ext == "shp" for _, ext in found):
        raise ValueError("holds no shapes")
    return found


def members(found: DataFrame) -> DataFrame:
    """(archive, stem, ext, content, error) of the .shp and .dbf members of archives (path, content); the last of members of one name counts.

    An archive that is none, or holds no .shp member, is a row with an error.
    """

    def listed(archive: str, content: bytes | None) -> list[tuple]:
        try:
            return [(archive, stem, ext, body, None) for (stem, ext), body in sorted(member_files(content or b"").items())]
        except UNREADABLE as e:
            return [(archive, None, None, None, str(e) if isinstance(e, ValueError) else f"not read: {e}")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, content in zip(frame["path"], frame["content"]):
                yield pd.DataFrame(listed(archive, content), columns=["archive", "stem", "ext", "content", "error"])

    return found.select("path", "content").mapInPandas(run, MEMBER)


def shape_coordinates(shape: bytes) -> np.ndarray:
    """(x, y, z) rows of one record; z is NaN for flat shapes, and null or unknown shapes have no rows."""
    kind = struct.unpack_from("<i", shape)[0]
    if kind in SINGLE:
        x, y, *z = struct.unpack_from("<3d" if kind in WITH_Z else "<2d", shape, 4)
        return np.array([[x, y, z[0] if z else np.nan]])
    if kind in LISTS:
        n, at = struct.unpack_from("<i", shape, 36)[0], 40
    elif kind in PARTS:
        parts, n = struct.unpack_from("<2i", shape, 36)
        at = 44 + 4 * parts
    else:
        return np.zeros((0, 3))
    xy = np.frombuffer(shape, "<f8", 2 * n, at).reshape(n, 2)
    z = np.frombuffer(shape, "<f8", n, at + 16 * n + 16) if kind in WITH_Z else np.full(n, np.nan)
    return np.column_stack([xy, z])


def record_places(stem: str, content: bytes) -> np.ndarray:
    """(start, size) of every record of one .shp file, without its header."""
    at, found = 100, array("q")
    while at < len(content):
        size = 2 * struct.unpack_from(">i", content, at + 4)[0] if at + 8 <= len(content) else -1
        if size < 4 or at + 8 + size > len(content):
            raise ValueError(f"record {len(found) // 2} of {stem}.shp is cut off")
        found.extend((at + 8, size))
        at += 8 + size
    return np.array(found, np.int64).reshape(-1, 2)


def shape_slices(archive: str, stem: str, content: bytes) -> Iterator[pd.DataFrame]:
    """All points of one .shp file, those of SLICE records at once; a file that can't be decoded raises before the first."""
    places, found = record_places(stem, content), []
    for part in slices(len(places)):
        parts = [shape_coordinates(content[at : at + size]) for at, size in places[part].tolist()]
        sizes = np.array([len(x) for x in parts], np.int64)
        xyz = np.concatenate(parts) if parts else np.zeros((0, 3))
        found.append((part.start + np.repeat(np.arange(len(parts)), sizes), np.arange(len(xyz)) - np.repeat(np.cumsum(sizes) - sizes, sizes), xyz))
    return (pd.DataFrame({"archive": archive, "stem": stem, "record_ix": record, "point_ix": point, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}) for record, point, xyz in found)


def shape_table(archive: str, stem: str, content: bytes) -> pd.DataFrame:
    """All points of one .shp file."""
    return pd.concat(list(shape_slices(archive, stem, content)), ignore_index=True)


def shapes(found: DataFrame) -> DataFrame:
    """(archive, stem, record_ix, point_ix, x, y, z, error) of members(); every record counts in record_ix, null shapes too.

    A file with a record that is cut off gives no points, as do archives that
    weren't read; each is a row with the error, without a record.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, stem, content, error in zip(frame["archive"], frame["stem"], frame["content"], frame["error"]):
                try:
                    if error is not None:
                        raise ValueError(error)
                    tables = shape_slices(archive, stem, content)
                except (ValueError, struct.error) as e:
                    yield pd.DataFrame({"archive": [archive], "stem": [stem], "record_ix": [-1], "point_ix": [-1], "x": [np.nan], "y": [np.nan], "z": [np.nan], "error": [str(e)]})
                    continue
                for table in tables:
                    yield table.assign(error=pd.Series([None] * len(table), dtype=object))

    return found.filter("ext = 'shp' OR error IS NOT NULL").mapInPandas(run, POINT)


def attribute_slices(archive: str, stem: str, content: bytes, field: str) -> Iterator[pd.DataFrame]:
    """One field of all rows of one .dbf file as text, SLICE rows at once; deleted rows, and all if the field is missing, are null."""
    rows, header, width = struct.unpack_from("<IHH", content, 4)
    at, offset, place = 32, 1, None
    while at + 32 <= header and content[at] != 0x0D:
        name = content[at : at + 11].split(b"\0")[0].decode("ascii", "replace").replace(" ", "").lower()
        if name == field and place is None:
            place = (offset, offset + content[at + 16])
        at, offset = at + 32, offset + content[at + 16]
    whole = min(rows, (len(content) - header) // width) if width else 0
    every = np.frombuffer(content, np.uint8, whole * width, header).reshape(whole, width)
    for part in slices(whole):
        table = every[part]
        raw = pd.Series([None] * len(table), dtype=object)
        if place:
            cells = np.ascontiguousarray(table[:, place[0] : place[1]]).view(f"S{place[1] - place[0]}").ravel()
            raw = pd.Series(np.char.decode(cells, "ascii", "replace"), dtype=object).mask(table[:, 0] == ord("*"), None)
        yield pd.DataFrame({"archive": archive, "stem": stem, "record_ix": part.start + np.arange(len(table)), "raw": raw})


def attribute_table(archive: str, stem: str, content: bytes, field: str) -> pd.DataFrame:
    """attribute_slices() as one table."""
    return pd.concat(list(attribute_slices(archive, stem, content, field)), ignore_index=True)


def heights(found: DataFrame, field: str = HEIGHT_FIELD) -> DataFrame:
    """(archive, stem, record_ix, height): an attribute as a number; deleted rows, blanks and other text are null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in zip(frame["archive"], frame["stem"], frame["content"]):
                yield from attribute_slices(*row, field)

    read = found.filter("ext = 'dbf'").mapInPandas(run, "archive string, stem string, record_ix long, raw string")
    return read.select("archive", "stem", "record_ix", strict_number(F.col("raw")).alias("height"))


def contour_points(found: DataFrame) -> DataFrame:
    """(archive, stem, record_ix, point_ix, x, y, h) of members(): finite points; the attribute wins over the shape's own z."""
    return finite_points(with_heights(shapes(found), found))


def with_heights(shaped: DataFrame, found: DataFrame) -> DataFrame:
    """shapes() with h, the attribute or else the shape's own z."""
    joined = shaped.join(heights(found), ["archive", "stem", "record_ix"], "left")
    return joined.select("archive", "stem", "record_ix", "point_ix", "x", "y", F.coalesce("height", F.nanvl("z", F.lit(None).cast("double"))).alias("h"), "error")


def finite_points(points: DataFrame) -> DataFrame:
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("x", "y", "h")]
    return points.filter(F.col("error").isNull() & finite[0] & finite[1] & finite[2]).select("archive", "stem", "record_ix", "point_ix", "x", "y", "h")


def contour_mesh(points: DataFrame) -> DataFrame:
    """(archive, tid, a, b, c): triangles of each archive's contour_points(), numbered in order of stem, record and point."""
    order = Window.partitionBy("archive").orderBy("stem", "record_ix", "point_ix")
    return triangulate(points.withColumn("vid", F.row_number().over(order) - 1), "archive")


def results(found: DataFrame, least: int = 3) -> DataFrame:
    """(archive, status, error, n_points, n_triangles) for each archive of members(): `ok`, or `error` where it can't be read or has fewer than `least` points.

    An archive with one bad file is an error as a whole; its points still count.
    """
    read = stored(with_heights(shapes(found), found), "shapes")
    points = finite_points(read)
    faults = read.groupBy("archive").agg(F.min("error").alias("_fault"))
    counted = points.groupBy("archive").agg(F.count("*").alias("n_points"))
    meshed = contour_mesh(points).groupBy("archive").agg(F.count("*").alias("n_triangles"))
    out = faults.join(counted, "archive", "left").join(meshed, "archive", "left").fillna(0, ["n_points", "n_triangles"])
    few = F.concat(F.col("n_points").cast("string"), F.lit(f" points; {least} are needed"))
    error = F.coalesce("_fault", F.when(F.col("n_points") < least, few))
    return out.select("archive", F.when(error.isNull(), "ok").otherwise("error").alias("status"), error.alias("error"), "n_points", "n_triangles")
