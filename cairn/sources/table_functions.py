"""Table functions for SQL: the points and the mesh of zipped shapefiles, a table of archives (path, content) as their argument.

register(spark), then for example

    SELECT * FROM contour_points(TABLE(SELECT path, content FROM archives))
    SELECT * FROM contour_mesh(TABLE(SELECT path, content FROM archives))

They take Arrow batches; Spark runs them where the rows lie.  (It refuses Arrow
functions on the right of LATERAL, so the table goes in whole and the path comes
out again.)  An archive that can't be read is one row with its error; see
shapefile.results for a summary of many.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cairn.operators.mesh import triangles
from cairn.sources.shapefile import HEIGHT_FIELD, UNREADABLE, attribute_table, member_files, shape_table

POINTS = {"archive": pa.string(), "stem": pa.string(), "record_ix": pa.int64(), "point_ix": pa.int64(), "x": pa.float64(), "y": pa.float64(), "h": pa.float64(), "error": pa.string()}
TRIANGLES = {"archive": pa.string(), "tid": pa.int64(), "a": pa.int64(), "b": pa.int64(), "c": pa.int64(), "error": pa.string()}


def table_of(kinds: dict[str, pa.DataType], columns: dict) -> pa.Table:
    """A table of the given columns; missing ones are null."""
    n = len(next(iter(columns.values())))
    return pa.table([pa.array(columns[c], kind, from_pandas=True) if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()], names=list(kinds))


def heights_of(content: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(stem, record, point, x y h) of the finite points of an archive, by stem: the attribute wins over the shape's own z."""
    files = member_files(content)
    for stem in sorted(s for s, ext in files if ext == "shp"):
        shape = shape_table("", stem, files[stem, "shp"])
        record = shape["record_ix"].to_numpy(np.int64)
        h = shape["z"].to_numpy(float)
        if (stem, "dbf") in files:
            raw = attribute_table("", stem, files[stem, "dbf"], HEIGHT_FIELD)["raw"]
            own = pd.to_numeric(raw.astype("object").map(lambda t: None if t is None else t.strip() or None), errors="coerce").to_numpy(float)
            known = record < len(own)
            given = np.where(known, own[np.minimum(record, max(0, len(own) - 1))] if len(own) else np.nan, np.nan)
            h = np.where(np.isnan(given), h, given)
        xyh = np.column_stack([shape["x"].to_numpy(float), shape["y"].to_numpy(float), h])
        keep = np.isfinite(xyh).all(axis=1)
        yield stem, record[keep], shape["point_ix"].to_numpy(np.int64)[keep], xyh[keep]


#: What an archive raises that can't be read, or holds too few points.
FAULTS = (*UNREADABLE, struct.error)


@F.arrow_udtf(returnType="archive string, stem string, record_ix bigint, point_ix bigint, x double, y double, h double, error string")
class ContourPoints:
    def eval(self, archives: pa.RecordBatch) -> Iterator[pa.Table]:
        for archive, content in zip(archives.column("path").to_pylist(), archives.column("content")):
            try:
                parts = list(heights_of(content.as_py() or b""))
            except FAULTS as e:
                yield table_of(POINTS, {"archive": [archive], "error": [str(e)]})
                continue
            for stem, record, point, xyh in parts:
                yield table_of(POINTS, {"archive": [archive] * len(record), "stem": [stem] * len(record), "record_ix": record, "point_ix": point, "x": xyh[:, 0], "y": xyh[:, 1], "h": xyh[:, 2]})


@F.arrow_udtf(returnType="archive string, tid bigint, a bigint, b bigint, c bigint, error string")
class ContourMesh:
    """Corners are numbers of contour_points' rows of an archive, in order of stem, record and point, from 0.  An archive is meshed by one task; mesh.triangulate takes larger sheets."""

    def eval(self, archives: pa.RecordBatch) -> Iterator[pa.Table]:
        for archive, content in zip(archives.column("path").to_pylist(), archives.column("content")):
            try:
                xyh = np.concatenate([p[3] for p in heights_of(content.as_py() or b"")])
                if len(xyh) < 3:
                    raise ValueError(f"{len(xyh)} points; 3 are needed")
            except FAULTS as e:
                yield table_of(TRIANGLES, {"archive": [archive], "error": [str(e)]})
                continue
            found = triangles(xyh[:, 0], xyh[:, 1])
            yield table_of(TRIANGLES, {"archive": [archive] * len(found), "tid": np.arange(len(found)), "a": found[:, 0], "b": found[:, 1], "c": found[:, 2]})


def register(spark: SparkSession) -> None:
    spark.udtf.register("contour_points", ContourPoints)
    spark.udtf.register("contour_mesh", ContourMesh)
