"""Readers and streams on small files written here."""

import io
import struct
import zipfile
import zlib
from types import SimpleNamespace

import numpy as np
import pytest

from cairn.sources import catalogs, gpx, rasters, shapefile
from cairn.streaming import tiles


def test_gpx(spark, tmp_path):
    head = '<gpx creator="me"><metadata><name>walk</name></metadata>'
    (tmp_path / "a.gpx").write_text(head + '<trk><trkseg><trkpt lat="51.5" lon="-1"><ele>4</ele><time>2013-04-15T17:56:17Z</time></trkpt><trkpt lat="52" lon="-2"/></trkseg></trk><trk><trkseg><trkpt lat="53" lon="-3"/></trkseg></trk></gpx>')
    (tmp_path / "b.gpx").write_text('<gpx creator="you"><rte><rtept lat="1" lon="2"><name>n</name></rtept><rtept lat="3" lon="4"/></rte></gpx>')
    docs = gpx.read_gpx(spark, f"file://{tmp_path}")
    rows = {(r.kind, r.segment_ix, r.point_ix): r for r in gpx.track_points(docs).collect()}
    assert sorted(rows) == [("route", 0, 0), ("route", 0, 1), ("track", 0, 0), ("track", 0, 1), ("track", 1, 0)]
    assert rows["track", 0, 0].ele == 4 and rows["track", 0, 1].ts is None and rows["track", 1, 0].lat == 53 and rows["route", 0, 0].name == "n"
    assert {(r.creator, r.name) for r in gpx.metadata(docs).collect()} == {("me", "walk"), ("you", "n")}
    whole = gpx.read_gpx(spark, f"file://{tmp_path}/a.gpx")
    assert gpx.metadata(whole).first().ts.isoformat().startswith("2013-04-15T17:56:17") and gpx.with_tracks(docs).count() == 2
    (tmp_path / "c").mkdir()
    (tmp_path / "c/none.gpx").write_text('<gpx creator="me"><metadata><name>empty</name></metadata></gpx>')
    with pytest.raises(Exception, match="no track or route"):
        gpx.track_points(gpx.with_tracks(gpx.read_gpx(spark, f"file://{tmp_path}/c"))).collect()


def archive(records, values):
    shp = bytes(100) + b"".join(struct.pack(">2i", i + 1, len(r) // 2) + r for i, r in enumerate(records))
    field = b"Prop_Value\0" + b"N" + bytes(4) + bytes([8]) + bytes(15)
    dbf = struct.pack("<4xIHH", len(values), 65, 9).ljust(32, b"\0") + field + b"\r" + b"".join(flag + v.rjust(8).encode() for flag, v in values)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("data/SU42.SHP", shp)
        z.writestr("data/SU42.dbf", dbf)
    return out.getvalue()


def test_contour_points(spark, tmp_path):
    line = struct.pack("<i32x2ii4d", 3, 1, 2, 0, 5.0, 6.0, float("nan"), 8.0)
    records = [struct.pack("<i2d", 1, 1.0, 2.0), struct.pack("<i", 0), struct.pack("<i3d", 11, 3.0, 4.0, 9.0), line, struct.pack("<i2d", 1, 7.0, 7.0)]
    (tmp_path / "a.zip").write_bytes(archive(records, [(b" ", "12.5"), (b" ", "1"), (b"*", "3"), (b" ", "20"), (b" ", "bad")]))
    found = shapefile.members(shapefile.archives(spark, f"file://{tmp_path}"))
    got = shapefile.contour_points(found).orderBy("record_ix", "point_ix").collect()
    assert [(r.stem, r.record_ix, r.x, r.y, r.h) for r in got] == [("su42", 0, 1, 2, 12.5), ("su42", 2, 3, 4, 9), ("su42", 3, 5, 6, 20)]


def test_catalog_round_trip(spark, tmp_path):
    rows = [(80000.0, 9640.0, 4096, 4096, "000_015-16bit.j2c"), (120960.0, 9640.0, 4096, 4096, "001_015-16bit.j2c")]
    made = catalogs.catalog_json(spark.createDataFrame(rows, "xllcorner double, yllcorner double, nrows int, ncols int, source_filename string"))
    made.write.text(f"file://{tmp_path}/catalog")
    got = catalogs.read_catalog(spark, f"file://{tmp_path}/catalog").orderBy("key").collect()
    assert [r.key for r in got] == ["120960, 9640", "80000, 9640"] and [tuple(r[1:6]) for r in got] == rows[::-1]


def test_shape_lists_and_faults(spark):
    head = lambda kind, n: struct.pack("<i32xi", kind, n)
    multi_z = head(18, 2) + struct.pack("<4d2d2d", 1, 2, 3, 4, 5, 6, 5, 6)
    line_z = struct.pack("<i32x2i2i", 13, 2, 3, 0, 1) + struct.pack("<6d2d3d", 1, 1, 2, 2, 3, 3, 7, 9, 7, 8, 9)
    records = [head(8, 2) + struct.pack("<4d", 1, 2, 3, 4), multi_z, line_z, struct.pack("<i", 31) + bytes(8)]
    table = shapefile.shape_table("a", "s", archive_shp(records))
    assert table[["record_ix", "point_ix", "x", "z"]].fillna(-1).values.tolist() == [[0, 0, 1, -1], [0, 1, 3, -1], [1, 0, 1, 5], [1, 1, 3, 6], [2, 0, 1, 7], [2, 1, 2, 8], [2, 2, 3, 9]]
    with pytest.raises(ValueError, match="cut off"):
        shapefile.shape_table("a", "s", archive_shp(records)[:-3])
    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    point = lambda x, y: struct.pack("<i3d", 11, x, y, 5)
    square = [point(x, y) for x in (0, 1) for y in (0, 1)]
    whole = archive(square, [(b" ", "7")] * 4)
    files = [("good", whole), ("empty", empty.getvalue()), ("cut", whole[: len(whole) // 2]), ("none", None), ("two", archive(square[:2], [(b" ", "7")] * 2)), ("short", archive([*square, point(9, 9)[:-4]], [(b" ", "7")] * 5))]
    found = shapefile.members(spark.createDataFrame(files, "path string, content binary"))
    got = {r.archive: (r.status, r.n_points, r.n_triangles, r.error) for r in shapefile.results(found).collect()}
    assert got["good"] == ("ok", 4, 2, None) and got["empty"] == ("error", 0, 0, "holds no shapes") and got["two"] == ("error", 2, 0, "2 points; 3 are needed")
    assert all(got[k][:3] == ("error", 0, 0) and got[k][3] for k in ("cut", "none", "short")) and len(got) == 6
    assert shapefile.contour_points(found).select("archive").distinct().count() == 2


def archive_shp(records):
    return bytes(100) + b"".join(struct.pack(">2i", i + 1, len(r) // 2) + r for i, r in enumerate(records))


def test_half_tiles_and_listing(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(np.array([0, 15360, 65535, 1], "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"\1\0\2")
    (tmp_path / ".c.bin").write_bytes(b"")
    found = rasters.listing(spark, f"file://{tmp_path}", "*.bin")
    assert sorted(r.name for r in found.collect()) == ["a.bin", "b.bin"]
    got = {r.path.rsplit("/", 1)[-1]: r for r in rasters.half_tiles(shapefile.archives(spark, f"file://{tmp_path}/[ab].bin"), 2, 2).collect()}
    assert got["a.bin"].bits == [0, 15360, 65535, 1] and got["a.bin"].whole and got["b.bin"].bits == [1] and not got["b.bin"].whole


def test_sidecar_files(spark, tmp_path):
    rows = [(80000.0, 9640.0, 4096, 4096, "000_015.j2c")]
    catalogs.write_sidecars(spark.createDataFrame(rows, "xllcorner double, yllcorner double, nrows int, ncols int, source_filename string"), f"file://{tmp_path}/s")
    assert [p.name for p in (tmp_path / "s").glob("tile=*")] == ["tile=000_015.j2c.json"]


def test_phases_stream(spark, tmp_path):
    events = [("a", 1, "touch", 0, 1.0, True), ("a", 2, "epoch", 0, 0.5, True), ("a", 3, "result", 0, 1.0, True), ("a", 4, "touch", 0, 1.0, True), ("a", 5, "result", 1, 0.5, False), ("b", 1, "touch", 0, 1.0, True), ("b", 2, "result", 0, 1.0, True)]
    schema = "tile string, ts timestamp, kind string, generation long, quality double, ok boolean"
    spark.createDataFrame(events, "tile string, s long, kind string, generation long, quality double, ok boolean").selectExpr("tile", "timestamp_seconds(s) AS ts", "kind", "generation", "quality", "ok").write.parquet(f"file://{tmp_path}/in")
    source = lambda: spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    for name, stream, mode in (("phases", tiles.phases(source()), "append"), ("alive", tiles.alive_intervals(source().select("tile", "ts"), "2 seconds", "1 second"), "append"), ("first", tiles.first_touches(source().select("tile", "ts"), "1 hour"), "append")):
        stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/{name}").start().awaitTermination(120)
    found = [(r.tile, r.phase, r.generation) for r in spark.table("phases").orderBy("tile", "ts").collect()]
    assert found == [("a", "loading", 0), ("a", "idle", 1), ("a", "loading", 1), ("a", "failed", 1), ("b", "loading", 0), ("b", "ready", 0)]
    assert sorted(r.tile for r in spark.table("first").collect()) == ["a", "b"]


def test_reconciling_and_debouncing_streams(spark, tmp_path):
    events = [("a", 1, "want"), ("a", 2, "want"), ("a", 3, "loaded"), ("a", 4, "drop"), ("b", 1, "want"), ("b", 2, "drop"), ("b", 3, "loaded"), ("c", 5, "want")]
    rows = spark.createDataFrame(events, "tile string, s long, kind string").selectExpr("tile", "tile AS track", "timestamp_seconds(s) AS ts", "kind")
    rows.write.parquet(f"file://{tmp_path}/in")
    source = lambda: spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    for name, stream in (("actions", tiles.reconciled(source().select("tile", "ts", "kind"))), ("gestures", tiles.debounced(source().select("track", "ts"), "1 second", "0 seconds"))):
        stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/{name}").start().awaitTermination(120)
    got = [(r.tile, r.ts.second, r.action) for r in spark.table("actions").orderBy("tile", "ts").collect()]
    assert got == [("a", 1, "add"), ("a", 4, "remove"), ("b", 1, "add"), ("b", 3, "remove"), ("c", 5, "add")]
    # Gestures end once the watermark has reached their end; that of `c` is the latest.
    assert sorted((r.track, r.n_steps) for r in spark.table("gestures").collect()) == [("a", 4), ("b", 3)]


def test_tile_steps():
    event = lambda kind, **k: SimpleNamespace(kind=kind, **({"generation": 0, "quality": 0.5, "ok": True} | k))
    state, seen = tiles.NEW, []
    for e in (event("touch"), event("result"), event("promote"), event("epoch", quality=0.1), event("touch"), event("result", generation=0), event("expire"), event("disable"), event("touch"), event("enable"), event("touch")):
        state, changed = tiles.step(state, e)
        seen.append((*state, changed))
    assert seen == [
        ("loading", 0, 1.0, None, None, True), ("ready", 0, 1.0, None, 1.0, True), ("ready", 0, 1.0, 1.0, None, True), ("idle", 1, 0.1, 1.0, None, True), ("loading", 1, 0.1, 1.0, None, True), ("loading", 1, 0.1, 1.0, None, False),
        ("idle", 2, 0.1, None, None, True), ("off", 2, 0.1, None, None, True), ("off", 2, 0.1, None, None, False), ("idle", 2, 0.1, None, None, True), ("loading", 2, 0.1, None, None, True),
    ]
