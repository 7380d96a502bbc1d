"""TIFF windows: layouts, packings, bytes that are read, slices of large files, faults as rows."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.plans.fixtures import tiff_image
from cairn.sources import tiff


def pack_lzw(data):
    """An LZW stream by the format's rules: codes widen one entry early, 12 bits at most, then a clear."""
    out, bits = 0, 0

    def put(code, width):
        nonlocal out, bits
        out, bits = out << width | code, bits + width

    put(256, 9)
    table, word, width = {bytes([i]): i for i in range(256)}, b"", 9
    free = 258
    for i in range(len(data)):
        byte = data[i : i + 1]
        if word + byte in table:
            word += byte
            continue
        put(table[word], width)
        table[word + byte] = free
        free += 1
        width = min(12, max(9, free.bit_length()))
        if free == 4095:
            put(256, 12)
            table, free, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = byte
    if word:
        put(table[word], width)
        free += 1
        width = min(12, max(9, free.bit_length()))
    put(257, width)
    bits_over = -bits % 8
    return (out << bits_over).to_bytes((bits + bits_over) // 8, "big")


def difference(block, predictor, order):
    """A tile's bytes (row, column, band) before packing."""
    if predictor == 2:
        return np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1])).astype(block.dtype.newbyteorder(order)).tobytes()
    if predictor == 3:
        rows, columns, bands = block.shape
        planes = block.astype(block.dtype.newbyteorder(">")).reshape(rows, columns * bands, 1).view(np.uint8).transpose(0, 2, 1).reshape(rows, -1, bands)
        return np.diff(planes, axis=1, prepend=np.zeros_like(planes[:, :1])).tobytes()
    return block.astype(block.dtype.newbyteorder(order)).tobytes()


def write_tiff(samples, order="<", big=False, tile=None, strip_rows=None, packing=1, predictor=1, planar=1):
    """samples (row, column, band) as a file of any layout."""
    h, w, bands = samples.shape
    tw, th = tile or (w, strip_rows or h)
    blocks = []
    for part in [samples] if planar == 1 else [samples[:, :, b : b + 1] for b in range(bands)]:
        for y in range(0, h, th):
            for x in range(0, w, tw):
                block = part[y : y + th, x : x + tw]
                if tile:
                    block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)))
                raw = difference(block, predictor, order)
                blocks.append(zlib.compress(raw) if packing == 8 else pack_lzw(raw) if packing == 5 else raw)
    kinds = {"H": 3, "I": 4, "Q": 16}
    long = "Q" if big else "I"
    entries = [(256, "H", [w]), (257, "H", [h]), (258, "H", [samples.dtype.itemsize * 8] * bands), (259, "H", [packing]), (277, "H", [bands]), (284, "H", [planar]), (317, "H", [predictor]), (339, "H", [{"u": 1, "i": 2, "f": 3}[samples.dtype.kind]] * bands)]
    entries += [(322, "H", [tw]), (323, "H", [th])] if tile else [(278, "H", [th])]
    where, sizes = (324, 325) if tile else (273, 279)
    entries = sorted([*entries, (where, long, [0] * len(blocks)), (sizes, "I", [len(b) for b in blocks])])
    word, head, size = (8, 16, 20) if big else (4, 8, 12)
    base = head + (8 if big else 2) + size * len(entries) + word
    for round_ in (0, 1):
        extra, listed = b"", b""
        for tag, code, values in entries:
            body = struct.pack(order + code * len(values), *values)
            place = body.ljust(word, b"\0") if len(body) <= word else struct.pack(order + long, base + len(extra))
            extra += b"" if len(body) <= word else body
            listed += struct.pack(order + "HH" + long, tag, kinds[code], len(values)) + place
        starts = np.cumsum([base + len(extra), *[len(b) for b in blocks]])[:-1]
        entries = [(t, c, [int(x) for x in starts] if t == where else v) for t, c, v in entries]
    magic = b"II" if order == "<" else b"MM"
    lead = magic + (struct.pack(order + "HHHQ", 43, 8, 0, head) if big else struct.pack(order + "HI", 42, head))
    return lead + struct.pack(order + ("Q" if big else "H"), len(entries)) + listed + bytes(word) + extra + b"".join(blocks)


LAYOUTS = [
    dict(strip_rows=2, packing=8), dict(order=">", strip_rows=3), dict(tile=(16, 16), packing=5), dict(tile=(16, 32), packing=8, predictor=2), dict(order=">", tile=(16, 16), packing=5, predictor=2),
    dict(tile=(16, 16), big=True), dict(order=">", strip_rows=5, big=True, packing=8), dict(tile=(16, 16), planar=2, packing=8), dict(packing=5, predictor=2, strip_rows=7),
]


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("kind", ["i2", "u1", "f4", "i4"])
def test_layouts(tmp_path, layout, kind):
    rng = np.random.default_rng(1)
    samples = (rng.normal(size=(37, 53, 2)) * 50 + 100).astype(kind)
    if kind == "f4" and layout.get("predictor") == 2:
        layout = layout | {"predictor": 3}
    (tmp_path / "a.tif").write_bytes(write_tiff(samples, **layout))
    image = tiff.Image(tiff.Ranges(f"file://{tmp_path}/a.tif"))
    want = np.full((60, 80), -9.0)
    want[5 : 5 + 37, 7 : 7 + 53] = samples[:, :, 1]
    assert (image.window(-7, -5, 73, 55, -9.0, band=1) == want).all()
    assert (image.window(20, 10, 41, 33, -9.0) == samples[10:33, 20:41, 0]).all()


def test_window_reads_its_tiles_only(tmp_path):
    samples = np.arange(512 * 512, dtype=np.float32).reshape(512, 512, 1)
    (tmp_path / "a.tif").write_bytes(write_tiff(samples, tile=(64, 64)))
    source = tiff.Ranges(f"file://{tmp_path}/a.tif")
    image = tiff.Image(source)
    header = source.bytes_read
    assert header < 1000
    assert (image.window(100, 100, 150, 150, -1) == samples[100:150, 100:150, 0]).all()
    # Four tiles of 16 KB and their places, of 64.
    assert 4 * 16384 <= source.bytes_read - header <= 4 * 16384 + 4 * 16 + 2 * tiff.NEAR


def test_source_reads_slices_and_boxes(spark, tmp_path):
    tiff.register(spark)
    samples = np.arange(200 * 300, dtype=np.int32).reshape(200, 300, 1)
    for name in ("a", "b"):
        (tmp_path / f"{name}.tif").write_bytes(write_tiff(samples, tile=(32, 32), packing=8))
    (tmp_path / "c.tif").write_bytes(b"II*\0nothing here")
    (tmp_path / "_d.tif").write_bytes(b"hidden")
    (tmp_path / "e.txt").write_bytes(b"other")
    read = lambda: spark.read.format("tiff").option("window", "70x70").option("pathGlobFilter", "*.tif")
    whole = read().load(f"file://{tmp_path}")
    cut = read().option("partitionBytes", "20000").load(f"file://{tmp_path}")
    assert cut.rdd.getNumPartitions() > whole.rdd.getNumPartitions()
    rows = lambda df: sorted((r.path, r.status, r.left or 0, r.top or 0, r.pixels) for r in df.collect())
    got = rows(whole)
    assert got == rows(cut) and [r[1] for r in got].count("ok") == 2 * 5 * 3 and [r[1] for r in got].count("error") == 1
    one = next(r for r in got if r[2] == 280 and r[3] == 140)
    want = np.full((70, 70), -200.0)
    want[:60, :20] = samples[140:, 280:, 0]
    assert one[4] == want.ravel().tolist()
    boxed = read().option("box", "75,10,130,60").load(f"file://{tmp_path}/a.tif").collect()
    assert [(r.left, r.top) for r in boxed] == [(70, 0)] and boxed[0].read_bytes < (tmp_path / "a.tif").stat().st_size / 4
    with pytest.raises(Exception, match="cut off|TIFF"):
        read().option("mode", "FAILFAST").load(f"file://{tmp_path}").count()


def test_windows_that_a_table_asks_for(spark, tmp_path):
    samples = np.arange(64 * 64, dtype=np.uint16).reshape(64, 64, 1)
    (tmp_path / "a.tif").write_bytes(write_tiff(samples, tile=(16, 16), packing=5))
    path = f"file://{tmp_path}/a.tif"
    asked = [(i, path, i % 60, i % 50, i % 60 + 4, i % 50 + 4, "own") for i in range(3000)] + [(9001, path, 5, 5, 5, 9, "empty"), (9002, None, 0, 0, 1, 1, "none"), (9003, f"file://{tmp_path}/no.tif", 0, 0, 1, 1, "missing"), (9004, path, 0, None, 1, 1, "null")]
    wanted = spark.createDataFrame(asked, "id long, path string, left int, top int, right int, bottom int, note string")
    got = {r.id: r for r in tiff.read_windows(wanted.repartition(3)).collect()}
    assert len(got) == len(asked)
    assert all(got[i].pixels == samples[i % 50 : i % 50 + 4, i % 60 : i % 60 + 4, 0].ravel().tolist() and got[i].note == "own" for i in range(3000))
    assert [got[i].status for i in range(9001, 9005)] == ["error"] * 4
    with pytest.raises(Exception):
        tiff.read_windows(wanted.filter(F.col("id") == 9003), strict=True).collect()


def test_place_on_the_ground(tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff_image(np.arange(64, dtype=np.float32).reshape(8, 8), 4, (80000.0, 624040.0), 10.0))
    row = tiff.Cut(target=(2, 4)).row("a", tiff.Image(tiff.Ranges(f"file://{tmp_path}/a.tif")), (2, 0, 6, 8), 0)
    assert (row["xll"], row["yll"], row["width"], row["height"]) == (80020.0, 623960.0, 2, 4)
    assert row["pixels"].tolist() == [2, 4, 18, 20, 34, 36, 50, 52]


def test_lzw_of_many_entries():
    data = np.random.default_rng(3).integers(0, 40, 20_000).astype(np.uint8).tobytes()
    assert tiff.lzw(pack_lzw(data)) == data
