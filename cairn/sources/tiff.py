"""Windows of TIFF images of any size: only the header and the tiles under a window are read from a file.

`spark.read.format("tiff")` (after register()) cuts every image under a path
into windows of one size; read_windows() reads the windows that a table asks
for.  Both fetch byte ranges through Arrow's file systems (file, hdfs, s3 and
gs addresses), in the tasks.  Classic and big files; 8 to 64 bits; raw, LZW
or deflated strips and tiles; differencing of whole numbers and of floats; one
band of any number.  What can't be read is a row with status `error`.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cairn.sources.tile_sink import TileWriter

#: Tags, types and compressions of the format (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, BANDS, STRIP_ROWS, STRIP_BYTES, PLANES, PREDICTOR, TILE_W, TILE_H, TILES, TILE_BYTES, FORMAT, PIXEL, TIE = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339, 33550, 33922
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
RAW, LZW, DEFLATE = 1, 5, (8, 32946)
CLEAR, END = 256, 257

WINDOW = "path string, status string, error string, left int, top int, right int, bottom int, xll double, yll double, width int, height int, pixels array<double>, read_bytes long"
#: Tiles whose bytes lie no further apart are fetched together.
NEAR = 4096


class Ranges:
    """A file that is read by ranges; counts the bytes."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.file, self.bytes_read = system.open_input_file(path), 0

    def at(self, start: int, size: int) -> bytes:
        data = self.file.read_at(size, start)
        if len(data) < size:
            raise ValueError(f"cut off: {size} bytes at {start}, {len(data)} there")
        self.bytes_read += size
        return data


def lzw(data: bytes) -> bytes:
    """The bytes of an LZW stream: codes of 9 to 12 bits, most significant first, which grow one entry early."""
    out, table, held, bits, width, last = [], [], 0, 0, 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == END:
            break
        if code == CLEAR:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
            width = min(12, max(9, (len(table) + 1).bit_length()))
        last = entry
    return b"".join(out)


class Image:
    """The first image of a TIFF file, of which only what is asked for is read."""

    def __init__(self, source: Ranges):
        self.source = source
        head = source.at(0, 8)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack(self.order + "H", head[2:4])[0] if self.order else 0
        if version not in (42, 43):
            raise ValueError("no TIFF file")
        self.big = version == 43
        first = self.unpack("Q", source.at(8, 8))[0] if self.big else self.unpack("I", head[4:])[0]
        counter, size, word = ("Q", 20, 8) if self.big else ("H", 12, 4)
        count = self.unpack(counter, source.at(first, struct.calcsize("<" + counter)))[0]
        place = first + struct.calcsize("<" + counter)
        listed = source.at(place, count * size)
        # tag: (type, number of values, place of the values)
        self.entries = {}
        for end in range(size, count * size + 1, size):
            tag, kind, n = self.unpack("HHQ" if self.big else "HHI", listed[end - size : end - word])
            if kind in TYPES:
                inline = n * struct.calcsize("<" + TYPES[kind]) <= word
                self.entries[tag] = (TYPES[kind], n, place + end - word if inline else self.unpack("Q" if self.big else "I", listed[end - word : end])[0])
        one = lambda tag, default: self.values(tag)[0] if tag in self.entries else default
        self.width, self.height = one(WIDTH, 0), one(HEIGHT, 0)
        self.bands, self.chunky = one(BANDS, 1), one(PLANES, 1) == 1
        bits, form = one(BITS, 1), one(FORMAT, 1)
        if bits not in (8, 16, 32, 64) or form not in (1, 2, 3) or (form == 3 and bits == 8):
            raise ValueError(f"samples of {bits} bits of format {form} aren't read")
        self.dtype = np.dtype(self.order + {1: "u", 2: "i", 3: "f"}[form] + str(bits // 8))
        self.packed, self.predictor = one(COMPRESSION, RAW), one(PREDICTOR, 1)
        if self.packed not in (RAW, LZW, *DEFLATE):
            raise ValueError(f"compression {self.packed} isn't read")
        if self.predictor not in (1, 2, 3):
            raise ValueError(f"predictor {self.predictor} isn't read")
        self.tiled = TILES in self.entries
        self.tile_w, self.tile_h = (one(TILE_W, 0), one(TILE_H, 0)) if self.tiled else (self.width, min(one(STRIP_ROWS, self.height), self.height))
        if min(self.width, self.height, self.tile_w, self.tile_h) < 1:
            raise ValueError("no pixels")
        self.across, self.down = -(-self.width // self.tile_w), -(-self.height // self.tile_h)
        pixel, tie = self.values(PIXEL) if PIXEL in self.entries else (1.0, 1.0), self.values(TIE) if TIE in self.entries else (0.0,) * 6
        self.pixel = pixel[:2]
        self.left, self.top = tie[3] - tie[0] * pixel[0], tie[4] + tie[1] * pixel[1]

    def unpack(self, layout: str, data: bytes) -> tuple:
        return struct.unpack(self.order + layout, data)

    def values(self, tag: int, start: int = 0, n: int | None = None) -> tuple:
        """n values of a tag from the start-th on (all of them)."""
        kind, count, at = self.entries[tag]
        n = count - start if n is None else n
        if start + n > count:
            raise ValueError(f"tag {tag} has {count} values")
        size = struct.calcsize("<" + kind)
        return self.unpack(kind * n, self.source.at(at + start * size, n * size))

    def places(self, numbers: list[int]) -> dict[int, tuple[int, int]]:
        """Start and size of tiles, by number; the lists are read from the least to the greatest of each row of tiles."""
        starts, sizes = (TILES, TILE_BYTES) if self.tiled else (STRIPS, STRIP_BYTES)
        found, run = {}, []
        for k in [*numbers, None]:
            if run and (k is None or k != run[-1] + 1):
                found |= dict(zip(run, zip(self.values(starts, run[0], len(run)), self.values(sizes, run[0], len(run)))))
                run = []
            run.append(k)
        return found

    def raw(self, numbers: list[int]) -> Iterator[tuple[int, bytes]]:
        """Packed bytes of tiles; near ones are fetched in one range."""
        places = sorted(self.places(numbers).items(), key=lambda p: p[1])
        at = 0
        while at < len(places):
            end, until = at + 1, sum(places[at][1])
            while end < len(places) and places[end][1][0] <= until + NEAR:
                until = max(until, sum(places[end][1]))
                end += 1
            first = places[at][1][0]
            data = self.source.at(first, until - first)
            for k, (start, size) in places[at:end]:
                yield k, data[start - first : start - first + size]
            at = end

    def samples(self, data: bytes) -> np.ndarray:
        """(row, column, band) of a tile's bytes."""
        data = lzw(data) if self.packed == LZW else zlib.decompress(data) if self.packed in DEFLATE else data
        bands = self.bands if self.chunky else 1
        row = self.tile_w * bands
        if self.predictor == 3:
            planes = np.frombuffer(data, np.uint8)
            planes = planes[: len(planes) // (row * self.dtype.itemsize) * row * self.dtype.itemsize].reshape(-1, row * self.dtype.itemsize // bands, bands)
            planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(-1, self.dtype.itemsize, row)
            return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(self.dtype.newbyteorder(">")).reshape(-1, self.tile_w, bands)
        tile = np.frombuffer(data, self.dtype, len(data) // self.dtype.itemsize)
        tile = tile[: len(tile) // row * row].reshape(-1, self.tile_w, bands)
        return np.cumsum(tile, axis=1, dtype=self.dtype.newbyteorder("=")) if self.predictor == 2 else tile

    def window(self, left: int, top: int, right: int, bottom: int, fill: float, band: int = 0) -> np.ndarray:
        """Samples of a window; fill outside the image."""
        if not 0 <= band < self.bands:
            raise ValueError(f"band {band} of {self.bands}")
        out = np.full((bottom - top, right - left), fill, float)
        rows = range(max(0, top) // self.tile_h, -(-min(bottom, self.height) // self.tile_h))
        columns = range(max(0, left) // self.tile_w, -(-min(right, self.width) // self.tile_w))
        plane = 0 if self.chunky else band * self.across * self.down
        for k, data in self.raw([plane + ty * self.across + tx for ty in rows for tx in columns]):
            ty, tx = divmod(k - plane, self.across)
            tile = self.samples(data)
            x0, y0 = tx * self.tile_w, ty * self.tile_h
            a, b = max(left, x0), min(right, x0 + self.tile_w, self.width)
            c, d = max(top, y0), min(bottom, y0 + len(tile), self.height)
            if a < b and c < d:
                out[c - top : d - top, a - left : b - left] = tile[c - y0 : d - y0, a - x0 : b - x0, band if self.chunky else 0]
        return out


def linear(samples: np.ndarray, width: int, height: int) -> np.ndarray:
    """Samples at another size, interpolated; pixel 0 stays pixel 0, as the common reader of such images does it."""
    h, w = samples.shape
    x, y = np.arange(width) * (w / width), np.arange(height) * (h / height)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(np.ceil(x).astype(int), w - 1), np.minimum(np.ceil(y).astype(int), h - 1)
    fx, fy = x - x0, (y - y0)[:, None]
    rows = samples[:, x0] * (1 - fx) + samples[:, x1] * fx
    return rows[y0] * (1 - fy) + rows[y1] * fy


@dataclass(frozen=True)
class Cut:
    """How windows are cut: filled outside the image, resampled to target (width, height), of one band."""

    fill: float = -200.0
    target: tuple[int, int] | None = None
    band: int = 0

    def row(self, uri: str, image: Image, box: tuple[int, int, int, int], before: int) -> dict:
        left, top, right, bottom = box
        if right <= left or bottom <= top:
            raise ValueError("empty window")
        samples = image.window(*box, self.fill, self.band)
        if self.target:
            samples = linear(samples, *self.target)
        corner = {"xll": image.left + left * image.pixel[0], "yll": image.top - bottom * image.pixel[1]}
        height, width = samples.shape
        return {"path": uri, "status": "ok", "left": left, "top": top, "right": right, "bottom": bottom, **corner, "width": width, "height": height, "pixels": samples.ravel(), "read_bytes": image.source.bytes_read - before}


def failed(uri: str, error: Exception, box: tuple = (None,) * 4) -> dict:
    return {"path": uri, "status": "error", "error": str(error), **dict(zip(("left", "top", "right", "bottom"), box))}


#: What an unreadable file or window raises.
FAULTS = (OSError, ValueError, KeyError, IndexError, struct.error, zlib.error, pa.ArrowException)


def in_batches(rows: Iterator[dict], schema: pa.Schema, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Rows in record batches of about `most` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + (8 * len(row["pixels"]) if row.get("pixels") is not None else 0)
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def pair(text: str) -> tuple[int, int]:
    found = re.fullmatch(r"(\d+)x(\d+)", text)
    if not found or not all(int(x) for x in found.groups()):
        raise ValueError(f"{text} isn't a size like 256x256")
    return int(found[1]), int(found[2])


@dataclass
class Part(InputPartition):
    """Whole files, or the slice-th of `slices` runs of the windows of one."""

    uris: tuple[str, ...]
    slice: int = 0
    slices: int = 1


class TiffReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema = to_arrow_schema(schema)
        self.path, self.pattern = options["path"], options.get("pathglobfilter", "*")
        self.size = pair(options["window"]) if "window" in options else None
        self.cut = Cut(float(options.get("fill", -200.0)), pair(options["target"]) if "target" in options else None, int(options.get("band", 0)))
        self.box = tuple(int(x) for x in options["box"].split(",")) if "box" in options else None
        self.most = int(options.get("partitionbytes", 128 << 20))
        self.strict = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"

    def partitions(self) -> list[Part]:
        """From the list of files and their sizes alone: small ones together, large ones in slices of about partitionBytes."""
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(root)
        listed = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        head = self.path[: self.path.index("://") + 3] if "://" in self.path else "file://"
        name = lambda p: p.rsplit("/", 1)[-1]
        hidden = lambda p: any(x[0] in "._" for x in p[len(root) :].split("/") if x) if p != root else False
        files = sorted((f.path, f.size) for f in listed if f.type == fs.FileType.File and fnmatch(name(f.path), self.pattern) and not hidden(f.path))
        parts, held, size = [], [], 0
        for path, n in files:
            uri = head + path
            if n > self.most:
                slices = -(-n // self.most)
                parts += [Part((uri,), i, slices) for i in range(slices)]
                continue
            if held and size + n > self.most:
                parts.append(Part(tuple(held)))
                held, size = [], 0
            held.append(uri)
            size += n
        return [*parts, Part(tuple(held))] if held or not parts else parts

    def windows(self, image: Image, part: Part) -> Iterator[tuple[int, int, int, int]]:
        """The slice's windows, row by row: those that meet the box, of the grid that starts at pixel 0."""
        w, h = self.size or (image.width, image.height)
        left, top, right, bottom = self.box or (0, 0, image.width, image.height)
        left, top, right, bottom = max(0, left), max(0, top), min(image.width, right), min(image.height, bottom)
        columns, rows = range(left // w, -(-right // w)), range(top // h, -(-bottom // h))
        total = len(columns) * len(rows)
        for k in range(total * part.slice // part.slices, total * (part.slice + 1) // part.slices):
            y, x = divmod(k, len(columns))
            yield columns[x] * w, rows[y] * h, columns[x] * w + w, rows[y] * h + h

    def rows(self, part: Part) -> Iterator[dict]:
        for uri in part.uris:
            try:
                image = Image(Ranges(uri))
            except FAULTS as e:
                if self.strict:
                    raise
                if part.slice == 0:  # told once
                    yield failed(uri, e)
                continue
            before = 0
            for box in self.windows(image, part):
                try:
                    yield self.cut.row(uri, image, box, before)
                except FAULTS as e:
                    if self.strict:
                        raise
                    yield failed(uri, e, box)
                before = image.source.bytes_read

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return in_batches(self.rows(partition), self.schema)


class TiffSource(DataSource):
    """Format `tiff`.  Options: window (256x256; whole images), box (left,top,right,bottom: windows of the grid that meet it), target (a size to resample to), fill, band, pathGlobFilter, partitionBytes, mode (PERMISSIVE, FAILFAST); for writing, see tile_sink: block."""

    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return WINDOW

    def reader(self, schema: StructType) -> TiffReader:
        return TiffReader(schema, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> TileWriter:
        options = {k.lower(): v for k, v in self.options.items()}
        if overwrite:
            raise ValueError("tiles are only added; take another folder or mode append")
        return TileWriter(schema, options["path"], int(options.get("block", 256)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TiffSource)


def read_windows(wanted: DataFrame, cut: Cut = Cut(), strict: bool = False) -> DataFrame:
    """The windows (path, left, top, right, bottom) that wanted asks for, a row each, with their other columns.

    Each task opens the files that its rows name; rows of one file that follow
    each other share its header.  Sort them by path where they are many.  No
    list of windows leaves the tasks, so there may be any number of them.
    """
    names = [f.strip().split(" ")[0] for f in WINDOW.split(",")]
    others = [c for c in wanted.columns if c.lower() not in names]
    asked = wanted.select("path", *[F.col(c).cast("int").alias(c) for c in ("left", "top", "right", "bottom")], *[F.col(f"`{c}`") for c in others])
    kinds = StructType([*StructType.fromDDL(WINDOW).fields, *[asked.schema[c] for c in others]])

    layout = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, image = None, None

        def rows(batch: pa.RecordBatch) -> Iterator[dict]:
            nonlocal uri, image
            for asked in batch.to_pylist():
                box = tuple(asked[c] for c in ("left", "top", "right", "bottom"))
                rest = {c: asked[c] for c in others}
                try:
                    if image is None or uri != asked["path"]:
                        uri, image = asked["path"], None
                        image = Image(Ranges(uri))
                        before = 0
                    else:
                        before = image.source.bytes_read
                    if None in box:
                        raise ValueError("empty window")
                    yield cut.row(uri, image, box, before) | rest
                except (*FAULTS, TypeError) as e:
                    if strict:
                        raise
                    yield failed(asked["path"], e, box) | rest

        for batch in batches:
            yield from in_batches(rows(batch), layout)

    return asked.mapInArrow(run, kinds)
