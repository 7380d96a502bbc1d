"""A sink for elevation tiles that can be taken up again: `df.write.format("tiff").mode("append").save(folder)`, after tiff.register().

A tile (layer, name, width, height, pixels, and if it has them left, top and
pixel: place of its upper left corner and size of a sample on the ground)
becomes <layer>/<name>.tif, one band of 32-bit floats in deflated blocks.  Each
is written under another name first and then moved, so a name that is there is
a whole tile; tiles that are there already are skipped, be it that the job was
ended and is run again, that a task is repeated, or that rows are.  What
finished tasks did is summed up in _runs/<id>.json.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NEEDED = ("layer", "name", "width", "height", "pixels")


def tiff_bytes(samples: np.ndarray, block: int = 256, origin: tuple[float, float] = (0.0, 0.0), pixel: float = 1.0) -> bytes:
    """A file of one band of 32-bit floats in deflated blocks, with its place on the ground; blocks over the edge end in zeros."""
    height, width = samples.shape
    tall, wide = -(-height // block), -(-width // block)
    padded = np.zeros((tall * block, wide * block), "<f4")
    padded[:height, :width] = samples
    data = [zlib.compress(padded[y * block : (y + 1) * block, x * block : (x + 1) * block].tobytes()) for y in range(tall) for x in range(wide)]
    # (tag, type, values), in the order of tags.
    fields = [(256, "I", [width]), (257, "I", [height]), (258, "H", [32]), (259, "H", [8]), (277, "H", [1]), (322, "I", [block]), (323, "I", [block]), (324, "I", [0] * len(data)), (325, "I", [len(d) for d in data]), (339, "H", [3]), (33550, "d", [pixel, pixel, 0.0]), (33922, "d", [0.0, 0.0, 0.0, *origin, 0.0])]
    kinds = {"H": 3, "I": 4, "d": 12}
    place = 8 + 2 + 12 * len(fields) + 4
    sizes = [struct.calcsize(f"<{len(v)}{c}") for _, c, v in fields]
    first = place + sum(s for s in sizes if s > 4)
    starts = (first + np.cumsum([0, *map(len, data)])[:-1]).tolist()
    fields[7] = (324, "I", starts)
    head, outside = struct.pack("<2sHIH", b"II", 42, 8, len(fields)), b""
    for (tag, code, values), size in zip(fields, sizes):
        body = struct.pack(f"<{len(values)}{code}", *values)
        head += struct.pack("<HHI", tag, kinds[code], len(values)) + (body.ljust(4, b"\0") if size <= 4 else struct.pack("<I", place + len(outside)))
        outside += body if size > 4 else b""
    return head + bytes(4) + outside + b"".join(data)


@dataclass
class Done(WriterCommitMessage):
    written: int
    skipped: int


class TileWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, path: str, block: int):
        missing = [c for c in NEEDED if c not in schema.names]
        if missing:
            raise ValueError(f"tiles need the columns {', '.join(missing)}")
        self.path, self.block = path.rstrip("/"), block

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        system, root = fs.FileSystem.from_uri(self.path)
        done = Done(0, 0)
        for batch in iterator:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row].as_py() if c in batch.schema.names else None  # noqa: B023, E731
                layer, name = get("layer"), get("name")
                if not all(x and re.fullmatch(r"[\w.-]+", x) and x[0] not in "._" for x in (layer, name)):
                    raise ValueError(f"{layer}/{name} is no name for a tile")
                target = f"{root}/{layer}/{name}.tif"
                if system.get_file_info(target).type == fs.FileType.File:
                    done.skipped += 1
                    continue
                pixels = np.asarray(batch.column("pixels")[row].values.to_numpy(zero_copy_only=False), np.float32)
                if len(pixels) != get("width") * get("height") or not len(pixels):
                    raise ValueError(f"{layer}/{name} has {len(pixels)} samples")
                system.create_dir(f"{root}/{layer}")
                own = f"{root}/{layer}/_{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(own) as out:
                    out.write(tiff_bytes(pixels.reshape(get("height"), get("width")), self.block, (get("left") or 0.0, get("top") or 0.0), get("pixel") or 1.0))
                system.move(own, target)
                done.written += 1
        return done

    def commit(self, messages: list[Done | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(f"{root}/_runs")
        told = [m for m in messages if m is not None]
        with system.open_output_stream(f"{root}/_runs/{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps({"written": sum(m.written for m in told), "skipped": sum(m.skipped for m in told)}).encode())

    def abort(self, messages: list[Done | None]) -> None:
        """Whole tiles stay, as the next run skips them."""
