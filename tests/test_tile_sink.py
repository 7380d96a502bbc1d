"""Tiles written once, whatever is repeated."""

import json

import numpy as np
import pytest

from cairn.sources import tiff, tile_sink


def rows(n, bad=()):
    return [("dtm", f"t{i}", 7, 5, np.random.default_rng(i).random(35 if i not in bad else 34).astype(np.float32).tolist(), 100.0 + i, 50.0, 2.0) for i in range(n)]


def write(spark, made, folder, parts=4):
    spark.createDataFrame(made, "layer string, name string, width int, height int, pixels array<float>, left double, top double, pixel double").repartition(parts).write.format("tiff").option("block", 4).mode("append").save(folder)


def test_ended_and_repeated_write(spark, tmp_path):
    tiff.register(spark)
    folder = f"file://{tmp_path}/tiles"
    with pytest.raises(Exception, match="34 samples"):
        write(spark, rows(40, bad={17}), folder, 40)
    there = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "tiles/dtm").glob("*.tif")} if (tmp_path / "tiles/dtm").exists() else {}
    assert "t17.tif" not in there and not (tmp_path / "tiles/_runs").exists()
    write(spark, rows(40) + rows(40)[:5], folder, 1)
    write(spark, rows(40), folder)
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "tiles/dtm").glob("*.tif") if p.name in there} == there
    assert sorted(p.name for p in (tmp_path / "tiles/dtm").iterdir()) == sorted(f"t{i}.tif" for i in range(40))
    told = sorted((json.loads(p.read_text()) for p in (tmp_path / "tiles/_runs").iterdir()), key=lambda r: -r["written"])
    assert told == [{"written": 40 - len(there), "skipped": len(there) + 5}, {"written": 0, "skipped": 40}]
    got = {r.path.rsplit("/", 1)[-1]: r for r in spark.read.format("tiff").load(folder).collect()}
    assert len(got) == 40 and all(got[f"t{i}.tif"].pixels == rows(40)[i][4] and got[f"t{i}.tif"].xll == 100 + i and got[f"t{i}.tif"].yll == 40 for i in range(40))


def test_names_and_modes(spark, tmp_path):
    tiff.register(spark)
    for layer, name in (("..", "a"), ("dtm", "a/b"), ("dtm", ""), ("dtm", None), ("dtm", "_a")):
        with pytest.raises(Exception, match="no name"):
            write(spark, [(layer, name, 1, 1, [1.0], 0.0, 0.0, 1.0)], f"file://{tmp_path}/x", 1)
    with pytest.raises(Exception, match="need the columns"):
        spark.range(3).write.format("tiff").mode("append").save(f"file://{tmp_path}/x")


def test_file_reads_back(tmp_path):
    samples = np.random.default_rng(1).random((33, 70)).astype(np.float32)
    (tmp_path / "a.tif").write_bytes(tile_sink.tiff_bytes(samples, 16, (5.0, 9.0), 0.5))
    image = tiff.Image(tiff.Ranges(f"file://{tmp_path}/a.tif"))
    assert (image.window(0, 0, 70, 33, -1) == samples).all() and (image.left, image.top, image.pixel) == (5.0, 9.0, (0.5, 0.5))
