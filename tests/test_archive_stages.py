"""Archives are decoded once for a summary, and dealt to several tasks."""

import pandas as pd
from cairn.plans import fixtures
from cairn.sources import shapefile


def brands(spark):
    rows = [(f"Brand#{10 * k + d}", 1000 * k + 100 * d + i, i * 7 % 50 + 1) for k in range(1, 4) for d in range(1, 6) for i in range(40)]
    return spark.createDataFrame(rows, "p_brand string, p_partkey long, p_size int")


def test_results_decode_each_archive_once(spark):
    """Shapes and attributes are read once each, however often the points are counted and meshed."""
    opened = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            opened.add(len(frame))
            yield frame

    files = fixtures.shape_archives(brands(spark), faults=True).mapInPandas(counted, "path string, content binary")
    got = {r.archive: r for r in shapefile.results(shapefile.members(files)).collect()}
    assert len(got) == 15 and opened.value <= 2 * len(got)
    assert all((r.status == "ok") == (a[-1] in "15") == (r.n_triangles > 0) for a, r in got.items())
    assert got["Brand#12"].error.startswith("not read") and got["Brand#13"].error == "holds no shapes" and got["Brand#14"].error == "record 39 of points.shp is cut off"


def test_archives_are_dealt_to_tasks(spark):
    """Small as they are, archives don't meet in one task."""

    def counted(frames):
        yield pd.DataFrame({"n": [sum(len(frame) for frame in frames)]})

    held = [r.n for r in fixtures.shape_archives(brands(spark)).mapInPandas(counted, "n long").collect()]
    assert sum(held) == 15 and max(held) < 15
