"""Archives are handed on in slices of bounded size, with the same rows."""

import pandas as pd
from cairn.plans import fixtures
from cairn.sources import shapefile


def test_slices_are_bounded_and_whole(spark, monkeypatch):
    """A file of 100 records in slices of 7, points and attributes alike."""
    parts = spark.createDataFrame([("Brand#11", k, k % 50 + 1) for k in range(100)], "p_brand string, p_partkey long, p_size int")
    files = shapefile.member_files(fixtures.shape_archives(parts).first().content)
    shp, dbf = files["points", "shp"], files["points", "dbf"]
    whole = shapefile.shape_table("a", "points", shp), shapefile.attribute_table("a", "points", dbf, shapefile.HEIGHT_FIELD)
    assert [len(w) for w in whole] == [100, 100]
    monkeypatch.setattr(shapefile, "SLICE", 7)
    for want, found in zip(whole, (list(shapefile.shape_slices("a", "points", shp)), list(shapefile.attribute_slices("a", "points", dbf, shapefile.HEIGHT_FIELD)))):
        assert max(map(len, found)) == 7
        pd.testing.assert_frame_equal(pd.concat(found, ignore_index=True), want)
