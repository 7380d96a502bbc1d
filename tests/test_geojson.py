"""Nested collections, repeated rows and broken texts of GeoJSON."""

import json

from cairn.sources import geojson


def nest(depth, x):
    inner = {"type": "Point", "coordinates": [x, depth, 5]}
    for _ in range(depth):
        inner = {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [x, -1, 4]}, inner]}
    return inner


def feature(geometry, value=None):
    return {"type": "Feature", "properties": {"PROP_VALUE": value}, "geometry": geometry}


def collection(*features):
    return json.dumps({"type": "FeatureCollection", "features": list(features)})


def test_collections_of_any_depth(spark):
    texts = [collection(*[feature(nest(d, d)) for d in (0, 1, 4, 6, 9)]), collection(feature({"type": "GeometryCollection", "geometries": [nest(0, k) for k in range(70)]}, 8))]
    got = geojson.points(spark.createDataFrame(list(enumerate(texts)), "doc int, text string"), "text").collect()
    first = [r for r in got if r.doc == 0]
    # A point at each level and one at the bottom.
    assert sorted((r.feature_ix, r.y) for r in first) == sorted([(i, float(d)) for i, d in enumerate((0, 1, 4, 6, 9))] + [(i, -1.0) for i, d in enumerate((0, 1, 4, 6, 9)) for _ in range(d)])
    assert [list(r.part_ix) for r in first if r.y == 6] == [[1] * 6] and [list(r.part_ix) for r in first if r.y == 0] == [[]]
    assert sorted((r.part_ix[0], r.x, r.h) for r in got if r.doc == 1) == [(k, float(k), 8.0) for k in range(70)]


def test_odd_texts(spark):
    empty = {"type": "GeometryCollection", "geometries": []}
    broken = {"type": "GeometryCollection", "geometries": "none"}
    word = {"type": "Point", "coordinates": [1, 2], "note": "GeometryCollection GeometryCollection"}
    texts = [None, "", "{", "[]", collection(), collection(feature(None), feature(empty, 1), feature(broken, 1), feature({"type": "Circle", "coordinates": [1, 2]}, 1), feature(word, 1)), f"[{collection(feature(nest(0, 1)))},{collection(feature(nest(1, 2)))}]"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(6, texts[6])]
    got = [(r.doc, r.feature_ix, r.x) for r in geojson.points(spark.createDataFrame(rows, "doc int, text string"), "text").collect()]
    # Rows with equal keys stay two documents.
    assert sorted(got) == [(5, 4, 1.0), *[(6, 0, 1.0)] * 2, *[(6, 1, 2.0)] * 4]
