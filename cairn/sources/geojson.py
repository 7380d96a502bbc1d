"""Points of GeoJSON feature collections, as column expressions over variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.formats import strict_number

#: Nesting of positions by geometry type (fixed values).
DEPTHS = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}
#: The types that the older reader knew.
LEGACY = ("Point", "MultiPoint", "LineString", "MultiLineString")


def positions(coordinates: Column, kind: Column) -> Column:
    """All positions (arrays of numbers) of a geometry's coordinates, in order."""
    nested = {0: "array<double>", 1: "array<array<double>>", 2: "array<array<array<double>>>", 3: "array<array<array<array<double>>>>"}
    as_type = lambda d: F.try_variant_get(coordinates, "$", nested[d])
    flat = {0: F.array(as_type(0)), 1: as_type(1), 2: F.flatten(as_type(2)), 3: F.flatten(F.flatten(as_type(3)))}
    out = F.when(F.lit(False), flat[1])
    for depth in range(4):
        out = out.when(kind.isin([k for k, d in DEPTHS.items() if d == depth]), flat[depth])
    return out


def opened(geometry: Column) -> Column:
    """array<struct<part_ix, geometry>> of the plain geometries within one: collections are opened however deep they lie.

    A text names GeometryCollection at least as often as collections lie within
    each other, so that many rounds open all; a round without one changes
    nothing.  part_ix holds the places in the collections on the way.
    """
    kind = lambda g: F.coalesce(F.try_variant_get(g, "$.type", "string"), F.lit(""))
    part = lambda ix, g: F.struct(ix.alias("part_ix"), g.alias("geometry"))
    closed = lambda s: kind(s["geometry"]) == "GeometryCollection"
    children = lambda s: F.coalesce(F.try_variant_get(s["geometry"], "$.geometries", "array<variant>"), F.array().cast("array<variant>"))
    inner = lambda s: F.when(closed(s), F.transform(children(s), lambda g, i: part(F.array_append(s["part_ix"], i), g))).otherwise(F.array(s))
    text = F.to_json(geometry)
    rounds = F.coalesce(F.size(F.split(text, "GeometryCollection")) - 1, F.lit(0))
    start = F.array(part(F.array().cast("array<int>"), geometry))
    step = lambda found, _: F.when(F.exists(found, closed), F.flatten(F.transform(found, inner))).otherwise(found)
    return F.when(rounds == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))), start, step))


def geometries(docs: DataFrame, text: str, nested: bool = True) -> DataFrame:
    """docs with (feature_ix, part_ix, geometry, height): one row for each plain geometry of documents that hold a collection or an array of them.

    Features count through all collections of a document.  nested: open
    collections of geometries, at any depth; part_ix orders the geometries of a
    feature.
    """
    whole = F.try_parse_json(F.col(text))
    several = F.coalesce(F.try_variant_get(whole, "$", "array<variant>"), F.array(whole))
    none = F.array().cast("array<variant>")
    features = F.flatten(F.transform(several, lambda c: F.coalesce(F.try_variant_get(c, "$.features", "array<variant>"), none)))
    keys = [c for c in docs.columns if c != text]
    listed = docs.select(*keys, F.posexplode(features).alias("feature_ix", "_f"))
    raw = F.try_variant_get("_f", "$.properties.PROP_VALUE", "string")
    found = listed.select(*keys, "feature_ix", F.try_variant_get("_f", "$.geometry", "variant").alias("geometry"), strict_number(raw).alias("height"))
    if not nested:
        return found.withColumn("part_ix", F.array().cast("array<int>"))
    return found.select(*keys, "feature_ix", "height", F.inline(opened(F.col("geometry"))))


def points(docs: DataFrame, text: str, legacy: bool = False) -> DataFrame:
    """docs without the text, with (feature_ix, part_ix, point_ix, x, y, h): the finite points of feature collections.

    The height is the feature's PROP_VALUE, a number or numeric text, else the
    position's own; points without one go.  Null and unknown geometries have
    no points.  legacy: only points and lines outside collections, and only
    PROP_VALUE as height.
    """
    found = geometries(docs, text, nested=not legacy)
    kind = F.try_variant_get("geometry", "$.type", "string")
    if legacy:
        found = found.filter(kind.isin(*LEGACY))
    keys = [c for c in found.columns if c not in ("geometry", "height")]
    placed = found.select(*keys, "height", F.posexplode(positions(F.try_variant_get("geometry", "$.coordinates", "variant"), kind)).alias("point_ix", "p"))
    x, y, z = (F.get("p", F.lit(i)) for i in range(3))
    out = placed.select(*keys, "point_ix", x.alias("x"), y.alias("y"), (F.col("height") if legacy else F.coalesce("height", z)).alias("h"))
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("x", "y", "h")]
    return out.filter(finite[0] & finite[1] & finite[2])
