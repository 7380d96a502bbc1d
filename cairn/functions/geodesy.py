"""Conversion between WGS84 latitudes and the British national grid, and grid references.

The seven-parameter Helmert transform and the transverse Mercator series of
the Ordnance Survey's published guide, as column expressions.  A point is
taken at height 0 on its ellipsoid.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ellipsoids (a, b), datum shift, and the grid's projection.
WGS84 = (6378137.0, 6356752.314245)
AIRY = (6377563.396, 6356256.909)
#: Metres, parts per million, arc seconds: from WGS84 to OSGB36.
SHIFT, SCALE_PPM, TURN = (-446.448, 125.157, -542.060), 20.4894, (-0.1502, -0.2470, -0.8421)
F0, LAT0, LON0, E0, N0 = 0.9996012717, math.radians(49), math.radians(-2), 400000.0, -100000.0
LETTERS = "ABCDEFGHJKLMNOPQRSTUVWXYZ"

N = (AIRY[0] - AIRY[1]) / (AIRY[0] + AIRY[1])
E2 = 1 - (AIRY[1] / AIRY[0]) ** 2
#: Coefficients of the meridional arc in (phi - LAT0) and in sines of its multiples.
ARC = (1 + N + 5 / 4 * N**2 + 5 / 4 * N**3, 3 * N + 3 * N**2 + 21 / 8 * N**3, 15 / 8 * (N**2 + N**3), 35 / 24 * N**3)


def change_datum(points: DataFrame, lat: str, lon: str, source: tuple, target: tuple, sign: int, rounds: int = 8) -> DataFrame:
    """points with _phi and _lam, radians on the target ellipsoid, of the degrees lat and lon on the source."""
    e2s, e2t = (1 - (b / a) ** 2 for a, b in (source, target))
    s = 1 + sign * SCALE_PPM * 1e-6
    rx, ry, rz = (sign * math.radians(r / 3600) for r in TURN)
    tx, ty, tz = (sign * t for t in SHIFT)
    out = points.withColumns({"_phi": F.radians(lat), "_lam": F.radians(lon)})
    out = out.withColumn("_nu", source[0] / F.sqrt(1 - e2s * F.sin("_phi") * F.sin("_phi")))
    out = out.withColumns({"_x": F.col("_nu") * F.cos("_phi") * F.cos("_lam"), "_y": F.col("_nu") * F.cos("_phi") * F.sin("_lam"), "_z": F.col("_nu") * (1 - e2s) * F.sin("_phi")})
    x, y, z = F.col("_x"), F.col("_y"), F.col("_z")
    out = out.withColumns({"_x": tx + x * s - y * rz + z * ry, "_y": ty + x * rz + y * s - z * rx, "_z": tz - x * ry + y * rx + z * s})
    # Each round gains over two digits of the latitude.
    across = F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))
    up = lambda phi: F.col("_z") + e2t * target[0] / F.sqrt(1 - e2t * F.sin(phi) * F.sin(phi)) * F.sin(phi)
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.atan2("_z", across * (1 - e2t)), lambda phi, _: F.atan2(up(phi), across))
    return out.withColumns({"_phi": phi, "_lam": F.atan2("_y", "_x")}).drop("_nu", "_x", "_y", "_z")


def arc(phi: Column) -> Column:
    """Meridional arc from LAT0 to phi."""
    d, s = phi - LAT0, phi + LAT0
    return AIRY[1] * F0 * (ARC[0] * d - ARC[1] * F.sin(d) * F.cos(s) + ARC[2] * F.sin(2 * d) * F.cos(2 * s) - ARC[3] * F.sin(3 * d) * F.cos(3 * s))


def radii(out: DataFrame) -> DataFrame:
    """out with the radii of curvature at _phi, and eta squared."""
    w = 1 - E2 * F.sin("_phi") * F.sin("_phi")
    out = out.withColumns({"_nu": AIRY[0] * F0 * F.pow(w, F.lit(-0.5)), "_rho": AIRY[0] * F0 * (1 - E2) * F.pow(w, F.lit(-1.5))})
    return out.withColumn("_eta2", F.col("_nu") / F.col("_rho") - 1)


def to_osgb(points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """points with east and north of their WGS84 degrees, in metres to the millimetre."""
    out = radii(change_datum(points, lat, lon, WGS84, AIRY, 1))
    sin, cos, tan2 = F.sin("_phi"), F.cos("_phi"), F.pow(F.tan("_phi"), F.lit(2.0))
    nu, rho, eta2, d = F.col("_nu"), F.col("_rho"), F.col("_eta2"), F.col("_lam") - LON0
    power = lambda c, n: F.pow(c, F.lit(float(n)))
    north = (
        arc(F.col("_phi")) + N0 + nu / 2 * sin * cos * power(d, 2) + nu / 24 * sin * power(cos, 3) * (5 - tan2 + 9 * eta2) * power(d, 4)
        + nu / 720 * sin * power(cos, 5) * (61 - 58 * tan2 + tan2 * tan2) * power(d, 6)
    )
    east = (
        E0 + nu * cos * d + nu / 6 * power(cos, 3) * (nu / rho - tan2) * power(d, 3)
        + nu / 120 * power(cos, 5) * (5 - 18 * tan2 + tan2 * tan2 + 14 * eta2 - 58 * tan2 * eta2) * power(d, 5)
    )
    return out.withColumns({"east": F.round(east, 3), "north": F.round(north, 3)}).drop("_phi", "_lam", "_nu", "_rho", "_eta2")


def to_wgs(points: DataFrame, east: str = "east", north: str = "north", rounds: int = 8) -> DataFrame:
    """points with the WGS84 degrees lat and lon of their grid coordinates.

    The latitude of a northing takes a fixed number of rounds, which reach
    well below a millimetre on the grid.
    """
    start = (F.col(north) - N0) / (AIRY[0] * F0) + LAT0
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda p, _: p + (F.col(north) - N0 - arc(p)) / (AIRY[0] * F0))
    out = radii(points.withColumn("_phi", phi))
    tan, sec = F.tan("_phi"), 1 / F.cos("_phi")
    nu, rho, eta2, d = F.col("_nu"), F.col("_rho"), F.col("_eta2"), F.col(east) - E0
    power = lambda c, n: F.pow(c, F.lit(float(n)))
    lat = (
        F.col("_phi") - tan / (2 * rho * nu) * power(d, 2) + tan / (24 * rho * power(nu, 3)) * (5 + 3 * tan * tan + eta2 - 9 * tan * tan * eta2) * power(d, 4)
        - tan / (720 * rho * power(nu, 5)) * (61 + 90 * tan * tan + 45 * power(tan, 4)) * power(d, 6)
    )
    lon = (
        LON0 + sec / nu * d - sec / (6 * power(nu, 3)) * (nu / rho + 2 * tan * tan) * power(d, 3) + sec / (120 * power(nu, 5)) * (5 + 28 * tan * tan + 24 * power(tan, 4)) * power(d, 5)
        - sec / (5040 * power(nu, 7)) * (61 + 662 * tan * tan + 1320 * power(tan, 4) + 720 * power(tan, 6)) * power(d, 7)
    )
    out = out.withColumns({"_lat": F.degrees(lat), "_lon": F.degrees(lon)}).drop("_phi", "_nu", "_rho", "_eta2")
    out = change_datum(out, "_lat", "_lon", AIRY, WGS84, -1)
    return out.withColumns({"lat": F.degrees("_phi"), "lon": F.degrees("_lam")}).drop("_phi", "_lam", "_lat", "_lon")


def grid_reference(east: Column, north: Column, digits: int = 10) -> Column:
    """Reference without spaces, such as SU42: two letters and digits/2 figures of each axis; null off the grid."""
    e, n = F.floor(east / 100000), F.floor(north / 100000)
    first = (19 - n) - (19 - n) % 5 + F.floor((e + 10) / 5)
    second = ((19 - n) * 5) % 25 + e % 5
    letter = lambda i: F.substring(F.lit(LETTERS), (i + 1).cast("int"), 1)
    half = digits // 2
    figures = lambda v: F.lpad(F.floor((v % 100000) / 10.0 ** (5 - half)).cast("string"), half, "0") if half else F.lit("")
    inside = e.between(0, 6) & n.between(0, 12)
    return F.when(inside, F.concat(letter(first), letter(second), figures(east), figures(north)))
