"""Column functions for views of the terrain: distances, zooms, angles, positions on screen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.scalars import clamp

#: Equatorial radius of the web map's sphere, and pixels of its tiles (fixed values).
EARTH_RADIUS, TILE_PIXELS = 6378137.0, 256
#: Metres of a pixel for each metre of distance.
PIXEL_SHARE = 0.001


def quality_from_slider(t: Column, low: float = 0.0, high: float = 0.9999) -> Column:
    return low + clamp(t, 0.0, 1.0) * (high - low)


def slider_from_quality(q: Column, low: float = 0.0, high: float = 0.9999) -> Column:
    return clamp((q - low) / (high - low), 0.0, 1.0)


def around(latitude: Column) -> Column:
    """Half the length of a parallel over the pixels of a map tile."""
    return EARTH_RADIUS * F.cos(F.radians(latitude)) * math.pi / TILE_PIXELS


def distance_to_zoom(distance: Column, latitude: Column) -> Column:
    return clamp(F.log2(around(latitude) / (distance * PIXEL_SHARE)), 0.0, 22.0)


def zoom_to_distance(zoom: Column, latitude: Column) -> Column:
    return around(latitude) / F.pow(F.lit(2.0), zoom) / PIXEL_SHARE


def map_view(lat: Column, lon: Column, distance: Column, bearing: Column, pitch: Column, base_zoom: float = 14.0) -> Column:
    """View of a web map, in degrees; a zoom of 0 is replaced by base_zoom."""
    zoom = distance_to_zoom(distance, lat)
    return F.struct(lon.alias("longitude"), lat.alias("latitude"), F.when(zoom == 0, base_zoom).otherwise(zoom).alias("zoom"), F.degrees(pitch).alias("pitch"), F.degrees(bearing).alias("bearing"))


def terrain_view(latitude: Column, zoom: Column, bearing: Column, pitch: Column) -> Column:
    """Distance and radians of a web map's view; the target comes from geodesy.to_osgb."""
    return F.struct(zoom_to_distance(zoom, latitude).alias("distance"), F.radians(bearing).alias("bearing"), F.radians(pitch).alias("pitch"))


def spherical(dx: Column, dy: Column, dz: Column) -> Column:
    """Distance, bearing and pitch of an offset from the target; z is up, bearing 0 lies towards -y.

    Straight up and down the bearing is pi, that of 0 and -0, which Spark's atan2 takes for 0 and 0.
    """
    r = F.sqrt(dx * dx + dy * dy + dz * dz)
    up = F.when(r > 0, clamp(dz / r, -1.0, 1.0)).otherwise(1.0)
    bearing = F.when((dx == 0) & (dy == 0), math.pi).otherwise(F.atan2(dx, -dy))
    return F.struct(r.alias("distance"), bearing.alias("bearing"), (math.pi / 2 - F.acos(up)).alias("pitch"))


def offset(distance: Column, bearing: Column, pitch: Column) -> dict[str, Column]:
    """The offset that spherical() takes apart."""
    flat = distance * F.cos(pitch)
    return {"dx": flat * F.sin(bearing), "dy": -flat * F.cos(bearing), "dz": distance * F.sin(pitch)}


def roll_free_basis(x: Column, y: Column, z: Column, heading: Column) -> Column:
    """Right and up vectors of a view direction without roll; straight down, right follows the heading.  A direction of no length has a null up."""
    flat = x * x + y * y
    steep = flat < 1e-10
    size = F.when(steep, 1.0).otherwise(F.sqrt(flat))
    rx, ry = F.when(steep, F.cos(heading)).otherwise(y / size), F.when(steep, F.sin(heading)).otherwise(-x / size)
    ux, uy, uz = ry * z, -rx * z, rx * y - ry * x
    n = F.sqrt(ux * ux + uy * uy + uz * uz)
    return F.struct(rx.alias("right_x"), ry.alias("right_y"), *[F.when(n > 0, u / n).alias(f"up_{c}") for c, u in zip("xyz", (ux, uy, uz))])


def clamp_view(distance: Column, pitch: Column, low: Column, high: Column) -> Column:
    """Distance within its limits, pitch within those of the controls."""
    return F.struct(F.greatest(low, F.least(high, distance)).alias("distance"), clamp(pitch, 0.05, math.pi / 2 - 0.02).alias("pitch"))


def zoom_limits(camera_height: Column) -> Column:
    return F.struct(F.greatest(camera_height / 50, F.lit(10.0)).alias("low"), (camera_height * 20).alias("high"))


def north_up(view: Column, pitch: float) -> Column:
    """A view (target_e, target_n, distance) with bearing 0 and the pitch."""
    return F.struct(view["target_e"].alias("target_e"), view["target_n"].alias("target_n"), view["distance"].alias("distance"), F.lit(0.0).alias("bearing"), F.lit(pitch).alias("pitch"))


def damped_wheel_scale(scale: Column, ground: Column, reference: float = 3000.0) -> Column:
    """Below the reference distance a wheel step counts less."""
    t = ground / reference
    return F.when(ground >= reference, scale).otherwise(1 + (scale - 1) * t * t)


def zoom_sensitivity(ground: Column, gain: float, power: float, reference: float = 3000.0) -> Column:
    return gain * F.pow(F.greatest(ground, F.lit(1.0)) / reference, F.lit(power))


def view_distance(dx: Column, dy: Column, dz: Column) -> Column:
    return F.greatest(F.sqrt(dx * dx + dy * dy + dz * dz), F.lit(1.0))


def metres_per_pixel(distance: Column, fov_degrees: Column, pixels: Column, gain: float = 1.0) -> Column:
    return 2 * distance * F.tan(F.radians(fov_degrees) / 2) / F.greatest(pixels, F.lit(1)) * gain


def ground_distance(z: Column, view_z: Column) -> Column:
    """Along the view to the ground plane; the height where the view is level or looks up."""
    t = F.when(F.abs(view_z) >= 1e-6, -z / view_z)
    return F.greatest(F.when(t > 0, t).otherwise(z), F.lit(1e-3))


def ground_point(px: Column, py: Column, pz: Column, vx: Column, vy: Column, vz: Column) -> Column:
    """Where a ray meets the plane z = 0 in front of it, else null."""
    t = F.when(vz != 0, -pz / vz)
    return F.when(t >= 0, F.struct((px + vx * t).alias("x"), (py + vy * t).alias("y")))


def zoom_about(point: Column, anchor: Column, ratio: Column) -> Column:
    """A camera (x, y, z) moved so that its distance to the anchor scales by ratio; it stays where that is below 1e-6."""
    d = [point[c] - anchor[c] for c in "xyz"]
    far = F.sqrt(sum(v * v for v in d))
    moves = (far >= 1e-6) & (far * ratio >= 1e-6)
    return F.struct(*[F.when(moves, anchor[c] + v * ratio).otherwise(point[c]).alias(c) for c, v in zip("xyz", d)])


def box_distance(p: list[Column], low: list[Column], high: list[Column], zoom: Column) -> Column:
    """Distance from a point to a box, over the camera's zoom."""
    gaps = [F.greatest(a - v, F.lit(0.0), v - b) for v, a, b in zip(p, low, high)]
    return F.sqrt(sum(g * g for g in gaps)) / zoom


def observed_distance(camera: Column, observer: Column, radius: Column) -> Column:
    """Distance for the level of detail: the observer's if the tile lies within its radius and is nearer."""
    return F.when((radius <= 0) | (observer > radius), camera).otherwise(F.least(camera, observer))


def pick_reason(x: Column, y: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """Why a position on screen can't be picked; null if it can."""
    outside = (x < left) | (x > left + width) | (y < top) | (y > top + height)
    return F.when((width < 1) | (height < 1), "empty-rect").when(outside, "outside-rect")


def to_pixel(at: Column, start: Column, size: Column, pixels: Column) -> Column:
    """Pixel of a position on screen, within the buffer."""
    return F.least(pixels - 1, F.greatest(F.lit(0), F.floor((at - start) / size * pixels)))


def marker_scale(distance: Column, share: float = 0.018, largest: float = 120.0) -> Column:
    return clamp(distance * share, 5.0, largest)


def vertex_uv(vertex: Column, size_x: Column, size_y: Column, eps: Column) -> dict[str, Column]:
    """Texture position of a grid's vertex."""
    return {"u": F.floor(vertex / size_y) * eps, "v": (vertex % size_x) * eps}


def curved(z: Column, distance: Column, radius: float = 6371000.0) -> Column:
    """Height over the tangent plane at the observer, on a sphere."""
    return z - distance * distance / (2 * radius)
