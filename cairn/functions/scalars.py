"""Column functions for heights, quality, views and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def half_to_float(bits: Column) -> Column:
    """Value of an IEEE 754 binary16 bit pattern."""
    sign = F.when(bits.bitwiseAND(0x8000) != 0, -1.0).otherwise(1.0)
    exponent = F.shiftright(bits, 10).bitwiseAND(31)
    fraction = bits.bitwiseAND(1023)
    special = F.when(fraction == 0, sign * float("inf")).otherwise(F.lit(float("nan")))
    normal = sign * F.pow(F.lit(2.0), exponent - 15) * (1 + fraction / F.lit(1024.0))
    return F.when(exponent == 31, special).when(exponent == 0, sign * fraction * 2.0**-24).otherwise(normal)


def float_to_half(v: Column) -> Column:
    """IEEE 754 binary16 bit pattern of a number taken as a 32-bit float; ties go away from zero, what is too large is infinite.

    Half of the smallest pattern and less, and all below that pattern, is zero.
    """
    wide = v.cast("float").cast("double")
    a = F.abs(wide)
    guess = F.floor(F.log2(F.when(a > 0, a).otherwise(1.0)))
    # The logarithm may be off by one next to a power of two.
    exponent = guess + F.when(F.pow(F.lit(2.0), guess + 1) <= a, 1).when(F.pow(F.lit(2.0), guess) > a, -1).otherwise(0)
    exponent = F.greatest(exponent, F.lit(-14))
    magnitude = (exponent + 14) * 1024 + F.floor(a / F.pow(F.lit(2.0), exponent - 10) + 0.5)
    # A sign of -0.0 shows in its text only.
    sign = F.when((wide < 0) | F.startswith(wide.cast("string"), F.lit("-")), 0x8000).otherwise(0)
    bits = F.when(F.isnan(wide), 0x7E00).when(a < 2.0**-24, sign).when(a >= 65536.0, sign + 0x7C00).otherwise(sign + F.least(magnitude, F.lit(0x7C00)))
    return bits.cast("int")


def metres_to_codebook(v: Column, low: Column, high: Column) -> Column:
    """Linear 16-bit code, cut off to a whole number; the top of the range keeps the last code."""
    return F.least(F.floor(65536.0 * (v - low) / F.when(high > low, high - low).otherwise(1.0)), F.lit(65535)).cast("int")


def normalised_half(v: Column, low: Column, high: Column, bad: float = -200.0) -> Column:
    """Half pattern of a height's share of the range; 0 for the sentinel of bad samples."""
    return F.when(v == bad, 0).otherwise(float_to_half((v - low) / F.when(high > low, high - low).otherwise(1.0)))


def denormalised(share: Column, low: Column, high: Column) -> Column:
    return low + share * (high - low)


def code_bytes(code: Column) -> Column:
    """High byte, low byte and 0 of a 16-bit code."""
    return F.array(F.shiftright(code, 8).bitwiseAND(255), code.bitwiseAND(255), F.lit(0))


def codebook_to_metres(code: Column, low: Column, high: Column) -> Column:
    """Linear 16-bit code to metres; an empty span counts as 1."""
    span = F.when(high > low, high - low).otherwise(1.0)
    return low + code / F.lit(65536.0) * span


def clamp_quality(q: Column) -> Column:
    """Lossy quality within 0 .. 0.9999; what is no finite number is 0."""
    bad = q.isNull() | F.isnan(q) | (F.abs(q) == float("inf"))
    return F.when(bad, 0.0).otherwise(clamp(q, 0.0, 0.9999))


def smoothstep(low, high, x: Column) -> Column:
    t = clamp((x - low) / (high - low), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def mix(a: Column, b: Column, t: Column) -> Column:
    return a * (1 - t) + b * t


def aa_step(threshold, v: Column, width: Column) -> Column:
    """Step smoothed over the change of v within a pixel."""
    return smoothstep(F.lit(threshold) - width, F.lit(threshold) + width, v)


def contour_line(height: Column, width: Column, interval: float, phase: float = 0.0) -> Column:
    """Strength of a contour line, smoothed over a fifth of the change of height within a pixel."""
    share, edge = contour_phase(height + phase, interval), width * 0.2
    # Edges of no width are steps.
    above = F.when(edge > 0, smoothstep(1 - edge, F.lit(1.0), share)).otherwise((share >= 1).cast("double"))
    below = F.when(edge > 0, smoothstep(edge, F.lit(0.0), share)).otherwise((share <= 0).cast("double"))
    return F.greatest(above, below)


def fading_contour(height: Column, width: Column, interval: float, major: float, falloff: float, phase: float = 0.0) -> Column:
    """Contour lines that fade from each major line upwards; smoothed over the whole change within a pixel."""
    share = contour_phase(height + phase, interval)
    line = F.greatest(smoothstep(1 - width, F.lit(1.0), share), smoothstep(width, F.lit(0.0), share))
    return line * F.greatest(F.lit(0.0), 1 - (1 - contour_phase(height, major)) * falloff)


def contour_phase(height: Column, interval: float) -> Column:
    """Position within the contour interval, 0 .. 1, for negative heights too."""
    return (height - F.floor(height / interval) * interval) / interval


def viewshed_config(radius: Column, map_size: Column, near: Column, scale: Column, source_height: Column) -> Column:
    """Radius, map size, near plane and its scale; what is no finite number falls to its default.

    The near plane is the given one, or the source height times the scale,
    within 0.01 and half the radius.
    """
    wide = F.greatest(finite_or(radius, 10000.0), F.lit(10.0))
    near_scale = F.greatest(finite_or(scale, 2.0), F.lit(0.0))
    given = F.when(near.isNotNull() & ~F.isnan(near) & (F.abs(near) < float("inf")), near)
    plane = F.greatest(F.lit(0.01), F.least(F.coalesce(given, finite_or(source_height, 1.7) * near_scale), wide * 0.5))
    size = clamp(F.floor(finite_or(map_size, 2048.0) + 0.5), 256, 8192).cast("int")
    return F.struct(wide.alias("radius"), size.alias("map_size"), plane.alias("near"), near_scale.alias("near_scale"))


def lod_level(distance: Column, size: float, levels: int = 12) -> Column:
    """Greatest level whose threshold 2^(level-3) * size is at most the distance; 0 if none is."""
    return F.when(distance <= 0, 0).otherwise(clamp(F.floor(F.log2(distance / size)) + 3, 0, levels - 1)).cast("int")


def cell_corner(v: Column, origin: float, size: float) -> Column:
    return F.lit(origin) + F.floor((v - origin) / size) * size


def colour_to_css(colour: Column) -> Column:
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(colour.bitwiseAND(0xFFFFFF)), 6, "0")))


def format_bytes(n: Column) -> Column:
    """Bytes with a binary unit: two decimals below 10, one below 100, none above."""
    unit = F.when(n < 1024, 0).when(n < 1 << 20, 1).when(n < 1 << 30, 2).otherwise(3)
    value = n / F.pow(F.lit(1024.0), unit)
    names = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB")]), unit + 1)
    shown = F.when(value < 10, F.format_string("%.2f", value)).when(value < 100, F.format_string("%.1f", value)).otherwise(F.format_string("%.0f", F.floor(value + 0.5).cast("double")))
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")) | (n <= 0), "0 B").otherwise(F.concat_ws(" ", shown, names))


def finite_or(v: Column, default: float) -> Column:
    """v, or the default where it is null, NaN or infinite."""
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(default)).otherwise(v)


def wheel_scale(delta: Column, sensitivity: float = 0.01) -> Column:
    """Zoom factor of a wheel step: above 1 for negative steps, below for positive ones."""
    scale = 2 / (1 + F.exp(-F.abs(delta * sensitivity)))
    return F.when(delta < 0, 1 / scale).otherwise(scale)


def wrap_angle(a: Column) -> Column:
    """Angle within -pi .. pi."""
    turn = 2 * 3.141592653589793
    return a - F.floor((a + turn / 2) / turn) * turn


def bias(t: Column, b: float) -> Column:
    return F.when(t <= 0, 0.0).otherwise(F.pow(t, F.log(F.lit(b)) / F.log(F.lit(0.5))))


def gain(t: Column, g: float) -> Column:
    """S-shaped or flattened curve through the middle."""
    return F.when(t < 0.5, bias(2 * t, 1 - g) / 2).otherwise(1 - bias(2 - 2 * t, 1 - g) / 2)


def rgb_to_hsv(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Hue, saturation and value in 0 .. 1; grey has hue 0."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    sixth = F.when(span == 0, 0.0).when(top == r, (g - b) / span).when(top == g, 2 + (b - r) / span).otherwise(4 + (r - g) / span)
    return {"h": sixth / 6 - F.floor(sixth / 6), "s": F.when(top > 0, span / top).otherwise(0.0), "v": top}


def hsv_to_rgb(h: Column, s: Column, v: Column) -> dict[str, Column]:
    """Red, green and blue of a colour with hue, saturation and value in 0 .. 1."""

    def channel(n: int) -> Column:
        k = (n + h * 6) - F.floor((n + h * 6) / 6) * 6
        return v - v * s * F.greatest(F.least(k, 4 - k, F.lit(1.0)), F.lit(0.0))

    return {"r": channel(5), "g": channel(3), "b": channel(1)}


def morphed(current: Column, following: Column, morph: Column) -> Column:
    """Height on the way from one lossy raster to the next."""
    return F.when(morph <= 0, current).otherwise(mix(current, following, clamp(morph, 0.0, 1.0)))


def blend_share(mode: Column, blend: float, u: Column, v: Column, time: float, amplitude: float = 1.0, frequency: float = 12.0, speed: float = 0.5) -> Column:
    """Share of the lossy raster: mode 0 mixes, 1 waves over the tile, 2 splits at u, 3 shows none."""
    wave = F.sin((u + v * 0.7) * frequency + time * speed)
    share = F.when(mode == 0, F.lit(blend)).when(mode == 1, blend * (0.5 + 0.5 * wave * amplitude)).when(mode == 2, (u < blend).cast("double")).otherwise(0.0)
    return clamp(share, 0.0, 1.0)


def blended_height(full: Column, lossy: Column, share: Column, gain: float = 1.0) -> Column:
    """Height between a full and a lossy raster, their difference raised by a gain of at least 1."""
    return full + (lossy - full) * share * max(gain, 1.0)


def loading_pulse(u: Column, v: Column, time: float) -> Column:
    """Brightness of a tile that is loading, a wave over the tile."""
    return 0.45 + 0.55 * F.sin(time * 7.0 + u * 13.0 + v * 7.0)


def emission(height: Column, scale: float, lines: list[tuple[Column, float]], strength: float, tint: Column, delta: Column, delta_scale: float = 80.0, pulse: Column | float = 0.0, pulse_share: float = 0.05) -> Column:
    """One channel of a tile's own light: height, lines in their colours, the tint of its level, the difference of rasters, and the pulse while it loads."""
    drawn = sum((line * colour for line, colour in lines), F.lit(0.0)) * strength
    return height * scale + drawn + tint + F.abs(delta) * delta_scale + pulse * F.lit(pulse_share)


def parse_number(text: Column) -> Column:
    """The number that text starts with, or null."""
    return F.regexp_extract(text, r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double")


def is_lossy_key(key: Column) -> Column:
    """Whether a cache key url@q=... is of a quality other than 1."""
    return F.contains(key, F.lit("@q=")) & ~F.endswith(key, F.lit("@q=1"))


def signed_to_code(v: Column) -> Column:
    """16-bit signed sample as an unsigned code."""
    return (v + 32768).bitwiseAND(0xFFFF)


def preset_is_active(current: Column, preset: Column, span: float) -> Column:
    """Whether a slider stands at a preset, within a fiftieth of the span or a twentieth of the preset."""
    near = F.when(preset == 0, F.lit(1e-9)).otherwise(preset * 0.05)
    return F.abs(current - preset) <= F.greatest(F.lit(span * 0.02), near)
