"""Column functions for labels, paths and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(v: Column, places: int) -> Column:
    """v with so many decimals; ties go away from zero."""
    return F.format_string(f"%.{places}f", v)


def tenths(v: Column) -> Column:
    """v with one decimal as C's printf rounds it: by its whole binary value, halves to even.

    Spark's own format goes by the shortest decimals of v, so 0.15 (a bit less
    as a binary number) gives 0.2 and 26.25 gives 26.3.
    """
    a, b = v * 8, v * 2
    s = a + b  # 10 * v is exactly s + rest
    rest = (a - (s - (s - a))) + (b - (s - a))
    low = F.floor(s)
    nearest = F.when((s - low != 0.5) | (rest == 0), F.rint(s)).when(rest > 0, low + 1.0).otherwise(low.cast("double"))
    return F.format_string("%.1f", nearest / 10)


def format_quality(q: Column) -> Column:
    """0 as `0`; fewer decimals the larger; below a thousandth in powers of ten."""
    power = F.regexp_replace(F.format_string("%.2e", q), r"e([-+])0?(\d+)$", "e$1$2")
    return F.when(q == 0, "0").when(q >= 10, fixed(q, 1)).when(q >= 1, fixed(q, 2)).when(q >= 0.001, fixed(q, 4)).otherwise(power)


def format_percent(fraction: Column) -> Column:
    return F.concat(fixed(fraction * 100, 1), F.lit("%"))


def format_norm_height(v: Column) -> Column:
    return F.concat(fixed(v * 100, 4), F.lit("% of 16-bit range"))


def status_sentence(enabled: Column, phase: Column, total: Column, pending: Column, completed: Column, failed: Column, tracked: Column) -> Column:
    """What a status line says of the counts of visible tiles."""
    text = lambda c: c.cast("string")
    part = F.concat(text(completed), F.lit("/"), text(total))
    failures = F.when(failed > 0, F.concat(F.lit(", "), text(failed), F.lit(" failed"))).otherwise("")
    return (
        F.when(~enabled, "Off")
        .when((phase == "idle") & (tracked == 0), "Shader on — waiting for height tiles")
        .when(phase == "idle", F.concat(F.lit("Shader on — "), text(tracked), F.lit(" tile(s) tracked")))
        .when(total == 0, "Waiting for visible height tiles")
        .when(pending > 0, F.concat(F.lit("Visible recode "), part, F.lit(" ("), text(pending), F.lit(" in flight"), failures, F.lit(")")))
        .when(failed > 0, F.concat(F.lit("Visible recode errors — "), part, F.lit(" ok, "), text(failed), F.lit(" failed")))
        .otherwise(F.concat(F.lit("Visible lossy rasters ready ("), part, F.lit(")")))
    )


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def zero_pad(v: Column, digits: int = 3) -> Column:
    """At least so many digits; longer numbers stay whole."""
    return F.when(v >= 10**digits, v.cast("string")).otherwise(F.lpad(v.cast("string"), digits, "0"))


def tile_file(x: Column, y: Column, size: Column, bits: Column) -> Column:
    """Name of a tile's file: 007_012-4096-32bit.j2c."""
    return F.concat(zero_pad(x), F.lit("_"), zero_pad(y), F.lit("-"), size.cast("string"), F.lit("-"), bits.cast("string"), F.lit("bit.j2c"))


def image_url(file: Column, low_res: Column, use_codec: Column) -> Column:
    """Where a tile's image is served: raw or coded for low resolution, else the normalised tile."""
    return F.concat(F.when(low_res & use_codec, "/ltile/").when(low_res, "/ttile/").otherwise("/tile/"), file)


def coded_url(url: Column) -> Column:
    """The coded form of a raw tile's url."""
    return F.regexp_replace(url, "/ttile/", "/ltile/")


def cache_key(url: Column, quality: Column) -> Column:
    return F.concat(url, F.lit("@q="), quality.cast("string"))


def cell_key(east: Column, north: Column, blank: bool = True) -> Column:
    return F.concat_ws(", " if blank else ",", east.cast("string"), north.cast("string"))


def size_key(url: Column, width: int, height: int) -> Column:
    return F.concat(url, F.lit(f"@{width}x{height}"))


def selection_key(urls: Column) -> Column:
    """The urls of a selection joined by |."""
    return F.array_join(urls, "|")


def route_path(url: Column, root: str = "") -> Column:
    """File behind a served url: /tile/, /ltile/, /os/ and /gpx/ names; null for others.

    Escapes are decoded in GPX names only.
    """
    name = lambda prefix: F.substr(url, F.lit(len(prefix) + 1))
    os_name = name("/os/")
    return (
        F.when(F.startswith(url, F.lit("/tile/")), F.concat(F.lit(f"{root}j2k/jph2/"), name("/tile/"), F.lit("_normalised_rate0.j2c")))
        .when(F.startswith(url, F.lit("/ltile/")), F.concat(F.lit(f"{root}DEFRA/LIDAR_10m_DTM_Composite_2019/htj2k/"), name("/ltile/")))
        .when(F.startswith(url, F.lit("/os/")), F.concat(F.lit(f"{root}OS terr50/data/"), F.substring(os_name, 1, 2), F.lit("/"), os_name, F.lit("_OST50CONT_20190530.zip")))
        .when(F.startswith(url, F.lit("/gpx/")), F.concat(F.lit(f"{root}tracklogs/"), F.try_url_decode(F.replace(name("/gpx/"), F.lit("+"), F.lit("%2B")))))
    )


def is_metre_route(url: Column, has_range: Column) -> Column:
    """Whether a tile is recoded in metres: a coded low-resolution tile of known height range."""
    return F.contains(url, F.lit("/ltile/")) & has_range


def resampled_name(file: Column, size: int = 2048) -> Column:
    return F.replace(file, F.lit(".tif"), F.lit(f"_{size}x{size}.j2c"))


def chunk_prefix(file: Column, x: Column, y: Column) -> Column:
    return F.replace(file, F.lit(".tif"), F.concat(F.lit("_x"), x.cast("string"), F.lit("_y"), y.cast("string")))


def chunk_name(file: Column, x: Column, y: Column, low: Column, high: Column) -> Column:
    return F.concat(chunk_prefix(file, x, y), F.lit("_min"), low.cast("string"), F.lit("_max"), high.cast("string"), F.lit(".j2c"))


def normalised_name(file: Column) -> Column:
    return F.replace(file, F.lit("-32bit"), F.lit("-normalised-16bit"))


def attribute_name(raw: Column) -> Column:
    """Name of a table's field: up to the first NUL, without blanks, lower case."""
    return F.lower(F.replace(F.substring_index(raw, "\0", 1), F.lit(" "), F.lit("")))


def strict_number(text: Column) -> Column:
    """The number that the whole text is, or null; blanks around it don't matter."""
    return F.when(F.trim(text) != "", F.trim(text)).try_cast("double")


def blend_mode_index(name: Column) -> Column:
    """0 .. 3 of a blend mode's name; unknown names count as `mix`."""
    modes = F.create_map(*[x for i, m in enumerate(BLEND_MODES) for x in (F.lit(m), F.lit(i))])
    return F.coalesce(F.try_element_at(modes, name), F.lit(0))


def blend_mode_name(index: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(m) for m in BLEND_MODES]), index), F.lit("mix"))


#: Blend modes in order of their index (fixed values).
BLEND_MODES = ("mix", "wave", "split", "deltaEmissive")


def vector_to_hex(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of channels in 0 .. 1, which are clamped."""
    part = lambda c: F.lpad(F.hex(F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5)), 2, "0")
    return F.lower(F.concat(F.lit("#"), part(r), part(g), part(b)))


def hex_to_vector(colour: Column) -> dict[str, Column]:
    part = lambda i: F.conv(F.substring(colour, i, 2), 16, 10).cast("double") / 255
    return {"r": part(2), "g": part(4), "b": part(6)}
