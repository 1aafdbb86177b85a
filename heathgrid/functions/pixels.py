"""Elevation in RGB pixels, colour ramps and layers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heathgrid.functions.num import clamp, half_up

#: The no-data height, and the least height that is data.
NO_DATA, FLOOR = -32768.0, -32767.0
#: Steps that three bytes tell apart; least height and steps a metre of the encodings.
STEPS, TERRARIUM, TERRAIN_RGB = 2**24, (NO_DATA, 256), (-10000.0, 10)


def elevation(z: Column) -> Column:
    """z, or NULL where it's the no-data height or not finite."""
    return F.when((z > FLOOR) & ~F.isnan(z) & (z < F.lit(float("inf"))), z)


def decode_terrarium(r: Column, g: Column, b: Column) -> Column:
    return r * 256.0 + g + b / 256.0 + NO_DATA


def decode_terrain_rgb(r: Column, g: Column, b: Column) -> Column:
    return (r * 65536 + g * 256 + b) * 0.1 - 10000.0


def decode_rgba(r: Column, g: Column, b: Column, a: Column, encoding: str = "terrarium") -> Column:
    """Height of a pixel; NULL where it's transparent or no data."""
    z = decode_terrarium(r, g, b) if encoding == "terrarium" else decode_terrain_rgb(r, g, b)
    return F.when(a != 0, elevation(z))


def encode_terrarium(z: Column) -> Column:
    """Struct of r, g, b, a; a 0 for an unknown height."""
    v = clamp(z - NO_DATA, 0, 65535.99609375)
    whole = F.floor(v)
    return _rgba(z, F.floor(whole / 256), whole % 256, half_up((v - whole) * 256) % 256)


def encode_terrain_rgb(z: Column) -> Column:
    v = F.greatest(F.lit(0).cast("long"), half_up((z + 10000.0) * 10.0))
    return _rgba(z, F.floor(v / 65536) % 256, F.floor(v / 256) % 256, v % 256)


def paged(z: Column, least: float, per_metre: int) -> Column:
    """Struct of page and z: the height to the encoding's step, brought by whole spans of three bytes into what the bytes hold; NULL for an unknown height.

    The bytes end at 32,768 m, or 1,667,721.6 m; the page, kept beside the pixel, leads back to heights beyond.
    """
    n = half_up((z - least) * float(per_metre))
    page = F.floor(n / float(STEPS))
    return F.struct(page.alias("page"), ((n - page * STEPS) / float(per_metre) + least).alias("z"))


def unpaged(z: Column, page: Column, per_metre: int) -> Column:
    """The height that a page and a pixel's height stand for."""
    return z + page * (STEPS / per_metre)


def _rgba(z: Column, *parts: Column) -> Column:
    each = [F.coalesce(F.when(z.isNotNull(), p), F.lit(0)).cast("int").alias(k) for k, p in zip("rgb", parts, strict=True)]
    return F.struct(*each, F.when(z.isNotNull(), 255).otherwise(0).alias("a"))


def rgba(r, g, b, a) -> Column:
    return F.struct(*(F.lit(x).cast("int").alias(k) for k, x in zip("rgba", (r, g, b, a), strict=True)))


def ramp(value: Column, stops: list[tuple[float, tuple[int, int, int, int]]]) -> Column:
    """Colour between stops, the ends beyond them, transparent for NULL."""
    out = F.when(value.isNull(), rgba(0, 0, 0, 0)).when(value <= stops[0][0], rgba(*stops[0][1]))
    for (v0, c0), (v1, c1) in zip(stops[:-1], stops[1:], strict=True):
        t = (value - v0) / (v1 - v0)
        mixed = F.struct(*(half_up(t * (b - a) + a).cast("int").alias(k) for k, a, b in zip("rgba", c0, c1, strict=True)))
        out = out.when(value <= v1, mixed)
    return out.otherwise(rgba(*stops[-1][1]))


#: Stops of the heat ramp.
HEAT = [(0.0, (0, 0, 0, 0)), (0.25, (66, 133, 90, 90)), (0.5, (214, 178, 60, 150)), (0.75, (222, 120, 44, 190)), (1.0, (196, 48, 40, 220))]


def categorical(code: Column, palette: dict[int, tuple[int, int, int, int]]) -> Column:
    out = F.when(code.isNull(), rgba(0, 0, 0, 0))
    for k, c in palette.items():
        out = out.when(code == k, rgba(*c))
    return out.otherwise(rgba(0, 0, 0, 0))


def over(lower: Column, upper: Column) -> Column:
    """upper laid over lower; the order matters."""
    a, b = upper["a"] / 255.0, lower["a"] / 255.0
    alpha = a + b * (F.lit(1.0) - a)
    part = lambda k: half_up(F.coalesce((upper[k] * a + lower[k] * b * (F.lit(1.0) - a)) / F.when(alpha > 0, alpha), F.lit(0.0))).cast("int").alias(k)
    return F.struct(part("r"), part("g"), part("b"), half_up(alpha * 255.0).cast("int").alias("a"))


def composite(layers: Column) -> Column:
    """Fold of an ordered array of colours."""
    return F.aggregate(layers, rgba(0, 0, 0, 0), over)


def hex_color(text: Column) -> Column:
    """Struct of r, g, b of #rgb or #rrggbb; NULL for anything else."""
    body = F.substring(text, 2, 6)
    full = F.when(text.rlike("^#[0-9a-fA-F]{6}$"), body).when(text.rlike("^#[0-9a-fA-F]{3}$"), F.regexp_replace(body, "(.)", "$1$1"))
    part = lambda k: F.conv(F.substring(full, 2 * k + 1, 2), 16, 10).cast("int")
    return F.when(full.isNotNull(), F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b")))


def unit(value: Column, most: float) -> Column:
    return clamp(value / most, 0, 1)


#: Stops of the slope ramp; how much lighter a mask's edge is.
SLOPE = [(0.0, (58, 84, 110, 0)), (8.0, (72, 140, 176, 140)), (20.0, (96, 186, 154, 170)), (30.0, (226, 190, 90, 190)), (45.0, (216, 118, 66, 210)), (70.0, (156, 48, 62, 235))]
LIGHTER = 70


def shade(value: Column, opacity: float = 1.0) -> Column:
    """Grey of a light from 0 to 1; transparent where unknown."""
    v, alpha = half_up(value * 255.0).cast("int"), int(255 * opacity + 0.5)
    return F.when(value.isNull(), rgba(0, 0, 0, 0)).otherwise(F.struct(v.alias("r"), v.alias("g"), v.alias("b"), F.lit(alpha).alias("a")))


def mask(set_: Column, color: Column, opacity: Column, edge: Column | None = None) -> Column:
    """Colour (#rrggbb) of set cells; those of the edge, if given, lighter and opaque; the rest transparent."""
    c = hex_color(color)
    alpha = half_up(clamp(opacity, 0, 1) * 255.0).cast("int")
    own = F.struct(c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"), alpha.alias("a"))
    if edge is not None:
        bright = F.struct(*(F.least(F.lit(255), c[k] + LIGHTER).alias(k) for k in "rgb"), F.lit(255).alias("a"))
        own = F.when(edge, bright).otherwise(own)
    return F.when(F.coalesce(set_, F.lit(False)), own).otherwise(rgba(0, 0, 0, 0))
