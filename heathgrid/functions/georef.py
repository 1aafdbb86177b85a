"""Where a raster's pixels lie: north-up affines between pixels, model coordinates and places, as Column expressions.

A placement is a struct column: sx, sy (model units a pixel), i, j (the tie point's pixel), x, y (its model
coordinate) and zone (the UTM zone north of the equator, NULL for degrees). Pixel k covers [k, k + 1); rows go south.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heathgrid.functions.num import let
from heathgrid.functions.tiles import DEGREE, utm, utm_inverse

PLACEMENT = "struct<sx:double,sy:double,i:double,j:double,x:double,y:double,zone:int>"


class Unplaced(ValueError):
    """A raster that doesn't say where it lies, or says it in a way that isn't read."""


# fixed values: GeoTIFF keys and codes
MODEL, RASTER, GEOGRAPHIC_CRS, PROJECTED_CRS = 1024, 1025, 2048, 3072
PROJECTED, GEOGRAPHIC, PIXEL_IS_AREA, WGS84 = 1, 2, 1, 4326
#: EPSG codes before zone 1: NAD 83 (zones 1 to 23) and WGS 84 (1 to 60).
UTM_CODES = ((26900, 23), (32600, 60))


def crs(keys: dict[int, int]) -> tuple[int, int | None]:
    """EPSG code and UTM zone (None: degrees) of a file's keys."""
    if keys.get(RASTER, PIXEL_IS_AREA) != PIXEL_IS_AREA:
        raise Unplaced("pixels are points: every place would be off by half a cell")
    model = keys.get(MODEL)
    if model == GEOGRAPHIC:
        return keys.get(GEOGRAPHIC_CRS, WGS84), None
    if model != PROJECTED:
        raise Unplaced(f"model type {model} is neither geographic nor projected")
    code = keys.get(PROJECTED_CRS)
    for before, zones in UTM_CODES:
        if code is not None and 1 <= code - before <= zones:
            return code, code - before
    raise Unplaced(f"EPSG {code} is no UTM zone of the north")


def placement(scale: tuple, tiepoint: tuple, zone: int | None, fx: float = 1.0, fy: float = 1.0) -> dict:
    """A placement's fields; fx and fy: how many times as coarse the level is as the file's first one."""
    if len(scale) < 2 or len(tiepoint) < 6:
        raise Unplaced("no pixel scale or tie point")
    return {"sx": scale[0] * fx, "sy": scale[1] * fy, "i": tiepoint[0] / fx, "j": tiepoint[1] / fy, "x": tiepoint[3], "y": tiepoint[4], "zone": zone}


def metres(place: dict) -> float:
    """Of a pixel, from north to south."""
    return place["sy"] if place["zone"] is not None else place["sy"] * DEGREE


def model_to_pixel(x: Column, y: Column, g: Column) -> Column:
    """Struct of px, py; fractions count from a pixel's north-west corner."""
    return F.struct((g["i"] + (x - g["x"]) / g["sx"]).alias("px"), (g["j"] + (g["y"] - y) / g["sy"]).alias("py"))


def pixel_to_model(px: Column, py: Column, g: Column) -> Column:
    """Struct of x, y."""
    return F.struct((g["x"] + (px - g["i"]) * g["sx"]).alias("x"), (g["y"] - (py - g["j"]) * g["sy"]).alias("y"))


def model_of(lng: Column, lat: Column, g: Column) -> Column:
    """Struct of x, y: a place in a raster's model coordinates."""
    flat = F.struct(lng.cast("double").alias("x"), lat.cast("double").alias("y"))
    metres_of = let(utm(lng, lat, g["zone"]), lambda u: F.struct(u["easting"].alias("x"), u["northing"].alias("y")))
    return F.when(g["zone"].isNull(), flat).otherwise(metres_of)


def place_of(x: Column, y: Column, g: Column) -> Column:
    """Struct of lng, lat."""
    flat = F.struct(x.cast("double").alias("lng"), y.cast("double").alias("lat"))
    return F.when(g["zone"].isNull(), flat).otherwise(utm_inverse(g["zone"], x, y, F.lit(True)))


def pixel_of(lng: Column, lat: Column, g: Column) -> Column:
    """Struct of px, py."""
    return let(model_of(lng, lat, g), lambda m: model_to_pixel(m["x"], m["y"], g))


def box_of(x0: Column, y0: Column, x1: Column, y1: Column, g: Column) -> Column:
    """Struct of west, south, east, north around pixels [x0, x1) by [y0, y1): corners and midpoints, and a margin for edges that bend between them."""
    three = lambda a, b: (a.cast("double"), (a + b) / 2, b.cast("double"))
    models = F.array(*(pixel_to_model(x, y, g) for x in three(x0, x1) for y in three(y0, y1)))
    spots = F.transform(models, lambda m: place_of(m["x"], m["y"], g))
    part = F.when(g["zone"].isNull(), 0.0).otherwise(0.01)

    def around(s: Column) -> Column:
        lngs, lats = F.transform(s, lambda p: p["lng"]), F.transform(s, lambda p: p["lat"])
        west, east, south, north = F.array_min(lngs), F.array_max(lngs), F.array_min(lats), F.array_max(lats)
        return F.struct((west - (east - west) * part).alias("west"), (south - (north - south) * part).alias("south"), (east + (east - west) * part).alias("east"), (north + (north - south) * part).alias("north"))

    return let(spots, around)
