"""Web-Mercator tiles, UTM and distances as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heathgrid.functions.num import clamp, half_up, wrap

#: Metres a pixel at the equator at zoom 0, sphere radii, Mercator's last latitude, metres a degree.
EQUATOR_PIXEL, RADIUS, MEAN_RADIUS, LAST_LATITUDE, DEGREE = 156543.03392804097, 6378137.0, 6371008.8, 85.051129, 111320.0
#: GRS 80 and the UTM grid.
A, FLATTENING, K0, EAST0, NORTH0 = 6378137.0, 1 / 298.257222101, 0.9996, 500000.0, 10000000.0


def pixel_size(lat: Column, zoom: Column, tile_size: int = 256) -> Column:
    return F.cos(F.radians(lat)) * EQUATOR_PIXEL / (F.pow(F.lit(2.0), zoom) * (tile_size / 256))


def tile_x(lng: Column, zoom: Column) -> Column:
    return (lng + 180.0) / 360.0 * F.pow(F.lit(2.0), zoom)


def tile_y(lat: Column, zoom: Column) -> Column:
    """Fractional row; the inverse hyperbolic sine of tan(lat) is Mercator's stretched latitude."""
    return (F.lit(1.0) - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * F.pow(F.lit(2.0), zoom)


def lng_of(x: Column, zoom: Column) -> Column:
    return x / F.pow(F.lit(2.0), zoom) * 360.0 - 180.0


def lat_of(y: Column, zoom: Column) -> Column:
    return F.degrees(F.atan(F.sinh((F.lit(1.0) - y * 2.0 / F.pow(F.lit(2.0), zoom)) * math.pi)))


def tile_bbox(x: Column, y: Column, zoom: Column) -> Column:
    return F.struct(lng_of(x, zoom).alias("west"), lat_of(y + 1, zoom).alias("south"), lng_of(x + 1, zoom).alias("east"), lat_of(y, zoom).alias("north"))


def tile_center(x: Column, y: Column, zoom: Column) -> Column:
    return F.struct(lng_of(x + 0.5, zoom).alias("lng"), lat_of(y + 0.5, zoom).alias("lat"))


def tile_ranges(west: Column, south: Column, east: Column, north: Column, zoom: Column) -> Column:
    """Struct of x0, x1, y0, y1 (both ends included) of the tiles over a box, clamped to the world."""
    last = F.pow(F.lit(2.0), zoom).cast("long") - 1
    lat = lambda c: clamp(c, -LAST_LATITUDE, LAST_LATITUDE)
    inside = lambda c: F.least(F.greatest(F.floor(c), F.lit(0).cast("long")), last)
    return F.struct(inside(tile_x(west, zoom)).alias("x0"), inside(tile_x(east, zoom)).alias("x1"), inside(tile_y(lat(north), zoom)).alias("y0"), inside(tile_y(lat(south), zoom)).alias("y1"))


def longitude_spans(west: Column, east: Column) -> Column:
    """Array of (west, east) within [-180, 180]: two where the box crosses the antimeridian, the whole world from 359.9 degrees on."""
    span = lambda a, b: F.struct(a.cast("double").alias("west"), b.cast("double").alias("east"))
    w, e = wrap(west + 180.0, 360) - 180.0, wrap(east + 180.0, 360) - 180.0
    e = F.when((e == -180.0) & (east > west), F.lit(180.0)).otherwise(e)
    return F.when(east - west >= 359.9, F.array(span(F.lit(-180.0), F.lit(180.0)))).when(w <= e, F.array(span(w, e))).otherwise(F.array(span(w, F.lit(180.0)), span(F.lit(-180.0), e)))


#: Rows of tiles that one strip holds, as bits of a long.
STRIP_BITS = 5


def _columns_over(boxes: DataFrame, zooms: list[int]) -> DataFrame:
    """boxes with zoom, x of every column of tiles over each, and _y0 and _y1, its first and last row.

    Repeated boxes go before they are opened, and a column that both spans of a box share within its row, so only boxes are shuffled and never tiles.
    """
    rows = boxes.distinct().withColumn("zoom", F.explode(F.array(*map(F.lit, dict.fromkeys(zooms)))))
    each = F.transform(longitude_spans(F.col("west"), F.col("east")), lambda s: tile_ranges(s["west"], F.col("south"), s["east"], F.col("north"), F.col("zoom")))
    rows = rows.withColumn("_r", F.explode(F.array(each)))
    rows = rows.withColumn("x", F.explode(F.array_distinct(F.flatten(F.transform("_r", lambda r: F.sequence(r["x0"], r["x1"]))))))
    return rows.withColumns({"_y0": F.col("_r")[0]["y0"], "_y1": F.col("_r")[0]["y1"]}).drop("_r")


def tiles_over(boxes: DataFrame, zooms: list[int]) -> DataFrame:
    """boxes (west, south, east, north, ...) with zoom, x, y of every tile over each: generated in place, without a join."""
    return _columns_over(boxes, zooms).withColumn("y", F.explode(F.sequence("_y0", "_y1"))).drop("_y0", "_y1")


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def strips_over(boxes: DataFrame, zooms: list[int]) -> DataFrame:
    """The tiles of `tiles_over` as strips (zoom, x, strip, bits), each once a box: bit k of a strip is the tile in row 32 * strip + k of column x.

    So what joins or groups tiles of many boxes moves a row a column and 32 rows instead of one a tile.
    """
    rows = _columns_over(boxes, zooms).withColumns({"_y0": F.least("_y0", "_y1"), "_y1": F.greatest("_y0", "_y1")})
    rows = rows.withColumn("strip", F.explode(F.sequence(F.shiftright("_y0", STRIP_BITS), F.shiftright("_y1", STRIP_BITS))))
    top, last = F.shiftleft("strip", STRIP_BITS), F.lit((1 << STRIP_BITS) - 1).cast("long")
    low, high = F.greatest(F.col("_y0") - top, F.lit(0).cast("long")), F.least(F.col("_y1") - top, last)
    return rows.withColumn("bits", _bit(high + 1) - _bit(low)).drop("_y0", "_y1")


def strips_of(tiles: DataFrame) -> DataFrame:
    """zoom, x, strip and bits of tiles (zoom, x, y), each strip once."""
    return tiles.groupBy("zoom", "x", F.shiftright("y", STRIP_BITS).alias("strip")).agg(F.bit_or(_bit(F.col("y") % (1 << STRIP_BITS))).alias("bits"))


def opened(strips: DataFrame) -> DataFrame:
    """Strips with y of every tile instead of strip and bits, in place."""
    places = F.filter(F.sequence(F.lit(0), F.lit((1 << STRIP_BITS) - 1)), lambda k: F.getbit("bits", k) == 1)
    return strips.withColumn("_k", F.explode(places)).withColumn("y", F.shiftleft("strip", STRIP_BITS) + F.col("_k")).drop("strip", "bits", "_k")


def tiles_of(strips: DataFrame) -> DataFrame:
    """Every tile (zoom, x, y) of strips once, whatever boxes they are of."""
    return opened(strips.groupBy("zoom", "x", "strip").agg(F.bit_or("bits").alias("bits")))


def tile_count(boxes: DataFrame, zooms: list[int]) -> DataFrame:
    """boxes with zoom and n_tiles, by arithmetic alone."""
    rows = boxes.withColumn("zoom", F.explode(F.array(*map(F.lit, zooms))))
    each = F.transform(longitude_spans(F.col("west"), F.col("east")), lambda s: tile_ranges(s["west"], F.col("south"), s["east"], F.col("north"), F.col("zoom")))
    return rows.withColumn("n_tiles", F.aggregate(each, F.lit(0).cast("long"), lambda n, r: n + (r["x1"] - r["x0"] + 1) * (r["y1"] - r["y0"] + 1)))


def source_zoom(zoom: Column, most: int) -> Column:
    return clamp(half_up(zoom + 1.0), 0, most).cast("int")


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column, radius: float = RADIUS) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2.0), F.lit(2.0))
    return F.asin(F.least(F.lit(1.0), F.sqrt(half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)))) * (2 * radius)


def utm_zone(lng: Column) -> Column:
    return (F.floor(wrap(lng + 180.0, 360) / 6.0) % 60 + 1).cast("int")


def central_meridian(zone: Column) -> Column:
    return (zone - 1) * 6 - 177


def nad83_epsg(zone: Column) -> Column:
    return zone + 26900


def zone_of_epsg(code: Column) -> Column:
    return F.when(code.between(26901, 26923), code - 26900).when(code.between(32601, 32660), code - 32600)


#: The transverse Mercator series in the third flattening, after Krueger: forward and inverse terms, and the rectifying radius.
_N = FLATTENING / (2 - FLATTENING)
RECTIFYING = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
INVERSE = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm(lng: Column, lat: Column, zone: Column | None = None) -> Column:
    """Struct of zone, easting, northing, north: sums of harmonics on the conformal sphere."""
    z = utm_zone(lng) if zone is None else zone
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    turn = F.radians(wrap(lng - central_meridian(z) + 180.0, 360) - 180.0)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.atanh(s * e) * e)
    xi, eta = F.atan2(t, F.cos(turn)), F.asinh(F.sin(turn) / F.sqrt(t * t + F.cos(turn) * F.cos(turn)))
    x, y = eta, xi
    for k, a in enumerate(FORWARD, 1):
        x = x + F.cos(xi * (2 * k)) * F.sinh(eta * (2 * k)) * a
        y = y + F.sin(xi * (2 * k)) * F.cosh(eta * (2 * k)) * a
    return F.struct(z.cast("int").alias("zone"), (x * (K0 * RECTIFYING) + EAST0).alias("easting"), (y * (K0 * RECTIFYING) + F.when(lat < 0, NORTH0).otherwise(0.0)).alias("northing"), (lat >= 0).alias("north"))


def utm_inverse(zone: Column, easting: Column, northing: Column, north: Column) -> Column:
    """Struct of lng, lat."""
    xi = (northing - F.when(north, 0.0).otherwise(NORTH0)) / (K0 * RECTIFYING)
    eta = (easting - EAST0) / (K0 * RECTIFYING)
    x, y = eta, xi
    for k, b in enumerate(INVERSE, 1):
        x = x - F.cos(xi * (2 * k)) * F.sinh(eta * (2 * k)) * b
        y = y - F.sin(xi * (2 * k)) * F.cosh(eta * (2 * k)) * b
    chi = F.asin(F.sin(y) / F.cosh(x))
    lat = chi
    for k, d in enumerate(LATITUDE, 1):
        lat = lat + F.sin(chi * (2 * k)) * d
    return F.struct((F.degrees(F.atan2(F.sinh(x), F.cos(y))) + central_meridian(zone)).alias("lng"), F.degrees(lat).alias("lat"))


def one_degree_cell(lng: Column, lat: Column) -> Column:
    """Name of the one-degree cell by its north-west corner."""
    top, left = F.ceil(lat), F.floor(lng)
    side = lambda v, plus, minus: F.when(v >= 0, plus).otherwise(minus)
    return F.concat(side(top, "n", "s"), F.lpad(F.abs(top).cast("string"), 2, "0"), side(left, "e", "w"), F.lpad(F.abs(left).cast("string"), 3, "0"))


def signature(ids: Column) -> Column:
    """Order-free name of a set of ids, as an aggregate."""
    return F.array_join(F.array_sort(F.collect_set(ids)), " ")
