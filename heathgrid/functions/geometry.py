"""Points, rings and polygons as Column expressions. A ring is an array of structs (lng, lat), open or closed; a polygon an array of rings."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from heathgrid.functions.num import wrap
from heathgrid.functions.tiles import MEAN_RADIUS, RADIUS, haversine

#: Square metres of a hectare and an acre; shortest side and smallest area of a boundary; largest extent in hectares.
HECTARE, ACRE, SHORTEST, SMALLEST, LARGEST = 10_000.0, 4046.8564224, 0.5, 4.0, 200_000.0


def point(lng: Column, lat: Column) -> Column:
    return F.struct(lng.alias("lng"), lat.alias("lat"))


def open_ring(ring: Column) -> Column:
    """The ring without a repeated first vertex at its end."""
    closed = (F.size(ring) > 1) & (ring[0] == F.element_at(ring, -1))
    return F.when(closed, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)


def close_ring(ring: Column) -> Column:
    own = open_ring(ring)
    return F.concat(own, F.slice(own, 1, 1))


def sides(ring: Column) -> Column:
    """Array of structs (a, b) of neighbouring vertices, the last with the first."""
    own = open_ring(ring)
    return F.zip_with(own, F.concat(F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), F.slice(own, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def total(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + value(x))


def ring_area(ring: Column) -> Column:
    """Square metres on the sphere."""
    half = total(sides(ring), lambda s: F.radians(s["b"]["lng"] - s["a"]["lng"]) * (F.lit(2.0) + F.sin(F.radians(s["a"]["lat"])) + F.sin(F.radians(s["b"]["lat"]))))
    return F.abs(half) * (MEAN_RADIUS * MEAN_RADIUS / 2)


def hectares(m2: Column) -> Column:
    return m2 / HECTARE


def acres(m2: Column) -> Column:
    return m2 / ACRE


def centroid(ring: Column) -> Column:
    """Planar centroid, measured from the first vertex to keep digits; the vertices' mean for a ring without area."""
    x0, y0 = ring[0]["lng"], ring[0]["lat"]
    cross = lambda s: (s["a"]["lng"] - x0) * (s["b"]["lat"] - y0) - (s["b"]["lng"] - x0) * (s["a"]["lat"] - y0)
    area = total(sides(ring), cross)
    side = lambda k, at: total(sides(ring), lambda s: (s["a"][k] + s["b"][k] - at * 2) * cross(s)) / (F.when(area != 0, area) * 3.0) + at
    mean = lambda k: total(open_ring(ring), lambda v: v[k]) / F.size(open_ring(ring))
    return point(F.coalesce(side("lng", x0), mean("lng")), F.coalesce(side("lat", y0), mean("lat")))


def bounds(ring: Column) -> Column:
    edge = lambda f, k: f(F.transform(ring, lambda v: v[k]))
    return F.struct(edge(F.array_min, "lng").alias("west"), edge(F.array_min, "lat").alias("south"), edge(F.array_max, "lng").alias("east"), edge(F.array_max, "lat").alias("north"))


def box_ring(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.array(point(west, south), point(east, south), point(east, north), point(west, north), point(west, south))


def inside_ring(lng: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test: whether a ray to the east crosses an odd number of sides."""
    def crosses(s: Column) -> Column:
        spans = (s["a"]["lat"] > lat) != (s["b"]["lat"] > lat)
        rise = s["b"]["lat"] - s["a"]["lat"]
        at = s["a"]["lng"] + (lat - s["a"]["lat"]) / F.when(rise != 0, rise) * (s["b"]["lng"] - s["a"]["lng"])
        return F.when(spans & (lng < at), 1).otherwise(0)

    return F.aggregate(sides(ring), F.lit(0), lambda n, s: n + crosses(s)) % 2 == 1


def inside(lng: Column, lat: Column, polygon: Column) -> Column:
    """Even-odd over all rings, so holes are out."""
    return F.aggregate(polygon, F.lit(False), lambda s, r: s != inside_ring(lng, lat, r))


def turn(a: Column, b: Column, c: Column) -> Column:
    """Side of c from the line a to b: -1, 0 or 1."""
    return F.signum((b["lng"] - a["lng"]) * (c["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (c["lng"] - a["lng"]))


def on_side(a: Column, b: Column, c: Column) -> Column:
    """Whether c, on the line through a and b, lies between them."""
    return c["lng"].between(F.least(a["lng"], b["lng"]), F.greatest(a["lng"], b["lng"])) & c["lat"].between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))


def segments_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether two segments share a point."""
    t = [turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)]
    touch = ((t[0] == 0) & on_side(a, b, c)) | ((t[1] == 0) & on_side(a, b, d)) | ((t[2] == 0) & on_side(c, d, a)) | ((t[3] == 0) & on_side(c, d, b))
    return ((t[0] != t[1]) & (t[2] != t[3])) | touch


def crosses_itself(ring: Column) -> Column:
    """Whether two sides that aren't neighbours share a point."""
    all_sides, n = sides(ring), F.size(sides(ring))
    numbered = F.transform(all_sides, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    apart = lambda p, q: (q["i"] > p["i"] + 1) & ~((p["i"] == 0) & (q["i"] == n - 1))
    return F.exists(numbered, lambda p: F.exists(numbered, lambda q: apart(p, q) & segments_cross(p["s"]["a"], p["s"]["b"], q["s"]["a"], q["s"]["b"])))


def ring_problem(ring: Column) -> Column:
    """What is wrong with a drawn boundary, by the first test that fails; NULL if nothing is."""
    short = F.exists(sides(ring), lambda s: haversine(s["a"]["lng"], s["a"]["lat"], s["b"]["lng"], s["b"]["lat"], MEAN_RADIUS) < SHORTEST)
    return F.when(F.size(open_ring(ring)) < 3, "too few points").when(short, "points too close").when(crosses_itself(ring), "crosses itself").when(ring_area(ring) < SMALLEST, "too small")


def extent_problem(ring: Column) -> Column:
    off = F.exists(ring, lambda v: ~(v["lng"].between(-180, 180) & v["lat"].between(-90, 90)))
    return F.when(off, "outside the world").when(hectares(ring_area(ring)) > LARGEST, "too large")


def offset(lng: Column, lat: Column, bearing: Column, metres: Column) -> Column:
    """The point so far away along a bearing, on the sphere."""
    d, b, phi = metres / RADIUS, F.radians(bearing), F.radians(lat)
    there = F.asin(F.sin(phi) * F.cos(d) + F.cos(phi) * F.sin(d) * F.cos(b))
    turned = F.atan2(F.sin(b) * F.sin(d) * F.cos(phi), F.cos(d) - F.sin(phi) * F.sin(there))
    return point(wrap(lng + F.degrees(turned) + 180.0, 360) - 180.0, F.degrees(there))


def scent_cone(lng: Column, lat: Column, bearing: Column, metres: Column, half_angle: float = 25.0, steps: int = 12) -> Column:
    """Closed ring of a sector from a point."""
    arc = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: offset(lng, lat, bearing - half_angle + k * (2 * half_angle / steps), metres))
    return F.concat(F.array(point(lng, lat)), arc, F.array(point(lng, lat)))


def simplified(line: Column, every: int = 3) -> Column:
    """Every third vertex and the last."""
    last = F.size(line) - 1
    return F.filter(line, lambda v, i: (i % every == 0) | (i == last))


def to_geojson(ring: Column) -> Column:
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(close_ring(ring), lambda v: F.array(v["lng"], v["lat"]))).alias("coordinates")))


def from_geojson(text: Column) -> Column:
    """Polygon of a GeoJSON Polygon; NULL for anything else."""
    read = F.from_json(text, "type string, coordinates array<array<array<double>>>")
    rings = F.transform(read["coordinates"], lambda r: F.transform(r, lambda v: point(v[0], v[1])))
    return F.when(read["type"] == "Polygon", rings)


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull of one group's points, anticlockwise: lower chain, then upper, over sorted points."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts
    chains = []
    for run in (pts, pts[::-1]):
        chain: list[tuple[float, float]] = []
        for p in run:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        chains.append(chain[:-1])
    return chains[0] + chains[1]


MILES_LAT, MILES_LNG = 69.055, 69.172


def span_miles(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Struct of width and height in miles of a box."""
    return F.struct(((east - west) * F.cos(F.radians((south + north) / 2.0)) * MILES_LNG).alias("width"), ((north - south) * MILES_LAT).alias("height"))


def padded(west: Column, south: Column, east: Column, north: Column, share: float) -> Column:
    dx, dy, last = (east - west) * share, (north - south) * share, 85.051129
    return F.struct((west - dx).alias("west"), F.greatest(south - dy, F.lit(-last)).alias("south"), (east + dx).alias("east"), F.least(north + dy, F.lit(last)).alias("north"))


