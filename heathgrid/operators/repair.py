"""Polygons whose rings cross or touch themselves, made valid: the same ground by the even-odd rule, as simple rings.

Every pair of sides is split where it meets; stretches that lie on one another an even number of times cancel. What is left
separates inside from outside, so it is walked with the inside on the left, closing a ring whenever a corner comes again.
Rings that run anticlockwise are outlines, the others are holes of the outline around them. A polygon is one row and its
sides are few; the work is the square of their number. Valid polygons pass without Python.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from heathgrid.functions import geometry

#: Decimal places to which corners are the same: a tenth of a millimetre and less.
PLACES = 11
Point = tuple[float, float]


def meets(a: Point, b: Point, c: Point, d: Point) -> list[Point]:
    """The points at which sides ab and cd must be split: their crossing, or ends that lie on the other side."""
    r, s = (b[0] - a[0], b[1] - a[1]), (d[0] - c[0], d[1] - c[1])
    cross, apart = r[0] * s[1] - r[1] * s[0], (c[0] - a[0], c[1] - a[1])
    scale = math.hypot(*r) * math.hypot(*s)
    if abs(cross) > 1e-12 * scale:
        t, u = (apart[0] * s[1] - apart[1] * s[0]) / cross, (apart[0] * r[1] - apart[1] * r[0]) / cross
        return [(a[0] + t * r[0], a[1] + t * r[1])] if -1e-12 <= t <= 1 + 1e-12 and -1e-12 <= u <= 1 + 1e-12 else []
    if abs(apart[0] * r[1] - apart[1] * r[0]) > 1e-12 * math.hypot(*r) * max(math.hypot(*apart), 1e-300):
        return []
    on = lambda p, q, v: min(p[0], q[0]) <= v[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= v[1] <= max(p[1], q[1])
    return [v for p, q, ends in ((a, b, (c, d)), (c, d, (a, b))) for v in ends if on(p, q, v)]


def boundary(rings: list[list[Point]]) -> list[tuple[Point, Point]]:
    """Stretches between inside and outside, each once, in no direction."""
    snap = lambda p: (round(p[0], PLACES) + 0.0, round(p[1], PLACES) + 0.0)
    sides = []
    for ring in rings:
        own = [snap(p) for p in ring if None not in p]
        sides += [(p, q) for p, q in zip(own, own[1:] + own[:1], strict=True) if p != q]
    cuts = [{p, q} for p, q in sides]
    for i, (a, b) in enumerate(sides):
        for j in range(i + 1, len(sides)):
            c, d = sides[j]
            if max(a[0], b[0]) < min(c[0], d[0]) or max(c[0], d[0]) < min(a[0], b[0]) or max(a[1], b[1]) < min(c[1], d[1]) or max(c[1], d[1]) < min(a[1], b[1]):
                continue
            for p in map(snap, meets(a, b, c, d)):
                cuts[i].add(p)
                cuts[j].add(p)
    times: Counter = Counter()
    for (a, b), points in zip(sides, cuts, strict=True):
        way = sorted(points, key=lambda p: (p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1]))
        times.update((min(p, q), max(p, q)) for p, q in zip(way[:-1], way[1:], strict=True))
    return [e for e, n in times.items() if n % 2]


def inside(p: Point, stretches: list[tuple[Point, Point]]) -> bool:
    odd = False
    for (ax, ay), (bx, by) in stretches:
        if (ay > p[1]) != (by > p[1]) and p[0] < ax + (p[1] - ay) / (by - ay) * (bx - ax):
            odd = not odd
    return odd


def area(ring: list[Point]) -> float:
    """Planar; above 0 for anticlockwise rings."""
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def loops(stretches: list[tuple[Point, Point]]) -> list[list[Point]]:
    """Simple rings along the stretches, the inside on the left."""
    out: dict[Point, list[Point]] = defaultdict(list)
    for p, q in stretches:
        dx, dy = q[0] - p[0], q[1] - p[1]
        near = 1e-6
        left = ((p[0] + q[0]) / 2 - dy * near, (p[1] + q[1]) / 2 + dx * near)
        a, b = (p, q) if inside(left, stretches) else (q, p)
        out[a].append(b)
    found = []
    for start in list(out):
        while out[start]:
            ring, at = [start], out[start].pop()
            before = start
            while True:
                if at in ring:
                    k = ring.index(at)
                    found.append(ring[k:])
                    ring = ring[:k]
                    if not ring:
                        break
                    before = ring[-1]
                ring.append(at)
                back = math.atan2(before[1] - at[1], before[0] - at[0])
                # the first way clockwise from where it came hugs the inside
                ahead = min(out[at], key=lambda q: (back - math.atan2(q[1] - at[1], q[0] - at[0])) % (2 * math.pi) or 2 * math.pi)
                out[at].remove(ahead)
                before, at = at, ahead
    return found


def straight(ring: list[Point]) -> list[Point]:
    """Without corners that lie on the way between their neighbours."""
    kept = []
    for k, p in enumerate(ring):
        a, b = ring[k - 1], ring[(k + 1) % len(ring)]
        turn = (p[0] - a[0]) * (b[1] - p[1]) - (p[1] - a[1]) * (b[0] - p[0])
        if abs(turn) > 1e-12 * math.dist(a, p) * math.dist(p, b):
            kept.append(p)
    return kept


def made_valid(rings: list[list[Point]]) -> list[list[list[Point]]]:
    """Polygons (an outline, then its holes), largest first; none for rings without ground."""
    rings_out = [straight(x) for x in loops(boundary(rings))]
    outlines = sorted((x for x in rings_out if len(x) > 2 and area(x) > 0), key=lambda x: (-area(x), min(x)))
    polygons = [[x] for x in outlines]
    for hole in (x for x in rings_out if len(x) > 2 and area(x) < 0):
        p, q = hole[0], hole[1]
        # just outside the hole, on its left, is inside the polygon that it belongs to
        spot = ((p[0] + q[0]) / 2 - (q[1] - p[1]) * 1e-6, (p[1] + q[1]) / 2 + (q[0] - p[0]) * 1e-6)
        around = [k for k, x in enumerate(outlines) if inside(spot, list(zip(x, x[1:] + x[:1], strict=True)))]
        if around:
            polygons[min(around, key=lambda k: area(outlines[k]))].append(hole)
    return polygons


def repaired(rows: DataFrame, column: str = "polygon") -> DataFrame:
    """rows with `polygons` (an array of polygons: outline, holes) made of a polygon's rings: as they are where no ring crosses itself and there is one.

    Rings come out open. NULL stays NULL; a polygon without ground, or with fewer than three corners a ring, gives an empty array.
    """

    kind = StructType([*rows.schema.fields, StructField("polygons", ArrayType(ArrayType(ArrayType(StructType([StructField("lng", DoubleType()), StructField("lat", DoubleType())])))))])
    shape = pa.list_(pa.list_(pa.list_(pa.struct([("lng", pa.float64()), ("lat", pa.float64())]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for polygon in batch.column(column).to_pylist():
                rings = [[(p["lng"], p["lat"]) for p in ring if p is not None] for ring in polygon if ring is not None]
                told.append([[[{"lng": x, "lat": y} for x, y in ring] for ring in part] for part in made_valid(rings)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, type=shape)], names=[*batch.schema.names, "polygons"])

    c = F.col(column)
    ring = F.get(c, F.lit(0))
    fine = F.when((F.size(c) == 1) & (F.size(ring) > 3), ~geometry.crosses_itself(ring))
    valid = F.coalesce(fine, F.lit(False))
    plain = rows.where(valid | c.isNull()).withColumn("polygons", F.when(c.isNotNull(), F.array(F.transform(c, geometry.open_ring))))
    return plain.union(rows.where(~valid & c.isNotNull()).mapInArrow(run, kind))
