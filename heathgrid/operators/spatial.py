"""Joins of points with boxes and polygons through map tiles, and polygons as runs of cells.

A polygon is covered by the few map tiles over its bounds, at the zoom where they are a few; its size decides the
zoom. A point names its tile at each zoom in use, so both sides meet in an equi-join, which Spark may split
where a tile is crowded; the exact test follows in the join's condition. Coordinates are degrees; shapes don't cross the antimeridian.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heathgrid.functions import geometry
from heathgrid.functions.num import clamp
from heathgrid.functions.tiles import LAST_LATITUDE, tile_ranges, tile_x, tile_y

FINEST = 22
#: Pairs of points and boxes in a piece, most partitions.
PAIRS, MOST_PARTS = 4_000_000, 10_000


def cover_zoom(west: Column, south: Column, east: Column, north: Column) -> Column:
    """The finest zoom at which a box is at most one tile wide and high, so that it touches four at most."""
    zero = F.lit(0)
    lat = lambda c: clamp(c, -LAST_LATITUDE, LAST_LATITUDE)
    extent = F.greatest(tile_x(east, zero) - tile_x(west, zero), tile_y(lat(south), zero) - tile_y(lat(north), zero))
    return F.when(extent > 0, F.greatest(F.lit(0), F.least(F.lit(FINEST), F.floor(-F.log2(F.when(extent > 0, extent)))))).otherwise(FINEST).cast("int")


def cover(boxes: DataFrame) -> DataFrame:
    """boxes (west, south, east, north, ...) with zoom, tx, ty of each tile that covers them."""
    rows = boxes.withColumn("zoom", cover_zoom(*(F.col(c) for c in ("west", "south", "east", "north"))))
    rows = rows.withColumn("its_r", tile_ranges(F.col("west"), F.col("south"), F.col("east"), F.col("north"), F.col("zoom")))
    return rows.withColumn("tx", F.explode(F.sequence("its_r.x0", "its_r.x1"))).withColumn("ty", F.explode(F.sequence("its_r.y0", "its_r.y1"))).drop("its_r")


def filed(points: DataFrame, zooms: list[int]) -> DataFrame:
    """points (lng, lat, ...) with zoom, tx, ty of their tile at each of the zooms."""
    rows = points.withColumn("zoom", F.explode(F.array(*map(F.lit, zooms)) if zooms else F.array().cast("array<int>")))
    r = tile_ranges(F.col("lng"), F.col("lat"), F.col("lng"), F.col("lat"), F.col("zoom"))
    return rows.withColumn("its_r", r).withColumns({"tx": F.col("its_r.x0"), "ty": F.col("its_r.y0")}).drop("its_r")


def zooms_of(covered: DataFrame) -> list[int]:
    """The zooms in use, FINEST + 1 at most."""
    return sorted(r.zoom for r in covered.select("zoom").distinct().where("zoom is not null").collect())


def met_in_tiles(points: DataFrame, boxes: DataFrame) -> tuple[DataFrame, int]:
    """Each point with each box over one of its tiles that holds it, edges included; and the number of pairs looked at.

    A tile's points are dealt in pieces of at most PAIRS pairs or so, each of which meets all the tile's boxes. Pieces have partitions of
    their own: rows this small would otherwise be merged by their bytes into a task or two, whatever the pairs.
    """
    covered, tile = cover(boxes), ["zoom", "tx", "ty"]
    at = filed(points, zooms_of(covered))
    load = at.groupBy(*tile).agg(F.count("*").alias("its_n")).join(covered.groupBy(*tile).agg(F.count("*").alias("its_m")), tile).withColumn("its_pairs", F.col("its_n") * F.col("its_m"))
    load = load.select(*tile, "its_pairs", F.ceil(F.col("its_pairs") / PAIRS).alias("its_pieces"))
    pairs, pieces = load.agg(F.coalesce(F.sum("its_pairs"), F.lit(0)), F.coalesce(F.sum(F.col("its_pairs") / PAIRS), F.lit(0.0))).first()
    load, n, keys = load.drop("its_pairs"), parts(pieces), [*tile, "its_piece"]
    spread = F.xxhash64(*(c for c, kind in points.dtypes if "map<" not in kind))
    left = at.join(load, tile).withColumn("its_piece", F.pmod(spread, F.col("its_pieces"))).drop("its_pieces").repartition(n, *keys)
    right = covered.join(load, tile).withColumn("its_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("its_pieces") - 1))).drop("its_pieces").repartition(n, *keys)
    held = F.col("lng").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))
    return left.join(right, keys).where(held).drop(*keys), pairs


def parts(pieces: float) -> int:
    """Partitions for so many pieces of PAIRS pairs: one more than those, and at most what a driver keeps track of."""
    return min(int(pieces) + 1, MOST_PARTS)


def in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each point (lng, lat, ...) with each box (west, south, east, north, ...) that holds it, edges included."""
    return met_in_tiles(points, boxes)[0]


def in_polygons(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Each point (lng, lat, ...) with each polygon (polygon: array of rings, ...) that holds it by the even-odd rule.

    Points and polygons with unknown parts, and polygons without a ring, meet nothing. Points at one place share its tests
    and are joined to what it lies in, over as many partitions as the pairs need.
    """
    own = [c for c in polygons.columns if c != "polygon"]
    ring = F.flatten("polygon")
    boxes = polygons.where(F.size("polygon") > 0).select(*own, "polygon", geometry.bounds(ring).alias("its_box"))
    boxes = boxes.select(*own, "polygon", *(F.col(f"its_box.{k}").alias(k) for k in ("west", "south", "east", "north")))
    places = points.select("lng", "lat").distinct()
    met, pairs = met_in_tiles(places, boxes)
    found = met.where(geometry.inside(F.col("lng"), F.col("lat"), F.col("polygon"))).select("lng", "lat", *own)
    n = parts(pairs / PAIRS * points.count() / max(1, places.count()))
    return points.repartition(n, "lng", "lat").join(found.repartition(n, "lng", "lat"), ["lng", "lat"]).select(*points.columns, *own)


def runs(polygons: DataFrame) -> DataFrame:
    """id, y, x0, x1 (both ends included): the cells (x, y) inside each polygon (id, polygon in cell units), as runs along rows.

    Each edge gives its crossing of every row it passes, half-open so that a vertex counts once; a row's sorted
    crossings pair up into runs. Work follows the outline's height and not the area, and no cell is tested against an edge.
    """
    edges = polygons.select("id", F.explode("polygon").alias("ring")).select("id", F.explode(geometry.sides(F.col("ring"))).alias("s"))
    ax, ay, bx, by = (F.col(f"s.{p}.{k}").cast("double") for p in "ab" for k in ("lng", "lat"))
    low, high = F.least(ay, by), F.greatest(ay, by)
    first, last = F.ceil(low), F.ceil(high) - 1  # rows y with low <= y < high: one end is above y and the other isn't
    rows = edges.where(first <= last).select("id", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by_"), F.explode(F.sequence(first, last)).alias("y"))
    at = F.col("ax") + (F.col("y") - F.col("ay")) / (F.col("by_") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    crossings = rows.select("id", "y", at.alias("at"))
    w = Window.partitionBy("id", "y").orderBy("at")
    pairs = crossings.withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("at").over(w)).where("n % 2 = 1")
    out = pairs.select("id", F.col("y").cast("int").alias("y"), F.ceil("at").cast("int").alias("x0"), (F.ceil("next") - 1).cast("int").alias("x1"))
    return out.where("x0 <= x1")


def fill(polygons: DataFrame) -> DataFrame:
    """id, x, y of the cells inside each polygon, each once."""
    return runs(polygons).select("id", F.explode(F.sequence("x0", "x1")).alias("x"), "y").distinct()


def masked(cells: DataFrame, polygons: DataFrame) -> DataFrame:
    """cells (x, y, ...) with id of each polygon that holds them: runs, opened, in an equi-join."""
    return cells.join(fill(polygons), ["x", "y"])


def outline(mask: DataFrame) -> DataFrame:
    """mask (id, x, y: cells set) with edge: whether one of the four neighbours isn't set."""
    sent = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))))
    met = mask.select("id", "x", "y", F.explode(sent).alias("o")).groupBy("id", (F.col("x") + F.col("o.dx")).cast("int").alias("x"), (F.col("y") + F.col("o.dy")).cast("int").alias("y"))
    counted = met.agg(F.max(((F.col("o.dx") == 0) & (F.col("o.dy") == 0)).cast("int")).alias("own"), F.count("*").alias("n"))
    return counted.where("own = 1").select("id", "x", "y", (F.col("n") < 5).alias("edge"))
