"""Heights between cells: lattices of places, and bilinear samples that know voids, by one equi-join on cells.

A point asks for the four cells around it; the cells answer, and the weights of those that are known are
brought back to one. The cell that holds the point must itself be known, so that a shore doesn't creep into a void.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heathgrid.functions import georef, tiles
from heathgrid.functions.num import known, worked_out
from heathgrid.operators import spatial


def lattice(spark: SparkSession, width: int, height: int, lng: Column, lat: Column) -> DataFrame:
    """id, i, j, lng, lat of width x height points; lng and lat are expressions of columns i (column) and j (row)."""
    rows = spark.range(width * height).select("id", (F.col("id") % width).cast("int").alias("i"), F.floor(F.col("id") / width).cast("int").alias("j"))
    return rows.withColumns({"lng": lng, "lat": lat})


def box_lattice(spark: SparkSession, west: float, south: float, east: float, north: float, width: int, height: int) -> DataFrame:
    """Centres of the cells that a box is cut into."""
    return lattice(spark, width, height, F.lit(float(west)) + (F.col("i") + 0.5) * ((east - west) / width), F.lit(float(north)) - (F.col("j") + 0.5) * ((north - south) / height))


def tile_lattice(spark: SparkSession, zoom: int, tx: int, ty: int, size: int = 256) -> DataFrame:
    """Pixel centres of a map tile."""
    z = F.lit(zoom)
    return lattice(spark, size, size, tiles.lng_of((F.col("i") + 0.5) / size + tx, z), tiles.lat_of((F.col("j") + 0.5) / size + ty, z))


def corners(px: Column, py: Column) -> Column:
    """Array of structs x, y, w, own: the four cells around a point, and whether each holds it."""
    x0, y0 = F.floor(px - 0.5), F.floor(py - 0.5)
    wx, wy = px - 0.5 - x0, py - 0.5 - y0
    one = lambda x, y, w: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), w.alias("w"), ((x == F.floor(px)) & (y == F.floor(py))).alias("own"))
    return F.array(one(x0, y0, (1 - wx) * (1 - wy)), one(x0 + 1, y0, wx * (1 - wy)), one(x0, y0 + 1, (1 - wx) * wy), one(x0 + 1, y0 + 1, wx * wy))


def bilinear(points: DataFrame, cells: DataFrame, strict: bool = False) -> DataFrame:
    """points (id, grid_id, px, py, ...) with z. strict: unknown unless all four cells that count are known.

    Fractions count from a cell's north-west corner. Points off the raster are unknown; ids must tell points apart.
    """
    asked = points.select("id", "grid_id", F.explode(corners(F.col("px"), F.col("py"))).alias("c")).select("id", "grid_id", "c.*")
    met = asked.join(cells.select("grid_id", "x", "y", known(F.col("z")).alias("z")), ["grid_id", "x", "y"])
    total, weight = F.sum(F.col("z") * F.col("w")), F.sum(F.when(F.col("z").isNotNull(), F.col("w")))
    fine = F.bool_or(F.col("own") & F.col("z").isNotNull()) & (weight > 0)
    fine = fine & (weight > 1 - 1e-9) if strict else fine
    found = met.groupBy("id").agg(F.when(fine, total / weight).alias("z"))
    return points.drop("z").join(found, "id", "left")


def placed_on(points: DataFrame, rasters: DataFrame) -> DataFrame:
    """points (id, lng, lat, ...) with grid_id, px, py on the first raster, by name, whose box holds them; NULL where none does.

    rasters: grid_id, width, height, g. Points and rasters meet by the map tiles that cover a raster's box.
    """
    b = georef.box_of(F.lit(0), F.lit(0), F.col("width"), F.col("height"), F.col("g"))
    boxes = worked_out(rasters.select("grid_id", "width", "height", "g"), "its_box", b).select("grid_id", "width", "height", "g", "its_box.*")
    met = spatial.in_boxes(points.select("id", "lng", "lat"), boxes)
    met = worked_out(met, "p", georef.pixel_of(F.col("lng"), F.col("lat"), F.col("g"))).where((F.col("p.px") >= 0) & (F.col("p.py") >= 0) & (F.col("p.px") < F.col("width")) & (F.col("p.py") < F.col("height")))
    first = met.groupBy("id").agg(F.min(F.struct("grid_id", "p")).alias("f")).select("id", F.col("f.grid_id").alias("grid_id"), F.col("f.p.px").alias("px"), F.col("f.p.py").alias("py"))
    return points.join(first, "id", "left")


def warp(points: DataFrame, rasters: DataFrame, cells: DataFrame) -> DataFrame:
    """points (id, lng, lat, ...) with grid_id and z: a raster, or the first of several, sampled on a lattice."""
    return bilinear(placed_on(points, rasters), cells).drop("px", "py")


def coverage(sampled: DataFrame) -> Column:
    """Share of a lattice's points with a height, as an aggregate over its rows."""
    return F.coalesce(F.count("z") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))


def at_cells(points: DataFrame, cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """points (id, grid_id, x, y whole numbers) with z of the cell there; beyond the edge, of the nearest one on it.

    bounds: grid_id, x0, x1, y0, y1, a row a grid.
    """
    held = points.join(bounds, "grid_id").select(*points.columns, F.greatest("x0", F.least("x1", F.col("x"))).alias("its_x"), F.greatest("y0", F.least("y1", F.col("y"))).alias("its_y"))
    there = cells.select("grid_id", F.col("x").alias("its_x"), F.col("y").alias("its_y"), known(F.col("z")).alias("z"))
    return held.join(there, ["grid_id", "its_x", "its_y"], "left").select(*points.columns, "z")
