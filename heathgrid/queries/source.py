"""Queries on tiles, placed files, samples and spatial joins, each with the SQL that DuckDB answers it with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heathgrid.functions import geometry, georef, pixels, readout, solar
from heathgrid.functions.num import shown, worked_out
from heathgrid.operators import landform, mosaic, repair, sampling, spatial, surface
from heathgrid.queries import geo
from heathgrid.queries import raster as r
from heathgrid.shared import cut, remove_folder, shared_folder
from heathgrid.sources import geotiff, png

QUERIES, ORACLE = {}, {}
#: Place of the raster: its north-west corner, and degrees a cell.
WEST, NORTH, DEGREES = -84.0, 40.0, 0.001
ROWS = "(select max(event_id) // 100 from events)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _fill_sql(passes: int) -> str:
    """A pass of filling after another, as common table expressions."""
    out = []
    for k in range(passes):
        source = f"v{k}"
        out.append(
            f"h{k} as (select x, y, z, coalesce(sum(z) over w, 0) as s, count(z) over w as n from {source} window w as (partition by y order by x range between 1 preceding and 1 following)), "
            f"v{k + 1} as (select x, y, coalesce(z, case when sum(n) over w > 0 then sum(s) over w / sum(n) over w end) as z from h{k} window w as (partition by x order by y range between 1 preceding and 1 following))"
        )
    return ", ".join(out)


@query(f"with {r.VOIDS}, v0 as (select x, y, case when x between 30 and 41 and y between 2 and 7 then null else z end as z from e), {_fill_sql(mosaic.FILL_PASSES)} select x, y, round(z, 9) as z from v{mosaic.FILL_PASSES}")
def void_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passes of filling, over tiles with a halo as deep as there are passes."""
    cells = r.raster(spark, sf_dir, voids=True)
    cells = cells.withColumn("z", F.when(~(F.col("x").between(30, 41) & F.col("y").between(2, 7)), F.col("z")))
    met = mosaic.over_tiles(cells, {"filled": (mosaic.filled, "double")}, mosaic.FILL_PASSES)
    return cells.select("x", "y").join(met.select("x", "y", "filled"), ["x", "y"], "left").select("x", "y", F.round("filled", 9).alias("z"))


@query(f"with {r.SURFACE} select x, y, round(slope, 6) as slope, round(aspect, 6) as aspect from s where {r.INSIDE.format(m=1)}")
def mosaic_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope and aspect of a raster that was dealt in tiles with a halo of one cell."""
    ringed = mosaic.cells_of(mosaic.haloed(mosaic.deal(r.raster(spark, sf_dir)), 1), 1).withColumn("grid_id", F.concat_ws("/", "grid_id", "tx", "ty"))
    found = surface.surface(ringed, r.CELL)
    own = (F.floor(F.col("x") / mosaic.SIZE) == F.col("tx")) & (F.floor(F.col("y") / mosaic.SIZE) == F.col("ty"))
    e = r.bounds(spark, sf_dir).drop("grid_id")
    inner = found.where(own).join(F.broadcast(e)).where("x between x0 + 1 and x1 - 1 and y between y0 + 1 and y1 - 1")  # e is one row
    return inner.select("x", "y", F.round("slope", 6).alias("slope"), F.round("aspect", 6).alias("aspect"))


def as_files(spark: SparkSession, sf_dir: str, levels: int = 1) -> str:
    """The raster as placed files of 64 x 64 cells in the shared folder; the folder's name."""
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    geotiff.write_tiles(mosaic.deal(r.raster(spark, sf_dir)), folder, mosaic.SIZE, DEGREES, WEST, NORTH, levels=levels).count()
    return folder


BOX = (-83.971, 39.962, -83.934, 39.981)
LNG, LAT = f"({WEST}::double + (x + 0.5::double) * {DEGREES}::double)", f"({NORTH}::double - (y + 0.5::double) * {DEGREES}::double)"


@query(f"with {r.CELLS} select x, y, round({LNG}, 7) as lng, round({LAT}, 7) as lat, round(z, 6) as z from e where {LNG} between {BOX[0]} and {BOX[2]} and {LAT} between {BOX[1]} and {BOX[3]}")
def geotiff_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster written as placed files; of their tiles, those that touch a box are read."""
    folder = as_files(spark, sf_dir)
    try:
        tiles = geotiff.read(geotiff.within(geotiff.index(geotiff.files(spark, folder)), *BOX))
        cells = geotiff.placed(geotiff.cells(tiles)).where(F.col("lng").between(BOX[0], BOX[2]) & F.col("lat").between(BOX[1], BOX[3]) & F.col("z").isNotNull())
        x, y = (F.floor((F.col("lng") - WEST) / DEGREES).cast("int"), F.floor((NORTH - F.col("lat")) / DEGREES).cast("int"))
        return cut(cells.select(x.alias("x"), y.alias("y"), shown(F.col("lng"), 7).alias("lng"), shown(F.col("lat"), 7).alias("lat"), shown(F.col("z")).alias("z")))
    finally:
        remove_folder(folder)


WIDE = 80
_WARP = (
    f"l as (select i, j, {BOX[0]}::double + (i + 0.5::double) * {(BOX[2] - BOX[0]) / WIDE}::double as lng, {BOX[3]}::double - (j + 0.5::double) * {(BOX[3] - BOX[1]) / WIDE}::double as lat from range({WIDE}) a(i), range({WIDE}) b(j)), "
    f"p as (select *, (lng - {WEST}::double) / {DEGREES}::double as px, ({NORTH}::double - lat) / {DEGREES}::double as py from l), "
    "c as (select p.*, floor(px - 0.5::double)::int + dx as x, floor(py - 0.5::double)::int + dy as y, case when dx = 1 then px - 0.5::double - floor(px - 0.5::double) else 1 - (px - 0.5::double - floor(px - 0.5::double)) end * case when dy = 1 then py - 0.5::double - floor(py - 0.5::double) else 1 - (py - 0.5::double - floor(py - 0.5::double)) end as w from p, (values (0, 0), (1, 0), (0, 1), (1, 1)) o(dx, dy)), "
    "m as (select c.*, z from c left join e using (x, y)), "
    "s as (select i, j, case when bool_or(x = floor(px) and y = floor(py) and z is not null) then sum(z * w) / sum(case when z is not null then w end) end as z from m group by i, j)"
)


@query(f"with {r.VOIDS}, {_WARP} select i, j, round(z, 5) as z, round((select count(z)::double / count(*) from s), 6) as coverage from s")
def geotiff_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lattice over a box, sampled from the raster with voids; each point with the share of the lattice that has a height."""
    cells = r.raster(spark, sf_dir, voids=True)
    e = r.bounds(spark, sf_dir)
    g = F.struct(*(F.lit(float(v)).alias(k) for k, v in (("sx", DEGREES), ("sy", DEGREES), ("i", 0), ("j", 0), ("x", WEST), ("y", NORTH))), F.lit(None).cast("int").alias("zone"))
    rasters = e.select("grid_id", (F.col("x1") + 1).alias("width"), (F.col("y1") + 1).alias("height"), g.alias("g"))
    found = cut(sampling.warp(sampling.box_lattice(spark, *BOX, WIDE, WIDE), rasters, cells))
    share = found.agg(F.round(sampling.coverage(found), 6).alias("coverage"))
    return found.join(F.broadcast(share)).select("i", "j", F.round("z", 5).alias("z"), "coverage")  # share is one row


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and polygon: a diamond around each supplier's place, with a square hole; sizes differ a hundredfold."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    x, y, d = (k * 6151 % 34000) / 100.0 - 170, (k * 98317 % 13000) / 100.0 - 65, (k % 10 + 1) * (k % 10 + 1) / 20.0
    p = geometry.point
    ring = F.array(p(x - d, y), p(x, y - d), p(x + d, y), p(x, y + d), p(x - d, y))
    hole = F.array(p(x - d / 4, y - d / 4), p(x + d / 4, y - d / 4), p(x + d / 4, y + d / 4), p(x - d / 4, y + d / 4))
    return s.select(k.alias("area"), F.array(ring, hole).alias("polygon"))


_AREAS = (
    "a as (select s_suppkey as area, (s_suppkey * 6151 % 34000) / 100.0::double - 170 as cx, (s_suppkey * 98317 % 13000) / 100.0::double - 65 as cy, (s_suppkey % 10 + 1) * (s_suppkey % 10 + 1) / 20.0::double as d from supplier), "
    "g as (select area, cx - d as ax, cy as ay, cx as bx, cy - d as b_y from a union all select area, cx, cy - d, cx + d, cy from a union all select area, cx + d, cy, cx, cy + d from a union all select area, cx, cy + d, cx - d, cy from a "
    "union all select area, cx - d / 4, cy - d / 4, cx + d / 4, cy - d / 4 from a union all select area, cx + d / 4, cy - d / 4, cx + d / 4, cy + d / 4 from a union all select area, cx + d / 4, cy + d / 4, cx - d / 4, cy + d / 4 from a union all select area, cx - d / 4, cy + d / 4, cx - d / 4, cy - d / 4 from a)"
)


@query(f"with {geo.PLACES}, {_AREAS} select id, area from p, g where (ay > lat) <> (b_y > lat) and lng < ax + (lat - ay) / (b_y - ay) * (bx - ax) group by id, area having count(*) % 2 = 1")
def points_in_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which places lie in which areas."""
    return spatial.in_polygons(geo.places(spark, sf_dir), areas(spark, sf_dir)).select("id", "area")


@query(f"with {r.CELLS}, g(ax, ay, bx, b_y) as (values {geo._EDGES}), m as (select x, y, count(*) filter ((ay > y) <> (b_y > y) and x < ax + (y - ay) / (b_y - ay) * (bx - ax)) % 2 = 1 as i from e cross join g group by x, y), s as (select * from m where i) select s.x, s.y, count(t.x) < 4 as edge from s left join s t on abs(s.x - t.x) + abs(s.y - t.y) = 1 group by s.x, s.y")
def scanline_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells inside a polygon by runs along rows, and those of its outline."""
    shape = spark.range(1).select("id", geo.polygon().alias("polygon"))
    mask = spatial.masked(r.raster(spark, sf_dir).select("x", "y"), shape)
    return spatial.outline(mask).select("x", "y", "edge")


SPOTS = f"spot as (select event_id as id, {WEST}::double + ((event_id * 7919 % 10500) / 100.0::double + 0.005::double) * {DEGREES}::double as lng, {NORTH}::double - ((event_id * 104729 % 10500) / 100.0::double + 0.005::double) * {DEGREES}::double as lat from events)"


@query(
    f"with {r.WEISS}, {r.CURVED}, {SPOTS}, d as (select w.x, w.y, w.z, w.slope, w.aspect, weiss, ({r.WOOD_CASE})::int as wood from weiss w join c using (x, y)), "
    f"t as (select id, floor((lng - {WEST}::double) / {DEGREES}::double)::int as x, floor(({NORTH}::double - lat) / {DEGREES}::double)::int as y from spot) "
    "select id, case when d.x is null then 'no_data' else 'ok' end as outcome, floor(z * 3.28084::double + 0.5)::bigint as elevation_ft, floor(slope + 0.5)::bigint as slope_deg, case when d.x is not null then case when slope is null then 'unmeasured' when aspect < 0 then 'flat' else 'value' end end as aspect_kind, "
    "case when slope is not null and aspect >= 0 then floor(aspect + 0.5)::bigint end as aspect_deg, case when weiss > 0 then weiss_names.label end as landform, case when wood < 6 then wood_names.label end as morphometry from t left join d using (x, y) "
    f"left join (values {', '.join(f'({i}, {chr(39)}{n}{chr(39)})' for i, n in enumerate(landform.WEISS))}) weiss_names(k, label) on weiss_names.k = weiss left join (values {', '.join(f'({i}, {chr(39)}{n}{chr(39)})' for i, n in enumerate(landform.WOOD))}) wood_names(k, label) on wood_names.k = wood"
)
def point_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on and off the raster with what their cells say."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = lambda k: (F.col("event_id") * k % 10500) / 100.0 + 0.005
    g = F.struct(*(F.lit(float(v)).alias(k) for k, v in (("sx", DEGREES), ("sy", DEGREES), ("i", 0), ("j", 0), ("x", WEST), ("y", NORTH))), F.lit(None).cast("int").alias("zone"))
    spots = e.select(F.col("event_id").alias("id"), (at(7919) * DEGREES + WEST).alias("lng"), (F.lit(NORTH) - at(104729) * DEGREES).alias("lat"))
    p = worked_out(spots, "p", georef.pixel_of(F.col("lng"), F.col("lat"), g)).select("id", F.floor("p.px").cast("int").alias("x"), F.floor("p.py").cast("int").alias("y"))
    cells = surface.curvature(r.classed(spark, sf_dir), r.CELL)
    cells = cells.withColumn("wood", landform.wood(F.col("slope"), F.col("cross_sectional"), F.col("max_curvature"), F.col("min_curvature"), landform.curvature_tolerance(r.CELL)))
    told = readout.facts(F.col("z"), F.col("slope"), F.col("aspect"), F.col("weiss"), F.col("wood"), F.lit(0))
    f = readout.read_points(p, cells, told)
    return f.select(
        "id", "outcome", F.col("readout.elevation_ft.value").alias("elevation_ft"), F.col("readout.slope_deg.value").alias("slope_deg"), F.col("readout.aspect.kind").alias("aspect_kind"), F.col("readout.aspect.value.deg").alias("aspect_deg"),
        F.col("readout.landform.value").alias("landform"), F.col("readout.morphometry.value").alias("morphometry"),
    )


_HILL = r._hill(315)


@query(f"with {r.SURFACE}, h as (select x, y, {_HILL} as v, dx from s) select x, y, case when dx is null then 0 else floor(v * 255 + 0.5)::int end as grey, case when dx is null then 0 else 204 end as alpha from h")
def hillshade_rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey of the hillshade at four fifths opacity."""
    cells = r.surfaced(spark, sf_dir).withColumn("c", pixels.shade(solar.hillshade(F.col("dzdx"), F.col("dzdy")), 0.8))
    return cells.select("x", "y", F.col("c.r").alias("grey"), F.col("c.a").alias("alpha"))


@query(ORACLE["hillshade_rgba"])
def hillshade_png_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hillshade as PNG images of 64 cells a side, read back to pixels within the raster."""
    cells = r.surfaced(spark, sf_dir).withColumn("c", pixels.shade(solar.hillshade(F.col("dzdx"), F.col("dzdy")), 0.8))
    read = png.pixels(png.tiles(cells.select("grid_id", "x", "y", "c.*"), 64), 64)
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return read.join(r.bounds(spark, sf_dir), "grid_id").where(inside).select("x", "y", F.col("r").alias("grey"), F.col("a").alias("alpha"))


@query(
    f"with {r.SURFACE}, m as (select x, y, coalesce(slope between 12 and 40, false) as i from s), k as (select m.*, i and (select count(*) from m n where n.i and abs(n.x - m.x) + abs(n.y - m.y) = 1 and n.x between m.x - 1 and m.x + 1) < 4 as edge from m) "
    "select x, y, case when not i then 0 when edge then 255 else 200 end as r, case when not i then 0 when edge then 170 else 100 end as g, case when not i then 0 when edge then 120 else 50 end as b, case when not i then 0 when edge then 255 else 153 end as a from k"
)
def mask_rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slope filter's cells in its colour, with their outline."""
    cells = r.surfaced(spark, sf_dir).select("x", "y", F.col("slope").between(12, 40).alias("i"))
    edges = spatial.outline(cells.where("i").select(F.lit(0).alias("id"), "x", "y")).select("x", "y", "edge")
    c = pixels.mask(F.col("i"), F.lit("#c86432"), F.lit(0.6), F.coalesce("edge", F.lit(False)))
    return cells.join(edges, ["x", "y"], "left").select("x", "y", c.alias("c")).select("x", "y", "c.*")


@query("with a as (select s_suppkey as id, (s_suppkey % 9 + 1) / 4.0::double as d from supplier) select id, case when id % 3 = 0 then 1 else 2 end as n_polygons, case when id % 3 = 2 then 1 else 0 end as n_holes, round(case id % 3 when 0 then 4 * d * d when 1 then 2 * d * d else 5 * d * d end, 6) as area from a")
def rings_made_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares, bow ties, and squares with a hole beside a square that touches a corner; the planar area of what they are made into."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k, d = F.col("s_suppkey"), (F.col("s_suppkey") % 9 + 1) / 4.0
    x, y = (k * 6151 % 34000) / 100.0 - 170, (k * 98317 % 13000) / 100.0 - 65
    ring = lambda *at: F.array(*(geometry.point(x + d * a, y + d * b) for a, b in at))
    square, tie = ring((0, 0), (2, 0), (2, 2), (0, 2)), ring((0, 0), (2, 2), (2, 0), (0, 2))
    odd = F.array(ring((0, 0), (2, 0), (2, 2), (0, 2)), ring((0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)), ring((2, 2), (4, 2), (4, 3), (2, 3)))
    rows = s.select(k.alias("id"), F.when(k % 3 == 0, F.array(square)).when(k % 3 == 1, F.array(tie)).otherwise(odd).alias("polygon"))
    out = repair.repaired(rows)
    turned = lambda r, i: r[i]["lng"] * r[(i + 1) % F.size(r)]["lat"] - r[(i + 1) % F.size(r)]["lng"] * r[i]["lat"]
    planar = lambda r: F.abs(F.aggregate(F.sequence(F.lit(0), F.size(r) - 1), F.lit(0.0), lambda s, i: s + turned(r, i)) / 2)
    ground = F.aggregate("polygons", F.lit(0.0), lambda s, p: s + planar(p[0]) - F.aggregate(F.slice(p, 2, F.size(p)), F.lit(0.0), lambda t, r: t + planar(r)))
    holes = F.aggregate("polygons", F.lit(0), lambda n, p: n + F.size(p) - 1)
    return out.select("id", F.size("polygons").alias("n_polygons"), holes.alias("n_holes"), F.round(ground, 6).alias("area"))
