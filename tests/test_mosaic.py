import numpy as np
import pytest
from pyspark.sql import functions as F
from test_surface import CELL

from heathgrid.operators import mosaic, rays, surface


def rough(spark, n=150, holes=40):
    rows = []
    gone = {((7 * k) % n, (13 * k) % n) for k in range(holes)}
    for y in range(-10, n - 10):
        for x in range(-3, n - 3):
            z = 500 + 40 * np.sin(0.31 * x) * np.cos(0.17 * y) + 12 * np.sin(0.07 * x + 0.11 * y)
            rows.append(("g", x, y, None if (x, y) in gone else float(z)))
    return spark.createDataFrame(rows, "grid_id string, x int, y int, z double")


def dense(rows, name, x0=-3, y0=-10, n=150):
    out = np.full((n, n), np.nan)
    for r in rows:
        if 0 <= r.x - x0 < n and 0 <= r.y - y0 < n and r[name] is not None:
            out[r.y - y0, r.x - x0] = r[name]
    return out


def whole(spark, cells):
    return dense(cells.collect(), "z")


@pytest.mark.parametrize(("size", "halo"), [(64, 24), (24, 24), (50, 24)])
def test_rays_of_a_dealt_raster_are_those_of_the_whole(spark, size, halo):
    cells = rough(spark)
    z = whole(spark, cells)
    found = mosaic.over_tiles(cells, {"v": (rays.sky_view, "double", CELL), "s": (rays.shelter, "double", CELL, 300.0), "d": (rays.shadow, "int", CELL, 140.0, 20.0, halo)}, halo, size).collect()
    for name, want in (("v", rays.sky_view(z, CELL)), ("s", rays.shelter(z, CELL, 300.0)), ("d", rays.shadow(z, CELL, 140.0, 20.0, halo))):
        got = dense(found, name)
        assert (np.isnan(got) == np.isnan(want)).all() and np.nanmax(np.abs(got - want)) < 1e-12, name


def test_windows_of_a_dealt_raster_are_those_of_the_whole(spark):
    cells = rough(spark, 90)
    rows = lambda df: {(r.x, r.y): (r.dzdx, r.dzdy, r.t) for r in df.where("z is not null").collect()}
    want = rows(surface.tpi(surface.surface(cells, CELL), 3, "t"))
    ringed = mosaic.cells_of(mosaic.haloed(mosaic.deal(cells, 32), 4, 32), 4, 32).withColumn("grid_id", F.concat_ws("/", "grid_id", "tx", "ty"))
    tiled = surface.tpi(surface.surface(ringed, CELL), 3, "t")
    own = tiled.where("floor(x / 32) = tx and floor(y / 32) = ty")
    got = rows(own)
    assert got.keys() == want.keys() and own.select("grid_id").distinct().count() == 16
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for k in want for a, b in zip(got[k], want[k], strict=True))


def test_strips_are_no_more_than_the_halo(spark):
    tiles = mosaic.deal(rough(spark, 96, 0), 32)
    sizes = {(r.dx, r.dy): r.n for r in mosaic.strips(tiles, 5, 32).groupBy("dx", "dy").agg(F.max(F.size("part")).alias("n")).collect()}
    assert sizes == {(dx, dy): (32 if dx == 0 else 5) * (32 if dy == 0 else 5) for dx in (-1, 0, 1) for dy in (-1, 0, 1)}
    with pytest.raises(mosaic.InsufficientHalo):
        mosaic.strips(tiles, 33, 32)


def test_tiles_side_by_side(spark):
    cells = spark.createDataFrame([("g", x, y, float(100 * y + x)) for x in range(8) for y in range(4)], "grid_id string, x int, y int, z double")
    rows = {(r.tx, r.ty): np.array([np.nan if v is None else v for v in r.z]).reshape(6, 6) for r in mosaic.haloed(mosaic.deal(cells, 4), 1, 4).collect()}
    assert rows.keys() == {(0, 0), (1, 0)}
    left = rows[0, 0]
    assert np.isnan(left[0]).all() and np.isnan(left[-1]).all() and np.isnan(left[:, 0]).all()
    assert left[1:5, 5].tolist() == [4, 104, 204, 304] and left[1:5, 1:5].tolist() == [[100 * y + x for x in range(4)] for y in range(4)]


def test_filled_like_the_window_passes(spark):
    cells = rough(spark, 60, 60).withColumn("z", F.when(~(F.col("x").between(20, 28) & F.col("y").between(20, 28)), F.col("z")))
    want = {(r.x, r.y): r.z for r in surface.fill_voids(cells).collect()}
    got = {(r.x, r.y): r.f for r in mosaic.over_tiles(cells, {"f": (mosaic.filled, "double")}, 8, 16).collect() if (r.x, r.y) in want}
    assert got.keys() == want.keys() and all((want[k] is None) == (got[k] is None) and (want[k] is None or abs(want[k] - got[k]) < 1e-9) for k in want)


def test_repeats_gaps_and_nothing(spark):
    kind = "grid_id string, x int, y int, z double"
    cells = spark.createDataFrame([("g", 0, 0, 1.0), ("g", 0, 0, 1.0), ("g", 130, 0, float("nan")), ("h", -1, -1, 2.0)], kind)
    rows = mosaic.over_tiles(cells, {"f": (lambda z: z * 2, "double")}, 2, 8)
    assert {(r.grid_id, r.x, r.y, r.f) for r in rows.where("z is not null").collect()} == {("g", 0, 0, 2.0), ("h", -1, -1, 4.0)}
    assert mosaic.over_tiles(cells.where("false"), {"f": (lambda z: z, "double")}, 2, 8).count() == 0


def test_mosaic_of_a_box(spark):
    """Tiles of 4 x 4 whose heights are their world pixels; one is missing."""
    zoom, size = 5, 4
    rows = [(tx, ty, [float(1000 * (ty * size + j) + tx * size + i) for j in range(size) for i in range(size)]) for tx in range(10, 18) for ty in range(8, 16) if (tx, ty) != (13, 11)]
    tiles = spark.createDataFrame(rows, "tx int, ty int, z array<double>")
    boxes = spark.createDataFrame([(1, -50.0, 40.0, -25.0, 55.0)], "id int, west double, south double, east double, north double")
    got = mosaic.over_boxes(boxes, tiles, zoom, 3, size).collect()
    from heathgrid.functions import tiles as T

    r = boxes.select(T.tile_ranges(*(F.col(c) for c in ("west", "south", "east", "north")), F.lit(zoom)).alias("r")).first().r
    w, h = (r.x1 - r.x0 + 1) * size, (r.y1 - r.y0 + 1) * size
    assert len(got) == (w + 6) * (h + 6) and sum(x.inside for x in got) == w * h
    for x in got:
        gx, gy = r.x0 * size + x.x, r.y0 * size + x.y
        there = (gx // size, gy // size) in {(a, b) for a, b, _ in rows}
        assert x.z == (1000 * gy + gx if there else None)
    place = spark.range(1).select(mosaic.place_of_pixel(F.lit(7.0), F.lit(5.0), F.lit(zoom), F.lit(r.x0), F.lit(r.y0), size).alias("p")).select(mosaic.pixel_in_mosaic(F.col("p.lng"), F.col("p.lat"), F.lit(zoom), F.lit(r.x0), F.lit(r.y0), size).alias("q")).first().q
    assert (place.x, place.y) == (7, 5)
