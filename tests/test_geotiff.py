import numpy as np
import pytest
from pyspark.sql import functions as F

from heathgrid.functions import georef
from heathgrid.functions import tiles as T
from heathgrid.operators import sampling
from heathgrid.sources import geotiff, tiff

GEO = {georef.MODEL: georef.GEOGRAPHIC, georef.RASTER: georef.PIXEL_IS_AREA, georef.GEOGRAPHIC_CRS: 4326}
UTM = {georef.MODEL: georef.PROJECTED, georef.RASTER: georef.PIXEL_IS_AREA, georef.PROJECTED_CRS: 26916}


def write(folder, name, z, keys=GEO, scale=(0.001, 0.001, 0.0), tie=(0.0, 0.0, 0.0, -84.0, 40.0, 0.0), **more):
    path = folder / name
    path.write_bytes(tiff.write(z, 16, "<f8", no_data=-1.0, scale=scale, tiepoint=tie, geo_keys=keys, **more))
    return str(path)


def heights(h, w):
    z = np.arange(h * w, dtype=float).reshape(h, w)
    z[3, 5] = -1.0
    return z


def test_a_box_reads_its_tiles_alone(spark, tmp_path):
    z = heights(128, 128)
    write(tmp_path, "a.tif", z)
    index = geotiff.index(geotiff.files(spark, str(tmp_path)))
    assert index.count() == 64
    # pixels 20 to 45 by 20 to 45 touch tiles 1 and 2 of rows 1 and 2
    some = geotiff.within(index, -84 + 0.0205, 40 - 0.0445, -84 + 0.0445, 40 - 0.0205)
    assert {r.tile for r in some.collect()} == {9, 10, 17, 18}
    cells = geotiff.placed(geotiff.cells(geotiff.read(some))).collect()
    assert len(cells) == 4 * 256 and all(r.z == z[r.y, r.x] for r in cells)
    assert all(abs(r.lng - (-84 + (r.x + 0.5) * 0.001)) < 1e-9 and abs(r.lat - (40 - (r.y + 0.5) * 0.001)) < 1e-9 for r in cells)
    whole = {(r.x, r.y): r.z for r in geotiff.cells(geotiff.read(index)).collect()}
    assert len(whole) == 128 * 128 and whole[5, 3] is None


def test_only_the_bytes_asked_for(tmp_path):
    path = write(tmp_path, "a.tif", np.zeros((256, 256)))
    source = geotiff.Ranges(path)
    found = geotiff.header(source, probe=64)
    assert source.asked[0] == (0, 64) and sum(n for _, n in source.asked) < 9000 < source.file.size() / 50
    assert all(source.asked[k][0] == sum(n for _, n in source.asked[:k]) for k in range(len(source.asked)))  # each byte once
    assert found[0].width == 256 and len(found[0].offsets) == 256


def test_levels_and_sparse_tiles(spark, tmp_path):
    z = heights(64, 96)
    path = write(tmp_path, "a.tif", z, overviews=[z[::2, ::2], z[::4, ::4]])
    res = [georef.metres(g) for g in geotiff.placements(geotiff.header(geotiff.Ranges(path)))[1]]
    assert [round(r / res[0], 9) for r in res] == [1, 2, 4]
    assert [geotiff.level_for(res, w) for w in (None, 1.0, 100.0, 150.0, 300.0, 1e6)] == [0, 0, 0, 1, 2, 2]
    coarse = geotiff.index(geotiff.files(spark, str(tmp_path)), wanted=160.0)
    cells = geotiff.cells(geotiff.read(coarse)).collect()
    assert {r.level for r in cells} == {1} and all(r.z == (None if z[2 * r.y, 2 * r.x] == -1 else z[2 * r.y, 2 * r.x]) for r in cells)
    assert geotiff.index(geotiff.files(spark, str(tmp_path)), every_level=True).select("level").distinct().count() == 3
    gone = coarse.withColumn("length", F.lit(0).cast("long"))
    assert geotiff.cells(geotiff.read(gone)).where("z is not null").count() == 0
    assert geotiff.index(geotiff.files(spark, str(tmp_path)).where("false")).count() == 0


def test_utm_round_trip(spark, tmp_path):
    z = heights(64, 64)
    write(tmp_path, "u.tif", z, UTM, (10.0, 10.0, 0.0), (0.0, 0.0, 0.0, 700000.0, 4430000.0, 0.0))
    index = geotiff.index(geotiff.files(spark, str(tmp_path)))
    assert index.first().epsg == 26916 and index.first().g.zone == 16
    cells = geotiff.placed(geotiff.cells(geotiff.read(index)))
    back = cells.select("x", "y", georef.pixel_of(F.col("lng"), F.col("lat"), F.col("g")).alias("p")).collect()
    assert all(abs(r.p.px - r.x - 0.5) < 1e-4 and abs(r.p.py - r.y - 0.5) < 1e-4 for r in back)
    spot = cells.where("x = 20 and y = 30").first()
    near = geotiff.within(index, spot.lng - 1e-6, spot.lat - 1e-6, spot.lng + 1e-6, spot.lat + 1e-6)
    assert [r.tile for r in near.collect()] == [1 + 4 * 1]


@pytest.mark.parametrize("keys", [GEO | {georef.RASTER: 2}, {georef.MODEL: 3}, {}, UTM | {georef.PROJECTED_CRS: 32716}, UTM | {georef.PROJECTED_CRS: 26924}, {georef.MODEL: georef.PROJECTED}])
def test_places_that_are_refused(keys):
    with pytest.raises(georef.Unplaced):
        georef.crs(keys)


def test_no_place_at_all(tmp_path):
    path = write(tmp_path, "a.tif", np.zeros((16, 16)), scale=(), tie=())
    with pytest.raises(georef.Unplaced):
        geotiff.placements(geotiff.header(geotiff.Ranges(path)))


def bilinear(z, px, py):
    h, w = z.shape
    if not (0 <= px < w and 0 <= py < h) or np.isnan(z[int(py), int(px)]):
        return None
    x0, y0 = int(np.floor(px - 0.5)), int(np.floor(py - 0.5))
    fx, fy = px - 0.5 - x0, py - 0.5 - y0
    total = weight = 0.0
    for dx, dy, v in ((0, 0, (1 - fx) * (1 - fy)), (1, 0, fx * (1 - fy)), (0, 1, (1 - fx) * fy), (1, 1, fx * fy)):
        x, y = x0 + dx, y0 + dy
        if 0 <= x < w and 0 <= y < h and not np.isnan(z[y, x]):
            total, weight = total + v * z[y, x], weight + v
    return total / weight if weight else None


def test_bilinear_by_hand(spark):
    r = np.random.default_rng(4)
    z = r.normal(size=(12, 15))
    z[r.random(z.shape) < 0.2] = np.nan
    cells = spark.createDataFrame([("g", x, y, None if np.isnan(z[y, x]) else float(z[y, x])) for y in range(12) for x in range(15)], "grid_id string, x int, y int, z double")
    spots = [(k, "g", float(a), float(b)) for k, (a, b) in enumerate(zip(r.uniform(-1, 16, 400), r.uniform(-1, 13, 400), strict=True))] + [(1000, "g", 3.5, 4.5), (1001, "g", 0.0, 0.0), (1002, "h", 3.0, 3.0), (1003, "g", None, 1.0)]
    points = spark.createDataFrame(spots, "id long, grid_id string, px double, py double")
    got = {r.id: r.z for r in sampling.bilinear(points, cells).collect()}
    assert len(got) == len(spots)
    for k, g, px, py in spots:
        want = bilinear(z, px, py) if g == "g" and px is not None else None
        assert (got[k] is None) == (want is None) and (want is None or abs(got[k] - want) < 1e-9), (k, px, py)
    strict = {r.id: r.z for r in sampling.bilinear(points, cells, strict=True).collect()}
    assert sum(v is not None for v in strict.values()) < sum(v is not None for v in got.values())
    assert all(v is None or abs(v - got[k]) < 1e-12 for k, v in strict.items())


def test_cells_beyond_the_edge_are_those_on_it(spark):
    cells = spark.createDataFrame([("g", x, y, 10.0 * y + x) for x in range(3) for y in range(2)], "grid_id string, x int, y int, z double")
    points = spark.createDataFrame([(0, "g", -5, 0), (1, "g", 9, 9), (2, "g", 1, 1)], "id long, grid_id string, x int, y int")
    bounds = spark.createDataFrame([("g", 0, 2, 0, 1)], "grid_id string, x0 int, x1 int, y0 int, y1 int")
    assert {r.id: r.z for r in sampling.at_cells(points, cells, bounds).collect()} == {0: 0.0, 1: 12.0, 2: 11.0}


def test_a_map_tile_from_two_files(spark, tmp_path):
    """A plane over two files side by side is a plane on the tile; places off both are unknown."""
    plane = lambda lng, lat: 1000 * (lng + 84) + 500 * (lat - 40)
    for k in (0, 1):
        west = -84.0 + k * 0.064
        lng, lat = np.meshgrid(west + (np.arange(64) + 0.5) * 0.001, 40 - (np.arange(64) + 0.5) * 0.001)
        write(tmp_path, f"f{k}.tif", plane(lng, lat), tie=(0.0, 0.0, 0.0, west, 40.0, 0.0))
    index = geotiff.index(geotiff.files(spark, str(tmp_path)))
    x, y = spark.range(1).select(F.floor(T.tile_x(F.lit(-83.93), F.lit(11))), F.floor(T.tile_y(F.lit(39.97), F.lit(11)))).first()
    points = sampling.tile_lattice(spark, 11, x, y, 32)
    rasters = index.select(F.col("path").alias("grid_id"), "width", "height", "g").distinct()
    rows = sampling.warp(points, rasters, geotiff.cells(geotiff.read(index))).collect()
    assert len(rows) == 1024
    for r in rows:
        on = -84 <= r.lng < -83.872 and 39.936 < r.lat <= 40
        assert (r.z is not None) == on
        edge = min(abs(r.lng + v) for v in (84, 83.936, 83.872)) < 0.001 or min(abs(r.lat - v) for v in (40, 39.936)) < 0.001
        assert not on or edge or abs(r.z - plane(r.lng, r.lat)) < 1e-6
    assert len({r.grid_id for r in rows if r.grid_id}) == 2
