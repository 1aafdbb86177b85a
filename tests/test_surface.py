"""Closed-form surfaces: heights whose derivatives are known."""

import math

import pytest
from pyspark.sql import functions as F

from heathgrid.functions import solar, wind
from heathgrid.operators import landform, mosaic, rays, surface

CELL = 10.0


def grid(spark, z, size=33, void=None):
    """Cells of a function of metres east and north of the centre."""
    mid = (size - 1) / 2
    rows = [("g", x, y, None if void and void(x, y) else float(z((x - mid) * CELL, (mid - y) * CELL))) for y in range(size) for x in range(size)]
    return spark.createDataFrame(rows, "grid_id string, x int, y int, z double")


def inner(df, margin, size=33):
    return df.where(f"x >= {margin} and y >= {margin} and x < {size - margin} and y < {size - margin}")


@pytest.mark.parametrize("east,north,want", [(0, -1, 0), (-1, -1, 45), (-1, 0, 90), (-1, 1, 135), (0, 1, 180), (1, 1, 225), (1, 0, 270), (1, -1, 315)])
def test_a_plane_falls_along_its_aspect(spark, east, north, want):
    g = 0.3 / math.hypot(east, north)
    rows = inner(surface.surface(grid(spark, lambda x, y: g * (east * x + north * y) + 500, 7), CELL), 1, 7).select("slope", "aspect").distinct().collect()
    assert all(abs(r.slope - math.degrees(math.atan(0.3))) < 1e-6 and abs(r.aspect - want) < 1e-6 for r in rows)


def test_flat_and_void_ground(spark):
    cells = surface.surface(grid(spark, lambda x, y: 500, 9, lambda x, y: (x, y) == (4, 4)), CELL)
    found = {(r.x, r.y): (r.slope, r.aspect) for r in inner(cells, 1, 9).collect()}
    assert found[2, 2] == (0.0, -1.0)
    assert all(found[x, y] == (None, -1.0) for x in (3, 4, 5) for y in (3, 4, 5))


def test_ruggedness_of_a_plane(spark):
    rows = inner(surface.ruggedness(grid(spark, lambda x, y: 0.2 * x + 500, 7)), 1, 7).select("ruggedness").collect()
    assert all(abs(r.ruggedness - 0.2 * CELL * math.sqrt(6)) < 1e-9 for r in rows)


def test_vector_ruggedness_is_none_on_a_plane_and_on_a_roof_known(spark):
    flat = inner(surface.vector_ruggedness(surface.surface(grid(spark, lambda x, y: 0.4 * x - 0.1 * y + 500, 17), CELL)), 5, 17)
    assert flat.agg(F.max("vrm")).first()[0] < 1e-9


def test_position_is_none_on_a_plane_and_abstains_beside_a_void(spark):
    plane = lambda x, y: math.tan(math.radians(15)) * x + 500
    assert abs(inner(surface.tpi(grid(spark, plane), 3), 3).agg(F.max(F.abs("tpi"))).first()[0]) < 1e-9
    cut = inner(surface.tpi(grid(spark, plane, void=lambda x, y: x > 20), 3), 3).where("x = 20").select("tpi").distinct().collect()
    assert [r.tpi for r in cut] == [None]


def test_standardize(spark):
    flat = surface.standardized(grid(spark, lambda x, y: 500, 5, lambda x, y: x == 0), "z", "s").select("x", "s").collect()
    assert all((r.s is None) == (r.x == 0) and r.s in (None, 0.0) for r in flat)
    void = surface.standardized(grid(spark, lambda x, y: 500, 5, lambda x, y: True), "z", "s").select("s").distinct().collect()
    assert [r.s for r in void] == [0.0]


@pytest.mark.parametrize("z,want", [(lambda x, y: -0.001 * (x * x + y * y), 5), (lambda x, y: 0.001 * (x * x + y * y), 1), (lambda x, y: 0.001 * (x * x - y * y), 3), (lambda x, y: -0.001 * x * x, 4), (lambda x, y: 0.001 * x * x, 2), (lambda x, y: 0.0, 0)])
def test_wood_features_at_the_centre(spark, z, want):
    cells = surface.curvature(surface.surface(grid(spark, lambda x, y: z(x, y) + 500, 9), CELL), CELL)
    code = landform.wood(F.col("slope"), F.col("cross_sectional"), F.col("max_curvature"), F.col("min_curvature"), 0.0005)
    assert cells.where("x = 4 and y = 4").select(code.alias("c")).first().c == want


def test_weiss_table(spark):
    rows = [(s, p, 10.0 if k else 2.0) for s in (-2.0, 0.0, 2.0) for p in (-2.0, 0.0, 2.0) for k in (0, 1)]
    found = {(r.s, r.l, r.p): r.c for r in spark.createDataFrame(rows, "s double, l double, p double").withColumn("c", landform.weiss(F.col("s"), F.col("l"), F.col("p"))).collect()}
    assert [found[s, p, 2.0] for s in (-2.0, 0.0, 2.0) for p in (-2.0, 0.0, 2.0)] == [1, 2, 3, 4, 5, 7, 8, 9, 10]
    assert found[0.0, 0.0, 10.0] == 6
    unknown = spark.createDataFrame([(None, 1.0, 2.0), (1.0, None, 2.0), (1.0, 1.0, None)], "s double, l double, p double")
    assert {r.c for r in unknown.select(landform.weiss(F.col("s"), F.col("l"), F.col("p")).alias("c")).collect()} == {0}


def test_benches_and_small_groups(spark):
    hill = lambda x, y: 500 + (0.6 * (y - 40) if y > 40 else 0 if y >= -40 else 0.6 * (y + 40))
    rings = landform.ring_stats(surface.surface(grid(spark, hill), CELL))
    benches = rings.withColumn("bench", landform.bench_candidate(F.col("slope"), F.col("ring_samples"), F.col("ring_steep"))).select("grid_id", "x", "y", "bench")
    kept = landform.remove_small(benches)
    assert kept.where("bench = 1 and y between 13 and 19").count() > 50
    plane = landform.ring_stats(surface.surface(grid(spark, lambda x, y: 0.45 * y + 500), CELL))
    assert plane.withColumn("bench", landform.bench_candidate(F.col("slope"), F.col("ring_samples"), F.col("ring_steep"))).where("bench = 1").count() == 0
    spots = spark.createDataFrame([("g", x, y, int((x, y) in {(0, 0), (1, 0), (4, 4)} or x == 7)) for x in range(8) for y in range(8)], "grid_id string, x int, y int, bench int")
    assert {(r.x, r.y) for r in landform.remove_small(spots).where("bench = 1").collect()} == {(7, y) for y in range(8)}


def test_shelter_upwind_of_a_plane_and_unknown_ground(spark):
    plane = lambda x, y: math.tan(math.radians(15)) * x + 500
    found = mosaic.over_tiles(grid(spark, plane), {"s": (rays.shelter, "double", CELL, 90.0, 8), "v": (rays.sky_view, "double", CELL, 16, 4)}, 8)
    assert abs(found.where("x = 16 and y = 16").first().s - 0.5) < 1e-6
    assert found.where("x = 32 and y = 16").first().s is None and found.where("x = 0 and y = 0").first().v is None


def test_fill_voids_settles(spark):
    filled = surface.fill_voids(grid(spark, lambda x, y: 500, 9, lambda x, y: 3 <= x <= 5 and 3 <= y <= 5))
    assert filled.where("z is null").count() == 0 and filled.where("abs(z - 500) > 1e-9").count() == 0


def test_sun_and_times(spark):
    day = spark.createDataFrame([("2024-03-20 12:07:00", 0.0, 0.0)], "t string, lat double, lng double").select(F.to_timestamp("t").alias("t"), "lat", "lng")
    assert day.select(solar.sun(F.col("t"), F.col("lat"), F.col("lng")).alias("s")).first().s.altitude > 88
    winter = spark.createDataFrame([("2024-12-21 17:00:00", 40.0, -84.0), ("2024-12-21 12:00:00", 80.0, 0.0)], "t string, lat double, lng double").select(F.to_timestamp("t").alias("t"), "lat", "lng")
    found = {r.lat: r for r in solar.sun_times(winter, "t", "lat", "lng").collect()}
    assert 8 < (found[40.0].sunset - found[40.0].sunrise).total_seconds() / 3600 < 10.5
    assert found[80.0].sunrise is None and found[80.0].sunset is None


def test_wind_and_cold(spark):
    rows = spark.createDataFrame([(10.0, 90.0), (0.0, -1.0), (None, -1.0)], "slope double, aspect double")
    assert [r.e for r in rows.select(wind.wind_exposure(F.col("slope"), F.col("aspect"), 90.0).alias("e")).collect()] == [1.0, 0.0, None]
    cold = spark.createDataFrame([(5.0,), (-10.0,), (-40.0,), (-2.5,), (None,)], "c double").select(wind.cold_weight(F.col("c")).alias("w")).collect()
    assert [r.w for r in cold] == [0.0, 0.75, 0.75, 0.375, 0.0]
