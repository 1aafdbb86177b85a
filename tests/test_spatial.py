import random

import pytest
from pyspark.sql import functions as F

from heathgrid.operators import spatial

POLYGONS = "area long, polygon array<array<struct<lng:double,lat:double>>>"


def inside(x, y, polygon):
    n = 0
    for ring in polygon:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                n += 1
    return n % 2 == 1


def star(r, x, y, size, n):
    import math

    return [(x + size * r.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), y + size * r.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def test_points_in_polygons_of_all_sizes(spark):
    r = random.Random(8)
    shapes = [[star(r, r.uniform(-150, 150), r.uniform(-70, 70), size, r.randint(3, 12))] for size in (0.001, 0.05, 1, 5, 20, 60) for _ in range(5)]
    shapes[3].append(star(r, *shapes[3][0][0], 0.0005, 4))
    spots = [(r.uniform(-180, 180), r.uniform(-85, 85)) for _ in range(300)] + [(p[0][0][0] + r.uniform(-0.01, 0.01), p[0][0][1] + r.uniform(-0.01, 0.01)) for p in shapes for _ in range(3)]
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(spots)] + [(-1, None, None)], "id long, lng double, lat double")
    polygons = spark.createDataFrame(list(enumerate(shapes)) + [(98, None), (99, [])], POLYGONS)
    found = spatial.in_polygons(points, polygons)
    got = [(x.id, x.area) for x in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(k, a) for k, p in enumerate(spots) for a, s in enumerate(shapes) if inside(*p, s)} and len(got) > 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert spatial.in_polygons(points, polygons.where("false")).count() == 0
    assert spatial.in_polygons(points.where("false"), polygons).count() == 0


def test_a_shape_has_four_tiles_at_most(spark):
    r = random.Random(2)
    rows = [(k, r.uniform(-170, 160), r.uniform(-80, 70), 10 ** r.uniform(-6, 1)) for k in range(200)]
    boxes = spark.createDataFrame([(k, x, y, x + d, y + d) for k, x, y, d in rows], "k long, west double, south double, east double, north double")
    assert spatial.cover(boxes).groupBy("k").count().agg(F.max("count")).first()[0] <= 4


@pytest.mark.parametrize("seed", range(3))
def test_runs_are_the_even_odd_mask(spark, seed):
    r = random.Random(seed)
    shapes = [[[(float(round(x)), float(round(y))) if r.random() < 0.5 else (x, y) for x, y in star(r, 20, 15, 18, r.randint(3, 9))] for _ in range(r.randint(1, 3))] for _ in range(4)]
    shapes.append([[(2.0, 2.0), (9.0, 2.0), (9.0, 7.0), (2.0, 7.0)], [(4.0, 3.0), (6.0, 3.0), (6.0, 5.0), (4.0, 5.0)]])
    polygons = spark.createDataFrame(list(enumerate(shapes)), POLYGONS.replace("area", "id"))
    got = sorted((x.id, x.x, x.y) for x in spatial.fill(polygons).collect())
    assert got == sorted((k, x, y) for k, s in enumerate(shapes) for x in range(-5, 45) for y in range(-10, 40) if inside(x, y, s))
    cells = spark.createDataFrame([(x, y) for x in range(30) for y in range(30)], "x int, y int")
    assert spatial.masked(cells, polygons).count() == sum(1 for _, x, y in got if 0 <= x < 30 and 0 <= y < 30)


def test_runs_are_fewer_than_cells(spark):
    polygons = spark.createDataFrame([(1, [[(0.0, 0.0), (500.0, 0.0), (500.0, 40.0), (0.0, 40.0)]])], POLYGONS.replace("area", "id"))
    assert spatial.runs(polygons).count() == 40 and spatial.fill(polygons).count() == 20_000


def test_outline(spark):
    mask = spark.createDataFrame([(1, x, y) for x in range(5) for y in range(4)], "id long, x int, y int")
    assert {(r.x, r.y) for r in spatial.outline(mask).where("not edge").collect()} == {(x, y) for x in (1, 2, 3) for y in (1, 2)}
    assert spatial.outline(mask).count() == 20
