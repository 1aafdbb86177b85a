from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_surface import CELL, grid

from heathgrid.functions import solar
from heathgrid.plans import analyze as a
from heathgrid.plans import predicate as p


def test_halo(spark):
    assert a.required_halo({"slope"}) == 1 and a.required_halo({"weiss", "bench"}) == 20 and a.required_halo({"sky_view"}) == 24
    cells = grid(spark, lambda x, y: 0.2 * x + 500, 9)
    with pytest.raises(a.InsufficientHalo) as e:
        a.analyze(cells, {"slope", "vrm"}, CELL, 2)
    assert (e.value.required, e.value.available, e.value.layers) == (5, 2, ["vrm"])
    with pytest.raises(ValueError):
        a.analyze(cells, {"nope"}, CELL, 2)


def test_only_wanted_columns_and_no_halo(spark):
    found = a.analyze(grid(spark, lambda x, y: 0.2 * x + 500, 9), {"slope", "tpi_small", "wind_exposure"}, CELL, 3)
    assert found.columns == ["grid_id", "x", "y", "z", "slope", "tpi_small"] and found.count() == 9
    plan = found.select("x", "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_bedding_on_a_plane(spark):
    found = a.analyze(grid(spark, lambda x, y: 0.2 * x + 500, 47), {"bedding", "shelter", "wood", "bench"}, CELL, 20, wind_from=90.0)
    rows = found.collect()
    assert len(rows) == 49 and all(0 < r.bedding < 1 and r.wood == 0 and r.bench == 0 for r in rows if r.bedding is not None)
    assert any(r.bedding is not None for r in rows)


def test_area_share(spark):
    cells = grid(spark, lambda x, y: (0.2 if x > 0 else 0.02) * x + 500, 21)
    one = a.area_share(cells, p.within("slope", 8, 20), CELL, 1).first()
    assert one.cells == 361 and 0.4 < one.share < 0.6 and one.advice == "tighten"
    assert a.layers_of(p.PRESETS["Thermal sinks"]) == {"curvature", "sky_view"}


def test_the_sun_is_worked_out_or_asked_for(spark):
    cells = grid(spark, lambda x, y: 0.2 * x + 0.1 * y + 500, 5)
    with pytest.raises(ValueError, match="sun"):
        a.analyze(cells, {"insolation"}, CELL, 1)
    at = (datetime(2024, 3, 20, 17, 30), 39.7, -84.2)
    found = a.analyze(cells, {"insolation", "multi_hillshade"}, CELL, 1, at=at)
    assert found.columns == ["grid_id", "x", "y", "z", "multi_hillshade", "insolation"]
    sun = spark.range(1).select(solar.sun(*map(F.lit, at)).alias("s")).first().s
    assert 45 < sun.altitude < 55 and 160 < sun.azimuth < 200
    given = a.analyze(cells, {"insolation", "multi_hillshade"}, CELL, 1, sun=(sun.altitude, sun.azimuth))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, given.collect()))
    assert all(0 < r.insolation < 1 and 0 < r.multi_hillshade < 1 for r in found.collect())
