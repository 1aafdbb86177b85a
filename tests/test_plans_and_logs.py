import pytest
from pyspark.sql import functions as F

from heathgrid.functions import geometry, pixels, season, tiles
from heathgrid.operators import cost, fieldlog, selection
from heathgrid.plans import predicate as p


def test_predicates_over_unknown_ground(spark):
    cells = spark.createDataFrame([(2.0, 0.0, 5, 0), (12.0, 90.0, 2, 1), (None, -1.0, 0, 2), (1.0, -1.0, 5, 0), (40.0, 350.0, 10, 0)], "slope double, aspect double, weiss int, bench int")
    match = lambda tree, **k: [r.m for r in cells.select(p.compiled(tree, cells.columns, **k).alias("m")).collect()]
    steep = p.within("slope", 10)
    assert match(steep) == [False, True, False, False, True]
    assert match({"kind": "not", "operand": steep}) == [True, False, True, True, False]
    assert match({"kind": "not", "operand": steep}, kleene=True) == [True, False, None, True, False]
    north = {"kind": "aspect", "centerDeg": 5, "toleranceDeg": 20, "includeFlat": True}
    assert match(north) == [True, False, False, True, True]
    assert match(p.every()) == [True] * 5 and match({"kind": "any", "operands": []}) == [False] * 5
    assert match(p.within("skyView", 0)) == [False] * 5
    assert match({"kind": "bench", "isBench": False}) == [True, False, False, True, True]


@pytest.mark.parametrize("bad", ['{"kind": "range", "metric": "nope"}', '{"kind": "all"}', "[]", '{"kind": "range", "metric": "slope", "min": "x"}', '{"kind": "bench"}', '{"kind": "?"}'])
def test_bad_predicates(bad):
    with pytest.raises(p.InvalidPredicate):
        p.parse(bad)


def test_predicate_limits_and_presets():
    deep = p.within("slope", 1)
    for _ in range(12):
        deep = {"kind": "not", "operand": deep}
    with pytest.raises(p.InvalidPredicate):
        p.parse(deep)
    with pytest.raises(p.InvalidPredicate):
        p.parse(p.every(*[p.within("slope", 1)] * 33))
    assert all(p.parse(x) for x in p.PRESETS.values()) and len(p.PRESETS) == 7
    assert p.columns(p.PRESETS["Leeward spur points"]) == {"weiss", "wind_exposure", "slope"}
    assert p.columns({"kind": "aspect", "centerDeg": 0, "toleranceDeg": 1}) == {"aspect", "slope"}


def test_selection(spark):
    def run(used, shares):
        u = spark.createDataFrame([(b,) for b, n in enumerate(used) for _ in range(n)], "bin int")
        a = spark.createDataFrame([(i, f"b{i}", float(s)) for i, s in enumerate(shares)], "bin int, label string, share double")
        return sorted(selection.analysis(u, a).collect())

    same = run([90, 10], [0.9, 0.1])
    assert all(abs(r.ratio - 1) < 1e-9 and r.significant is False for r in same)
    other = run([50, 50], [0.9, 0.1])
    assert other[1].ratio > 4 and other[1].significant
    assert run([3, 1], [0.9, 0.1])[0].significant is None and run([5], [1.0])[0].chi_square is None
    rows = spark.createDataFrame([(1,), (4,), (10,), (0,)], "df int").select(selection.critical_95(F.col("df")).alias("c")).collect()
    assert [r.c for r in rows] == [3.841, 9.488, 18.307, None]


def test_season(spark):
    rows = spark.createDataFrame([("2024-11-15",), ("2024-11-07",), ("2024-10-28",), ("2024-12-27",), ("2024-07-04",)], "d string").select(season.reading(F.dayofyear(F.to_date("d")), F.lit(39.7), F.lit("WHITETAIL")).alias("r"))
    assert [x.r.phase for x in rows.collect()] == ["PeakBreeding", "Chasing", "Seeking", "LateSeason", "OffSeason"]
    elk = spark.range(1).select(season.reading(F.lit(300), F.lit(45.0), F.lit("ELK")).alias("r")).first().r
    assert not elk.supported and elk.phase is None


def test_pixels(spark):
    one = spark.range(1).select(pixels.decode_terrarium(F.lit(128), F.lit(100), F.lit(128)).alias("a"), pixels.decode_terrain_rgb(F.lit(0), F.lit(0), F.lit(0)).alias("b"), pixels.decode_rgba(F.lit(1), F.lit(1), F.lit(1), F.lit(0)).alias("c"), pixels.hex_color(F.lit("#f80")).alias("d"), pixels.hex_color(F.lit("red")).alias("e")).first()
    assert (one.a, one.b, one.c, tuple(one.d), one.e) == (100.5, -10000.0, None, (255, 136, 0), None)


def test_tiles_and_rings(spark):
    one = spark.range(1).select((tiles.pixel_size(F.lit(60.0), F.lit(14)) / tiles.pixel_size(F.lit(0.0), F.lit(14))).alias("r"), tiles.utm(F.lit(-84.2), F.lit(39.7)).alias("u")).first()
    assert abs(one.r - 0.5) < 1e-12 and one.u.zone == 16 and abs(one.u.northing - 4397990) < 3000
    bow = F.array(*(geometry.point(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (1, 1), (1, 0), (0, 1))))
    square = F.array(*(geometry.point(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))))
    r = spark.range(1).select(geometry.crosses_itself(bow).alias("b"), geometry.crosses_itself(square).alias("s"), geometry.inside(F.lit(0.5), F.lit(0.5), F.array(square)).alias("i"), geometry.to_geojson(square).alias("j"))
    found = r.first()
    assert found.b and not found.s and found.i
    assert r.select(F.size(geometry.from_geojson(F.col("j"))[0]).alias("n")).first().n == 5
    assert geometry.hull([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2), (1, 0)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]


def test_paths_round_a_wall():
    import numpy as np

    base = np.ones((21, 21))
    base[:, 10] = np.nan
    zero = np.zeros((21, 21))
    assert cost.Grid(base, zero, zero, 10.0).path((2, 10), (18, 10))[0] == []
    base[9:12, 10] = 1
    g = cost.Grid(base, zero, zero, 10.0)
    cells, hours = g.path((2, 10), (18, 10))
    assert len(cells) == 17 and (10, 10) in cells
    found = g.corridor([(2, 10)], [(18, 10)])
    assert found["mask"][10, 10] and abs(found["optimal"] - hours) < 1e-12 and cost.pinch(found["mask"])[10, 10] > 0.3
    assert len(cost.Grid(np.ones((9, 9)), np.zeros((9, 9)), np.zeros((9, 9)), 10.0).path((0, 0), (8, 8))[0]) == 9


def test_replay_and_inserts(spark):
    m = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 3, 2), ("b", 1, 5), ("c", 1, 1)], "entity_id string, seq long, base_version long")
    e = spark.createDataFrame([("a", 1), ("b", 4)], "id string, version long")
    found = {(r.entity_id, r.seq): (r.status, r.version) for r in fieldlog.replayed(m, e).collect()}
    assert found == {("a", 1): ("applied", 2), ("a", 2): ("conflict", 2), ("a", 3): ("applied", 3), ("b", 1): ("conflict", 4), ("c", 1): ("missing", None)}
    new = fieldlog.new_rows(spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "y")], "seq long, client_id string"), spark.createDataFrame([("y",)], "client_id string"))
    assert sorted(r.seq for r in new.collect()) == [1, 3]


def test_corridor_shapes():
    import numpy as np

    g = cost.Grid(np.ones((15, 30)), np.zeros((15, 30)), np.zeros((15, 30)), 10.0)
    found = g.corridor(cost.seed_cells([(2, 7)], 30, 15), cost.seed_cells([(27, 7)], 30, 15))
    lines = cost.centre_lines(found["strength"], found["mask"])
    assert 1 <= len(lines) <= 6 and all(len(x) >= 8 and len(set(x)) == len(x) for x in lines)
    assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for x in lines for a, b in zip(x, x[1:], strict=False))
    assert len(cost.seed_cells([(0, 0), (1, 0)], 30, 15)) == 12
    box = np.zeros((9, 9), dtype=bool)
    box[2:7, 3:8] = True
    assert cost.edge_cells(box).sum() == 16 and cost.band(box) == [(3, 2), (7, 2), (7, 6), (3, 6)]
    assert cost.top_apart(np.where(box, 0.9, 0.0)) == [(3, 2, 0.9)]
