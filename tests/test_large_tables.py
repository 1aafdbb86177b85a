"""What only shows on larger tables, brought about on small ones; queries against their SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from heathgrid import queries
from heathgrid.functions import tiles
from heathgrid.operators import fieldlog, spatial
from heathgrid.plans import analyze, region
from heathgrid.queries import geo


def both(spark, folder, name, **tables):
    """A query's rows over tables made of columns, and those of its SQL."""
    con = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), folder / f"{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    found = queries.queries()[name](spark, str(folder))
    key = lambda row: [(v is None, v) for v in row]
    return sorted(map(tuple, found.collect()), key=key), sorted(con.execute(f"select {', '.join(found.columns)} from ({queries.oracle_sql()[name]})").fetchall(), key=key)


@pytest.fixture
def conf(spark):
    """Sets configurations of the session until the test ends."""
    before = {}

    def put(**values):
        for k, v in values.items():
            name = "spark.sql." + k.replace("_", ".")
            before.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, v)

    yield put
    for name, v in before.items():
        spark.conf.unset(name) if v is None else spark.conf.set(name, v)


def test_replay_when_the_join_turns_into_a_broadcast(spark, conf):
    conf(autoBroadcastJoinThreshold="-1", adaptive_autoBroadcastJoinThreshold="10m", adaptive_coalescePartitions_enabled="false")
    log = spark.range(0, 4000, 1, 8).selectExpr("(id * 31) % 20 as entity_id", "id as seq", "id div 20 + 1 - id div 3000 as base_version")
    start = log.selectExpr("entity_id as id", "1L as version").distinct()
    at, want = dict.fromkeys(range(20), 1), {}
    for k in range(4000):
        one = k * 31 % 20
        hit = k // 20 + 1 - k // 3000 == at[one]
        at[one] += hit
        want[k] = ("applied" if hit else "conflict", at[one])
    assert {r.seq: (r.status, r.version) for r in fieldlog.replayed(log, start).collect()} == want


def test_pixels_of_heights_beyond_their_bytes(spark, tmp_path):
    ids = [50, 1_000, 1_100_000, 1_100_099, 3_600_001, 3_600_098, 5_999_900, 5_999_999, 90_000_000, 90_000_099]
    events = {"event_id": [*ids, 7], "value": pa.array([*(k * 3.17 for k in range(len(ids))), None], pa.float64())}
    found, want = both(spark, tmp_path, "rgb_roundtrip", events=events)
    assert found == want


def opened_last(frame):
    """Whether rows are opened above every aggregate, so that no aggregate holds the opened ones."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return "Generate" in plan and "Aggregate" in plan and plan.index("Aggregate") > plan.rindex("Generate")


BOXES = "id long, west double, south double, east double, north double"
ROUND = [(1, 170.0, -5.0, 182.0, 2.0), (1, 170.0, -5.0, 182.0, 2.0), (2, 10.0, 10.0, 22.0, 17.0), (3, -179.0, -60.0, 178.0, 60.0), (4, 5.0, -60.0, 360.0, 60.0), (4, 5.0, -60.0, 360.0, 60.0)]


def test_tiles_are_opened_after_boxes_are_told_apart(spark):
    boxes = spark.createDataFrame(ROUND, BOXES)
    found = tiles.tiles_over(boxes, [2, 5, 2])
    got = [(r.id, r.zoom, r.x, r.y) for r in found.collect()]
    assert opened_last(found) and len(got) == len(set(got))
    counts = {(r.id, r.zoom): r.n_tiles for r in tiles.tile_count(boxes.where("id < 4").distinct(), [2, 5]).collect()}
    assert {k: sum(g[:2] == k for g in got) for k in counts} == counts
    assert {g[2] for g in got if g[:2] == (4, 2)} == {0, 1, 2, 3}  # the spans from 5 to 180 and from -180 to 0 meet in column 2


def test_coverage_joins_tiles_that_no_aggregate_held(spark, tmp_path):
    customer = {"c_custkey": [*range(1, 90), *range(80, 95)]}
    found, want = both(spark, tmp_path, "tile_coverage", customer={"c_custkey": [*range(1, 95)]})
    assert found == want
    assert opened_last(geo.planned(spark, str(tmp_path)))
    again, _ = both(spark, tmp_path, "tile_coverage", customer=customer)
    assert again == want


def test_coverage_joins_strips_instead_of_tiles(spark, tmp_path, conf, monkeypatch):
    conf(autoBroadcastJoinThreshold="-1")
    joined = []
    real = fieldlog.coverage
    monkeypatch.setattr(fieldlog, "coverage", lambda planned, *rest: joined.append(planned) or real(planned, *rest))
    found, want = both(spark, tmp_path, "tile_coverage", customer={"c_custkey": [*range(1, 95), 5_399_999, 5_400_000]})
    assert found == want
    assert joined[0].count() * 3 < sum(row[1] for row in found)


def test_strips_hold_the_tiles_over_boxes(spark):
    boxes = spark.createDataFrame([*ROUND, (5, 0.0, 84.0, 1.0, 89.0), (6, -3.0, -1.0, -2.0, 1.0)], BOXES)
    strips = tiles.strips_over(boxes, [0, 2, 5, 9])
    of_box = {}
    for r in strips.collect():
        assert (r.id, r.zoom, r.x, r.strip) not in of_box and r.bits > 0
        of_box[r.id, r.zoom, r.x, r.strip] = r.bits
    got = {(i, z, x, 32 * s + k) for (i, z, x, s), bits in of_box.items() for k in range(32) if bits >> k & 1}
    opened = tiles.tiles_over(boxes, [0, 2, 5, 9])
    assert got == {(r.id, r.zoom, r.x, r.y) for r in opened.collect()} and len({g[3] // 32 for g in got if g[:2] == (3, 9)}) > 2
    assert sum(bits.bit_count() for bits in of_box.values()) == len(got)
    each = [(r.zoom, r.x, r.y) for r in tiles.tiles_of(strips).collect()]
    assert len(each) == len(set(each)) and set(each) == {g[1:] for g in got}
    again = tiles.tiles_of(tiles.strips_of(opened)).collect()
    assert {(r.zoom, r.x, r.y) for r in again} == set(each)


def test_missing_tiles_are_found_by_strips(spark, tmp_path, conf, monkeypatch):
    conf(autoBroadcastJoinThreshold="-1")
    joined = []
    real = fieldlog.missing
    monkeypatch.setattr(fieldlog, "missing", lambda planned, *rest: joined.append(planned) or real(planned, *rest))
    keys = {"c_custkey": [*range(1, 40), 5_399_999, 5_400_000]}
    found, want = both(spark, tmp_path, "tile_anti_join", customer=keys)
    assert found == want and len(found) > 100
    every, _ = both(spark, tmp_path, "tiles_for_bbox", customer=keys)
    assert joined[0].count() * 3 < len(every)


def test_coverage_of_tiles_and_of_sets_agree(spark):
    planned = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 2), (3, 3), (None, 0)], "id long, x long")
    held = spark.createDataFrame([(0,), (1,), (1,), (7,)], "x long")
    want = {1: (2, 2, "covered"), 2: (2, 1, "partial"), 3: (1, 0, "empty"), None: (1, 1, "covered")}
    rows = lambda found: {r.id: (r.planned, r.held, r.verdict) for r in found.collect()}
    assert rows(fieldlog.coverage(planned, held, ["x"], "id")) == want
    sets = lambda f, *by: f.groupBy(*by, (f.x % 2).alias("odd")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), f.x.cast("int"))).alias("b"))
    assert rows(fieldlog.coverage(sets(planned, "id"), sets(held), ["odd"], "id", "b")) == want


def test_sampled_tiles_are_opened_after_boxes_are_told_apart(spark):
    for zoom, most in ((2, 48), (5, 20), (22, 48)):
        found = region.sampled(spark.createDataFrame(ROUND, BOXES), zoom, most)
        got = [(r.id, r.x, r.y) for r in found.collect()]
        assert len(got) == len(set(got)) and {g[0] for g in got} == {1, 2, 3, 4}
    # the part of the plan for boxes whose spans can't meet comes first
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")


def test_exclusive_tiles_need_no_distinct_rows(spark):
    rows = [(1, 0), (1, 0), (1, 1), (2, 1), (2, 2), (3, 1), (None, 3), (None, 4), (3, 4), (2, 5)]
    found = fieldlog.exclusive(spark.createDataFrame(rows, "id long, x long"), ["x"], "id")
    assert {r.id: r.n_exclusive for r in found.collect()} == {1: 1, 2: 2, 3: 0, None: 0}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 3


def test_crowded_tiles_are_dealt_in_pieces(spark, conf, monkeypatch):
    conf(adaptive_enabled="true")
    monkeypatch.setattr(spatial, "PAIRS", 50)
    points = spark.range(300).selectExpr("id", "(id % 30) / 100.0 as lng", "(id % 20) / 100.0 as lat")
    square = "array(array(named_struct('lng', {0}, 'lat', {0}), named_struct('lng', {1}, 'lat', {0}), named_struct('lng', {1}, 'lat', {1}), named_struct('lng', {0}, 'lat', {1})))"
    polygons = spark.range(20).selectExpr("id as area", square.format("id / 200.0D - 0.001D", "id / 200.0D + 0.0555D") + " as polygon")
    found = spatial.in_polygons(points.selectExpr("id", "cast(lng as double) lng", "cast(lat as double) lat"), polygons)
    got = sorted((r.id, r.area) for r in found.collect())
    low, high = [k / 200 - 0.001 for k in range(20)], [k / 200 + 0.0555 for k in range(20)]
    assert got == sorted((k, a) for k in range(300) for a in range(20) if low[a] < k % 30 / 100 < high[a] and low[a] < k % 20 / 100 < high[a]) and len(got) > 100
    assert found.rdd.getNumPartitions() > 20


def test_layers_with_groups_are_worked_out_once(spark):
    cells = spark.range(47 * 47).selectExpr("'g' as grid_id", "cast(id % 47 as int) as x", "cast(id div 47 as int) as y", "500.0D + id % 47 as z")
    found = analyze.analyze(cells, {"bench"}, 10.0, 20)
    assert "Range (" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 49
