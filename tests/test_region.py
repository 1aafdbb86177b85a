from pyspark.sql import functions as F

from heathgrid.functions import tiles
from heathgrid.plans import region

BOX = "id long, west double, south double, east double, north double"


def test_zooms(spark):
    rows = spark.createDataFrame([(8.0, 11.4), (3.0, 40.0), (14.0, 2.0), (9.5, 9.5)], "v double, d double")
    got = [tuple(r.z) for r in rows.select(region.zoom_range(F.col("v"), F.col("d")).alias("z")).collect()]
    assert got == [(6, 11), (6, 15), (6, 6), (8, 10)]


def test_plans_count_what_a_listing_would(spark):
    boxes = spark.createDataFrame([(1, -84.0, 39.0, -83.0, 40.0), (2, 175.0, -10.0, 185.0, 5.0), (3, 1.0, 1.0, 1.0, 1.0)], BOX)
    plans = {r.id: r for r in region.planned(boxes.withColumns({"lo": F.lit(6), "hi": F.lit(9)}), most=100).collect()}
    listed = {(r.id, r.zoom): r["count"] for r in tiles.tiles_over(boxes, [6, 7, 8, 9]).groupBy("id", "zoom").count().collect()}
    for k, r in plans.items():
        assert {(k, v.zoom): v.n for v in r.by_zoom} == {z: n for z, n in listed.items() if z[0] == k}
        assert r.bytes == r.n_tiles * region.TILE_BYTES and r.over_limit == (r.n_tiles > 100)
    far = region.planned(boxes.withColumns({"lo": F.lit(22), "hi": F.lit(22)})).where("id = 2").first()
    assert far.n_tiles > 10**10


def test_samples_are_spread_and_few(spark):
    boxes = spark.createDataFrame([(1, -84.0, 39.0, -83.0, 40.0), (2, 175.0, -10.0, 185.0, 5.0), (3, -120.0, 40.0, -60.0, 40.01), (4, 1.0, 1.0, 1.0, 1.0)], BOX)
    for zoom, most in ((20, 48), (12, 7), (6, 1000)):
        got = region.sampled(boxes, zoom, most)
        all_of = {r.id: r.n for r in region.planned(boxes.withColumns({"lo": F.lit(zoom), "hi": F.lit(zoom)})).select("id", F.col("n_tiles").alias("n")).collect()}
        for r in got.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("x", "y").alias("d")).collect():
            assert r.n == r.d and r.n <= max(most + 1, 1) and (r.n == all_of[r.id] if all_of[r.id] <= most else r.n >= 1)
    assert rows_of(region.sampled(boxes, 20, 48)) == rows_of(region.sampled(boxes, 20, 48))


def rows_of(df):
    return {tuple(r) for r in df.select("id", "x", "y").collect()}


def test_warnings(spark):
    rows = spark.createDataFrame([(10, 1_000, 10_000), (130_000, 600_000_000, None), (10, 95, 100), (10, 90, 100)], "n long, size long, free long")
    got = [[w.code for w in r.w] for r in rows.select(region.device_warnings(F.col("n"), F.col("size"), F.col("free")).alias("w")).collect()]
    assert got == [[], ["over_limit", "large"], ["no_room"], []]
    plans = spark.createDataFrame([(1, 100, 12, ["satellite"]), (2, 100, 16, ["slope", "satellite"]), (3, 90_000, 12, ["topo", "topo"]), (4, 5, 12, ["nothing like it"]), (5, 5, 12, [])], "id long, n_tiles long, hi int, layers array<string>")
    out = {r.id: r for r in region.by_layer(plans).collect()}
    assert [w.code for w in out[1].warnings] == [] and out[1].heaviest.layer == "satellite" and out[1].total_bytes == 4_200_000
    assert [(w.code, w.layer) for w in out[2].warnings] == [("heaviest", "satellite"), ("deep", None)]
    assert [w.code for w in out[3].warnings] == ["over_limit", "large"]
    assert out[4].total_bytes == 50_000 and out[5].total_bytes == 0 and out[5].heaviest is None


def test_device_and_server(spark):
    said = "array<struct<code:string,layer:string,amount:long>>"
    device = spark.createDataFrame([(1, 10, 5, [("no_room", None, 3)]), (2, 10, 5, []), (3, 10, 5, [])], f"id long, n_tiles long, bytes long, warnings {said}")
    served = spark.createDataFrame([(1, 10, [("large", None, 9), ("deep", None, 16), ("no_room", None, 3)]), (2, 12, [])], f"id long, n_tiles long, warnings {said}")
    got = {r.id: r for r in region.reconciled(device, served).collect()}
    assert [w.code for w in got[1].warnings] == ["deep", "no_room"] and got[1].source == "server" and got[1].server_tiles is None
    assert [w.code for w in got[2].warnings] == ["disagrees"] and got[2].server_tiles == 12 and got[2].n_tiles == 10
    assert got[3].source == "device" and got[3].warnings == []
