from pyspark.sql import functions as F

from heathgrid.operators import cascade as c


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_members(spark):
    kind = "property_id long, user_id long, role string"
    held = spark.createDataFrame([(1, 10, "HUNTER"), (1, 11, "OBSERVER"), (2, 10, "MANAGER")], kind)
    wanted = spark.createDataFrame([(1, 11, "MANAGER", 1), (1, 11, "HUNTER", 2), (1, 12, "OBSERVER", 3), (2, 10, "KING", 4)], kind + ", seq long")
    after = c.members_set(held, wanted)
    assert rows(after, "property_id", "user_id", "role") == {(1, 10, "HUNTER"), (1, 11, "HUNTER"), (1, 12, "OBSERVER"), (2, 10, "MANAGER")} and after.columns == held.columns
    properties = spark.createDataFrame([(1, 10), (2, 99)], "id long, owner_id long")
    gone = spark.createDataFrame([(1, 10), (1, 11), (1, 11), (2, 10), (3, 3)], "property_id long, user_id long")
    assert rows(c.members_removed(after, properties, gone), "property_id", "user_id") == {(1, 10), (1, 12)}


def test_removals(spark):
    properties = spark.createDataFrame([(1, 7), (2, 8), (3, 9)], "id long, owner_id long")
    members = spark.createDataFrame([(2, 7, "HUNTER"), (3, 7, "OBSERVER")], "property_id long, user_id long, role string")
    seen = spark.createDataFrame([(100, 1, 8), (200, 2, 7), (201, 2, 8), (300, 3, 7), (400, 4, 7)], "id long, property_id long, user_id long")
    wanted = spark.createDataFrame([(100,), (200,), (200,), (201,), (300,), (400,), (999,)], "id long")
    left, told = c.rows_removed(seen, properties, members, wanted, 7)
    assert rows(told, "id", "status") == {(100, "removed"), (200, "removed"), (201, "refused"), (300, "refused"), (400, "refused"), (999, "missing")} and told.count() == 6
    assert rows(left, "id") == {(201,), (300,), (400,)}


def test_filters(spark):
    kind = "id long, owner_id long, name string, predicate string, color string, version int, matched_area_share double"
    held = spark.createDataFrame([(1, 7, "a", "p", "#000000", 1, 0.5), (2, 7, "b", "p", "#000000", 4, 0.5), (3, 8, "c", "p", "#000000", 1, 0.5)], kind)
    changes = spark.createDataFrame([(1, 7, 1, "x", None, None), (1, 7, 2, None, "q", None), (1, 7, 3, "y", None, "#A0b1c2"), (2, 7, 4, "z", None, "red"), (2, 7, 5, None, "bad", None), (2, 7, 6, "n", None, None), (3, 7, 7, "stolen", None, None), (9, 7, 8, "new", None, None)], "id long, user_id long, seq long, name string, predicate string, color string")
    after = c.filters_changed(held, changes, F.col("predicate") != "bad")
    assert rows(after, *held.columns) == {(1, 7, "y", "q", "#A0b1c2", 4, None), (2, 7, "n", "p", "#000000", 5, 0.5), (3, 8, "c", "p", "#000000", 1, 0.5)}


def test_boundaries_and_regions(spark):
    properties = spark.createDataFrame([(1, "A", 5.0, 1.0, 2.0, "n"), (2, "B", 6.0, 1.0, 2.0, "m")], "id long, boundary string, area_hectares double, center_lng double, center_lat double, name string")
    profiles = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "property_id long, bench_share double")
    changes = spark.createDataFrame([(1, 1, "C", 7.0, 3.0, 4.0), (1, 2, "D", 8.0, 5.0, 6.0), (2, 3, None, 9.0, 9.0, 9.0)], "id long, seq long, boundary string, area_hectares double, center_lng double, center_lat double")
    after, left = c.boundaries_changed(properties, profiles, changes)
    assert rows(after, *properties.columns) == {(1, "D", 8.0, 5.0, 6.0, "n"), (2, "B", 6.0, 1.0, 2.0, "m")} and after.columns == properties.columns
    assert rows(left, "property_id") == {(2,), (3,)}
    regions = spark.createDataFrame([(1, "PENDING", None, None, None), (2, "PENDING", None, None, None)], "id long, status string, size_bytes long, tile_count long, packaged_at string")
    done = spark.createDataFrame([(1, 1, 10, 3, "t"), (1, 2, 20, None, None)], "id long, seq long, size_bytes long, tile_count long, packaged_at string")
    assert rows(c.regions_ready(regions, done), *regions.columns) == {(1, "READY", 20, 3, "t"), (2, "PENDING", None, None, None)}
    none = changes.where("false")
    assert rows(c.boundaries_changed(properties, profiles, none)[0], "id", "boundary") == {(1, "A"), (2, "B")}
