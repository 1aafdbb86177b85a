import datetime as dt

import pytest
from pyspark.sql import functions as F

from heathgrid.functions import names, pixels, readout
from heathgrid.sources import catalog as c

PAGE = """<?xml version="1.0"?><ListBucketResult><IsTruncated> {more} </IsTruncated>
<Contents><Key>a/b&amp;c.tif</Key><Size>3</Size></Contents><Contents>
<Key>a/&lt;d&gt;.tif</Key></Contents><Contents><Size>1</Size></Contents>
<CommonPrefixes><Prefix>{p}P &amp;amp; Q/</Prefix></CommonPrefixes><CommonPrefixes><Prefix>{p}R/</Prefix></CommonPrefixes><CommonPrefixes><Prefix>{p}</Prefix></CommonPrefixes>
<NextContinuationToken>t&quot;1</NextContinuationToken></ListBucketResult>"""


def test_listings(spark):
    rows = spark.createDataFrame([(1, PAGE.format(more="true", p=c.PROJECTS)), (2, PAGE.format(more="false", p="")), (3, ""), (4, None)], "id long, value string")
    got = {r.id: r.l for r in rows.select("id", c.listing(F.col("value")).alias("l")).collect()}
    assert got[1]["keys"] == ["a/b&c.tif", "a/<d>.tif"] and got[1].prefixes == [f"{c.PROJECTS}P &amp; Q/", f"{c.PROJECTS}R/", c.PROJECTS]
    assert got[2].token is None and not got[2].truncated and got[3]["keys"] == []
    assert {r.project for r in c.projects(rows.where("id = 1")).collect()} == {"P &amp; Q", "R"}
    url = spark.range(1).select(c.list_url(F.lit("https://b"), F.lit("a b/"), F.lit("/"), 1000, F.lit('t"1')).alias("u"), c.list_url(F.lit("https://b"), F.lit("x"), token=F.lit(None).cast("string")).alias("v")).first()
    assert url.u == "https://b/?list-type=2&prefix=a+b%2F&delimiter=%2F&max-keys=1000&continuation-token=t%221" and url.v == "https://b/?list-type=2&prefix=x"
    asked = []
    held = {None: ("one", "t1"), "t1": ("two", "t2"), "t2": ("three", None)}
    assert c.pages(lambda t: (asked.append(t), held[t])[1]) == ["one", "two", "three"] and asked == [None, "t1", "t2"]
    assert len(c.pages(lambda t: ("p", "again"), 5)) == 5


def test_sources():
    assert c.source().name == "terrarium" and c.source("usgs3dep-1m").product == "1m"
    with pytest.raises(c.UnknownSource):
        c.source("nope")


def test_urls_in_order(spark):
    boxes = spark.createDataFrame([(1, -84.5, 39.6, -83.5, 39.9), (2, -84.5, 39.5, -84.4, 39.6)], "id long, west double, south double, east double, north double")
    rows = c.third_arc_urls(boxes, "B").collect()
    got = {k: [r.url.split("/")[-2] for r in sorted(rows, key=lambda r: r.place) if r.id == k] for k in (1, 2)}
    assert got == {1: ["n40w084", "n40w085"], 2: ["n40w085"]} or got == {1: ["n40w085", "n40w084"], 2: ["n40w085"]}
    files = spark.createDataFrame([("USGS_one_meter_x71y439_OH_A.tif",), ("USGS_1M_16_x71y439_OH_B.tif",), ("USGS_1M_17_x1y1_FAR.tif",)], "value string")
    index = names.inverted(names.manifest(files))
    point = spark.createDataFrame([(1, 710500.0 + 4000, 4384500.0)], "id long, e double, n double")
    from heathgrid.functions import tiles

    at = point.select("id", tiles.utm_inverse(F.lit(16), F.col("e"), F.col("n"), F.lit(True)).alias("p")).first().p
    box = spark.createDataFrame([(7, at.lng - 1e-4, at.lat - 1e-4, at.lng + 1e-4, at.lat + 1e-4)], "id long, west double, south double, east double, north double")
    urls = [r.url for r in c.one_meter_urls(box, index, "B").orderBy("place").collect()]
    assert urls and all("/OH_B/TIFF/" in u and u.endswith("_OH_B.tif") for u in urls) and len(urls) == len(set(urls))
    assert any("USGS_1M_16_x71y439" in u for u in urls)
    assert {r.key for r in c.index_within(index, box).collect()} == {"*/71/439", "16/71/439"}


def test_the_first_that_holds(spark):
    candidates = spark.createDataFrame([(1, 1, "a", "P"), (1, 2, "b", "Q"), (1, 3, "c", "R"), (2, 1, "a", "P")], "id long, rank int, url string, project string")
    probes = spark.createDataFrame([(1, "a", True, True, True, False), (1, "b", True, True, True, True), (1, "c", True, True, True, True), (2, "a", False, True, True, True)], "id long, url string, opens boolean, is_utm boolean, inside boolean, has_height boolean")
    assert [tuple(r) for r in c.resolved(candidates, probes).collect()] == [(1, 2, "b", "Q")]


def test_cache(spark):
    t = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    kept = spark.createDataFrame([(1, 1, b"abc", t(0)), (1, 2, b"abcd", t(50)), (2, 2, None, t(99))], "z int, x int, body binary, fetched_at timestamp")
    wanted = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (3, 3)], "z int, x int")
    hits, misses = c.looked_up(wanted, kept, ["z", "x"], F.lit(t(100)))
    assert {(r.z, r.x) for r in hits.collect()} == {(1, 2)} and sorted((r.z, r.x) for r in misses.collect()) == [(1, 1), (3, 3)]
    new = spark.createDataFrame([(1, 1, b"new", t(100)), (3, 3, b"n", t(100)), (1, 2, b"old", t(1))], kept.schema)
    after = c.stored(kept, new, ["z", "x"])
    assert {(r.z, r.x): bytes(r.body) if r.body else None for r in after.collect()} == {(1, 1): b"new", (1, 2): b"abcd", (2, 2): None, (3, 3): b"n"}
    assert {(r.z, r.n, r.bytes) for r in c.stats(after, ["z"], "body").collect()} == {(1, 2, 7), (2, 1, 0), (3, 1, 1)}


def test_datums(spark):
    rows = spark.createDataFrame([(1, "orthometric"), (2, "orthometric")], "id long, datum string")
    assert c.same_datum(rows, "orthometric").count() == 2
    for other in ("ellipsoidal", None):
        with pytest.raises(c.DatumMismatch):
            c.same_datum(rows.union(spark.createDataFrame([(3, other)], "id long, datum string")), "orthometric")
    heights = spark.createDataFrame([(128.0, 100.0), (110.0, 100.0), (134.0, 100.0), (None, 1.0)], "a double, b double")
    assert [r.u for r in heights.select(c.unconverted(F.col("a"), F.col("b")).alias("u")).collect()] == [True, False, True, None]


def test_colours(spark):
    rows = spark.createDataFrame([(0.5, True, False), (None, True, True), (1.0, None, False)], "v double, s boolean, e boolean")
    got = rows.select(pixels.shade(F.col("v"), 0.5).alias("h"), pixels.mask(F.col("s"), F.lit("#10f0ff"), F.lit(2.0), F.col("e")).alias("m")).collect()
    assert [tuple(r.h) for r in got] == [(128, 128, 128, 128), (0, 0, 0, 0), (255, 255, 255, 128)]
    assert [tuple(r.m) for r in got] == [(16, 240, 255, 255), (86, 255, 255, 255), (0, 0, 0, 0)]


def test_readings(spark):
    kind = "z double, slope double, aspect double, weiss int, wood int, bench int, bedding double, wind double"
    rows = spark.createDataFrame([(100.0, 12.4, 350.0, 6, 4, 1, 0.075, 90.0), (None, None, None, 0, 6, 2, None, 90.0), (1.0, 0.2, -1.0, 5, 0, 0, 0.1, None)], kind)
    f = rows.select(readout.facts(*(F.col(k) for k in ("z", "slope", "aspect", "weiss", "wood", "bench"))).alias("f"), readout.judgement(F.col("bedding"), F.col("wind")).alias("j")).collect()
    a, b, d = (r.f for r in f)
    assert a.elevation_ft == ("value", 328) and a.slope_deg == ("value", 12) and a.aspect == ("value", (350, "N")) and a.landform == ("value", "Open slope — bench") and a.morphometry == ("value", "Ridge")
    assert all(x.kind == "unmeasured" and x.value is None for x in b)
    assert d.aspect == ("flat", None) and d.landform == ("value", "Plain") and d.morphometry == ("value", "Planar")
    assert [(r.j.wind_set, r.j.bedding_percent.kind, r.j.bedding_percent.value) for r in f] == [(True, "value", 50), (True, "unmeasured", None), (False, "unmeasured", None)]
