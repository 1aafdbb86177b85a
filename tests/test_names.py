import struct
import zlib

from pyspark.sql import functions as F

from heathgrid.functions import names
from heathgrid.sources import png


def test_one_meter_names(spark):
    rows = ["USGS_1M_16_x27y405_AL_25Co_B1_2017.tif", "USGS_one_meter_x27y405_OH_x1y2_B.tif", "usgs_1m_x1y2_P.TIF", "USGS_13_n40w084.tif", "USGS_1M_16_x27y405.tif"]
    found = [r.p and tuple(r.p) for r in spark.createDataFrame([(x,) for x in rows], "n string").select(names.parse_one_meter(F.col("n")).alias("p")).collect()]
    assert found == [("1M_zone", 16, 27, 405, "AL_25Co_B1_2017"), ("one_meter", None, 27, 405, "OH_x1y2_B"), ("1m", None, 1, 2, "P"), None, None]


def test_candidates_come_zoned_first(spark):
    point = spark.createDataFrame([(1, -84.2, 39.7)], "id int, lng double, lat double")
    tile = point.select(names.one_meter_tile(F.col("lng"), F.col("lat")).alias("t")).first().t
    lines = [f"https://x/USGS_one_meter_x{tile.x}y{tile.y}_A_old.tif", f"USGS_1M_{tile.zone}_x{tile.x}y{tile.y}_Z_new.tif", "nothing", f"USGS_1M_{tile.zone}_x{tile.x + 1}y{tile.y}_far.tif"]
    index = names.inverted(names.manifest(spark.createDataFrame([(x,) for x in lines], "value string")))
    found = names.candidates(point, index).orderBy("rank").collect()
    assert [(r.project, r.zoned) for r in found][0] == ("Z_new", True) and {r.project for r in found} == {"Z_new", "A_old"}


def test_texts(spark):
    one = spark.range(1).select(names.bytes_text(F.lit(1.44e9)).alias("a"), names.bytes_text(F.lit(320e6)).alias("b"), names.bytes_text(F.lit(12)).alias("c"), names.percent(F.lit(0.999)).alias("d"), names.percent(F.lit(0.0)).alias("e")).first()
    assert tuple(one) == ("1.4 GB", "320 MB", "12 B", 99, 1)


def test_png(spark):
    cells = spark.createDataFrame([("g", 0, 0, 255, 0, 0, 255), ("g", 1, 1, 0, 9, 0, 128)], "grid_id string, x int, y int, r int, g int, b int, a int")
    data = bytes(png.images(cells).first().png)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (2, 2)
    start = data.index(b"IDAT") + 4
    assert zlib.decompress(data[start : data.index(b"IEND") - 8]) == bytes([0, 255, 0, 0, 255, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 9, 0, 128])
