"""File names of published elevation tiles, the index over them, and short texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heathgrid.functions import tiles
from heathgrid.functions.num import clamp, half_up

#: The pattern of a one-metre tile's file name, with zone (only some have one), x, y and project.
ONE_METER = r"(?i)^USGS_(?:1M_(\d{1,2})_|1m_|one_meter_)x(\d+)y(\d+)_(.+)\.tif$"
KEYS, MOST_PROBES = ("one_meter", "1M_zone", "1m"), 12


def one_third_url(lng: Column, lat: Column, bucket: str) -> Column:
    cell = tiles.one_degree_cell(lng, lat)
    return F.concat(F.lit(f"{bucket}/StagedProducts/Elevation/13/TIFF/current/"), cell, F.lit("/USGS_13_"), cell, F.lit(".tif"))


def stems(zone: Column, x: Column, y: Column) -> Column:
    """The names that a tile may stand under, in the order to try them."""
    at = F.format_string("x%dy%d", x, y)
    return F.array(F.concat(F.lit("USGS_one_meter_"), at), F.concat(F.format_string("USGS_1M_%d_", zone), at), F.concat(F.lit("USGS_1m_"), at))


def one_meter_tile(lng: Column, lat: Column, zone: Column | None = None) -> Column:
    """Struct of zone, x (its west edge) and y (its north edge), in ten kilometres, and stems."""
    u = tiles.utm(lng, lat, zone)
    x, y = F.floor(u["easting"] / 10000.0), F.floor(u["northing"] / 10000.0) + 1
    return F.struct(u["zone"].alias("zone"), x.alias("x"), y.alias("y"), stems(u["zone"], x, y).alias("stems"))


def parse_one_meter(name: Column) -> Column:
    """Struct of stem, zone (NULL if the name has none), x, y, project; NULL for other names."""
    part = lambda k: F.regexp_extract(name, ONE_METER, k)
    stem = F.when(part(1) != "", KEYS[1]).when(name.rlike("(?i)^USGS_one_meter_"), KEYS[0]).otherwise(KEYS[2])
    return F.when(name.rlike(ONE_METER), F.struct(stem.alias("stem"), F.when(part(1) != "", part(1)).cast("int").alias("zone"), part(2).cast("int").alias("x"), part(3).cast("int").alias("y"), part(4).alias("project")))


def manifest(lines: DataFrame, column: str = "value") -> DataFrame:
    """stem, zone, x, y, project of the file names in a manifest's lines; lines with none are left out."""
    parsed = parse_one_meter(F.element_at(F.split(F.trim(F.col(column)), "/"), -1))
    return lines.select(parsed.alias("p")).where("p is not null").select("p.*")


def inverted(files: DataFrame) -> DataFrame:
    """key (zone or *, x, y), projects: in the order of their names."""
    key = F.concat_ws("/", F.coalesce(F.col("zone").cast("string"), F.lit("*")), F.col("x").cast("string"), F.col("y").cast("string"))
    return files.groupBy(key.alias("key")).agg(F.array_sort(F.collect_set("project")).alias("projects"))


def candidates(points: DataFrame, index: DataFrame) -> DataFrame:
    """points (id, lng, lat) with rank, project, zone, zoned: tiles to try, those whose name has the zone first, then by project and zone.

    A point near a zone's border may lie in a neighbour zone's tile, so three zones are asked for.
    """
    own = tiles.utm_zone(F.col("lng"))
    zones = F.array(own, (own + 58) % 60 + 1, own % 60 + 1)
    asked = points.withColumn("zone", F.explode(zones)).withColumn("_t", one_meter_tile(F.col("lng"), F.col("lat"), F.col("zone")))
    ask = lambda z, zoned: F.struct(F.concat_ws("/", z, F.col("_t.x").cast("string"), F.col("_t.y").cast("string")).alias("key"), F.lit(zoned).alias("zoned"))
    keyed = asked.withColumn("_k", F.explode(F.array(ask(F.col("zone").cast("string"), True), ask(F.lit("*"), False)))).withColumn("key", F.col("_k.key"))
    found = keyed.join(index, "key").select("id", "lng", "lat", "zone", F.col("_k.zoned").alias("zoned"), F.explode("projects").alias("project"))
    best = F.row_number().over(Window.partitionBy("id", "project", "zone").orderBy(F.col("zoned").desc()))
    rows = found.withColumn("_n", best).where("_n = 1").drop("_n")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.col("zoned").desc(), "project", "zone"))).where(F.col("rank") <= MOST_PROBES)


def bytes_text(n: Column) -> Column:
    whole = lambda d, unit: F.concat(half_up(n / d).cast("string"), F.lit(f" {unit}"))
    return F.when(n >= 1e9, F.concat(F.format_string("%.1f", n / 1e9), F.lit(" GB"))).when(n >= 1e6, whole(1e6, "MB")).when(n >= 1e3, whole(1e3, "kB")).otherwise(whole(1.0, "B"))


def percent(share: Column) -> Column:
    """A part's percentage, never 0 or 100."""
    return clamp(half_up(share * 100), 1, 99).cast("int")


def area_text(ha: Column) -> Column:
    return F.format_string("%.1f ha (%.1f ac)", ha, ha * 2.4710538147)


def next_name(prefix: Column, count: Column) -> Column:
    return F.format_string("%s %d", prefix, count + 1)
