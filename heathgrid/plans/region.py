"""Plans of map areas to keep: how many tiles, how many bytes, what to warn of, and a spread sample of tiles, by arithmetic on bounds.

No tile is listed until `tiles.tiles_over` is asked to, so zooms with billions of tiles cost a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heathgrid.functions.num import half_up
from heathgrid.functions.tiles import longitude_spans, tile_ranges

#: Zooms of a region, levels of overview, bytes of a height tile, most tiles on a device, bytes that are many.
LOWEST, HIGHEST, OVERVIEWS, TILE_BYTES, MOST_TILES, MANY_BYTES = 6, 15, 2, 100_000, 120_000, 500_000_000
#: Most tiles of a served region over all layers, zoom that is warned of, share of free room that may be used.
MOST_SERVED, DEEP, FREE_SHARE = 120_000, 16, 0.9
#: Bytes a tile by layer, and of a layer that isn't listed.
LAYER_BYTES = {
    "satellite": 42_000, "topo": 18_000, "hillshade": 22_000, "lidar_hillshade": 30_000, "contours": 9_000, "slope": 14_000, "aspect": 16_000, "landform": 8_000, "morphometry": 7_000, "benches": 4_000,
    "insolation": 12_000, "land_cover": 6_000, "public_land": 3_000, "parcels": 5_000,
}
OTHER_BYTES = 10_000


def within(c: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, c))


def zoom_range(view: Column, detail: Column) -> Column:
    """Struct of lo, hi: the detail wanted and some levels of overview below the view, within what is served."""
    hi = within(half_up(detail), F.lit(LOWEST), F.lit(HIGHEST)).cast("int")
    return F.struct(within(half_up(view) - OVERVIEWS, F.lit(LOWEST), hi).cast("int").alias("lo"), hi.alias("hi"))


def spans(zoom: Column) -> Column:
    """Array of x0, x1, y0, y1 over the box of columns west, south, east, north: one, or two over the antimeridian."""
    return F.transform(longitude_spans(F.col("west"), F.col("east")), lambda s: tile_ranges(s["west"], F.col("south"), s["east"], F.col("north"), zoom))


def tiles_in(ranges: Column) -> Column:
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + (r["x1"] - r["x0"] + 1) * (r["y1"] - r["y0"] + 1))


def planned(regions: DataFrame, tile_bytes: int = TILE_BYTES, most: int = MOST_TILES) -> DataFrame:
    """regions (west, south, east, north, lo, hi, ...) with by_zoom (zoom, n), n_tiles, bytes and over_limit."""
    by_zoom = F.transform(F.sequence("lo", "hi"), lambda z: F.struct(z.alias("zoom"), tiles_in(spans(z)).alias("n")))
    rows = regions.withColumn("by_zoom", by_zoom).withColumn("n_tiles", F.aggregate("by_zoom", F.lit(0).cast("long"), lambda n, v: n + v["n"]))
    return rows.withColumns({"bytes": F.col("n_tiles") * tile_bytes, "over_limit": F.col("n_tiles") > most})


def warning(when: Column, code: str, amount: Column, layer: Column | None = None) -> Column:
    said = F.struct(F.lit(code).alias("code"), (F.lit(None).cast("string") if layer is None else layer).alias("layer"), amount.cast("long").alias("amount"))
    return F.when(when, said)


def device_warnings(n_tiles: Column, size: Column, free: Column) -> Column:
    """Array of code, layer, amount: too many tiles, many bytes, more than there is room for (not for an unknown room)."""
    return F.array_compact(F.array(warning(n_tiles > MOST_TILES, "over_limit", n_tiles), warning(size > MANY_BYTES, "large", size), warning(size > free * FREE_SHARE, "no_room", size - free)))


def by_layer(plans: DataFrame, layers: str = "layers") -> DataFrame:
    """plans (n_tiles, hi, an array of layer names, ...) with per_layer, total_bytes, heaviest and warnings.

    heaviest is the first layer of the most bytes; it is warned of when it is over half of a download of several.
    """
    bytes_of = F.create_map(*(F.lit(x) for pair in LAYER_BYTES.items() for x in pair))
    per = F.transform(layers, lambda k: F.struct(k.alias("layer"), (F.coalesce(F.try_element_at(bytes_of, k), F.lit(OTHER_BYTES)) * F.col("n_tiles")).cast("long").alias("bytes")))
    rows = plans.withColumn("per_layer", per).withColumn("total_bytes", F.aggregate("per_layer", F.lit(0).cast("long"), lambda n, v: n + v["bytes"]))
    largest = F.array_max(F.transform("per_layer", lambda v: v["bytes"]))
    rows = rows.withColumn("heaviest", F.get(F.filter("per_layer", lambda v: v["bytes"] == largest), F.lit(0)))
    wanted = F.col("n_tiles") * F.size(layers)
    total, top = F.col("total_bytes"), F.col("heaviest.bytes")
    said = F.array(
        warning(wanted > MOST_SERVED, "over_limit", wanted), warning(total > MANY_BYTES, "large", total), warning((top * 2 > total) & (F.size(layers) > 1), "heaviest", top, F.col("heaviest.layer")),
        warning(F.col("hi") >= DEEP, "deep", F.col("hi")),
    )
    return rows.withColumn("warnings", F.array_compact(said))


def reconciled(device: DataFrame, served: DataFrame) -> DataFrame:
    """device (id, n_tiles, bytes, warnings) against served (id, n_tiles, warnings): the device's numbers and whose they are.

    The served warning of size goes, since its bytes aren't those of height tiles; the device's are added, each once. Counts that differ lead the list.
    """
    s = served.select("id", F.col("n_tiles").alias("its_n"), F.col("warnings").alias("its_w"))
    kept = F.filter("its_w", lambda w: w["code"] != "large")
    differ = F.col("its_n") != F.col("n_tiles")
    led = F.array_compact(F.array(warning(differ, "disagrees", F.col("its_n"))))
    out = F.when(F.col("its_n").isNull(), F.col("warnings")).otherwise(F.concat(led, F.array_distinct(F.concat(kept, F.col("warnings")))))
    rows = device.join(s, "id", "left").withColumn("warnings", out)
    return rows.withColumns({"source": F.when(F.col("its_n").isNull(), "device").otherwise("server"), "server_tiles": F.when(differ, F.col("its_n"))}).drop("its_n", "its_w")


def sampled(boxes: DataFrame, zoom: int, most: int) -> DataFrame:
    """boxes (west, south, east, north, ...) with x, y of at most about `most` tiles, spread evenly; all tiles where they are no more.

    Each span gets its share of the budget as columns and rows in the proportions of its sides; a column or row is the
    middle tile of an equal strip. The sample follows from the bounds alone, so it is the same every time. A span has a tile once;
    only boxes whose two spans share a column of tiles can have one twice, and theirs alone are told apart.
    """
    rows = boxes.distinct().withColumn("its_all", spans(F.lit(zoom))).withColumn("its_total", tiles_in(F.col("its_all")))
    rows = rows.withColumn("its_twice", F.coalesce((F.size("its_all") > 1) & (F.get("its_all", F.lit(1))["x1"] >= F.col("its_all")[0]["x0"]), F.lit(False)))
    rows = rows.withColumn("its_r", F.explode("its_all")).withColumns({"its_w": F.col("its_r.x1") - F.col("its_r.x0") + 1, "its_h": F.col("its_r.y1") - F.col("its_r.y0") + 1})
    w, h, one = F.col("its_w"), F.col("its_h"), F.lit(1).cast("long")
    rows = rows.withColumn("its_budget", F.greatest(one, half_up(F.lit(float(most)) * w * h / F.col("its_total"))))
    few = F.col("its_total") <= most
    rows = rows.withColumn("its_nx", F.when(few, w).otherwise(within(half_up(F.sqrt(F.col("its_budget") * w / h)), one, F.least(w, F.col("its_budget")))))
    rows = rows.withColumn("its_ny", F.when(few, h).otherwise(within(F.floor(F.col("its_budget") / F.col("its_nx")), one, h)))
    rows = rows.withColumn("its_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("its_nx") - 1))).withColumn("its_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("its_ny") - 1)))
    x = F.col("its_r.x0") + F.floor((F.col("its_i") + 0.5) * w / F.col("its_nx"))
    y = F.col("its_r.y0") + F.floor((F.col("its_j") + 0.5) * h / F.col("its_ny"))
    own = [*boxes.columns, x.alias("x"), y.alias("y")]
    return rows.where(~F.col("its_twice")).select(*own).union(rows.where("its_twice").select(*own).distinct())
