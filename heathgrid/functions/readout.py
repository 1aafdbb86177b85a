"""What a place's cell says, for people: readings that are a value, flat ground, or not measured; nothing is made up for the last.

A reading is a struct: kind (value, flat, unmeasured) and value (NULL but for value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heathgrid.functions.num import half_up, known
from heathgrid.functions.pixels import unit
from heathgrid.operators import landform

#: Feet of a metre, the bedding score that is shown as all.
FEET, BEDDING_MOST = 3.28084, 0.15


def reading(value: Column, flat: Column | None = None) -> Column:
    kind = F.when(value.isNotNull(), "value")
    kind = kind if flat is None else F.when(flat, "flat").when(value.isNotNull(), "value")
    kind = kind.otherwise("unmeasured")
    return F.struct(kind.alias("kind"), (value if flat is None else F.when(~flat, value)).alias("value"))


def whole(c: Column) -> Column:
    return half_up(known(c.cast("double"))).cast("long")


def facts(z: Column, slope: Column, aspect: Column, weiss: Column, wood: Column, bench: Column) -> Column:
    """Struct of elevation_ft, slope_deg, aspect (deg, octant), landform, morphometry: measured ground alone."""
    steep = whole(slope)
    flat = F.coalesce(steep.isNotNull() & (F.coalesce(known(aspect), F.lit(-1.0)) < 0), F.lit(False))
    side = F.when(steep.isNotNull() & (aspect >= 0), F.struct(whole(aspect).alias("deg"), landform.octant(aspect).alias("octant")))
    form = F.when(weiss > 0, F.concat(landform.label(weiss, landform.WEISS), F.when(bench == 1, " — bench").otherwise("")))
    feature = F.when((wood >= 0) & (wood < len(landform.WOOD) - 1), landform.label(wood, landform.WOOD))
    return F.struct(reading(whole(z * FEET)).alias("elevation_ft"), reading(steep).alias("slope_deg"), reading(side, flat).alias("aspect"), reading(form).alias("landform"), reading(feature).alias("morphometry"))


def judgement(bedding: Column, wind_from: Column) -> Column:
    """Struct of wind_set, bedding_percent: a model's word, kept apart from what was measured; none without a wind."""
    there = wind_from.isNotNull()
    return F.struct(there.alias("wind_set"), reading(F.when(there, whole(unit(known(bedding), BEDDING_MOST) * 100))).alias("bedding_percent"))


def read_points(points: DataFrame, cells: DataFrame, told: Column) -> DataFrame:
    """points (x, y of their cell, ...) with outcome (ok or no_data) and readout: `told` over the cell's columns, NULL off the raster.

    cells: x, y and the columns of `told`; a cell that is there but unknown is ok, its readings unmeasured.
    """
    there = cells.select("x", "y", told.alias("readout"), F.lit(True).alias("its_there"))
    out = points.join(there, ["x", "y"], "left")
    return out.withColumn("outcome", F.when(F.col("its_there"), "ok").otherwise("no_data")).drop("its_there")
