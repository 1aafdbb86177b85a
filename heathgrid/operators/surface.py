"""Slope, aspect, curvature, ruggedness and topographic position of raster cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heathgrid.functions.num import clamp01
from heathgrid.operators.stencil import NINE, box_sums, nine
from heathgrid.shared import cut

#: Share of a window that must be known, and how far its known cells' centroid may lie off, in radii.
TPI_QUORUM, TPI_OFFSET, VRM_QUORUM = 0.5, 0.05, 0.75
#: Fixed value: a spread up to this is no spread.
FLAT_SIGMA = 1e-3


def all_known() -> Column:
    out = F.col("c").isNotNull()
    for k in NINE:
        out &= F.col(k).isNotNull()
    return out


def surface(cells: DataFrame, cell_size: float) -> DataFrame:
    """cells (grid_id, x, y, z, ...) with dzdx, dzdy (towards south), slope in degrees (NULL: unmeasured) and aspect (-1: flat or unmeasured)."""
    own = nine(cells)
    weigh = lambda a, b, c: F.col(a) + 2.0 * F.col(b) + F.col(c)
    east = (weigh("ne", "e", "se") - weigh("nw", "w", "sw")) / F.lit(8.0 * cell_size)
    south = (weigh("sw", "s", "se") - weigh("nw", "n", "ne")) / F.lit(8.0 * cell_size)
    out = own.withColumn("dzdx", F.when(all_known(), east)).withColumn("dzdy", F.when(all_known(), south)).drop(*NINE)
    rise = F.hypot("dzdx", "dzdy")
    azimuth = F.degrees(F.atan2(-F.col("dzdx"), F.col("dzdy")))
    aspect = F.when(rise.isNull() | (rise < 1e-9), F.lit(-1.0)).otherwise(F.when(azimuth < 0, azimuth + 360.0).otherwise(azimuth))
    return out.withColumn("slope", F.degrees(F.atan(rise))).withColumn("aspect", aspect)


def curvature(cells: DataFrame, cell_size: float) -> DataFrame:
    """cells with the curvatures of the quadratic through each 3 x 3 window."""
    own, s = nine(cells), float(cell_size)
    v = {k: F.col(k) for k in NINE}
    sides = v["nw"] + v["w"] + v["sw"] + v["ne"] + v["e"] + v["se"]
    a = (sides - 2.0 * (v["n"] + v["c"] + v["s"])) / F.lit(6 * s * s)
    b = (v["nw"] + v["n"] + v["ne"] + v["sw"] + v["s"] + v["se"] - 2.0 * (v["w"] + v["c"] + v["e"])) / F.lit(6 * s * s)
    c = (v["ne"] + v["sw"] - v["nw"] - v["se"]) / F.lit(4 * s * s)
    d = (v["ne"] + v["e"] + v["se"] - v["nw"] - v["w"] - v["sw"]) / F.lit(6 * s)
    e = (v["nw"] + v["n"] + v["ne"] - v["sw"] - v["s"] - v["se"]) / F.lit(6 * s)
    own = own.select(*cells.columns, *(F.when(all_known(), x).alias(f"_{k}") for k, x in (("a", a), ("b", b), ("c", c), ("d", d), ("e", e))))
    a, b, c, d, e = (F.col(f"_{k}") for k in "abcde")
    p = d * d + e * e
    along, across = a * d * d + b * e * e + c * d * e, b * d * d + a * e * e - c * d * e
    sloped = lambda x: F.when(p < 1e-12, F.lit(0.0)).otherwise(x)
    spread = F.sqrt((a - b) * (a - b) + c * c)
    return own.withColumns({
        "curvature_profile": sloped(2.0 * along / (p * F.pow(p + 1.0, 1.5))), "curvature_plan": sloped(-2.0 * across / F.pow(p, 1.5)),
        "longitudinal": sloped(-2.0 * along / p), "cross_sectional": sloped(-2.0 * across / p),
        "max_curvature": spread - a - b, "min_curvature": -spread - a - b,
    }).drop(*(f"_{k}" for k in "abcde"))


def ruggedness(cells: DataFrame) -> DataFrame:
    """cells with ruggedness: the root of the summed squared differences to the eight neighbours."""
    total = F.lit(0.0)
    for k in NINE:
        total += (F.col(k) - F.col("c")) * (F.col(k) - F.col("c"))
    return nine(cells).withColumn("ruggedness", F.when(all_known(), F.sqrt(total))).drop(*NINE)


def vector_ruggedness(surfaced: DataFrame, radius: int = 4) -> DataFrame:
    """Cells of surface() with vrm: one less the length of the mean unit normal in the square of the radius."""
    length = F.sqrt(F.col("dzdx") * F.col("dzdx") + F.col("dzdy") * F.col("dzdy") + 1.0)
    parts = {"_nx": -F.col("dzdx") / length, "_ny": F.col("dzdy") / length, "_nz": 1.0 / length, "_nn": F.when(F.col("dzdx").isNotNull(), 1.0)}
    summed = box_sums(surfaced, parts, radius)
    vrm = 1.0 - F.sqrt(F.pow("_nx", F.lit(2.0)) + F.pow("_ny", F.lit(2.0)) + F.pow("_nz", F.lit(2.0))) / F.col("_nn")
    enough = F.col("z").isNotNull() & (F.col("_nn") >= F.lit(VRM_QUORUM * (2 * radius + 1) ** 2))
    return summed.withColumn("vrm", F.when(enough, clamp01(vrm))).drop("_nx", "_ny", "_nz", "_nn")


def tpi(cells: DataFrame, radius: int, name: str = "tpi", inner: int = 0) -> DataFrame:
    """cells with each cell's height above the mean of the square of the radius, less the inner square if there is one.

    NULL where too little of the window is known, or where what is known lies to one side.
    """
    parts = {"_z": F.col("z"), "_n": F.when(F.col("z").isNotNull(), 1.0), "_x": F.when(F.col("z").isNotNull(), F.col("x").cast("double")), "_y": F.when(F.col("z").isNotNull(), F.col("y").cast("double"))}
    out, area = box_sums(cells, parts, radius), (2 * radius + 1) ** 2
    total = {k: F.col(k) for k in parts}
    if inner:
        out = box_sums(out, {f"{k}_in": v for k, v in parts.items()}, inner)
        total = {k: F.col(k) - F.col(f"{k}_in") for k in parts}
        area -= (2 * inner + 1) ** 2
    dx, dy = total["_x"] / total["_n"] - F.col("x"), total["_y"] / total["_n"] - F.col("y")
    even = (total["_n"] == F.lit(float(area))) | (dx * dx + dy * dy <= F.lit((TPI_OFFSET * radius) ** 2))
    enough = F.col("z").isNotNull() & (total["_n"] > 0) & (total["_n"] >= F.lit(TPI_QUORUM * area))
    value = F.when(enough & even, F.col("z") - total["_z"] / total["_n"])
    return out.withColumn(name, value).select(*cells.columns, name)


def standardized(cells: DataFrame, value: str, name: str) -> DataFrame:
    """cells with value's z-score within its grid: 0 everywhere if the grid has no known value, and where the spread is none.

    Each grid's moments are one row, partly summed before the shuffle, joined back by grid_id.
    """
    moments = cells.groupBy("grid_id").agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sigma"), F.count(value).alias("_known"))
    score = F.when(F.col("_known") == 0, F.lit(0.0)).when(F.col(value).isNotNull(), F.when(F.col("_sigma") <= FLAT_SIGMA, F.lit(0.0)).otherwise((F.col(value) - F.col("_mean")) / F.col("_sigma")))
    return cells.join(moments, "grid_id").withColumn(name, score).drop("_mean", "_sigma", "_known")


def fill_pass(cells: DataFrame) -> DataFrame:
    """cells with each unknown z replaced by the mean of the known ones of its 3 x 3 window."""
    summed = box_sums(cells, {"_z": F.col("z"), "_n": F.when(F.col("z").isNotNull(), 1.0)}, 1)
    return summed.withColumn("z", F.coalesce("z", F.when(F.col("_n") > 0, F.col("_z") / F.col("_n")))).drop("_z", "_n")


def fill_voids(cells: DataFrame, passes: int = 8) -> DataFrame:
    """fill_pass, up to so many times, until it fills nothing more; each pass is checkpointed."""
    left = cells.where("z is null").count()
    for _ in range(passes):
        if not left:
            break
        cells = cut(fill_pass(cells))
        now = cells.where("z is null").count()
        if now == left:
            break
        left = now
    return cells


def height_range(cells: DataFrame) -> DataFrame:
    """grid_id and its least and greatest known height; 0 if there is none."""
    return cells.groupBy("grid_id").agg(F.coalesce(F.min("z"), F.lit(0.0)).alias("min_z"), F.coalesce(F.max("z"), F.lit(0.0)).alias("max_z"))
