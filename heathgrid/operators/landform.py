"""Landform classes, ring statistics and benches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heathgrid.operators.stencil import offsets
from heathgrid.shared import cut

#: Class names by code.
WEISS = ("Unknown", "Canyon", "Midslope drainage", "Upland drainage", "U-shaped valley", "Plain", "Open slope", "Upper slope", "Local ridge in valley", "Midslope ridge", "Mountain top")
WOOD = ("Planar", "Pit", "Channel", "Pass", "Ridge", "Peak", "Unknown")
OCTANTS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
#: A bench's pad and ring slopes in degrees, ring radius and directions, least ring samples, least cells.
PAD_SLOPE, RING_SLOPE, RING_RADIUS, DIRECTIONS, LEAST_SAMPLES, LEAST_CELLS = 8.0, 18.0, 8, 16, 8, 6
#: Cells along a tile's side, and rows' share of a part's name.
SIZE, WIDE = 64, 1 << 32


def weiss(small: Column, large: Column, slope: Column, plain_slope: float = 5.0, threshold: float = 1.0) -> Column:
    """Code of the class of a cell's z-scored positions in a small and a large window: 3 bands x 3 bands, the middle one split by slope."""
    band = lambda z: F.when(z <= -threshold, 0).when(z >= threshold, 2).otherwise(1)
    place = band(small) * 3 + band(large)
    code = F.when(place < 4, place + 1).when(place > 4, place + 2).when(slope <= plain_slope, 5).otherwise(6)
    return F.when(small.isNull() | large.isNull() | slope.isNull(), 0).otherwise(code).cast("int")


def curvature_tolerance(cell_size: float | None = None, explicit: float | None = None) -> float:
    if explicit is not None:
        return explicit
    return 0.015 / cell_size if cell_size and cell_size > 0 else 5e-4


def wood(slope: Column, cross: Column, most: Column, least: Column, tolerance: float, slope_tolerance: float = 1.5) -> Column:
    """Code of the morphometric feature: on a slope by the curvature across it, else by the signs of the principal curvatures."""
    up, down = lambda c: c > tolerance, lambda c: c < -tolerance
    flat = (
        F.when(up(most) & up(least), 5).when(down(most) & down(least), 1).when(up(most) & down(least), 3)
        .when(up(most) | up(least), 4).when(down(most) | down(least), 2).otherwise(0)
    )
    sloped = F.when(up(cross), 4).when(down(cross), 2).otherwise(0)
    return F.when(slope.isNull() | cross.isNull() | most.isNull(), 6).when(slope > slope_tolerance, sloped).otherwise(flat).cast("int")


def label(code: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), code + 1)


def octant(aspect: Column, slope: Column | None = None) -> Column:
    """N, NE, ... of an aspect; flat below 0, unknown where the slope is."""
    named = F.element_at(F.array(*map(F.lit, OCTANTS)), (F.floor((aspect + 22.5) / 45.0) % 8 + 1).cast("int"))
    out = F.when(aspect.isNull() | (aspect < 0), F.lit("flat")).otherwise(named)
    return out if slope is None else F.when(slope.isNull(), F.lit("unknown")).otherwise(out)


def ring_offsets(radius: int = RING_RADIUS, directions: int = DIRECTIONS) -> list[tuple[int, int, int]]:
    """(k, dx, dy) of evenly spread directions, rounded to cells."""
    near = lambda v: math.floor(v + 0.5)
    return [(k, near(math.cos(2 * math.pi * k / directions) * radius), near(math.sin(2 * math.pi * k / directions) * radius)) for k in range(directions)]


def ring_stats(surfaced: DataFrame, radius: int = RING_RADIUS, steep: float = RING_SLOPE, directions: int = DIRECTIONS) -> DataFrame:
    """Cells (grid_id, x, y, slope, ...) with ring_samples, ring_missing, ring_steep, ring_mean of the slopes on a ring; places beyond the cells count for nothing."""
    near = offsets(surfaced, ring_offsets(radius, directions), "slope")
    stats = near.groupBy("grid_id", "x", "y").agg(
        F.count("slope").cast("int").alias("ring_samples"), F.sum(F.col("slope").isNull().cast("int")).cast("int").alias("ring_missing"),
        F.sum((F.col("slope") >= steep).cast("int")).alias("_steep"), F.avg("slope").alias("ring_mean"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    joined = surfaced.join(stats, ["grid_id", "x", "y"], "left")
    return joined.select(*surfaced.columns, zero("ring_samples").alias("ring_samples"), zero("ring_missing").alias("ring_missing"), zero("_steep").alias("ring_steep"), "ring_mean")


def bench_candidate(slope: Column, samples: Column, steep: Column, pad: float = PAD_SLOPE) -> Column:
    """1 bench, 0 none, 2 unmeasured, before small ones go: level ground with a steep half of a ring around it."""
    found = (slope <= pad) & (samples >= LEAST_SAMPLES) & (2 * steep >= samples)
    return F.when(slope.isNull(), 2).when(found, 1).otherwise(0).cast("int")


def labels(mask: np.ndarray) -> np.ndarray:
    """The least index of each set cell's 4-connected group; mask.size where not set. Minima sweep along rows and columns, both ways."""
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape), mask.size)
    while True:
        before = label.copy()
        for axis in (0, 1):
            for flip in (False, True):
                v = np.flip(label, axis) if flip else label
                m = np.flip(mask, axis) if flip else mask
                for k in range(1, v.shape[axis]):
                    a, b = (v[k - 1], v[k]) if axis == 0 else (v[:, k - 1], v[:, k])
                    ok = (m[k - 1] & m[k]) if axis == 0 else (m[:, k - 1] & m[:, k])
                    np.minimum(b, a, out=b, where=ok)
        if (label == before).all():
            return label


def labelled(cells: DataFrame, size: int = SIZE) -> DataFrame:
    """grid_id, x, y, part: cells (grid_id, x, y) in 4-connected parts within tiles; a part is named by its first cell. A task's group is one tile."""

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(tile["x"].iloc[0]) // size * size, int(tile["y"].iloc[0]) // size * size
        x, y = tile["x"].to_numpy() - x0, tile["y"].to_numpy() - y0
        mask = np.zeros((size, size), dtype=bool)
        mask[y, x] = True
        first = labels(mask)[y, x]
        return tile[["grid_id", "x", "y"]].assign(part=(first // size + y0).astype("int64") * WIDE + first % size + x0)

    keys = ["grid_id", F.floor(F.col("x") / size), F.floor(F.col("y") / size)]
    return cells.select("grid_id", "x", "y").groupBy(*keys).applyInPandas(run, f"grid_id {dict(cells.dtypes)['grid_id']}, x int, y int, part long")


def met(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """grid_id, a, b: parts that touch across a border of tiles, by an equi-join of the cells along borders."""
    found = None
    for c, o in (("x", "y"), ("y", "x")):
        left = parts.where(F.pmod(F.col(c), F.lit(size)) == size - 1).select("grid_id", (F.col(c) + 1).alias(c), o, F.col("part").alias("a"))
        right = parts.where(F.pmod(F.col(c), F.lit(size)) == 0).select("grid_id", c, o, F.col("part").alias("b"))
        pairs = left.join(right, ["grid_id", c, o]).select("grid_id", "a", "b")
        found = pairs if found is None else found.union(pairs)
    return found.distinct()


def wholes(touching: DataFrame) -> DataFrame:
    """grid_id, part, whole: the least part that each part of touching pairs leads to.

    Each round takes the least name among a part and its neighbours, and then that name's own; names only
    fall, and a chain's length halves, until nothing changes. Rounds are checkpointed.
    """
    both = cut(touching.union(touching.select("grid_id", "b", "a")).toDF("grid_id", "part", "beside"))
    at = cut(both.select("grid_id", "part", F.col("part").alias("whole")).distinct())
    while True:
        beside = both.join(at.select("grid_id", F.col("part").alias("beside"), F.col("whole").alias("its")), ["grid_id", "beside"]).groupBy("grid_id", "part").agg(F.min("its").alias("its"))
        lower = at.join(beside, ["grid_id", "part"]).select("grid_id", "part", F.col("whole").alias("old"), F.least("whole", "its").alias("whole"))
        jump = at.select("grid_id", F.col("part").alias("whole"), F.col("whole").alias("further"))
        step = cut(lower.join(jump, ["grid_id", "whole"], "left").select("grid_id", "part", "old", F.least("whole", F.coalesce("further", "whole")).alias("whole")))
        at = step.select("grid_id", "part", "whole")
        if not step.where("old != whole").limit(1).count():
            return at


def groups(cells: DataFrame, size: int = SIZE) -> DataFrame:
    """grid_id, x, y, whole, cells_in: the 4-connected group of each cell (grid_id, x, y) over a raster of any extent, and its size.

    Tiles label their own parts, borders tell which parts are one, and sizes add up by part before they meet.
    """
    parts = cut(labelled(cells, size))
    joined = wholes(met(parts, size))
    sizes = parts.groupBy("grid_id", "part").agg(F.count("*").alias("n")).join(joined, ["grid_id", "part"], "left").withColumn("whole", F.coalesce("whole", "part"))
    totals = sizes.groupBy("grid_id", "whole").agg(F.sum("n").alias("cells_in"))
    named = sizes.select("grid_id", "part", "whole").join(totals, ["grid_id", "whole"])
    return parts.join(named, ["grid_id", "part"]).select("grid_id", "x", "y", "whole", "cells_in")


def remove_small(cells: DataFrame, flag: str = "bench", least: int = LEAST_CELLS, size: int = SIZE) -> DataFrame:
    """cells with flag 1 turned to 0 in 4-connected groups of fewer than `least` cells; a task holds one tile."""
    small = groups(cells.where(F.col(flag) == 1), size).where(F.col("cells_in") < least).select("grid_id", "x", "y", F.lit(True).alias("its_small"))
    kind = dict(cells.dtypes)[flag]
    return cells.join(small, ["grid_id", "x", "y"], "left").withColumn(flag, F.when(F.col("its_small"), F.lit(0).cast(kind)).otherwise(F.col(flag))).select(*cells.columns)


def bench_counts(cells: DataFrame, flag: str = "bench") -> DataFrame:
    """grid_id, benches, others, unmeasured and the share of benches in what was measured (NULL if nothing was)."""
    tally = cells.groupBy("grid_id").agg(*(F.sum((F.col(flag) == k).cast("long")).alias(n) for k, n in ((1, "benches"), (0, "others"), (2, "unmeasured"))))
    return tally.withColumn("bench_share", F.try_divide(F.col("benches").cast("double"), (F.col("benches") + F.col("others")).cast("double")))
