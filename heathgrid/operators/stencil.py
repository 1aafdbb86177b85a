"""Neighbourhoods of raster cells (grid_id, x, y, ...) by windows along rows and then along columns.

Both windows carry grid_id and a row or column number, so no task needs more than one row of one grid.
Same-key windows of several operators collapse into one pass: two exchanges serve them all. A cell that
isn't there counts as one whose value is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NINE = ("nw", "n", "ne", "w", "c", "e", "sw", "s", "se")


def along(axis: str):
    """The window over a row of cells (axis x) or a column (axis y)."""
    return Window.partitionBy("grid_id", "y" if axis == "x" else "x").orderBy(axis)


def beside(value: Column, axis: str, step: int) -> Column:
    """value of the cell `step` further along axis x or y."""
    window = along(axis)
    return F.when(F.lead(axis, step).over(window) == F.col(axis) + step, F.lead(value, step).over(window))


def nine(cells: DataFrame, value: str = "z", prefix: str = "") -> DataFrame:
    """cells with the 3 x 3 window around each cell in prefix + nw, n, ne, w, c, e, sw, s, se; row 0 is north."""
    row = F.struct(beside(F.col(value), "x", -1).alias("l"), F.col(value).alias("m"), beside(F.col(value), "x", 1).alias("r"))
    out = cells.withColumn("_row", row)
    out = out.withColumn("_up", beside(F.col("_row"), "y", -1)).withColumn("_down", beside(F.col("_row"), "y", 1))
    places = [f"{r}.{k}" for r in ("_up", "_row", "_down") for k in "lmr"]
    return out.select(*cells.columns, *(F.col(p).alias(prefix + n) for p, n in zip(places, NINE, strict=True)))


def box_sums(cells: DataFrame, values: dict[str, Column], radius: int) -> DataFrame:
    """cells with, for each name, the sum of its value over the square of cells within radius; NULL adds nothing."""
    row, col = (along(a).rangeBetween(-radius, radius) for a in "xy")
    out = cells.withColumns({f"_{k}": F.coalesce(F.sum(v).over(row), F.lit(0.0)) for k, v in values.items()})
    return out.withColumns({k: F.sum(f"_{k}").over(col) for k in values}).drop(*(f"_{k}" for k in values))


def offsets(cells: DataFrame, shifts: list[tuple[int, int, int]], value: str) -> DataFrame:
    """grid_id, x, y, k, value (of the cell at x + dx, y + dy) for each shift (k, dx, dy): one row for every cell that is there.

    Cells send their value to the cells that ask for it, so the neighbourhood costs one grouped
    exchange and no join; the shifts are a constant list.
    """
    sent = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, dx, dy in shifts))
    rows = cells.select("grid_id", "x", "y", value, F.explode(sent).alias("o"))
    return rows.select("grid_id", (F.col("x") - F.col("o.dx")).alias("x"), (F.col("y") - F.col("o.dy")).alias("y"), F.col("o.k").alias("k"), value)


def interior(cells: DataFrame, margin: int, bounds: DataFrame | None = None) -> DataFrame:
    """Cells at least `margin` from their grid's edge. bounds: grid_id, x0, x1, y0, y1; else found from cells, a row a grid."""
    if bounds is None:
        bounds = cells.groupBy("grid_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    inside = (F.col("x") >= F.col("x0") + margin) & (F.col("x") <= F.col("x1") - margin) & (F.col("y") >= F.col("y0") + margin) & (F.col("y") <= F.col("y1") - margin)
    return cells.join(bounds, "grid_id").where(inside).select(*cells.columns)
