"""Rasters as square tiles that know their neighbours' borders.

A tile is one row: grid_id, tx, ty and its heights, row by row from the north-west. Each tile sends its
eight neighbours the strip, or corner, that lies within their halo, and itself whole; one grouping by
tile brings them together. A tile's group is nine parts at most, whatever the size of the raster, so a mosaic has as
many tasks as tiles, and windows and rays that end within the halo are those of the whole raster.

Heights of a neighbour that isn't there are unknown, as is whatever depends on them. A halo deeper than a
tile would need more than the eight neighbours: InsufficientHalo.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heathgrid.functions import tiles as places
from heathgrid.functions.num import known

SIZE = 64
#: Fixed value: passes that fill voids from their neighbours.
FILL_PASSES = 8


class InsufficientHalo(ValueError):
    def __init__(self, required: int, available: int, layers: list[str]):
        super().__init__(f"{', '.join(layers)}: a halo of {required} cells is needed, {available} are there")
        self.required, self.available, self.layers = required, available, layers


def deal(cells: DataFrame, size: int = SIZE) -> DataFrame:
    """grid_id, tx, ty, z array of cells (grid_id, x, y, z); a cell that isn't there is unknown, one that is there twice counts once."""
    tile = lambda c: F.floor(F.col(c) / size).cast("int")
    place = F.pmod(F.col("y"), F.lit(size)) * size + F.pmod(F.col("x"), F.lit(size))
    rows = cells.select("grid_id", tile("x").alias("tx"), tile("y").alias("ty"), place.cast("int").alias("place"), known(F.col("z").cast("double")).alias("z"))
    met = rows.groupBy("grid_id", "tx", "ty").agg(F.sort_array(F.collect_list(F.struct("place", "z"))).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column("own")[k].values
                z = np.full(size * size, np.nan)
                z[own.field("place").to_numpy()] = own.field("z").to_numpy(zero_copy_only=False)
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in ("grid_id", "tx", "ty")), arrays([z])], names=["grid_id", "tx", "ty", "z"])

    return met.mapInArrow(run, f"grid_id {dict(cells.dtypes)['grid_id']}, tx int, ty int, z array<double>")


def arrays(found: list[np.ndarray]) -> pa.Array:
    """Arrays of heights as an Arrow column; NaN becomes NULL."""
    flat = np.concatenate([x.ravel() for x in found]) if found else np.zeros(0)
    ends = np.cumsum([0] + [x.size for x in found]).astype("<i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, from_pandas=True))


def strips(tiles: DataFrame, halo: int, size: int = SIZE) -> DataFrame:
    """grid_id, tx, ty, dx, dy, part: what each tile gets from the tile at (tx + dx, ty + dy), itself included."""
    if halo > size:
        raise InsufficientHalo(halo, size, ["mosaic"])
    span = {-1: (size - halo, halo), 0: (0, size), 1: (0, halo)}  # of the sender's columns, or rows, by where it lies

    def cut(dx: int, dy: int) -> Column:
        (left, w), (top, h) = span[dx], span[dy]
        if w == size:
            return F.slice("z", top * size + 1, h * size)
        return F.flatten(F.transform(F.sequence(F.lit(top), F.lit(top + h - 1)), lambda r: F.slice("z", r * size + left + 1, F.lit(w))))

    around = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if halo or dx == dy == 0]
    sent = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), cut(dx, dy).alias("part")) for dx, dy in around))
    rows = tiles.select("grid_id", "tx", "ty", F.explode(sent).alias("s"))
    return rows.select("grid_id", (F.col("tx") - F.col("s.dx")).alias("tx"), (F.col("ty") - F.col("s.dy")).alias("ty"), "s.*")


def assembled(tiles: DataFrame, halo: int, size: int = SIZE) -> DataFrame:
    """grid_id, tx, ty, parts (dx, dy, part) of every tile that is there itself."""
    met = strips(tiles, halo, size).groupBy("grid_id", "tx", "ty").agg(F.collect_list(F.struct("dx", "dy", "part")).alias("parts"), F.max((F.col("dx") == 0) & (F.col("dy") == 0)).alias("there"))
    return met.where("there").drop("there")


def padded(parts: pa.StructArray, halo: int, size: int) -> np.ndarray:
    """A tile and its halo as one array."""
    n = size + 2 * halo
    z = np.full((n, n), np.nan)
    at = {-1: slice(0, halo), 0: slice(halo, halo + size), 1: slice(halo + size, n)}
    for k, (dx, dy) in enumerate(zip(parts.field("dx").to_pylist(), parts.field("dy").to_pylist(), strict=True)):
        place = z[at[dy], at[dx]]
        place[...] = parts.field("part")[k].values.to_numpy(zero_copy_only=False).reshape(place.shape)
    return z


def haloed(tiles: DataFrame, halo: int, size: int = SIZE, fill: bool = False) -> DataFrame:
    """grid_id, tx, ty, z: every tile as a square with its halo, voids filled from their neighbours if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                z = padded(batch.column("parts")[k].values, halo, size)
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in ("grid_id", "tx", "ty")), arrays([filled(z) if fill else z])], names=["grid_id", "tx", "ty", "z"])

    return assembled(tiles, halo, size).mapInArrow(run, f"grid_id {dict(tiles.dtypes)['grid_id']}, tx int, ty int, z array<double>")


def cells_of(squares: DataFrame, halo: int, size: int = SIZE, ring: bool = True) -> DataFrame:
    """grid_id, tx, ty, x, y, z of the cells of haloed tiles; x and y are those of the whole raster. ring: the halo's cells too."""
    n = size + 2 * halo
    rows = squares.select("grid_id", "tx", "ty", F.posexplode("z").alias("at", "z"))
    x, y = F.col("at") % n - halo, F.floor(F.col("at") / n).cast("int") - halo
    own = x.between(0, size - 1) & y.between(0, size - 1)
    rows = rows if ring else rows.where(own)
    return rows.select("grid_id", "tx", "ty", (x + F.col("tx") * size).cast("int").alias("x"), (y + F.col("ty") * size).cast("int").alias("y"), "z")


def filled(z: np.ndarray, passes: int = FILL_PASSES) -> np.ndarray:
    """Unknown cells take the mean of what is known among their eight neighbours, pass after pass; sums run from north-west to south-east."""
    z = z.copy()
    h, w = z.shape
    for _ in range(passes):
        unknown = np.isnan(z)
        if not unknown.any():
            break
        wide = np.pad(z, 1, constant_values=np.nan)
        total, count = np.zeros_like(z), np.zeros(z.shape, dtype=int)
        for dy in range(3):
            for dx in range(3):
                v = wide[dy : dy + h, dx : dx + w]
                there = ~np.isnan(v)
                total[there] += v[there]
                count += there
        ready = unknown & (count > 0)
        if not ready.any():
            break
        z[ready] = total[ready] / count[ready]
    return z


def over_tiles(cells: DataFrame, kernels: dict[str, tuple[Callable, str]], halo: int, size: int = SIZE) -> DataFrame:
    """grid_id, x, y, z of every cell of the tiles, with a column for each name.

    kernels has (function of heights and arguments, Spark type, arguments) by name; a function gets a
    tile with its halo and returns an array of that shape, NaN where unknown. Only cells that are there or share a
    tile with one come out; ask for z to be known, or join, for less.
    """
    kinds = {name: v[1] for name, v in kernels.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = slice(halo, halo + size)
        for batch in batches:
            for k in range(batch.num_rows):
                z = padded(batch.column("parts")[k].values, halo, size)
                tx, ty, g = batch.column("tx")[k].as_py(), batch.column("ty")[k].as_py(), batch.column("grid_id")[k]
                y, x = np.mgrid[0:size, 0:size]
                columns = [pa.array([g.as_py()] * (size * size), type=batch.column("grid_id").type), pa.array((x.ravel() + tx * size).astype(np.int32)), pa.array((y.ravel() + ty * size).astype(np.int32)), pa.array(z[own, own].ravel(), from_pandas=True)]
                for kernel, kind, *args in kernels.values():
                    found = kernel(z, *args)[own, own].ravel()
                    columns.append(pa.array(found, from_pandas=True).cast(pa.int32() if kind == "int" else pa.float64(), safe=False))
                yield pa.RecordBatch.from_arrays(columns, names=["grid_id", "x", "y", "z", *kinds])

    met = assembled(deal(cells, size), halo, size)
    return met.mapInArrow(run, f"grid_id {dict(cells.dtypes)['grid_id']}, x int, y int, z double, " + ", ".join(f"{k} {v}" for k, v in kinds.items()))


# ---- mosaics of map tiles ---------------------------------------------------------------------------


def pixel_in_mosaic(lng: Column, lat: Column, zoom: Column, x0: Column, y0: Column, size: int = 256) -> Column:
    """Struct of x, y: the whole pixel of a place in a mosaic whose north-west tile is (x0, y0); halves go up."""
    at = lambda v, first: F.floor((v - first) * size + 0.5).cast("long")
    return F.struct(at(places.tile_x(lng, zoom), x0).alias("x"), at(places.tile_y(lat, zoom), y0).alias("y"))


def place_of_pixel(x: Column, y: Column, zoom: Column, x0: Column, y0: Column, size: int = 256) -> Column:
    """Struct of lng, lat."""
    return F.struct(places.lng_of(x0 + x / size, zoom).alias("lng"), places.lat_of(y0 + y / size, zoom).alias("lat"))


def over_boxes(boxes: DataFrame, tiles: DataFrame, zoom: int, halo: int, size: int = 256) -> DataFrame:
    """id, x, y, z, inside: the mosaic of each box (id, west, south, east, north) out of tiles (tx, ty, z) of that zoom.

    x and y are pixels from the box's north-west tile. A ring of neighbour tiles gives `halo` cells on every side
    (inside is false there); a tile that isn't there leaves its cells unknown. One equi-join by tile brings
    tiles to boxes, and only strips of the ring's tiles are opened.
    """
    if halo > size:
        raise InsufficientHalo(halo, size, ["mosaic"])
    r = places.tile_ranges(F.col("west"), F.col("south"), F.col("east"), F.col("north"), F.lit(zoom))
    ring = 1 if halo else 0
    wanted = boxes.select("id", r.alias("r")).select("id", "r", F.explode(F.sequence(F.col("r.x0") - ring, F.col("r.x1") + ring)).alias("tx")).withColumn("ty", F.explode(F.sequence(F.col("r.y0") - ring, F.col("r.y1") + ring)))
    met = wanted.join(tiles.select(F.col("tx").cast("long").alias("tx"), F.col("ty").cast("long").alias("ty"), "z"), ["tx", "ty"], "left")
    x = (F.col("tx") - F.col("r.x0")) * size + F.col("at") % size
    y = (F.col("ty") - F.col("r.y0")) * size + F.floor(F.col("at") / size)
    heights = F.coalesce("z", F.array_repeat(F.lit(None).cast("double"), size * size))
    rows = met.select("id", "r", "tx", "ty", F.posexplode(heights).alias("at", "z")).select("id", "r", x.alias("x"), y.alias("y"), "z")
    width, height = (F.col("r.x1") - F.col("r.x0") + 1) * size, (F.col("r.y1") - F.col("r.y0") + 1) * size
    kept = F.col("x").between(-halo, width + halo - 1) & F.col("y").between(-halo, height + halo - 1)
    inside = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
    return rows.where(kept).select("id", "x", "y", known(F.col("z")).alias("z"), inside.alias("inside"))
