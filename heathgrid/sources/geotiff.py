"""Placed elevation files, tile by tile: an index of tiles from file headers, pruned by a box, then reads of their bytes alone.

`index` probes headers in tasks (the first 32 KiB, more only where a directory lies further on) and gives a row for each
tile with its place and its bytes' range. What a query's box or level leaves out is filtered from the index, so its bytes are
never asked for. `read` fetches and decodes the rest; neighbouring tiles share a task, one file's tiles spread
over many. Files are opened through pyarrow's filesystems: local paths and URIs.

Defined cases: a tile of length 0 is one that a sparse file leaves out, and unknown; a range that can't be
read fails its task, so that Spark tries again; files without a place, or with one that isn't read, raise Unplaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heathgrid.functions import georef
from heathgrid.functions.num import let, worked_out
from heathgrid.operators.mosaic import arrays
from heathgrid.shared import filesystem
from heathgrid.sources import tiff

PROBE = 32 << 10
#: A level may be half as coarse again as what is wanted.
COARSER = 1.5
#: Tiles in a row that one task reads.
TOGETHER = 16
INDEX = (
    f"path string, level int, width int, height int, tile int, x0 int, y0 int, tile_width int, tile_height int, start long, length long, compression int, predictor int, kind string, no_data double, epsg int, g {georef.PLACEMENT}"
)


class Ranges:
    """Reads of a file's byte ranges; counts what it asked for."""

    def __init__(self, path: str):
        fs, at = filesystem(path)
        self.file, self.asked = fs.open_input_file(at), []

    def read(self, start: int, length: int) -> bytes:
        self.asked.append((start, length))
        return self.file.read_at(length, start)

    def close(self) -> None:
        self.file.close()


def header(source: Ranges, probe: int = PROBE) -> list[tiff.Directory]:
    """Directories from as few bytes as hold them."""
    data, size = source.read(0, probe), source.file.size()
    while True:
        try:
            return tiff.parse(data)
        except tiff.Truncated as e:
            if e.needed > size or len(data) >= size:
                raise
            data += source.read(len(data), min(size, max(e.needed, 2 * len(data))) - len(data))


def placements(found: list[tiff.Directory]) -> tuple[int, list[dict]]:
    """EPSG code and every level's placement; coarser levels take theirs from the first by the ratio of sizes."""
    base = found[0]
    code, zone = georef.crs(base.geo_keys)
    own = [georef.placement(d.scale, d.tiepoint, zone) if d.scale and d.tiepoint else georef.placement(base.scale, base.tiepoint, zone, base.width / d.width, base.height / d.height) for d in found]
    return code, own


def level_for(resolutions: list[float], wanted: float | None) -> int:
    """The coarsest of levels, finest first, that is still fine enough; the first for None."""
    best = 0
    for k, r in enumerate(resolutions):
        if wanted is None or r > wanted * COARSER:
            break
        best = k
    return best


def files(spark: SparkSession, folder: str, pattern: str = "*.tif*") -> DataFrame:
    """path, length of the files in a folder: Spark lists them, and reads nothing of them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")


def index(paths: DataFrame, wanted: float | None = None, every_level: bool = False) -> DataFrame:
    """A row for each tile of files (path), of the level that suits `wanted` metres a pixel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                source = Ranges(path)
                try:
                    found = header(source)
                finally:
                    source.close()
                code, places = placements(found)
                for k, (d, g) in enumerate(zip(found, places, strict=True)):
                    if every_level or k == level_for([georef.metres(x) for x in places], wanted):
                        n = len(d.offsets)
                        tile = np.arange(n, dtype=np.int32)
                        same = lambda v, kind, n=n: pa.array([v] * n, type=kind)
                        columns = [same(path, pa.string()), *(same(v, pa.int32()) for v in (k, d.width, d.height)), pa.array(tile), pa.array(tile % d.across * d.tile_width), pa.array(tile // d.across * d.tile_height), *(same(v, pa.int32()) for v in (d.tile_width, d.tile_height)), pa.array(d.offsets, pa.int64()), pa.array(d.counts, pa.int64()), same(d.compression, pa.int32()), same(d.predictor, pa.int32()), same(d.kind.str, pa.string()), same(d.no_data, pa.float64()), same(code, pa.int32()), same(g, pa.struct([(f, pa.int32() if f == "zone" else pa.float64()) for f in g]))]
                        yield pa.RecordBatch.from_arrays(columns, names=[x.strip().split(" ")[0] for x in INDEX.split(f", g {georef.PLACEMENT}")[0].split(",")] + ["g"])

    return paths.select("path").mapInArrow(run, INDEX)


def tile_box() -> Column:
    x1, y1 = F.least(F.col("x0") + F.col("tile_width"), F.col("width")), F.least(F.col("y0") + F.col("tile_height"), F.col("height"))
    return georef.box_of(F.col("x0"), F.col("y0"), x1, y1, F.col("g"))


def within(tiles: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Index rows of tiles that touch a box."""
    b = F.col("its_box")
    return worked_out(tiles, "its_box", tile_box()).where((b["west"] <= east) & (b["east"] >= west) & (b["south"] <= north) & (b["north"] >= south)).drop("its_box")


def read(tiles: DataFrame) -> DataFrame:
    """Index rows with z: the tile's heights row by row, NULL where unknown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = {c: one.column(c)[0].as_py() for c in ("path", "start", "length", "tile_width", "tile_height", "compression", "predictor", "kind", "no_data")}
                if row["path"] != path:
                    if source:
                        source.close()
                    path, source = row["path"], Ranges(row["path"])
                if row["length"]:
                    d = tiff.Directory(0, 0, row["tile_width"], row["tile_height"], [], [], row["compression"], row["predictor"], np.dtype(row["kind"]), row["no_data"])
                    z = tiff.decode_tile(d, source.read(row["start"], row["length"]))
                else:
                    z = np.full((row["tile_height"], row["tile_width"]), np.nan)
                yield pa.RecordBatch.from_arrays([*one.columns, arrays([z])], names=[*one.schema.names, "z"])
        if source:
            source.close()

    dealt = tiles.repartition("path", "level", F.floor(F.col("tile") / TOGETHER)).sortWithinPartitions("path", "level", "tile")
    return dealt.mapInArrow(run, f"{INDEX}, z array<double>")


def cells(tiles: DataFrame) -> DataFrame:
    """grid_id (the path), level, x, y, z, g of every cell of tiles that were read."""
    rows = tiles.select("path", "level", "width", "height", "x0", "y0", "tile_width", "g", F.posexplode("z").alias("at", "z"))
    x, y = (F.col("x0") + F.col("at") % F.col("tile_width")).cast("int"), (F.col("y0") + F.floor(F.col("at") / F.col("tile_width"))).cast("int")
    rows = rows.select(F.col("path").alias("grid_id"), "level", x.alias("x"), y.alias("y"), "z", "g", "width", "height")
    return rows.where((F.col("x") < F.col("width")) & (F.col("y") < F.col("height"))).drop("width", "height")


def placed(rows: DataFrame) -> DataFrame:
    """Cells with lng and lat of their centres."""
    m = georef.pixel_to_model(F.col("x") + 0.5, F.col("y") + 0.5, F.col("g"))
    p = worked_out(rows, "its_place", let(m, lambda m: georef.place_of(m["x"], m["y"], F.col("g"))))
    return p.select(*rows.columns, F.col("its_place.lng").alias("lng"), F.col("its_place.lat").alias("lat"))


def write_tiles(dealt: DataFrame, folder: str, size: int, degrees: float, west: float, north: float, tile: int = 16, levels: int = 1) -> DataFrame:
    """path: each dealt tile (tx, ty, z) as a file of its own in degrees, north-west corner of tile (0, 0) given.

    A task that runs again writes the same files. levels: so many directories, each half as fine as the one before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
        for batch in batches:
            written = []
            for k in range(batch.num_rows):
                tx, ty = batch.column("tx")[k].as_py(), batch.column("ty")[k].as_py()
                z = batch.column("z")[k].values.to_numpy(zero_copy_only=False).reshape(size, size)
                coarse = [z[:: 2**n, :: 2**n] for n in range(1, levels)]
                data = tiff.write(np.where(np.isnan(z), -9999.0, z), tile, "<f8", no_data=-9999.0, scale=(degrees, degrees, 0.0), tiepoint=(0.0, 0.0, 0.0, west + tx * size * degrees, north - ty * size * degrees, 0.0), geo_keys={georef.MODEL: georef.GEOGRAPHIC, georef.RASTER: georef.PIXEL_IS_AREA, georef.GEOGRAPHIC_CRS: georef.WGS84}, overviews=[np.where(np.isnan(c), -9999.0, c) for c in coarse])
                name = f"{at}/t_{tx}_{ty}.tif"
                with fs.open_output_stream(name) as out:
                    out.write(data)
                written.append(f"{folder}/t_{tx}_{ty}.tif")
            yield pa.RecordBatch.from_arrays([pa.array(written, pa.string())], names=["path"])

    return dealt.select("tx", "ty", "z").mapInArrow(run, "path string")
