"""PNG images of RGBA pixels, written and read without an imaging library."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type (grey, RGB, grey with alpha, RGBA).
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}


def encode(pixels: np.ndarray) -> bytes:
    """An 8-bit RGBA image (height, width, 4) as PNG bytes."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w, _ = pixels.shape
    rows = np.hstack([np.zeros((h, 1), dtype=np.uint8), pixels.reshape(h, w * 4).astype(np.uint8)])
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def images(cells: DataFrame) -> DataFrame:
    """grid_id, png of cells (grid_id, x, y, r, g, b, a): a grid is one image; places without a cell are transparent."""

    def run(grid: pd.DataFrame) -> pd.DataFrame:
        x, y = grid["x"] - grid["x"].min(), grid["y"] - grid["y"].min()
        out = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 4), dtype=np.uint8)
        out[y, x] = grid[["r", "g", "b", "a"]].to_numpy()
        return pd.DataFrame({"grid_id": [grid["grid_id"].iloc[0]], "png": [encode(out)]})

    return cells.groupBy("grid_id").applyInPandas(run, "grid_id string, png binary")


def tiles(cells: DataFrame, size: int = 256) -> DataFrame:
    """grid_id, tx, ty, png of cells (grid_id, x, y, r, g, b, a): an image for each square of `size` cells that has any.

    A task holds one square, whatever the grid's extent; places without a cell are transparent.
    """

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((size, size, 4), dtype=np.uint8)
        out[tile["y"] % size, tile["x"] % size] = tile[["r", "g", "b", "a"]].to_numpy()
        return tile[["grid_id", "tx", "ty"]].head(1).assign(png=encode(out))

    dealt = cells.select("grid_id", *(F.floor(F.col(c) / size).cast("int").alias(f"t{c}") for c in "xy"), "x", "y", "r", "g", "b", "a")
    return dealt.groupBy("grid_id", "tx", "ty").applyInPandas(run, f"grid_id {dict(cells.dtypes)['grid_id']}, tx int, ty int, png binary")


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row's bytes from its filtered ones and the row above; step: bytes of a pixel."""
    if kind == 0:
        return line
    if kind == 1:
        return line.reshape(-1, step).cumsum(axis=0, dtype=np.uint64).astype(np.uint8).ravel()
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise ValueError(f"no PNG filter {kind}")
    out, up = [0] * step + line.tolist(), [0] * step + above.tolist()
    for i in range(step, len(out)):
        a, b, c = out[i - step], up[i], up[i - step]
        if kind == 3:
            guess = (a + b) // 2
        else:
            _, _, guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))
        out[i] = (out[i] + guess) & 255
    return np.array(out[step:], dtype=np.uint8)


def decode(data: bytes) -> np.ndarray:
    """RGBA pixels (height, width, 4) of a PNG; grey and opaque images are widened.

    ValueError for anything else than 8 bits a sample, row by row, without a palette, and for damaged data.
    """
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, head = 8, [], None
    while at + 12 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in SAMPLES or head[6]:
        raise ValueError("a kind of PNG that isn't read")
    w, h, step = head[0], head[1], SAMPLES[head[3]]
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise ValueError("damaged PNG") from e
    if len(raw) != h * (w * step + 1):
        raise ValueError("damaged PNG")
    lines = np.frombuffer(raw, dtype=np.uint8).reshape(h, w * step + 1)
    rows = np.zeros((h, w * step), dtype=np.uint8)
    for y in range(h):
        rows[y] = _unfiltered(int(lines[y, 0]), lines[y, 1:], rows[y - 1] if y else np.zeros(w * step, dtype=np.uint8), step)
    pixels = rows.reshape(h, w, step)
    alpha = pixels[:, :, -1:] if step in (2, 4) else np.full((h, w, 1), 255, dtype=np.uint8)
    return np.concatenate([pixels[:, :, :3] if step > 2 else pixels[:, :, :1].repeat(3, axis=2), alpha], axis=2)


def pixels(images: DataFrame, size: int = 256) -> DataFrame:
    """grid_id, x, y, r, g, b, a: the pixels of images (grid_id, tx, ty, png), placed by their tile; none for a null image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = batch.column("png")[k].as_py()
                if data is None:
                    continue
                found = decode(data)
                y, x = np.indices(found.shape[:2], dtype=np.int32)
                places = [(batch.column(f"t{c}")[k].as_py() * size + v.ravel()).astype(np.int32) for c, v in (("x", x), ("y", y))]
                ids = batch.column("grid_id").slice(k, 1).take(pa.array(np.zeros(x.size, dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, places), *(pa.array(found[:, :, i].ravel().astype(np.int32)) for i in range(4))], names=["grid_id", "x", "y", "r", "g", "b", "a"])

    return images.select("grid_id", "tx", "ty", "png").mapInArrow(run, f"grid_id {dict(images.dtypes)['grid_id']}, x int, y int, r int, g int, b int, a int")
