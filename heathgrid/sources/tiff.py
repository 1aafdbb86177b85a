"""Tiled TIFF elevation files: a parser, tile decoders and a Spark data source of cells.

One directory of a file is one raster. Tiles hold one band of 8- to 64-bit numbers, plain or LZW, with no
predictor, the horizontal one or the floating-point one. Unknown heights are NULL.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from heathgrid.functions.pixels import FLOOR


class Truncated(ValueError):
    """The bytes at hand end before what must be read; needed: how many bytes from the file's start."""

    def __init__(self, needed: int):
        super().__init__(f"{needed} bytes needed")
        self.needed = needed


class Unsupported(ValueError):
    pass


#: Sizes of field types, and their struct codes.
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


@dataclass
class Directory:
    width: int
    height: int
    tile_width: int
    tile_height: int
    offsets: list[int]
    counts: list[int]
    compression: int
    predictor: int
    kind: np.dtype
    no_data: float | None
    scale: tuple[float, ...] = ()
    tiepoint: tuple[float, ...] = ()
    geo_keys: dict[int, int] = field(default_factory=dict)

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.tile_height)


def take(data: bytes, start: int, n: int) -> bytes:
    if start + n > len(data):
        raise Truncated(start + n)
    return data[start : start + n]


def parse(data: bytes) -> list[Directory]:
    """Directories of a classic or big TIFF, in the file's order."""
    order = {b"II": "<", b"MM": ">"}.get(take(data, 0, 2))
    if order is None:
        raise Unsupported("not a TIFF file")
    version = struct.unpack(f"{order}H", take(data, 2, 2))[0]
    if version not in (42, 43):
        raise Unsupported("not a TIFF file")
    big = version == 43
    word, size, head = ("Q", 8, 8) if big else ("I", 4, 4)
    at = struct.unpack(order + word, take(data, head, size))[0]
    found = []
    while at:
        n = struct.unpack(order + ("Q" if big else "H"), take(data, at, 8 if big else 2))[0]
        at += 8 if big else 2
        tags = {}
        for k in range(n):
            entry = take(data, at + k * (12 + 8 * big), 12 + 8 * big)
            tag, kind = struct.unpack(f"{order}HH", entry[:4])
            count = struct.unpack(order + word, entry[4 : 4 + size])[0]
            if kind not in KINDS:
                continue
            length = count * struct.calcsize("=" + KINDS[kind])
            held = entry[4 + size :]
            body = held[:length] if length <= size else take(data, struct.unpack(order + word, held)[0], length)
            tags[tag] = body if kind == 2 else list(struct.unpack(f"{order}{count * len(KINDS[kind])}{KINDS[kind][0]}", body))
        at = struct.unpack(order + word, take(data, at + n * (12 + 8 * big), size))[0]
        found.append(directory(tags, order))
    return found


def directory(tags: dict, order: str) -> Directory:
    one = lambda tag, other: tags.get(tag, [other])[0]
    if 322 not in tags:
        raise Unsupported("only tiled files")
    if one(277, 1) != 1:
        raise Unsupported("only one band")
    bits, form = one(258, 1), one(339, 1)
    kind = {1: "u", 2: "i", 3: "f"}.get(form)
    if kind is None or bits not in (8, 16, 32, 64) or (kind != "f" and bits == 64) or (kind == "f" and bits < 32):
        raise Unsupported("sample format")
    if order == ">" and one(317, 1) == 3:
        raise Unsupported("big-endian floating-point predictor")
    text = tags.get(42113, b"").split(b"\0")[0].strip()
    keys = tags.get(34735, [])
    return Directory(
        one(256, 0), one(257, 0), one(322, 0), one(323, 0), tags.get(324, []), tags.get(325, []), one(259, 1), one(317, 1), np.dtype(f"{order}{kind}{bits // 8}"),
        float(text) if text else None, tuple(tags.get(33550, ())), tuple(tags.get(33922, ())), {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0},
    )


def unpack_lzw(data: bytes) -> bytes:
    """Codes grow from 9 to 12 bits, most significant bit first, one code early; 256 clears, 257 ends."""
    out, table, width, held, bits, before = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            text = table[code]
        elif code == len(table) and before:
            text = before + before[:1]
        else:
            raise ValueError("broken LZW data")
        if before:
            table.append(before + text[:1])
        out += text
        before = text
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def decode_tile(d: Directory, data: bytes) -> np.ndarray:
    """Heights of a tile; NaN where unknown."""
    if d.compression not in (1, 5):
        raise Unsupported(f"compression {d.compression}")
    raw = unpack_lzw(data) if d.compression == 5 else data
    h, w, size = d.tile_height, d.tile_width, d.kind.itemsize
    raw = raw[: h * w * size]
    if len(raw) < h * w * size:
        raise ValueError("a tile ends early")
    if d.predictor == 3:
        # bytes are differences along a row whose planes, highest byte first, stand one after another
        planes = np.cumsum(np.frombuffer(raw, dtype=np.uint8).reshape(h, w * size), axis=1, dtype=np.uint8).reshape(h, size, w)
        values = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(d.kind.newbyteorder(">"))[..., 0]
    else:
        values = np.frombuffer(raw, dtype=d.kind).reshape(h, w)
        if d.predictor == 2:
            own = values.astype(values.dtype.newbyteorder("="))
            values = np.cumsum(own.view(f"u{size}"), axis=1, dtype=f"u{size}").view(own.dtype)
        elif d.predictor != 1:
            raise Unsupported(f"predictor {d.predictor}")
    z = values.astype(float)
    unknown = ~np.isfinite(z) | (z <= FLOOR)
    return np.where(unknown | (z == d.no_data) if d.no_data is not None else unknown, np.nan, z)


def overview(found: list[Directory], resolution: float, wanted: float) -> int:
    """The coarsest directory no more than half as coarse again as wanted; the first one's resolution is given."""
    fits = [k for k, d in enumerate(found) if resolution * found[0].width / d.width <= 1.5 * wanted]
    return max(fits, key=lambda k: found[0].width / found[k].width, default=0)


def cells(binary_files: DataFrame, level: int = 0) -> DataFrame:
    """grid_id (the path), x, y, z of files read with format binaryFile: a tile's cells leave its task as they are decoded."""
    kinds = StructType([StructField("grid_id", StringType()), StructField("x", IntegerType()), StructField("y", IntegerType()), StructField("z", DoubleType())])

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for path, data in zip(frame["path"], frame["content"], strict=True):
                d = parse(data)[level]
                for k, (start, n) in enumerate(zip(d.offsets, d.counts, strict=True)):
                    z = decode_tile(d, take(data, start, n))
                    y, x = np.mgrid[0 : d.tile_height, 0 : d.tile_width]
                    x, y = x + k % d.across * d.tile_width, y + k // d.across * d.tile_height
                    inside = (x < d.width) & (y < d.height)
                    yield pd.DataFrame({"grid_id": path, "x": x[inside].astype("int32"), "y": y[inside].astype("int32"), "z": pd.array(z[inside], dtype="Float64")})

    return binary_files.select("path", "content").mapInPandas(run, kinds)


def encoded(z: np.ndarray, tile: int, dtype: np.dtype, predictor: int) -> list[bytes]:
    """The tiles of a raster, row by row."""
    h, w = z.shape
    across, down = -(-w // tile), -(-h // tile)
    full = np.zeros((down * tile, across * tile), dtype=dtype)
    full[:h, :w] = z
    tiles = []
    for j in range(down):
        for i in range(across):
            part = full[j * tile : (j + 1) * tile, i * tile : (i + 1) * tile]
            if predictor == 2:
                u = part.astype(dtype.newbyteorder("=")).view(f"u{dtype.itemsize}")
                part = np.diff(u, axis=1, prepend=u.dtype.type(0))
            elif predictor == 3:
                planes = part.astype(dtype.newbyteorder(">")).view(np.uint8).reshape(tile, tile, dtype.itemsize).transpose(0, 2, 1).reshape(tile, -1)
                part = np.diff(planes, axis=1, prepend=np.uint8(0))
            tiles.append(np.ascontiguousarray(part).tobytes())
    return tiles


def write(
    z: np.ndarray, tile: int = 16, kind: str = "<f4", predictor: int = 1, no_data: float | None = None, scale: tuple = (), tiepoint: tuple = (), geo_keys: dict[int, int] | None = None, overviews: list[np.ndarray] | None = None
) -> bytes:
    """A small uncompressed tiled file, for fixtures and derived data; overviews are further directories without a place of their own."""
    dtype = np.dtype(kind)
    form = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    text = b"" if no_data is None else f"{no_data:g}".encode() + b"\0"
    levels = [(x, encoded(x, tile, dtype, predictor)) for x in (z, *(overviews or []))]
    plans = []
    for k, (x, tiles) in enumerate(levels):
        tags = {256: (4, [x.shape[1]]), 257: (4, [x.shape[0]]), 258: (3, [dtype.itemsize * 8]), 259: (3, [1]), 277: (3, [1]), 317: (3, [predictor]), 322: (4, [tile]), 323: (4, [tile]), 324: (4, [0] * len(tiles)), 325: (4, [len(t) for t in tiles]), 339: (3, [form])}
        tags |= {254: (4, [1])} if k else {}
        tags |= {33550: (12, list(scale))} if scale and not k else {}
        tags |= {33922: (12, list(tiepoint))} if tiepoint and not k else {}
        tags |= {34735: (3, [1, 1, 0, len(geo_keys), *(v for key, value in sorted(geo_keys.items()) for v in (key, 0, 1, value))])} if geo_keys and not k else {}
        tags |= {42113: (2, text)} if text else {}
        plans.append((dict(sorted(tags.items())), tiles))
    body = lambda kind, values: values if kind == 2 else struct.pack(f"<{len(values)}{KINDS[kind]}", *values)
    longer = lambda tags: sum(len(body(*v)) for v in tags.values() if len(body(*v)) > 4)
    at = 8
    for tags, _ in plans:
        at += 2 + 12 * len(tags) + 4 + longer(tags)
    for tags, tiles in plans:
        tags[324] = (4, [int(v) for v in np.cumsum([at] + [len(t) for t in tiles[:-1]])])
        at += sum(map(len, tiles))
    out = b"II" + struct.pack("<HI", 42, 8)
    for k, (tags, _) in enumerate(plans):
        rest, extra = len(out) + 2 + 12 * len(tags) + 4, b""
        out += struct.pack("<H", len(tags))
        for tag, (kind_, values) in tags.items():
            data = body(kind_, values)
            out += struct.pack("<HHI", tag, kind_, len(values)) + (struct.pack("<I", rest + len(extra)) if len(data) > 4 else data.ljust(4, b"\0"))
            extra += data if len(data) > 4 else b""
        out += struct.pack("<I", rest + len(extra) if k + 1 < len(plans) else 0) + extra
    return out + b"".join(t for _, tiles in plans for t in tiles)
