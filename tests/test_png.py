import struct
import zlib

import numpy as np
import pytest

from heathgrid.sources import png


def filtered(pixels, kinds, colour):
    """A PNG whose rows use the given filters, worked out byte by byte."""
    h, w, step = pixels.shape
    raw, flat = b"", pixels.reshape(h, w * step).astype(int)
    for y in range(h):
        raw += bytes([kinds[y % len(kinds)]])
        for i in range(w * step):
            a = flat[y, i - step] if i >= step else 0
            b = flat[y - 1, i] if y else 0
            c = flat[y - 1, i - step] if y and i >= step else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            raw += bytes([(flat[y, i] - (0, a, b, (a + b) // 2, paeth)[kinds[y % len(kinds)]]) % 256])
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    data = zlib.compress(raw)
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"tEXt", b"k") + chunk(b"IDAT", data[:7]) + chunk(b"IDAT", data[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("colour", "step"), [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_every_filter_and_colour_type(colour, step):
    rng = np.random.default_rng(colour)
    for kinds in ([0], [1], [2], [3], [4], [4, 3, 2, 1, 0]):
        pixels = rng.integers(0, 256, (7, 9, step), dtype=np.uint8)
        found = png.decode(filtered(pixels, kinds, colour))
        assert found.shape == (7, 9, 4)
        assert (found[:, :, :3] == (pixels[:, :, :3] if step > 2 else pixels[:, :, :1])).all()
        assert (found[:, :, 3] == (pixels[:, :, -1] if step in (2, 4) else 255)).all()


def test_refusals():
    data = png.encode(np.zeros((2, 3, 4), dtype=np.uint8))
    assert png.decode(data).shape == (2, 3, 4)
    palette = filtered(np.zeros((2, 2, 1), dtype=np.uint8), [0], 3)
    for bad in (b"", b"GIF89a", data[:20], data[:-20], data[:45] + bytes([data[45] ^ 1]) + data[46:], palette):
        with pytest.raises(ValueError):
            png.decode(bad)


def test_tiles_give_back_their_cells(spark):
    cells = [(g, x, y, x % 256, y % 256, 7, 255) for g in (1, 2) for x in range(-3, 6) for y in range(-2, 5) if (x + y) % 3]
    images = png.tiles(spark.createDataFrame(cells, "grid_id int, x int, y int, r int, g int, b int, a int"), 4)
    assert sorted((r.grid_id, r.tx, r.ty) for r in images.collect()) == [(g, x, y) for g in (1, 2) for x in (-1, 0, 1) for y in (-1, 0, 1)]
    assert sorted(tuple(r) for r in png.pixels(images, 4).where("a > 0").collect()) == sorted(cells)
    none = spark.createDataFrame([(1, 0, 0, None)], "grid_id int, tx int, ty int, png binary")
    assert not png.pixels(none).collect() and not png.tiles(spark.createDataFrame([], "grid_id int, x int, y int, r int, g int, b int, a int")).collect()
