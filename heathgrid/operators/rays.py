"""Horizons: sky view, shelter and shadows by rays, as kernels over a tile with its halo (`mosaic.over_tiles`).

A ray visits the cells whose centres lie nearest to whole steps along a bearing. Each step of all rays of
one bearing is one shifted array, so a tile costs a numpy pass for each bearing and step. Places outside
the grid and unknown heights are gaps; a result that a gap could change is unknown.
"""

from __future__ import annotations

import math

import numpy as np

#: Bearings and reach of the sky view, reach of shelter and shadows in cells, full shelter in degrees.
SKY_DIRECTIONS, SKY_REACH, SHELTER_REACH, SHADOW_REACH, FULL_SHELTER = 16, 24, 20, 64, 30.0


def near(v: float) -> int:
    return math.floor(v + 0.5)


def shifted(z: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """z at x + dx, y + dy; NaN outside."""
    out = np.full_like(z, np.nan)
    h, w = z.shape
    if abs(dx) < w and abs(dy) < h:
        out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = z[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def scan(z: np.ndarray, bearing: tuple[float, float], reach: int, cell_size: float) -> tuple[np.ndarray, np.ndarray]:
    """Steepest rise along a bearing (0 at least), and whether a gap lies on the way."""
    most, gap = np.zeros_like(z), np.zeros(z.shape, dtype=bool)
    for r in range(1, reach + 1):
        rise = (shifted(z, near(bearing[0] * r), near(bearing[1] * r)) - z) / (r * cell_size)
        gap |= np.isnan(rise)
        most = np.fmax(most, rise)
    return most, gap


def sky_view(z: np.ndarray, cell_size: float, directions: int = SKY_DIRECTIONS, reach: int = SKY_REACH) -> np.ndarray:
    """Mean cosine of the horizon's height over the bearings."""
    total, gap = np.zeros_like(z), np.isnan(z)
    for k in range(directions):
        a = 2 * math.pi * k / directions
        most, missing = scan(z, (math.cos(a), math.sin(a)), reach, cell_size)
        total += np.cos(np.arctan(most))
        gap |= missing
    return np.where(gap, np.nan, total / directions)


def shelter(z: np.ndarray, cell_size: float, wind_from: float, reach: int = SHELTER_REACH) -> np.ndarray:
    """Horizon upwind as a share of full shelter; a gap matters only where shelter isn't full already."""
    a = math.radians(wind_from)
    most, gap = scan(z, (math.sin(a), -math.cos(a)), reach, cell_size)
    share = np.minimum(1.0, np.degrees(np.arctan(most)) / FULL_SHELTER)
    return np.where(np.isnan(z) | (gap & (most <= math.tan(math.radians(FULL_SHELTER)))), np.nan, share)


def shadow(z: np.ndarray, cell_size: float, azimuth: float, altitude: float, reach: int = SHADOW_REACH) -> np.ndarray:
    """0 in shadow, 1 lit, 2 unknown; all 0 when the sun is down."""
    if altitude <= 0:
        return np.zeros(z.shape)
    a, pin = math.radians(azimuth), math.tan(math.radians(altitude))
    most, gap = scan(z, (math.sin(a), -math.cos(a)), reach, cell_size)
    return np.where(np.isnan(z), 2.0, np.where(most > pin, 0.0, np.where(gap, 2.0, 1.0)))
