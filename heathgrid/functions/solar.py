"""Sun position, sun times, light on slopes and hillshade as Column expressions. Times are UTC timestamps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heathgrid.functions.num import clamp, let, wrap

STANDARD_NOON = 2451545.0


def poly(t: Column, *terms: float) -> Column:
    """terms[0] + terms[1] t + ... by Horner's rule."""
    out = F.lit(float(terms[-1]))
    for x in reversed(terms[:-1]):
        out = out * t + F.lit(float(x))
    return out


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def julian_day(ts: Column) -> Column:
    return seconds(ts) / F.lit(86400.0) + F.lit(2440587.5)


def sun(ts: Column, lat: Column, lng: Column) -> Column:
    """Struct of altitude and azimuth in degrees, by the low-precision almanac series in centuries since 2000.

    Every stage of the series is bound once, so that the plan grows with the formula and not with its uses.
    """
    minutes = F.hour(ts) * 60 + F.minute(ts) + F.second(ts) / F.lit(60.0)

    def series(t: Column) -> Column:
        # fixed values: coefficients of the published series
        anomaly, node = F.radians(poly(t, 357.52911, 35999.05029, -0.0001537)), F.radians(poly(t, 125.04, -1934.136))
        mean_long = wrap(poly(t, 280.46646, 36000.76983, 0.0003032), 360)
        return let(F.struct(t.alias("t"), anomaly.alias("anomaly"), node.alias("node"), mean_long.alias("mean_long")), orbit)

    def orbit(s: Column) -> Column:
        t, anomaly, node, mean_long = (s[k] for k in ("t", "anomaly", "node", "mean_long"))
        centre = F.sin(anomaly) * poly(t, 1.914602, -0.004817, -0.000014) + F.sin(anomaly * 2) * poly(t, 0.019993, -0.000101) + F.sin(anomaly * 3) * 0.000289
        apparent = F.radians(mean_long + centre - 0.00569 - F.sin(node) * 0.00478)
        tilt = F.radians(poly(t, 23 + 26 / 60 + 21.448 / 3600, -46.815 / 3600, -0.00059 / 3600, 0.001813 / 3600) + F.cos(node) * 0.00256)
        e, long2 = poly(t, 0.016708634, -0.000042037, -0.0000001267), F.radians(mean_long) * 2
        return let(F.struct(anomaly.alias("anomaly"), apparent.alias("apparent"), tilt.alias("tilt"), e.alias("e"), long2.alias("long2"), F.pow(F.tan(tilt / 2), F.lit(2.0)).alias("y")), clock)

    def clock(s: Column) -> Column:
        anomaly, e, long2, y = (s[k] for k in ("anomaly", "e", "long2", "y"))
        equation = F.degrees(
            y * F.sin(long2) - e * F.sin(anomaly) * 2 + e * y * F.sin(anomaly) * F.cos(long2) * 4 - y * y * F.sin(long2 * 2) * 0.5 - e * e * F.sin(anomaly * 2) * 1.25
        ) * 4
        hour_angle = wrap(minutes + equation + lng * 4, 1440) / 4 - 180
        return let(F.struct(hour_angle.alias("hour_angle"), F.asin(F.sin(s["tilt"]) * F.sin(s["apparent"])).alias("declination"), F.radians(lat).alias("lat")), height)

    def height(s: Column) -> Column:
        zenith = F.acos(clamp(F.sin(s["lat"]) * F.sin(s["declination"]) + F.cos(s["lat"]) * F.cos(s["declination"]) * F.cos(F.radians(s["hour_angle"])), -1, 1))
        return let(F.struct(s["hour_angle"].alias("hour_angle"), s["declination"].alias("declination"), s["lat"].alias("lat"), zenith.alias("zenith")), place)

    def place(s: Column) -> Column:
        base = F.cos(s["lat"]) * F.sin(s["zenith"])
        side = F.degrees(F.acos(clamp((F.sin(s["lat"]) * F.cos(s["zenith"]) - F.sin(s["declination"])) / F.when(F.abs(base) > 1e-9, base), -1, 1)))
        turned = wrap(F.when(s["hour_angle"] > 0, side + 180).otherwise(F.lit(540.0) - side), 360)
        azimuth = F.when(F.abs(base) > 1e-9, turned).otherwise(F.when(lat > 0, 180.0).otherwise(0.0))
        return F.struct((F.lit(90.0) - F.degrees(s["zenith"])).alias("altitude"), azimuth.alias("azimuth"))

    return let((julian_day(ts) - STANDARD_NOON) / F.lit(36525.0), series)


def insolation(slope: Column, aspect: Column, altitude: Column, azimuth: Column) -> Column:
    """Share of the beam that a slope takes, 0 when the sun is down; NULL where the slope is unknown."""
    s, a = F.radians(slope), F.radians(altitude)
    turn = F.when(aspect < 0, F.lit(1.0)).otherwise(F.cos(F.radians(azimuth - aspect)))
    return F.when(altitude <= 0, F.lit(0.0)).when(slope.isNotNull(), F.greatest(F.lit(0.0), F.cos(s) * F.sin(a) + F.sin(s) * F.cos(a) * turn))


def daily_insolation(surfaced: DataFrame, suns: list[tuple[float, float]], hours: float = 0.5) -> DataFrame:
    """Cells with daily_insolation: the sum over a constant list of sun (altitude, azimuth) positions, each for so many hours; voids get 0."""
    total = F.lit(0.0)
    for altitude, azimuth in suns:
        if altitude > 0:
            total += F.coalesce(insolation(F.col("slope"), F.col("aspect"), F.lit(altitude), F.lit(azimuth)), F.lit(0.0)) * hours
    return surfaced.withColumn("daily_insolation", total)


def hillshade(dzdx: Column, dzdy: Column, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0) -> Column:
    """Light on the surface's unit normal, 0 to 1."""
    az, alt = math.radians(azimuth), math.radians(altitude)
    east, south = dzdx * z_factor, dzdy * z_factor
    beam = -east * (math.sin(az) * math.cos(alt)) + south * (math.cos(az) * math.cos(alt)) + math.sin(alt)
    light = beam / F.sqrt(east * east + south * south + 1.0)
    return F.when(dzdx.isNotNull() & dzdy.isNotNull(), F.greatest(F.lit(0.0), light))


#: Lights (azimuth, weight).
LIGHTS = ((225.0, 0.2), (270.0, 0.25), (315.0, 0.35), (360.0, 0.2))


def multi_hillshade(dzdx: Column, dzdy: Column, altitude: float = 45.0, z_factor: float = 1.0) -> Column:
    return sum((hillshade(dzdx, dzdy, a, altitude, z_factor) * w for a, w in LIGHTS), F.lit(0.0))


def sun_times(rows: DataFrame, ts: str, lat: str, lng: str) -> DataFrame:
    """rows with sunrise and sunset of the local solar day around ts; NULL where the sun doesn't cross the horizon.

    The day runs from local solar midnight. Altitude is taken every ten minutes; in the first step where
    it changes sign upwards (sunrise) or downwards (sunset), twenty halvings close in on the crossing. A
    halving needs the one before, so it's a vectorised kernel over the distinct places and days, which
    are few beside the rows; times are joined back.
    """
    day = F.floor((seconds(F.col(ts)) + F.col(lng) * 240) / 86400)
    keyed = rows.withColumn("_start", (day * 86400 - F.col(lng) * 240).cast("double"))
    days = keyed.select("_start", F.col(lat).cast("double").alias("_lat"), F.col(lng).cast("double").alias("_lng")).where("_start is not null and _lat is not null").distinct()

    def run(frames):
        for f in frames:
            start, la, ln = (f[k].to_numpy(float) for k in ("_start", "_lat", "_lng"))
            steps = np.stack([altitude(start + m * 60, la, ln) for m in range(0, 1441, 10)]) > 0
            out = {}
            for name, up in (("sunrise", True), ("sunset", False)):
                turns = (steps[:-1] != up) & (steps[1:] == up)
                some, low = turns.any(axis=0), turns.argmax(axis=0) * 600.0
                for k in range(20):
                    width = 600 / 2 ** (k + 1)
                    low = np.where((altitude(start + low + width, la, ln) > 0) == up, low, low + width)
                out[name] = pd.array(np.floor((start + low) * 1e6).astype("int64"), dtype="Int64")
                out[name][~some] = pd.NA
            yield f.assign(**out)

    times = days.mapInPandas(run, "_start double, _lat double, _lng double, sunrise long, sunset long")
    times = times.withColumn("sunrise", F.timestamp_micros("sunrise")).withColumn("sunset", F.timestamp_micros("sunset"))
    same = (keyed["_start"] == times["_start"]) & (F.col(lat) == F.col("_lat")) & (F.col(lng) == F.col("_lng"))
    return keyed.join(times, same, "left").select(*rows.columns, "sunrise", "sunset")


def altitude(at: np.ndarray, lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    """sun()'s altitude for times in seconds, in numpy."""
    t = (at / 86400 + 2440587.5 - STANDARD_NOON) / 36525
    p = np.polynomial.polynomial.polyval
    mean_long, m, node = p(t, [280.46646, 36000.76983, 0.0003032]) % 360, np.radians(p(t, [357.52911, 35999.05029, -0.0001537])), np.radians(p(t, [125.04, -1934.136]))
    centre = np.sin(m) * p(t, [1.914602, -0.004817, -0.000014]) + np.sin(2 * m) * p(t, [0.019993, -0.000101]) + np.sin(3 * m) * 0.000289
    apparent = np.radians(mean_long + centre - 0.00569 - np.sin(node) * 0.00478)
    tilt = np.radians(p(t, [23 + 26 / 60 + 21.448 / 3600, -46.815 / 3600, -0.00059 / 3600, 0.001813 / 3600]) + np.cos(node) * 0.00256)
    dec = np.arcsin(np.sin(tilt) * np.sin(apparent))
    y, e, l2 = np.tan(tilt / 2) ** 2, p(t, [0.016708634, -0.000042037, -0.0000001267]), 2 * np.radians(mean_long)
    equation = 4 * np.degrees(y * np.sin(l2) - 2 * e * np.sin(m) + 4 * e * y * np.sin(m) * np.cos(l2) - 0.5 * y * y * np.sin(2 * l2) - 1.25 * e * e * np.sin(2 * m))
    hour = np.radians(((at % 86400 / 60 + equation + 4 * lng) % 1440) / 4 - 180)
    phi = np.radians(lat)
    return 90 - np.degrees(np.arccos(np.clip(np.sin(phi) * np.sin(dec) + np.cos(phi) * np.cos(dec) * np.cos(hour), -1, 1)))
