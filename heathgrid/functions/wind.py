"""Wind, thermals and bedding as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heathgrid.functions.num import azimuth_delta, clamp01, wrap

#: Bedding pad, ring and cover scales; cold onset and severe cold in degrees Celsius; largest solar weight.
PAD, RING, RING_SCALE, FULL_COVER, ONSET, SEVERE, MOST_SOLAR, RING_QUORUM = 12.0, 15.0, 4.0, 0.06, 5.0, -10.0, 0.75, 0.5


def wind_exposure(slope: Column, aspect: Column, wind_from: Column | float) -> Column:
    """1 facing the wind, -1 in the lee, 0 on flat ground."""
    wind = F.lit(float(wind_from)) if isinstance(wind_from, (int, float)) else wind_from
    return F.when(slope.isNull(), F.lit(None)).when(aspect < 0, F.lit(0.0)).otherwise(F.cos(F.radians(aspect - wind)))


def thermals(slope: Column, aspect: Column, plan: Column, phase: str, sun: Column | None = None) -> Column:
    """Struct of scent_azimuth (-1: none) and strength (0 to 1) of slope air that is rising, sinking or in transition."""
    base = F.least(F.lit(1.0), slope / 30.0)
    if phase == "sinking":
        base = base * F.when(plan < 0, 1.0 + F.least(F.lit(1.0), F.abs(plan) * 200.0)).otherwise(1.0)
    elif phase == "rising" and sun is not None:
        base = base * F.greatest(F.lit(0.1), sun)
    elif phase == "transition":
        base = base * 0.35
    way = wrap(aspect + 180.0, 360) if phase == "rising" else aspect
    level = aspect < 0
    return F.struct(
        F.when(slope.isNull() | level, F.lit(-1.0)).otherwise(way).alias("scent_azimuth"),
        F.when(slope.isNull(), F.lit(None)).when(level, F.lit(0.0)).otherwise(F.least(F.lit(1.0), base)).alias("strength"),
    )


def thermal_phase(now: Column, sunrise: Column, sunset: Column, minutes: float = 45) -> Column:
    gap = lambda other: F.abs(F.unix_micros(now) - F.unix_micros(other)) <= int(minutes * 60e6)
    return F.when(sunrise.isNull() | sunset.isNull() | gap(sunrise) | gap(sunset), "transition").when((now > sunrise) & (now < sunset), "rising").otherwise("sinking")


def cold_weight(celsius: Column) -> Column:
    """Share of the sun in bedding: none from ONSET up, all of MOST_SOLAR from SEVERE down."""
    return F.coalesce(clamp01((F.lit(ONSET) - celsius) / (ONSET - SEVERE)) * MOST_SOLAR, F.lit(0.0))


def bedding(slope: Column, exposure: Column, ring_mean: Column, ring_samples: Column, ring_missing: Column, shelter: Column, vrm: Column, sun: Column | None = None, weight: Column | None = None) -> Column:
    """0 to 1; NULL if anything it needs is unknown. sun and weight come in when it's cold."""
    lee = (F.lit(1.0) - exposure) / 2.0
    aspect = lee if sun is None or weight is None else F.when(weight > 0, (F.lit(1.0) - weight) * lee + weight * clamp01(sun)).otherwise(lee)
    pad = F.lit(1.0) / (F.lit(1.0) + F.pow(slope / PAD, F.lit(2.0)))
    ring = F.lit(1.0) / (F.lit(1.0) + F.exp((F.lit(RING) - F.coalesce(ring_mean, slope)) / RING_SCALE))
    seen = ring_samples + ring_missing
    enough = (seen == 0) | (ring_samples >= seen * RING_QUORUM)
    return F.when(enough, clamp01(aspect * pad * ring * (clamp01(shelter) * 0.75 + 0.25) * (clamp01(vrm / FULL_COVER) * 0.6 + 0.4)))


def wind_rating(phase: Column, exposure: Column, thermal_azimuth: Column, wind_from: Column, wind_octant: Column, huntable: Column) -> Column:
    """good, marginal or burned for a stand.

    A wind that isn't on the stand's list burns it. It's marginal while thermals switch, where air along the
    slope and the wind run more than a right angle apart, and in the lee.
    """
    apart = F.coalesce(F.abs(azimuth_delta(thermal_azimuth, wrap(wind_from + 180.0, 360))), F.lit(0.0))
    doubtful = (phase == "transition") | (apart > 90) | (F.coalesce(exposure, F.lit(0.0)) < -0.5)
    return F.when((F.size(huntable) > 0) & ~F.array_contains(huntable, wind_octant), "burned").when(doubtful, "marginal").otherwise("good")
