"""Breeding season, moon and other calendar readings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heathgrid.functions.num import half_up, steps, wrap

#: Phases by days from the peak, each up to the bound; synodic month in days and its epoch.
PHASES = [(-60, "OffSeason"), (-21, "PreRut"), (-10, "Seeking"), (-2, "Chasing"), (8, "PeakBreeding"), (24, "PostRut"), (38, "SecondRut"), (75, "LateSeason")]
SYNODIC, EPOCH_SECONDS = 29.530588853, 947182440
MOONS = ("New moon", "Waxing crescent", "First quarter", "Waxing gibbous", "Full moon", "Waning gibbous", "Last quarter", "Waning crescent")


def peak_day(lat: Column) -> Column:
    """Day of the year of peak breeding at a latitude, of its own half of the year."""
    a = F.abs(lat)
    return F.when(a >= 40, F.lit(319)).when(a >= 34, half_up((F.lit(40.0) - a) * 1.2) + 319).otherwise(half_up((F.lit(34.0) - a) * 3.5) + 326).cast("int")


def days_from_peak(day: Column, lat: Column, offset: Column | int = 0) -> Column:
    """Signed days, in (-183, 182]; south of the equator the peak lies half a year on."""
    peak = peak_day(lat) + offset
    peak = F.when(lat < 0, (peak + 181) % 365 + 1).otherwise(peak)
    apart = day - peak
    return F.when(apart > 182, apart - 365).when(apart < -182, apart + 365).otherwise(apart).cast("int")


def phase(days: Column) -> Column:
    return steps(days, PHASES, "OffSeason")


def confidence(lat: Column) -> Column:
    return F.when(F.abs(lat) >= 38, 0.9).when(F.abs(lat) >= 32, 0.65).when(F.abs(lat) >= 28, 0.4).otherwise(0.2)


def confidence_label(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.5, "moderate").otherwise("low")


def reading(day: Column, lat: Column, species: Column, offset: Column | int = 0) -> Column:
    """Struct of supported, phase, days_from_peak, confidence; only for WHITETAIL, NULL without a place or species."""
    ours = species == "WHITETAIL"
    days = days_from_peak(day, lat, offset)
    return F.when(lat.isNotNull() & species.isNotNull(), F.struct(ours.alias("supported"), F.when(ours, phase(days)).alias("phase"), F.when(ours, days).alias("days_from_peak"), F.when(ours, confidence(lat)).alias("confidence")))


def calibrated_offset(days: Column) -> Column:
    """As an aggregate: the rounded median of the days from peak at which harvests fell, six days on; NULL from fewer than three or beyond two weeks."""
    middle = half_up(F.percentile(days, 0.5) + 6).cast("int")
    return F.when((F.count(days) >= 3) & (F.abs(middle) <= 14), middle)


def moon(ts: Column) -> Column:
    """Age of the moon as a share of its month."""
    return wrap((F.unix_micros(ts.cast("timestamp")) / F.lit(1e6) - EPOCH_SECONDS) / F.lit(86400.0 * SYNODIC), 1)


def moon_label(p: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MOONS)), (half_up(p * 8) % 8 + 1).cast("int"))
