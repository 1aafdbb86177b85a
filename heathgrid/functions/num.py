"""Numbers, angles and unknowns as Column expressions. Unknown is NULL, never NaN."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known(c: Column) -> Column:
    """c, or NULL where it's not a finite number."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it occurs there, also after projections are merged."""
    return F.transform(F.array(value), use).getItem(0)


def worked_out(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column whose value is worked out once a row, also where filters and columns above use parts of it several times."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def clamp(c: Column, low: float, high: float) -> Column:
    """c within bounds; NULL stays NULL, which least and greatest alone would skip."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def clamp01(c: Column) -> Column:
    return clamp(c, 0, 1)


def half_up(c: Column) -> Column:
    """To the nearest whole number, halves upwards."""
    return F.floor(c + F.lit(0.5))


def wrap(c: Column, period: float) -> Column:
    """Into [0, period)."""
    return F.pmod(c, F.lit(float(period)))


def azimuth_delta(a: Column, b: Column) -> Column:
    """Signed difference in [-180, 180)."""
    return wrap(a - b + F.lit(180.0), 360) - F.lit(180.0)


def shown(c: Column, places: int = 6) -> Column:
    """Rounded for reports, without a negative zero."""
    return F.round(c, places) + F.lit(0.0)


def steps(value: Column, cases: list[tuple[float, object]], otherwise: object) -> Column:
    """The answer of the first case whose bound is above value; NULL for NULL."""
    out = F.when(value.isNull(), F.lit(None))
    for bound, answer in cases:
        out = out.when(value < F.lit(float(bound)), F.lit(answer))
    return out.otherwise(F.lit(otherwise))
