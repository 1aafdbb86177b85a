"""Use against availability: shares by bin, selection ratios, chi-square, and solar-relative histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heathgrid.functions.num import half_up

#: Bins as (name, from, to), half-open; a bin whose from exceeds its to wraps round.
SLOPE_BINS = [("0-8", 0.0, 8.0), ("8-20", 8.0, 20.0), ("20-30", 20.0, 30.0), ("30-45", 30.0, 45.0), ("45+", 45.0, 91.0)]
ASPECT_BINS = [("N", 337.5, 22.5), ("NE", 22.5, 67.5), ("E", 67.5, 112.5), ("SE", 112.5, 157.5), ("S", 157.5, 202.5), ("SW", 202.5, 247.5), ("W", 247.5, 292.5), ("NW", 292.5, 337.5)]
#: Chi-square at 95 % for 1 to 30 degrees of freedom.
CRITICAL = (3.841, 5.991, 7.815, 9.488, 11.07, 12.592, 14.067, 15.507, 16.919, 18.307, 19.675, 21.026, 22.362, 23.685, 24.996, 26.296, 27.587, 28.869, 30.144, 31.41, 32.671, 33.924, 35.172, 36.415, 37.652, 38.885, 40.113, 41.337, 42.557, 43.773)
LEAST_EXPECTED = 5.0
#: Fixed value: fewest uses that are read.
LEAST_USES = 10


def every_bin():
    """A window over the rows of a bin table, of which there are as many as bins."""
    return Window.partitionBy(F.lit(1))


def bin_index(value: Column, bins: list[tuple[str, float, float]]) -> Column:
    """Number of the first bin that holds value, -1 if none does, NULL for NULL."""
    def chosen(v: Column) -> Column:
        out = F.when(v.isNull(), F.lit(None).cast("int"))
        for i, (_, low, high) in enumerate(bins):
            inside = (v >= low) | (v < high) if low > high else (v >= low) & (v < high)
            out = out.when(inside, i)
        return out.otherwise(-1)

    # as a lambda's variable, value is worked out once and not for each bound
    return F.transform(F.array(value), chosen)[0]


def bin_table(df: DataFrame, bins: list[tuple[str, float, float]]) -> DataFrame:
    rows = [(i, n) for i, (n, _, _) in enumerate(bins)]
    return df.sparkSession.createDataFrame(rows, "bin int, label string")


def shares(cells: DataFrame, index: Column, bins: list[tuple[str, float, float]], mask: Column | None = None) -> DataFrame:
    """bin, label, cells, share of the masked, binned cells; every bin has a row, and a share of 0 if nothing counts."""
    rows = cells if mask is None else cells.where(mask)
    counted = rows.select(index.alias("bin")).where("bin >= 0").groupBy("bin").agg(F.count("*").alias("n"))
    joined = bin_table(cells, bins).join(counted, "bin", "left").select("bin", "label", F.coalesce("n", F.lit(0)).alias("cells"))
    total = F.sum("cells").over(every_bin())
    return joined.select("bin", "label", "cells", F.when(total > 0, F.col("cells") / total).otherwise(0.0).alias("share"))


def profile(cells: DataFrame, by: list[str], inside: Column, landforms: int = 11) -> DataFrame:
    """Availability of each area's terrain in one pass over its cells (slope, aspect, weiss, bench, z and `by`).

    slope_shares, aspect_shares (flat ground counts nowhere) and landform_shares are arrays over what was measured of
    each; bench_share leaves out unmeasured cells; mean_slope is of the cells inside, and least and greatest height of all
    cells given, as the envelope's. Shares and means of nothing are 0.
    """
    aspect = F.when(F.col("aspect") >= 0, F.col("aspect"))
    bins = {"slope": (bin_index(F.col("slope"), SLOPE_BINS), len(SLOPE_BINS)), "aspect": (bin_index(aspect, ASPECT_BINS), len(ASPECT_BINS)), "landform": (F.col("weiss"), landforms)}
    rows = cells.select(*by, "z", inside.alias("its_in"), "slope", "bench", *(i.alias(f"its_{k}") for k, (i, _) in bins.items()))
    count = lambda c: F.count(F.when(F.col("its_in") & c, 1))
    tallies = [count(F.col(f"its_{k}") == v).alias(f"its_{k}_{v}") for k, (_, n) in bins.items() for v in range(n)]
    out = rows.groupBy(*by).agg(
        count(F.lit(True)).alias("cells"), *tallies, count(F.col("bench") == 1).alias("its_benches"), count(F.col("bench") < 2).alias("its_measured"), F.coalesce(F.avg(F.when(F.col("its_in"), F.col("slope"))), F.lit(0.0)).alias("mean_slope"),
        F.coalesce(F.min("z"), F.lit(0.0)).alias("min_z"), F.coalesce(F.max("z"), F.lit(0.0)).alias("max_z"),
    )
    part = lambda n, total: F.coalesce(F.try_divide(n.cast("double"), total.cast("double")), F.lit(0.0))
    shares_of = {}
    for k, (_, n) in bins.items():
        own = [F.col(f"its_{k}_{v}") for v in range(n)]
        total = own[0]
        for c in own[1:]:
            total = total + c
        shares_of[f"{k}_shares"] = F.array(*(part(c, total) for c in own))
    return out.select(*by, "cells", *(v.alias(k) for k, v in shares_of.items()), part(F.col("its_benches"), F.col("its_measured")).alias("bench_share"), "mean_slope", "min_z", "max_z")


def critical_95(df: Column) -> Column:
    """The table up to 30 degrees of freedom, the cube-root approximation beyond."""
    k = F.lit(2.0) / (df * 9.0)
    far = df * F.pow(F.lit(1.0) - k + F.sqrt(k) * 1.6449, F.lit(3.0))
    return F.when(df < 1, F.lit(None)).when(df <= 30, F.element_at(F.array(*map(F.lit, CRITICAL)), F.greatest(F.lit(1), F.least(F.lit(30), df)).cast("int"))).otherwise(far)


def analysis(used: DataFrame, available: DataFrame) -> DataFrame:
    """bin, label, used, available, ratio and, alike in every row, used_total, chi_square, df, critical, significant.

    used: bin, one row for each use (NULL and -1 don't count). available: bin, label, share. Shares are
    taken as parts of their sum. A ratio needs a share; chi-square sums the bins with an expectation.
    Significance needs a degree of freedom and an expectation of 5 in each such bin.
    """
    counts = used.where("bin >= 0").groupBy("bin").agg(F.count("*").alias("n"))
    rows = available.join(counts, "bin", "left").select("bin", "label", F.coalesce("n", F.lit(0)).alias("used"), "share")
    rows = rows.withColumn("used_total", F.sum("used").over(every_bin())).withColumn("_shares", F.sum("share").over(every_bin())).withColumn("available", F.col("share") / F.when(F.col("_shares") == 0, 1.0).otherwise(F.col("_shares")))
    rows = rows.withColumn("_expected", F.col("available") * F.col("used_total"))
    ratio = F.when((F.col("available") > 0) & (F.col("used_total") > 0), F.col("used") / F.col("used_total") / F.when(F.col("available") > 0, F.col("available")))
    part = F.when(F.col("_expected") > 0, F.pow(F.col("used") - F.col("_expected"), F.lit(2.0)) / F.when(F.col("_expected") > 0, F.col("_expected")))
    rows = rows.withColumn("ratio", ratio).withColumn("_part", part)
    usable = F.count(F.when(F.col("_expected") > 0, 1)).over(every_bin())
    rows = rows.withColumn("df", (F.greatest(usable, F.lit(1)) - 1).cast("int")).withColumn("_chi", F.sum("_part").over(every_bin()))
    out = rows.withColumn("_least", F.min(F.when(F.col("_expected") > 0, F.col("_expected"))).over(every_bin())).withColumn("chi_square", F.when(F.col("df") > 0, F.col("_chi"))).withColumn("critical", critical_95(F.col("df")))
    significant = F.when((F.col("df") > 0) & (F.col("_least") >= LEAST_EXPECTED), F.col("chi_square") > F.col("critical"))
    return out.select("bin", "label", "used", "available", "ratio", "used_total", "chi_square", "df", "critical", significant.alias("significant"))


def ratio_interval(used: Column, total: Column, available: Column, z: float = 1.96) -> Column:
    """Struct of low and high: log-normal bounds of a selection ratio; NULL where there is none."""
    p = used / F.when(total > 0, total)
    half = F.sqrt((F.lit(1.0) - p) / F.when(used > 0, used)) * z
    ratio = p / F.when(available > 0, available)
    return F.when((used > 0) & (available > 0), F.struct((ratio * F.exp(-half)).alias("low"), (ratio * F.exp(half)).alias("high")))


def readout(rows: DataFrame) -> DataFrame:
    """readout, n, best, ratio, used, worst of an analysis(): one line of text, with what it says as columns.

    Too few uses, no significance, or the bins most and least chosen of those used at all (ties: the first); columns
    beyond n are NULL where the text makes no claim. A line claims a pattern only where chi-square does.
    """
    some = (F.col("used") > 0) & F.col("ratio").isNotNull()
    by = lambda sign: F.struct("ratio", (F.col("bin") * sign).alias("bin"))
    top = F.max_by(F.when(some, F.struct("label", "ratio", "used")), F.when(some, by(-1)))
    worst = F.min_by(F.when(some, F.col("label")), F.when(some, by(1)))
    out = rows.agg(F.max("used_total").alias("n"), F.bool_or("significant").alias("sig"), top.alias("top"), worst.alias("low"))
    claims = (F.col("n") >= LEAST_USES) & F.coalesce("sig", F.lit(False)) & F.col("top").isNotNull()
    text = F.when(F.col("n") < LEAST_USES, F.format_string("Only %d uses: too few to read.", "n")).when(claims, F.format_string("%s: %.1f times its share of the ground (%d of %d uses). Least chosen: %s.", "top.label", "top.ratio", "top.used", "n", "low"))
    said = lambda c: F.when(claims, F.col(c))
    return out.select(text.otherwise(F.format_string("%d uses: no significant selection.", "n")).alias("readout"), "n", said("top.label").alias("best"), said("top.ratio").alias("ratio"), said("top.used").alias("used"), said("low").alias("worst"))


def solar_buckets(rows: DataFrame, ts: str, sun: str, step: int = 30, most: int = 240) -> DataFrame:
    """minutes, n: counts of rows by their time after the sun event (negative: before), in steps, zeros included."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    apart = (micros(ts) - micros(sun)) / F.lit(60e6)
    counted = rows.select(apart.alias("m")).where(F.abs("m") <= most).groupBy((half_up(F.col("m") / step) * step).cast("int").alias("minutes")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(-most, most + 1, step).select(F.col("id").cast("int").alias("minutes"))
    return every.join(counted, "minutes", "left").select("minutes", F.coalesce("n", F.lit(0)).alias("n"))


def pressure_label(trend: Column) -> Column:
    return F.when(trend.isNull(), "unknown").when(trend <= -3, "falling fast").when(trend <= -1, "falling").when(trend < 1, "steady").when(trend < 3, "rising").otherwise("rising fast")


def per_sit(sightings: Column, sits: Column) -> Column:
    return sightings / F.when(sits != 0, sits)


def corridor_closed_form(dx: Column, dy: Column, cell_size: float) -> Column:
    """Hours (Tobler, level ground) of the shortest 8-neighbour way between cells that far apart."""
    a, b = F.abs(dx), F.abs(dy)
    return (F.greatest(a, b) + F.least(a, b) * (math.sqrt(2) - 1)) * (cell_size / 1000 / (6 * math.exp(-3.5 * 0.05)))
