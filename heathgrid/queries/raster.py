"""Queries on a raster made of the events table, each with the SQL that DuckDB answers it with.

The raster: x = event_id mod 100, y = event_id div 100, a ridge field with noise from value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heathgrid.functions import solar, wind
from heathgrid.functions.num import shown
from heathgrid.operators import landform, surface
from heathgrid.operators.stencil import interior
from heathgrid.plans import predicate

CELL = 10.0
SUN = (35.0, 150.0)
WIND_FROM = 315.0


def raster(spark: SparkSession, sf_dir: str, voids: bool = False) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    x, y = (F.col("event_id") % 100).cast("int"), F.floor(F.col("event_id") / 100).cast("int")
    z = F.lit(500.0) + F.col("value") / 50.0 + (x - 50) * (y - 50) * 0.02
    z = F.when(F.col("event_id") % 97 != 0, z) if voids else z
    return e.select(F.lit("g").alias("grid_id"), x.alias("x"), y.alias("y"), z.alias("z"))


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster's bounds, from the scan's own columns."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.agg(F.lit(0).alias("x0"), F.lit(99).alias("x1"), F.lit(0).alias("y0"), F.floor(F.max("event_id") / 100).cast("int").alias("y1")).select(F.lit("g").alias("grid_id"), "*")


#: SQL of the raster, of its 3 x 3 windows, and of the surface, as common table expressions.
CELLS = "e as (select (event_id % 100)::int as x, (event_id // 100)::int as y, 500.0::double + value / 50 + (event_id % 100 - 50) * (event_id // 100 - 50) * 0.02::double as z from events)"
VOIDS = CELLS.replace("0.02::double as z", "0.02::double * case when event_id % 97 = 0 then null else 1 end as z")
NINE = (
    "r as (select x, y, z, lag(z) over h as l, lead(z) over h as q from e window h as (partition by y order by x)), "
    "w as (select x, y, z, lag(l) over v as nw, lag(z) over v as n, lag(q) over v as ne, l as w, q as e, lead(l) over v as sw, lead(z) over v as s, lead(q) over v as se from r window v as (partition by x order by y))"
)
GRADIENT = (
    "g as (select x, y, z, case when z is not null then (ne + 2 * e + se - nw - 2 * w - sw) / 80.0::double + 0 * (n + s) end as dx, case when z is not null then (sw + 2 * s + se - nw - 2 * n - ne) / 80.0::double + 0 * (w + e) end as dy from w), "
    "s as (select *, degrees(atan(sqrt(dx * dx + dy * dy))) as slope, case when dx is null or sqrt(dx * dx + dy * dy) < 1e-9 then -1.0::double else degrees(atan2(-dx, dy)) + case when degrees(atan2(-dx, dy)) < 0 then 360 else 0 end end as aspect from g)"
)
INSIDE = "x between {m} and 99 - {m} and y between {m} and (select max(event_id) // 100 from events) - {m}"
SURFACE = f"{CELLS}, {NINE}, {GRADIENT}"
CURVED = (
    "q as (select x, y, (nw + w + sw + ne + e + se - 2 * (n + z + s)) / 600.0::double as a, (nw + n + ne + sw + s + se - 2 * (w + z + e)) / 600.0::double as b, (ne + sw - nw - se) / 400.0::double as c, (ne + e + se - nw - w - sw) / 60.0::double as d, (nw + n + ne - sw - s - se) / 60.0::double as e from w), "
    "k as (select *, d * d + e * e as p from q), "
    "c as (select x, y, case when p < 1e-12 then 0 else 2 * (a * d * d + b * e * e + c * d * e) / (p * pow(1 + p, 1.5)) end as profile, case when p < 1e-12 then 0 else -2 * (b * d * d + a * e * e - c * d * e) / pow(p, 1.5) end as plan, "
    "case when p < 1e-12 then 0 else -2 * (a * d * d + b * e * e + c * d * e) / p end as longitudinal, case when p < 1e-12 then 0 else -2 * (b * d * d + a * e * e - c * d * e) / p end as cross_sectional, -a - b + sqrt((a - b) * (a - b) + c * c) as max_curvature, -a - b - sqrt((a - b) * (a - b) + c * c) as min_curvature from k)"
)


def box(name: str, source: str, radius: int, values: dict[str, str]) -> str:
    """SQL of sums over squares: along rows, then along columns."""
    rows = ", ".join(f"coalesce(sum({v}) over (partition by y order by x range between {radius} preceding and {radius} following), 0) as h_{k}" for k, v in values.items())
    cols = ", ".join(f"sum(h_{k}) over (partition by x order by y range between {radius} preceding and {radius} following) as {k}" for k in values)
    return f"{name}_rows as (select *, {rows} from {source}), {name} as (select * exclude ({', '.join(f'h_{k}' for k in values)}), {cols} from {name}_rows)"


MASS = {"sz": "z", "sn": "case when z is not null then 1.0::double end", "sx": "case when z is not null then x::double end", "sy": "case when z is not null then y::double end"}


def tpi_sql(name: str, source: str, radius: int, inner: int = 0) -> str:
    area = (2 * radius + 1) ** 2 - (((2 * inner + 1) ** 2) if inner else 0)
    out = box(f"{name}_o", source, radius, MASS)
    src, t = f"{name}_o", {k: k for k in MASS}
    if inner:
        out += ", " + box(f"{name}_i", f"{name}_o", inner, {f"{k}2": v for k, v in MASS.items()})
        src, t = f"{name}_i", {k: f"({k} - {k}2)" for k in MASS}
    value = f"case when z is not null and {t['sn']} > 0 and {t['sn']} >= {area} * 0.5 and ({t['sn']} = {area} or pow({t['sx']} / {t['sn']} - x, 2) + pow({t['sy']} / {t['sn']} - y, 2) <= pow(0.05::double * {radius}, 2)) then z - {t['sz']} / {t['sn']} end"
    return f"{out}, {name} as (select x, y, z, {value} as t from {src})"


def z_sql(name: str, source: str) -> str:
    return f"{name} as (select x, y, case when (select count(t) from {source}) = 0 then 0 when t is null then null when (select stddev_pop(t) from {source}) <= 1e-3 then 0 else (t - (select avg(t) from {source})) / (select stddev_pop(t) from {source}) end as v from {source})"


WEISS_CASE = "case when {s} is null or {l} is null or {p} is null then 0 when {s} <= -1 then case when {l} <= -1 then 1 when {l} >= 1 then 3 else 2 end when {s} >= 1 then case when {l} <= -1 then 8 when {l} >= 1 then 10 else 9 end when {l} <= -1 then 4 when {l} >= 1 then 7 when {p} <= 5 then 5 else 6 end"
WEISS = f"{SURFACE}, {tpi_sql('a', 'e', 3)}, {z_sql('za', 'a')}, {tpi_sql('b', 'e', 20)}, {z_sql('zb', 'b')}, weiss as (select s.x, s.y, s.z, slope, aspect, ({WEISS_CASE.format(s='za.v', l='zb.v', p='slope')})::int as weiss from s join za using (x, y) join zb using (x, y))"
WOOD_CASE = "case when slope is null or cross_sectional is null or max_curvature is null then 6 when slope > 1.5 then case when cross_sectional > 0.0015 then 4 when cross_sectional < -0.0015 then 2 else 0 end when max_curvature > 0.0015 and min_curvature > 0.0015 then 5 when max_curvature < -0.0015 and min_curvature < -0.0015 then 1 when max_curvature > 0.0015 and min_curvature < -0.0015 then 3 when max_curvature > 0.0015 or min_curvature > 0.0015 then 4 when max_curvature < -0.0015 or min_curvature < -0.0015 then 2 else 0 end"
RING = ", ".join(f"({k}, {dx}, {dy})" for k, dx, dy in landform.ring_offsets())
RING_SQL = f"o(k, dx, dy) as (values {RING}), ring as (select s.x, s.y, s.z, s.slope, count(t.slope)::int as ring_samples, count(*) filter (t.x is not null and t.slope is null)::int as ring_missing, count(*) filter (t.slope >= 18)::int as ring_steep, avg(t.slope) as ring_mean from s cross join o left join s t on t.x = s.x + o.dx and t.y = s.y + o.dy group by all)"


def at(m: int) -> str:
    return INSIDE.format(m=m)


QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def surfaced(spark: SparkSession, sf_dir: str, voids: bool = False) -> DataFrame:
    return surface.surface(raster(spark, sf_dir, voids), CELL)


@query(f"with {SURFACE} select x, y, round(slope, 6) as slope, round(aspect, 6) as aspect, round(dx, 9) + 0.0 as dzdx, round(dy, 9) + 0.0 as dzdy from s where {at(1)}")
def horn_slope_aspect(spark, sf_dir):
    out = interior(surfaced(spark, sf_dir), 1, bounds(spark, sf_dir))
    return out.select("x", "y", *(shown(F.col(k), 9 if k[0] == "d" else 6).alias(k) for k in ("slope", "aspect", "dzdx", "dzdy")))


@query(f"with {SURFACE.replace(CELLS, VOIDS)} select x, y, round(slope, 6) as slope, round(aspect, 6) as aspect from s where {at(1)}")
def horn_with_voids(spark, sf_dir):
    out = interior(surfaced(spark, sf_dir, True), 1, bounds(spark, sf_dir))
    return out.select("x", "y", shown(F.col("slope")).alias("slope"), shown(F.col("aspect")).alias("aspect"))


@query(f"with {CELLS}, {NINE}, {CURVED} select x, y, round(profile, 6) + 0.0 as curvature_profile, round(plan, 6) + 0.0 as curvature_plan, round(longitudinal, 6) + 0.0 as longitudinal, round(cross_sectional, 6) + 0.0 as cross_sectional, round(max_curvature, 6) + 0.0 as max_curvature, round(min_curvature, 6) + 0.0 as min_curvature from c where {at(1)}")
def curvature(spark, sf_dir):
    out = interior(surface.curvature(raster(spark, sf_dir), CELL), 1, bounds(spark, sf_dir))
    return out.select("x", "y", *(shown(F.col(k)).alias(k) for k in ("curvature_profile", "curvature_plan", "longitudinal", "cross_sectional", "max_curvature", "min_curvature")))


@query(f"with {CELLS}, {NINE} select x, y, round(sqrt(pow(nw - z, 2) + pow(n - z, 2) + pow(ne - z, 2) + pow(w - z, 2) + pow(e - z, 2) + pow(sw - z, 2) + pow(s - z, 2) + pow(se - z, 2)), 6) as ruggedness from w where {at(1)}")
def tri(spark, sf_dir):
    out = interior(surface.ruggedness(raster(spark, sf_dir)), 1, bounds(spark, sf_dir))
    return out.select("x", "y", shown(F.col("ruggedness")).alias("ruggedness"))


@query(f"with {SURFACE}, u as (select x, y, z, -dx / sqrt(dx * dx + dy * dy + 1) as nx, dy / sqrt(dx * dx + dy * dy + 1) as ny, 1 / sqrt(dx * dx + dy * dy + 1) as nz from s), {box('v', 'u', 4, {'a': 'nx', 'b': 'ny', 'c': 'nz', 'k': 'case when nx is not null then 1.0::double end'})} select x, y, round(case when k >= 81 * 0.75 then greatest(0, least(1, 1 - sqrt(a * a + b * b + c * c) / k)) end, 6) + 0.0 as vrm from v where {at(5)}")
def vrm(spark, sf_dir):
    out = interior(surface.vector_ruggedness(surfaced(spark, sf_dir), 4), 5, bounds(spark, sf_dir))
    return out.select("x", "y", shown(F.col("vrm")).alias("vrm"))


def _z(radius, inner=0):
    return f"with {CELLS}, {tpi_sql('a', 'e', radius, inner)}, {z_sql('za', 'a')} select x, y, round(v, 5) + 0.0 as tpi_z from za where {at(radius)}"


def _tpi(spark, sf_dir, radius, inner=0):
    scored = surface.standardized(surface.tpi(raster(spark, sf_dir), radius, "tpi", inner), "tpi", "tpi_z")
    return interior(scored, radius, bounds(spark, sf_dir)).select("x", "y", shown(F.col("tpi_z"), 5).alias("tpi_z"))


@query(_z(3))
def tpi_z_small(spark, sf_dir):
    return _tpi(spark, sf_dir, 3)


@query(_z(20))
def tpi_z_large(spark, sf_dir):
    return _tpi(spark, sf_dir, 20)


@query(_z(20, 3))
def tpi_annulus(spark, sf_dir):
    return _tpi(spark, sf_dir, 20, 3)


@query(f"with {VOIDS}, {tpi_sql('a', 'e', 3)} select x, y, round(t, 6) + 0.0 as tpi from a")
def tpi_void_quorum(spark, sf_dir):
    return surface.tpi(raster(spark, sf_dir, True), 3).select("x", "y", shown(F.col("tpi")).alias("tpi"))


def classed(spark, sf_dir):
    cells = surface.tpi(surface.tpi(surfaced(spark, sf_dir), 3, "tpi_small"), 20, "tpi_large")
    cells = surface.standardized(surface.standardized(cells, "tpi_small", "z_small"), "tpi_large", "z_large")
    return cells.withColumn("weiss", landform.weiss(F.col("z_small"), F.col("z_large"), F.col("slope")))


@query(f"with {WEISS} select x, y, weiss from weiss")
def weiss_class(spark, sf_dir):
    return classed(spark, sf_dir).select("x", "y", "weiss")


@query(f"with {WEISS} select weiss, {'case weiss ' + ' '.join(f'when {i} then {chr(39)}{n}{chr(39)}' for i, n in enumerate(landform.WEISS)) + ' end'} as label, count(*) as cells, round(count(*)::double / sum(count(*)) over (), 6) as share from weiss group by weiss")
def weiss_share(spark, sf_dir):
    counts = classed(spark, sf_dir).groupBy("weiss").agg(F.count("*").alias("cells"))
    total = counts.agg(F.sum("cells").alias("total"))
    return counts.crossJoin(total).select("weiss", landform.label(F.col("weiss"), landform.WEISS).alias("label"), "cells", F.round(F.col("cells") / F.col("total"), 6).alias("share"))


def formed(spark, sf_dir):
    cells = surface.curvature(surfaced(spark, sf_dir), CELL)
    return cells.withColumn("wood", landform.wood(F.col("slope"), F.col("cross_sectional"), F.col("max_curvature"), F.col("min_curvature"), landform.curvature_tolerance(CELL)))


@query(f"with {SURFACE}, {CURVED} select x, y, ({WOOD_CASE})::int as wood from s join c using (x, y)")
def wood_class(spark, sf_dir):
    return formed(spark, sf_dir).select("x", "y", "wood")


@query(f"with {SURFACE}, {RING_SQL} select x, y, ring_samples, ring_missing, ring_steep, round(ring_mean, 6) as ring_mean from ring")
def ring_slope_stats(spark, sf_dir):
    out = landform.ring_stats(surfaced(spark, sf_dir))
    return out.select("x", "y", "ring_samples", "ring_missing", "ring_steep", F.round("ring_mean", 6).alias("ring_mean"))


BENCH_SQL = f"with {SURFACE}, {RING_SQL}, bench as (select x, y, case when slope is null then 2 when slope <= 8 and ring_samples >= 8 and 2 * ring_steep >= ring_samples then 1 else 0 end as bench from ring)"


def benched(spark, sf_dir):
    rings = landform.ring_stats(surfaced(spark, sf_dir))
    return rings.withColumn("bench", landform.bench_candidate(F.col("slope"), F.col("ring_samples"), F.col("ring_steep")))


@query(f"{BENCH_SQL} select x, y, bench from bench")
def bench_candidates(spark, sf_dir):
    return benched(spark, sf_dir).select("x", "y", "bench")


@query(f"{BENCH_SQL}, m as materialized (select x, y from bench where bench = 1), lab as (with recursive c(x, y, rx, ry) as (select x, y, x, y from m union select m.x, m.y, c.rx, c.ry from c join m on abs(m.x - c.x) + abs(m.y - c.y) = 1) select x, y, count(*) as size from c group by x, y) select b.x, b.y, case when bench = 1 and size < 6 then 0 else bench end as bench from bench b left join lab using (x, y)")
def bench_blobs(spark, sf_dir):
    return landform.remove_small(benched(spark, sf_dir).select("grid_id", "x", "y", "bench")).select("x", "y", "bench")


@query(f"{BENCH_SQL} select count(*) filter (bench = 1) as benches, count(*) filter (bench = 0) as others, count(*) filter (bench = 2) as unmeasured, round(count(*) filter (bench = 1)::double / nullif(count(*) filter (bench < 2), 0), 6) as bench_share from bench")
def bench_share(spark, sf_dir):
    return landform.bench_counts(benched(spark, sf_dir)).select("benches", "others", "unmeasured", F.round("bench_share", 6).alias("bench_share"))


HILL = "greatest(0, (-{dx} * sin(radians({az})) * cos(radians({alt})) + {dy} * cos(radians({az})) * cos(radians({alt})) + sin(radians({alt}))) / sqrt(dx * dx + dy * dy + 1))"


def _hill(az, alt=45):
    return HILL.format(dx="dx", dy="dy", az=az, alt=alt)


@query(f"with {SURFACE} select x, y, round(case when dx is not null then {_hill(315)} end, 6) + 0.0 as hillshade from s")
def hillshade(spark, sf_dir):
    return surfaced(spark, sf_dir).select("x", "y", shown(solar.hillshade(F.col("dzdx"), F.col("dzdy"))).alias("hillshade"))


@query(f"with {SURFACE} select x, y, round(case when dx is not null then 0.2 * {_hill(225)} + 0.25 * {_hill(270)} + 0.35 * {_hill(315)} + 0.2 * {_hill(360)} end, 6) + 0.0 as hillshade from s")
def multi_hillshade(spark, sf_dir):
    return surfaced(spark, sf_dir).select("x", "y", shown(solar.multi_hillshade(F.col("dzdx"), F.col("dzdy"))).alias("hillshade"))


def _light(alt, az):
    return f"greatest(0, cos(radians(slope)) * sin(radians({alt})) + sin(radians(slope)) * cos(radians({alt})) * case when aspect < 0 then 1 else cos(radians({az} - aspect)) end)"


@query(f"with {SURFACE} select x, y, round(case when slope is not null then {_light(*SUN)} end, 6) + 0.0 as insolation from s")
def insolation(spark, sf_dir):
    return surfaced(spark, sf_dir).select("x", "y", shown(solar.insolation(F.col("slope"), F.col("aspect"), F.lit(SUN[0]), F.lit(SUN[1]))).alias("insolation"))


SUNS = [(float(a), float(z)) for a, z in zip((5, 15, 25, 33, 38, 40, 38, 33, 25, 15, 5, -5), range(100, 280, 15), strict=True)]


@query(f"with {SURFACE}, suns(alt, az) as (values {', '.join(map(str, SUNS))}) select x, y, round(sum(case when alt <= 0 or slope is null then 0 else {_light('alt', 'az')} end * 0.5), 6) + 0.0 as daily_insolation from s cross join suns group by x, y")
def daily_insolation(spark, sf_dir):
    return solar.daily_insolation(surfaced(spark, sf_dir), SUNS).select("x", "y", shown(F.col("daily_insolation")).alias("daily_insolation"))


EXPOSURE = f"case when slope is null then null when aspect < 0 then 0 else cos(radians(aspect - {WIND_FROM})) end"


@query(f"with {SURFACE} select x, y, round({EXPOSURE}, 6) + 0.0 as wind_exposure from s")
def wind_exposure(spark, sf_dir):
    return surfaced(spark, sf_dir).select("x", "y", shown(wind.wind_exposure(F.col("slope"), F.col("aspect"), WIND_FROM)).alias("wind_exposure"))


@query(f"with {SURFACE}, {CURVED}, b as (select s.*, plan from s join c using (x, y)), p(phase) as (values ('rising'), ('sinking'), ('transition')) select x, y, phase, round(case when slope is null or aspect < 0 then -1 when phase = 'rising' then (aspect + 180) - 360 * floor((aspect + 180) / 360) else aspect end, 6) + 0.0 as scent_azimuth, round(case when slope is null then null when aspect < 0 then 0 else least(1, least(1, slope / 30) * case phase when 'sinking' then case when plan < 0 then 1 + least(1, abs(plan) * 200) else 1 end when 'rising' then greatest(0.1, {_light(*SUN)}) else 0.35 end) end, 6) + 0.0 as strength from b cross join p")
def thermals(spark, sf_dir):
    cells = surface.curvature(surfaced(spark, sf_dir), CELL)
    sun = solar.insolation(F.col("slope"), F.col("aspect"), F.lit(SUN[0]), F.lit(SUN[1]))
    each = F.array(*(F.struct(F.lit(p).alias("phase"), wind.thermals(F.col("slope"), F.col("aspect"), F.col("curvature_plan"), p, sun).alias("t")) for p in ("rising", "sinking", "transition")))
    rows = cells.select("x", "y", F.explode(each).alias("r"))
    return rows.select("x", "y", "r.phase", shown(F.col("r.t.scent_azimuth")).alias("scent_azimuth"), shown(F.col("r.t.strength")).alias("strength"))


# ---- predicates -------------------------------------------------------------------------------------


def fields(spark, sf_dir):
    """Every field that the preset predicates read."""
    cells = surface.curvature(classed(spark, sf_dir), CELL)
    wood = landform.wood(F.col("slope"), F.col("cross_sectional"), F.col("max_curvature"), F.col("min_curvature"), landform.curvature_tolerance(CELL))
    exposure = wind.wind_exposure(F.col("slope"), F.col("aspect"), WIND_FROM)
    return cells.withColumn("wood", wood).withColumn("wind_exposure", exposure).withColumn("insolation", solar.insolation(F.col("slope"), F.col("aspect"), F.lit(SUN[0]), F.lit(SUN[1])))


FIELDS = f"{WEISS}, {CURVED}, f as (select weiss.*, plan as curvature_plan, ({WOOD_CASE})::int as wood, {EXPOSURE} as wind_exposure, case when slope is not null then {_light(*SUN)} end as insolation from weiss join c using (x, y))"
CASES = {
    "slope 8-20": ({"kind": "range", "metric": "slope", "min": 8, "max": 20}, "coalesce(slope between 8 and 20, false)"),
    "aspect wraps": ({"kind": "aspect", "centerDeg": 350, "toleranceDeg": 30, "includeFlat": False}, "aspect >= 0 and (aspect >= 320 or aspect <= 20)"),
    "flat too": ({"kind": "aspect", "centerDeg": 180, "toleranceDeg": 20, "includeFlat": True}, "(aspect >= 160 and aspect <= 200) or (aspect < 0 and slope is not null)"),
    "weiss in": ({"kind": "weiss", "classes": [1, 10, 6]}, "weiss in (1, 6, 10)"),
    "wood in": ({"kind": "wood", "features": [2, 4]}, "wood in (2, 4)"),
    "not steep": ({"kind": "not", "operand": {"kind": "range", "metric": "slope", "min": 10}}, "not coalesce(slope >= 10, false)"),
    "any": ({"kind": "any", "operands": [{"kind": "range", "metric": "insolation", "max": 0.2}, {"kind": "wood", "features": [3]}]}, "coalesce(insolation <= 0.2, false) or wood = 3"),
    "all of none": ({"kind": "all", "operands": []}, "true"),
    "any of none": ({"kind": "any", "operands": []}, "false"),
    "absent field": ({"kind": "range", "metric": "skyView", "min": 0}, "false"),
    "Leeward spur points": (predicate.PRESETS["Leeward spur points"], "weiss in (8, 9) and coalesce(wind_exposure <= -0.25, false) and coalesce(slope between 10 and 35, false)"),
    "Late-season sun": (predicate.PRESETS["Late-season sun slopes"], "coalesce(insolation >= 0.6 and slope >= 5, false)"),
    "Sidehill": (predicate.PRESETS["Sidehill walkable grade"], "coalesce(slope between 8 and 20, false)"),
    "Saddles": (predicate.PRESETS["Saddles & crossings"], "wood = 3"),
    "Midslope drainages": (predicate.PRESETS["Midslope drainages"], "weiss = 2 and coalesce(slope between 3 and 30, false)"),
}


@query(f"with {FIELDS} " + " union all ".join(f"select '{k}' as name, count(*) as cells, count(*) filter ({sql}) as matched, round(avg(case when {sql} then 1.0::double else 0 end), 6) as share, case when avg(case when {sql} then 1.0::double else 0 end) > 0.35 then 'tighten' when avg(case when {sql} then 1.0::double else 0 end) < 0.002 then 'loosen' end as advice from f" for k, (_, sql) in CASES.items()))
def match_shares(spark, sf_dir):
    cells = fields(spark, sf_dir)
    flags = [F.sum(predicate.compiled(p, cells.columns).cast("long")).alias(f"m{i}") for i, (p, _) in enumerate(CASES.values())]
    one = cells.agg(F.count("*").alias("cells"), *flags)  # all predicates in one pass
    rows = one.select("cells", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(f"m{i}").alias("matched")) for i, k in enumerate(CASES)))).alias("r"))
    share = F.col("r.matched") / F.col("cells")
    return rows.select("r.name", "cells", "r.matched", F.round(share, 6).alias("share"), predicate.advice(share).alias("advice"))


@query(f"with {SURFACE}, t as (select *, case when slope is null then 'unknown' when slope < 8 then '0-8' when slope < 20 then '8-20' when slope < 30 then '20-30' when slope < 45 then '30-45' else '45+' end as band from s where {at(1)}) select band, count(*) as cells, round(avg(case when slope between 8 and 20 then 1.0::double else 0 end), 6) as match_share from t group by band")
def slope_band_match(spark, sf_dir):
    from heathgrid.functions.num import steps

    cells = interior(surfaced(spark, sf_dir), 1, bounds(spark, sf_dir))
    band = F.coalesce(steps(F.col("slope"), [(8, "0-8"), (20, "8-20"), (30, "20-30"), (45, "30-45")], "45+"), F.lit("unknown"))
    match = predicate.compiled({"kind": "range", "metric": "slope", "min": 8, "max": 20}, cells.columns)
    return cells.groupBy(band.alias("band")).agg(F.count("*").alias("cells"), F.round(F.avg(match.cast("double")), 6).alias("match_share"))
