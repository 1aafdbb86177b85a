"""Queries on field observations, properties and calendars, each with the SQL that DuckDB answers it with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heathgrid.functions import season, solar
from heathgrid.functions.num import shown
from heathgrid.operators import cascade, cost, fieldlog, landform, selection
from heathgrid.queries import raster as r

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field observations made of the events table."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.element_at(F.create_map(*(F.lit(x) for x in ("view", "SIGHTING", "click", "TRAIL_CAMERA", "purchase", "HARVEST", "signup", "SIGN", "error", "SIT"))), F.col("event_type"))
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("property_id"), F.col("ts").alias("observed_at"), kind.alias("kind"),
        F.when(F.col("user_id") % 3 == 0, "BUCK").when(F.col("user_id") % 3 == 1, "DOE").otherwise("UNKNOWN").alias("sex"), (F.col("value") % 7).alias("estimated_age"),
        ((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0)).alias("is_blank_sit"), (F.col("value") % 8 - 4).alias("pressure_trend_3h"),
        ((F.col("event_id") * 37) % 360).cast("double").alias("wind_from_deg"), (F.lit(39.0) + (F.col("event_id") % 100) / 100.0).alias("lat"),
        (F.lit(-84.0) + F.floor(F.col("event_id") / 100) / 100.0).alias("lng"), (F.col("event_id") % 100).cast("int").alias("x"), F.floor(F.col("event_id") / 100).cast("int").alias("y"),
    )


OBS = (
    "obs as (select event_id as id, user_id % 5 as property_id, ts as observed_at, case event_type when 'view' then 'SIGHTING' when 'click' then 'TRAIL_CAMERA' when 'purchase' then 'HARVEST' when 'signup' then 'SIGN' when 'error' then 'SIT' end as kind, "
    "case user_id % 3 when 0 then 'BUCK' when 1 then 'DOE' else 'UNKNOWN' end as sex, value % 7 as estimated_age, event_type = 'error' and event_id % 2 = 0 as is_blank_sit, value % 8 - 4 as pressure_trend_3h, ((event_id * 37) % 360)::double as wind_from_deg, "
    "39.0::double + (event_id % 100) / 100.0::double as lat, -84.0::double + (event_id // 100) / 100.0::double as lng, (event_id % 100)::int as x, (event_id // 100)::int as y from events)"
)


def stamped(spark, sf_dir):
    """Observations with the terrain of their cell, NULL where it isn't known."""
    cells = r.classed(spark, sf_dir).select("x", "y", "z", "slope", "aspect", "weiss")
    return observations(spark, sf_dir).join(cells, ["x", "y"], "left")


STAMPED = f"{r.WEISS}, {OBS}, st as (select obs.*, w.z, w.slope, w.aspect, w.weiss from obs left join weiss w using (x, y))"


@query(f"with {STAMPED} select id, round(z, 6) as elevation_m, round(slope, 6) as slope_deg, round(aspect, 6) as aspect_deg, weiss as landform_class from st")
def stamp_observations(spark, sf_dir):
    return stamped(spark, sf_dir).select("id", shown(F.col("z")).alias("elevation_m"), shown(F.col("slope")).alias("slope_deg"), shown(F.col("aspect")).alias("aspect_deg"), F.col("weiss").alias("landform_class"))


BINS = {"slope": (selection.SLOPE_BINS, "slope"), "aspect": (selection.ASPECT_BINS, "aspect")}


def _bin_sql(name: str) -> str:
    bins, c = BINS[name]
    cases = " ".join(f"when {c} >= {lo} {'or' if lo > hi else 'and'} {c} < {hi} then {i}" for i, (_, lo, hi) in enumerate(bins))
    return f"case when {c} is null then null {'when ' + c + ' < 0 then {flat}' if name == 'aspect' else ''} {cases} else -1 end"


def _shares_sql(name: str) -> str:
    bins = BINS[name][0]
    b = _bin_sql(name).replace("{flat}", "-1")
    return f"bins(bin, label) as (values {', '.join(f'({i}, {chr(39)}{n}{chr(39)})' for i, (n, _, _) in enumerate(bins))}), cnt as (select {b} as bin, count(*) as n from s group by 1), sh as (select bins.bin, label, coalesce(n, 0) as cells, coalesce(coalesce(n, 0)::double / nullif(sum(coalesce(n, 0)) over (), 0), 0) as share from bins left join cnt using (bin))"


def _shares(spark, sf_dir, name):
    bins, c = BINS[name]
    cells = r.surfaced(spark, sf_dir)
    value = F.when(F.col(c) >= 0, F.col(c)) if name == "aspect" else F.col(c)
    return selection.shares(cells, selection.bin_index(value, bins), bins)


def _register_shares(name: str):
    @query(f"with {r.SURFACE}, {_shares_sql(name)} select bin, label, cells, round(share, 6) as share from sh")
    def f(spark, sf_dir):
        return _shares(spark, sf_dir, name).select("bin", "label", "cells", F.round("share", 6).alias("share"))

    QUERIES[f"shares_{name}"], ORACLE[f"shares_{name}"] = QUERIES.pop("f"), ORACLE.pop("f")

    # use counts flat ground (-1) in the wrapping north bin, availability doesn't
    use = _bin_sql(name).replace("{flat}", "0")
    sql = (
        f"with {r.WEISS}, {OBS}, {_shares_sql(name)}, u as (select {use} as bin, count(*) as used from (select o.id, s.slope, s.aspect from obs o join s on o.x = s.x and o.y = s.y where kind = 'HARVEST') group by 1), "
        "t as (select bin, label, coalesce(used, 0) as used, share / (select sum(share) from sh) as available from sh left join u using (bin)), n as (select sum(used) as total from t), "
        "q as (select t.*, total, available * total as ex from t, n), k as (select greatest(count(*) filter (ex > 0), 1) - 1 as df, sum(case when ex > 0 then pow(used - ex, 2) / ex end) as chi, min(case when ex > 0 then ex end) as least from q) "
        "select bin, label, used, round(available, 6) as available, round(case when available > 0 then used / total / available end, 6) as ratio, total::bigint as used_total, round(case when df > 0 then chi end, 5) as chi_square, df::int as df, "
        f"case df when 4 then 9.488::double when 3 then 7.815::double when 2 then 5.991::double when 1 then 3.841::double when 7 then 14.067::double when 6 then 12.592::double when 5 then 11.07::double end as critical, "
        "case when df > 0 and least >= 5 then chi > case df when 4 then 9.488 when 3 then 7.815 when 2 then 5.991 when 1 then 3.841 when 7 then 14.067 when 6 then 12.592 when 5 then 11.07 end end as significant from q, k"
    )

    @query(sql)
    def g(spark, sf_dir):
        rows = _analysis(spark, sf_dir, name)
        return rows.withColumns({k: F.round(k, 5 if k == "chi_square" else 6) for k in ("available", "ratio", "chi_square")})

    QUERIES[f"selection_{name}"], ORACLE[f"selection_{name}"] = QUERIES.pop("g"), ORACLE.pop("g")


def _analysis(spark, sf_dir, name):
    bins, c = BINS[name]
    harvest = observations(spark, sf_dir).where("kind = 'HARVEST'").join(r.surfaced(spark, sf_dir).select("x", "y", "slope", "aspect"), ["x", "y"])
    return selection.analysis(harvest.select(selection.bin_index(F.col(c), bins).alias("bin")), _shares(spark, sf_dir, name))


for _name in BINS:
    _register_shares(_name)


_READ = (
    "t as (select max(used_total) as n, bool_or(significant) as sig, arg_max(label, (ratio, -bin)) filter (used > 0 and ratio is not null) as best, max(ratio) filter (used > 0) as ratio, arg_max(used, (ratio, -bin)) filter (used > 0 and ratio is not null) as used, arg_min(label, (ratio, bin)) filter (used > 0 and ratio is not null) as worst from a), "
    "c as (select *, n >= 10 and coalesce(sig, false) and best is not null as ok from t) "
    "select case when n < 10 then printf('Only %d uses: too few to read.', n::bigint) when ok then printf('%s: %.1f times its share of the ground (%d of %d uses). Least chosen: %s.', best, ratio, used::bigint, n::bigint, worst) else printf('%d uses: no significant selection.', n::bigint) end as readout, n, case when ok then best end as best, case when ok then ratio end as ratio, case when ok then used end as used, case when ok then worst end as worst from c"
)


def _register_readout(name: str):
    @query(f"with a as ({ORACLE[f'selection_{name}']}), {_READ}")
    def f(spark, sf_dir):
        return selection.readout(_analysis(spark, sf_dir, name)).withColumn("ratio", F.round("ratio", 6))

    key = "selection_readout" if name == "slope" else f"selection_readout_{name}"
    QUERIES[key], ORACLE[key] = QUERIES.pop("f"), ORACLE.pop("f")


for _name in BINS:
    _register_readout(_name)


@query("with t(used, total, p) as (select l_linenumber, 40, 0.02 * l_linenumber from lineitem) select used::bigint as used, count(*) as n, round(max(used / 40.0::double / p * exp(-1.96 * sqrt((1 - used / 40.0::double) / used))), 6) as low, round(max(used / 40.0::double / p * exp(1.96 * sqrt((1 - used / 40.0::double) / used))), 6) as high from t group by used")
def selection_ci(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_linenumber").cast("bigint").alias("used"))
    rows = rows.withColumn("i", selection.ratio_interval(F.col("used"), F.lit(40.0), F.col("used") * 0.02))
    return rows.groupBy("used").agg(F.count("*").alias("n"), F.round(F.max("i.low"), 6).alias("low"), F.round(F.max("i.high"), 6).alias("high"))


@query(f"with {OBS} select case when pressure_trend_3h is null then 'unknown' when pressure_trend_3h <= -3 then 'falling fast' when pressure_trend_3h <= -1 then 'falling' when pressure_trend_3h < 1 then 'steady' when pressure_trend_3h < 3 then 'rising' else 'rising fast' end as trend, count(*) as n from obs where kind = 'SIGHTING' group by 1")
def pressure_groups(spark, sf_dir):
    return observations(spark, sf_dir).where("kind = 'SIGHTING'").groupBy(selection.pressure_label(F.col("pressure_trend_3h")).alias("trend")).agg(F.count("*").alias("n"))


@query(f"with {OBS} select (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[(floor((wind_from_deg + 22.5) / 45)::int % 8) + 1] as octant, count(*) as n from obs group by 1")
def wind_octants(spark, sf_dir):
    return observations(spark, sf_dir).groupBy(landform.octant(F.col("wind_from_deg")).alias("octant")).agg(F.count("*").alias("n"))


@query(f"with {OBS} select property_id, count(*) filter (kind = 'SIGHTING') as sightings, count(*) filter (kind = 'SIT' or is_blank_sit) + count(*) filter (kind = 'SIGHTING') as sits, round(count(*) filter (kind = 'SIGHTING')::double / nullif(count(*) filter (kind = 'SIT' or is_blank_sit) + count(*) filter (kind = 'SIGHTING'), 0), 6) as per_sit, count(*) filter (kind = 'SIGHTING' and sex = 'BUCK' and estimated_age >= 3.5) as mature from obs group by property_id")
def movement_dashboard(spark, sf_dir):
    when = lambda c: F.count(F.when(c, 1))
    seen, sat = F.col("kind") == "SIGHTING", (F.col("kind") == "SIT") | F.col("is_blank_sit")
    out = observations(spark, sf_dir).groupBy("property_id").agg(when(seen).alias("sightings"), (when(sat) + when(seen)).alias("sits"), when(seen & (F.col("sex") == "BUCK") & (F.col("estimated_age") >= 3.5)).alias("mature"))
    return out.withColumn("per_sit", F.round(selection.per_sit(F.col("sightings"), F.col("sits")), 6))


LAT = "(20 + (o_orderkey % 3000) / 100.0::double) * case when o_orderkey % 7 = 0 then -1 else 1 end"
DAYS = f"d as (select o_orderkey, o_orderdate, {LAT} as lat, dayofyear(o_orderdate) as doy from orders), p as (select *, (case when abs(lat) >= 40 then 319 when abs(lat) >= 34 then 319 + floor((40 - abs(lat)) * 1.2 + 0.5) else 326 + floor((34 - abs(lat)) * 3.5 + 0.5) end)::int as base from d), w as (select *, doy - case when lat < 0 then (base + 181) % 365 + 1 else base end as raw from p), k as (select *, (case when raw > 182 then raw - 365 when raw < -182 then raw + 365 else raw end)::int as days from w)"
PHASE = "case when days < -60 then 'OffSeason' when days < -21 then 'PreRut' when days < -10 then 'Seeking' when days < -2 then 'Chasing' when days < 8 then 'PeakBreeding' when days < 24 then 'PostRut' when days < 38 then 'SecondRut' when days < 75 then 'LateSeason' else 'OffSeason' end"


def orders(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lat = (F.lit(20.0) + (F.col("o_orderkey") % 3000) / 100.0) * F.when(F.col("o_orderkey") % 7 == 0, -1).otherwise(1)
    return o.select("o_orderkey", "o_orderdate", lat.alias("lat"), F.dayofyear("o_orderdate").alias("doy"))


@query(f"with {DAYS} select o_orderkey, days as days_from_peak, {PHASE} as phase, case when abs(lat) >= 38 then 0.9::double when abs(lat) >= 32 then 0.65::double when abs(lat) >= 28 then 0.4::double else 0.2::double end as confidence from k")
def rut_phase(spark, sf_dir):
    rows = orders(spark, sf_dir).withColumn("r", season.reading(F.col("doy"), F.col("lat"), F.lit("WHITETAIL")))
    return rows.select("o_orderkey", "r.days_from_peak", "r.phase", "r.confidence")


@query(f"with {DAYS}, m as (select o_orderkey % 25 as property_id, floor(median(days) + 6 + 0.5)::int as o, count(*) as n from k where days between -30 and 10 group by 1) select property_id, case when n >= 3 and abs(o) <= 14 then o end as offset_days from m")
def calibrate_offset(spark, sf_dir):
    rows = orders(spark, sf_dir).withColumn("days", season.days_from_peak(F.col("doy"), F.col("lat"))).where("days between -30 and 10")
    return rows.groupBy((F.col("o_orderkey") % 25).alias("property_id")).agg(season.calibrated_offset(F.col("days")).alias("offset_days"))


MOON = "((epoch_us(ts) / 1e6 - 947182440) / (86400.0::double * 29.530588853::double))"


@query(f"select event_id, round({MOON} - floor({MOON}), 6) as phase, (['New moon', 'Waxing crescent', 'First quarter', 'Waxing gibbous', 'Full moon', 'Waning gibbous', 'Last quarter', 'Waning crescent'])[floor(({MOON} - floor({MOON})) * 8 + 0.5)::int % 8 + 1] as label from events")
def moon_phase(spark, sf_dir):
    p = season.moon(F.col("ts"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(p, 6).alias("phase"), season.moon_label(p).alias("label"))


T = "((epoch_us(ts) / 1e6 / 86400 + 2440587.5 - 2451545.0) / 36525)"
SUN = (
    f"a as (select event_id, ts, 39.0::double + (event_id % 100) / 100.0::double as lat, -84.0::double + (event_id // 100 % 100) / 100.0::double as lng, {T} as t from events), "
    "b as (select *, (280.46646::double + t * (36000.76983::double + t * 0.0003032::double)) as l00, radians(357.52911::double + t * (35999.05029::double - 0.0001537::double * t)) as m, radians(125.04::double - 1934.136::double * t) as om, 0.016708634::double - t * (0.000042037::double + 0.0000001267::double * t) as ec from a), "
    "c as (select *, l00 - 360 * floor(l00 / 360) as l0 from b), "
    "d as (select *, radians(l0 + sin(m) * (1.914602::double - t * (0.004817::double + 0.000014::double * t)) + sin(2 * m) * (0.019993::double - 0.000101::double * t) + sin(3 * m) * 0.000289::double - 0.00569::double - 0.00478::double * sin(om)) as ap, radians(23 + (26 + (21.448::double - t * (46.815::double + t * (0.00059::double - t * 0.001813::double))) / 60) / 60 + 0.00256::double * cos(om)) as ep from c), "
    "e as (select *, asin(sin(ep) * sin(ap)) as de, pow(tan(ep / 2), 2) as y, 2 * radians(l0) as l2 from d), "
    "f as (select *, 4 * degrees(y * sin(l2) - 2 * ec * sin(m) + 4 * ec * y * sin(m) * cos(l2) - 0.5 * y * y * sin(2 * l2) - 1.25 * ec * ec * sin(2 * m)) as eq from e), "
    "g as (select *, hour(ts) * 60 + minute(ts) + second(ts) / 60.0::double + eq + 4 * lng as tst from f), "
    "h as (select *, (tst - 1440 * floor(tst / 1440)) / 4 - 180 as ha from g), "
    "i as (select *, acos(greatest(-1, least(1, sin(radians(lat)) * sin(de) + cos(radians(lat)) * cos(de) * cos(radians(ha))))) as z from h), "
    "j as (select *, degrees(acos(greatest(-1, least(1, (sin(radians(lat)) * cos(z) - sin(de)) / (cos(radians(lat)) * sin(z)))))) as az from i)"
)


@query(f"with {SUN} select event_id, round(90 - degrees(z), 5) + 0.0 as altitude, round(case when ha > 0 then (az + 180) - 360 * floor((az + 180) / 360) else (540 - az) - 360 * floor((540 - az) / 360) end, 4) as azimuth from j")
def solar_position(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    sun = solar.sun(F.col("ts"), F.lit(39.0) + (F.col("event_id") % 100) / 100.0, F.lit(-84.0) + F.floor(F.col("event_id") / 100) % 100 / 100.0)
    return e.select("event_id", sun.alias("s")).select("event_id", shown(F.col("s.altitude"), 5).alias("altitude"), F.round("s.azimuth", 4).alias("azimuth"))


def _altitude_sql(rows: str) -> str:
    """rows (tm in seconds, lat, lng, ...) with the sun's altitude as alt."""
    layers = [
        "*, (tm / 86400 + 2440587.5::double - 2451545.0::double) / 36525 as t",
        "*, 280.46646::double + t * 36000.76983::double + t * t * 0.0003032::double as l00, radians(357.52911::double + t * 35999.05029::double - t * t * 0.0001537::double) as m, radians(125.04::double - 1934.136::double * t) as om, 0.016708634::double - t * 0.000042037::double - t * t * 0.0000001267::double as ec",
        "*, l00 - 360 * floor(l00 / 360) as l0",
        "*, radians(l0 + sin(m) * (1.914602::double - t * 0.004817::double - t * t * 0.000014::double) + sin(2 * m) * (0.019993::double - t * 0.000101::double) + sin(3 * m) * 0.000289::double - 0.00569::double - 0.00478::double * sin(om)) as ap, "
        "radians(23 + 26 / 60.0::double + 21.448::double / 3600 - t * 46.815::double / 3600 - t * t * 0.00059::double / 3600 + t * t * t * 0.001813::double / 3600 + cos(om) * 0.00256::double) as ep",
        "*, asin(sin(ep) * sin(ap)) as de, pow(tan(ep / 2), 2) as y, 2 * radians(l0) as l2",
        "*, 4 * degrees(y * sin(l2) - 2 * ec * sin(m) + 4 * ec * y * sin(m) * cos(l2) - 0.5 * y * y * sin(2 * l2) - 1.25 * ec * ec * sin(2 * m)) as eq",
        "*, (tm - 86400 * floor(tm / 86400)) / 60 + eq + 4 * lng as tst",
        "*, radians((tst - 1440 * floor(tst / 1440)) / 4 - 180) as ha",
        "* exclude (t, l00, m, om, ec, l0, ap, ep, de, y, l2, eq, tst, ha), 90 - degrees(acos(greatest(-1, least(1, sin(radians(lat)) * sin(de) + cos(radians(lat)) * cos(de) * cos(ha))))) as alt",
    ]
    for layer in layers:
        rows = f"(select {layer} from {rows})"
    return rows


def _sun_times_sql(rows: str) -> str:
    """Common table expressions from rows (observed_at, lat, lng, ...): st has the rows with sunrise and sunset."""
    out = (
        f"keyed as (select *, floor((epoch(observed_at) + lng * 240) / 86400) * 86400 - lng * 240 as start from {rows}), sd as (select distinct start, lat, lng from keyed), "
        f"su as (select start, lat, lng, k, alt > 0 as up from {_altitude_sql('(select *, start + k * 600 as tm from sd, range(145) r(k))')}), sw as (select *, lag(up) over (partition by start, lat, lng order by k) as was from su), "
        "s0 as (select start, lat, lng, up as rise, min(k - 1) * 600.0::double as low from sw where up <> was group by 1, 2, 3, 4)"
    )
    for i in range(20):
        width = 600 / 2 ** (i + 1)
        source = f"(select *, start + low + {width}::double as tm from s{i})"
        out += f", s{i + 1} as (select start, lat, lng, rise, case when (alt > 0) = rise then low else low + {width}::double end as low from {_altitude_sql(source)})"
    at = lambda rise: f"make_timestamp(floor((start + max(low) filter (rise = {rise})) * 1e6)::bigint)"
    return f"{out}, times as (select start, lat, lng, {at('true')} as sunrise, {at('false')} as sunset from s20 group by start, lat, lng), st as (select keyed.*, sunrise, sunset from keyed left join times using (start, lat, lng))"


_PLACED = f"{OBS.replace('obs as (', 'obs0 as (', 1)}, obs as (select * exclude (lat, lng), 39.7::double as lat, -84.2::double as lng from obs0)"


@query(f"with {_PLACED}, {_sun_times_sql('obs')} select id, sunrise, sunset from st")
def sun_times(spark, sf_dir):
    rows = observations(spark, sf_dir).select("id", "observed_at", F.lit(39.7).alias("lat"), F.lit(-84.2).alias("lng"))
    return solar.sun_times(rows, "observed_at", "lat", "lng").select("id", "sunrise", "sunset")


def _buckets_sql(event: str) -> str:
    return f"with {_PLACED}, {_sun_times_sql('obs')}, d as (select date_diff('microsecond', {event}, observed_at) / 60e6 as m from st where kind = 'SIGHTING'), c as (select (floor(m / 30 + 0.5) * 30)::int as minutes, count(*) as n from d where abs(m) <= 240 group by 1) select g::int as minutes, coalesce(n, 0) as n from generate_series(-240, 240, 30) t(g) left join c on minutes = g"


def _buckets(spark, sf_dir, event):
    """Sightings by their time after the day's own sunrise or sunset."""
    rows = observations(spark, sf_dir).where("kind = 'SIGHTING'").withColumns({"lat": F.lit(39.7), "lng": F.lit(-84.2)})
    return selection.solar_buckets(solar.sun_times(rows, "observed_at", "lat", "lng"), "observed_at", event)


@query(_buckets_sql("sunrise"))
def solar_buckets(spark, sf_dir):
    return _buckets(spark, sf_dir, "sunrise")


@query(_buckets_sql("sunset"))
def sunset_buckets(spark, sf_dir):
    return _buckets(spark, sf_dir, "sunset")


# ---- relations: customers own orders as properties and their children; suppliers are members of nations --------


def properties(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("owner_id"), F.col("c_name").alias("name"))


def memberships(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    role = F.element_at(F.array(*map(F.lit, fieldlog.ROLES[:3])), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return s.select((F.col("s_suppkey") * 7 % 150 + 1).alias("property_id"), F.col("s_nationkey").alias("user_id"), role.alias("role"))


MEMBERS = "m as (select s_suppkey * 7 % 150 + 1 as property_id, s_nationkey as user_id, (['OBSERVER', 'HUNTER', 'MANAGER'])[(s_suppkey % 3 + 1)::int] as role, s_suppkey % 3 as rk from supplier where s_nationkey = 3)"


@query(f"with {MEMBERS}, b as (select property_id, arg_max(role, rk) as role, max(rk) as rk from m group by 1) select c_custkey as id, case when c_nationkey = 3 then 'OWNER' else role end as role, case when c_nationkey = 3 then true else coalesce(rk >= 2, false) end as allowed from customer left join b on c_custkey = property_id")
def property_access(spark, sf_dir):
    return fieldlog.access(properties(spark, sf_dir), memberships(spark, sf_dir), F.lit(3), "MANAGER").select("id", "role", "allowed")


@query(f"with {MEMBERS} select c_custkey as id, c_name as name from customer where c_nationkey = 3 or c_custkey in (select property_id from m)")
def visible_properties(spark, sf_dir):
    return fieldlog.visible(properties(spark, sf_dir), memberships(spark, sf_dir), F.lit(3)).select("id", "name")


@query("select c_custkey as id, (select count(*) from orders where o_custkey = c_custkey) as n_orders, (select count(*) from supplier where s_suppkey * 7 % 150 + 1 = c_custkey) as n_members from customer")
def property_counts(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("property_id"))
    return fieldlog.with_counts(properties(spark, sf_dir), n_orders=o, n_members=memberships(spark, sf_dir)).select("id", "n_orders", "n_members")


@query(f"with {OBS} select id, observed_at from obs where kind = 'SIGHTING' and sex = 'BUCK' order by observed_at desc, id limit 2000")
def latest_observations(spark, sf_dir):
    return fieldlog.latest(observations(spark, sf_dir), kind="SIGHTING", sex="BUCK").select("id", "observed_at")


VERSIONS = "(event_id * 31) % 200 as entity_id, event_id as seq, (event_id * 17) % 4 as base_version"


@query(f"with recursive q as (select {VERSIONS} from events), o as (select *, row_number() over (partition by entity_id order by seq) as n from q), w(entity_id, n, seq, base_version, v, hit) as (select entity_id, n, seq, base_version, case when base_version = 1 then 2 else 1 end, base_version = 1 from o where n = 1 union all select o.entity_id, o.n, o.seq, o.base_version, case when o.base_version = w.v then w.v + 1 else w.v end, o.base_version = w.v from w join o on o.entity_id = w.entity_id and o.n = w.n + 1) select entity_id, seq, base_version, case when hit then 'applied' else 'conflict' end as status, v::bigint as version from w")
def optimistic_conflict(spark, sf_dir):
    q = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*VERSIONS.split(", "))
    entities = q.select(F.col("entity_id").alias("id"), F.lit(1).cast("bigint").alias("version")).distinct()
    return fieldlog.replayed(q, entities)


QUEUE = "user_id % 50 as queue_id, event_id as seq, case when event_id % 41 = 0 then 'offline' when event_id % 13 = 0 then 'conflict' when event_id % 17 = 0 then 'error' else 'ok' end as outcome"


@query(f"select queue_id, seq, case when max((outcome = 'offline')::int) over (partition by queue_id order by seq rows unbounded preceding) = 1 then 'queued' when outcome = 'ok' then 'sent' else outcome end as state from (select {QUEUE} from events)")
def queue_replay(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id % 50 as queue_id", "event_id as seq", QUEUE.split(", ", 2)[2])
    return fieldlog.flushed(rows).select("queue_id", "seq", "state")


@query("with i as (select event_id as seq, case when event_id % 5 = 0 then null else 'c' || (event_id * 7 % 3000) end as client_id from events), f as (select * from i where client_id is not null qualify row_number() over (partition by client_id order by seq) = 1) select seq, client_id from f where client_id not in (select 'c' || c_custkey from customer) union all select seq, client_id from i where client_id is null")
def dedupe_client_id(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id as seq", "if(event_id % 5 = 0, null, concat('c', event_id * 7 % 3000)) as client_id")
    held = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("concat('c', c_custkey) as client_id")
    return fieldlog.new_rows(rows, held).select("seq", "client_id")


# ---- cost ---------------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, round(6 * exp(-3.5 * abs(l_discount::double - 0.05 + 0.05)), 6) as speed from lineitem")
def tobler(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.round(cost.tobler(F.col("l_discount").cast("double") - 0.05), 6).alias("speed"))


_NLCD = " ".join(f"when {k} then {v}::double" for k, v in cost.NLCD.items())


@query(f"select p_partkey, (p_size + 10)::int as code, case (p_size + 10) when 11 then null when 24 then null {_NLCD} else 1.5::double end as resistance from part")
def nlcd_resistance(spark, sf_dir):
    code = (F.col("p_size") + 10).cast("int")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", code.alias("code"), cost.resistance(code).alias("resistance"))


def cost_cells(spark, sf_dir):
    cells = r.surfaced(spark, sf_dir)
    return cells.withColumn("base", cost.base_cost(F.col("slope"), F.lit(1.0) + F.col("x") % 3, F.col("y") % 10 / 10.0))


BASE = f"{r.SURFACE}, k as (select x, y, dx as gx, dy as gy, case when slope < 55 then (1 + x % 3) * (1 - 0.5 * (y % 10) / 10.0::double) end as base from s)"


@query(f"with {BASE}, o(ox, oy) as (select a, b from range(-1, 2) t(a), range(-1, 2) u(b) where a <> 0 or b <> 0), j as (select a.x, a.y, b.x as to_x, b.y as to_y, a.base as b0, b.base as b1, sqrt(ox * ox + oy * oy) * 10 as way, ((a.gx + b.gx) * ox + (a.gy + b.gy) * oy) * 5 as rise from k a cross join o join k b on b.x = a.x + ox and b.y = a.y + oy where a.base is not null and b.base is not null) select x, y, to_x, to_y, round(way / 1000 / (6 * exp(-3.5 * abs(rise / way + 0.05))) * (b0 + b1) / 2, 7) as cost from j")
def edge_step_cost(spark, sf_dir):
    return cost.step_costs(cost_cells(spark, sf_dir), r.CELL).select("x", "y", "to_x", "to_y", F.round("cost", 7).alias("cost"))


@query(f"with {r.CELLS} select x, y, round((greatest(abs(x - 20), abs(y - 5)) + (sqrt(2) - 1) * least(abs(x - 20), abs(y - 5))) * 0.01 / (6 * exp(-3.5 * 0.05)), 7) + 0.0 as hours from e")
def flat_cost_distance(spark, sf_dir):
    """The raster's cells as flat ground, where the distance is known in closed form."""
    flat = r.raster(spark, sf_dir).select("grid_id", "x", "y", F.lit(1.0).alias("base"), F.lit(0.0).alias("dzdx"), F.lit(0.0).alias("dzdy"))
    return cost.accumulated(flat, [(20, 5)], 10.0).select("x", "y", shown(F.col("cost"), 7).alias("hours"))


def _reach_sql(name: str, x: int, y: int, start: str, end: str) -> str:
    """Least costs from a cell along edges ed, lowered round by round until none is lower."""
    return (
        f"{name}(x, y, c) using key (x, y) as (select {x}, {y}, 0.0::double union (select ed.{end}x, ed.{end}y, min({name}.c + ed.cost) from {name} join ed on ed.{start}x = {name}.x and ed.{start}y = {name}.y "
        f"left join recurring.{name} r on r.x = ed.{end}x and r.y = ed.{end}y where {name}.c + ed.cost < coalesce(r.c, 1e300) group by 1, 2))"
    )


def _chords_sql() -> str:
    import math

    at = lambda v: math.floor(v + 0.5)
    turns = [(k, sign, n, at(math.cos(math.pi * k / 8) * n * sign), at(math.sin(math.pi * k / 8) * n * sign)) for k in range(8) for sign in (1, -1) for n in range(1, cost.PINCH_RADIUS + 1)]
    rows = ", ".join(map(str, turns))
    return (
        f"wt(k, sign, n, ox, oy) as (values {rows}), q as (select x, y from h where inside), "
        f"len as (select q.x, q.y, k, sign, coalesce(min(n) filter (t.x is null), {cost.PINCH_RADIUS + 1}) - 1 as n from q cross join wt left join q t on t.x = q.x + ox and t.y = q.y + oy group by 1, 2, 3, 4), "
        f"tight as (select x, y, greatest(0, 1 - min(chord) / (0.75::double * {cost.PINCH_RADIUS})) as pinch from (select x, y, k, 1 + sum(n) as chord from len group by 1, 2, 3) group by 1, 2)"
    )


CORRIDOR = (
    f"with recursive {BASE}, o(ox, oy) as (select a, b from range(-1, 2) t(a), range(-1, 2) u(b) where a <> 0 or b <> 0), "
    "j as (select a.x, a.y, b.x as to_x, b.y as to_y, a.base as b0, b.base as b1, sqrt(ox * ox + oy * oy) * 10 as way, ((a.gx + b.gx) * ox + (a.gy + b.gy) * oy) * 5 as rise from k a cross join o join k b on b.x = a.x + ox and b.y = a.y + oy where a.base is not null and b.base is not null), "
    "ed as materialized (select x, y, to_x, to_y, way / 1000 / (6 * exp(-3.5 * abs(rise / way + 0.05))) * (b0 + b1) / 2 as cost from j), "
    f"{_reach_sql('da', 5, 5, '', 'to_')}, {_reach_sql('db', 90, 5, 'to_', '')}, "
    "g2 as (select k.x, k.y, da.c as cost_a, db.c as cost_b, da.c + db.c - min(da.c + db.c) over () as excess, min(da.c + db.c) over () as best from k left join da on da.x = k.x and da.y = k.y left join db on db.x = k.x and db.y = k.y), "
    f"h as materialized (select *, coalesce(excess <= best * {cost.TOLERANCE}::double, false) as inside from g2), {_chords_sql()}, "
    f"f as (select h.x, h.y, round(cost_a, 7) as cost_a, round(cost_b, 7) as cost_b, round(excess, 7) as excess, round(case when inside then 1 - excess / (best * {cost.TOLERANCE}::double) else 0 end, 7) as strength, round(coalesce(pinch, 0), 7) as pinch, inside from h left join tight using (x, y))"
)


@query(f"{CORRIDOR} select * from f")
def corridor_events(spark, sf_dir):
    return cost.corridor(cost_cells(spark, sf_dir), [(5, 5)], [(90, 5)], r.CELL).select("x", "y", *(F.round(k, 7).alias(k) for k in ("cost_a", "cost_b", "excess", "strength", "pinch")), "inside")


@query(f"{CORRIDOR} select x, y, pinch from f where pinch > 0.35")
def pinch_points(spark, sf_dir):
    return corridor_events(spark, sf_dir).where("pinch > 0.35").select("x", "y", "pinch")


# ---- stands and areas ---------------------------------------------------------------------------------

STANDS = "s as (select s_suppkey as id, (['rising', 'sinking', 'transition'])[(s_suppkey % 3 + 1)::int] as phase, (s_suppkey % 21 - 10) / 10.0::double as exposure, case when s_suppkey % 11 = 0 then null else (s_suppkey * 53 % 360)::double end as thermal, (s_suppkey * 37 % 360)::double as wind, case when s_suppkey % 4 = 0 then [] else ['N', 'SE', 'W', 'NW'] end as winds from supplier)"


@query(f"with {STANDS}, o as (select *, (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[(floor((wind + 22.5) / 45)::int % 8) + 1] as octant, abs((thermal - (wind + 180) % 360 + 540) - 360 * floor((thermal - (wind + 180) % 360 + 540) / 360) - 180) as apart from s) select id, octant, case when len(winds) > 0 and not list_contains(winds, octant) then 'burned' when phase = 'transition' or coalesce(apart, 0) > 90 or exposure < -0.5 then 'marginal' else 'good' end as rating from o")
def wind_check(spark, sf_dir):
    from heathgrid.functions import wind

    k = F.col("s_suppkey")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        k.alias("id"), F.element_at(F.array(*map(F.lit, ("rising", "sinking", "transition"))), (k % 3 + 1).cast("int")).alias("phase"), ((k % 21 - 10) / 10.0).alias("exposure"),
        F.when(k % 11 != 0, (k * 53 % 360).cast("double")).alias("thermal"), (k * 37 % 360).cast("double").alias("wind"), F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, ("N", "SE", "W", "NW")))).alias("winds"),
    )
    rows = rows.withColumn("octant", landform.octant(F.col("wind")))
    return rows.select("id", "octant", wind.wind_rating(F.col("phase"), F.col("exposure"), F.col("thermal"), F.col("wind"), F.col("octant"), F.col("winds")).alias("rating"))


@query()
def bedding(spark, sf_dir):
    from heathgrid.plans import analyze

    fields = analyze.analyze(r.raster(spark, sf_dir), {"bedding", "bench", "weiss"}, r.CELL, 20, wind_from=r.WIND_FROM, sun=r.SUN, celsius=-3.0)
    return fields.select("x", "y", F.round("bedding", 6).alias("bedding"), "bench", "weiss")


@query(f"with {r.SURFACE}, ar as (select * from s where x between 9 and 90 and y between 9 and (select max(event_id) // 100 from events) - 9) select count(*) as cells, count(*) filter (slope between 8 and 20) as matched, round(count(*) filter (slope between 8 and 20)::double / greatest(count(*), 1), 6) as share, case when count(*) filter (slope between 8 and 20)::double / greatest(count(*), 1) > 0.35 then 'tighten' when count(*) filter (slope between 8 and 20)::double / greatest(count(*), 1) < 0.002 then 'loosen' end as advice from ar")
def area_share(spark, sf_dir):
    from heathgrid.plans import analyze, predicate

    return analyze.area_share(r.raster(spark, sf_dir), predicate.PRESETS["Sidehill walkable grade"], r.CELL, 9).withColumn("share", F.round("share", 6))


def _bins_sql(column: str, values) -> str:
    return ", ".join(f"count(*) filter (i and {column} = {v})" for v in values)


@query(
    f"with {r.WEISS}, {r.RING_SQL}, bb as (select w.x, w.y, w.z, w.slope, w.aspect, w.weiss, case when g.slope is null then 2 when g.slope <= 8 and ring_samples >= 8 and 2 * ring_steep >= ring_samples then 1 else 0 end as bench, w.x // 50 as area, pow(w.x - 50, 2) + pow(w.y - 50, 2) <= 1600 as i from weiss w join ring g using (x, y)), "
    f"kk as (select *, {_bin_sql('slope')} as sb, {_bin_sql('aspect').replace('{flat}', '-1')} as ab from bb), "
    f"tt as (select area, count(*) filter (i) as cells, [{_bins_sql('sb', range(5))}] as s, [{_bins_sql('ab', range(8))}] as a, [{_bins_sql('weiss', range(11))}] as l, count(*) filter (i and bench = 1) as bn, count(*) filter (i and bench < 2) as bt, coalesce(avg(slope) filter (i), 0) as mean_slope, min(z) as min_z, max(z) as max_z from kk group by area) "
    "select area, cells, array_to_string(list_transform(s, lambda v: printf('%.6f', coalesce(v / nullif(list_sum(s), 0), 0))), ' ') as slope_shares, array_to_string(list_transform(a, lambda v: printf('%.6f', coalesce(v / nullif(list_sum(a), 0), 0))), ' ') as aspect_shares, array_to_string(list_transform(l, lambda v: printf('%.6f', coalesce(v / nullif(list_sum(l), 0), 0))), ' ') as landform_shares, round(coalesce(bn::double / nullif(bt, 0), 0), 6) as bench_share, round(mean_slope, 6) as mean_slope, round(min_z, 6) as min_z, round(max_z, 6) as max_z from tt"
)
def terrain_profile(spark, sf_dir):
    """Availability of two areas' terrain, from one pass."""
    from heathgrid.operators import landform

    rings = landform.ring_stats(r.classed(spark, sf_dir))
    cells = rings.withColumn("bench", landform.bench_candidate(F.col("slope"), F.col("ring_samples"), F.col("ring_steep"))).withColumn("area", F.floor(F.col("x") / 50))
    found = selection.profile(cells, ["area"], F.pow(F.col("x") - 50, F.lit(2)) + F.pow(F.col("y") - 50, F.lit(2)) <= 1600)
    text = lambda c: F.array_join(F.transform(c, lambda v: F.format_string("%.6f", v)), " ").alias(c)
    return found.select("area", "cells", *map(text, ("slope_shares", "aspect_shares", "landform_shares")), *(F.round(c, 6).alias(c) for c in ("bench_share", "mean_slope", "min_z", "max_z")))


PAGE = 500


@query(f"with {OBS}, o as (select id, observed_at, row_number() over (order by observed_at desc, id) as n, count(*) over () as total from obs) select id, observed_at, (n - {PAGE})::int as place, total > {2 * PAGE} as has_more from o where n > {PAGE} and n <= {2 * PAGE}")
def second_page(spark, sf_dir):
    """The page that follows the first one's cursor in a listing of all observations, latest first."""
    rows, keys = observations(spark, sf_dir).select("id", "observed_at"), [("observed_at", True), ("id", False)]
    last = fieldlog.page(rows, keys, PAGE).where(F.col("place") == PAGE).collect()  # one row: the cursor
    return fieldlog.page(rows, keys, PAGE, (last[0].observed_at, last[0].id)) if last else fieldlog.page(rows.where("false"), keys, PAGE)


@query(f"with {OBS}, l as (select id, property_id, kind, sex, case kind when 'SIGHTING' then 1 when 'SIGN' then 2 when 'TRAIL_CAMERA' then 3 when 'HARVEST' then 4 else 5 end as k from obs where property_id = 3 and not is_blank_sit) select id, kind, row_number() over (order by k, sex, id)::int as place from l")
def property_listing(spark, sf_dir):
    """A property's rows in the order of an enumeration, then by sex and id, with their place."""
    from pyspark.sql import Window

    order = ["SIGHTING", "SIGN", "TRAIL_CAMERA", "HARVEST"]
    rows = fieldlog.listed(observations(spark, sf_dir), [F.col("sex"), F.col("id")], {"kind": order}, property_id=3, is_blank_sit=False)
    k = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("kind")), F.lit(0)), F.lit(5))
    return rows.select("id", "kind", F.row_number().over(Window.partitionBy("property_id").orderBy(k, "sex", "id")).alias("place"))


def _wanted(spark, sf_dir):
    """Memberships that are asked for: one of each order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    role = F.element_at(F.array(*map(F.lit, (*fieldlog.ROLES[:3], "GUEST"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select((F.col("o_custkey") % 150 + 1).alias("property_id"), (F.col("o_orderkey") % 23).alias("user_id"), role.alias("role"), F.col("o_orderkey").alias("seq"))


_SET = (
    "own as (select distinct s_suppkey * 7 % 150 + 1 as property_id, s_nationkey as user_id, 'OBSERVER' as role from supplier), "
    "want as (select o_custkey % 150 + 1 as property_id, o_orderkey % 23 as user_id, (['OBSERVER', 'HUNTER', 'MANAGER', 'GUEST'])[(o_orderkey % 4 + 1)::int] as role, o_orderkey as seq from orders), "
    "new as (select property_id, user_id, arg_max(role, seq) as role from want where role <> 'GUEST' group by 1, 2)"
)


@query(f"with {_SET} select property_id, user_id, coalesce(new.role, own.role) as role from own full join new using (property_id, user_id)")
def members_set(spark, sf_dir):
    """Memberships after a batch that adds some and changes others."""
    own = memberships(spark, sf_dir).select("property_id", "user_id", F.lit("OBSERVER").alias("role")).distinct()
    return cascade.members_set(own, _wanted(spark, sf_dir)).select("property_id", "user_id", "role")


@query(f"with {_SET}, gone as (select distinct o_custkey % 150 + 1 as property_id, o_orderkey % 29 as user_id from orders) select property_id, user_id from own where not exists (select 1 from gone where gone.property_id = own.property_id and gone.user_id = own.user_id and not exists (select 1 from customer where c_custkey = gone.property_id and c_nationkey = gone.user_id))")
def members_removed(spark, sf_dir):
    """Memberships after a batch of removals; owners stay."""
    own = memberships(spark, sf_dir).select("property_id", "user_id").distinct()
    gone = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 150 + 1).alias("property_id"), (F.col("o_orderkey") % 29).alias("user_id"))
    return cascade.members_removed(own, properties(spark, sf_dir), gone).select("property_id", "user_id")


@query(
    "with f as (select c_custkey as id, c_nationkey as owner_id, c_name as name, 'p0' as predicate, '#000000' as color from customer), "
    "ch as (select o_custkey as id, o_orderkey % 25 as user_id, o_orderkey as seq, case when o_orderkey % 3 = 0 then o_orderstatus end as name, case when o_orderkey % 5 = 0 then 'p' || o_orderkey % 7 end as predicate, case when o_orderkey % 2 = 0 then (['#00ff00', 'green'])[(o_orderkey // 2 % 2 + 1)::int] end as color from orders), "
    "ok as (select ch.* from ch join f on f.id = ch.id and f.owner_id = ch.user_id where (ch.color is null or ch.color = '#00ff00') and (ch.predicate is null or ch.predicate <> 'p3')), "
    "g as (select id, arg_max(name, seq) filter (name is not null) as name, arg_max(predicate, seq) filter (predicate is not null) as predicate, arg_max(color, seq) filter (color is not null) as color, count(*) as n from ok group by id) "
    "select f.id, coalesce(g.name, f.name) as name, coalesce(g.predicate, f.predicate) as predicate, coalesce(g.color, f.color) as color, 1 + coalesce(n, 0) as version, case when g.predicate is null then 0.5::double end as share from f left join g using (id)"
)
def filters_changed(spark, sf_dir):
    """Saved filters after their owners' changes: versions rise, and shares of changed predicates go."""
    filters = properties(spark, sf_dir).select("id", "owner_id", "name", F.lit("p0").alias("predicate"), F.lit("#000000").alias("color"), F.lit(1).cast("long").alias("version"), F.lit(0.5).alias("matched_area_share"))
    k = F.col("o_orderkey")
    changes = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").alias("id"), (k % 25).alias("user_id"), k.alias("seq"), F.when(k % 3 == 0, F.col("o_orderstatus")).alias("name"), F.when(k % 5 == 0, F.concat(F.lit("p"), (k % 7).cast("string"))).alias("predicate"),
        F.when(k % 2 == 0, F.element_at(F.array(F.lit("#00ff00"), F.lit("green")), (F.floor(k / 2) % 2 + 1).cast("int"))).alias("color"),
    )
    return cascade.filters_changed(filters, changes, F.col("predicate") != "p3").select("id", "name", "predicate", "color", "version", F.col("matched_area_share").alias("share"))
