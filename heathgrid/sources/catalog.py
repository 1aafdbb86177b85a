"""Where elevation comes from: named sources, bucket listings, files that may hold a place, a tile cache and datum guards."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heathgrid.functions import names, tiles

#: The prefix of one-metre projects, pages of a listing, keys a page, seconds that tiles and indexes are kept.
PROJECTS, MOST_PAGES, PAGE_KEYS, TILES_LIVE, INDEX_LIVES = "StagedProducts/Elevation/1m/Projects/", 50, 1000, 90 * 86400, 86400
#: Metres by which ellipsoidal heights lie below orthometric ones over the conterminous United States.
SEPARATION = (22.0, 34.0)
#: Entities that listings escape; the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


@dataclass(frozen=True)
class Source:
    """A named source of heights; kind: tiles (colour-coded map tiles) or files (placed rasters)."""

    name: str
    kind: str
    bare_earth: bool
    datum: str
    product: str | None = None


SOURCES = {s.name: s for s in (Source("terrarium", "tiles", False, "orthometric"), Source("usgs3dep-13", "files", True, "orthometric", "13"), Source("usgs3dep-1m", "files", True, "orthometric", "1m"))}


class UnknownSource(ValueError):
    pass


class DatumMismatch(ValueError):
    pass


def source(name: str | None = None) -> Source:
    """A source by name, the first for none; never another one in place of one that isn't known."""
    if name is not None and name not in SOURCES:
        raise UnknownSource(f"{name}: there are {', '.join(SOURCES)}")
    return SOURCES[name or "terrarium"]


# ---- listings ---------------------------------------------------------------------------------------


def plain(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)


def listing(xml: Column) -> Column:
    """Struct of keys, prefixes, truncated and token (NULL on the last page) of a page of a bucket's listing."""
    inside = lambda outer, inner: F.transform(F.filter(F.regexp_extract_all(xml, F.lit(f"(?s)<{outer}>(.*?)</{outer}>"), 1), lambda b: F.regexp_like(b, F.lit(f"<{inner}>[^<]*</{inner}>"))), lambda b: plain(F.regexp_extract(b, f"<{inner}>([^<]*)</{inner}>", 1)))
    truncated = F.regexp_like(xml, F.lit(r"(?i)<IsTruncated>\s*true\s*</IsTruncated>"))
    token = F.regexp_extract(xml, "<NextContinuationToken>([^<]*)</NextContinuationToken>", 1)
    return F.struct(inside("Contents", "Key").alias("keys"), inside("CommonPrefixes", "Prefix").alias("prefixes"), truncated.alias("truncated"), F.when(truncated & (token != ""), plain(token)).alias("token"))


def list_url(bucket: Column, prefix: Column, delimiter: Column | None = None, most: int | None = None, token: Column | None = None) -> Column:
    """Address of a page of a listing."""
    parts = [F.concat(bucket, F.lit("/?list-type=2&prefix="), F.url_encode(prefix))]
    for name, value in (("delimiter", delimiter), ("max-keys", None if most is None else F.lit(str(most))), ("continuation-token", token)):
        if value is not None:
            parts.append(F.coalesce(F.concat(F.lit(f"&{name}="), F.url_encode(value)), F.lit("")))
    return F.concat(*parts)


def pages(fetch: Callable[[str | None], tuple[str, str | None]], most: int = MOST_PAGES) -> list[str]:
    """Pages one after another, each asked for by the token of the one before; `fetch` gives a page and its token."""
    found, token = [], None
    for _ in range(most):
        page, token = fetch(token)
        found.append(page)
        if token is None:
            break
    return found


def projects(listed: DataFrame, prefix: str = PROJECTS) -> DataFrame:
    """project of each prefix in listing pages (value), in no order."""
    name = F.regexp_replace(F.substring("p", F.lit(len(prefix) + 1), F.length("p")), "/$", "")
    return listed.select(F.explode(listing(F.col("value"))["prefixes"]).alias("p")).select(name.alias("project")).where("project != ''")


# ---- which files hold a place -------------------------------------------------------------------------


def five_points(boxes: DataFrame) -> DataFrame:
    """boxes (id, west, south, east, north) as id, pos, lng, lat: the middle and the corners, in the order in which they are asked for."""
    p = lambda k, lng, lat: F.struct(F.lit(k).alias("pos"), lng.alias("lng"), lat.alias("lat"))
    w, s, e, n = (F.col(c) for c in ("west", "south", "east", "north"))
    at = F.array(p(0, (w + e) / 2, (s + n) / 2), p(1, w, n), p(2, e, n), p(3, w, s), p(4, e, s))
    return boxes.select("id", F.explode(at).alias("p")).select("id", "p.*")


def first_of(rows: DataFrame, *keys: str) -> DataFrame:
    """Each distinct url of an id once, by where it first stood, with place from 0."""
    from pyspark.sql import Window

    met = rows.groupBy("id", "url").agg(F.min(F.struct(*keys)).alias("its_at"), *(F.min_by(c, F.struct(*keys)).alias(c) for c in rows.columns if c not in ("id", "url", *keys)))
    return met.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("its_at")) - 1).drop("its_at")


def third_arc_urls(boxes: DataFrame, bucket: str) -> DataFrame:
    """id, url, place: files of a third of an arc second over the middle and corners of boxes."""
    return first_of(five_points(boxes).select("id", "pos", names.one_third_url(F.col("lng"), F.col("lat"), bucket).alias("url")), "pos")


def one_meter_urls(boxes: DataFrame, index: DataFrame, bucket: str) -> DataFrame:
    """id, url, project, place: one-metre files of the project that covers each of a box's five points, under the names they may have."""
    points = five_points(boxes).withColumn("its_id", F.struct("id", "pos"))
    met = names.candidates(points.select(F.col("its_id").alias("id"), "lng", "lat"), index)
    chosen = met.groupBy("id").agg(F.min_by("project", "rank").alias("project"))
    rows = met.join(chosen, ["id", "project"]).withColumn("its_t", names.one_meter_tile(F.col("lng"), F.col("lat"), F.col("zone")))
    rows = rows.select(F.col("id.id").alias("id"), F.col("id.pos").alias("pos"), "rank", "project", F.posexplode("its_t.stems").alias("k", "stem"))
    url = F.concat(F.lit(f"{bucket}/{PROJECTS}"), F.col("project"), F.lit("/TIFF/"), F.col("stem"), F.lit("_"), F.col("project"), F.lit(".tif"))
    return first_of(rows.select("id", "pos", "rank", "k", "project", url.alias("url")), "pos", "rank", "k")


def resolved(candidates: DataFrame, probes: DataFrame) -> DataFrame:
    """The first candidate (id, rank, url, ...) of each id whose probe (id, url, opens, is_utm, inside, has_height) holds in all; ids without one are left out."""
    good = probes.where("opens and is_utm and inside and has_height").select("id", "url").distinct()
    rest = [c for c in candidates.columns if c != "id"]
    first = candidates.join(good, ["id", "url"], "left_semi").groupBy("id").agg(F.min_by(F.struct(*rest), "rank").alias("its_row"))
    return first.select("id", *(F.col(f"its_row.{c}").alias(c) for c in rest))


def index_within(index: DataFrame, boxes: DataFrame) -> DataFrame:
    """Rows of a one-metre index (key, projects) that may serve boxes: ten-kilometre cells over their corners in three zones, and a ring around."""
    w, s, e, n = (F.col(c) for c in ("west", "south", "east", "north"))
    own = F.array(tiles.utm_zone(w), tiles.utm_zone(e))
    zones = F.array_distinct(F.flatten(F.transform(own, lambda z: F.array(z - 1, z, z + 1))))
    rows = boxes.select("west", "south", "east", "north", F.explode(F.filter(zones, lambda z: (z >= 1) & (z <= 60))).alias("zone"))
    corner = F.explode(F.array(*(F.struct(a.alias("lng"), b.alias("lat")) for a in (w, e) for b in (s, n))))
    at = rows.withColumn("box", F.struct(w, s, e, n)).select("box", "zone", corner.alias("c")).withColumn("t", names.one_meter_tile(F.col("c.lng"), F.col("c.lat"), F.col("zone")))
    span = at.groupBy("box", "zone").agg(*(f(f"t.{k}").alias(f"{k}{i}") for k in "xy" for i, f in ((0, F.min), (1, F.max))))
    cells = span.withColumn("x", F.explode(F.sequence(F.col("x0") - 1, F.col("x1") + 1))).withColumn("y", F.explode(F.sequence(F.col("y0") - 1, F.col("y1") + 1)))
    key = lambda z: F.concat_ws("/", z, F.col("x").cast("string"), F.col("y").cast("string"))
    return index.join(cells.select(F.explode(F.array(key(F.col("zone").cast("string")), key(F.lit("*")))).alias("key")).distinct(), "key", "left_semi")


# ---- a cache of tiles -----------------------------------------------------------------------------------


def live(kept: DataFrame, now: Column, seconds: int = TILES_LIVE, time: str = "fetched_at") -> DataFrame:
    """Rows that were fetched less than so many seconds ago."""
    return kept.where(F.col(time) > now - F.expr(f"interval {seconds} seconds"))


def looked_up(wanted: DataFrame, kept: DataFrame, keys: list[str], now: Column, seconds: int = TILES_LIVE) -> tuple[DataFrame, DataFrame]:
    """What the cache has of wanted keys, and the keys to fetch; each key once, whoever wants it."""
    asked, there = wanted.select(*keys).distinct(), live(kept, now, seconds)
    return there.join(asked, keys, "left_semi"), asked.join(there, keys, "left_anti")


def stored(kept: DataFrame, new: DataFrame, keys: list[str], time: str = "fetched_at") -> DataFrame:
    """The cache with new rows, the latest of each key."""
    rest = [c for c in kept.columns if c not in keys]
    both = kept.unionByName(new.select(*kept.columns)).groupBy(*keys).agg(F.max_by(F.struct(*rest), time).alias("its_row"))
    return both.select(*(c if c in keys else F.col(f"its_row.{c}").alias(c) for c in kept.columns))


def stats(kept: DataFrame, by: list[str], body: str) -> DataFrame:
    """by, n, bytes of the tiles kept."""
    return kept.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(body)), F.lit(0)).alias("bytes"))


# ---- datums ---------------------------------------------------------------------------------------------


def same_datum(rows: DataFrame, expected: str, datum: str = "datum") -> DataFrame:
    """rows, if all heights are over the datum expected; their distinct datums are looked at first, so nothing mixed is ever combined."""
    other = sorted(str(r[0]) for r in rows.select(datum).distinct().where(~F.col(datum).eqNullSafe(F.lit(expected))).limit(9).collect())
    if other:
        raise DatumMismatch(f"{', '.join(other)} heights among {expected} ones: they differ by {SEPARATION[0]:g} to {SEPARATION[1]:g} m")
    return rows


def unconverted(altitude: Column, ground: Column) -> Column:
    """Whether a receiver's altitude lies as far above the ground as an ellipsoidal height would."""
    return (altitude - ground).between(*SEPARATION)
