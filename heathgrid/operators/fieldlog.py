"""Joins, listings and log semantics of the relational tables: access, counts, replay, optimistic updates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Roles from least to most, enum orders that sort by declaration.
ROLES = ("OBSERVER", "HUNTER", "MANAGER", "OWNER")
LATEST = 2000


def rank(role: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), role) - 1, F.lit(-1))


def access(properties: DataFrame, memberships: DataFrame, user_id: Column, needed: str) -> DataFrame:
    """properties (id, owner_id, ...) with role (OWNER for the owner, else the membership's, NULL: none) and allowed."""
    own = memberships.where(F.col("user_id") == user_id).groupBy(F.col("property_id").alias("id")).agg(F.max_by("role", rank(F.col("role"))).alias("_role"))
    role = F.when(F.col("owner_id") == user_id, F.lit("OWNER")).otherwise(F.col("_role"))
    out = properties.join(own, "id", "left").withColumn("role", role).drop("_role")
    return out.withColumn("allowed", rank(F.col("role")) >= ROLES.index(needed))


def visible(properties: DataFrame, memberships: DataFrame, user_id: Column) -> DataFrame:
    """The properties that a user owns or is a member of, as semi-joins."""
    member = properties.join(memberships.where(F.col("user_id") == user_id).select(F.col("property_id").alias("id")), "id", "left_semi")
    return properties.where(F.col("owner_id") == user_id).union(member.where(~F.col("owner_id").eqNullSafe(user_id)))


def with_counts(parents: DataFrame, **children: DataFrame) -> DataFrame:
    """parents (id, ...) with a count of each child table's rows (property_id, ...), 0 included; children are counted before they are joined."""
    for name, rows in children.items():
        counted = rows.groupBy(F.col("property_id").alias("id")).agg(F.count("*").alias(f"_{name}"))
        parents = parents.join(counted, "id", "left").withColumn(name, F.coalesce(f"_{name}", F.lit(0))).drop(f"_{name}")
    return parents


def latest(rows: DataFrame, time: str = "observed_at", key: str = "id", n: int = LATEST, **where) -> DataFrame:
    """The last rows by time, ties by key; where holds equalities, None for no condition."""
    for k, v in where.items():
        rows = rows if v is None else rows.where(F.col(k) == v)
    return rows.orderBy(F.col(time).desc(), F.col(key)).limit(n)


def after(rows: DataFrame, cursor: tuple | None, keys: list[tuple[str, bool]]) -> DataFrame:
    """Rows that come after a cursor (a value for each key) in the order of keys (column, whether it falls); all for no cursor.

    The first key's bound stands alone too, so that it reaches the scan and prunes files by their statistics.
    """
    if cursor is None:
        return rows
    past = lambda c, v, falls: F.col(c) < F.lit(v) if falls else F.col(c) > F.lit(v)
    beyond, equal = F.lit(False), F.lit(True)
    for (c, falls), v in zip(keys, cursor, strict=True):
        beyond, equal = beyond | (equal & past(c, v, falls)), equal & (F.col(c) == F.lit(v))
    c, falls = keys[0]
    return rows.where((F.col(c) <= F.lit(cursor[0])) if falls else (F.col(c) >= F.lit(cursor[0]))).where(beyond)


def page(rows: DataFrame, keys: list[tuple[str, bool]], size: int, cursor: tuple | None = None) -> DataFrame:
    """The next `size` rows after the cursor, with place (from 1) and has_more; keys must tell rows apart.

    One row more than a page is looked at, for has_more. The next cursor is the keys' values in the last row.
    """
    order = [F.col(c).desc() if falls else F.col(c).asc() for c, falls in keys]
    ahead = after(rows, cursor, keys).orderBy(*order).limit(size + 1)
    whole = Window.partitionBy(F.lit(1))  # a page and a row
    numbered = ahead.withColumn("place", F.row_number().over(whole.orderBy(*order))).withColumn("has_more", F.count("*").over(whole) > size)
    return numbered.where(F.col("place") <= size)


def listed(rows: DataFrame, order: list[Column], ordinals: dict[str, list[str]] | None = None, **where) -> DataFrame:
    """Rows in a listing's order, that of an enumeration being its declaration's; where holds equalities, None for no condition."""
    for k, v in where.items():
        rows = rows if v is None else rows.where(F.col(k).eqNullSafe(F.lit(v)))
    ranks = [F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col(c)), F.lit(0)), F.lit(len(names) + 1)) for c, names in (ordinals or {}).items()]
    return rows.orderBy(*ranks, *order)


def share_copied(rows: DataFrame, key: Column, owner: Column, new_key: Column, valid: Column) -> DataFrame:
    """The publicly shared row of that key as a private one of another owner; none if it isn't shared or its predicate isn't valid any more."""
    own = rows.where((F.col("id") == key) & F.col("shared_publicly") & valid)
    return own.withColumns({"id": new_key, "owner_id": owner, "shared_publicly": F.lit(False), "is_preset": F.lit(False), "version": F.lit(1)})


def new_rows(incoming: DataFrame, existing: DataFrame, key: str = "client_id", order: str = "seq") -> DataFrame:
    """Incoming rows to insert: the first of each key that isn't there yet; rows without a key always."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    keyed = incoming.where(F.col(key).isNotNull()).withColumn("_n", first).where("_n = 1").drop("_n")
    return keyed.join(existing.select(key).where(F.col(key).isNotNull()), key, "left_anti").select(*incoming.columns).union(incoming.where(F.col(key).isNull()))


def too_early(at: Column, now: Column) -> Column:
    """Whether a row claims a time more than an hour ahead."""
    return at > now + F.expr("interval 1 hour")


def replayed(mutations: DataFrame, entities: DataFrame) -> DataFrame:
    """mutations (entity_id, seq, base_version) with status and version: applied in order of seq against entities (id, version).

    A mutation applies if its base version is the entity's at that moment and then raises it by one; else
    it's a conflict that carries the entity's version. The state is one number, so an entity's mutations
    stream past it in order; entities run apart, and none has to fit in memory. Repeated rows each apply
    in turn; a null base version is a conflict, and an entity that isn't there gives `missing`.

    A window numbers the mutations: unlike a plain repartition, which adaptive plans may read mapper by mapper
    again once the join is broadcast, it demands an entity in one place and in order. Number 1 starts an entity.
    """
    start = entities.select(F.col("id").alias("entity_id"), F.col("version").cast("bigint").alias("_v"))
    log = mutations.select("entity_id", F.col("seq").cast("bigint").alias("seq"), F.col("base_version").cast("bigint").alias("base_version")).join(start, "entity_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = None
        for batch in batches:
            status, version = [], []
            for n, base, first in zip(*(batch.column(k).to_pylist() for k in ("_n", "base_version", "_v")), strict=True):
                if n == 1:
                    v = first
                hit = v is not None and base == v
                v = v + 1 if hit else v
                status.append("missing" if v is None else "applied" if hit else "conflict")
                version.append(v)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("entity_id", "seq", "base_version")), pa.array(status, pa.string()), pa.array(version, pa.int64())], names=["entity_id", "seq", "base_version", "status", "version"])

    ordered = log.withColumn("_n", F.row_number().over(Window.partitionBy("entity_id").orderBy("seq", "base_version")))
    return ordered.mapInArrow(run, f"entity_id {dict(mutations.dtypes)['entity_id']}, seq bigint, base_version bigint, status string, version bigint")


def flushed(queue: DataFrame) -> DataFrame:
    """queue (queue_id, seq, outcome: ok, conflict, error or offline) with state: first in, first out; all from the first offline one on stay queued."""
    stopped = F.max(F.when(F.col("outcome") == "offline", 1).otherwise(0)).over(Window.partitionBy("queue_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return queue.withColumn("state", F.when(stopped == 1, "queued").when(F.col("outcome") == "ok", "sent").otherwise(F.col("outcome")))


def first_known(layers: DataFrame, keys: list[str], value: str = "z", order: str = "priority") -> DataFrame:
    """Ordered mosaic: each key's value from the layer with the least order that knows it; NULL if none does."""
    return layers.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def missing(planned: DataFrame, held: DataFrame, keys: list[str], bits: str | None = None) -> DataFrame:
    """Planned tiles that aren't held; where bits names a column, rows are sets of tiles as in `coverage`, and keep the bits that aren't held."""
    if bits is None:
        return planned.join(held, keys, "left_anti")
    there = held.groupBy(*keys).agg(F.bit_or(bits).alias("_h"))
    rest = F.col(bits).bitwiseAND(F.bitwise_not(F.coalesce("_h", F.lit(0).cast("long"))))
    return planned.join(there, keys, "left").withColumn(bits, rest).where(F.col(bits) != 0).drop("_h")


def coverage(planned: DataFrame, held: DataFrame, keys: list[str], region: str, bits: str | None = None) -> DataFrame:
    """region, planned, held and verdict: covered, partial or empty.

    Rows are tiles, or, where bits names a column, sets of tiles under one key as its bits; a region has a key once.
    Tiles of many regions make more rows than anything else here, so sets keep down what the join sorts and the counts hold.
    """
    tiles = F.lit(1).cast("long") if bits is None else F.col(bits)
    there = held.groupBy(*keys).agg(F.bit_or(tiles).alias("_h"))
    met = planned.select(region, *keys, F.bit_count(tiles).alias("_n"), tiles.alias("_p")).join(there, keys, "left")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counts = met.groupBy(region).agg(n("_n").alias("planned"), n(F.bit_count(F.col("_p").bitwiseAND(F.col("_h")))).alias("held"))
    return counts.withColumn("verdict", F.when(F.col("held") == 0, "empty").when(F.col("held") == F.col("planned"), "covered").otherwise("partial"))


def exclusive(tiles: DataFrame, keys: list[str], region: str) -> DataFrame:
    """region and the number of its tiles that no other region has; a tile is exclusive if the least and the largest region that have it are one, so repeated rows don't count."""
    met = tiles.groupBy(*keys).agg(F.min(region).alias(region), F.max(region).alias("_last"), F.count_if(F.col(region).isNull()).alias("_unknown"))
    only = met.where((F.col(region) == F.col("_last")) & (F.col("_unknown") == 0))
    return tiles.select(region).distinct().join(only.groupBy(region).agg(F.count("*").alias("_n")), region, "left").select(region, F.coalesce("_n", F.lit(0)).alias("n_exclusive"))
