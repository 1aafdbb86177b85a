"""Changes of relational tables in batches, with what depends on them: each gives the table as it is afterwards.

A change names its row by key; several of one key are settled by `seq`, the last one wins (and so do its values, a NULL
leaving what is there). Refused changes are answered by `refused`-like columns and not applied. All are equi-joins and
anti-joins on the key; nothing is updated in place, so that a result can be written as a new version of its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heathgrid.operators.fieldlog import ROLES, access, rank

#: Fixed value: how a colour is written.
COLOUR = "^#[0-9a-fA-F]{6}$"


def last(changes: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last change of each key, whole."""
    rest = [c for c in changes.columns if c not in keys]
    picked = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("its_row"))
    return picked.select(*keys, *(F.col(f"its_row.{c}").alias(c) for c in rest))


def folded(changes: DataFrame, keys: list[str], values: list[str], order: str = "seq") -> DataFrame:
    """One change of each key: for each value the last one that isn't NULL, and n, how many there were."""
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in values]
    return changes.groupBy(*keys).agg(*latest, F.count("*").alias("n"))


def patched(table: DataFrame, changes: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """table with its values changed, and its_n: how many changes each row had (0: none). Changes of rows that aren't there do nothing."""
    new = folded(changes, keys, values).select(*keys, *(F.col(c).alias(f"its_{c}") for c in values), F.col("n").alias("its_n"))
    out = table.join(new, keys, "left")
    kept = [F.coalesce(f"its_{c}", c).alias(c) if c in values else F.col(c) for c in table.columns]
    return out.select(*kept, F.coalesce("its_n", F.lit(0)).alias("its_n"))


def members_set(memberships: DataFrame, wanted: DataFrame) -> DataFrame:
    """memberships (property_id, user_id, role) after wanted ones (property_id, user_id, role, seq): new ones come in, others change their role; roles that aren't known do nothing."""
    new = last(wanted.where(F.col("role").isin(*ROLES)), ["property_id", "user_id"]).select("property_id", "user_id", F.col("role").alias("its_role"))
    met = memberships.join(new, ["property_id", "user_id"], "full")
    return met.select(*(F.coalesce("its_role", "role").alias("role") if c == "role" else F.col(c) for c in memberships.columns))


def members_removed(memberships: DataFrame, properties: DataFrame, gone: DataFrame) -> DataFrame:
    """memberships without those of gone (property_id, user_id); an owner's stays until ownership is given away."""
    owners = properties.select(F.col("id").alias("property_id"), F.col("owner_id").alias("user_id"))
    fine = gone.select("property_id", "user_id").join(owners, ["property_id", "user_id"], "left_anti")
    return memberships.join(fine, ["property_id", "user_id"], "left_anti")


def rows_removed(rows: DataFrame, properties: DataFrame, memberships: DataFrame, wanted: DataFrame, user: str | int) -> tuple[DataFrame, DataFrame]:
    """rows (id, property_id, user_id, ...) after a user's removals (id), and id, status of each removal.

    Hunters remove what they recorded, managers and owners anything of the property; others nothing. Statuses: removed, refused, missing.
    """
    role = access(properties, memberships, F.lit(user), "HUNTER").select(F.col("id").alias("property_id"), "role")
    asked = wanted.select("id").distinct().join(rows.select("id", "property_id", F.col("user_id").alias("its_user"), F.lit(True).alias("its_there")), "id", "left").join(role, "property_id", "left")
    own = (F.col("its_user") == F.lit(user)) & (rank(F.col("role")) >= ROLES.index("HUNTER"))
    may = F.coalesce(own | (rank(F.col("role")) >= ROLES.index("MANAGER")), F.lit(False))
    told = asked.select("id", F.when(F.col("its_there").isNull(), "missing").when(may, "removed").otherwise("refused").alias("status"))
    return rows.join(told.where("status = 'removed'"), "id", "left_anti"), told


def filters_changed(filters: DataFrame, changes: DataFrame, valid: Column) -> DataFrame:
    """Saved filters (id, owner_id, name, predicate, color, version, matched_area_share, ...) after their owners' changes (id, user_id, seq, name, predicate, color; NULL: as it is).

    A change of another owner's filter, of a colour that isn't #rrggbb, or of a predicate that isn't `valid` (over
    the change's columns), does nothing. Each that counts raises the version; a new predicate drops the share that was worked out.
    """
    owners = filters.select("id", F.col("owner_id").alias("user_id"))
    fine = (F.col("color").isNull() | F.col("color").rlike(COLOUR)) & (F.col("predicate").isNull() | valid)
    counted = changes.where(fine).join(owners, ["id", "user_id"], "left_semi")
    values = [c for c in ("name", "predicate", "color") if c in filters.columns]
    renewed = counted.where("predicate is not null").select("id").distinct().withColumn("its_new", F.lit(True))
    out = patched(filters, counted, ["id"], values).join(renewed, "id", "left")
    fresh = {"version": F.col("version") + F.col("its_n"), "matched_area_share": F.when(F.col("its_new").isNull(), F.col("matched_area_share"))}
    return out.withColumns(fresh).select(*filters.columns)


def boundaries_changed(properties: DataFrame, profiles: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """properties (id, boundary, area_hectares, center_lng, center_lat, ...) and terrain profiles (property_id, ...) after changes (id, seq, boundary, area_hectares, center_lng, center_lat).

    The profile of a property whose boundary was given anew goes, since it describes other ground; the measures come with the boundary.
    """
    new = last(changes.where("boundary is not null"), ["id"])
    values = ["boundary", "area_hectares", "center_lng", "center_lat"]
    out = patched(properties, new, ["id"], [c for c in values if c in properties.columns]).drop("its_n")
    return out, profiles.join(new.select(F.col("id").alias("property_id")), "property_id", "left_anti")


def regions_ready(regions: DataFrame, done: DataFrame) -> DataFrame:
    """Kept regions (id, status, size_bytes, tile_count, packaged_at, ...) after reports of what was stored (id, seq, size_bytes, tile_count, packaged_at)."""
    values = ["size_bytes", "tile_count", "packaged_at"]
    out = patched(regions, done, ["id"], values)
    return out.withColumn("status", F.when(F.col("its_n") > 0, "READY").otherwise(F.col("status"))).select(*regions.columns)
