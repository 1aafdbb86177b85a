"""Keyed state on streams: versioned upserts with their change log, and caches whose entries expire.

State lives in the state store, a few values a key, so keys are spread over tasks and none has to fit in memory with its
history; a restart goes on from the last batch's state. Needs the RocksDB state store (`prepare`).

Rows of a key are handled in the order of `seq` within a batch, and batches in the source's order; a row that
comes after a later one of its key was handled is handled on arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds that change-log rows, source indexes and readings stay.
CHANGES_LIVE, INDEX_LIVES, READINGS_LIVE = 90 * 86400, 24 * 3600, 20
CHANGED = "entity_id {key}, seq long, op string, status string, version long, payload string"


def prepare(spark: SparkSession) -> None:
    """The state store that keyed state needs, for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Upserts(StatefulProcessor):
    """Version and payload of an entity; a mutation applies if its base is the version at that moment."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "version long, payload string, gone boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        version, payload, gone = self.held.get() if self.held.exists() else (0, None, True)
        out = []
        for r in batch.itertuples(index=False):
            base = None if pd.isna(r.base_version) else int(r.base_version)
            if r.op == "create":
                status = "applied" if gone else "conflict"
            else:
                status = "missing" if gone else "applied" if base == version else "conflict"
            if status == "applied":
                version, gone = version + 1, r.op == "delete"
                payload = payload if r.op == "delete" else r.payload
            out.append((key[0], int(r.seq), r.op, status, version, payload))
        self.held.update((version, payload, gone))
        yield pd.DataFrame(out, columns=["entity_id", "seq", "op", "status", "version", "payload"])

    def close(self) -> None:
        pass


def upserts(mutations: DataFrame) -> DataFrame:
    """mutations (entity_id, seq, op: create, update or delete, base_version, payload) with status, version and the entity's payload.

    A create of an entity that is there, and a change of another version than the present one, is a conflict
    and carries what is there; a change of one that isn't is missing. Versions go on rising over deletes.
    """
    kind = CHANGED.format(key=dict(mutations.dtypes)["entity_id"])
    rows = mutations.select("entity_id", F.col("seq").cast("long").alias("seq"), "op", F.col("base_version").cast("long").alias("base_version"), F.col("payload").cast("string").alias("payload"))
    return rows.groupBy("entity_id").transformWithStateInPandas(Upserts(), kind, "append", "none")


def change_log(applied: DataFrame) -> DataFrame:
    """cursor, entity_id, op, version, payload of what was applied: what a client pulls, in the order of its cursor."""
    return applied.where("status = 'applied'").select(F.col("seq").alias("cursor"), "entity_id", "op", "version", "payload")


def pull(log: DataFrame, cursor: int | None, size: int, now: str | None = None) -> DataFrame:
    """The `size` changes after a cursor, with place and has_more; with a time (of column `at`), only those that still live."""
    from heathgrid.operators.fieldlog import page

    live = log if now is None else log.where(F.col("at") > F.lit(now).cast("timestamp") - F.expr(f"interval {CHANGES_LIVE} seconds"))
    return page(live, [("cursor", False)], size, None if cursor is None else (cursor,))


class Cache(StatefulProcessor):
    """The last value put under a key, until its time is over."""

    def __init__(self, seconds: int):
        self.millis = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "value string, put long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows))
        batch = batch.assign(ms=batch["at"].map(lambda t: int(t.timestamp() * 1000))).sort_values(["ms", "seq"], kind="stable")
        value, put = self.held.get() if self.held.exists() else (None, None)
        before, out = put, []
        for r in batch.itertuples(index=False):
            if isinstance(r.value, str):
                value, put = r.value, r.ms
            else:
                fresh = put is not None and put <= r.ms < put + self.millis
                out.append((key[0], int(r.seq), "hit" if fresh else "miss", value if fresh else None))
        if put is not None and put != before:
            self.held.update((value, put))
            if before is not None:
                self.handle.deleteTimer(before + self.millis)
            self.handle.registerTimer(put + self.millis)
        yield pd.DataFrame(out, columns=["key", "seq", "found", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        yield pd.DataFrame([], columns=["key", "seq", "found", "value"])

    def close(self) -> None:
        pass


def cached(stream: DataFrame, seconds: int, late: str = "1 minute") -> DataFrame:
    """stream (key, seq, at, value: NULL asks) with found (hit or miss) and value for each row that asks.

    An entry lives for so many seconds of the stream's own time; once the watermark passes its end, its state goes.
    """
    kind = f"key {dict(stream.dtypes)['key']}, seq long, found string, value string"
    rows = stream.select("key", F.col("seq").cast("long").alias("seq"), "at", F.col("value").cast("string").alias("value"))
    return rows.withWatermark("at", late).groupBy("key").transformWithStateInPandas(Cache(seconds), kind, "append", "eventTime")
