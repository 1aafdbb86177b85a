"""The change log and offline queues as streams: inserts once, stamped on arrival, counted in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(stream: DataFrame, key: str = "client_id", time: str = "queued_at", late: str = "1 day") -> DataFrame:
    """The first row of each key; a repeat that comes later than `late` isn't recognised, which bounds the state."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def stamped(stream: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the terrain of their cell as they arrive: a stream-static left join."""
    return stream.join(cells, keys, "left")


def not_ahead(stream: DataFrame, time: str, now: str = "current_timestamp()") -> DataFrame:
    """Rows that don't claim a time more than an hour ahead; late ones all stay."""
    return stream.where(F.col(time) <= F.expr(f"{now} + interval 1 hour"))


def counts(stream: DataFrame, time: str, width: str, slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """start, end, by, n: counts in tumbling or sliding windows, closed once the watermark passes."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = stream.withWatermark(time, late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(stream: DataFrame, time: str, gap: str, by: str, late: str = "10 minutes") -> DataFrame:
    """start, end, by, n: runs of a key's rows with no gap as long as `gap`."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")
