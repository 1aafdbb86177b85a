"""Queries that run a stream over a table to its end and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heathgrid.shared import cut, remove_folder, shared_folder
from heathgrid.streaming import log, state

QUERIES, ORACLE = {}, {}
STORE_KEY = "spark.sql.streaming.stateStore.providerClass"


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream writes, checkpointed, once its source is used up; a batch that runs again replaces what it wrote."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    write = lambda batch, i: batch.write.mode("overwrite").parquet(f"{at}/table/its_batch={i if mode == 'append' else 0}")
    try:
        query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
        query.awaitTermination()
        return cut(spark.read.parquet(f"{at}/table").drop("its_batch"))
    finally:
        remove_folder(at)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(log.counts(events(spark, sf_dir), "ts", "1 hour", by=("event_type",)), "complete").select("start", "event_type", "n")


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("client_id", F.col("user_id"))
    return drained(log.once(rows, "client_id", "ts", "3650 days")).select("client_id")


def stream_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutations of 200 entities, each created once, through keyed state."""
    e = events(spark, sf_dir)
    op = F.when(F.col("event_id") < 200, "create").otherwise("update")
    rows = e.select((F.col("event_id") * 31 % 200).alias("entity_id"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("event_id") * 17 % 4).alias("base_version"), F.col("event_id").cast("string").alias("payload"))
    before = spark.conf.get(STORE_KEY)
    state.prepare(spark)
    try:
        return drained(state.upserts(rows))
    finally:
        spark.conf.set(STORE_KEY, before)


QUERIES |= {"stream_hourly_counts": stream_hourly_counts, "stream_dedupe": stream_dedupe, "stream_upserts": stream_upserts}
ORACLE |= {
    "stream_hourly_counts": "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by 1, 2",
    "stream_dedupe": "select distinct user_id as client_id from events",
    "stream_upserts": (
        "with recursive o as (select event_id * 31 % 200 as entity_id, event_id as seq, event_id * 17 % 4 as base, row_number() over (partition by event_id * 31 % 200 order by event_id) as n from events), "
        "w(entity_id, n, seq, op, status, v, p) as (select entity_id, n, seq, 'create', 'applied', 1::bigint, seq from o where n = 1 union all select o.entity_id, o.n, o.seq, 'update', case when o.base = w.v then 'applied' else 'conflict' end, case when o.base = w.v then w.v + 1 else w.v end, case when o.base = w.v then o.seq else w.p end from w join o on o.entity_id = w.entity_id and o.n = w.n + 1) "
        "select entity_id, seq, op, status, v as version, p::varchar as payload from w"
    ),
}
