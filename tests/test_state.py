import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from heathgrid.streaming import state

KIND = "entity_id long, seq long, op string, base_version long, payload string"


def run(stream, folder):
    """What a stream gives until its source is used up; it goes on from the folder's log."""
    write = lambda batch, i: batch.write.mode("overwrite").parquet(f"{folder}/out/its_batch={i}")
    stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out").drop("its_batch")


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state.prepare(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def plain(rows):
    held, out = {}, []
    for e, seq, op, base, payload in sorted(rows, key=lambda r: r[1]):
        version, body, gone = held.get(e, (0, None, True))
        status = ("applied" if gone else "conflict") if op == "create" else "missing" if gone else "applied" if base == version else "conflict"
        if status == "applied":
            version, gone, body = version + 1, op == "delete", body if op == "delete" else payload
        held[e] = (version, body, gone)
        out.append((e, seq, op, status, version, body))
    return sorted(out, key=lambda r: r[1])


def test_upserts_over_a_restart(spark, store, tmp_path):
    r = random.Random(1)
    rows = [(r.randrange(5), k, r.choice(("create", "update", "update", "update", "delete")), r.choice((1, 2, 3, 4, None)), f"p{k}") for k in range(150)]
    source = tmp_path / "in"

    def arrive(part):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(str(source))

    stream = lambda: state.upserts(spark.readStream.schema(KIND).parquet(str(source)))
    arrive(rows[:60])
    assert run(stream(), tmp_path).count() == 60
    arrive(rows[60:])
    got = sorted((tuple(x) for x in run(stream(), tmp_path).select("entity_id", "seq", "op", "status", "version", "payload").collect()), key=lambda x: x[1])
    assert got == plain(rows) and {x[3] for x in got} == {"applied", "conflict", "missing"}
    log = state.change_log(spark.read.parquet(str(tmp_path / "out")))
    want, cursor, pulled = [x[1] for x in got if x[3] == "applied"], None, []
    while True:
        part = state.pull(log, cursor, 10).orderBy("place").collect()
        pulled += [x.cursor for x in part]
        if not part or not part[-1].has_more:
            break
        cursor = part[-1].cursor
    assert pulled == want


def test_entries_expire(spark, store, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", 0, 0, "x"), ("a", 1, 5, None), ("a", 2, 19, None), ("a", 3, 20, None), ("b", 4, 21, None), ("a", 5, 30, "y"), ("a", 6, 49, None), ("a", 7, 51, None), ("b", 8, 60, "z"), ("b", 9, 61, None)]
    frame = [(k, s, t0 + dt.timedelta(seconds=t), v) for k, s, t, v in rows]
    kind = "key string, seq long, at timestamp, value string"
    for part in (frame[:5], frame[5:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = run(state.cached(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), state.READINGS_LIVE, "0 seconds"), tmp_path)
    assert {x.seq: (x.found, x.value) for x in out.collect()} == {1: ("hit", "x"), 2: ("hit", "x"), 3: ("miss", None), 4: ("miss", None), 6: ("hit", "y"), 7: ("miss", None), 9: ("hit", "z")}


def test_changes_live_so_long(spark):
    log = spark.createDataFrame([(k, dt.datetime(2024, 1, 1) + dt.timedelta(days=k)) for k in range(120)], "cursor long, at timestamp")
    kept = state.pull(log, None, 1000, "2024-04-30 12:00:00")
    assert kept.agg(F.min("cursor")).first()[0] == 31 and kept.count() == 89
