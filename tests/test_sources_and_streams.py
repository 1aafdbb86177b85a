import numpy as np
import pytest
from pyspark.sql import functions as F

from heathgrid.sources import tiff
from heathgrid.streaming import log


@pytest.mark.parametrize("kind,predictor", [("<f4", 1), ("<f4", 3), ("<f8", 1), ("<i2", 1), ("<i2", 2), ("<u2", 2), ("<i4", 2), ("<u1", 2)])
def test_tiff_round_trip(spark, tmp_path, kind, predictor):
    z = np.arange(20 * 37).reshape(20, 37) % 200
    (tmp_path / "a.tif").write_bytes(tiff.write(z, 16, kind, predictor, no_data=7))
    found = tiff.cells(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert len(found) == 20 * 37
    assert all(r.z == (None if z[r.y, r.x] == 7 else z[r.y, r.x]) for r in found)


def test_tiff_refusals():
    data = tiff.write(np.zeros((4, 4)), 16)
    with pytest.raises(tiff.Unsupported):
        tiff.parse(b"nothing like it")
    with pytest.raises(tiff.Truncated) as e:
        tiff.parse(data[:40])
    assert e.value.needed > 40


def pack(codes):
    """Codes of 9 bits."""
    bits = "".join(f"{c:09b}" for c in codes)
    return bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))


def test_lzw():
    assert tiff.unpack_lzw(pack([256, 65, 66, 258, 260, 257])) == b"ABABABA"
    assert tiff.unpack_lzw(pack([256, 65, 258, 257])) == b"AAA"
    with pytest.raises(ValueError):
        tiff.unpack_lzw(pack([256, 65, 400]))


def run(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 7, f"2024-01-01 00:{i:02d}:00", i % 3) for i in range(50)]
    batch = spark.createDataFrame(rows, "client_id int, t string, kind int").select("client_id", F.to_timestamp("t").alias("queued_at"), "kind")
    late = spark.createDataFrame([(100, "2024-01-03 00:00:00", 0)], "client_id int, t string, kind int").select("client_id", F.to_timestamp("t").alias("queued_at"), "kind")
    batch.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    assert sorted(r.client_id for r in run(log.once(stream), "once")) == list(range(7))
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # moves the watermark past the first day
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = {(r.start, r.kind): r.n for r in run(log.counts(stream, "queued_at", "10 minutes", by=("kind",)), "tumbling")}
    want = {(r.start, r.kind): r.n for r in log.counts(batch, "queued_at", "10 minutes", by=("kind",)).collect()}
    assert found == want and len(want) == 15
    cells = spark.createDataFrame([(0, 3.5)], "kind int, slope double")
    assert sorted((r.kind, r.slope) for r in run(log.stamped(stream, cells, ["kind"]), "stamped") if r.kind < 2) == sorted([(0, 3.5)] * 18 + [(1, None)] * 17, key=lambda x: x[0])
