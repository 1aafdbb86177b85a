"""What the text operators share: reading, shared storage, byte views of Arrow texts, components."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heathgrid.shared import cut

#: A word of the contracts: a run of anything but the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
#: Bytes of text that a Python kernel looks at together; a longer text is a slice by itself.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows, in batches of about `most` bytes of text, so that memory doesn't follow the batch size."""
    for batch in batches:
        texts = batch.column(column)
        lengths = np.diff(offsets_of(texts))
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def offsets_of(texts: pa.Array) -> np.ndarray:
    """Byte offsets of an Arrow string array, slices included."""
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(1, dtype=np.int64)
    return np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after another, and each text's offsets in them. Null is an empty text."""
    offsets = offsets_of(texts)
    data = texts.buffers()[2] if len(texts) else None
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return flat, offsets - offsets[0]


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, label); label is one node of the component, the same for all.

    Each round points every node at the neighbour, or itself, that comes first in the round's own hash
    order, follows that pointer once more, and contracts the edges to the nodes pointed at. Edges inside a
    contracted group go, so a dense group is gone after a round and a long chain shrinks by a constant
    factor whatever the order of its nodes. All state stays in checkpointed tables; minima combine before
    the shuffle and the joins are equi-joins that AQE may split, so a hub node doesn't land in one task.
    An empty table gives an empty table.
    """
    left = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct())
    loops = edges.where("a = b").select(F.col("a").alias("node"))
    steps, turn = [], 0
    while left.limit(1).count():
        near = left.select("a", "b").union(left.select("b", "a"))
        best = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        first = near.groupBy(F.col("a").alias("node")).agg(F.min(best("b")).alias("m")).select("node", F.least("m", F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), F.col("node").alias("to")))["to"].alias("to"))
        first = cut(first)
        then = first.select(F.col("node").alias("to"), F.col("to").alias("root"))
        step = cut(first.join(then, "to").select("node", F.col("root").alias("label")))
        steps.append(step)
        at = lambda c: step.select(F.col("node").alias(c), F.col("label").alias(f"{c}_root"))  # noqa: B023, E731
        roots = left.join(at("a"), "a").join(at("b"), "b").where("a_root != b_root")
        left = cut(roots.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct())
        turn += 1
    if not steps:
        return loops.distinct().select("node", F.col("node").alias("label"))
    labels = steps[0]
    for step in steps[1:]:
        further = step.select(F.col("node").alias("label"), F.col("label").alias("root"))
        labels = labels.join(further, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    alone = loops.distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    return cut(labels.union(alone))
