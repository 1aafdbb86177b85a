"""SimHash fingerprints and the documents whose fingerprints lie within a few bits of each other.

Candidate search embeds a fingerprint as the population counts of its 32 two-bit segments. The
Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints, so a range
join of the embeddings finds every link. The grid: links of up to 4 bits have distance up to 2 in one
half of the segments at least, and two lattice points at distance up to 2 share a point within 1 of
each. Every fingerprint is filed under its own point and the neighbours, in each half; of the points
that two fingerprints share, one step from the smaller towards the other names the pair, so that each
pair is made once. The exact distance is verified inside the join. Equal fingerprints are one node, so
a group of copies, however large, costs one row.

A segment's count is held in unary (00, 01, 11), which makes the Manhattan distance a bit count.

Defined cases: null and empty texts have fingerprint zero and link to one another; fewer than four
words form one shingle; repeated rows give repeated result rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heathgrid.llm.common import ASCII_LOWER, WORD, components, slices, texts_of
from heathgrid.shared import cut, fresh

SEED = 42
MOST_BITS = 4
PIECE = 8192  # shingles whose bits are unpacked at a time


def fingerprint(text: str, size: int = 4) -> int:
    """As a signed 64-bit number."""
    words = WORD.findall(text.translate(ASCII_LOWER))
    if not words:
        return 0
    joined = " ".join(words).encode()
    at = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(x.encode()) + 1 for x in words] if not joined.isascii() else [len(x) + 1 for x in words], out=at[1:])
    last = max(1, len(words) - size + 1)
    ends = at[min(size, len(words)) :] - 1
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(joined[a:b], SEED) for a, b in zip(at[:last].tolist(), ends.tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, last, PIECE):
        ones += np.unpackbits(hashes[k : k + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, fp long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pa.array([fingerprint(x, size) for x in texts_of(batch)], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def long(n: int) -> Column:
    return F.lit(n).cast("long")


def unary(v: Column) -> Column:
    """The counts of the two-bit segments of the 32 bits v, each in unary: its bits in order."""
    low, up = long(0x55555555), F.shiftright(v, 1)  # the low bit of every segment
    return v.bitwiseOR(up).bitwiseAND(low).bitwiseOR(F.shiftleft(v.bitwiseAND(up).bitwiseAND(low), 1))


def half(fp: Column, h: Column) -> Column:
    """Half h of a fingerprint."""
    return F.call_function("shiftrightunsigned", fp, (h * 32).cast("int")).bitwiseAND(long(0xFFFFFFFF))


def links(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct values of column fp at 4 or fewer differing bits.

    Columns and not SQL text: parsing expressions this deep leaves a hundred megabytes in the driver.
    """
    own = [F.struct(long(h).alias("half"), unary(half(F.col("fp"), long(h))).alias("p")) for h in (0, 1)]
    halves = nodes.select("fp", F.explode(F.array(*own)).alias("x")).select("fp", "x.*")
    point, one = F.col("p"), long(1)
    bit = lambda v, k: F.call_function("shiftright", v, k).bitwiseAND(one)
    # a bit may flip if the count stays valid: the low one while the high one is 0, the high one while the low one is 1
    steps = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda k: F.when(k % 2 == 0, bit(point, k + 1) == 0).otherwise(bit(point, k - 1) == 1))
    near = F.concat(F.array(point), F.transform(steps, lambda k: point.bitwiseXOR(F.call_function("shiftleft", one, k))))
    # both sides are the same two columns, so they are made and shuffled once; a pair's embedding is made anew from its fingerprints
    filed = halves.select("fp", F.explode(F.transform(near, lambda z: F.col("half") * 4294967296 + z)).alias("cell"))
    a, b = filed.alias("a"), filed.alias("b")
    x, y, cell = F.col("a.fp"), F.col("b.fp"), F.col("a.cell")
    side = F.shiftright(cell, 32)
    p, q = unary(half(x, side)), unary(half(y, side))
    there = F.bit_count(unary(half(x, 1 - side)).bitwiseXOR(unary(half(y, 1 - side))))
    differ = p.bitwiseXOR(q)
    field = differ.bitwiseOR(F.shiftright(differ, 1)).bitwiseAND(long(0x55555555))
    unit = field.bitwiseAND(-field)
    both = differ.bitwiseAND(unit * 3)
    # a count of 0 rises by its low bit first, a count of 2 falls by its high bit first
    step = F.when(both == unit * 3, F.when(p.bitwiseAND(unit) == 0, unit).otherwise(unit * 2)).otherwise(both)
    here = F.bit_count(differ)
    linked = (here + there <= MOST_BITS) & (F.bit_count(x.bitwiseXOR(y)) <= MOST_BITS)
    named = (here <= 2) & ((side == 0) | (there > 2)) & (cell == side * 4294967296 + p.bitwiseXOR(step))
    return a.join(b, (cell == F.col("b.cell")) & (x < y) & linked & named).select(x.alias("a"), y.alias("b"))


def group(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, fp, n_links (links of its fingerprint to others) and component_id of every row."""
    prints = cut(fingerprints(docs, size))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    pairs = cut(links(nodes.select("fp")))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    label = components(pairs).withColumnRenamed("node", "fp")
    known = nodes.join(label, "fp", "left").join(degree, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    smallest = known.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = known.join(smallest, "label").select("fp", "n_links", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "n_links", "component_id")


def keep_one(docs: DataFrame, size: int = 4) -> DataFrame:
    """The rows of docs that are the smallest doc_id of their group, with docs' own columns."""
    (own,) = fresh(docs, "its_doc")
    kept = group(docs, size).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(own))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi").select(*docs.columns)
