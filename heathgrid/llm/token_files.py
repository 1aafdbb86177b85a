"""Token counts of documents in flat token files, found by their end-of-document identifiers alone.

A token file is a run of fixed-width little-endian token ids in which each document ends with one
end-of-document id; nothing else says where documents begin. Files are cut into byte ranges by their
lengths alone, and a task reads its ranges straight from the storage that all executors share, so no file
is held whole, whatever its size. Each block is searched by itself, as one vector comparison, and gives the
lengths between its ends and a summary. A prefix scan over the summaries, first within spans of SPAN
blocks and then over the spans of a file, tells each block how many documents ended before it and how many
tokens of the document that it starts in lie in earlier blocks, which stitches documents that span blocks.

Blocks are rows of (file, block, offset, length) to be read, or of (file, block, data) that hold their
bytes; file and block are never null and name a row together.

Defined cases: two ends in a row are an empty document; tokens after a file's last end are a document
that isn't complete; empty blocks and files count nothing; null data is an empty block; a null text is
written as an empty document; repeated documents are written and counted each time; an empty table gives
no rows; further columns of documents stay unused, and doc_id may be null or of any type.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heathgrid.llm.byte_bpe import encoder
from heathgrid.llm.common import slices, texts_of
from heathgrid.shared import filesystem, remove_folder, written

#: Tokens in a block of a table of blocks.
BLOCK_TOKENS = 1 << 18
#: Bytes of a file that a task reads at a time.
BLOCK_BYTES = 4 << 20
#: Blocks whose summaries are scanned together before those of a file's spans are.
SPAN = 4096


def width(vocabulary: int) -> str:
    """The type of an id: two bytes if every id fits."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write_blocks(docs: DataFrame, path: str, pattern: str, eod: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, data, doc_ids): one file for each input partition; doc_ids names the documents that end in a block, for tests and reports only."""
    kind = width(eod + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, file, block = encoder(path, pattern), TaskContext.get().partitionId(), 0
        rest, ended = np.zeros(0, dtype=kind), []  # tokens not written yet; (end position in them, doc_id)

        def row(tokens: np.ndarray, ids: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([tokens.tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names=["file", "block", "data", "doc_ids"])

        for batch in slices(batches):
            parts, at = [rest], len(rest)
            for doc_id, coded in zip(batch.column("doc_id").to_pylist(), own.encode_all(texts_of(batch)), strict=True):
                ids = np.frombuffer(coded, dtype="<u4").astype(kind)
                parts += [ids, np.array([eod], dtype=kind)]
                at += len(ids) + 1
                ended.append((at, doc_id))
            rest = np.concatenate(parts)
            while len(rest) >= block_tokens:
                inside = sum(1 for x, _ in ended if x <= block_tokens)
                yield row(rest[:block_tokens], [x for _, x in ended[:inside]])
                rest, ended, block = rest[block_tokens:], [(x - block_tokens, y) for x, y in ended[inside:]], block + 1
        if len(rest):
            yield row(rest, [x for _, x in ended])

    return docs.select("doc_id", "text").mapInArrow(run, "file long, block long, data binary, doc_ids array<long>")


def write_files(docs: DataFrame, folder: str, path: str, pattern: str, eod: int) -> DataFrame:
    """file, ordinal, doc_id: docs as flat token files in a shared folder, one for each input partition that has rows.

    A task that runs again writes another file; only those that the result names count.
    """
    kind = width(eod + 1)
    end = np.array([eod], dtype=kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, at), own, out, ordinal = filesystem(folder), encoder(path, pattern), None, 0
        name = f"part-{TaskContext.get().partitionId()}-{uuid.uuid4().hex}.bin"
        for batch in slices(batches):
            out = out or fs.open_output_stream(f"{at}/{name}")
            for coded in own.encode_all(texts_of(batch)):
                out.write(np.frombuffer(coded, dtype="<u4").astype(kind).tobytes() + end)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n)), batch.column("doc_id")], names=["file", "ordinal", "doc_id"])
            ordinal += n
        if out:
            out.close()

    return docs.select("doc_id", "text").mapInArrow(run, f"file string, ordinal long, doc_id {dict(docs.dtypes)['doc_id']}")


def read_files(spark: SparkSession, paths: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of flat token files, to be read by the search, from paths that pyarrow opens too; block_bytes must be a multiple of a token's width."""
    files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), F.col("length").alias("size"))
    cuts = F.expr(f"sequence(0L, greatest(0L, (size - 1) div {block_bytes}))")
    blocks = files.select("file", "size", F.explode(cuts).alias("block")).withColumn("offset", F.col("block") * block_bytes)
    return blocks.select("file", "block", "offset", F.least(F.lit(block_bytes), F.col("size") - F.col("offset")).alias("length")).repartition("file", "block")


def block_bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[bytes]]]:
    """Batches of blocks, each with its rows' bytes one after another: those held, or those read from the files."""

    def read(batch: pa.RecordBatch) -> Iterator[bytes]:
        for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
            fs, at = filesystem(file)
            with fs.open_input_file(at) as source:
                source.seek(offset)
                yield source.read(length)

    for batch in batches:
        if "data" in batch.schema.names:
            for part in slices(iter([batch]), "data"):
                yield part, (x or b"" for x in part.column("data").to_pylist())
        else:
            for k in range(batch.num_rows):
                yield batch.slice(k, 1), read(batch.slice(k, 1))


def search(blocks: DataFrame, eod: int, kind: str) -> DataFrame:
    """blocks without their bytes, with n (tokens), lengths (tokens before each end, back to the end before or the block's start) and tail (tokens after the last end)."""
    others = [c for c in blocks.columns if c not in ("data", "offset", "length")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, held in block_bytes_of(batches):
            sizes, lengths, tails = [], [], []
            for data in held:
                tokens = np.frombuffer(data, dtype=kind)
                ends = np.flatnonzero(tokens == eod)
                sizes.append(len(tokens))
                lengths.append(np.diff(ends, prepend=-1) - 1)
                tails.append(len(tokens) - 1 - int(ends[-1]) if len(ends) else len(tokens))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(sizes, pa.int64()), pa.array(lengths, pa.list_(pa.int64())), pa.array(tails, pa.int64())], names=[*others, "n", "lengths", "tail"])

    kinds = dict(blocks.dtypes)
    return blocks.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in others) + ", n long, lengths array<long>, tail long")


def prefix(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Summaries (n, ends, tail) with, within their keys, before (ends in earlier rows), carry (tokens since the last of these), closed (where the row's last end stands, in tokens) and final (the last row)."""
    turn = Window.partitionBy(*keys).orderBy(order)
    earlier = turn.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("before", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
    placed = placed.withColumn("closed", F.when(F.col("ends") > 0, F.col("start") + F.col("n") - F.col("tail")))
    carry = F.col("start") - F.coalesce(F.max("closed").over(earlier), F.lit(0))
    return placed.withColumn("carry", carry).withColumn("final", F.lead(order).over(turn).isNull()).drop("start")


def stitch(found: DataFrame, span: int = SPAN) -> DataFrame:
    """found with before (documents that ended in the file's earlier blocks), carry (their last document's tokens so far) and final (the file's last block)."""
    parts = found.select("file", "block", "n", F.size("lengths").alias("ends"), "tail", F.expr(f"block div {span}").alias("span"))
    inner = prefix(parts, ["file", "span"], "block")
    spans = inner.groupBy("file", "span").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.max("closed").alias("closed"))
    outer = prefix(spans.select("file", "span", "n", "ends", (F.col("n") - F.coalesce("closed", F.lit(0))).alias("tail")), ["file"], "span")
    outer = outer.select("file", "span", F.col("before").alias("span_before"), F.col("carry").alias("span_carry"), F.col("final").alias("span_final"))
    carry = F.col("carry") + F.when(F.col("before") > 0, 0).otherwise(F.col("span_carry"))
    placed = inner.join(outer, ["file", "span"]).select("file", "block", (F.col("before") + F.col("span_before")).alias("before"), carry.alias("carry"), (F.col("final") & F.col("span_final")).alias("final"))
    return found.join(placed, ["file", "block"])


def count(blocks: DataFrame, eod: int, kind: str, carrying: str | None = None, span: int = SPAN) -> DataFrame:
    """file, ordinal, n_tokens, complete: one row for each document; carrying names an array column of blocks with a value for each end.

    The search's finds are written to the shared folder first, so the bytes are read once.
    """
    stitched = stitch(written(search(blocks, eod, kind)), span)
    value = f", {carrying}[i]" if carrying else ", cast(null as bigint)"
    tail = F.expr("if(final and tail + if(size(lengths) = 0, carry, 0) > 0, array(named_struct('ordinal', before + size(lengths), 'n_tokens', tail + if(size(lengths) = 0, carry, 0), 'complete', false, 'value', cast(null as bigint))), array())")
    ends = F.expr(f"transform(lengths, (x, i) -> named_struct('ordinal', before + i, 'n_tokens', x + if(i = 0, carry, 0), 'complete', true, 'value'{value}))")
    rows = stitched.select("file", F.explode(F.concat(ends, tail)).alias("x")).select("file", "x.*")
    return rows.withColumnRenamed("value", carrying) if carrying else rows.drop("value")


def count_documents(docs: DataFrame, folder: str, path: str, pattern: str, eod: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write docs as flat token files under folder, which all executors share, then count by search: doc_id, file, ordinal, n_tokens.

    The files go once they are searched. Which document is which in a file is kept beside them and joined last.
    """
    spark, at = docs.sparkSession, f"{folder}/tokens-{uuid.uuid4().hex}"
    fs, local = filesystem(at)
    fs.create_dir(local, recursive=True)
    try:
        names = written(write_files(docs, at, path, pattern, eod))
        named = F.element_at(F.split("file", "/"), -1)
        blocks = read_files(spark, at, block_bytes).join(names.select(F.col("file").alias("name")).distinct(), named == F.col("name"), "left_semi")
        found = count(blocks, eod, width(eod + 1)).where("complete").withColumn("file", named)
    finally:
        remove_folder(at)
    return found.join(names, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")
