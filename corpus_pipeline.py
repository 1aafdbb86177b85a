"""From raw documents to token ids: quality rules, line dedup, near-dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents. Near-dedup takes shingles of
five words. The last one gives each document's token ids and whether they decode to its text's bytes.

Defined cases are those of the stages' operators; an empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heathgrid.llm import byte_bpe, decontaminate, line_dedup, quality_rules, simhash
from heathgrid.llm.common import table
from heathgrid.llm.registry import VOCABULARY
from heathgrid.shared import drop, keep, scratch, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.rejects(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, 5)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = byte_bpe.encode_and_check(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ["doc_id", "lang", "source"])
    return coded.withColumn("n_tokens", F.expr("cast(length(ids) div 4 as bigint)"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near), ("decontaminate", benchmark), ("byte_bpe", encode)]

#: SimHash and BPE are beyond SQL; tests hold run() against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes once the next one is written; the last one stays until release()."""
    docs, held = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), held)
        drop(spark, held[:-1])
        del held[:-1]
    keep(held)
    return STAGES[-1][1](spark, docs, sf_dir)
