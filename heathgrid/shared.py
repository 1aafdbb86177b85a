"""The folder that all executors share, and tables in it that go together."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Frees the shuffle files of a query when it ends; without it they stay until the driver's memory is cleaned.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is named, a local session gets one of its own; a cluster must name one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The filesystem of a local path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def remove_folder(path: str) -> None:
    """A folder of the shared one, with all that is in it; nothing if it isn't there."""
    fs, at = filesystem(path)
    if fs.get_file_info(at).type == pafs.FileType.Directory:
        fs.delete_dir(at)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it from there from now on."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Names of the tables written, in the blocks of scratch() that are open; the first list is of those outside any.
_held: list[list[str]] = [[]]


def written(df: DataFrame, held: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder, which stays until the block of scratch() around it ends, or until release().

    With a list, its name goes there and the caller drops it.
    """
    spark = df.sparkSession
    name = f"scratch_{uuid.uuid4().hex}"
    spark.sql(f"create database {name} location '{shared_folder(spark)}/{name}'")
    (_held[-1] if held is None else held).append(name)
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        df.write.option("compression", "zstd").format("parquet").saveAsTable(f"{name}.rows")
    finally:
        spark.conf.set(FREED, before)
    return spark.table(f"{name}.rows")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drops, at its end, the tables that were written inside."""
    _held.append([])
    try:
        yield
    finally:
        drop(spark, _held.pop())


def keep(names: list[str]) -> None:
    """Leave tables to the block of scratch() around, or to release()."""
    _held[-1].extend(names)


def release(spark: SparkSession) -> None:
    """Drop the tables written outside any block of scratch(); results that read them must be on disk by then."""
    drop(spark, _held[0])
    _held[0] = []


def drop(spark: SparkSession, names: list[str]) -> None:
    for name in names:
        spark.sql(f"drop database if exists {name} cascade")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as make it differ from every column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
