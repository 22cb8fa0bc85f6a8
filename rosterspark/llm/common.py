"""Helpers that the operators of this package share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; only where it is unset (tests), an own one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder, so that a lost executor costs nothing before it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`cut`, but as a Parquet table of its own: columns can be pruned when it is read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def bucketed(df: DataFrame, buckets: int, columns: tuple[str, ...], name: str) -> DataFrame:
    """Like :func:`written`, but dealt by hash of ``columns``: grouping and joining by them needs no further shuffle of
    this table.  The catalog's entry names the folder; nothing is kept in the warehouse."""
    spark = df.sparkSession
    own = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{own}"
    df.write.bucketBy(buckets, *columns).option("path", path).option("compression", "zstd").saveAsTable(own)
    return spark.table(own)


def slices(batches, rows: int = 512):
    """Arrow batches in parts of at most ``rows``, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@contextmanager
def collector_off() -> Iterator[None]:
    """Without the collector of cycles, for very many short-lived lists; an error leaves it on again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def fold(column: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the decimal text of ``column`` modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reserved(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns called as what an operator adds (compared as Spark does, without case)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])
