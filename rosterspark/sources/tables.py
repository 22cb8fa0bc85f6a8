"""Reading and writing tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rosterspark.functions.text import strip


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``); where that is unset and Spark runs
    on one machine, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-tables-", dir="/tmp")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoints(spark: SparkSession) -> None:
    """Where lineage is cut by the libraries themselves: in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch(spark, "checkpoints"))


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and safe from lost executors."""
    path = scratch(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in more partitions, where it has fewer than there are cores, for work that is dear by the row: a file is cut by
    its size, and a small one has many rows.  ``df`` is a table as read, without joins."""
    have = df.rdd.getNumPartitions()
    want = min(df.sparkSession.sparkContext.defaultParallelism, 8 * have)
    return df.repartition(want) if have < want else df


def parse_date(c: Column) -> Column:
    """``yyyy-m-d`` or ``m/d/yyyy``, also before 1900; null for anything else."""
    t = strip(c.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("date") for f in ("yyyy-M-d", "M/d/yyyy")])


def column_names(columns: list[str]) -> list[str]:
    """Lower case, underscores for blanks."""
    return [c.lower().replace(" ", "_") for c in columns]


def read_csv(spark: SparkSession, path: str, date_columns: list[str] | None = None, normalise: bool = True, sep: str = ",", multi_line: bool = True) -> DataFrame:
    """A CSV file with a header; columns named like dates (or those given) become dates, all others stay text.  Without
    ``multi_line`` no field may hold a line break, and a file of any size is read by many tasks."""
    raw = spark.read.csv(path, header=True, inferSchema=False, sep=sep, multiLine=multi_line, escape='"')
    dates = set(date_columns) if date_columns is not None else {c for c in raw.columns if "date" in c.lower()}
    typed = raw.select(*[(parse_date(F.col(f"`{c}`")) if c in dates else F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return typed.toDF(*column_names(typed.columns)) if normalise else typed


def read_catalog(spark: SparkSession, folder: str, files: list[str]) -> dict[str, DataFrame]:
    """The files that are there, by name without ending and with underscores."""
    out = {}
    for name in files:
        try:
            out[name.removesuffix(".csv").replace("-", "_")] = read_csv(spark, f"{folder}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return out


def read_pipes(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, date_columns=[], normalise=False, sep="|")


def write_pipes(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "|").option("header", True).csv(path)


def write_catalog(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> list[str]:
    """Writes every table with rows; returns their names."""
    written = []
    for name, df in tables.items():
        if not df.isEmpty():
            writer = df.write.mode("overwrite").option("header", True)
            getattr(writer, kind)(f"{folder}/{name}")
            written.append(name)
    return written


def typed_records(df: DataFrame) -> DataFrame:
    """Records as text: ``seat`` becomes a number, ``vacancy_date`` and ``nomination_date`` dates; null what is none."""
    casts = {"seat": lambda c: c.try_cast("bigint"), "vacancy_date": parse_date, "nomination_date": parse_date}
    return df.withColumns({n: f(F.col(n)) for n, f in casts.items() if n in df.columns})


def snapshot_summary(df: DataFrame, column: str = "retrieval_date") -> DataFrame:
    """One row: number of rows, first and last retrieval, and in words how old the snapshot is."""
    day = F.date_format("first", "yyyy-MM-dd"), F.date_format("last", "yyyy-MM-dd")
    out = df.agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("first"), F.max(column).alias("last"))
    said = (
        F.when(F.col("first").isNull(), F.concat(F.col("n").cast("string"), F.lit(" records, retrieval date unknown")))
        .when(day[0] == day[1], F.concat(F.col("n").cast("string"), F.lit(" records retrieved on "), day[0]))
        .otherwise(F.concat(F.col("n").cast("string"), F.lit(" records retrieved from "), day[0], F.lit(" to "), day[1]))
    )
    return out.withColumn("message", said)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Saved API payloads: one JSON record per line, nested parts kept as text."""
    return spark.read.schema("nomination string, nominee string, request string, retrieval_date timestamp").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame | None:
    """The feature table if it is there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
