"""Cutting lineage in storage that every executor can read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Temporary folders by application.
_MADE: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session's ``spark.checkpoint.dir`` names. Where that is unset a temporary one
    is made if driver and executors are one process, as in tests; on a cluster it is an error, as other
    executors would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _MADE.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="checkpoint-"))


#: Files of a durable table, and of what a stage of the pipeline writes, for each core of the cluster, at most.
FILES_A_CORE = 4


def in_few_files(df: DataFrame) -> DataFrame:
    """``df`` in at most ``FILES_A_CORE`` partitions a core, for writing. A file for each of many small partitions
    would cost more to make than to fill, so a task takes several in turn where they outnumber that."""
    return df.coalesce(FILES_A_CORE * df.sparkSession.sparkContext.defaultParallelism)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and read it from there. Unlike a local
    checkpoint, the rows outlive a lost executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return in_few_files(df).checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read from there: for tables of many rows,
    which take a fraction of the room there that a checkpoint's rows take."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    in_few_files(df).write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


#: Rows that a task takes at least when a small durable table is read.
ROWS_A_TASK = 50_000


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``durable(df)`` and its number of rows, counted on the way. A table of few rows is read by few
    tasks: else every later shuffle would write as many tiny files as there are partitions."""
    seen = Observation()
    out = durable(df.observe(seen, F.count(F.lit(1)).alias("n")))
    n = seen.get["n"]
    return out.coalesce(1 + n // ROWS_A_TASK), n
