"""Tables that readers see whole or not at all: versions behind a pointer, and batches that are added once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: The file that names the version in force.
POINTER = "CURRENT"


def _files(spark: SparkSession, path: str):
    """Hadoop's view of ``path``, and a function that makes paths under it."""
    hadoop = spark._jvm.org.apache.hadoop
    root = hadoop.fs.Path(path)
    settings = spark._jsc.hadoopConfiguration()
    context = hadoop.fs.FileContext.getFileContext(root.getFileSystem(settings).getUri(), settings)
    return context, root.getFileSystem(settings), lambda name: hadoop.fs.Path(root, name)


def _renamed(spark: SparkSession, context, old, new, overwrite: bool) -> None:
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE if overwrite else option.NONE
    context.rename(old, new, options)


def publish(df: DataFrame, path: str, kind: str = "parquet") -> str:
    """Write ``df`` as a new version under ``path`` and point readers at it, by one rename. A write that
    fails leaves the version before in force; of two at a time the one that ends last is. Returns the
    version's name. Earlier versions stay until somebody removes them."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.format(kind).save(f"{path}/versions/{version}")
    context, files, at = _files(spark, path)
    told = at(f".{POINTER}-{version}")
    stream = files.create(told, False)
    stream.write(f"{kind} {version}".encode())
    stream.close()
    _renamed(spark, context, told, at(POINTER), True)
    return version


def published(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The version in force under ``path``."""
    context, files, at = _files(spark, path)
    stream = files.open(at(POINTER))
    kind, version = bytes(stream.readAllBytes()).decode().split()
    stream.close()
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(kind).load(f"{path}/versions/{version}")


def add_once(df: DataFrame, path: str, batch: str, kind: str = "parquet") -> bool:
    """Add ``df`` under ``path`` as the batch of that name, unless it is there. The rows are written beside and
    moved by one rename that fails where the batch exists, so of two runs at a time one adds and the
    other does not; a run that fails adds nothing. Returns whether it added."""
    spark = df.sparkSession
    context, files, at = _files(spark, path)
    if files.exists(at(f"batches/{batch}")):
        return False
    beside = f"pending/{uuid.uuid4().hex}"
    df.write.format(kind).save(f"{path}/{beside}")
    files.mkdirs(at("batches"))
    try:
        _renamed(spark, context, at(beside), at(f"batches/{batch}"), False)
    except Exception as error:  # the JVM's error, by its name
        if "FileAlreadyExists" not in str(error) and not files.exists(at(f"batches/{batch}")):
            raise
        files.delete(at(beside), True)
        return False
    return True


def added(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """All batches under ``path``; without any, no rows."""
    _, files, at = _files(spark, path)
    if not files.exists(at("batches")):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(kind).load(f"{path}/batches/*")
