"""The folder that driver and executors share, written tables in it, and commits that never overwrite."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset the warehouse, which only a local session or a remote store may stand for."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir: the warehouse is a local folder, which executors may not share")
    return warehouse + "/_veriloom"


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


_marked: set[str] = set()


def new_path(spark: SparkSession) -> str:
    """A path in the session's own part of the shared folder, which goes when the session's JVM ends."""
    folder = f"{shared_folder(spark)}/veriloom/{spark.sparkContext.applicationId}"
    if folder not in _marked:
        at, files = file_system(spark, folder)
        files.mkdirs(at)
        files.deleteOnExit(at)
        _marked.add(folder)
    return f"{folder}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: computed once, and not again when an executor is lost."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as a shuffle has: a file's row group is read by one task, however many follow."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, F.xxhash64(*df.columns))


def exists(spark: SparkSession, path: str) -> bool:
    at, files = file_system(spark, path)
    return files.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, files = file_system(spark, path)
    files.delete(at, True)


def commit(spark: SparkSession, staged: str, path: str) -> bool:
    """Rename, unless something is at `path` already: then the staged files go, and the answer is False."""
    jvm = spark._jvm
    at, to = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration()) if to.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(at, to, none)
    except Exception as error:  # what the gateway makes of a Java exception depends on its kind
        if not isinstance(error, PySparkException) and "FileAlreadyExistsException" not in str(error):
            raise
        if not exists(spark, path):
            raise
        delete(spark, staged)
        return False
    return True
