"""What the operators share: shipping code, cutting lineage, reading Arrow text, packing blobs."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship  # noqa: F401

#: The characters that the contracts call blank, as a regular expression class.
BLANK_CLASS = r"[\x20\x09-\x0D]"
#: A row without an id sorts after every row that has one.
LAST_ID = (1 << 63) - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else a folder of the warehouse, which they share too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_veriloom"


def _delete(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if at_exit:
        files.mkdirs(at)
        files.deleteOnExit(at)
    else:
        files.delete(at, True)


_marked: set[str] = set()


def new_table(spark: SparkSession) -> str:
    """A path for a table in the session's own part of the shared folder, which goes when the session's JVM ends."""
    folder = f"{shared_folder(spark)}/veriloom/{spark.sparkContext.applicationId}"
    if folder not in _marked:
        _delete(spark, folder, at_exit=True)
        _marked.add(folder)
    return f"{folder}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back, so that a lost executor costs no recomputation.

    The shuffles that made the table are removed at once: nothing reads them again.
    """
    spark, path = df.sparkSession, new_table(df.sparkSession)
    tidy = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(tidy, "false")
    spark.conf.set(tidy, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(tidy, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of cut() that no later result reads."""
    for table in tables:
        if path := table.__dict__.get("_written_at"):
            _delete(table.sparkSession, path)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names that no column has, in any spelling of case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def tasks(spark: SparkSession) -> int:
    """How many partitions an explicit shuffle gets: the session's own number."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(column: pa.Array):
    """The rows of a string column as bytes, one at a time; null is empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def pack(**arrays) -> bytes:
    """Arrays of one length, one after the other, behind their length."""
    parts = [np.asarray(a) for a in arrays.values()]
    return np.int64(len(parts[0])).tobytes() + b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


def unpack(blob, **kinds) -> dict[str, np.ndarray]:
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, {}
    for name, kind in kinds.items():
        out[name] = np.frombuffer(blob, kind, n, at)
        at += n * np.dtype(kind).itemsize
    return out
