"""The bounded labelled sample on which the two classifiers are fitted."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, utf8

#: The documented bound of the sample: rows of each label, whatever their length.
ROWS_OF_A_LABEL = 3000


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS_OF_A_LABEL, measure=None) -> tuple[list[tuple], tuple[float, float]]:
    """(text, label) of up to `rows` rows for each label, the first by a hash of the id; and what a row of label 0 and 1 stands for.

    With measure(bytes), a list of numbers takes the text's place and is made where the text is, so that texts of any
    length stay on the executors. Labels that are null or neither 0 nor 1 don't count; of several labels of an id the greatest does. The ids
    are chosen first (a bounded top of each label), so only their texts move.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    marks = marks.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    totals = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = [r for y in (0, 1) for r in marks.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows).collect()]
    if not chosen:
        return [], (1.0, 1.0)
    wanted = F.broadcast(spark.createDataFrame([(r["id"], r["y"]) for r in chosen], "wanted long, y int"))  # 2 * rows at most
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    sample = found.join(wanted, F.col("id") == F.col("wanted")).groupBy("id").agg(F.min("t").alias("t"), F.max("y").alias("y"))
    got = [(r["t"], r["y"]) for r in sample.orderBy("id").toLocalIterator()] if measure is None else _measured(sample, measure)
    have = [max(1, sum(1 for _, y in got if y == k)) for k in (0, 1)]
    return got, tuple(max(1, totals.get(k, 0)) / have[k] for k in (0, 1))


def _measured(sample: DataFrame, measure) -> list[tuple[list[float], int]]:
    ship(sample.sparkSession)

    def run(batches):
        for batch in batches:
            found = [measure(raw) for raw in utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], names=["id", "y", "x"])

    rows = sample.select("id", "y", "t").mapInArrow(run, "id long, y int, x array<double>")
    return [(r["x"], r["y"]) for r in sorted(rows.toLocalIterator(), key=lambda r: r["id"])]
