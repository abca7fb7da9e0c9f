"""Places of rows in their groups, without a task that gets a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, discard, tasks

#: Rows of a range, about.
RANGE = 1 << 20


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows (a written table) with `tree`, the number of rows in lesser groups, `place` in the group from 0, and `n`, its size.

    Nulls come first. Rows are dealt to ranges of (group, order), so a hot group spreads over many of them; a row's
    number is its number in its range and the sizes of the ranges before. The order must tell rows apart as far as the
    caller minds, and one value of it must not hold many rows (add a row number as its last column).
    """
    keys = [group, *order]
    parts = max(tasks(rows.sparkSession), rows.count() // RANGE)
    ranged = cut(rows.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()))
    sizes = cut(ranged.groupBy("part", group).agg(F.count("*").alias("here")))
    sum_before = lambda value, by: F.coalesce(F.sum(value).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.groupBy("part").agg(F.sum("here").alias("all")).select("part", sum_before("all", W.orderBy("part")).alias("start"))  # one row a range
    firsts = sizes.join(starts, "part").withColumn("first", F.col("start") + sum_before("here", W.partitionBy("part").orderBy(group)))
    trees = firsts.groupBy(group).agg(F.min("first").alias("tree"), F.sum("here").alias("n")).withColumnRenamed(group, "_g")
    found = firsts.join(trees, F.col(group).eqNullSafe(F.col("_g"))).select(F.col("part").alias("_p"), "_g", "start", "tree", "n")
    found = cut(found)
    discard(sizes)
    numbered = ranged.withColumn("row", F.row_number().over(W.partitionBy("part").orderBy(*keys)) - 1)
    joined = numbered.join(found, (F.col("part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn("place", F.col("start") + F.col("row") - F.col("tree")).drop("part", "_p", "_g", "start", "row")
