"""Order within groups of any size: numbers, sums before and last values, range by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import written

#: Rows of a range, about.
RANGE = 1 << 20


def _ranged(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows as a written table with `_part`, the range of (group, order) that each lies in: a group spreads over many."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE)
    return written(rows.repartitionByRange(parts, group, *order).withColumn("_r_part", F.spark_partition_id()))


def _joined(ranged: DataFrame, of_ranges: DataFrame, group: str) -> DataFrame:
    """ranged with columns of its (range, group), each of which is no larger than a range."""
    named = of_ranges.withColumnRenamed("_r_part", "_range_of").withColumnRenamed(group, "_group_of")
    return ranged.join(named, (F.col("_r_part") == F.col("_range_of")) & F.col(group).eqNullSafe(F.col("_group_of"))).drop("_range_of", "_group_of")


def numbered(rows: DataFrame, group: str, order: list[str], cost: Column, number: str, before: str) -> DataFrame:
    """rows with their number in the group, from 0, and the sum of the costs before them.

    Two steps: within a range, and over the ranges' sums.
    """
    ranged = _ranged(rows.withColumn("_r_cost", cost), group, order)
    sums = ranged.groupBy("_r_part", group).agg(F.count("*").alias("_r_n"), F.sum("_r_cost").alias("_r_s"))
    earlier = W.partitionBy(group).orderBy("_r_part").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    offsets = sums.select("_r_part", group, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("_r_n", "_r_s")])
    local = W.partitionBy("_r_part", group).orderBy(*order)
    local = ranged.withColumns({"_r_i": F.row_number().over(local) - 1, "_r_b": F.coalesce(F.sum("_r_cost").over(local.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    found = _joined(local, offsets, group)
    return found.withColumns({number: F.col("_r_n0") + F.col("_r_i"), before: F.col("_r_s0") + F.col("_r_b")}).drop("_r_part", "_r_cost", "_r_n0", "_r_s0", "_r_i", "_r_b")


def greatest_so_far(rows: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """rows with the greatest value of theirs and the group's rows before, in order; nulls don't count."""
    ranged = _ranged(rows, group, order)
    earlier = W.partitionBy(group).orderBy("_r_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy("_r_part", group).agg(F.max(value).alias("_r_m")).select("_r_part", group, F.max("_r_m").over(earlier).alias("_r_m0"))
    local = ranged.withColumn("_r_m", F.max(value).over(W.partitionBy("_r_part", group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    return _joined(local, offsets, group).withColumn(name, F.greatest("_r_m", "_r_m0")).drop("_r_part", "_r_m", "_r_m0")


def previous(rows: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """rows with the value of the group's row before, null for the first. The order tells rows of a group apart."""
    ranged = _ranged(rows, group, order)
    ends = ranged.groupBy("_r_part", group).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_r_m"))
    carried = ends.select("_r_part", group, F.lag("_r_m").over(W.partitionBy(group).orderBy("_r_part"))[value].alias("_r_m0"))  # a row a range
    by = W.partitionBy("_r_part", group).orderBy(*order)
    local = ranged.withColumns({"_r_m": F.lag(value).over(by), "_r_i": F.row_number().over(by)})
    return _joined(local, carried, group).withColumn(name, F.when(F.col("_r_i") == 1, F.col("_r_m0")).otherwise(F.col("_r_m"))).drop("_r_part", "_r_m", "_r_m0", "_r_i")
