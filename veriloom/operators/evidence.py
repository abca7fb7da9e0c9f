"""Evidence tables: joins of sequences to intervals, and checks that give rows of violations instead of errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .ranges import previous


def violation(rows: DataFrame, where: Column, rule: str, detail: Column, severity: str = "error") -> DataFrame:
    return rows.where(where).select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def first_interval(points: DataFrame, intervals: DataFrame, group: str, point: str, start: str, end: str, order: str, value: str) -> DataFrame:
    """Each point with the interval that holds it and comes first by `order` (intervals expanded to an equi-join)."""
    spread = intervals.where(F.col(end) >= F.col(start)).select(group, order, value, F.explode(F.sequence(start, end)).alias(point))
    first = spread.groupBy(group, point).agg(F.min_by(value, order).alias(value))
    return points.join(first, [group, point], "left")


def last_interval(points: DataFrame, intervals: DataFrame, group: str, point: str, start: str, end: str, value: str) -> DataFrame:
    """Each point with the interval that was laid over it last, intervals by their start."""
    spread = intervals.where(F.col(end) >= F.col(start)).select(group, F.col(start).alias("_s"), value, F.explode(F.sequence(start, end)).alias(point))
    last = spread.groupBy(group, point).agg(F.max_by(value, F.struct("_s", value)).alias(value))
    return points.join(last, [group, point], "left")


def tiling(intervals: DataFrame, group: str, start: str, end: str, length: str, name: str) -> DataFrame:
    """Violations of: starts after the previous end, ends at or after the start, states its length, has a name of its own."""
    order = W.partitionBy(group).orderBy(start, end)
    rows = intervals.withColumn("expected", F.coalesce(F.lag(end).over(order) + 1, F.lit(1))).withColumn("same", F.count("*").over(W.partitionBy(group, name)))
    tell = lambda *c: F.concat_ws(":", F.col(group), F.col(name), *c)
    return union([
        violation(rows, F.col(start) != F.col("expected"), "interval-start", tell(start, "expected")),
        violation(rows, F.col(end) < F.col(start), "interval-end", tell(start, end)),
        violation(rows, F.col(length) != F.col(end) - F.col(start) + 1, "interval-length", tell(length)),
        violation(rows, (F.col("same") > 1) | F.col(name).isNull(), "interval-name", tell("same")),
    ])


def gaps(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """How often a value isn't the previous one plus one."""
    step = F.col(value) - F.lag(value).over(W.partitionBy(group).orderBy(order))
    return rows.withColumn("g", F.coalesce(step != 1, F.lit(False))).groupBy(group).agg(F.count_if("g").alias("gaps"), F.count("*").alias("n"))


def dense(rows: DataFrame, group: str, value: str, order: list[str]) -> DataFrame:
    """Rows whose value isn't their place from 1."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col(value) != F.col("place"))


def full_coverage(ranges: DataFrame, group: str, start: str, end: str, order: str, size: str) -> DataFrame:
    """Per group whether ranges in their given order cover [0, size) without a gap or overlap."""
    rows = previous(ranges.select(group, start, end, order, size), group, [order, start, end], end, "_end_before")
    ok = (F.col(start) == F.coalesce("_end_before", F.lit(0))) & (F.col(end) > F.col(start))
    return rows.withColumn("ok", ok).groupBy(group).agg(F.bool_and("ok").alias("tiled"), F.max_by(end, order).alias("last"), F.max(size).alias("size")).select(group, (F.col("tiled") & (F.col("last") == F.col("size"))).alias("covered"))


def partial_coverage(ranges: DataFrame, group: str, start: str, end: str, order: str) -> DataFrame:
    """Per group whether ranges are sorted and don't overlap."""
    rows = previous(ranges.select(group, start, end, order), group, [order, start, end], end, "_end_before")
    ok = (F.col(start) >= F.coalesce("_end_before", F.lit(0))) & (F.col(end) > F.col(start))
    return rows.withColumn("ok", ok).groupBy(group).agg(F.bool_and("ok").alias("sorted_apart"))


def modal_value(rows: DataFrame, group: str, value: str, order: str, share: float = 0.12, least: int = 5) -> DataFrame:
    """The most frequent value of each group, of equals the first seen, and whether it is repeated suspiciously often."""
    n = rows.groupBy(group).agg(F.count("*").alias("n"))
    counts = rows.withColumn("v", T.trimmed(F.col(value).cast("string"))).where("v <> ''").groupBy(group, "v").agg(F.count("*").alias("c"), F.min(order).alias("first"))
    top = counts.groupBy(group).agg(F.max_by(F.struct("v", "c"), F.struct("c", -F.col("first"))).alias("top"))
    return top.join(n, group).select(group, F.col("top.v").alias("value"), F.col("top.c").alias("count"), "n", (F.col("top.c") >= F.greatest(F.lit(least), F.ceil(F.col("n") * share))).alias("warned"))


def score_shape(rows: DataFrame, group: str, score: str, low: int = 1, high: int = 10, distinct: int = 4, least: int = 20) -> DataFrame:
    """Scores outside the range; only without any of those, whether too few different ones occur."""
    bad = (F.col(score) % 1 != 0) | (F.col(score) < low) | (F.col(score) > high) | F.col(score).isNull()
    out = rows.groupBy(group).agg(F.count_if(bad).alias("bad"), F.countDistinct(score).alias("different"), F.count("*").alias("n"))
    flat = (F.col("bad") == 0) & (F.col("n") >= least) & (F.col("different") < distinct)
    return out.select(group, "bad", "different", "n", F.when(F.col("bad") > 0, "out-of-range").when(flat, "flat").otherwise("ok").alias("verdict"))


def row_scale(values: list[Column]) -> Column:
    """The scale of a row of numbers, tried in order: 1-10 whole, 0-1, 0-100 with one over 10."""
    each = lambda f: reduce(lambda a, b: a & b, [f(v) for v in values])
    some = lambda f: reduce(lambda a, b: a | b, [f(v) for v in values])
    return (
        F.when(some(lambda v: v.isNull()), "non-numeric")
        .when(each(lambda v: (v % 1 == 0) & v.between(1, 10)), "intensity")
        .when(each(lambda v: v.between(0, 1)), "ratio")
        .when(each(lambda v: v.between(0, 100)) & some(lambda v: v > 10), "percentage")
        .otherwise("invalid")
    )


def scale_sum_ok(scale: Column, values: list[Column]) -> Column:
    total = reduce(lambda a, b: a + b, values)
    return F.when(scale == "ratio", F.abs(total - 1) <= 0.01).when(scale == "percentage", F.abs(total - 100) <= 1).otherwise(scale == "intensity")


def length_shape(rows: DataFrame, group: str, length: str) -> DataFrame:
    """Whether a group of twelve or more is mostly short (up to 3) with nothing long (over 8)."""
    out = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(length) <= 3).alias("short"), F.max(length).alias("longest"))
    return out.withColumn("packet_like", (F.col("n") >= 12) & (F.col("short") / F.col("n") >= 0.65) & (F.col("longest") <= 8))


def formula_frequency(rows: DataFrame, group: str, text: str, pattern: str, share: float, least: int = 8, rows_needed: int = 20) -> DataFrame:
    out = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(text).rlike(pattern)).alias("hits"))
    return out.withColumn("formulaic", (F.col("n") >= rows_needed) & (F.col("hits") >= F.greatest(F.lit(least), F.ceil(F.col("n") * share))))


def uniform_state(rows: DataFrame, group: str, state: str) -> DataFrame:
    """Per group whether all rows are of one state (a null is none), and that state."""
    own = F.col(state)
    one = (F.min(own) == F.max(own)) & (F.count(own) == F.count("*"))
    return rows.groupBy(group).agg(F.coalesce(one, F.lit(False)).alias("uniform"), F.when(one, F.max(own)).alias("state"))


def latest_completion(rows: DataFrame, group: str, completed: str, done: Column | None = None) -> DataFrame:
    """Per group the latest time of the rows that are done, null where none is."""
    return rows.groupBy(group).agg(F.max(F.col(completed) if done is None else F.when(done, F.col(completed))).alias("latest"))


def claims(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer reconciliation on a key: the state of each key, and the columns that differ."""
    a, b = left.select(key, F.struct(*columns).alias("l")), right.select(key, F.struct(*columns).alias("r"))
    unlike = F.array_compact(F.array(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in columns]))
    state = F.when(F.col("r").isNull(), "left-only").when(F.col("l").isNull(), "right-only").when(F.size(unlike) > 0, "differs").otherwise("equal")
    return a.join(b, key, "full").select(key, state.alias("state"), F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), F.array_join(unlike, ",")).otherwise("").alias("unlike"))


def positional(left: DataFrame, right: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Rows of both sides by their place, with those whose values differ or that have no partner."""
    at = F.row_number().over(W.partitionBy(group).orderBy(order))
    a = left.select(group, at.alias("place"), F.col(value).alias("left_value"))
    b = right.select(group, at.alias("place"), F.col(value).alias("right_value"))
    return a.join(b, [group, "place"], "full").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def partition_of(parts: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """Per key of either: how often the parts hold it and whether the whole does; an exact partition has 1 and true."""
    n = parts.groupBy(key).agg(F.count("*").alias("times"))
    return whole.select(key, F.lit(True).alias("wanted")).distinct().join(n, key, "full").select(key, F.coalesce("times", F.lit(0)).cast("long").alias("times"), F.coalesce("wanted", F.lit(False)).alias("wanted"))


def running_total(rows: DataFrame, group: str, order: str, value: str, width: int = 1 << 16) -> DataFrame:
    """rows with `upto`, the sum of values up to and with each row, and `whole`, the group's sum.

    In two steps, over ranges of `width` of the (whole-numbered) order and within a range, so that a group with any part of
    the rows spreads over many tasks.
    """
    cut = F.floor(F.col(order) / width)
    ranged = rows.withColumn("_range", cut)
    sums = ranged.groupBy(group, "_range").agg(F.sum(value).alias("_sum"))
    by = W.partitionBy(group).orderBy("_range")
    before = F.coalesce(F.sum("_sum").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), before.alias("_before"), F.sum("_sum").over(W.partitionBy(group)).alias("whole"))
    within = F.sum(value).over(W.partitionBy(group, "_range").orderBy(order))
    found = ranged.withColumn("_within", within).join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return found.withColumn("upto", F.col("_before") + F.col("_within")).drop("_range", "_within", "_g", "_r", "_before")


def dangling(references: DataFrame, targets: DataFrame, reference: str, target: str) -> DataFrame:
    """References that no target has; a null refers to nothing and dangles."""
    return references.join(targets.select(F.col(target).alias("_target")).distinct(), F.col(reference) == F.col("_target"), "left_anti")


def bound(selectors: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """selectors with whether all of their keys agree with some live row."""
    known = live.select(*keys).distinct().withColumn("_live", F.lit(True))
    return selectors.join(known, keys, "left").withColumn("bound", F.col("_live").isNotNull()).drop("_live")


def counts(rows: DataFrame, group: str, conditions: dict[str, Column]) -> DataFrame:
    """Per group how many rows there are and for how many each condition holds."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()])


def story_index(points: DataFrame, intervals: DataFrame, facts: DataFrame, group: str, point: str, start: str, end: str, interval: str) -> DataFrame:
    """Each point with its interval, the place in it, and the facts known about it (group, point, ...); points without an interval or facts stay."""
    held = first_interval(points, intervals, group, point, start, end, interval, interval)
    rows = held.join(intervals.select(group, interval, F.col(start).alias("_s")), [group, interval], "left")
    return rows.withColumn("in_interval", F.col(point) - F.col("_s") + 1).withColumnRenamed("_s", start).join(facts, [group, point], "left")
