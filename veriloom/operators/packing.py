"""Ordered items into bounded parts, and context budgets.

Additive costs: next-fit by successor pointers, over any number of tasks for a group. Each item's jump, the item that a part
beginning with it leaves for the next, comes from prefix sums; pointer doubling marks the items that parts begin with.
Other tests and costs of whole parts are walks over a group's sorted rows in one task, as each step depends on the last.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..shared import written
from .ranges import greatest_so_far, numbered

STATIC, LIMIT, INPUT_CAP, RESERVE = 16_384, 272_000, 190_000, 48_000


def _jumps(items: DataFrame, target: int) -> DataFrame:
    """items (_g, _i, _before, _cost) to _g, _i and _j: where the part after one that begins with _i begins, of those within the group.

    The items at or before the point that the target reaches are counted by one sorted pass over sums and reaches together.
    """
    ends = items.select("_g", (F.col("_before") + F.col("_cost")).alias("at"), F.lit(0).alias("ask"), (F.col("_i") + 1).alias("k"), F.lit(None).cast("long").alias("_i"))
    asks = items.select("_g", (F.col("_before") + target).alias("at"), F.lit(1).alias("ask"), F.lit(None).cast("long").alias("k"), "_i")
    met = greatest_so_far(ends.unionByName(asks), "_g", ["at", "ask", "k", "_i"], "k", "reached").where("ask = 1")
    return met.select("_g", "_i", F.greatest(F.col("_i") + 1, F.coalesce("reached", F.lit(0))).alias("_j"))


def _starts(jumps: DataFrame) -> DataFrame:
    """_g and _i of the items that a chain of jumps from a group's item 0 reaches: as many rounds as the logarithm of the parts."""
    onto = lambda left, at: left.join(hops.select(F.col("_g").alias("_h"), F.col("_i").alias("_from"), F.col("_j").alias("_to")), F.col("_g").eqNullSafe(F.col("_h")) & (F.col(at) == F.col("_from")))
    marked, hops = jumps.where("_i = 0").select("_g", "_i"), jumps
    last = jumps.groupBy("_g").agg(F.max("_i").alias("_last")).withColumnRenamed("_g", "_lg")
    hops = written(hops.join(last, F.col("_g").eqNullSafe(F.col("_lg"))).where("_j <= _last").select("_g", "_i", "_j"))
    while not hops.isEmpty():
        marked = written(marked.unionByName(onto(marked, "_i").select("_g", F.col("_to").alias("_i"))))
        hops = written(onto(hops, "_j").select("_g", "_i", F.col("_to").alias("_j")))
    return marked


def next_fit(items: DataFrame, group: str, order: str, cost: str, target: int, fits: Callable[[int, int], bool] | None = None) -> DataFrame:
    """group, order, cost and part (from 1): a part closes when it isn't empty and the next item would exceed the target.

    Costs are whole numbers from 0; a null costs nothing. An item that doesn't fit alone still gets a part of its own.
    fits(sum, cost) may replace the additive test: then one task walks a group's sorted rows and keeps the running sum.
    """
    if fits:
        return _walked(items, group, order, cost, fits)
    rows = items.select(F.col(group).alias("_g"), F.col(order).alias("_o"), F.coalesce(F.col(cost).cast("long"), F.lit(0)).alias("_cost"))
    rows = written(_numbered(rows))
    begins = _starts(_jumps(rows, target)).select(F.col("_g").alias("_h"), F.col("_i").alias("_begin"))
    flagged = rows.join(begins, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_i") == F.col("_begin")), "left").withColumn("_first", F.col("_begin").isNotNull())
    parts = numbered(flagged.select("_g", "_o", "_i", "_cost", "_first"), "_g", ["_i"], F.col("_first").cast("long"), "_again", "_parts")
    return parts.select(F.col("_g").alias(group), F.col("_o").alias(order), F.col("_cost").alias(cost), (F.col("_parts") + F.col("_first").cast("long")).alias("part"))


def _numbered(rows: DataFrame) -> DataFrame:
    return numbered(rows.withColumnRenamed("_cost", "_c"), "_g", ["_o"], F.col("_c"), "_i", "_before").withColumnRenamed("_c", "_cost")


def _walked(items: DataFrame, group: str, order: str, cost: str, ok: Callable[[int, int], bool]) -> DataFrame:
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, part, total = None, 0, 0
        for rows in batches:
            parts = []
            for g, c in zip(rows[group], rows[cost]):
                if g != now:
                    now, part, total = g, 0, 0
                if part and ok(total, c):
                    total += c
                else:
                    part, total = part + 1, c
                parts.append(part)
            yield rows.assign(part=parts)

    rows = items.select(group, order, F.col(cost).cast("long").alias(cost)).repartition(group).sortWithinPartitions(group, order)
    return rows.mapInPandas(walk, rows.drop("part").schema.simpleString()[7:-1].replace(":", " ") + ", part long")


def longest_fitting(items: list, cost: Callable[[list], int | None], budget: int) -> int:
    """How many of the items the longest prefix takes whose cost is known and within the budget.

    cost must not fall as a prefix grows; None (no cost can be told) counts as too much. Doubles, then halves.
    """
    fits = lambda n: (c := cost(items[:n])) is not None and c <= budget
    if not items or not fits(1):
        return 0
    low, high = 1, 2
    while high <= len(items) and fits(high):
        low, high = high, 2 * high
    high = min(high, len(items) + 1)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if fits(middle) else (low, middle)
    return low


def greedy_by_cost(items: DataFrame, group: str, order: str, payload: str, budget: int, cost: Callable[[list], int | None]) -> DataFrame:
    """group, order, part (from 1) and error: parts are maximal prefixes whose exact cost as a whole fits the budget.

    cost gets the payloads of a possible part, in order, and says what the whole part costs, or None. An item that fits no part by
    itself has no part but an error, and the next part begins after it. One task walks a group's sorted rows; it
    holds the items of one part and at most as many again to look ahead.
    """
    schema = items.select(group, order).schema.simpleString()[7:-1].replace(":", " ") + ", part long, error string"

    def walk(batches):
        now, part, held, tried, out, kinds = None, 0, [], 0, [], None

        def close(all_there: bool):
            nonlocal part
            while held:
                n = longest_fitting([x for _, x in held], cost, budget)
                if n == len(held) and not all_there:
                    return  # the part may go on
                part += n > 0
                out.extend((now, o, part, None) for o, _ in held[:n]) if n else out.append((now, held[0][0], None, "fits-no-part"))
                del held[: n or 1]

        def given():
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=[group, order, "part", "error"])

        for batch in batches:
            kinds = [batch.schema.field(0).type, batch.schema.field(1).type, pa.int64(), pa.string()]
            for g, o, x in zip(*(c.to_pylist() for c in batch.columns)):
                if g != now:
                    close(True)
                    now, part, tried = g, 0, 0
                held.append((o, x))
                if len(held) >= max(1, 2 * tried):  # looked at again only once twice as many wait
                    close(False)
                    tried = len(held)
            yield given()
        if kinds:
            close(True)
            yield given()

    return items.select(group, order, payload).repartition(group).sortWithinPartitions(group, order).mapInArrow(walk, schema)


def json_cost(values: list) -> int:
    """Characters of the JSON array of JSON texts."""
    return sum(map(len, values)) + len(values) + 1


def greedy_by_tokens(items: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """Maximal prefixes under a token budget; `fits_alone` is false for an item over the budget by itself."""
    return next_fit(items, group, order, cost, budget).withColumn("fits_alone", F.col(cost) <= budget)


def exact_cover(parts: DataFrame, items: DataFrame, group: str, part: str, order: str) -> DataFrame:
    """Per group whether the parts, one after the other, give the ordered items without repeats. Compared place by place."""
    a = numbered(parts.select(F.col(group).alias("_a"), F.col(part).alias("_part_no"), F.col(order).alias("got")), "_a", ["_part_no", "got"], F.lit(0), "_i", "_0").drop("_0", "_part_no")
    b = numbered(items.select(F.col(group).alias("_b"), F.col(order).alias("want")), "_b", ["want"], F.lit(0), "_j", "_0").drop("_0")
    both = a.join(b, F.col("_a").eqNullSafe(F.col("_b")) & (F.col("_i") == F.col("_j")), "full").select(F.coalesce("_a", "_b").alias(group), "got", "want")
    return both.groupBy(group).agg(F.bool_and(F.col("got").eqNullSafe(F.col("want"))).alias("covered"))


def context_budget(input_bytes: Column, limit: int = LIMIT, reserve: int = RESERVE, static: int = STATIC) -> tuple[Column, Column]:
    """Estimated tokens, and whether they are below the limit."""
    tokens = static + F.ceil(input_bytes / 2.0) + reserve
    return tokens.cast("long"), tokens < limit


def input_gate(input_bytes: Column, cap: int = INPUT_CAP) -> Column:
    return F.ceil(input_bytes / 2.0) <= cap


@F.pandas_udf(LongType())
def encoded_length(text: pd.Series) -> pd.Series:
    """Length of a text as a JSON string, in UTF-16 units as the encoder counts them."""
    return text.map(lambda x: len(json.dumps(x, ensure_ascii=False).encode("utf-16-le")) // 2 if x is not None else 0)
