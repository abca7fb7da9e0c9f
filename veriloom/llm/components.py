"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

MOST_ROUNDS = 60
#: A node with more neighbours is a hub, at least; at most so many hubs are broadcast.
HUB, MOST_HUBS = 256, 1_000_000


def _mark(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _least(pairs: DataFrame, rows: int) -> DataFrame:
    """pairs (at, to) with m, the least node among `at` and what it is tied to. rows: how many pairs there are at most.

    A hub's neighbours are summed up before the shuffle, and its least node is broadcast to them, so no task gets
    them all. Of so many pairs, 2 * rows / MOST_HUBS or more a hub, there are at most MOST_HUBS / 2 hubs.
    """
    hub = max(HUB, 2 * rows // MOST_HUBS)
    least = pairs.groupBy("at").agg(F.least(F.min("to"), F.first("at")).alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > hub).select("at", "m"))
    others = pairs.join(hubs.select("at"), "at", "left_anti").join(least.where(F.col("n") <= hub).select("at", "m"), "at")
    return others.unionByName(pairs.join(hubs, "at"))


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v of type long. One row (node, root) for each node that has an edge; root is the least of its component.

    Every round halves paths; a table in the shared folder ends each one, and the round before is deleted.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(edges)
    if not before[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(MOST_ROUNDS):
        both = edges.select(F.col("u").alias("at"), F.col("v").alias("to")).union(edges.select("v", "u"))
        large = cut(_least(both, 2 * before[0]).where("to > at").select(F.col("to").alias("u"), F.col("m").alias("v")).distinct())
        down = _least(large.select(F.col("u").alias("at"), F.col("v").alias("to")), 2 * before[0])
        small = down.select(F.col("to").alias("u"), F.col("m").alias("v")).union(down.select("at", "m")).where("u <> v").distinct()
        last, edges = edges, cut(small)
        discard(last, large)
        now = _mark(edges)
        if now == before:
            roots = edges.select(F.col("v").alias("node")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
        before = now
    raise RuntimeError("components didn't settle")
