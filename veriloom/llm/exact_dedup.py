"""Exact deduplication by skew-safe combining.

Texts are equal when they are identical without blanks. Three combining stages, each comparing whole
content (the content is a grouping key next to its digest, so a digest collision never merges two texts):

1. local: the partial aggregation of every scan task keeps one row per (digest, content, length, salt);
2. salted: a shuffle on (digest, content, length, salt) merges the local rows, so a hot text is spread over `salts` tasks;
3. global: the salt winners, at most `salts` per content and length, meet by digest and give the final winner.

The narrow result (digest, salts, winner, size) is written to the shared folder and joined to the rows on
(digest, salt): again no task gets more than a salt's share of a hot text.

Null texts count as empty and equal each other. A row without id loses against rows with one; such rows are salted
by their place, and their groups' winners go to all salts. Rows that repeat an id are rows of their own in the sizes;
of those that agree with the winner in id and length one is kept. An empty table gives an empty
result. Other columns, whatever their names, are not touched. Very long texts are values like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANK_CLASS, cut, fresh, text_or_empty

SALTS = 32


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def _keyed(docs: DataFrame, id_col: str, text_col: str, salts: int, digest) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.select("id", F.regexp_replace("text", BLANK_CLASS + "+", "").alias("content"), F.length("text").alias("points"))
    place = F.when(F.col("id").isNull(), F.monotonically_increasing_id()).otherwise(F.col("id"))
    return rows.withColumn("digest", digest(F.col("content"))).withColumn("salt", F.pmod(F.xxhash64(place), F.lit(salts)).cast("int"))


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """One row per content: digest, content, best, size, salts, and how many contents share the digest."""
    salted = rows.groupBy("digest", "content", "points", "salt").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.bool_or(F.col("id").isNull()).alias("nameless"))
    best = F.min(F.struct((-F.col("points")).alias("shorter"), F.col("id").isNull().alias("last"), "id")).alias("best")
    whole = salted.repartition("digest").groupBy("digest", "content").agg(best, F.sum("n").alias("size"), F.collect_set("salt").alias("found"), F.bool_or("nameless").alias("nameless"))
    every = F.sequence(F.lit(0), F.lit(salts - 1))  # a second scan may place rows without id elsewhere
    whole = whole.withColumn("salts", F.when(F.col("nameless"), every).otherwise(F.col("found")))
    return whole.withColumn("sharing", F.count("*").over(W.partitionBy("digest")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=sha256_hex) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, digest of the content."""
    rows = _keyed(docs, id_col, text_col, salts, digest)
    winners = _winners(rows, salts)
    narrow = cut(winners.select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.shorter")).alias("longest"), F.col("size").alias("group_size"), "salts", "sharing"))
    if narrow.where("sharing > 1").isEmpty():
        found = narrow.select("digest", F.explode("salts").alias("salt"), "keep_id", "longest", "group_size")
        joined = rows.select("id", "points", "digest", "salt").join(found, ["digest", "salt"])
    else:  # colliding digests: the content itself decides
        found = winners.select("digest", "content", F.explode("salts").alias("salt"), F.col("best.id").alias("keep_id"), (-F.col("best.shorter")).alias("longest"), F.col("size").alias("group_size"))
        joined = rows.select("id", "points", "digest", "salt", "content").join(found, ["digest", "content", "salt"])
    best = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("longest"))
    found = joined.select("id", "keep_id", "group_size", best.alias("kept"), "digest")
    return found.where("not kept or group_size = 1").unionByName(_one_of_equals(found.where("kept and group_size > 1")))


def _one_of_equals(rows: DataFrame) -> DataFrame:
    """Of rows that agree in everything one stays marked. They are counted and laid out anew, in two steps, so none are gathered."""
    counted = rows.groupBy("id", "keep_id", "group_size", "digest").agg(F.count("*").alias("c"))
    most = F.lit(1 << 16).cast("long")
    blocks = counted.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / most)))).repartition("digest", "b")
    laid = blocks.withColumn("i", F.explode(F.sequence(F.col("b") * most, F.least((F.col("b") + 1) * most, F.col("c")) - 1)))
    return laid.select("id", "keep_id", "group_size", (F.col("i") == 0).alias("kept"), "digest")


def keep_one_copy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of equal texts the longest, then the least id.

    Rows that agree with it in id, content and length count as one, and any of them stays. Nulls, empty tables and
    clashing names are as in exact_groups.
    """
    rows = _keyed(docs, id_col, text_col, salts, sha256_hex)
    mark = lambda digest, i, points: F.concat_ws(":", digest, F.coalesce(i.cast("string"), F.lit("~")), points.cast("string"))
    winners = cut(_winners(rows, salts).select(mark(F.col("digest"), F.col("best.id"), -F.col("best.shorter")).alias("winner")))
    (name,) = fresh(docs.columns, "mark")
    content = F.regexp_replace(text_or_empty(text_col), BLANK_CLASS + "+", "")
    marked = docs.withColumn(name, mark(sha256_hex(content), F.col(id_col).cast("long"), F.length(text_or_empty(text_col))))
    found = marked.join(winners, marked[name] == winners["winner"], "left_semi")  # one shuffle serves the join and the distinct
    return found.dropDuplicates([name]).select(*[F.col(f"`{c}`") for c in docs.columns])
