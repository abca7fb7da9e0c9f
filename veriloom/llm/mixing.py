"""Mixing sources to target weights by a low-discrepancy schedule.

Slot t of the mix belongs to the source whose share of the unit interval holds frac(t / golden ratio); the shares
are the targets, cumulated. So after any number of slots each source has its share of them up to a few slots. The
k-th slot of a source takes the k-th block of that source's stream: its documents in a shuffled order (by MD5 of
the id), cut into blocks of equally many words, and again from the start after the last block. A source whose
slots don't reach its target gets closing slots; the slot in which it reaches the target is cut short.

Sources by code point, null last, weigh `weights` in turn and share `share` of all words; a target stops at
`most_repeats` times its source's words, and what is over is shared again by weight (water filling).

Positions within a source are prefix sums in two steps, over ranges of the shuffled order and within a range, so a
source with any part of the rows spreads over many tasks. Slots find their source by an equi-join on cells of the unit
interval, as many as there are sources at least; only the numbers of slots and sources reach the driver.

`mix` tells for each document how many words are taken and the first slot that takes some; `in_order` gives the mix
itself, documents in the order of their slots, so that any prefix of it has the sources in proportion.

Null texts have no words; documents without words take nothing and have no slot. Rows that repeat an id keep separate
positions (ordered by text); rows without id are placed by their text. A null source is a source. Very long texts span
many blocks. An empty table gives empty results. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, fresh, tasks, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE, MOST_REPEATS = 1.5, 2.0
#: The fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: The finest mix: blocks of LEAST_BLOCK words, or larger ones where that would make more than MOST_SLOTS slots. It
#: sets how closely a prefix keeps the shares, not how many words of a document are taken.
MOST_SLOTS, LEAST_BLOCK = 1 << 20, 64
_WORDS = r"[^\x20\x09-\x0D]+"


def sizes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size, and the place in the shuffled order; 4,096 ranges of it for the prefix sums."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(_WORDS)).cast("long").alias("size"), F.xxhash64(text).alias("tie"))
    rows = rows.withColumn("place", F.md5(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("~"), F.col("tie").cast("string")))))
    return rows.withColumn("range", F.substring("place", 1, 3))


def targets_of(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """One row per source: source, source_size, weight, target. Its rows are sources, so one task may order them."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    rows = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    cap = most * F.col("source_size")
    rows = rows.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    # Sources fill up in the order of cap / weight. What is left for the others, divided by their weights, is the level.
    order = W.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(0, W.unboundedFollowing)
    total = share * F.sum("source_size").over(W.partitionBy(F.lit(0)))
    rows = rows.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    first = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(W.partitionBy(F.lit(0)))
    rows = rows.withColumn("first", first)
    target = F.when(F.col("first").isNull() | (F.col("ratio") < F.col("first.ratio")), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("first.level")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def placed(sizes: DataFrame) -> DataFrame:
    """sizes with `start`, a document's first word in its source's shuffled stream."""
    in_range = sizes.groupBy("source", "range").agg(F.sum("size").alias("words"))
    offset = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = in_range.select(F.col("source").alias("s"), F.col("range").alias("r"), offset.alias("offset"))
    within = W.partitionBy("source", "range").orderBy("place", F.col("id").asc_nulls_last(), "tie").rowsBetween(W.unboundedPreceding, -1)
    rows = sizes.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    return rows.select("id", "source", "tie", "size", (F.col("offset") + F.col("within")).alias("start"))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """The mix in order: slot, source, block number, rank of the slot in its source, round, words taken from that block."""
    spark = targets.sparkSession
    order = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    rows = targets.where("target >= 1").withColumn("goal", F.floor("target").cast("long")).withColumn("n", F.row_number().over(order).cast("long"))
    rows = rows.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    rows = rows.withColumn("need", F.expr(f"(goal div source_size) * blocks + cast(ceil((goal % source_size) / cast({block} as double)) as bigint)"))
    rows = cut(rows.withColumn("upto", F.sum("target").over(order) / F.sum("target").over(W.partitionBy(F.lit(0)))))
    slots, sources = (x or 0 for x in rows.agg(F.sum("need"), F.count("*")).first())
    cells = 1 << max(6, (sources - 1).bit_length())
    # A source's share of the unit interval, in every cell that it reaches into; the last one ends at 1.
    share = rows.select("n", F.coalesce(F.lag("upto").over(W.partitionBy(F.lit(0)).orderBy("n")), F.lit(0.0)).alias("low"), F.when(F.col("n") == sources, 1.0).otherwise(F.col("upto")).alias("high"))
    share = share.select("n", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") * F.lit(GOLDEN)) % 1).alias("at"))
    points = points.withColumn("cell", F.floor(F.col("at") * cells)).join(share, "cell").where("low <= at and at < high").select("slot", "n")
    # Ranks within a source in two steps, by ranges of slots, as one source may have most of them.
    points = points.withColumn("part", F.expr("slot div 8192"))
    counts = points.groupBy("n", "part").agg(F.count("*").alias("c"))
    offsets = counts.select("n", "part", F.coalesce(F.sum("c").over(W.partitionBy("n").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    ranked = points.withColumn("within", F.row_number().over(W.partitionBy("n", "part").orderBy("slot"))).join(offsets, ["n", "part"])
    ranked = ranked.select("slot", "n", (F.col("offset") + F.col("within") - 1).alias("rank"))
    got = counts.groupBy("n").agg(F.sum("c").alias("got"))
    short = rows.join(got, "n", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    closing = short.select("n", "got", F.explode(F.sequence("got", F.col("need") - 1)).alias("rank"))
    closing = closing.select((F.lit(slots) + (F.col("rank") - F.col("got")) * sources + F.col("n") - 1).alias("slot"), "n", "rank")
    taken = ranked.unionByName(closing).join(rows, "n").where("rank < need")
    taken = taken.withColumn("block", F.col("rank") % F.col("blocks")).withColumn("round", F.expr("rank div blocks"))
    full = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    left = F.col("goal") - F.col("round") * F.col("source_size") - F.col("block") * block
    return taken.select("slot", "source", "block", "rank", "round", F.least(full, left).alias("words"))


def _block_size(targets: DataFrame, most_slots: int) -> int:
    return max(LEAST_BLOCK, math.ceil((targets.agg(F.sum("target")).first()[0] or 0.0) / most_slots))


def _taken(sizes: DataFrame, targets: DataFrame, block: int) -> DataFrame:
    """source, id, tie, start, size, round, slot, words: what each slot takes of each document (words null: nothing)."""
    slots = schedule(targets, block).select(F.col("source").alias("s"), "block", "slot", "round", "words")
    cuts = F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))
    pieces = placed(sizes).where("size > 0").select("source", "id", "tie", "start", "size", F.explode(cuts).alias("b"))
    joined = pieces.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("block")), "left")
    inside = F.least(F.col("start") + F.col("size") - F.col("b") * block, F.col("words")) - F.greatest(F.col("start") - F.col("b") * block, F.lit(0))
    return joined.select("source", "id", "tie", "start", "size", "round", "slot", F.when(F.col("words").isNotNull() & (inside > 0), inside).alias("words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, most_slots: int = MOST_SLOTS) -> DataFrame:
    """Per row: id, size, source_size, target, taken (words of it that the schedule's slots take, repeats counted), first_slot."""
    sizes = cut(sizes_of(docs, id_col, text_col, source_col))
    targets = cut(targets_of(sizes, weights, share, most))
    taken = _taken(sizes, targets, _block_size(targets, most_slots)).groupBy("source", "id", "start", "size")
    taken = taken.agg(F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("taken"), F.min(F.when(F.col("words").isNotNull(), F.col("slot"))).alias("first_slot"))
    empty = sizes.where("size = 0").select("source", "id", "size", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    rows = taken.select("source", "id", "size", "taken", "first_slot").unionByName(empty).withColumnRenamed("source", "s")
    return rows.join(targets, F.col("source").eqNullSafe(F.col("s"))).select("id", "source", "size", "source_size", "target", "taken", "first_slot")


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, most_slots: int = MOST_SLOTS) -> DataFrame:
    """The mix as rows of docs, each as often as it is taken, in the order of the slots that take it.

    A source's stream is taken from the start again and again, so only the one document at which it stops is taken in
    part; it is in the mix when half of it or more is. Documents without words come last, once each.
    """
    sizes = cut(sizes_of(docs, id_col, text_col, source_col))
    targets = cut(targets_of(sizes, weights, share, most))
    turns = _taken(sizes, targets, _block_size(targets, most_slots)).where("words is not null").groupBy("source", "id", "tie", "start", "size", "round")
    turns = turns.agg(F.sum("words").alias("words"), F.min("slot").alias("slot")).where("2 * words >= size")
    mark = lambda i, tie, source: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("~")), tie.cast("string"), F.coalesce(F.concat(F.lit("'"), source), F.lit("~")))
    rows = turns.select(mark(F.col("id"), F.col("tie"), F.col("source")).alias("of"), F.struct("start", "slot").alias("turn"))
    # Rows that agree in id, text and source have one mark: the first of them takes the turns of the first start, and so on.
    rows = rows.groupBy("of").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    name, number, slot, words, of, turn = fresh(docs.columns, "mark", "number", "slot", "words", "of", "turns")
    rows = rows.select(F.col("of").alias(of), F.col("turns").alias(turn))
    text = text_or_empty(text_col)
    marked = docs.withColumns({name: mark(F.col(id_col).cast("long"), F.xxhash64(text), F.col(source_col).cast("string")), words: F.regexp_count(text, F.lit(_WORDS))})
    marked = marked.withColumn(number, F.row_number().over(W.partitionBy(name).orderBy(name)))
    joined = marked.join(rows, F.col(name) == F.col(of), "left")
    starts = F.array_sort(F.array_distinct(F.transform(turn, lambda t: t["start"])))
    own = F.transform(F.filter(turn, lambda t: t["start"] == F.get(starts, F.col(number) - 1)), lambda t: t["slot"])
    none = F.array(F.lit((1 << 63) - 1))
    mixed = joined.withColumn(slot, F.explode(F.when(F.col(words) == 0, none).otherwise(own)))
    return mixed.repartitionByRange(tasks(docs.sparkSession), slot).sortWithinPartitions(slot, name).select(*[F.col(f"`{c}`") for c in docs.columns])
