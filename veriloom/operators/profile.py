"""Length distributions and style profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from ..functions import text as T


def ranked(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows by distinct value with count, rank range and group size: at most as many rows as distinct values."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("c"))
    order = W.partitionBy(key).orderBy(value)
    upto = F.sum("c").over(order.rowsBetween(W.unboundedPreceding, 0))
    return counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(W.partitionBy(key)))


def summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """mean, population deviation (both to one digit), p10, p50, p90 by lower rank."""
    found = ranked(rows, key, value)
    at = lambda f: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * F.lit(f)), F.col(value)))
    mean = F.sum(F.col(value) * F.col("c")) / F.sum("c")
    square = F.sum(F.col(value).cast("double") * F.col(value) * F.col("c")) / F.sum("c")
    out = found.groupBy(key).agg(mean.alias("m"), square.alias("s"), at(0.1).alias("p10"), at(0.5).alias("p50"), at(0.9).alias("p90"))
    return out.select(key, T.round_half_up(F.col("m"), 1).alias("mean"), T.round_half_up(F.sqrt(F.greatest(F.lit(0.0), F.col("s") - F.col("m") * F.col("m"))), 1).alias("std_dev"), "p10", "p50", "p90")


def mattr(tokens: DataFrame, key: str, token: str = "token", at: str = "pos", window: int = 200, n: str | None = None) -> DataFrame:
    """Mean share of distinct tokens over sliding windows, in closed form. `n` names a column with a text's number of tokens.

    A token counts in each window that holds it but not its previous occurrence; how many windows those are
    follows from the two places. Up to `window` tokens the share is that of the whole.
    """
    total = F.col(n) if n else F.count("*").over(W.partitionBy(key))
    before = F.coalesce(F.lag(at).over(W.partitionBy(key, token).orderBy(at)), F.lit(-1))
    rows = tokens.select(key, F.col(at).cast("long").alias("p"), before.cast("long").alias("q"), total.cast("long").alias("n"))
    spans = F.greatest(F.lit(0).cast("long"), F.least("p", F.col("n") - window) - F.greatest(F.col("q") + 1, F.col("p") - (window - 1)) + 1)
    fresh = (F.col("q") < 0).cast("long")
    whole = F.col("n") <= window
    rows = rows.groupBy(key).agg(F.max("n").alias("n"), F.sum(F.when(whole, fresh).otherwise(spans)).alias("total"))
    value = F.when(whole, F.col("total") / F.col("n")).otherwise(F.col("total") / (F.lit(float(window)) * (F.col("n") - window + 1)))
    return rows.select(key, F.col("n").alias("tokens"), T.round_half_up(value, 3).alias("mattr"))


@arrow_udf(LongType())
def window_counts(words: pa.Array, window: pa.Array) -> pa.Array:
    """For each row's words: in how many windows a word stands that the window doesn't hold before, over all words; of up to one window the distinct words.

    Arrow numbers the words; a word's last place before in its row then gives its windows, as in mattr.
    """
    offsets = np.asarray(words.offsets) - words.offsets[0].as_py()
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)
    codes = np.asarray(words.flatten().dictionary_encode().indices, np.int64)
    place = np.arange(len(codes)) - offsets[row]
    order = np.lexsort((codes, row))  # stable: equal words of a row stay in the order of their places
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[order][1:] == codes[order][:-1]) & (row[order][1:] == row[order][:-1])
    last = np.full(len(codes), -1, np.int64)
    last[order[1:][same[1:]]] = place[order[:-1][same[1:]]]
    w, n = np.asarray(window, np.int64)[row], lengths[row]
    spans = np.maximum(0, np.minimum(place, n - w) - np.maximum(last + 1, place - (w - 1)) + 1)
    upto = np.concatenate(([0], np.cumsum(np.where(n <= w, last < 0, spans), dtype=np.int64)))
    return pa.array(upto[offsets[1:]] - upto[offsets[:-1]])


def row_mattr(words: Column, window: int) -> tuple[Column, Column]:
    """Number of words of a row's array, and the mean share of distinct ones over sliding windows; no shuffle."""
    n, total = F.size(words), window_counts(words, F.lit(window).cast("long"))
    value = F.when(n <= window, total / n).otherwise(total / (F.lit(float(window)) * (n - window + 1)))
    return n.cast("long"), F.when(n > 0, T.round_half_up(value, 3)).otherwise(F.lit(0.0))


def _of_lengths(name: str, lengths: Column) -> dict[str, Column]:
    """Mean, population deviation (both to one digit) and lower-rank percentiles of an array within its row; 0 without elements."""
    n, ordered = F.size(lengths), F.array_sort(lengths)
    mean = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x) / n
    square = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x.cast("double") * x) / n
    at = lambda f: F.get(ordered, F.floor((n - 1) * F.lit(f)).cast("int")).cast("long")
    found = {"mean": T.round_half_up(mean, 1), "std_dev": T.round_half_up(F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)), 1), "p10": at(0.1), "p50": at(0.5), "p90": at(0.9)}
    return {f"{name}_{k}": F.when(n > 0, v).otherwise(F.lit(0)) for k, v in found.items()}


#: Signs of similes, Hangul words, sentences that count as short (in characters), the window of word variety.
SIMILES, HANGUL_WORD, SHORT, VARIETY = "처럼|같이|듯이|마치", "[가-힣]+", 18, 200


def style_profile(docs: DataFrame, key: str = "doc_id", text: str = "text", simile: str = SIMILES, word: str = HANGUL_WORD, short: int = SHORT, window: int = VARIETY) -> DataFrame:
    """Per document: characters, sentence and paragraph lengths, dialogue shares, word variety, short sentences, rhetoric per 10,000.

    Everything comes from arrays within the row, in one scan without a shuffle.
    """
    tokens, variety = row_mattr(F.col("w"), window)
    base = docs.select(key, T.trimmed(F.coalesce(F.col(text), F.lit(""))).alias("clean"))
    rows = base.select(
        key, "clean", T.dense_length(F.col("clean")).cast("long").alias("characters"),
        F.transform(T.sentences(F.col("clean")), T.dense_length).alias("s"),
        F.transform(T.paragraphs(F.col("clean")), lambda p: F.struct(T.dense_length(p).alias("n"), T.is_dialogue(p).alias("talk"))).alias("p"),
        F.regexp_extract_all(F.lower("clean"), F.lit(word), F.lit(0)).alias("w"),
    )
    talk = F.filter("p", lambda x: x["talk"])
    share = lambda a, b: F.when(b > 0, T.round_half_up(a / b, 3)).otherwise(0.0)
    rate = lambda pattern: F.when(F.col("characters") > 0, T.round_half_up(F.regexp_count("clean", F.lit(pattern)) * 10_000.0 / F.col("characters"), 2)).otherwise(0.0)
    spoken = F.aggregate(talk, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    profile = rows.select(
        key, "characters", F.size("s").cast("long").alias("sentences"), F.size("p").cast("long").alias("paragraphs"),
        *[c.alias(n) for n, c in {**_of_lengths("sentence", F.col("s")), **_of_lengths("paragraph", F.transform("p", lambda x: x["n"]))}.items()],
        share(F.size(F.filter("s", lambda x: x <= short)), F.size("s")).alias("short_share"),
        share(F.size(talk), F.size("p")).alias("dialogue_paragraph_share"), share(spoken, F.col("characters")).alias("dialogue_share"),
        rate(simile).alias("similes_per_10k"), rate("[?？]").alias("questions_per_10k"), rate("[!！]").alias("exclamations_per_10k"),
        tokens.alias("tokens"), variety.alias("mattr"),
    )
    return profile


def phase_bounds(n: Column, phase: Column, phases: int = 5) -> tuple[Column, Column]:
    """First and last of 1..n in a phase (from 0)."""
    return F.floor(n * phase / phases) + 1, F.floor(n * (phase + 1) / phases)


#: Fixed value: what a phase is sampled at.
POSITIONS = ("entry", "escalation", "payoff")


def phase_samples(counts: DataFrame, arcs: DataFrame, key: str, n: str = "n", phases: int = 5) -> DataFrame:
    """key, phase (from 1), position, sequence, arc: three chapters of each phase, clamped to the arcs that hold its ends.

    counts: key and its number of chapters; arcs: key, arc, start, end, place (of several arcs over a chapter the first by place).
    """
    rows = counts.select(key, F.col(n).cast("long").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(phases - 1).cast("long"))).alias("p"))
    first, last = phase_bounds(F.col("n"), F.col("p"), phases)
    rows = rows.select(key, (F.col("p") + 1).alias("phase"), first.cast("long").alias("first"), last.cast("long").alias("last"))
    at = F.array(*[F.struct(F.lit(name).alias("position"), x.alias("at")) for name, x in zip(POSITIONS, (F.col("first"), F.expr("(first + last) div 2"), F.col("last")))])
    rows = rows.select(key, "phase", "first", "last", F.explode(at).alias("x")).select(key, "phase", "first", "last", "x.*")
    spread = arcs.where("end >= start").select(key, F.struct("place", "arc", "start", "end").alias("o"), F.explode(F.sequence("start", "end")).alias("at"))
    held = spread.groupBy(key, "at").agg(F.min("o").alias("o"))
    found = rows.join(held, [key, "at"], "left")
    sequence = F.when(F.col("position") == "entry", F.greatest("first", F.coalesce("o.start", "first"))).when(F.col("position") == "payoff", F.least("last", F.coalesce("o.end", "last"))).otherwise(F.col("at"))
    return found.select(key, "phase", "position", sequence.cast("long").alias("sequence"), F.coalesce(F.col("o.arc").cast("string"), F.lit("unknown")).alias("arc"))
