"""URL rules decided by a Bloom filter cascade.

A rule is (host, path, verdict); it fits its host and all subdomains when the url's path starts with the rule's.
Every url yields candidate keys: each suffix of its host at a label boundary, with each prefix of its path whose
length occurs among the rules. The distinct keys of all urls are the universe of the cascade.

Level 0 encodes the listed keys. Level 1 encodes the keys of the universe that level 0 accepts although they are
not listed; level 2 the listed keys that level 1 accepts, and so on until a level has no false positives. Over
the universe the cascade is exact, so deciding a url is a scan without any join: a key is listed when the first
level that rejects it is odd, and of the listed keys the longest is the rule. There is one cascade for the
listed keys of each verdict.

Size: level 0 takes a false positive rate of about listed / universe keys, so that level 1 holds about as many keys
as are listed, and the later levels a rate of a half. All levels together so have some 1.44 * log2(universe / listed)
+ 4 bits for each listed key, however many urls there are. Filters reach executors as broadcast bytes.

A url that no rule lists gets the default verdict `allow`. A null url, or one without `://`, has an empty host
and path. Rows that repeat an id, and ties of equal urls, are decided each by itself; very long urls are whole.
An empty table or rule list gives an empty result or the default; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import cut, discard, ship

DEFAULT = "allow"
_CUT_URL = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.translate(F.regexp_extract(url, _CUT_URL, 1), _UPPER, _LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, _CUT_URL, 2)).otherwise("")


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys host suffix + newline + path prefix, the longest rule text first (longer host before longer path)."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in sorted(lengths, reverse=True)]), lambda n: F.length(path) >= n)
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat(s, F.lit("\n"), F.substr(path, F.lit(1), n)))))
    return F.array_sort(keys, lambda a, b: F.length(b) - F.length(a))


def _hashed(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def positions(a: np.ndarray, b: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """Bit positions of keys (their two hashes) in a level: a row for each key."""
    seed = np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) & ((1 << 64) - 1))
    first, step = _mixed(a.view(np.uint64) + seed), _mixed(b.view(np.uint64) ^ seed) | np.uint64(1)
    return (first[:, None] + step[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)


class BloomCascade:
    """Levels of (number of bits, 64-bit words, number of hashes)."""

    def __init__(self, levels: list[tuple[int, np.ndarray, int]]):
        self.levels = levels

    @staticmethod
    def shape(n: int, rate: float) -> tuple[int, int]:
        """Bits and hashes for n keys at a false positive rate."""
        return 64 * max(1, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64)), max(1, round(-math.log2(rate)))

    def accepts(self, a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
        bits, words, hashes = self.levels[level]
        p = positions(a, b, level, bits, hashes)
        return ((words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool).all(1)

    def contains(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether keys of the universe are listed."""
        out, todo = np.zeros(len(a), bool), np.arange(len(a))
        for level in range(len(self.levels)):
            yes = self.accepts(a[todo], b[todo], level)
            out[todo[~yes]] = level % 2 == 1
            todo = todo[yes]
        out[todo] = len(self.levels) % 2 == 1
        return out

    def holds(self, spark, key: Column) -> Column:
        """Whether a key column of the universe is listed."""
        shared = ship(spark).sparkContext.broadcast(self)

        @arrow_udf("boolean")
        def listed(a: pa.Array, b: pa.Array) -> pa.Array:
            return pa.array(shared.value.contains(np.asarray(a), np.asarray(b)))

        return listed(*_hashed(key))

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, rate: float | None = None, most_levels: int = 200) -> BloomCascade:
        """listed, universe: distinct keys in a column `key`; listed keys outside the universe don't matter.

        Each level's bits are gathered by OR over 64-bit words: what reaches the driver is the filter, never keys.
        """
        spark = ship(universe.sparkSession)
        hashed = lambda rows: rows.select("key", *[c.alias(n) for c, n in zip(_hashed(F.col("key")), "ab")])
        positive, negative = cut(hashed(listed)), cut(hashed(universe.join(listed, "key", "left_anti")))
        out = cls([])
        while (n := positive.count()) > 0:
            level = len(out.levels)
            if level == most_levels:
                raise ValueError("two keys have the same hashes: no filter tells them apart")
            others = negative.count()
            bits, hashes = cls.shape(n, rate or (min(0.5, n / others) if level == 0 and others else 0.5))

            def spread(batches, level=level, bits=bits, hashes=hashes):
                for batch in batches:
                    p = positions(np.asarray(batch.column(0)), np.asarray(batch.column(1)), level, bits, hashes).ravel()
                    word, at = np.unique((p >> np.uint64(6)).astype(np.int64), return_inverse=True)
                    mask = np.zeros(len(word), np.uint64)
                    np.bitwise_or.at(mask, at, np.uint64(1) << (p & np.uint64(63)))
                    yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], names=["word", "mask"])

            found = positive.select("a", "b").mapInArrow(spread, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
            words = np.zeros(bits // 64, np.uint64)
            words[np.asarray(found["word"])] = np.asarray(found["mask"]).view(np.uint64)
            out.levels.append((bits, words, hashes))
            shared = spark.sparkContext.broadcast(out)

            def passing(batches, level=level, shared=shared):
                for batch in batches:
                    yield batch.filter(pa.array(shared.value.accepts(np.asarray(batch.column(1)), np.asarray(batch.column(2)), level)))

            kept = cut(negative.mapInArrow(passing, "key string, a long, b long"))
            discard(negative)
            positive, negative = kept, positive
        discard(positive, negative)
        return out


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", rate: float | None = None) -> DataFrame:
    """Per row: id, host, path, rule (host and path of the longest fitting rule, else null), verdict."""
    spark = ship(pages.sparkSession)
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    parts = pages.select(F.col(id_col).cast("long").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    lengths = sorted({len(path) for _, path, _ in rules}) or [0]
    keyed = parts.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    universe = cut(keyed.select(F.explode("keys").alias("key")).distinct())
    cascades = []
    for verdict in ("allow", "block"):
        listed = spark.createDataFrame([(f"{h}\n{p}",) for h, p, v in rules if v == verdict], "key string").distinct()
        cascades.append(BloomCascade.build(listed.join(universe, "key", "left_semi"), universe, rate))
    discard(universe)
    shared = spark.sparkContext.broadcast(cascades)

    @arrow_udf("int")
    def first_hit(a: pa.Array, b: pa.Array) -> pa.Array:
        """Place of the first listed key, twice and plus one where its verdict is block; -1 where none is listed."""
        starts = np.asarray(a.offsets)
        x, y = np.asarray(a.flatten()), np.asarray(b.flatten())
        starts = starts - starts[0]
        allow, block = (c.contains(x, y) for c in shared.value)
        hits = np.flatnonzero(allow | block)
        row = np.searchsorted(starts, hits, side="right") - 1
        rows, first = np.unique(row, return_index=True)
        out = np.full(len(a), -1, np.int32)
        out[rows] = 2 * (hits[first] - starts[rows]) + block[hits[first]]
        return pa.array(out)

    hashes = F.transform("keys", lambda k: _hashed(k)[0]), F.transform("keys", lambda k: _hashed(k)[1])
    decided = keyed.withColumn("hit", first_hit(*hashes))
    rule = F.when(F.col("hit") >= 0, F.translate(F.get("keys", F.floor(F.col("hit") / 2).cast("int")), "\n", ""))
    verdict = F.when(F.col("hit") < 0, DEFAULT).when(F.col("hit") % 2 == 1, "block").otherwise("allow")
    return decided.select("id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
