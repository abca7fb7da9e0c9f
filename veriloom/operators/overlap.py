"""Verbatim overlap between protected sources and artifacts."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import written
from ..shipping import ship

TOKENS, WINDOW_BYTES, MOST_MATCHES = 12, 120, 100
#: So many keys of sources at most are broadcast (24 bytes each); beyond that, keys alone are shuffled first.
MOST_BROADCAST = 1_000_000


def grams(rows: DataFrame, key: str, text: str, size: int, tokens=T.scanner_tokens) -> DataFrame:
    """key, pos (from 0) and a 128-bit key of each run of `size` tokens: 24 bytes a row, however long the tokens."""
    listed = rows.select(key, tokens(F.col(text)).alias("t"))
    # Explode and hashes are one stage of generated code, so the tokens aren't copied for each place. Outer, and filtered
    # by place: a filter of the tokens would be pushed down and find them once more.
    places = F.when(F.size("t") >= size, F.sequence(F.lit(0), F.size("t") - size))
    at = listed.select(key, "t", F.explode_outer(places).alias("pos")).where("pos is not null")
    piece = F.slice("t", F.col("pos") + 1, size)
    return at.select(key, "pos", F.xxhash64(piece).alias("g1"), F.xxhash64(F.lit(7), piece).alias("g2"))


def token_overlap(artifacts: DataFrame, sources: DataFrame, artifact: str = "doc_id", source: str = "item_id", text: str = "text", size: int = TOKENS) -> DataFrame:
    """Each source position whose tokens occur in an artifact, with their first place there.

    The artifacts' grams are cut down to those of the sources before anything is grouped.
    """
    wanted = grams(sources, source, text, size).withColumnRenamed("pos", "source_pos")
    keys = wanted.select("g1", "g2").distinct()
    if keys.count() <= MOST_BROADCAST:
        keys = F.broadcast(keys)
    first = grams(artifacts, artifact, text, size).join(keys, ["g1", "g2"]).groupBy(artifact, "g1", "g2").agg(F.min("pos").alias("artifact_pos"))
    return wanted.join(first, ["g1", "g2"]).select(source, artifact, "source_pos", "artifact_pos")


def is_boundary(data: Column, at: Column) -> Column:
    """Whether a byte offset doesn't cut a UTF-8 character."""
    byte = F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(0xC0) != 0x80, F.lit(True))


def _bytes(text: str) -> Column:
    return F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")


def _hashed(piece: Column) -> list[Column]:
    return [F.xxhash64(piece).alias("g1"), F.xxhash64(F.lit(7), piece).alias("g2")]


def window_overlap(artifacts: DataFrame, sources: DataFrame, artifact: str = "doc_id", source: str = "item_id", text: str = "text", size: int = WINDOW_BYTES) -> DataFrame:
    """Every pair of offsets of equal windows of `size` bytes that begin and end between characters.

    A window holds exactly one whole block that begins at a multiple of half its size and no earlier than half a size into
    it. So artifacts give one key for each such block, sources one for each offset; where a block is met, the windows
    around it are compared byte by byte. Blocks carry the bytes around them where the sources' keys can be
    broadcast; else the keys are met first, and bytes are fetched for what meets.
    """
    half = size // 2
    own = sources.select(F.col(source), _bytes(text).alias("sb")).where(F.octet_length("sb") >= size)
    at = F.sequence(F.lit(0), F.octet_length("sb") - half)
    keys = own.select(source, F.explode(F.transform(at, lambda i: F.struct(i.alias("s"), *_hashed(F.substring("sb", i + 1, F.lit(half)))))).alias("x")).select(source, "x.*")
    data = artifacts.select(artifact, _bytes(text).alias("b")).where(F.octet_length("b") >= size)
    small = keys.count() <= MOST_BROADCAST
    near = lambda b: F.substring("b", F.greatest(b - half, F.lit(0)) + 1, F.least(b, F.lit(half)) + size)
    carried = lambda b: near(b) if small else F.lit(None).cast("binary")
    block = lambda i: F.struct((i * half).alias("at"), *_hashed(F.substring("b", i * half + 1, F.lit(half))), carried(i * half).alias("near"))
    blocks = data.select(artifact, F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.octet_length("b") / half).cast("int") - 1), block)).alias("x")).select(artifact, "x.*")
    met = blocks.join(F.broadcast(keys) if small else keys, ["g1", "g2"])
    if not small:
        met = met.drop("near").join(data, artifact).withColumn("near", near(F.col("at")))
    met = met.join(F.broadcast(own) if small else own, source)
    # A window begins up to half - 1 bytes before the block; `lead` bytes of `near` come before the block.
    lead = F.least("at", F.lit(half))
    fits = lambda d: (d <= F.col("s")) & (d <= lead) & (F.col("s") - d + size <= F.octet_length("sb")) & (lead - d + size <= F.octet_length("near"))
    mine, theirs = lambda d: F.substring("near", lead - d + 1, F.lit(size)), lambda d: F.substring("sb", F.col("s") - d + 1, F.lit(size))
    whole = lambda d: is_boundary(F.col("sb"), F.col("s") - d) & is_boundary(F.col("sb"), F.col("s") - d + size)
    ends = lambda d: is_boundary(F.col("near"), lead - d) & is_boundary(F.col("near"), lead - d + size)
    back = F.filter(F.sequence(F.lit(0), F.lit(half - 1)), lambda d: fits(d) & (mine(d) == theirs(d)) & whole(d) & ends(d))
    found = met.select(source, artifact, "s", "at", F.explode(back).alias("d"))
    return found.select(source, artifact, (F.col("s") - F.col("d")).alias("source_offset"), (F.col("at") - F.col("d")).alias("artifact_offset"))


def surface_copies(candidates: DataFrame, samples: DataFrame, candidate: str, sample: str, text: str = "text", size: int = 5) -> DataFrame:
    """Pairs of which some run of `size` surface tokens is equal.

    The candidates' runs are cut down to those of the samples within the scan, and a candidate keeps each run once.
    """
    wanted = written(grams(samples, sample, text, size, T.surface_tokens).drop("pos").distinct())
    keys = wanted.select("g1", "g2").distinct()
    if wanted.count() <= MOST_BROADCAST:
        keys = F.broadcast(keys)
    met = grams(candidates, candidate, text, size, T.surface_tokens).join(keys, ["g1", "g2"], "left_semi").drop("pos").distinct()
    return met.join(wanted, ["g1", "g2"]).select(candidate, sample).distinct()


#: Characters of terms in one automaton, about 100 bytes each.
MOST_CHARACTERS = 1 << 20


def automaton_of(terms):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in terms:
        found.add_word(term, term)
    if len(found):
        found.make_automaton()
    return found


def held_in(automaton, form: str) -> set[str]:
    return {term for _, term in automaton.iter(form)} if len(automaton) else set()


def _rows_of(keys: pa.Array, owner: list[int], terms: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys.take(pa.array(owner, pa.int64())), pa.array(terms, pa.string())], names=["k", "term"])


def _scan_with(words):
    """Every text once through the one automaton of all terms."""

    def run(batches):
        automaton = automaton_of(words.value)
        for batch in batches:
            hits = [(i, term) for i, form in enumerate(batch.column(1).to_pylist()) for term in held_in(automaton, form)]
            yield _rows_of(batch.column(0), [i for i, _ in hits], [t for _, t in hits])

    return run


def _scan_shards(batches):
    """Sorted rows (shard, block, is_text, k, value): the terms of a shard, then the texts that pass it."""
    at, terms, automaton = None, [], None
    for batch in batches:
        owner, found = [], []
        places = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        for i, (place, is_text, value) in enumerate(zip(places, batch.column(2).to_pylist(), batch.column(4).to_pylist())):
            if place != at:
                at, terms, automaton = place, [], None
            if not is_text:
                terms.append(value)
                continue
            automaton = automaton_of(terms) if automaton is None else automaton
            for term in held_in(automaton, value):
                owner.append(i)
                found.append(term)
        yield _rows_of(batch.column(3), owner, found)


def held_terms(texts: DataFrame, terms: DataFrame, key: str, form: str, most: int = MOST_CHARACTERS) -> DataFrame:
    """key and term of each of the terms (distinct, not empty) that a form contains.

    An Aho-Corasick automaton reads a form once, whatever the number of terms. Terms of up to `most` characters make one
    automaton, which every task of the scan builds; more are dealt to shards of about that size, and each text goes
    through each shard once: terms and texts meet by a shuffle, the texts in blocks, so neither side is gathered.
    """
    spark = ship(texts.sparkSession)
    shape = f"k {texts.schema[key].dataType.simpleString()}, term string"
    total = terms.agg(F.sum(F.length("term"))).first()[0] or 0
    if total <= most:
        words = spark.sparkContext.broadcast([r[0] for r in terms.select("term").collect()])  # `most` characters
        return texts.select(key, form).mapInArrow(_scan_with(words), shape).withColumnRenamed("k", key)
    shards = -(-total // most)
    blocks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = terms.select(F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"), F.lit(False).alias("is_text"), F.lit(None).cast(texts.schema[key].dataType).alias("k"), F.col("term").alias("value"))
    passed = texts.select(every(shards).alias("shard"), F.pmod(F.xxhash64(form), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("is_text"), F.col(key).alias("k"), F.col(form).alias("value"))
    ordered = dealt.unionByName(passed).repartition("shard", "block").sortWithinPartitions("shard", "block", "is_text")
    return ordered.mapInArrow(_scan_shards, shape).withColumnRenamed("k", key)


def contained(texts: DataFrame, terms: DataFrame, key: str, text: str = "text", most: int = MOST_CHARACTERS) -> DataFrame:
    """key and term of each of the normal terms (distinct, two characters or more) that a text's normal form contains."""
    forms = texts.select(key, F.coalesce(T.surface_norm(F.col(text)), F.lit("")).alias("form"))
    return held_terms(forms, terms, key, "form", most)


def term_containment(candidates: DataFrame, terms: DataFrame, candidate: str, reference: str, text: str = "text", also: tuple[str, ...] = (), most: int = MOST_CHARACTERS) -> DataFrame:
    """Pairs where a candidate's normal form contains the term's (two characters or more).

    `also` names further columns of the terms to carry.
    """
    wanted = written(terms.select(reference, *also, T.surface_norm(F.col("term")).alias("term")).where("length(term) >= 2").distinct())
    hits = contained(candidates, wanted.select("term").distinct(), candidate, text, most)
    return hits.join(wanted, "term").select(candidate, reference, "term", *also).distinct()


_TOKEN = re.compile("[가-힣A-Za-z0-9]+|[^\\t\\n\\x0b\\x0c\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]")


def located(rows: DataFrame, texts: DataFrame, key: str, pos: str, size: int = TOKENS, text: str = "text", name: str = "") -> DataFrame:
    """rows with the byte range and the slice's digest of the run of `size` tokens at place `pos` of their text.

    Only texts that rows name are read, each once, whatever the number of its places.
    """
    ship(rows.sparkSession)
    asked = rows.groupBy(key).agg(F.collect_set(pos).alias("places")).join(texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")), key)
    kind = texts.schema[key].dataType

    def run(batches):
        import hashlib

        for batch in batches:
            which, place, start, end, digest = [], [], [], [], []
            for i in range(batch.num_rows):
                value = batch.column(2)[i].as_py()
                spans = np.array([m.span() for m in _TOKEN.finditer(value)]).reshape(-1, 2)
                width = np.array([len(c.encode()) for c in value]) if not value.isascii() else np.ones(len(value), int)
                at = np.concatenate([[0], np.cumsum(width)])
                raw = value.encode()
                for p in batch.column(1)[i].as_py():
                    a, b = int(at[spans[p][0]]), int(at[spans[p + size - 1][1]])
                    which.append(i)
                    place.append(p)
                    start.append(a)
                    end.append(b)
                    digest.append(hashlib.sha256(raw[a:b]).hexdigest())
            keys = batch.column(0).take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(place, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(digest, pa.string())], names=["k", "p", "a", "b", "h"])

    found = asked.select(key, F.transform("places", lambda p: p.cast("int")).alias("places"), "t").mapInArrow(run, f"k {kind.simpleString()}, p int, a long, b long, h string")
    found = found.select(F.col("k").alias(key), F.col("p").alias(pos), F.col("a").alias(f"{name}start"), F.col("b").alias(f"{name}end"), F.col("h").alias(f"{name}slice_sha256"))
    return rows.join(found, [key, pos])


#: The names of the two methods of matching.
LONG, EXACT = "long-common-utf8-byte/v1", "exact-token-sequence/v1"


def leak_matches(artifacts: DataFrame, sources: DataFrame, artifact: str = "doc_id", source: str = "item_id", text: str = "text") -> DataFrame:
    """All matches of both methods with byte selectors on either side, the digests of their slices and an id."""
    columns = ["source_start", "source_end", "artifact_start", "artifact_end", "source_slice_sha256", "artifact_slice_sha256"]
    windows = window_overlap(artifacts, sources, artifact, source, text)
    own = sources.select(source, _bytes(text).alias("sb"))
    digest = F.sha2(F.substring("sb", F.col("source_offset") + 1, F.lit(WINDOW_BYTES)), 256)
    long = windows.join(own, source).select(
        source, artifact, F.lit(LONG).alias("method"), F.col("source_offset").cast("long").alias("source_start"), (F.col("source_offset") + WINDOW_BYTES).cast("long").alias("source_end"),
        F.col("artifact_offset").cast("long").alias("artifact_start"), (F.col("artifact_offset") + WINDOW_BYTES).cast("long").alias("artifact_end"), digest.alias("source_slice_sha256"), digest.alias("artifact_slice_sha256"),
    )
    tokens = token_overlap(artifacts, sources, artifact, source, text)
    tokens = located(located(tokens, sources, source, "source_pos", text=text, name="source_"), artifacts, artifact, "artifact_pos", text=text, name="artifact_")
    rows = long.unionByName(tokens.select(source, artifact, F.lit(EXACT).alias("method"), *columns))
    signature = F.concat_ws(":", F.when(F.col("method") == LONG, "long").otherwise("tokens"), F.col(source).cast("string"), F.col("source_start").cast("string"), F.col("artifact_start").cast("string"), F.col("source_slice_sha256"))
    return rows.withColumn("match_id", F.concat(F.lit("match-"), F.substring(F.sha2(signature, 256), 1, 24)))


def first_matches(matches: DataFrame, artifact: str, source: str = "item_id", most: int = MOST_MATCHES) -> DataFrame:
    """An artifact's first matches in the fixed order, as many as a receipt holds: by source, windows before tokens, places."""
    order = W.partitionBy(artifact).orderBy(source, F.desc("method"), "source_start", "artifact_start")
    return matches.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def leak_receipts(artifacts: DataFrame, matches: DataFrame, artifact: str = "doc_id", most: int = MOST_MATCHES) -> DataFrame:
    """Per artifact: match count up to the cap, whether the cap was reached, pass or quarantine."""
    counts = matches.groupBy(artifact).agg(F.least(F.count("*"), F.lit(most).cast("long")).alias("match_count"))
    out = artifacts.select(artifact).join(counts, artifact, "left").fillna(0, ["match_count"])
    return out.withColumns({"truncated": F.col("match_count") >= most, "status": F.when(F.col("match_count") == 0, "pass").otherwise("quarantine")})


def set_digests(rows: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """group and sha256 of the canonical JSON list of its rows, sorted by `order`: the same for any order of the table.

    A row is compact JSON with sorted keys, nulls kept. Rows come to a group's task sorted by Spark and are digested as
    they pass, so no set is held; a digest of a list is one task's.
    """
    ship(rows.sparkSession)
    body = T.sorted_json(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    ordered = rows.select(F.col(group).alias("k"), F.col(order).alias("_o"), body.alias("body")).repartition("k").sortWithinPartitions("k", "_o", "body").select("k", "body")
    kind = ordered.schema["k"].dataType.simpleString()

    def run(batches):
        import hashlib

        key, running, kinds = None, None, None

        def given(keys, digests):
            return pa.RecordBatch.from_arrays([pa.array(keys, kinds), pa.array(digests, pa.string())], names=["k", "sha256"])

        for batch in batches:
            kinds, keys, digests = batch.schema.field(0).type, [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if running is None or k != key:
                    if running is not None:
                        running.update(b"]")
                        keys.append(key)
                        digests.append(running.hexdigest())
                    key, running = k, hashlib.sha256(b"[")
                else:
                    running.update(b",")
                running.update(text.encode())
            yield given(keys, digests)
        if running is not None:
            running.update(b"]")
            yield given([key], [running.hexdigest()])

    return ordered.mapInArrow(run, f"k {kind}, sha256 string").withColumnRenamed("k", group)
