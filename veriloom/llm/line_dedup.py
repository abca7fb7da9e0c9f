"""Line deduplication by content-defined chunks of lines, completed at their edges.

Each line has a hash; a rolling hash over the last `WINDOW` line hashes ends a chunk where it is divisible by `EVERY`.
Boundaries so depend on nearby lines alone and come back after an insertion. Of the chunks of two or more lines with
other than blank characters that occur more than once in the corpus, the first occurrence (smallest id, then first
line) stays, and the others' lines are removed.

Whole chunks miss a repeated passage's head, its tail, and all of it where no whole chunk lies inside.
`remove_repeated_runs` therefore also looks at pairs, two successive lines with other than blank characters and the
blank lines between them, but for those inside a chunk that goes: a run with two or more such lines is made of
overlapping pairs, so passages of any length go whole. What covers what is as in suffix_dedup.py: a line goes if a chunk or pair
that covers it also starts earlier in the corpus; of each line its first occurrence stays. Blank lines around a run stay.
`remove_repeated_chunks` takes chunks alone.

1. Each document's chunks and pairs, as hashes and line numbers (narrow), are written down and counted by hash.
2. Of documents with a repeated hash the texts are dealt; the bytes behind repeated hashes meet by (hash, bytes): the
   bytes are a grouping key, first per salt, then globally, so only identical bytes count as repeated.
3. The removed line ranges go back to the texts that lose some.

What is hot, a chunk in many documents, is summed on its scan task and spread over `SALTS` keys.

Rows without id come last; rows that share an id go by a hash of their text; rows that repeat an id and a text are
judged as one. Null texts count as empty; very long ones are cut into lines whole. An empty table gives an empty result;
other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LAST_ID, cut, discard, ship, tasks, text_or_empty, utf8
from .key_filter import key_filter

WINDOW, EVERY, SALTS = 2, 3, 32


def chunks_of(lines: list[bytes], window: int = WINDOW, every: int = EVERY) -> list[tuple[int, int]]:
    """First line and line after the last of each chunk."""
    if not lines:
        return []
    h = np.array([xxhash.xxh3_64_intdigest(x) for x in lines], np.uint64)
    rolling = h.copy()
    for i in range(1, window):
        rolling[i:] += h[:-i] * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
    rolling ^= rolling >> np.uint64(32)
    ends = (np.flatnonzero(rolling % np.uint64(every) == 0) + 1).tolist()
    if not ends or ends[-1] != len(lines):
        ends.append(len(lines))
    return list(zip([0, *ends], ends))


def digest_of(content: bytes) -> tuple[int, int]:
    both = xxhash.xxh3_128_digest(content)
    return tuple(np.frombuffer(both, "<i8").tolist())


def whole_chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """The chunks of two or more lines with other than blank characters."""
    return [(a, b) for a, b in chunks_of(lines) if b - a > 1 and sum(1 for x in lines[a:b] if x.strip()) > 1]


def pairs_of(lines: list[bytes]) -> list[tuple[int, int]]:
    """First line and line after the last of each two successive lines with other than blank characters."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    return [(a, b + 1) for a, b in zip(full, full[1:])]


def chunk_spans(lines: list[bytes]) -> list[tuple[int, int, int, int]]:
    """First line, line after the last, kind (0: chunk) and -1 of each whole chunk."""
    return [(a, b, 0, -1) for a, b in whole_chunks(lines)]


def all_spans(lines: list[bytes]) -> list[tuple[int, int, int, int]]:
    """Whole chunks, and pairs (kind 1) with the first line of the whole chunk that they lie in, else -1."""
    chunks = whole_chunks(lines)
    owner = [-1] * len(lines)
    for n, (a, b) in enumerate(chunks):
        owner[a:b] = [n] * (b - a)
    return [(a, b, 0, -1) for a, b in chunks] + [(a, b, 1, chunks[owner[a]][0] if owner[a] >= 0 and owner[a] == owner[b - 1] else -1) for a, b in pairs_of(lines)]


def runs_of(drop: set[int]) -> int:
    """How many runs of neighbouring lines there are."""
    return sum(1 for i in drop if i - 1 not in drop)


_SPANS = "key long, tie long, first int, after int, kind int, inside int, h long, h2 long"
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]


def _spans(rows: DataFrame, digest, spans_of) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            keys, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, tie, raw in zip(keys, ties, utf8(batch.column(2))):
                lines = raw.split(b"\n")
                for a, b, kind, inside in spans_of(lines):
                    h, h2 = digest(b"\n".join(lines[a:b]))
                    out.append((key, tie, a, b, kind, inside, h, h2 ^ kind))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], names=[x.split()[0] for x in _SPANS.split(", ")])
                    out = []
            columns = list(zip(*out)) or [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=[x.split()[0] for x in _SPANS.split(", ")])

    return rows.select("key", "tie", "text").mapInArrow(run, _SPANS)


def _contents(asked: DataFrame, all_pairs: bool) -> DataFrame:
    """asked: key, tie, text, spans. A row for each span, with its bytes; pairs inside chunks that go only with all_pairs."""

    def run(batches):
        names = ["key", "tie", "first", "after", "h", "h2", "salt", "content"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            keys, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for i, raw in enumerate(utf8(batch.column(2))):
                lines, spans = raw.split(b"\n"), batch.column(3)[i].as_py()
                going = {c["first"] for c in spans if c["kind"] == 0 and c["later"]}
                for c in spans:
                    if all_pairs or c["inside"] not in going:
                        out.append((keys[i], ties[i], c["first"], c["after"], c["h"], c["h2"], c["salt"], b"\n".join(lines[c["first"] : c["after"]])))
                if len(out) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return asked.select("key", "tie", "text", "spans").mapInArrow(run, "key long, tie long, first int, after int, h long, h2 long, salt int, content binary")


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=digest_of) -> DataFrame:
    """Per row of docs: id, kept (text), n_lines, n_removed (lines), n_chunks (removed)."""
    return _removed(docs, id_col, text_col, digest, chunk_spans, lambda spans, drop: len(spans))


def remove_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=digest_of) -> DataFrame:
    """Per row of docs: id, kept (text), n_lines, n_removed (lines), n_chunks (maximal runs removed)."""
    return _removed(docs, id_col, text_col, digest, all_spans, lambda spans, drop: runs_of(drop))


def _removed(docs: DataFrame, id_col: str, text_col: str, digest, spans_of, count) -> DataFrame:
    spark = ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("key"), text_or_empty(text_col).alias("text"), F.col(id_col).isNull().alias("nameless"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    place = F.struct("key", "tie", "first")
    salt = F.pmod(F.xxhash64("key", "tie", "first"), F.lit(SALTS)).cast("int")
    spans = cut(_spans(rows, digest, spans_of).withColumn("salt", salt))
    # Rows that repeat an id and a text give the same places, so the number of places decides.
    repeated = spans.groupBy("h", "h2").agg(F.min(place).alias("least"), F.max(place).alias("most"), F.collect_set("salt").alias("salts")).where("least <> most")
    marks = cut(spans.join(repeated.select("h", "h2", "least", F.explode("salts").alias("salt")), ["h", "h2", "salt"]).withColumn("later", place != F.col("least")).drop("least").dropDuplicates(["key", "tie", "first", "after", "kind"]))
    discard(spans)
    asks = marks.groupBy("key", "tie").agg(F.collect_list(F.struct("first", "after", "kind", "inside", "later", "h", "h2", "salt")).alias("spans"))
    concerned = key_filter(marks, F.col("key"))
    texts = rows.where(concerned(F.col("key"))).select("key", "tie", "text").dropDuplicates(["key", "tie"])
    asked = asks.join(texts, ["key", "tie"])

    def whole(contents: DataFrame) -> DataFrame:
        salted = contents.groupBy("h", "h2", "content", "salt").agg(F.min(place).alias("stays"))
        met = salted.repartition("h", "h2").groupBy("h", "h2", "content").agg(F.min("stays").alias("stays"), F.collect_set("salt").alias("salts"))
        return met.withColumn("sharing", F.count("*").over(W.partitionBy("h", "h2")))

    narrow = cut(whole(_contents(asked, False)).select("h", "h2", "stays", "sharing"))
    if narrow.where("sharing > 1").isEmpty():
        salts = repeated_salts(marks)
        found = marks.join(narrow.join(salts, ["h", "h2"]).select("h", "h2", F.explode("salts").alias("salt"), "stays"), ["h", "h2", "salt"])
    else:  # colliding hashes: the bytes of every span decide
        contents = _contents(asked, True)
        found = contents.join(whole(contents).select("h", "h2", "content", F.explode("salts").alias("salt"), "stays"), ["h", "h2", "content", "salt"])
    gone = cut(found.where(place != F.col("stays")).groupBy("key", "tie").agg(F.collect_list(F.struct("first", "after")).alias("gone")))
    discard(marks, narrow)
    touched = key_filter(gone, F.col("key"))
    both = rows.where(touched(F.col("key"))).join(gone, ["key", "tie"], "left").select("key", "nameless", "text", "gone")
    whole_rows = rows.where(~touched(F.col("key"))).select("key", "nameless", "text", F.lit(None).cast("array<struct<first:int,after:int>>").alias("gone"))

    def run(batches):
        for batch in batches:
            out = []
            for raw, spans in zip(utf8(batch.column(2)), batch.column(3)):
                lines, spans = raw.split(b"\n"), spans.as_py() or []
                drop = {i for s in spans for i in range(s["first"], s["after"])}
                kept = b"\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else raw
                out.append((kept, len(lines), len(drop), count(spans, drop)))
            for i in range(0, len(out), 1000):
                kept, n, removed, spans = zip(*out[i : i + 1000])
                arrays = [batch.column(0).slice(i, 1000), batch.column(1).slice(i, 1000), pa.array(kept, pa.binary()).cast(pa.string()), *[pa.array(c, pa.int64()) for c in (n, removed, spans)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "nameless", "kept", "n_lines", "n_removed", "n_chunks"])

    out = both.unionByName(whole_rows).mapInArrow(run, "key long, nameless boolean, kept string, n_lines long, n_removed long, n_chunks long")
    return out.select(F.when(~F.col("nameless"), F.col("key")).alias("id"), "kept", "n_lines", "n_removed", "n_chunks")


def repeated_salts(marks: DataFrame) -> DataFrame:
    """The salts on which each hash lies."""
    return marks.groupBy("h", "h2").agg(F.collect_set("salt").alias("salts"))
