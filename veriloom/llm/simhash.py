"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A document's fingerprint has bit k set if more than half of its shingles' hashes have. Distinct fingerprints are points:

1. embedding: the bit counts of 32 segments of two bits, in unary code (00, 01, 11), so the Manhattan distance of two
   embeddings is the number of differing code bits. It never exceeds the number of differing fingerprint bits;
2. grid: the segments form 8 blocks of 4. Points within Manhattan distance 4 differ in at most 4 blocks, so they share
   the cell of at least 4: a point enters one cell for each of the 70 choices of 4 blocks, and the join is within cells.
   A choice tells 24 bits apart, so past 2^28 points the grid is finer (10, 12 or 16 blocks, all but 4 of them shared),
   and cells of unlike points stay small at any number of points;
3. cells are sorted streams. The pairs of a cell of up to `MOST_CELL` points are tested by the lower bound, then exactly;
   a pair counts in the first cell that it shares only;
4. the points of larger cells meet at midpoints: two points link exactly if some word lies within 2 bits of both, so each
   emits its 2,081 words around, and all points at a word link to the least of them: exact, and linear in the points.
   Cells that a sample (a 32nd of the points) shows to be large give their points to this way before the shuffle;
5. components by stars (components.py); the least id of each goes back to the documents, salted by fingerprint.

Statements. Null and empty texts and those of blanks only have the fingerprint zero and link like others. Fewer words
than a shingle make one shingle. Texts are worked through in pieces of 1 MB, at any length. Rows that repeat an id are
rows of their own; rows without id take part and get the least id of their component, null if none of it has an id.
An empty table gives no rows. Other columns, whatever their names, are not touched.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, ship, text_or_empty, utf8
from .components import components

WORDS, BITS, SEED = 4, 4, 42
PIECE, SALTS = 1 << 20, 32
#: Blocks of a grid, and how many points it serves: some 16 unlike ones share a cell then.
GRIDS = ((8, 1 << 28), (10, 1 << 32), (12, 1 << 36), (16, 1 << 62))
MOST_CELL = 256
#: A point in this many is sampled; a cell with so many of the sample is taken for a large one. Results don't depend on it.
SAMPLE, OFTEN = 32, 24
MOST_BROADCAST = 1_000_000
_BLANKS = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")


def grid_for(points: int) -> int:
    return next(blocks for blocks, most in GRIDS if points <= most)


@lru_cache(4)
def _grid(blocks: int) -> tuple[list[int], list[tuple[int, ...]], np.ndarray]:
    """Masks of the blocks, the choices of all but `BITS` of them, and for each set of blocks that agree the first choice in it."""
    cuts = [2 * round(32 * b / blocks) for b in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    choices = list(combinations(range(blocks), blocks - BITS))
    number = {c: k for k, c in enumerate(choices)}
    first = np.full(1 << blocks, -1, np.int16)
    for agree in range(1 << blocks):
        first[agree] = number.get(tuple(b for b in range(blocks) if agree >> b & 1)[: blocks - BITS], -1)
    return masks, choices, first


def _pieces(text: bytes, words: int):
    """Lists of the text's words, each list beginning with the last words of the one before; the last is marked."""
    rest, kept, at = b"", [], 0
    while True:
        piece, at = rest + text[at : at + PIECE], at + PIECE
        if at >= len(text):
            yield kept + piece.split(), True
            return
        end = max(piece.rfind(b) for b in _BLANKS) + 1
        found, rest = kept + piece[:end].split(), piece[end:]
        if len(found) >= words:
            yield found, False
            kept = found[len(found) - words + 1 :]
        else:
            kept = found


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Of UTF-8 bytes; A-Z count as a-z."""
    from xxhash import xxh64_intdigest

    total, counts, begun = 0, np.zeros(64, np.int64), False
    for found, last in _pieces(text.lower(), words):
        if not found or (last and begun and len(found) < words):
            continue
        begun = True
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        width = min(words, len(found))
        starts = np.concatenate(([0], ends[: len(found) - width]))
        stops = ends[width - 1 :] - 1
        hashes = np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts.tolist(), stops.tolist())), np.uint64, len(starts))
        for k in range(0, len(hashes), 1 << 14):
            bits = np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id and fp (the fingerprint's bits as a long) for each row of docs."""
    ship(docs.sparkSession)

    def make(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(t, words) for t in utf8(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(f"`{text_col}`").alias("text")).mapInArrow(make, "id long, fp long")


def _embedded(fp):
    """Counts of the two-bit segments in unary code, as a column."""
    low = F.lit(0x5555555555555555)
    shifted = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(shifted).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(shifted).bitwiseAND(low), 1))


def _embed(fp: np.ndarray) -> np.ndarray:
    low, one = np.uint64(0x5555555555555555), np.uint64(1)
    return ((fp | fp >> one) & low) | (((fp & fp >> one) & low) << one)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells(points: DataFrame, blocks: int) -> DataFrame:
    """points (fp) to a row for each cell they enter: choice, cell, fp."""
    parts, choices, _ = _grid(blocks)
    masks = [_signed(sum(parts[b] for b in c)) for c in choices]
    entered = points.select("fp", _embedded(F.col("fp")).alias("e"), F.posexplode(F.lit(masks)).alias("choice", "mask"))
    return entered.select("choice", F.col("e").bitwiseAND(F.col("mask")).alias("cell"), "fp")


def _sorted_runs(batches, names: list[str], most: int):
    """Sorted batches, cut where a run of equal leading columns ends: (columns, whether it is a part of a run of over `most`)."""
    carry, long = None, None
    for batch in batches:
        cols = [np.asarray(batch.column(c)) for c in names]
        if carry is not None:
            cols = [np.concatenate(x) for x in zip(carry, cols)]
        n = len(cols[0])
        if not n:
            continue
        differs = np.zeros(n, bool)
        for c in cols[:-1]:
            differs[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(differs)
        if long is not None:  # the run that was too long goes on
            end = 0 if any(c[0] != k for c, k in zip(cols, long)) else starts[0] if len(starts) else n
            if end:
                yield [c[:end] for c in cols], True
            if end == n:
                carry = None
                continue
            cols, starts, n, long = [c[end:] for c in cols], starts[starts > end] - end, n - end, None
        last = int(starts[-1]) if len(starts) else 0
        if last:
            yield [c[:last] for c in cols], False
        carry = [c[last:] for c in cols]
        if n - last > most:
            long = [c[last] for c in cols[:-1]]
            yield carry, True
            carry = None
    if carry is not None:
        yield carry, False


def _links(fp: np.ndarray, choice: np.ndarray, cell: np.ndarray, most: int, blocks: int):
    """Linked pairs within the cells of sorted columns, and the points of cells with over `most`."""
    new = np.concatenate(([True], (choice[1:] != choice[:-1]) | (cell[1:] != cell[:-1])))
    run = np.cumsum(new) - 1
    large = np.bincount(run)[run] > most
    hot, fp, choice, run = fp[large], fp[~large].view(np.uint64), choice[~large], run[~large]
    masks, _, first = _grid(blocks)
    e, pairs = _embed(fp), []
    for off in range(1, most):
        i = np.flatnonzero(run[off:] == run[:-off])
        if not len(i):
            break
        x = e[i] ^ e[i + off]
        i, x = i[near := np.bitwise_count(x) <= BITS], x[near]  # Manhattan distance, the lower bound
        agree = sum(((x & np.uint64(m)) == 0).astype(np.int64) << b for b, m in enumerate(masks))
        i = i[first[agree] == choice[i]]
        pairs.append(np.stack((i, i + off))[:, np.bitwise_count(fp[i] ^ fp[i + off]) <= BITS])
    found = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    return fp[found[0]].view(np.int64), fp[found[1]].view(np.int64), hot


def links(points: DataFrame, most: int = MOST_CELL, often: int = OFTEN, blocks: int | None = None) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (a written table) whose components are those of all links."""
    ship(points.sparkSession)
    blocks = blocks or grid_for(points.count())
    entered = cells(points, blocks)
    sampled = cells(points.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0), blocks)
    large = cut(sampled.groupBy("choice", "cell").count().where(F.col("count") >= often).select("choice", "cell"))
    n, dense = large.count(), None
    if n:
        known = F.broadcast(large) if n <= MOST_BROADCAST else large
        dense = entered.join(known, ["choice", "cell"], "left_semi").select("fp")
        entered = entered.join(known, ["choice", "cell"], "left_anti")

    def pairs(batches):
        for (choice, cell, fp), long in _sorted_runs(batches, ["choice", "cell", "fp"], most):
            u, v, hot = (fp[:0], fp[:0], fp) if long else _links(fp, choice, cell, most, blocks)
            away = pa.array(np.concatenate((v, hot)), mask=np.repeat([False, True], (len(v), len(hot))))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((u, hot))), away], names=["u", "v"])

    found = cut(entered.repartition("choice", "cell").sortWithinPartitions("choice", "cell").mapInArrow(pairs, "u long, v long"))
    hot = found.where("v is null").select(F.col("u").alias("fp"))
    hot = cut((hot.union(dense) if dense is not None else hot).distinct())
    edges = found.where("v is not null")
    return edges if hot.isEmpty() else edges.unionByName(_midpoint_links(hot))


def _around() -> np.ndarray:
    """All words of up to two bits."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    return np.concatenate((np.zeros(1, np.uint64), one, one[i] | one[j]))


def _midpoint_links(points: DataFrame) -> DataFrame:
    def words(batches):
        near = _around()
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            for k in range(0, len(fp), 32):
                some = fp[k : k + 32]
                yield pa.RecordBatch.from_arrays([pa.array((some[:, None] ^ near).ravel().view(np.int64)), pa.array(np.repeat(some, len(near)).view(np.int64))], names=["word", "fp"])

    def stars(batches):
        word = least = None
        for batch in batches:
            w, fp = np.asarray(batch.column("word")), np.asarray(batch.column("fp"))
            if not len(w):
                continue
            first = np.concatenate(([word is None or w[0] != word], w[1:] != w[:-1]))
            at = np.maximum.accumulate(np.where(first, np.arange(len(w)), -1))
            to = np.where(at >= 0, fp[at], least if least is not None else 0)
            word, least = w[-1], to[-1]
            pairs = np.unique(np.stack((fp, to), 1)[fp != to], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])

    met = points.mapInArrow(words, "word long, fp long")
    return met.repartition("word").sortWithinPartitions("word", "fp").mapInArrow(stars, "u long, v long").distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row a row of docs: id, fp, component_id (the least id that links of up to four differing bits reach)."""
    rows = cut(fingerprints(docs, id_col, text_col, words).withColumn("salt", F.pmod(F.xxhash64(F.coalesce("id", F.monotonically_increasing_id())), F.lit(SALTS))))
    salted = rows.groupBy("fp", "salt").agg(F.min("id").alias("id"))  # a hot fingerprint is salted
    points = cut(salted.groupBy("fp").agg(F.min("id").alias("id"), F.collect_set("salt").alias("salts")))
    edges = links(points.select("fp"))
    nodes = components(edges)
    rooted = points.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.select("root", "fp", "salts").join(least, "root").select("fp", F.explode("salts").alias("salt"), "component_id")
    found = rows.join(named, ["fp", "salt"]).select("id", "fp", "component_id")
    discard(edges)
    return found


def hex_digits(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
