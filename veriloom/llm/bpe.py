"""Byte-level BPE by a hierarchical-bitmap rank queue.

Merging a piece keeps its parts in a linked list. Each merge rank has a bucket of list positions, and a
bitmap of three levels of 64-bit words says which buckets hold entries; finding the first set bit of each
level gives the lowest rank in constant time. Entries are never removed when a merge invalidates them: an
entry whose position no longer has the bucket's rank is stale and skipped. A piece of n bytes costs
O(n log n) at most (the logarithm is the bucket's order by position), which suits very long pieces.

Null texts count as empty; an empty text has no ids. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, utf8

#: Fixed value: the characters with the Unicode property White_Space, which \s means in the pattern.
WHITE_SPACE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces up to so many bytes are remembered, and so many of them at most in two generations.
CACHED_BYTES, CACHED_PIECES = 48, 800_000
BIT = [1 << i for i in range(64)]
NO_RANK = 1 << 18


class RankQueue:
    """Buckets of list positions by merge rank under a bitmap of three levels (up to 2**18 ranks).

    Between two pieces every bucket is empty, so a queue is reused without clearing it. `Codec.merge` works on
    the fields directly: a method call for each entry would cost as much as the entry itself.
    """

    def __init__(self, ranks: int):
        if ranks > 1 << 18:
            raise ValueError("three levels hold 2**18 ranks")
        self.leaves = [0] * (ranks + 63 >> 6)
        self.middle = [0] * (ranks + 4095 >> 12)
        self.buckets: dict[int, list[int]] = {}


class _Pieces(dict):
    """From a piece to its ids as little-endian bytes; unknown pieces are merged.

    When half of the pieces are full they become the older generation, from which pieces still in use come back.
    """

    def __init__(self, codec: Codec, most: int):
        self.codec, self.half, self.older = codec, most // 2, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode()
            ids = np.array(self.codec.merge(raw), "<u4").tobytes()
            if len(raw) > CACHED_BYTES:
                return ids
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Codec:
    """Encodes and decodes texts by a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int = CACHED_PIECES):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        # \S and \s as the rank files mean them, by the Unicode property
        spelled = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]")
        self.pieces_of = regex.compile(spelled).findall
        # The same for text of ASCII characters, where the two properties are short classes that a faster matcher knows.
        ascii_only = spelled.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(WHITE_SPACE, r"\x09-\x0d\x20")
        ascii_only = ascii_only.replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+")
        self.ascii_pieces_of = self.pieces_of if "\\p" in ascii_only else re.compile(ascii_only, re.ASCII).findall
        self.queue = RankQueue(max(self.tokens, default=0) + 1)
        self.pieces = _Pieces(self, cached)

    @classmethod
    def parse(cls, table: bytes, pattern: str, cached: int = CACHED_PIECES) -> Codec:
        """table: lines of a token in base64 and its rank."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, table.splitlines()) if a}, pattern, cached)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        get = self.ranks.get
        if (whole := get(piece)) is not None:
            return [whole]
        n, ranks = len(piece), self.ranks
        leaves, middle, buckets = self.queue.leaves, self.queue.middle, self.queue.buckets
        top = 0
        after, before = list(range(1, n + 2)), list(range(-1, n))
        # rank_at[i]: of the part that starts at i with the one after it. One more at the end stands for "none" on
        # both sides: rank_at[n] after the last part, rank_at[-1] before the first.
        rank_at = [get(piece[i : i + 2], NO_RANK) for i in range(n - 1)] + [NO_RANK, NO_RANK]
        fresh, waiting = range(n - 1), {}
        while True:
            for i in fresh:
                # Only a pair that neither neighbour precedes can be merged next; the others wait until that changes.
                rank = rank_at[i]
                if rank < rank_at[before[i]] and rank <= rank_at[after[i]] and waiting.get(i) != rank:
                    waiting[i] = rank
                    if rank in buckets:
                        heappush(buckets[rank], i)
                    else:
                        buckets[rank] = [i]
                        leaf = rank >> 6
                        leaves[leaf] |= BIT[rank & 63]
                        middle[rank >> 12] |= BIT[leaf & 63]
                        top |= BIT[rank >> 12]
            if not top:
                break
            block = (top & -top).bit_length() - 1
            word = middle[block]
            leaf = block << 6 | (word & -word).bit_length() - 1
            word = leaves[leaf]
            rank = leaf << 6 | (word & -word).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                leaves[leaf] = word = word & word - 1
                if not word:
                    middle[block] = word = middle[block] & middle[block] - 1
                    if not word:
                        top &= top - 1
            if rank_at[i] != rank:
                fresh = ()
                continue  # stale
            gone = after[i]
            end = after[i] = after[gone]
            rank_at[gone] = NO_RANK
            left = before[i]
            if end < n:
                before[end] = i
                rank_at[i] = get(piece[i : after[end]], NO_RANK)
                fresh = [end, i]
            else:
                rank_at[i] = NO_RANK
                fresh = []
            if left >= 0:
                rank_at[left] = get(piece[left:end], NO_RANK)
                fresh += [left, before[left]] if left else [left]
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.ascii_pieces_of(text) if text.isascii() else self.pieces_of(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple[bytes, str, int], Codec] = {}


def codec_of(table: bytes, pattern: str, cached: int = CACHED_PIECES) -> Codec:
    """One codec for each table, pattern and size of its cache in a worker."""
    key = (hashlib.sha256(table).digest(), pattern, cached)
    if key not in _codecs:
        _codecs[key] = Codec.parse(table, pattern, cached)
    return _codecs[key]


def _table(vocabulary: str) -> bytes:
    with open(vocabulary, "rb") as file:  # on the driver; executors get its bytes, about 1 MB
        return file.read()


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the ids of its text, their bytes decoded again (the real outputs of encoding and decoding)."""
    return _coded(docs, vocabulary, pattern, id_col, text_col, False, CACHED_PIECES)


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", cached: int = CACHED_PIECES) -> DataFrame:
    """Per row: id, n_tokens, and the SHA-256 of ids and of decoded bytes. cached: pieces that a worker remembers."""
    return _coded(docs, vocabulary, pattern, id_col, text_col, True, cached)


def _coded(docs, vocabulary, pattern, id_col, text_col, digests: bool, cached: int) -> DataFrame:
    spark = ship(docs.sparkSession)
    table = spark.sparkContext.broadcast(_table(vocabulary))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "id long, ids array<int>, decoded binary"

    def run(batches):
        codec = codec_of(table.value, pattern, cached)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for name, raw in zip(batch.column(0), utf8(batch.column(1))):
                ids = codec.encode_bytes(raw.decode("utf-8", "replace"))
                numbers = np.frombuffer(ids, "<u4").tolist()
                decoded = codec.decode(numbers)
                if digests:
                    rows.append((name.as_py(), len(numbers), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                else:
                    rows.append((name.as_py(), numbers, decoded))
                    held += len(ids)
                if held > 8 << 20:
                    yield _batch(rows, digests)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, digests)
        if cached < CACHED_PIECES:  # where memory is short an idle worker holds the younger generation only
            codec.pieces.older = {}

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _batch(rows: list[tuple], digests: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] if digests else [pa.int64(), pa.list_(pa.int32()), pa.binary()]
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["id", "ids", "decoded"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
