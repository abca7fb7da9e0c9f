"""Suffix-array deduplication: bytes covered by a string of `LENGTH` bytes that also starts earlier.

A window is LENGTH bytes within one document. Sorting the windows of a whole corpus as suffixes would move
LENGTH bytes for each byte of text, so windows are gathered around anchors first: the anchor of a window is the
k-gram in it with the least hash (k = 48, the leftmost of equals). Equal windows have equal anchors at the same
place in them, and the windows of an anchor are consecutive: they make a segment.

1. Each scan task finds its segments. Where two have equal hashes their bytes are compared, run by run of
   neighbouring segments, and the first stays; the others are wholly covered.
2. Segments meet by anchor. Where hashes are equal again (a 64-bit hash, besides the anchor's), the later one claims to be
   covered by the first; anchors with one segment are done. Anchors with different segments need a closer look.
3. Bytes are fetched: for each claimed run those of both sides, which must be one and the same content; and for anchors
   with different segments all their windows, which are sorted as suffixes by deep-shallow sorting (suffix_sort.py). Of
   a class of equal windows the first stays, the others are covered. Should any claim fail, which takes two colliding
   64-bit hashes, no claim counts, and the sort decides everything that shares an anchor.
4. A document's covered spans are merged and its remaining bytes concatenated.

So nothing is removed but by comparison of bytes. Records travel packed, a blob for each bucket of anchors, so a
shuffle moves few rows, and are worked on bucket by bucket. What many documents share is reduced to one record for
each scan task before it moves. Of the texts only those move that a claim, a sort or a removal concerns.

"Earlier" is a smaller id, or an earlier start in the same document; rows without id come last; rows that
share an id go by a hash of their text, and rows that repeat an id and a text are judged as one document. Null texts
count as empty; texts under LENGTH bytes lose nothing; very long ones are cut into blocks that share LENGTH - 1 bytes. An
empty table gives an empty result; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, cut, discard, ship, tasks, text_or_empty, utf8
from .key_filter import key_filter
from .suffix_sort import equal_classes

LENGTH, GRAM = 100, 48
_BLOCK = 1 << 20
#: Anchors go to so many buckets at least; the marks of so many buckets of a task, or of fewer with so many marks, are gathered by document.
LEAST_BUCKETS, GATHERED, MOST_MARKS = 256, 12, 2_000_000
#: Text that a scan task looks at before it passes its records on, in bytes.
_FLUSH = 24 << 20
_rng = np.random.default_rng(3)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1 << 60, 1 << 62)) | 1
_SEGMENT = np.dtype([("anchor", "<u8"), ("segment", "<u8"), ("doc", "<u4"), ("start", "<u4"), ("windows", "<u4")])
_SPAN = np.dtype([("start", "<u4"), ("end", "<u4")])
_ASK = np.dtype([("start", "<u4"), ("windows", "<u4"), ("anchor", "<u8")])
_DOC = np.dtype([("key", "<i8"), ("tie", "<i8")])
_CLAIM = np.dtype([("start", "<u4"), ("end", "<u4"), ("key", "<i8"), ("tie", "<i8"), ("at", "<u4")])
_ROW = "bucket int, key long, tie long, spans binary, asks binary, claims binary, docs binary, records binary"
_PIECE = "start long, length long, a_key long, a_tie long, a_start long"
#: Bytes of a claimed run that are compared at once, in steps of its first occurrence's place.
_STEP = 1 << 20
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(_BLOCK, base & ((1 << 64) - 1), np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def segments(buffer: np.ndarray, ends: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """buffer: up to 2**20 bytes of documents, which end at `ends`. Anchor hash, segment hash (of so many bits), first window, windows of each segment."""
    n, width = len(buffer), LENGTH - GRAM + 1
    none = np.zeros(0, np.uint64)
    if n < LENGTH:
        return none, none, none.astype(np.int64), none.astype(np.int64)
    power, back = _power_tables()
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buffer] * power[:n], out=sums[1:])
    gram = _mixed((sums[GRAM:] - sums[:-GRAM]) * back[: n + 1 - GRAM])
    low = np.uint64(_BLOCK - 1)
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    reach = 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: reach - width], least[width - reach :])
    anchor = (least & low).astype(np.int64)  # of each window
    valid = np.ones(len(anchor), bool)
    for end in ends:
        valid[max(0, end - LENGTH + 1) : end] = False
    start = np.flatnonzero(valid)
    if not len(start):
        return none, none, none.astype(np.int64), none.astype(np.int64)
    anchor = anchor[start]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
    windows = np.diff(np.append(new, len(start)))
    first, anchor = start[new], anchor[new]
    whole = (sums[first + windows - 1 + LENGTH] - sums[first]) * back[first]
    offset = (anchor - first).astype(np.uint64) << np.uint64(32) | windows.astype(np.uint64)
    return gram[anchor], _mixed(whole + _mixed(offset)) >> np.uint64(64 - bits), first, windows


def _first_of_equals(r: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over r: the number of the first of its segment (its own, or -1 where it counts as that one); whether its anchor has unlike or several segments.

    Records of one document and start, from rows that repeat an id and a text, count once: the others have -1.
    """
    rank = np.unique(docs, return_inverse=True)[1]
    first = np.arange(len(r))
    unlike, several_of = np.zeros(len(r), bool), np.zeros(len(r), bool)
    by = np.argsort(r["anchor"], kind="stable")
    a = r["anchor"][by]
    twin = np.r_[False, a[1:] == a[:-1]] if len(a) else np.zeros(0, bool)
    several = by[twin | np.r_[twin[1:], False]] if len(a) else by
    s = r[several]
    order = np.lexsort((s["start"], rank[s["doc"]], s["segment"], s["anchor"]))
    several, s = several[order], s[order]
    if len(s):
        same_anchor = np.r_[False, s["anchor"][1:] == s["anchor"][:-1]]
        same = same_anchor & np.r_[False, s["segment"][1:] == s["segment"][:-1]]
        once_more = same & np.r_[False, (rank[s["doc"]][1:] == rank[s["doc"]][:-1]) & (s["start"][1:] == s["start"][:-1])]
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(s))))
        first[several] = several[head]
        first[several[once_more]] = -1
        group = np.cumsum(~same_anchor) - 1
        unlike[several[~same]] = (np.bincount(group, ~same) > 1)[group][~same]
        several_of[several] = (np.bincount(group, ~once_more) > 1)[group] & ~once_more
    return first, unlike, several_of


def _runs(r: np.ndarray, docs: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Records `at` and the `first` ones of their segments as runs of neighbours at one distance.

    Order of `at` by run, the run's number for each, and of each run: document, start, end, first's document and start.
    """
    a, f = r[at], r[first]
    distance = a["start"].astype(np.int64) - f["start"]
    order = np.lexsort((a["start"], distance, f["doc"], a["doc"]))
    a, f, distance = a[order], f[order], distance[order]
    end = a["start"].astype(np.int64) + a["windows"] + LENGTH - 1
    new = np.ones(len(a), bool)
    new[1:] = (a["doc"][1:] != a["doc"][:-1]) | (f["doc"][1:] != f["doc"][:-1]) | (distance[1:] != distance[:-1]) | (a["start"][1:] > end[:-1])
    begins = np.flatnonzero(new)
    last = np.append(begins[1:], len(a)) - 1
    return order, np.cumsum(new) - 1, a["doc"][begins], a["start"][begins].astype(np.int64), end[last] if len(a) else end, f["doc"][begins], f["start"][begins].astype(np.int64)


_NAMES = ["bucket", "key", "tie", "spans", "asks", "claims", "docs", "records"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=_NAMES)


def _by_document(docs: np.ndarray, **lists: tuple[np.ndarray, np.ndarray]) -> list[tuple]:
    """Rows (key, tie, spans, asks, claims) out of (document of each item, items)."""
    rows: dict[int, dict] = {}
    for name, (doc, items) in lists.items():
        order = np.argsort(doc, kind="stable")
        doc, items = doc[order], items[order]
        begins = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else []
        for a, b in zip(begins, np.append(begins[1:], len(doc))):
            rows.setdefault(int(doc[a]), {})[name] = items[a:b].tobytes()
    return [(int(docs["key"][d]), int(docs["tie"][d]), x.get("spans"), x.get("asks"), x.get("claims")) for d, x in rows.items()]


def _items(kind: np.dtype, **columns) -> np.ndarray:
    out = np.empty(len(next(iter(columns.values()))), kind)
    for name, column in columns.items():
        out[name] = column
    return out


class _Scan:
    """Gathers the segments of documents until they are passed on."""

    def __init__(self, buckets: int, bits: int):
        self.buckets, self.bits = buckets, bits
        self.clear()

    def clear(self):
        self.docs, self.texts, self.records, self.bytes, self.block, self.held = [], [], [], 0, [], 0

    def add(self, key: int, tie: int, raw: bytes) -> None:
        number = len(self.docs)
        self.docs.append((key, tie))
        self.texts.append(raw)
        self.bytes += len(raw)
        step = _BLOCK - LENGTH + 1
        for at in range(0, max(1, len(raw) - LENGTH + 1), step):  # blocks of a very long text share LENGTH - 1 bytes
            part = raw[at : at + _BLOCK]
            if self.held + len(part) > _BLOCK:
                self.close()
            self.block.append((number, at, part))
            self.held += len(part)

    def close(self) -> None:
        if self.block:
            buffer = np.frombuffer(b"".join(p for _, _, p in self.block), np.uint8)
            ends = np.cumsum([len(p) for _, _, p in self.block])
            anchor, segment, first, windows = segments(buffer, ends, self.bits)
            which = np.searchsorted(ends, first, side="right")
            r = np.empty(len(first), _SEGMENT)
            r["anchor"], r["segment"], r["windows"] = anchor, segment, windows
            r["doc"] = np.array([d for d, _, _ in self.block])[which]
            r["start"] = first - np.r_[0, ends[:-1]][which] + np.array([a for _, a, _ in self.block])[which]
            self.records.append(r)
        self.block, self.held = [], 0

    def flush(self):
        self.close()
        if not self.docs:
            return
        docs, texts = np.array(self.docs, _DOC), self.texts
        r = np.concatenate(self.records) if self.records else np.empty(0, _SEGMENT)
        self.clear()
        first, _, _ = _first_of_equals(r, docs)
        keep = first == np.arange(len(r))
        later = np.flatnonzero(~keep & (first >= 0))
        order, run, doc, start, end, f_doc, f_start = _runs(r, docs, later, first[later])
        same = np.array([texts[d][s:e] == texts[f][g : g + e - s] for d, s, e, f, g in zip(doc.tolist(), start.tolist(), end.tolist(), f_doc.tolist(), f_start.tolist())], bool)
        keep[later[order[~same[run]]]] = True  # colliding hashes: another segment after all
        spans = _items(_SPAN, start=start[same], end=end[same])
        for key, tie, s, _, _ in _by_document(docs, spans=(doc[same], spans)):
            yield (key * 0x9E3779B97F4A7C15 >> 40) % self.buckets, key, tie, s, None, None, None, None
        r = r[keep]
        bucket = (r["anchor"] >> np.uint64(32)) % np.uint64(self.buckets)
        order = np.argsort(bucket.astype(np.uint32), kind="stable")
        r, bucket = r[order], bucket[order]
        begins = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(r) else []
        for a, b in zip(begins, np.append(begins[1:], len(r))):
            used, local = np.unique(r["doc"][a:b], return_inverse=True)
            part = r[a:b].copy()
            part["doc"] = local
            yield int(bucket[a]), None, None, None, None, None, docs[used].tobytes(), _packed(part)


def _packed(r: np.ndarray) -> bytes:
    """Records by column: the hashes as they are, the small numbers compressed."""
    small = np.diff(r["doc"], prepend=np.uint32(0)).tobytes() + r["start"].tobytes() + r["windows"].astype(np.uint8).tobytes()
    return np.int64(len(r)).tobytes() + r["anchor"].tobytes() + r["segment"].tobytes() + pa.compress(small, "zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    r = np.empty(n, _SEGMENT)
    r["anchor"], r["segment"] = np.frombuffer(raw, "<u8", n, 8), np.frombuffer(raw, "<u8", n, 8 + 8 * n)
    small = pa.decompress(raw[8 + 16 * n :], decompressed_size=9 * n, codec="zstd", asbytes=True)
    r["doc"] = np.cumsum(np.frombuffer(small, "<u4", n), dtype=np.uint32)
    r["start"], r["windows"] = np.frombuffer(small, "<u4", n, 4 * n), np.frombuffer(small, np.uint8, n, 8 * n)
    return r


def _columns(names=("key", "tie", "text")):
    return [F.col(n) for n in names]


def _found_in_scan(rows: DataFrame, buckets: int, bits: int) -> DataFrame:
    def run(batches):
        scan = _Scan(buckets, bits)
        for batch in batches:
            keys, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, tie, raw in zip(keys, ties, utf8(batch.column(2))):
                scan.add(key, tie, raw)
                if scan.bytes >= _FLUSH:
                    yield _batch(list(scan.flush()))
        yield _batch(list(scan.flush()))

    return rows.select(*_columns()).mapInArrow(run, _ROW)


def _by_bucket(batches, bucket: int, *columns: int):
    """Lists of the column values of each bucket's rows with records, one bucket at a time; batches come sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for i, name in enumerate(batch.column(bucket).to_pylist()):
            if name != now and held:
                yield held
                held = []
            now = name
            if batch.column(columns[-1])[i].is_valid:
                held.append(tuple(batch.column(c)[i].as_py() for c in columns))
    if held:
        yield held


def _merged(found: DataFrame, parts: int, sort_all: bool) -> DataFrame:
    """Segments of all scan tasks, met by anchor: rows of a document's spans, asks and claims; with sort_all there are no claims."""

    def run(batches):
        def passing():
            for batch in batches:
                whole = pc.is_null(batch.column(7))
                if pc.any(whole).as_py():
                    done.append(batch.filter(whole))
                yield batch

        def out():
            """The marks of some buckets together, a row for each document."""
            docs, number = np.unique(np.concatenate([d for d, *_ in gathered]), return_inverse=True)
            at, a_doc, c_doc = 0, [], []
            for d, asked, _, claiming, _ in gathered:
                own = number[at : at + len(d)]
                a_doc.append(own[asked])
                c_doc.append(own[claiming])
                at += len(d)
            join = lambda i: np.concatenate([g[i] for g in gathered])
            rows = _by_document(docs, asks=(np.concatenate(a_doc), join(2)), claims=(np.concatenate(c_doc), join(4)))
            for i in range(0, len(rows), 20_000):
                yield _batch([(0, key, tie, s, a, c, None, None) for key, tie, s, a, c in rows[i : i + 20_000]])

        done: list[pa.RecordBatch] = []
        gathered: list[tuple] = []
        size, seen = 0, 0
        for held in _by_bucket(passing(), 0, 6, 7):
            while done:
                yield done.pop()
            docs, records, n = [], [], 0
            for d, raw in held:
                d, r = np.frombuffer(d, _DOC), _unpacked(raw)
                r["doc"] += n
                n += len(d)
                docs.append(d)
                records.append(r)
            docs, r = np.concatenate(docs), np.concatenate(records)
            docs, local = np.unique(docs, return_inverse=True)
            r["doc"] = local[r["doc"]]
            first, unlike, several = _first_of_equals(r, docs)
            asked = r[several if sort_all else unlike]
            asks = _items(_ASK, start=asked["start"], windows=asked["windows"], anchor=asked["anchor"])
            later = np.flatnonzero((first >= 0) & (first != np.arange(len(r)))) if not sort_all else np.zeros(0, np.int64)
            _, _, doc, start, end, f_doc, f_start = _runs(r, docs, later, first[later])
            claims = _items(_CLAIM, start=start, end=end, key=docs["key"][f_doc], tie=docs["tie"][f_doc], at=f_start)
            if len(asks) or len(claims):
                used, local = np.unique(np.concatenate([asked["doc"], doc]), return_inverse=True)
                gathered.append((docs[used], local[: len(asks)], asks, local[len(asks) :], claims))
                size += len(used) + len(asks) + len(claims)
            seen += 1
            if gathered and (size > MOST_MARKS or seen % GATHERED == 0):
                yield from out()
                gathered, size = [], 0
        if gathered:
            yield from out()
        yield from done

    return found.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _ROW).select("key", "tie", "spans", "asks", "claims")


def _claimed(marks: DataFrame) -> DataFrame:
    """Per document with claims: its spans, and the pieces of them to compare with their first occurrences."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, tie, blobs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                c = np.frombuffer(b"".join(blobs), _CLAIM)
                distance = c["start"].astype(np.int64) - c["at"]
                c = c[np.lexsort((c["start"], distance, c["tie"], c["key"]))]
                start, end, at = (c[n].astype(np.int64) for n in ("start", "end", "at"))
                new = np.ones(len(c), bool)
                new[1:] = (c["key"][1:] != c["key"][:-1]) | (c["tie"][1:] != c["tie"][:-1]) | ((start - at)[1:] != (start - at)[:-1]) | (start[1:] > end[:-1])
                begins = np.flatnonzero(new)
                start, at, of = start[begins], at[begins], c[begins]
                end = np.maximum.reduceat(end, begins)
                pieces = []
                for s, e, f, k, t in zip(start.tolist(), end.tolist(), at.tolist(), of["key"].tolist(), of["tie"].tolist()):
                    while s < e:
                        size = min(e - s, _STEP - f % _STEP)
                        pieces.append({"start": s, "length": size, "a_key": k, "a_tie": t, "a_start": f})
                        s, f = s + size, f + size
                rows.append((key, tie, _items(_SPAN, start=start, end=end).tobytes(), pieces))
            keys, ties, spans, pieces = zip(*rows) if rows else ((), (), (), ())
            kind = pa.list_(pa.struct([(x.split()[0], pa.int64()) for x in _PIECE.split(", ")]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ties, pa.int64()), pa.array(spans, pa.binary()), pa.array(pieces, kind)], names=["key", "tie", "spans", "pieces"])

    rows = marks.where("claims is not null").groupBy("key", "tie").agg(F.collect_list("claims").alias("claims"))
    return rows.mapInArrow(run, f"key long, tie long, spans binary, pieces array<struct<{_PIECE.replace(' ', ':').replace(',:', ',')}>>")


def _fetched(asked: DataFrame, buckets: int) -> DataFrame:
    """asked: key, tie, text, asks (list of blobs), pieces. The bytes of asked segments by bucket of their anchors, and of pieces."""
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["bucket", "docs", "records", "a_key", "a_tie", "a_start", "length", "content"]

    def run(batches):
        held: dict[int, list] = {}
        contents: list[tuple] = []
        size = 0

        def out():
            rows = []
            for bucket, found in held.items():
                docs = np.array([(k, t) for k, t, _, _ in found], _DOC).tobytes()
                rows.append((bucket, docs, b"".join(np.array([a["start"], a["windows"]], "<u4").tobytes() + part for _, _, a, part in found), None, None, None, None, None))
            rows += [(None, None, None, *c) for c in contents]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

        for batch in batches:
            keys, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, raw in enumerate(utf8(batch.column(2))):
                asks, pieces = batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
                for a in np.frombuffer(b"".join(asks or []), _ASK):
                    start, windows = int(a["start"]), int(a["windows"])
                    bucket = int(a["anchor"] >> np.uint64(32)) % buckets
                    held.setdefault(bucket, []).append((keys[i], ties[i], a, raw[start : start + windows + LENGTH - 1]))
                    size += windows + LENGTH
                for p in pieces or []:
                    contents.append((p["a_key"], p["a_tie"], p["a_start"], p["length"], raw[p["start"] : p["start"] + p["length"]]))
                    size += p["length"]
                if size > 8 << 20:
                    yield out()
                    held, contents, size = {}, [], 0
        yield out()

    return asked.select("key", "tie", "text", "asks", "pieces").mapInArrow(run, "bucket int, docs binary, records binary, a_key long, a_tie long, a_start long, length long, content binary")


def _sorted(fetched: DataFrame, parts: int) -> DataFrame:
    """Windows of the fetched segments, sorted as suffixes; spans of those that aren't the first of their class."""

    def run(batches):
        for held in _by_bucket(batches, 0, 1, 2):
            docs, numbers, pieces = [], [], []
            for d, raw in held:
                at = 0
                for one in np.frombuffer(d, _DOC):
                    start, windows = np.frombuffer(raw, "<u4", 2, at).tolist()
                    at += 8 + windows + LENGTH - 1
                    docs.append(one)
                    numbers.append((start, windows))
                    pieces.append(raw[at - windows - LENGTH + 1 : at])
            docs, local = np.unique(np.array(docs, _DOC), return_inverse=True)  # in the order of documents
            start, windows = np.array(numbers, np.int64).T
            buffer = np.frombuffer(b"".join(pieces), np.uint8)
            base = np.cumsum(windows + LENGTH - 1) - (windows + LENGTH - 1)
            within = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            owner = np.repeat(np.arange(len(windows)), windows)
            order, number = equal_classes(buffer, base[owner] + within, LENGTH)
            doc, place = local[owner[order]], (start[owner] + within)[order]
            by = np.lexsort((place, doc, number))
            again = np.r_[False, number[by][1:] == number[by][:-1]]
            doc, place = doc[by][again], place[by][again]
            by = np.lexsort((place, doc))
            doc, place = doc[by], place[by]
            if len(doc):  # neighbouring windows as one span
                new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)])
                last = np.append(new[1:], len(doc)) - 1
                rows = _by_document(docs, spans=(doc[new], _items(_SPAN, start=place[new], end=place[last] + LENGTH)))
                for i in range(0, len(rows), 20_000):
                    yield _batch([(0, key, tie, s, None, None, None, None) for key, tie, s, _, _ in rows[i : i + 20_000]])

    dealt = fetched.where("bucket is not null").select("bucket", "docs", "records").repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, _ROW).select("key", "tie", "spans")


def kept_bytes(raw: bytes, blobs) -> tuple[bytes, int, int]:
    """What is left of a text, how many bytes went, in how many maximal runs."""
    if not blobs:
        return raw, 0, 0
    spans = np.frombuffer(b"".join(blobs), _SPAN)
    change = np.zeros(len(raw) + 1, np.int64)
    np.add.at(change, spans["start"], 1)
    np.add.at(change, spans["end"], -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int((gone & ~np.r_[False, gone[:-1]]).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _covered(rows: DataFrame, parts: int, buckets: int, bits: int, sort_all: bool) -> DataFrame | None:
    """key, tie, spans: what goes, in part more than once; None where a claim failed."""
    marks = cut(_merged(_found_in_scan(rows, buckets, bits), parts, sort_all))
    claimed = cut(_claimed(marks))
    piece = claimed.select("key", "tie", F.explode("pieces").alias("p"))
    first = piece.select(F.col("p.a_key").alias("key"), F.col("p.a_tie").alias("tie"), F.struct(F.col("p.a_start").alias("start"), "p.length", "p.a_key", "p.a_tie", "p.a_start").alias("p")).distinct()
    pieces = piece.union(first).groupBy("key", "tie").agg(F.collect_list("p").alias("pieces"))
    asks = marks.where("asks is not null").groupBy("key", "tie").agg(F.collect_list("asks").alias("asks"))
    asked = asks.join(pieces, ["key", "tie"], "full")
    concerned = key_filter(marks.where("asks is not null").select("key").union(piece.select("key")).union(first.select("key")), F.col("key"))
    texts = rows.where(concerned(F.col("key"))).select("key", "tie", "text").dropDuplicates(["key", "tie"])
    fetched = cut(_fetched(asked.join(texts, ["key", "tie"]), buckets))
    contents = fetched.where("content is not null").groupBy("a_key", "a_tie", "a_start", "length", "content").agg(F.lit(1).alias("one"))
    failed = contents.groupBy("a_key", "a_tie", "a_start", "length").agg(F.count("*").alias("n")).where("n > 1")
    if not failed.isEmpty():
        discard(marks, claimed, fetched)
        return None
    spans = marks.where("spans is not null").select("key", "tie", "spans").union(claimed.select("key", "tie", "spans")).union(_sorted(fetched, parts))
    covered = cut(spans)
    discard(marks, claimed, fetched)
    return covered


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """Per row of docs: id, kept (bytes), n_bytes, n_removed, n_spans. bits: length of the segments' hashes."""
    spark = ship(docs.sparkSession)
    parts = tasks(spark)
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    buckets = max(LEAST_BUCKETS, 4 * parts, min(size >> 28, 16 * parts))  # 256 MB of text behind a bucket, if the estimate is right
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("key"), text_or_empty(text_col).alias("text"), F.col(id_col).isNull().alias("nameless"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    spans = _covered(rows, parts, buckets, bits, False)
    if spans is None:
        spans = _covered(rows, parts, buckets, bits, True)
    touched = key_filter(spans, F.col("key"))
    spans = spans.groupBy("key", "tie").agg(F.collect_list("spans").alias("spans"))
    both = rows.where(touched(F.col("key"))).join(spans, ["key", "tie"], "left").select("key", "nameless", "text", "spans")

    def run(batches):
        for batch in batches:
            done = [kept_bytes(raw, s.as_py()) + (len(raw),) for raw, s in zip(utf8(batch.column(2)), batch.column(3))]
            for i in range(0, len(done), 1000):
                kept, removed, runs, sizes = zip(*done[i : i + 1000])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1000), batch.column(1).slice(i, 1000), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], names=["key", "nameless", "kept", "n_bytes", "n_removed", "n_spans"])

    out = both.mapInArrow(run, "key long, nameless boolean, kept binary, n_bytes long, n_removed long, n_spans long")
    zero = F.lit(0).cast("long")
    whole = rows.where(~touched(F.col("key"))).select("key", "nameless", F.encode("text", "UTF-8").alias("kept"), F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"))
    return out.union(whole).select(F.when(~F.col("nameless"), F.col("key")).alias("id"), "kept", "n_bytes", "n_removed", "n_spans")
