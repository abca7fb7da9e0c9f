"""N-gram Jaccard join by a MinHash LSH forest.

Texts are words between blanks, shingles five words (a shorter text is one shingle). Texts with the same words are
collapsed to a representative first. A representative has a label of `DEPTH` min-hashes (16 bits each) in each of
`TREES` trees. A tree is the prefix trie of its labels: labels sorted within the subtrees of the floor depth, so
that the texts below any trie node are one run.

Which prefix counts is decided for each text and tree. Where few texts (`DENSE`) share a prefix of the floor depth,
that node's texts meet. Below a denser node the prefix is the shortest with at most `DENSE` texts, or the whole label. A
text so has a prefix length d in each tree, and a pair at the threshold t meets with a chance of 1 - prod(1 - t**d).
Texts for which that is under the target recall have all their longer prefixes shortened, step by step, until it is
reached; at the floor depth in every tree it is. A trie node whose prefix counts for one of its texts ties all of its
texts, each to the first of them, so m texts give m - 1 ties, never their pairs. Ties join texts into candidate
families. Nodes with thousands of texts (estimated from a 64th of the texts, which changes only how work is
dealt) are split by salts, tied within each and then across.

A family's texts meet in cells. A small family is one cell. The members of a large one are dealt to chunks of `CHUNK`
texts or `CHUNK_BYTES`, and those pairs of chunks that share a trie node form cells. What goes to several cells is not the
text but how its shingles differ from those of the family's first text, C: for sets with A = C - a + a' and B = C - b + b'
the intersection has |C| - |a| - |b| + |a & b| + |a' & b'| shingles, exactly, and near copies differ little. Within a cell
the intersections are counted blockwise, so every pair of a family at the threshold is found (counting all links of m
near copies takes m * m / 2 comparisons of such differences, spread over cells), and only counts and one tie per text
leave it. Verified ties give the classes.

Result: a row per row of docs with id, class_id (least id of the texts that verified links connect), n_links (other
different texts at the threshold), n_copies (rows with the same words), digest (of the words) and stays (whether
the row is the one of its class to keep; rows that repeat it in id and words stay with it).

Null texts and texts without words link to nothing, aren't copies of each other and all stay. Rows without id and rows that
repeat an id with other words take part by their words; a class without any id has none. Very long texts are compared
whole. An empty table gives an empty result; columns other than id and text, whatever their names, are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CLASS, cut, discard, fresh, ship, tasks, text_or_empty
from .components import components
from .key_filter import key_filter

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9995
TREES, DEPTH = 25, 8
#: Up to so many texts below a trie node of the floor depth meet without a longer prefix.
DENSE = 64
CHUNK, CHUNK_BYTES, SALTS = 512, 4 << 20, 32
#: Marks the shingles that a text lacks of its family's first text.
_LACKS = np.uint64(0xA5A5A5A5A5A5A5A5)
#: A node is hot when a sample of a 64th of the texts has so many of it; a salt of it gets about HOT * 64 texts.
SAMPLE, HOT = 64, 32
_M = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def floor_depth(threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> int:
    """The longest prefix with which a pair at the threshold meets in some tree with the target recall."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(raw: bytes, size: int = WORDS) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes."""
    words = raw.split()
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    if not len(w):
        return w
    n = max(1, len(w) - size + 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(size, len(w))):
        total += _mixed(w[i : i + n] + _M[i]) * _M[i + size]
    return np.unique(_mixed(total))


class Forest:
    """Labels of a text: for each tree DEPTH min-hashes of 16 bits, the first ones in the highest bits of two numbers."""

    def __init__(self, trees: int = TREES, seed: int = 11):
        self.trees = trees
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 63, trees * DEPTH, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 1 << 63, trees * DEPTH, dtype=np.uint64)

    def labels(self, x: np.ndarray) -> np.ndarray:
        """trees * 2 numbers."""
        least = np.full(len(self.a), np.iinfo(np.uint32).max, np.uint64)
        for i in range(0, len(x), 1024):
            part = (x[i : i + 1024, None] * self.a + self.b) >> np.uint64(32)
            np.minimum(least, part.min(0), out=least)
        value = (least & np.uint64(0xFFFF)).reshape(self.trees, 2, 4)
        return (value << np.array([48, 32, 16, 0], np.uint64)).sum(2, dtype=np.uint64)


def prefix(hi: np.ndarray, lo: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels without what follows their first `depth` values."""
    keep = lambda n: np.uint64(0 if n <= 0 else (1 << 64) - (1 << (64 - 16 * min(n, 4))))
    return hi & keep(depth), lo & keep(depth - 4)


def _signed(docs: DataFrame, forest: Forest) -> DataFrame:
    def run(batches):
        for batch in batches:
            labels, sizes = [], []
            for value in batch.column(3):
                raw = value.as_py().encode()
                x = shingles(raw)
                labels.append(forest.labels(x).tobytes() if len(x) else None)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(labels, pa.binary()), pa.array(sizes, pa.int64())], names=["id", "digest", "salt", "labels", "size"])
        _hashes.clear()  # an idle worker holds none

    return docs.mapInArrow(run, "id long, digest string, salt int, labels binary, size long")


def _exploded(firsts: DataFrame, trees: int, floor: int) -> DataFrame:
    """firsts: node, labels. A row for each text and tree: key (of the subtree at the floor depth), hi, lo, node."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            both = np.frombuffer(b"".join(x.as_py() for x in batch.column(1)), np.uint64).reshape(-1, trees, 2)
            hi, lo = both[:, :, 0].ravel(), both[:, :, 1].ravel()
            a, b = prefix(hi, lo, floor)
            tree = np.tile(np.arange(trees, dtype=np.uint64), len(both))
            key = _mixed(_mixed(_mixed(a + _M[20]) + b * _M[21]) + tree * _M[22])
            columns = [key.view(np.int64), hi.view(np.int64), lo.view(np.int64), np.repeat(np.asarray(batch.column(0)), trees)]
            for i in range(0, len(key), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in columns], names=["key", "hi", "lo", "node"])

    return firsts.select("node", "labels").mapInArrow(run, "key long, hi long, lo long, node long")


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Whether a row begins a run of equal values in all columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _sizes(begins: np.ndarray) -> np.ndarray:
    """Of each row, the size of its run."""
    number = np.cumsum(begins) - 1
    return np.bincount(number)[number]


def _whole_runs(batches, columns: int):
    """Arrays of whole runs of equal first columns out of batches sorted by it."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [np.asarray(batch.column(i)) for i in range(columns)]
        if held is not None:
            rows = [np.concatenate(pair) for pair in zip(held, rows)]
        cut_at = int(np.searchsorted(rows[0], rows[0][-1]))
        if cut_at:
            yield [c[:cut_at] for c in rows]
        held = [c[cut_at:] for c in rows]
    if held is not None:
        yield held


def _tied(node: np.ndarray, begins: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ties from each member of a run to its first."""
    head = node[np.maximum.accumulate(np.where(begins, np.arange(len(node)), 0))]
    tied = head != node if wanted is None else (head != node) & wanted
    return node[tied], head[tied]


_MET = "kind int, key long, hi long, lo long, u long, v long, depth int"


def _met_batch(kind: int, key, hi, lo, u, v, depth) -> pa.RecordBatch:
    n = len(u)
    fill = lambda c, t: pa.nulls(n, t) if c is None else pa.array(c, t)
    arrays = [pa.array(np.full(n, kind, np.int32)), *[fill(c, pa.int64()) for c in (key, hi, lo, u, v)], fill(depth, pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "key", "hi", "lo", "u", "v", "depth"])


_TIE, _BELOW_DENSE, _SALT = 0, 1, 2


def _met(keyed: DataFrame, parts: int, floor: int, dense: int) -> DataFrame:
    """keyed: run, key, hi, lo, node, hot. Ties below sparse and hot nodes; of dense nodes the rows with their depth;
    of the salts of hot nodes the first texts."""

    def run(batches):
        for number, key, hi, lo, node, hot in _whole_runs(batches, 6):
            begins = _begins(number)
            size = _sizes(begins)
            large = (size > dense) & (hot == 0)
            u, v = _tied(node, begins, ~large)
            yield _met_batch(_TIE, None, None, None, u, v, None)
            salted = begins & (hot == 1)
            if salted.any():
                yield _met_batch(_SALT, key[salted], None, None, node[salted], None, None)
            if large.any():
                key, hi, lo, node = (c[large] for c in (key, hi, lo, node))
                depth = np.full(len(key), DEPTH, np.int32)
                for d in range(DEPTH - 1, floor, -1):  # sizes grow as prefixes shorten
                    few = _sizes(_begins(key, *prefix(hi.view(np.uint64), lo.view(np.uint64), d))) <= dense
                    depth[few] = d
                yield _met_batch(_BELOW_DENSE, key, hi, lo, node, None, depth)

    return keyed.repartition(parts, "run").sortWithinPartitions("run", "hi", "lo", "node").select("run", "key", "hi", "lo", "node", "hot").mapInArrow(run, _MET)


def _across_salts(rows: DataFrame, parts: int) -> DataFrame:
    """rows: key, node. Ties the first texts of a hot node's salts."""

    def run(batches):
        for key, node in _whole_runs(batches, 2):
            u, v = _tied(node, _begins(key))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return rows.select("key", "node").repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(run, "u long, v long")


def shortened(below: DataFrame, threshold: float, trees: int, floor: int, recall: float) -> DataFrame:
    """below: node, depth, a row for each tree in which a text's prefix is longer than the floor. Per node: steps.

    The least number of steps by which shortening all of its prefixes (to the floor at most) reaches the recall.
    """
    log_miss = lambda d: F.log(1 - F.pow(F.lit(threshold), d.cast("double")))
    sums = [F.sum(log_miss(F.greatest(F.lit(floor), F.col("depth") - k))).alias(f"s{k}") for k in range(DEPTH - floor + 1)]
    rows = below.groupBy("node").agg(F.count("*").alias("n"), *sums)
    rest = (trees - F.col("n")) * log_miss(F.lit(floor))
    steps = F.lit(DEPTH - floor)
    for k in range(DEPTH - floor - 1, -1, -1):
        steps = F.when(F.exp(F.col(f"s{k}") + rest) <= 1 - recall, k).otherwise(steps)
    return rows.select("node", steps.alias("steps"))


def _within_dense(below: DataFrame, steps: DataFrame, parts: int, floor: int) -> DataFrame:
    """Ties below dense nodes, at every trie node whose prefix counts for one of its texts."""

    def run(batches):
        for key, hi, lo, node, depth in _whole_runs(batches, 5):
            for d in range(DEPTH, floor - 1, -1):
                begins = _begins(key, *prefix(hi.view(np.uint64), lo.view(np.uint64), d))
                number = np.cumsum(begins) - 1
                counts = np.bincount(number, depth <= d)[number] > 0
                u, v = _tied(node, begins, counts)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    rows = below.join(steps, "node").select("key", "hi", "lo", "node", F.greatest(F.lit(floor), F.col("depth") - F.col("steps")).cast("int").alias("depth"))
    return rows.repartition(parts, "key").sortWithinPartitions("key", "hi", "lo", "node").mapInArrow(run, "u long, v long")


def _ties(firsts: DataFrame, parts: int, threshold: float, trees: int, recall: float, dense: int) -> tuple[DataFrame, DataFrame]:
    """firsts: node, labels. u, v: a tie for each text that meets others in some tree; and the table that it is read from."""
    floor = floor_depth(threshold, trees, recall)
    part = _exploded(firsts.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SAMPLE)) == 0), trees, floor)
    hot = part.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).select("key", F.ceil(F.col("n") / HOT).alias("salts"))
    keyed = _exploded(firsts, trees, floor).join(hot, "key", "left")
    number = F.when(F.col("salts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("node"), "salts")))
    met = cut(_met(keyed.select(number.alias("run"), "key", "hi", "lo", "node", F.col("salts").isNotNull().cast("int").alias("hot")), parts, floor, dense))
    ties = met.where(F.col("kind") == _TIE).select("u", "v")
    salted = met.where(F.col("kind") == _SALT).select("key", F.col("u").alias("node"))
    below = met.where(F.col("kind") == _BELOW_DENSE).select("key", "hi", "lo", F.col("u").alias("node"), "depth")
    if not salted.isEmpty():
        ties = ties.union(_across_salts(salted, parts))
    if not below.isEmpty():
        ties = ties.union(_within_dense(below, shortened(below, threshold, trees, floor, recall), parts, floor))
    return ties, met


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD, sizes: np.ndarray | None = None, lacks: np.ndarray | None = None, base: int = 0) -> np.ndarray:
    """Which pairs (row of left, row of right) of shingle sets reach the threshold, by exact intersections.

    With sizes, lacks and base the sets are differences from a set of `base` shingles: see difference().
    """
    lengths = np.array([len(s) for s in sets])
    sizes, lacks = (lengths if sizes is None else sizes), (np.zeros(len(sets), int) if lacks is None else lacks)
    value, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
    _, number, count = np.unique(value, return_inverse=True, return_counts=True)
    shared = count[number] > 1
    _, number = np.unique(number[shared], return_inverse=True)
    owner = owner[shared]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    both = np.zeros((len(left), len(right)), np.float32)
    at = {n: i for i, n in enumerate(left)}
    of_left = np.array([at.get(i, -1) for i in range(len(sets))])
    at = {n: i for i, n in enumerate(right)}
    of_right = np.array([at.get(i, -1) for i in range(len(sets))])
    width = 2048
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(number, [lo, lo + width])
        who, what = owner[a:b], number[a:b] - lo
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        here = of_left[who] >= 0
        x[of_left[who[here]], what[here]] = 1
        here = of_right[who] >= 0
        y[of_right[who[here]], what[here]] = 1
        both += x @ y.T
    both = base - lacks[left][:, None] - lacks[right][None, :] + both.astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return both / np.maximum(union, 1) >= threshold


def difference(x: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, int]:
    """Shingles of x besides those of base, and marked ones of base that x lacks; and how many x lacks."""
    more, less = np.setdiff1d(x, base, assume_unique=True), np.setdiff1d(base, x, assume_unique=True)
    return np.concatenate([more, less ^ _LACKS]), len(less)


def _differences(rows: DataFrame) -> DataFrame:
    """rows: node, root, chunk, text, base (text of the root). Each text as what differs from the base."""
    names, kinds = ["node", "root", "chunk", "size", "lacks", "base", "x"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        last, base = None, None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                raw = batch.column(4)[i].as_py()
                if raw != last:
                    last, base = raw, shingles(raw.encode())
                own = shingles(batch.column(3)[i].as_py().encode())
                x, lacks = difference(own, base)
                out.append((len(own), lacks, len(base), x.tobytes()))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], *[pa.array(c, k) for c, k in zip(columns, kinds[3:])]], names=names)
        _hashes.clear()

    return rows.select("node", "root", "chunk", "text", "base").mapInArrow(run, "node long, root long, chunk int, size long, lacks long, base long, x binary")


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least index of each index's component."""
    root = np.arange(n)
    while len(pairs):
        low = root.copy()
        np.minimum.at(low, pairs[0], root[pairs[1]])
        np.minimum.at(low, pairs[1], root[pairs[0]])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return root


def _verified(cells: DataFrame, parts: int, threshold: float) -> DataFrame:
    """cells: cell, a, b, chunk, node, text or size, lacks, base, x. Per text and cell: its links there and the first text they connect it to."""

    def judge(rows):
        rows.sort(key=lambda r: r[3])
        names, chunks = np.array([r[3] for r in rows]), np.array([r[2] for r in rows])
        left, right = np.flatnonzero(chunks == rows[0][0]), np.flatnonzero(chunks == rows[0][1])
        if rows[0][4] is not None:
            hit = linked([shingles(r[4].encode()) for r in rows], left, right, threshold)
        else:
            hit = linked([np.frombuffer(r[8], np.uint64) for r in rows], left, right, threshold, np.array([r[5] for r in rows]), np.array([r[6] for r in rows]), rows[0][7])
        i, j = np.nonzero(hit)
        i, j = left[i], right[j]
        own = i != j
        links = np.bincount(i[own], minlength=len(rows))
        if rows[0][0] != rows[0][1]:
            links = links + np.bincount(j[own], minlength=len(rows))
        return names, links, names[_roots(len(rows), np.stack([i[own], j[own]]))]

    def batch_of(found):
        names, links, roots = (np.concatenate(c) for c in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(links, pa.int64()), pa.array(roots, pa.int64())], names=["node", "links", "root"])

    def run(batches):
        now, rows, found = None, [], []
        for batch in batches:
            cell, *numbers = (batch.column(i).to_pylist() for i in range(5))
            for i in range(batch.num_rows):
                if cell[i] != now and rows:
                    found.append(judge(rows))
                    rows = []
                now = cell[i]
                rows.append((*[c[i] for c in numbers], *[batch.column(c)[i].as_py() for c in range(5, 10)]))
            if found:
                yield batch_of(found)
                found = []
        if rows:
            yield batch_of([judge(rows)])
        _hashes.clear()

    dealt = cells.repartition(parts, "cell").sortWithinPartitions("cell")
    return dealt.select("cell", "a", "b", "chunk", "node", "text", "size", "lacks", "base", "x").mapInArrow(run, "node long, links long, root long")


def _numbered(same: DataFrame) -> tuple[DataFrame, bool]:
    """same with `node`, a number of its own for each text: the least id, where no other text has it; and whether others had to be found.

    Texts without id, and but one of those that share an id, get numbers from a hash outside the ids' range.
    """
    first = same.where("id is not null").groupBy("id").agg(F.min("digest").alias("digest")).withColumnRenamed("id", "speaker")
    rows = same.join(first, "digest", "left").withColumn("speaks", F.col("speaker").isNotNull())
    if rows.where("not speaks").isEmpty():
        return rows.withColumn("node", F.col("id")).drop("speaker", "speaks"), False
    low, high = same.agg(F.min("id"), F.max("id")).first()
    low, high = low or 0, high or 0
    above = (1 << 63) - 1 - high
    start, room = (high + 1, above) if above > low + (1 << 63) else (-(1 << 63), low + (1 << 63))
    for seed in range(20):
        found = rows.withColumn("node", F.when(F.col("speaks"), F.col("id")).otherwise(F.lit(start) + F.pmod(F.xxhash64("digest", F.lit(seed)), F.lit(min(room, (1 << 63) - 1)))))
        if found.where("not speaks").groupBy("node").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
            return found.drop("speaker", "speaks"), True
    raise ValueError("ids leave no room for numbers of texts without id")


def _normal(text_col: str):
    return F.trim(F.regexp_replace(text_or_empty(text_col), BLANK_CLASS + "+", " "))


def _mark(digest, i):
    return F.concat_ws(":", digest, F.coalesce(i.cast("string"), F.lit("~")))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, dense: int | None = None) -> DataFrame:
    """Per row of docs: id, class_id, n_links, n_copies, digest (of its words), stays."""
    spark = ship(docs.sparkSession)
    parts = tasks(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), _normal(text_col).alias("text"))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")  # written down once, so every reader sees the same
    signed = cut(_signed(rows.select("id", F.sha2("text", 256).alias("digest"), salt.alias("salt"), "text"), Forest(trees)))
    # The least id of each text, kept on its salts: a text with very many copies meets them in SALTS tasks.
    same = signed.where("labels is not null").groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.collect_set("salt").alias("salts"))
    same, odd = _numbered(cut(same))
    same = cut(same)
    # One signature for each text.
    nodes = same.select(_mark(F.col("digest"), F.col("id")).alias("mark"), "node")
    marked = signed.where("labels is not null").select(_mark(F.col("digest"), F.col("id")).alias("mark"), "labels", "size")
    firsts = cut(marked.join(nodes, "mark").select("node", "labels", "size").dropDuplicates(["node"]))
    ties, met_at = _ties(firsts, parts, threshold, trees, recall, dense or DENSE)
    family = components(ties)
    discard(met_at)
    sized = cut(family.join(firsts.select("node", "size"), "node"))
    sums = sized.groupBy("root").agg(F.count("*").alias("members"), F.sum("size").alias("bytes"))
    sums = sums.select("root", F.greatest(F.ceil(F.col("members") / (2 * CHUNK)), F.ceil(F.col("bytes") / (2 * CHUNK_BYTES))).alias("over"), F.greatest(F.ceil(F.col("members") / CHUNK), F.ceil(F.col("bytes") / CHUNK_BYTES)).alias("chunks"))
    chunk = F.when(F.col("over") <= 1, 0).otherwise(F.pmod(F.xxhash64("node"), "chunks"))
    member = cut(sized.join(sums, "root").select("node", "root", "over", chunk.cast("int").alias("chunk")))
    large = member.where("over > 1")
    met = _exploded(firsts.join(large, "node"), trees, floor_depth(threshold, trees, recall)).select("key", "node").join(large, "node").select("key", "root", "chunk").distinct()
    other = met.select(F.col("key").alias("k"), F.col("root").alias("r"), F.col("chunk").alias("b"))
    cells = met.join(other, (F.col("key") == F.col("k")) & (F.col("root") == F.col("r")) & (F.col("chunk") <= F.col("b"))).select("root", F.col("chunk").alias("a"), "b").distinct()
    sides = cells.select("root", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("chunk"))
    # Only texts of families move: a sieve of their ids comes before anything else is done with a text.
    asked = key_filter(member.select("node").join(same.select("node", "id"), "node"), F.col("id"))
    texts = docs.where(asked(F.col(id_col).cast("long"))).select(F.col(id_col).cast("long").alias("id"), _normal(text_col).alias("text"))
    texts = texts.select(_mark(F.sha2("text", 256), F.col("id")).alias("mark"), "text").dropDuplicates(["mark"])
    placed = texts.join(member.join(same.select("node", _mark(F.col("digest"), F.col("id")).alias("mark")), "node"), "mark")
    whole = placed.where("over <= 1").select(F.xxhash64("root").alias("cell"), F.lit(0).alias("a"), F.lit(0).alias("b"), "chunk", "node", "text", *[F.lit(None).cast("long").alias(c) for c in ("size", "lacks", "base")], F.lit(None).cast("binary").alias("x"))
    if large.isEmpty():
        verified = cut(_verified(whole, parts, threshold))
    else:
        crowd = placed.where("over > 1").select("node", "root", "chunk", "text")
        bases = crowd.where("node = root").select("root", F.col("text").alias("base")).join(large.select("root", "chunk").distinct(), "root")
        apart = cut(_differences(crowd.join(bases, ["root", "chunk"])))
        dealt = apart.join(sides, ["root", "chunk"]).select(F.xxhash64("root", "a", "b").alias("cell"), "a", "b", "chunk", "node", F.lit(None).cast("string").alias("text"), "size", "lacks", "base", "x")
        verified = cut(_verified(whole.union(dealt), parts, threshold))
        discard(apart)
    discard(firsts, sized, member)
    links = verified.groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = components(verified.select(F.col("node").alias("u"), F.col("root").alias("v")))
    found = same.join(links.join(roots, "node", "left"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    if odd:
        found = found.drop("class_id").join(found.groupBy("root").agg(F.min("id").alias("class_id")), "root")
    else:
        found = found.withColumn("class_id", F.col("root"))
    found = found.select("digest", F.explode("salts").alias("salt"), F.col("id").alias("first"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("n") - 1).alias("n_copies"), (F.col("root") == F.col("node")).alias("leads"))
    out = signed.select("id", "digest", "salt", F.col("labels").isNull().alias("empty")).join(found, ["digest", "salt"], "left")
    own = F.when(F.col("empty"), F.col("id")).otherwise(F.col("class_id"))
    stays = F.col("empty") | (F.col("leads") & F.col("id").eqNullSafe(F.col("first")))
    return out.select("id", own.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(0)).cast("long").alias("n_copies"), "digest", stays.alias("stays"))


def keep_one_of_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each class, and every row without words.

    A row goes by its id and its words together, so one that only shares an id with a copy stays. Of rows that agree in both any
    one stays. Nulls, empty tables and clashing names are as in near_classes.
    """
    gone = near_classes(docs, id_col, text_col, threshold).where("not stays").select(_mark(F.col("digest"), F.col("id")).alias("gone")).distinct()
    name, words = fresh(docs.columns, "mark", "words")
    marked = docs.withColumn(words, _normal(text_col))
    own = F.concat(F.lit("~"), F.monotonically_increasing_id().cast("string"))
    marked = marked.withColumn(name, F.when(F.col(words) == "", own).otherwise(_mark(F.sha2(words, 256), F.col(id_col).cast("long")))).drop(words)
    kept = marked.join(gone, marked[name] == gone["gone"], "left_anti")
    return kept.dropDuplicates([name]).select(*[F.col(f"`{c}`") for c in docs.columns])
