"""Exact top-k search by inner product over norm-sorted vectors.

Vectors become integers, floor(scale * x). An orthogonal rotation, the right singular vectors of all candidates
(from their Gram matrix, summed over all rows), moves most of each product into the leading components.
Candidates are packed into blocks by descending length. A block is scanned in slices: by Cauchy-Schwarz
|q||x| bounds a whole slice, and the product of the leading components plus the product of the residual
lengths bounds each pair; only pairs whose bound reaches the query's k-th best score so far are multiplied out,
exactly. The first threshold of each query comes from a bounded head, the longest `HEAD` candidates.

Every query meets every candidate block: the blocks of queries go to each lane, the candidate blocks are dealt to
lanes by number. Nothing is approximated: bounds are widened by more than their rounding error. Products are summed as
floating numbers where each sum of a block is below 2**52 and so exact, else as integers of any size. A score that
a long can't hold is ranked by its true value and reported as the nearest long.

A vector that is null, empty, or has a null or non-finite component takes no part; neither does a row without id.
Products are of vectors of one dimension: a query meets the candidates that have as many components (the rotation is
that of the most common dimension). Ties go to the smaller id. Repeated ids are candidates of their own, except for a
query with the same id. An empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, ship, tasks

SCALE, LEADING = 256.0, 16
HEAD, QUERY_BLOCK, BLOCK, SLICE = 4096, 512, 2048, 1024
_EXACT = float(1 << 52)
_LONG = (1 << 63) - 1


def _vectors(table: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id, components, dimension and squared length of the vectors that take part."""
    x = F.col(vector_col)
    fine = x.isNotNull() & F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = table.where(fine).select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("v"), F.size(x).alias("dim"))
    square = F.aggregate("v", F.lit(0.0), lambda a, v: a + F.floor(v * scale).cast("double") * F.floor(v * scale).cast("double"))
    return rows.withColumn("square", square)


def whole_numbers(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x): as floating numbers where those are exact, else as Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if np.abs(scaled).max(initial=0) < _EXACT:
        return scaled
    exact = lambda v: math.floor(v * scale) if math.isfinite(v * scale) else math.floor(v) * int(scale)
    return np.array([exact(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _gram(rows: DataFrame, scale: float) -> np.ndarray | None:
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                with np.errstate(over="ignore", invalid="ignore"):
                    x = _matrix(batch.column(0)) * scale
                    total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    parts = rows.select("v").mapInArrow(run, "g binary")
    total = None
    for row in parts.toLocalIterator():  # one matrix of dim * dim for each partition, one at a time
        part = np.frombuffer(row["g"])
        total = part if total is None else total + part
    return None if total is None else total.reshape(int(len(total) ** 0.5), -1)


def _rotation(gram: np.ndarray) -> np.ndarray:
    """Right singular vectors of the candidates, the strongest first; none where their products are too large for numbers."""
    return np.linalg.svd(gram)[0] if np.isfinite(gram).all() else np.eye(len(gram))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows in their order within a partition as blobs of up to `size` vectors of one dimension, each with a number of its own."""

    def run(batches):
        base, n, ids, vectors, held = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def blob():
            x = np.concatenate(vectors)
            raw = np.int64(len(x)).tobytes() + np.concatenate(ids).astype("<i8").tobytes() + x.astype("<f8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), pa.array([x.shape[1]], pa.int32()), pa.array([raw], pa.binary())], names=["n", "dim", "blob"])

        for batch in batches:
            dims, at = np.asarray(batch.column(2)), 0
            while at < batch.num_rows:
                change = np.flatnonzero(dims[at:] != dims[at])
                piece = batch.slice(at, min(size - held, int(change[0]) if len(change) else batch.num_rows))
                if held and dims[at] != vectors[-1].shape[1]:
                    yield blob()
                    ids, vectors, held, n = [], [], 0, n + 1
                    continue
                ids.append(np.asarray(piece.column(0)))
                vectors.append(_matrix(piece.column(1)))
                held, at = held + piece.num_rows, at + piece.num_rows
                if held == size:
                    yield blob()
                    ids, vectors, held, n = [], [], 0, n + 1
        if held:
            yield blob()

    return rows.select("id", "v", "dim").mapInArrow(run, "n long, dim int, blob binary")


def _open(blob) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    return np.frombuffer(blob, "<i8", n, 8), np.frombuffer(blob, "<f8", -1, 8 + 8 * n).reshape(n, -1)


def _number(v: int) -> float:
    """The nearest floating number; infinite beyond those."""
    try:
        return float(v)
    except OverflowError:
        return math.inf if v > 0 else -math.inf


def _numbers(x: np.ndarray) -> np.ndarray:
    return np.vectorize(_number, otypes=[float])(x) if x.dtype == object else x


def _norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((_numbers(x) ** 2).sum(1))


class Searcher:
    """The k best candidates of a block of queries, kept while slices of candidates pass by. x: whole numbers."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rotation: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.x, self.rotation, self.k = ids, x, rotation, k
        with np.errstate(over="ignore", invalid="ignore"):
            self.turned = _numbers(x) @ rotation
            self.rest = np.sqrt((self.turned[:, LEADING:] ** 2).sum(1))
        self.norm = _norms(x)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id) of each query in order
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor
        self.multiplied = 0

    def threshold(self) -> np.ndarray:
        """A score below it can't be among a query's k best."""
        last = [_number(-b[-1][0]) if len(b) == self.k else -np.inf for b in self.best]
        return np.maximum(self.floor, last)

    def scan(self, ids: np.ndarray, y: np.ndarray) -> None:
        """y: whole numbers of candidates, longer ones first."""
        norm = _norms(y)
        for a in range(0, len(y), SLICE):
            part, names = y[a : a + SLICE], ids[a : a + SLICE]
            need, longest = self.threshold(), norm[a : a + SLICE].max()
            with np.errstate(over="ignore", invalid="ignore"):
                slack = 1e-9 * (self.norm * longest + 1) + 1e-6
                live = np.flatnonzero(~(self.norm * longest + slack < need))  # Cauchy-Schwarz for the slice
                if not len(live):
                    continue
                turned = _numbers(part) @ self.rotation
                rest = np.sqrt((turned[:, LEADING:] ** 2).sum(1))
                bound = self.turned[live, :LEADING] @ turned[:, :LEADING].T + np.outer(self.rest[live], rest) + slack[live, None]
                q, c = np.nonzero(~(bound < need[live, None]))
            other = self.ids[live[q]] != names[c]
            self.keep(live[q[other]], c[other], part, names)

    def keep(self, q: np.ndarray, c: np.ndarray, part: np.ndarray, names: np.ndarray) -> None:
        if not len(q):
            return
        self.multiplied += len(q)
        plain = self.x.dtype != object and part.dtype != object and self.norm.max() * _norms(part).max() < _EXACT
        x, y = (self.x, part) if plain else (_integers(self.x), _integers(part))
        for at in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q)) + 1):  # pairs come by query
            who, which = int(q[at[0]]), c[at]
            score = y[which] @ x[who]
            if plain and len(which) > self.k:
                least = np.partition(score, len(score) - self.k)[len(score) - self.k]
                which, score = which[score >= least], score[score >= least]
            found = [(-int(s), int(n)) for s, n in zip(score, names[which])]
            self.best[who] = sorted(self.best[who] + found)[: self.k]

    def rows(self) -> pa.RecordBatch:
        flat = [(int(i), n, max(-_LONG - 1, min(_LONG, -s)), _beyond(-s)) for i, best in zip(self.ids, self.best) for s, n in best]
        columns = list(zip(*flat)) or [()] * 4
        kinds = [pa.int64()] * 3 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["query_id", "vec_id", "score", "beyond"])


def _beyond(score: int) -> bytes:
    """Bytes in whose order scores follow each other that the same long stands for."""
    size = (score.bit_length() + 8) // 8
    if score > _LONG:
        return size.to_bytes(2, "big") + score.to_bytes(size, "big")
    if score < -_LONG - 1:
        return (0xFFFE - size).to_bytes(2, "big") + ((1 << 8 * size) + score).to_bytes(size, "big")
    return b"" if score > 0 else b"\xff\xff"


def _integers(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.vectorize(int, otypes=[object])(x)


def top_k(table: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """queries: a condition on the column `id`. Per query and rank: query_id, rank, vec_id, score."""
    spark = ship(table.sparkSession)
    rows = cut(_vectors(table, id_col, vector_col, scale))
    common = rows.groupBy("dim").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    main = rows.where(F.col("dim") == common["dim"])
    rotation = _rotation(_gram(main, scale))
    top = main.orderBy(F.desc("square"), "id").limit(HEAD).select("id", "v").collect()
    head_ids, head = np.array([r["id"] for r in top]), whole_numbers(np.array([r["v"] for r in top]), scale)
    lanes = tasks(spark)
    blocks = _packed(rows.repartitionByRange(lanes, "dim", F.desc("square"), "id").sortWithinPartitions("dim", F.desc("square"), "id"), BLOCK)
    blocks = blocks.select("dim", F.pmod(F.col("n") + F.shiftright("n", 32) * 7, F.lit(lanes)).alias("lane"), F.col("blob").alias("candidates"))
    asked = cut(_packed(rows.where(queries).sortWithinPartitions("dim"), QUERY_BLOCK))
    asked = asked.select("n", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"), F.col("blob").alias("queries"))

    def run(batches):
        floors: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column(0)[i].as_py()
                ids, raw = _open(batch.column(1)[i].as_py())
                x = whole_numbers(raw, scale)
                turn = rotation if x.shape[1] == len(rotation) else np.eye(x.shape[1])
                if number not in floors:
                    first = Searcher(ids, x, turn, k)
                    if x.shape[1] == len(rotation):
                        first.scan(head_ids, head)
                    floors[number] = first.threshold()
                search = Searcher(ids, x, turn, k, floors[number])
                names, y = _open(batch.column(2)[i].as_py())
                search.scan(names, whole_numbers(y, scale))
                yield search.rows()

    # Never a broadcast: a plan's estimate has the queries once, but every lane gets them, so the driver would hold them `lanes` times.
    met = blocks.repartition(lanes, "lane", "dim").join(asked.repartition(lanes, "lane", "dim").hint("merge"), ["lane", "dim"]).select("n", "queries", "candidates")
    found = met.mapInArrow(run, "query_id long, vec_id long, score long, beyond binary")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
