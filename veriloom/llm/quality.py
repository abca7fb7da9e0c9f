"""Quality by a generalised additive model with pairwise interactions.

Features of a text are cut into bins at quantiles of the sample. Boosting goes round the features in a cycle; each
turn fits a shallow tree (up to four leaves) to the current gradient of one feature and adds it to that feature's
lookup table. Then the pairs of features with the largest remaining gain get two-dimensional tables in the
same way, each turn a tree of one cut on either side. A score is the logistic function of the bias plus one table
entry for each feature and pair: vectorised bin additions over a batch of rows.

The model is fitted on a bounded labelled sample (labelled.py); what executors get is bin edges and tables. Every
row's whole text is measured. Null texts count as empty; an empty text has all features 0. Without usable labels
every score is 0.5. Repeated rows score alike; other columns are left alone.
"""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, utf8
from .labelled import held_out, labelled_sample

BINS, COARSE, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, RIDGE = 32, 8, 40, 20, 12, 0.15, 2.0
THRESHOLD = 0.5

_CLASS = np.zeros(256, np.intp)
for _n, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b"!?", b"|", b"#$%&*@^~=+<>{}[]\\/_", b"'\"-:;()"), 1):
    _CLASS[list(_chars)] = _n
_CLASS[0x80:0xC0], _CLASS[0xC0:] = 12, 13  # continuation and first bytes of other characters
FEATURES = ("lower", "upper", "digit", "space", "newline", "stop", "comma", "shout", "bar", "symbol", "mark", "foreign", "other", "length", "words", "word_length", "long_words", "distinct", "top_word", "repeated_lines", "lines", "packed", "capital_words")


def measure(raw: bytes) -> list[float]:
    """The features of a text of UTF-8 bytes, all defined for any text."""
    n = len(raw)
    counts = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=14) if n else np.zeros(14)
    points = max(1, n - counts[12])
    words = raw.split()
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(words))
    shares = [counts[c] / points for c in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 0)]
    sizes = [len(w) for w in words]
    return shares + [
        float(np.log1p(points)) if n else 0.0, float(np.log1p(len(words))), sum(sizes) / k, sum(s > 12 for s in sizes) / k,
        len(tally) / k, max(tally.values(), default=0) / k, 1 - len(set(lines)) / max(1, len(lines)), len(lines) / k,
        _packed(raw), sum(w[:1].isupper() for w in tally) / max(1, len(tally)),
    ]


def _packed(raw: bytes) -> float:
    """How far the whole text packs, as a mean over pieces of 64 KB."""
    if not raw:
        return 0.0
    return sum(len(zlib.compress(raw[i : i + 65536], 1)) for i in range(0, len(raw), 65536)) / len(raw)


def _segments(gain_of, g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values of a tree over ordered bins: the best cut again and again, up to so many leaves."""
    cuts, cg, ch = [0, len(g)], np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = gain_of(cg[m] - cg[a], ch[m] - ch[a]) + gain_of(cg[b] - cg[m], ch[b] - ch[m]) - gain_of(cg[b] - cg[a], ch[b] - ch[a])
                i = int(gain.argmax())
                best = max(best, (float(gain[i]), int(m[i])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return out


def _gain(g, h):
    return g * g / (h + RIDGE)


@dataclass
class Model:
    edges: list[np.ndarray] = field(default_factory=list)
    bias: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            z += table[b[:, j]]
        for i, j, table in self.pairs:
            z += table[_coarse(b[:, i]), _coarse(b[:, j])]
        return 1 / (1 + np.exp(-z))


def _coarse(b: np.ndarray) -> np.ndarray:
    return b * COARSE // BINS


def fit(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> Model:
    if not len(y) or y.min() == y.max():
        return Model()
    model = Model([np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])])
    share = share / share.mean()
    mean = np.average(y, weights=share)
    model.bias = float(np.log(mean / (1 - mean)))
    b, z = model.bins(x), np.full(len(y), model.bias)
    model.tables = [np.zeros(BINS) for _ in model.edges]

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return (p - y) * share, p * (1 - p) * share

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _segments(_gain, np.bincount(b[:, j], g, BINS), np.bincount(b[:, j], h, BINS), 4)
            table += step
            z += step[b[:, j]]
    g, h = slopes()
    gains = []
    for i, j in itertools.combinations(range(len(model.edges)), 2):
        cell = _coarse(b[:, i]) * COARSE + _coarse(b[:, j])
        gains.append((float(_gain(np.bincount(cell, g, COARSE**2), np.bincount(cell, h, COARSE**2)).sum()), i, j))
    model.pairs = [(i, j, np.zeros((COARSE, COARSE))) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            g, h = slopes()
            ci, cj = _coarse(b[:, i]), _coarse(b[:, j])
            step = RATE * _quadrants(np.bincount(ci * COARSE + cj, g, COARSE**2).reshape(COARSE, COARSE), np.bincount(ci * COARSE + cj, h, COARSE**2).reshape(COARSE, COARSE))
            table += step
            z += step[ci, cj]
    return model


def _quadrants(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of the tree that cuts either side once, where the four cells gain most."""
    pad = lambda a: np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    cg, ch = pad(g), pad(h)
    best, out = -1.0, np.zeros_like(g)
    for a, c in itertools.product(range(1, COARSE), repeat=2):
        cells = [(slice(p, q), slice(r, s)) for p, q in ((0, a), (a, COARSE)) for r, s in ((0, c), (c, COARSE))]
        sums = [[m[u.stop, v.stop] - m[u.start, v.stop] - m[u.stop, v.start] + m[u.start, v.start] for m in (cg, ch)] for u, v in cells]
        if (gain := sum(_gain(*s) for s in sums)) > best:
            best, out = gain, np.zeros_like(g)
            for cell, (sg, sh) in zip(cells, sums):
                out[cell] = -sg / (sh + RIDGE)
    return out


def fit_model(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    sample, weigh = labelled_sample(docs, labels, label, id_col, text_col, measure=measure)
    x = np.array([features for features, _ in sample]).reshape(-1, len(FEATURES))
    y = np.array([k for _, k in sample], float)
    return fit(x, y, np.where(y == 1, weigh[1], weigh[0]))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = np.array([measure(t) for t in utf8(batch.column(1))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x), pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, score double")
    return rows.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
