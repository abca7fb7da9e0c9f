"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is the logistic function of the summed weights of its
words and of their first letters (word families in languages that inflect); the document's is their noisy-or, 1 - prod(1 - p). Only documents have labels: the gradient of the bag's
likelihood spreads over its sentences, so the fitted weights locate the sentences that made a document toxic.
When scoring, sentences at or below `FLOOR` contribute nothing to the noisy-or, so that any number of sentences without
evidence leaves a text at 0.

The model is fitted on a labelled sample with texts of every length (see labelled.py) with an L1 penalty, which leaves a short list of
weighted words: that list, not the corpus, is what executors get. Every row's whole text is scored in one scan.

Null texts count as empty; an empty text has one empty sentence. Without any usable label all scores are 0. Repeated rows score alike; other columns are left alone.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, utf8
from .labelled import held_out, labelled_sample

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+").findall
#: The sample has so many rows of each label at most.
ROWS_OF_A_LABEL = 2000
#: A word is learnt when so many sample documents hold it, and the vocabulary has so many words at most.
LEAST_DOCUMENTS, MOST_WORDS, STEM = 3, 40_000, 4
#: A word of more than this part of the clean sample documents belongs to the language and isn't learnt.
MOST_USUAL = 0.05
#: The L1 penalty falls with the root of the sample's size.
PENALTY, STEPS, RATE, START = 3.4e-3, 300, 0.3, -5.0
THRESHOLD = 0.7
#: The logit up to which a sentence is no evidence (a probability of 0.047).
FLOOR = -3.0


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    stems: dict[str, float]

    def of_words(self, words: list[str]) -> float:
        return sum([w for w in map(self.weights.get, words) if w]) + sum([w for w in map(self.stems.get, [x[:STEM] for x in words]) if w])

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and probability of each sentence."""
        out = []
        for match in SENTENCE.finditer(text):
            score = self.bias + self.of_words(WORD(match[0].lower()))
            out.append((match.start(), match.end(), 1 / (1 + np.exp(-score))))
        return out

    def score(self, text: str) -> float:
        logits = np.array([self.of_words(WORD(part)) for part in SENTENCE.findall(text.lower())] or [0.0]) + self.bias
        return float(-np.expm1(-np.logaddexp(0, logits[logits > FLOOR]).sum()))  # 1 - prod(1 - sigmoid)


def loss_and_slopes(w: np.ndarray, bias: float, words: np.ndarray, of_sentence: np.ndarray, of_bag: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray, float]:
    """The weighted negative log-likelihood of the bags, and its slopes in the words' weights and the bias.

    words, of_sentence: a row for each word of a sentence; of_bag: each sentence's bag; y, share: each bag's label and weight.
    """
    logits = bias + np.bincount(of_sentence, w[words], len(of_bag))
    p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
    rest = np.exp(np.clip(np.bincount(of_bag, -np.logaddexp(0, logits), len(y)), -30, 0))  # the chance that no sentence is toxic
    pull = np.where(y == 1, -rest / np.maximum(1 - rest, 1e-9), 1.0) * share
    slope = pull[of_bag] * p
    loss = -float((share * np.where(y == 1, np.log(np.maximum(1 - rest, 1e-9)), np.log(rest))).sum())
    return loss, np.bincount(words, slope[of_sentence], len(w)), float(slope.sum())


def fit(sample: list[tuple[str, int]], weigh: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Proximal gradient with AdaGrad steps on the weighted likelihood of the bags."""
    number: dict[str, int] = {}
    seen, usual = array("i"), array("i")  # documents, and clean documents, with each word
    words, sizes, of_bag = array("i"), array("i"), array("i")  # numbers of each sentence's different words, one after the other
    for b, (text, label) in enumerate(sample):
        bag = set()
        for part in SENTENCE.findall(text.lower()) or [""]:
            found = WORD(part)
            names = {*found, *(x[:STEM] + "*" for x in found)}
            here = [number.setdefault(w, len(number)) for w in sorted(names)]
            words.extend(here)
            sizes.append(len(here))
            of_bag.append(b)
            bag.update(here)
        fresh = len(number) - len(seen)
        seen.extend([0] * fresh)
        usual.extend([0] * fresh)
        for i in bag:
            seen[i] += 1
            usual[i] += not label
    words, of_bag = np.array(words, np.int32), np.array(of_bag, np.int32)
    of_sentence = np.repeat(np.arange(len(of_bag), dtype=np.int32), np.array(sizes, np.int32))
    most = MOST_USUAL * sum(not label for _, label in sample)
    learnt = {w: i for w, i in number.items() if seen[i] >= LEAST_DOCUMENTS and usual[i] <= most}
    common = sorted(learnt, key=lambda w: (-seen[learnt[w]], w))[:MOST_WORDS]
    place = np.full(len(number), -1, np.int32)
    place[[learnt[w] for w in common]] = np.arange(len(common))
    del number, learnt
    words = place[words]
    words, of_sentence = words[words >= 0], of_sentence[words >= 0]
    y = np.array([label for _, label in sample], float)
    if not len(common) or y.min(initial=1) == y.max(initial=0):
        return Model(START, {}, {})
    share = np.where(y == 1, weigh[1], weigh[0])
    share = share / share.sum()
    penalty = PENALTY / len(y) ** 0.5
    w, bias, total, total_bias = np.zeros(len(common)), START, np.full(len(common), 1e-8), 1e-8
    for _ in range(STEPS):
        _, g, g_bias = loss_and_slopes(w, bias, words, of_sentence, of_bag, y, share)
        total, total_bias = total + g * g, total_bias + g_bias * g_bias
        rate = RATE / np.sqrt(total)
        w = w - rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        bias -= RATE / np.sqrt(total_bias) * g_bias
    found = {common[i]: float(w[i]) for i in np.flatnonzero(w)}
    return Model(float(bias), {k: v for k, v in found.items() if k[-1] != "*"}, {k[:-1]: v for k, v in found.items() if k[-1] == "*"})


def fit_model(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    return fit(*labelled_sample(docs, labels, label, id_col, text_col, ROWS_OF_A_LABEL))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = [shared.value.score(t.decode("utf-8", "replace")) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, score double")
    return rows.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def offending_sentences(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, start and end (code points) and probability of each sentence at or over the threshold.

    Null and empty texts have none; rows that repeat an id have theirs again; an empty table gives an empty result.
    """
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            rows = [(i.as_py(), s, e, float(p)) for i, t in zip(batch.column(0), utf8(batch.column(1))) for s, e, p in shared.value.sentences(t.decode("utf-8", "replace")) if p >= threshold]
            ids, starts, ends, ps = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(ps, pa.float64())], names=["id", "start", "end", "probability"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, start int, end int, probability double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs below the threshold, with all their columns, whatever their names. Null texts count as empty and stay; repeated rows stay or go together."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            keep = [shared.value.score(t.decode("utf-8", "replace")) < threshold for t in utf8(batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
