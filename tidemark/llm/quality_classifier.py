"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are rows of the training folds labelled 1; the unlabelled sample is drawn from all
rows of the training folds.  With class prior p, the risk of a score function g is
``p * R+(g, 1) + max(0, R_u(g, 0) - p * R+(g, 0))``: the negative part is estimated from unlabelled
rows less the share of positives among them, and may not go below zero; when it does, the step climbs
back instead.  The prior is estimated as the share of 1 among the labelled rows of the training folds
(the only use of labels 0).  The scorer is a small network with one hidden layer over features of
shape: lengths, kinds of characters, repetition, variety.  Its weights are fitted with numpy on a
bounded sample (``POSITIVES`` and ``UNLABELLED`` rows by hash of id and text, whatever the size of the
table) and are the same for the same rows; every row is then scored in one pass without a shuffle.

Features see the text alone.  A null text counts as empty, and an empty text gets the score of its
all-zero features.  Labels without a document, null labels and repeated labels of the same value
change nothing; a document labelled both 0 and 1 is no positive.  Without any positive, every score is 0.5.  Extra
columns are ignored; repeated rows get equal scores, and as they share a hash they are chosen for a sample
together, as far as its bound allows.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.tables import by_batch, documents, held_out, keyed, table
from tidemark.session import stored

#: Bounds of the sample that the model is fitted on.
POSITIVES, UNLABELLED = 6_000, 12_000
#: Least score that counts as good.
ACCEPT = 0.7
HIDDEN, STEPS, RATE, DECAY, SEED = 16, 600, 0.02, 1e-4, 7
_TABLE = W.byte_map(W.SPACES, lower=False)
_CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)),
    "wide": bytes(range(0xC0, 0x100)), "stop": b".", "comma": b",", "call": b"!?", "bar": b"|", "quote": b"\"'`",
    "mark": b"#*$%&<>@^~=+_\\/", "bracket": b"()[]{}", "line": b"\n", "other": b":;-",
}
FEATURES = [*_CLASSES, "n_words", "length", "spread", "short", "long", "variety", "trigrams", "stay", "capital", "empty"]


def features(words: W.Words) -> np.ndarray:
    """One row of numbers per text of a block, each in about 0 to 1."""
    n_docs = len(words.bounds) - 1
    n_bytes = np.maximum(np.diff(words.bounds), 1)
    out = []
    for chars in _CLASSES.values():
        is_one = np.zeros(256, np.int64)
        is_one[list(chars)] = 1
        total = np.append(0, np.cumsum(is_one[words.raw]))
        out.append((total[words.bounds[1:]] - total[words.bounds[:-1]]) / n_bytes)
    n = words.counts
    some = np.maximum(n, 1)
    size = words.end - words.start

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(words.doc, x, n_docs) / some

    length = mean(size)
    h = words.hashes()

    def distinct(length: int) -> np.ndarray:
        seq = W.sequence_hashes(h, length)
        ok = W.inside(words, length)
        doc, seq = words.doc[:len(seq)][ok], seq[ok]
        order = np.lexsort((seq, doc))
        doc, seq = doc[order], seq[order]
        new = np.ones(len(seq), bool)
        new[1:] = (seq[1:] != seq[:-1]) | (doc[1:] != doc[:-1])
        return np.bincount(doc[new], minlength=n_docs) / np.maximum(n - length + 1, 1)

    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    first = words.raw[words.start] if len(words.start) else np.zeros(0, np.uint8)
    out += [np.log1p(n) / 10, length / 10, np.sqrt(np.maximum(mean(size * size) - length ** 2, 0)) / 10,
            mean(size <= 3), mean(size > 14), distinct(1) * np.log1p(n) / 10, distinct(3), mean(same),
            mean((first >= 65) & (first < 91)), (n == 0).astype(float)]
    return np.stack(out, 1).astype(np.float64)


@dataclass
class Scorer:
    """A network of one hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        w1, b1, w2, b2 = self.weights
        return 1 / (1 + np.exp(-np.clip(np.tanh(x @ w1 + b1) @ w2 + b2[0], -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Scorer:
    """Minimise the non-negative risk by Adam over the whole sample."""
    rng = np.random.default_rng(SEED)
    mean, scale = unlabelled.mean(0), np.maximum(unlabelled.std(0), 1e-3)
    xp, xu = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    w = [rng.normal(0, 0.3, (xp.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]

    def forward(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(x @ w[0] + w[1])
        return hidden, 1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3][0], -30, 30)))

    def back(x: np.ndarray, hidden: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        down = np.outer(slope, w[2]) * (1 - hidden ** 2)
        return [x.T @ down, down.sum(0), hidden.T @ slope, np.array([slope.sum()])]

    for t in range(1, STEPS + 1):
        hp, sp = forward(xp)
        hu, su = forward(xu)
        as_negative = -np.log(np.maximum(1 - su, 1e-12)).mean() + prior * np.log(np.maximum(1 - sp, 1e-12)).mean()
        unl, pos0, pos1 = su / len(su), sp / len(sp), (sp - 1) / len(sp)
        if as_negative >= 0:
            grads = [a + b for a, b in zip(back(xp, hp, prior * (pos1 - pos0)), back(xu, hu, unl))]
        else:
            grads = [-(a + b) for a, b in zip(back(xp, hp, -prior * pos0), back(xu, hu, unl))]
        rate = RATE * (1 - t / (STEPS + 1))
        for i, g in enumerate(grads):
            g = g + DECAY * w[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - rate * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
    return Scorer(mean, scale, w)


def _featured(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i, j, words in W.word_blocks(batch["text"], _TABLE):
        x = features(words)
        yield pa.RecordBatch.from_arrays(
            [batch["rk"].slice(i, j - i), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(
                pa.list_(pa.float64()))], names=["rk", "x"])


def _sample(rows: DataFrame, n: int, bound: int, salt: int) -> np.ndarray:
    """Features of at most ``bound`` of ``n`` rows, chosen by hash of their key.

    Repeated rows share a key, so any number of them may be chosen at once: they are cut to the bound by
    key in Spark, before anything comes to the driver.
    """
    share = min(1.0, bound / max(n, 1))
    mine = rows.filter(F.pmod(F.xxhash64("rk", F.lit(salt)), F.lit(1 << 24)) < F.lit(int(share * (1 << 24))))
    found = by_batch(mine.select("rk", "text"), _featured, "rk long, x array<double>")
    got = sorted((r.rk, r.x) for r in stored(found.orderBy("rk").limit(bound), "sample").collect())
    return np.array([x for _, x in got], np.float64).reshape(-1, len(FEATURES))


def learn(docs: DataFrame, labels: DataFrame) -> Scorer | None:
    """The scorer learnt from the training folds; None without a positive."""
    rows = keyed(docs).filter(~held_out(F.col("doc_id")))
    marks = (labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].alias("quality"))
             .filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
             .agg(F.min("quality").alias("least"), F.max("quality").alias("most")))
    labelled = rows.join(marks, "doc_id")
    n = labelled.agg(F.count("*").alias("n"), F.count_if(F.expr("least = 1 AND most = 1")).alias("good")).first()
    if not n.good:
        return None
    positive = _sample(labelled.filter("least = 1 AND most = 1"), n.good, POSITIVES, 1)
    unlabelled = _sample(rows, rows.count(), UNLABELLED, 2)
    return fit(positive, unlabelled, n.good / n.n)


def _scores(text: pa.Array, scorer: Scorer | None) -> np.ndarray:
    """Scores of a batch, rounded so that equal texts agree whatever their neighbours."""
    out = [np.full(j - i, 0.5) if scorer is None else scorer(features(words))
           for i, j, words in W.word_blocks(text, _TABLE)]
    return np.round(np.concatenate(out), 6)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` per document."""
    scorer = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        s = _scores(batch["text"], scorer.value)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["held_out"], pa.array(s), pa.array((s >= ACCEPT).astype(np.int32))],
            names=["doc_id", "held_out", "score", "predicted"])

    rows = keyed(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return by_batch(rows, work, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are accepted, with all their columns."""
    scorer = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array(_scores(batch["text"], scorer.value) >= ACCEPT))

    return by_batch(docs, work, docs.schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    return score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
