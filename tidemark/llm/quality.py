"""Quality by supervised subword embeddings: hashed vectors of words and character n-grams, averaged, softmax output.

Words are runs of non-blank bytes; a word equal to the one before counts as a repeat mark. Character
n-grams are the three- and five-byte strings of the text, white space and punctuation included. Each
kind is averaged over the document, the averages are added, and a softmax over two classes follows.
Training is numpy stochastic gradient descent over a bounded sample. As the output is linear in the
averages, a trained vector acts on a score by one number, its projection on the difference of the two
output vectors, and that is what scoring looks up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix, prefix_hash, slices, span_hash, utf8
from tidemark.llm.folds import fold, platt, sigmoid, training_sample

BUCKETS, DIM, GRAMS = 1 << 16, 16, (3, 5)
KINDS = 1 + len(GRAMS)
REPEAT = 0
#: Bound of the training sample, documents.
MAX_DOCS = 5000
_BYTES = 400_000
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def featurize(raw: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind: buckets of all texts end to end, and where each text's begin (n + 1)."""
    prefix = prefix_hash(raw)
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = ~_BLANK[raw]
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = inside[:-1]
    before[at] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(raw) + 1, bool)
    after[:-1] = inside[1:]
    after[at[at > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    hashes, first = span_hash(prefix, start, end), np.searchsorted(start, at)
    ids = 1 + (hashes % np.uint64(BUCKETS - 1)).astype(np.int64)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[first[:-1][first[:-1] < len(hashes)]] = False
    ids[same] = REPEAT
    found = [(ids, first)]
    lengths = np.diff(at)
    for n in GRAMS:
        counts = np.maximum(lengths - n + 1, 0)
        begin = np.concatenate([[0], np.cumsum(counts)])
        places = np.arange(begin[-1]) + np.repeat(at[:-1] - begin[:-1], counts)
        packed = np.zeros(len(places), np.uint64)
        for j in range(n):
            packed = (packed << np.uint64(8)) | raw[places + j].astype(np.uint64)
        found.append(((mix(packed) % np.uint64(BUCKETS)).astype(np.int64), begin))
    return found


@dataclass
class Model:
    weights: np.ndarray  # a number for each kind and bucket
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    def logits(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.full(len(at) - 1, self.bias)
        for own, (ids, begin) in zip(self.weights, featurize(raw, at), strict=True):
            sums = np.concatenate([[0.0], np.cumsum(own[ids])])[begin]
            total += np.diff(sums) / np.maximum(np.diff(begin), 1)
        return total

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(at) - 1, self.constant)
        return sigmoid(self.slope * self.logits(raw, at) + self.offset)


def train(docs: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, seed: int = 11) -> Model:
    """docs: (bucket + kind * BUCKETS, share in the average of its kind, label). A fifth calibrates."""
    rng = np.random.default_rng(seed)
    labels = np.array([y for *_, y in docs])
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros((KINDS, BUCKETS)), 0.0, constant=float(labels[0]) if len(labels) else 0.0)
    table = (rng.normal(0, 0.05, (KINDS * BUCKETS, DIM))).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (2, DIM)).astype(np.float32), np.zeros(2, np.float32)
    order = rng.permutation(len(docs))
    held, fit = (order[: len(docs) // 5], order[len(docs) // 5 :]) if len(docs) >= 200 else (order, order)
    if labels[fit].min() == labels[fit].max():
        fit = order
    weight = np.array([len(fit) / (2 * max(1, (labels[fit] == y).sum())) for y in (0, 1)]) ** 0.5
    epochs = max(epochs, min(60, 24_000 // len(fit)))
    for epoch in range(epochs):
        rate = 0.5 * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            ids, share, y = docs[i]
            rows = table[ids]
            hidden = share @ rows
            odds = out @ hidden + bias
            p = np.exp(odds - odds.max())
            g = p / p.sum()
            g[y] -= 1
            g *= rate * weight[y]
            back = g @ out
            out -= np.outer(g, hidden)
            bias -= 0.1 * g
            # an average shares its gradient out thinly, so rare vectors would hardly move: steps are by the root of the share
            table[ids] = rows - np.sqrt(share)[:, None] * back * 0.5
    weights = (table @ (out[1] - out[0])).astype(np.float64).reshape(KINDS, BUCKETS)
    flat = weights.reshape(-1)
    logits = np.array([docs[i][1] @ flat[docs[i][0]] for i in held], np.float64) + float(bias[1] - bias[0])
    slope, offset = platt(logits, labels[held].astype(float))
    return Model(weights, float(bias[1] - bias[0]), slope, offset)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            ids, share = [], []
            for kind, (own, _) in enumerate(featurize(*utf8(b.column("text").slice(k, 1)))):
                unique, counts = np.unique(own, return_counts=True)
                ids.append((unique + kind * BUCKETS).astype(np.int32))
                share.append((counts / max(1, counts.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(share).tobytes()], pa.binary()), b.column("label").slice(k, 1), b.column("_id").slice(k, 1)],
                names=["ids", "share", "label", "id"],
            )


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", modulus: int = 5, held_out: int = 0, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on at most ``max_docs`` labelled documents, which the driver gets as buckets and shares."""
    sample = training_sample(docs, labels, label_col, modulus, held_out, max_docs, id_col, text_col)
    sample = sample.select(F.col("_id").cast("string").alias("_id"), "text", "label")
    rows = sample.mapInArrow(_features, "ids binary, share binary, label int, id string").collect()  # at most max_docs
    rows.sort(key=lambda r: (len(r["id"]), r["id"], r["ids"]))
    return train([(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["share"], np.float32), r["label"]) for r in rows])


def _score(model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            raw, at = utf8(b.column("text"))
            found = np.concatenate([m.scores(raw[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in slices(np.diff(at), _BYTES)]) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("kept"), pa.array(found)], names=["kept", "score"])

    return task


def scored(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """kept (a struct of the columns ``keep``, whatever their names) and score double: the probability of quality 1.

    Every whole text is scored; null counts as empty, and an empty text has the score of the output's
    bias. Without labels of both kinds all scores are that of the one kind (0 without any).
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), f"kept {rows.schema['kept'].dataType.simpleString()}, score double")


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, id_col: str = "doc_id") -> DataFrame:
    """The id column (of any type), score, held_out, for every row of docs."""
    found = scored(docs, fit(docs, labels, modulus=modulus, held_out=held_out, id_col=id_col), [id_col])
    found = found.select(F.col(f"kept.`{id_col}`").alias(id_col), "score")
    return found.withColumn("held_out", F.coalesce(fold(id_col, modulus) == held_out, F.lit(False)))
