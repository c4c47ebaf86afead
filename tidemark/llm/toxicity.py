"""Toxicity by a convolutional classifier: hashed word embeddings, filters of several widths, max pooling.

A word's embedding is the sum of hashed vectors of the word and of its first bytes, so unseen forms of
a known stem are near it. Filters one to three words wide run over the whole text; the largest answer
of each filter feeds a logistic output. Training is numpy on the driver over a bounded sample; scores
are calibrated on a part of it, and so is, for each language, the threshold from which a document
counts as toxic. The language picks a threshold only; it never enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, span_hash, prefix_hash, utf8, words
from tidemark.llm.folds import fold, platt, sigmoid, training_sample

BUCKETS, DIM, FILTERS, WIDTHS, STEMS = 1 << 16, 16, 8, (1, 2, 3), (4, 6)
PAD = BUCKETS
#: Bound of the training sample, documents.
MAX_DOCS = 6000
_BYTES = 400_000
#: Words whose answers training holds at once.
_WORDS = 16_384
_TAPS, _PADDING = sum(WIDTHS), max(WIDTHS) - 1


def featurize(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (one row for a word, a column for the word and each stem) of texts end to end; each text is followed
    by padding as long as the widest filter less one word. Also where each text begins (n + 1)."""
    start, end, hashes, first = words(raw, at)
    prefix = prefix_hash(raw)
    columns = [hashes] + [span_hash(prefix, start, np.minimum(start + n, end)) ^ np.uint64(n) for n in STEMS]
    ids = np.stack([(c % np.uint64(BUCKETS)).astype(np.int32) for c in columns], axis=1)
    counts = np.diff(first)
    begin = np.concatenate([[0], np.cumsum(counts + _PADDING)])
    out = np.full((int(begin[-1]), len(columns)), PAD, np.int32)
    out[np.arange(len(ids)) + np.repeat(begin[:-1] - first[:-1], counts)] = ids
    return out, begin


@dataclass
class Model:
    table: np.ndarray
    taps: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None
    threshold: float = 0.7
    thresholds: dict[str, float] = field(default_factory=dict)

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        x = self.table[ids[:, 0]]
        for c in range(1, ids.shape[1]):
            x += self.table[ids[:, c]]
        return x

    def answers(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.vectors(ids)
        a = x @ self.taps
        z, tap = np.empty((len(ids), FILTERS * len(WIDTHS)), np.float32), 0
        for k, width in enumerate(WIDTHS):
            own = z[:, k * FILTERS : (k + 1) * FILTERS]
            own[:] = a[:, tap * FILTERS : (tap + 1) * FILTERS]
            for j in range(1, width):
                own[:-j] += a[j:, (tap + j) * FILTERS : (tap + j + 1) * FILTERS]
            tap += width
        return x, z

    def logits(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        pooled = np.empty((len(begin) - 1, FILTERS * len(WIDTHS)), np.float32)
        for k in range(len(begin) - 1):  # a text at a time; a long one in overlapping pieces
            best = None
            for lo in range(begin[k], max(begin[k] + 1, begin[k + 1] - _PADDING), 50_000):
                z = self.answers(ids[lo : min(begin[k + 1], lo + 50_000 + _PADDING)])[1]
                top = z[: max(1, len(z) - _PADDING)].max(axis=0)
                best = top if best is None else np.maximum(best, top)
            pooled[k] = best
        return (np.maximum(pooled + self.bias, 0) @ self.out).astype(np.float64) + self.out_bias

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(at) - 1, self.constant)
        return sigmoid(self.slope * self.logits(*featurize(raw, at)) + self.offset)


def _peaks(model: Model, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Highest answer of each filter in each text, and the word where it starts; some thousand words are held at once."""
    ends = np.maximum(begin[:-1] + 1, begin[1:] - _PADDING)
    best, where = np.full((len(ends), FILTERS * len(WIDTHS)), -np.inf, np.float32), np.zeros((len(ends), FILTERS * len(WIDTHS)), np.int64)
    for lo in range(0, len(ids), _WORDS):
        z = model.answers(ids[lo : lo + _WORDS + _PADDING])[1]
        for k in range(np.searchsorted(ends, lo, side="right"), np.searchsorted(begin[:-1], lo + _WORDS)):
            a = max(begin[k], lo)
            part = z[a - lo : min(ends[k], lo + _WORDS) - lo]
            top = part.max(axis=0)
            better = top > best[k]
            best[k, better], where[k, better] = top[better], a + part.argmax(axis=0)[better]
    return best, where


def train(texts: list[tuple[np.ndarray, int, str]], steps: int = 600, batch: int = 64, seed: int = 7) -> Model:
    """texts: (buckets of one padded text, label, language). Adam on logistic loss; a fifth calibrates."""
    rng = np.random.default_rng(seed)
    labels = np.array([y for _, y, _ in texts])
    model = Model(
        (rng.normal(0, 0.02, (BUCKETS + 1, DIM))).astype(np.float32),
        (rng.normal(0, 0.3, (DIM, _TAPS * FILTERS))).astype(np.float32),
        np.zeros(FILTERS * len(WIDTHS), np.float32),
        (rng.normal(0, 0.3, FILTERS * len(WIDTHS))).astype(np.float32),
    )
    model.table[PAD] = 0
    if not len(labels) or labels.min() == labels.max():
        model.constant = float(labels[0]) if len(labels) else 0.0
        return model
    order = rng.permutation(len(texts))
    held = order[: len(texts) // 5] if len(texts) >= 1000 else order
    fit = order[len(texts) // 5 :] if len(texts) >= 1000 else order
    by_label = [fit[labels[fit] == y] for y in (0, 1)]
    if any(not len(x) for x in by_label):
        by_label = [order[labels[order] == y] for y in (0, 1)]
    dense = {k: [np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))] for k in ("taps", "bias", "out")}
    sq, rate = np.zeros(BUCKETS + 1, np.float32), 0.01
    column = np.arange(FILTERS)
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(by_label[y], batch // 2) for y in (0, 1)])
        y = labels[chosen]
        ids = np.concatenate([texts[i][0] for i in chosen])
        begin = np.concatenate([[0], np.cumsum([len(texts[i][0]) for i in chosen])])
        pooled, where = _peaks(model, ids, begin)
        pooled += model.bias
        active = np.maximum(pooled, 0)
        d = (sigmoid((active @ model.out + model.out_bias).astype(np.float64)) - y).astype(np.float32) / batch
        back = d[:, None] * model.out * (pooled > 0)
        grads = {"out": active.T @ d, "bias": back.sum(axis=0), "taps": np.zeros_like(model.taps)}
        rows, row_grads, tap = [], [], 0
        for k, width in enumerate(WIDTHS):
            own, at = back[:, k * FILTERS : (k + 1) * FILTERS], where[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(width):
                cols = (tap + j) * FILTERS + column
                grads["taps"][:, cols] = np.einsum("bf,bfd->df", own, model.vectors(ids[(at + j).reshape(-1)]).reshape(*at.shape, DIM))
                rows.append(ids[at + j].reshape(-1, ids.shape[1]))
                row_grads.append((own[:, :, None] * model.taps[:, cols].T).reshape(-1, DIM))
            tap += width
        pace = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for name, g, (m, v) in [*((k, grads[k] + 1e-4 * getattr(model, k), dense[k]) for k in dense)]:
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            getattr(model, name)[...] -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        model.out_bias -= float(pace * d.sum())
        flat, g = np.concatenate(rows), np.concatenate(row_grads)
        live = np.flatnonzero(np.abs(g).max(axis=1) > 0)
        for c in range(flat.shape[1]):
            unique, inverse = np.unique(flat[live, c], return_inverse=True)
            total = np.zeros((len(unique), DIM), np.float32)
            np.add.at(total, inverse, g[live])
            sq[unique] += (total * total).mean(axis=1)
            model.table[unique] -= (8 * pace / np.sqrt(sq[unique] + 1e-8))[:, None] * total
        model.table[PAD] = 0
    sums = np.array([model.logits(texts[i][0], np.array([0, len(texts[i][0])]))[0] for i in held], np.float64)
    model.slope, model.offset = platt(sums, labels[held].astype(float))
    scores = sigmoid(model.slope * sums + model.offset)
    model.threshold = _threshold(scores, labels[held])
    languages = np.array([texts[i][2] or "" for i in held])
    for lang in np.unique(languages):
        own = languages == lang
        if min(labels[held][own].sum(), (1 - labels[held][own]).sum()) >= 10:
            model.thresholds[str(lang)] = _threshold(scores[own], labels[held][own])
    return model


def _threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """From 0.5 to 0.9, where most labels are met; the middle of the best range."""
    cuts = np.linspace(0.5, 0.9, 41)
    right = np.array([((scores >= c) == labels).sum() for c in cuts])
    return float(np.median(cuts[right == right.max()]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            ids, _ = featurize(*utf8(b.column("text").slice(k, 1)))
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), b.column("label").slice(k, 1), b.column("lang").slice(k, 1), b.column("_id").slice(k, 1)], names=["ids", "label", "lang", "id"])


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", modulus: int = 3, held_out: int = 1, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang"
) -> Model:
    """Train on at most ``max_docs`` labelled documents, which the driver gets as word buckets. Without a language column there is one threshold for all."""
    lang = F.lit(None) if lang_col is None or lang_col not in docs.columns else F.col(f"`{lang_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), lang.cast("string").alias("_lang"))
    sample = training_sample(rows.withColumnRenamed("_id", id_col), labels, label_col, modulus, held_out, max_docs, id_col, "_text", ["_lang"])
    sample = sample.select(F.col("_id").cast("string").alias("_id"), "text", "label", F.col("_lang").alias("lang"))
    got = sample.mapInArrow(_features, "ids binary, label int, lang string, id string").collect()  # at most max_docs
    got.sort(key=lambda r: (len(r["id"]), r["id"], r["ids"]))
    return train([(np.frombuffer(r["ids"], np.int32).reshape(-1, 1 + len(STEMS)), r["label"], r["lang"]) for r in got])


def _score(model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            raw, at = utf8(b.column("text"))
            found = np.concatenate([m.scores(raw[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in slices(np.diff(at), _BYTES)]) if b.num_rows else np.zeros(0)
            limit = np.array([m.thresholds.get(x, m.threshold) for x in b.column("lang").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column("kept"), pa.array(found), pa.array(limit)], names=["kept", "score", "threshold"])

    return task


def scored(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """kept (a struct of the columns ``keep``, whatever their names), score double, threshold double (of the row's language; the overall one where that is unknown).

    Every whole text is scored; null counts as empty, and a text without words gets the score of
    padding alone. Without labels of both kinds all scores are that of the one kind (0 without any).
    """
    lang = F.lit(None) if lang_col is None or lang_col not in docs.columns else F.col(f"`{lang_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{text_col}`").cast("string").alias("text"), lang.cast("string").alias("lang"))
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), f"kept {rows.schema['kept'].dataType.simpleString()}, score double, threshold double")


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, id_col: str = "doc_id") -> DataFrame:
    """The id column (of any type), held_out, score, threshold, for every row of docs."""
    found = scored(docs, fit(docs, labels, modulus=modulus, held_out=held_out, id_col=id_col), [id_col])
    found = found.select(F.col(f"kept.`{id_col}`").alias(id_col), "score", "threshold")
    return found.withColumn("held_out", F.coalesce(fold(id_col, modulus) == held_out, F.lit(False)))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold of their language."""
    return scored(docs, fit(docs, labels), docs.columns).filter(F.col("score") < F.col("threshold")).select("kept.*")
