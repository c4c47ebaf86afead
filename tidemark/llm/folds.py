"""Bounded training samples with held-out folds, and calibration of scores, for the two classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Partitions of a training sample.
SAMPLE_PARTS = 16


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(modulus))


def _fitting(max_bytes: int):
    """Ids, in order, of the texts that fit into what those before them left of ``max_bytes``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = max_bytes
        for b in batches:
            fits = []
            for n in b.column("n").to_pylist():
                fits.append(n <= left)
                left -= n if fits[-1] else 0
            yield b.select(["_id"]).filter(pa.array(fits, pa.bool_()))

    return task


def training_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, held_out: int, max_docs: int, id_col: str, text_col: str, keep: list[str] = (), max_bytes: int = 64 << 20
) -> DataFrame:
    """_id, text, label and the columns ``keep`` of at most ``max_docs`` labelled documents outside the held-out fold, in the order of a hash of the id, and of at most ``max_bytes`` of text in all.

    A text that does not fit into what is left of ``max_bytes`` is left out, and those behind it still get their turn. The sample is the same for the same labels, whatever else the tables hold. Of several labels of an
    id the largest counts, and of several rows that share an id one; null labels and ids are left out.
    """
    known = labels.filter(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & (fold(id_col, modulus) != held_out))
    known = known.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    picked = known.groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    row = F.struct(F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`") for c in keep])
    held = docs.select(F.col(f"`{id_col}`").alias("_id"), row.alias("doc")).join(F.broadcast(picked), "_id")  # max_docs narrow rows
    one = materialize(held.groupBy("_id", "label").agg(F.min_by("doc", F.xxhash64("doc.text")).alias("doc")), "labelled")
    sizes = one.select("_id", F.octet_length(F.coalesce("doc.text", F.lit(""))).alias("n"), F.xxhash64("_id").alias("at"))
    fits = sizes.coalesce(1).sortWithinPartitions("at", "_id").mapInArrow(_fitting(max_bytes), f"_id {one.schema['_id'].dataType.simpleString()}")  # max_docs narrow rows
    bounded = one.join(F.broadcast(fits), "_id").select("_id", "label", "doc.*")
    return bounded.repartition(SAMPLE_PARTS, "_id")  # so that what is made of the sample is made in parallel and reaches the driver in small results


def platt(logits: np.ndarray, labels: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset that make sigmoid(slope * logit + offset) a probability; targets are smoothed, so the fit is finite."""
    pos, neg = labels.sum(), (1 - labels).sum()
    if not pos or not neg:
        return 1.0, 0.0
    y = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(np.std(logits)), 1e-6)
    x, a, b = logits / scale, 1.0, 0.0
    for _ in range(steps):  # Newton
        p = sigmoid(a * x + b)
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 1e-3 * a, (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a / scale), float(b)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
