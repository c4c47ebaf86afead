"""Best-fit packing of token sequences, planned over the histogram of lengths.

Tasks encode documents, cut those longer than a sequence and number the pieces of each length within
the task. The driver gets one count for each length (at most ``capacity`` of them) and places counts,
longest first, into the fullest sequences that still have room. Its plan has a bounded number of slots
too: a slot is a run of ranks within a length and a run of sequences. Pieces then find their places by
joining on length and rank.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, text_or_empty
from tidemark.llm.tokens import crc, encode_column


class Slot(NamedTuple):
    """Ranks first_rank..end_rank - 1 of a length go to sequences from first_sequence on, per_sequence to each, from offset on."""

    length: int
    first_rank: int
    end_rank: int
    first_sequence: int
    per_sequence: int
    offset: int


def plan(counts: dict[int, int], capacity: int) -> list[Slot]:
    """Best fit over counts, longest pieces first."""
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs (first sequence, how many)
    keys: list[int] = []
    slots: list[Slot] = []
    made = 0

    def put(free: int, first: int, n: int) -> None:
        if free > 0 and n > 0:
            if free not in room:
                room[free] = []
                insort(keys, free)
            room[free].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(keys, length)
            if k < len(keys):
                free = keys[k]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free]
                    keys.pop(k)
            else:
                free, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            each = free // length
            full = min(n, left // each)
            if full:
                slots.append(Slot(length, rank, rank + full * each, first, each, capacity - free))
                put(free - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:
                slots.append(Slot(length, rank, rank + left, first + full, left, capacity - free))
                put(free - left * length, first + full, 1)
                put(free, first + full + 1, n - full - 1)
                left = 0
            elif full < n:
                put(free, first + full, n - full)
    return slots


def _ranks_within(values: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How often each value came before, here or in ``seen``, which is brought up to date."""
    order = np.argsort(values, kind="stable")
    own = values[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own)))) + seen[own]
    seen += np.bincount(values, minlength=len(seen))
    return out


def _pieces(tokenizer: str, capacity: int, end_id: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for i, j, ids, begin in encode_column(tokenizer, batch.column(1), end_id):
                n = np.diff(begin)
                each = -(-n // capacity)
                own = np.repeat(np.arange(j - i), each)
                piece = np.arange(len(own)) - np.repeat(np.cumsum(each) - each, each)
                head = n - (each - 1) * capacity
                start = np.where(piece > 0, head[own] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, head[own])
                at = begin[own] + start
                sums = [crc(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).take(pa.array(own)),
                        pa.array(piece.astype(np.int32)),
                        *(pa.array(x.astype(np.int64)) for x in (start, length, np.array(sums, np.int64))),
                        pa.array(np.full(len(own), part, np.int32)),
                        pa.array(_ranks_within(length, seen)),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"],
                )

    return task


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A text (null: empty) is its ids and ``end_id``; one longer than ``capacity`` is cut into pieces of
    that length, of which the first may be shorter. Strings of special tokens in a text become those
    tokens. Each row of a repeated id (of any type) is packed as a document of its own. No sequence holds more than ``capacity`` ids, and its pieces lie one after the other
    from 0. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, place long"
    pieces = materialize(rows.mapInArrow(_pieces(tokenizer, capacity, end_id), schema), "pieces")
    per_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    slots = spark.createDataFrame(plan(counts, capacity), "slot_length long, first_rank long, end_rank long, first_sequence long, per_sequence long, slot_offset long")
    before = per_part.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))
    found = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))
    nth = F.col("rank") - F.col("first_rank")
    return ranked.join(F.broadcast(slots), found).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.expr("(rank - first_rank) div per_sequence")).cast("long").alias("sequence_id"),
        (F.col("slot_offset") + nth % F.col("per_sequence") * F.col("length")).cast("long").alias("offset"),
    )
