"""Token ids in ORC: ascending document ids over range-partitioned files, row indexes and Bloom filters.

Every row holds its part, its place there and the ids before it within the part, so a reader needs the
totals of the parts, but no row before its own: stripes are read in parallel, and a lookup by document
id skips files, stripes and row groups by their statistics and Bloom filters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, text_or_empty
from tidemark.llm.tokens import crc, encode_column

#: Fixed values of the format.
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(16 << 20),
}


def _encode(tokenizer: str, end_id: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for i, j, ids, begin in encode_column(tokenizer, batch.column(1), end_id):
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(j - i, part, np.int32)), pa.array(np.arange(place, place + j - i)), pa.array(before + begin[:-1]), batch.column(0).slice(i, j - i), lists],
                    names=["part", "place", "before", "doc_id", "ids"],
                )
                place, before = place + j - i, before + int(begin[-1])

    return task


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Encode each text (null: empty), add ``end_id``, and write ids in ascending id order to ORC files under ``path``.

    Rows that share an id (of any type that ORC holds and Spark orders) are all written, one after the other in any
    order; null ids come first. Strings of special tokens in a text become those tokens. An empty table gives a folder without rows. Columns other than the two named are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"))
    dealt = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    schema = f"part int, place long, before long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>"
    dealt.mapInArrow(_encode(tokenizer, end_id), schema).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """part, place, before, doc_id, ids as written; filters on doc_id prune files, stripes and row groups."""
    return spark.read.orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(3)
        at = np.asarray(lists.offsets)
        flat = lists.values.to_numpy(zero_copy_only=False)
        sums = [crc(flat[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], names=["part", "before", "doc_id", "n_tokens", "ids_crc32"]
        )


def token_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files at ``path``: doc_id, start (ids before it in the whole store), n_tokens, ids_crc32."""
    stored = read_tokens(spark, path)
    sums = stored.select("part", F.size("ids").alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    ahead = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))  # one row a file
    kind = stored.schema["doc_id"].dataType.simpleString()
    read = stored.select("part", "before", "doc_id", "ids").mapInArrow(_digest, f"part int, before long, doc_id {kind}, n_tokens long, ids_crc32 long")
    return read.join(ahead, "part").select("doc_id", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
