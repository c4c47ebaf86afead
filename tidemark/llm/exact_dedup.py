"""Exact deduplication by two passes over a Bloom filter.

Pass one notes, for every task, the bits of the hashes it has seen (``once``) and of those it has
seen again (``twice``); merged to bitmaps, ``twice`` also gets what two tasks share. Pass two tests each hash
against ``twice``: only rows that may be repeated shuffle, all others pass straight through.

A filter is at most ``filter_bytes`` large. Where the hashes need more, hash space is cut into that many
slices, and hashes lie in folders by slice. All slices are built in one job, which leaves their bitmaps in the shared
folder, and tested in another, whose tasks read the bitmap of the slice they hold. The driver sees none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_by_skewed_key, lower_az, materialize, mix, partitions, release, scratch_path, text_or_empty

#: Positions within a segment fit 16 bits.
_SEGMENT_BITS = 1 << 16
_LEAST_BITS = 1 << 19
_BITS_PER_ROW = 16
_PROBES = 3
FILTER_BYTES = 32 << 20
#: Segments of a slice's bitmap that are merged by one task and lie in one file (4 MB).
_FILE = 512
_PARTS = pa.schema([("slice", pa.int32()), ("segment", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """The _PROBES bit positions of each hash in a filter of ``size`` bits (a power of two)."""
    h = hashes.view(np.uint64)
    step = mix(h) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64(size - 1) for i in range(1, _PROBES + 1)]).astype(np.int64)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def _runs(slices: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(slice, from, to) of each run of rows of one slice."""
    cuts = np.concatenate([[0], np.flatnonzero(slices[1:] != slices[:-1]) + 1, [len(slices)]])
    yield from ((int(slices[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)


def _build(size: int):
    """Rows (slice, hash): the positions that each slice's hashes of a task set, by segment."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[np.ndarray]] = {}
        for b in batches:
            slices, hashes = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(2))
            for k, i, j in _runs(slices):
                seen.setdefault(k, []).append(hashes[i:j])
        for k, own in seen.items():
            values = np.sort(np.concatenate(own))
            again = values[1:] == values[:-1]
            fits = np.uint32 if size <= 1 << 32 else np.int64  # narrow numbers sort faster
            once, twice = (_distinct(_bits(v, size).astype(fits).reshape(-1)) for v in (values[np.append(True, ~again)], values[1:][again]))
            segments = _distinct(once // _SEGMENT_BITS).astype(np.int64)
            columns = [pa.array(np.full(len(segments), k, np.int32)), pa.array(segments)]
            for found in (once, twice):
                ends = np.append(np.searchsorted(found, segments * _SEGMENT_BITS), len(found)) * 2
                columns.append(pa.Array.from_buffers(pa.binary(), len(segments), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer((found % _SEGMENT_BITS).astype("<u2").tobytes())]))
            yield pa.RecordBatch.from_arrays(columns, schema=_PARTS)

    return task


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of positions come sorted by slice and segment; two bitmaps are held at a time. Gives the bitmap of twice."""
    at, once, twice = None, None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]]), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["slice", "segment", "twice"])

    for b in batches:
        for k, segment, o, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (k, segment) != at:
                if at is not None:
                    yield done()
                at, once, twice = (k, segment), np.zeros(_SEGMENT_BITS, bool), np.zeros(_SEGMENT_BITS, bool)
            o, t = np.frombuffer(o, "<u2"), np.frombuffer(t, "<u2")
            twice[o] |= once[o]
            once[o] = True
            twice[t] = True
    if at is not None:
        yield done()


def _bitmap(folder: str, k: int, size: int) -> np.ndarray:
    """A slice's bitmap, read in a task from the folder that all tasks share."""
    store, at = fs.FileSystem.from_uri(folder)
    twice = np.zeros(size // 8, np.uint8)
    for f in store.get_file_info(fs.FileSelector(f"{at}/slice={k}")):
        if f.path.endswith(".parquet"):
            with store.open_input_file(f.path) as source:
                rows = pq.ParquetFile(source).read(["segment", "twice"])
            for segment, bits in zip(rows.column("segment").to_pylist(), rows.column("twice").to_pylist(), strict=True):
                twice[segment * _SEGMENT_BITS // 8 :][: _SEGMENT_BITS // 8] = np.frombuffer(bits, np.uint8)
    return twice


#: The bitmap that this process read last, for its next task on the same slice.
_held: dict[tuple[str, int], np.ndarray] = {}


def _flag(folder: str, size: int, columns: list[str], only: bool):
    """Rows (slice, hash, columns): with maybe. A task holds the bitmap of one slice at a time."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, i, j in _runs(b.column("slice").to_numpy(zero_copy_only=False)):
                if (folder, k) not in _held:
                    _held.clear()
                    _held[folder, k] = _bitmap(folder, k, size)
                twice = _held[folder, k]
                part = b.slice(i, j - i)
                at = _bits(part.column("hash").to_numpy(zero_copy_only=False).astype(np.int64), size)
                hit = ((twice[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
                out = pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(hit, pa.bool_())], names=[*columns, "maybe"])
                yield out.filter(out.column("maybe")) if only else out

    return task


def possibly_repeated(hashes: DataFrame, rows: int, filter_bytes: int, only: bool = False) -> DataFrame:
    """``hashes`` (any columns beside hash long, slice int) with maybe boolean: false only for hashes that occur once; with ``only``, these are left out.

    Two jobs, however many slices there are: one writes the bitmaps of all slices to the shared folder,
    the other writes the rows with what the bitmaps say. The shared folder has to be one that Python reads
    too: a mounted one, HDFS or an object store.
    """
    spark = hashes.sparkSession
    columns = [f.name for f in hashes.schema if f.name not in ("hash", "slice")] + (["hash"] if only else [])
    schema = ", ".join(f"`{c}` {hashes.schema[c].dataType.simpleString()}" for c in columns)
    size = _LEAST_BITS
    while size < rows * _BITS_PER_ROW and size < filter_bytes * 8:
        size *= 2
    bitmaps = scratch_path(spark, "bitmaps")
    parts = hashes.select("slice", "hash").mapInArrow(_build(size), "slice int, segment long, once binary, twice binary")
    dealt = parts.repartition(partitions(spark), "slice", F.expr(f"segment div {_FILE}")).sortWithinPartitions("slice", "segment")
    dealt.mapInArrow(_merge, "slice int, segment long, twice binary").write.option("compression", "zstd").partitionBy("slice").parquet(bitmaps)
    rest = [f"`{c}`" for c in columns if c != "hash"]
    flagged = hashes.select("slice", "hash", *rest).mapInArrow(_flag(bitmaps, size, columns, only), f"{schema}, maybe boolean")
    path = scratch_path(spark, "flagged")
    writer = flagged.write.option("compression", "zstd")
    (writer if only else writer.partitionBy("maybe")).parquet(path)  # with only there is nothing to keep apart
    release(spark, [bitmaps])
    return spark.read.schema(f"{schema}, maybe boolean").parquet(path)


def slice_count(rows: int, filter_bytes: int) -> int:
    return max(1, -(-rows * _BITS_PER_ROW // (filter_bytes * 8)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per document: id, keep_id, group_size long, kept boolean, text_sha256 string.

    Texts are equal when identical after lowering A-Z only; null counts as empty. The row with the
    largest id of a group stays; a null id ranks below any other, and of rows that share text and id
    exactly one is kept. An empty table gives no rows. Other columns are never read.
    """
    spark = docs.sparkSession
    total = docs.count()
    text = lower_az(text_or_empty(text_col))
    hashed = (
        docs.select(F.col(f"`{id_col}`").alias("id"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
        .withColumn("hash", F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("long"))
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("slice", F.pmod(F.xxhash64("hash"), F.lit(slice_count(total, filter_bytes))).cast("int"))
    )
    hashed = materialize(hashed, "exact-hashes", ["slice"])
    flagged = possibly_repeated(hashed, total, filter_bytes)
    once = flagged.filter(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = flagged.filter("maybe").drop("maybe")
    best = F.max(F.struct("id", "row")).alias("best")
    groups = materialize(maybe.groupBy("text_sha256").agg(best, F.count(F.lit(1)).alias("group_size")), "exact-groups")
    joined = join_by_skewed_key(maybe, groups, ["text_sha256"], "group_size", total)
    repeated = joined.select("id", F.col("best.id").alias("keep_id"), "group_size", (F.col("best.row") == F.col("row")).alias("kept"), "text_sha256")
    return once.unionByName(repeated).withColumnRenamed("id", id_col)
