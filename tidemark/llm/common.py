"""What the training-data operators share: scratch tables, skew-safe joins and Arrow text buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as heavy from this share of all rows on, so there are at most 1/HEAVY_SHARE heavy keys.
HEAVY_SHARE = 1 / 2000

_written: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one, but only if all tasks run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder name in the shared folder."""
    return f"{scratch_dir(spark).rstrip('/')}/tidemark/{tag}-{uuid.uuid4().hex}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder name that written() lists."""
    _written.append(new_path(spark, tag))
    return _written[-1]


def materialize(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and outlives any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(_reordered(df, partition_by)).parquet(path)


def _reordered(df: DataFrame, partition_by: list[str] | None):
    names = [c for c in df.columns if c not in (partition_by or [])] + (partition_by or [])
    return df.select(*[F.col(f"`{c}`") for c in names]).schema


def written() -> list[str]:
    """Scratch folders written so far in this process, oldest first."""
    return list(_written)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch folders; call it only when no lazy result reads them any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        _written.remove(name)


def release_others(spark: SparkSession, before: list[str], *tags: str) -> None:
    """Delete what was written since ``before`` (an earlier written()), but for scratch tables of these tags."""
    release(spark, [p for p in _written if p not in before and not any(f"/tidemark/{t}-" in p for t in tags)])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_by_skewed_key(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int) -> DataFrame:
    """rows joined to groups (one row per key, with the key's row count in column ``size``).

    Keys with more than HEAVY_SHARE of ``total`` rows are at most 1/HEAVY_SHARE many, whatever the
    input, so that side is broadcast; the rows of all other keys shuffle in small groups.
    """
    limit = F.lit(max(1.0, total * HEAVY_SHARE))
    heavy = groups.filter(F.col(size) > limit)
    light = groups.filter(F.col(size) <= limit)
    spread = rows.join(F.broadcast(heavy.select(*key)), key, "left_anti").join(light.hint("shuffle_merge"), key)
    return rows.join(F.broadcast(heavy), key).unionByName(spread)


#: A side of at most so many narrow rows (some 50 bytes each) may be broadcast; larger ones shuffle.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if its counted rows are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def lower_az(text: Column) -> Column:
    """text with A-Z alone lowered. For a text of ASCII only that is what lower does, and faster than a map of letters."""
    mapped = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(mapped)


def slices(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths add up to at most ``limit``, or hold a single row."""
    ends = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, to
        at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins (n + 1 offsets); null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0]


_MULT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
#: Digits, letters and every byte of a character beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_powers = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        for name, m in (("up", _MULT), ("down", _INVERSE)):
            x = np.full(n + 1, m, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def prefix_hash(raw: np.ndarray, lower: bool = True) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64 of bytes, with A-Z lowered or as they are; see span_hash."""
    up, _ = powers(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(((_LOWER[raw] if lower else raw.astype(np.uint64)) + np.uint64(1)) * up[: len(raw)], out=out[1:])
    return out


#: A number for each byte, for a second hash that does not follow from the first.
_SCATTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def second_hash(raw: np.ndarray) -> np.ndarray:
    """Prefix sums like prefix_hash's, of other numbers: with both, span_hash tells spans apart by 128 bits."""
    up, _ = powers(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_SCATTER[raw] * up[: len(raw)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix) - 1)
    return mix((prefix[end] - prefix[start]) * down[start])


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts laid end to end: start and end byte, 64-bit hash (A-Z lowered), and each text's first word (n + 1)."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = _WORD[raw]
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = inside[:-1]
    before[at] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(raw) + 1, bool)
    after[:-1] = inside[1:]
    if len(at):
        cut = at[at > 0] - 1
        after[cut] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, span_hash(prefix_hash(raw), start, end), np.searchsorted(start, at)
