"""Which columns are keys, and which columns of other tables refer to them.

One pass a table gives every column's counts, extremes and an estimate of its distinct values. Columns that may be unique
are counted exactly. A reference is worth a test where kinds agree, values lie within the key's range and
are no more than the keys; the test is a Bloom filter of fixed size for each key, through which every candidate column of a
table goes in one pass. What the filter lets through is settled by an exact anti join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a key's filter (1 MB), probes of a value, and key columns whose filters are held at once.
BITS, PROBES, KEYS_AT_ONCE = 1 << 23, 3, 32
#: How far an estimate of distinct values is trusted.
_ERROR = 0.05


@dataclass
class _Column:
    table: str
    name: str
    kind: str  # integer or text
    rows: int
    known: int
    distinct: int
    low: object
    high: object


def _text(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def _columns(tables: dict[str, DataFrame]) -> list[_Column]:
    out = []
    for table, df in tables.items():
        own = [(f.name, "integer" if isinstance(f.dataType, T.IntegralType) else "text") for f in df.schema if isinstance(f.dataType, (T.IntegralType, T.StringType))]
        if not own:
            continue
        asked = [F.count(F.lit(1)).alias("rows")]
        for i, (name, _) in enumerate(own):
            c = F.col(f"`{name}`")
            asked += [F.count(c).alias(f"known{i}"), F.approx_count_distinct(c, 0.02).alias(f"distinct{i}"), F.min(c).alias(f"low{i}"), F.max(c).alias(f"high{i}")]
        one = df.agg(*asked).first()
        out += [_Column(table, name, kind, one["rows"], one[f"known{i}"], one[f"distinct{i}"], one[f"low{i}"], one[f"high{i}"]) for i, (name, kind) in enumerate(own)]
    return out


def _keys(tables: dict[str, DataFrame], columns: list[_Column]) -> list[_Column]:
    """Columns without nulls and repeats, by an exact count of those that may be so."""
    found = []
    for c in columns:
        if c.rows and c.known == c.rows and c.distinct >= (1 - _ERROR) * c.rows:
            repeats = tables[c.table].groupBy(F.col(f"`{c.name}`")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            if repeats.isEmpty():
                found.append(c)
    return found


def _positions(hashes: np.ndarray) -> np.ndarray:
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) % np.uint64(BITS) for k in range(PROBES)]).astype(np.int64)


def _filter(df: DataFrame, name: str) -> np.ndarray:
    """The Bloom filter of a column, put together by bitmaps of some thousand bits; BITS / 8 bytes reach the driver."""

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_positions(b.column(0).to_numpy(zero_copy_only=False))) + 1)], names=["at"])

    places = df.select(F.xxhash64(_text(name)).alias("h")).mapInArrow(spots, "at long")
    maps = places.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    made = np.zeros(BITS, bool)
    for r in maps.collect():  # BITS / 32768 rows
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        made[(r["bucket"] - 1) * 32768 + np.flatnonzero(bits)] = True  # positions are counted from 1 there
    return made


def _misses(filters, pairs: list[tuple[int, int]]):
    """Rows of hashes, a column for each child: of each (child, key), values that are no key for certain, and all values."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, missed = filters.value, np.zeros(len(pairs), np.int64)
        for b in batches:
            at = {}
            for k, (child, key) in enumerate(pairs):
                if child not in at:
                    at[child] = _positions(b.column(child).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
                missed[k] += int((~held[key][at[child]].all(axis=0)).sum()) if at[child].size else 0
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pairs)), pa.int32()), pa.array(missed)], names=["pair", "missed"])

    return task


def _stem(name: str) -> str:
    """A column's name less the short prefix of its table."""
    head, _, rest = name.lower().partition("_")
    return rest if rest and len(head) <= 2 else name.lower()


def discover(tables: dict[str, DataFrame], tolerance: float = 0.05, by_name: bool = False) -> tuple[DataFrame, DataFrame]:
    """Keys (table, column, rows) and references (child, child_column, parent, parent_column, known, distinct_pct, orphans, orphan_pct).

    A key has no null and no repeat. A reference is a column of integers or texts of which at most ``tolerance`` of the known
    values are no value of the key; orphans counts exactly the rows whose value is none, nulls left out, and distinct_pct tells how much of the key is
    used, by estimate. Small numbers lie within many keys; with ``by_name`` only columns are paired whose
    names agree but for a prefix of one or two letters.
    """
    if not tables:
        raise ValueError("there are no tables")
    spark = next(iter(tables.values())).sparkSession
    columns = _columns(tables)
    keys = _keys(tables, columns)
    asked = [
        (c, k)
        for k in keys
        for c in columns
        if c.known and (c.table, c.name) != (k.table, k.name) and c.kind == k.kind and c.distinct <= k.rows * (1 + _ERROR) and (not by_name or _stem(c.name) == _stem(k.name))
        # what lies beyond the key's range is an orphan, and a column all of which does so is no reference
        and not (c.high < k.low or c.low > k.high) and (tolerance > 0 or k.low <= c.low and c.high <= k.high)
    ]
    likely = []
    for lo in range(0, len(keys), KEYS_AT_ONCE):
        some = [k for k in keys[lo : lo + KEYS_AT_ONCE] if any(k is p for _, p in asked)]
        filters = spark.sparkContext.broadcast([_filter(tables[k.table], k.name) for k in some])
        for table, df in tables.items():
            own = [(c, k) for c, k in asked if c.table == table and any(k is s for s in some)]
            if not own:
                continue
            names = list(dict.fromkeys(c.name for c, _ in own))
            pairs = [(names.index(c.name), next(i for i, s in enumerate(some) if s is k)) for c, k in own]
            hashed = df.select(*[F.when(F.col(f"`{n}`").isNotNull(), F.xxhash64(_text(n))).alias(f"h{i}") for i, n in enumerate(names)])
            counts = hashed.mapInArrow(_misses(filters, pairs), "pair int, missed long").groupBy("pair").agg(F.sum("missed").alias("missed")).collect()
            likely += [own[r["pair"]] for r in counts if r["missed"] <= tolerance * own[r["pair"]][0].known]
        filters.unpersist()
    found = []
    for c, k in sorted(likely, key=lambda p: (p[0].table, p[0].name, p[1].table, p[1].name)):
        values = tables[c.table].select(_text(c.name).alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))  # one row a value, so no value is a hot key
        orphans = values.join(tables[k.table].select(_text(k.name).alias("v")), "v", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if orphans <= tolerance * c.known:
            found.append((c.table, c.name, k.table, k.name, c.known, round(min(1.0, c.distinct / k.rows) * 100, 2), orphans, round(orphans / c.known * 100, 2)))
    schema = "child string, child_column string, parent string, parent_column string, known long, distinct_pct double, orphans long, orphan_pct double"
    return spark.createDataFrame([(k.table, k.name, k.rows) for k in keys], "table string, column string, rows long"), spark.createDataFrame(found, schema)
