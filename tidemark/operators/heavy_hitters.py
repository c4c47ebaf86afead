"""Most frequent values of many columns in two passes, without a shuffle of every distinct value.

Pass one keeps a bounded set of counters a column and task: where there are more values than counters,
the count of the first that has no place is taken off all, and what was taken off in all is the most by which a
counter, or a value without one, can fall short. Summed over tasks this bounds every value's count. Where
nothing was taken off the counters are the counts. Else the values that can be among the first are counted again, exactly, in pass two,
and where the bound does not rule out every value without a counter, the column is counted in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Counters a column and task; candidates a column up to which the second pass is worth while.
COUNTERS, CANDIDATES = 2048, 20_000
#: Fixed kinds of the summary's rows.
_COUNT, _SHORT, _TOTAL = 0, 1, 2


def _count(columns: int, counters: int):
    """Rows (i, kind, value, n) of a task: counters, how far they may fall short, and how many values there were."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = [{} for _ in range(columns)]
        short, total = [0] * columns, [0] * columns
        for b in batches:
            for i in range(columns):
                found = pc.value_counts(b.column(i).drop_null())
                own = held[i]
                for value, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True):
                    own[value] = own.get(value, 0) + n
                total[i] += b.num_rows - b.column(i).null_count
                if len(own) > counters:
                    cut = int(np.partition(np.fromiter(own.values(), np.int64, len(own)), len(own) - counters - 1)[len(own) - counters - 1])
                    short[i] += cut
                    held[i] = {v: n - cut for v, n in own.items() if n > cut}
        rows = [(i, _COUNT, v, n) for i in range(columns) for v, n in held[i].items()] + [(i, _SHORT, None, short[i]) for i in range(columns)] + [(i, _TOTAL, None, total[i]) for i in range(columns)]
        for lo in range(0, len(rows), 10_000):
            i, kind, value, n = zip(*rows[lo : lo + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(kind, pa.int32()), pa.array(value, pa.string()), pa.array(n, pa.int64())], names=["i", "kind", "value", "n"])

    return task


@dataclass
class Found:
    """rows: column, value, n, total, rank; ways: how each column's counts were had (counters, recount or full)."""

    rows: DataFrame
    ways: dict[str, str]


def heavy_hitters(df: DataFrame, names: list[str], k: int, counters: int = COUNTERS) -> Found:
    """The k most frequent values of each column as text, ties by value, with exact counts; nulls count for nothing.

    column, value, n long, total long (values that are not null), rank int. ``counters`` has to be at least k.
    """
    if counters < k:
        raise ValueError("fewer counters than values asked for")
    texts = df.select(*[F.col(f"`{n}`").cast("string").alias(f"c{i}") for i, n in enumerate(names)])
    tasks = texts.mapInArrow(_count(len(names), counters), "i int, kind int, value string, n long")
    summed = tasks.groupBy("i", "kind", "value").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("i", "kind").orderBy(F.desc("n"), "value")
    # what is asked of pass one: bounds, totals, and of each column as many counters as can matter
    first = summed.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= CANDIDATES + 1).groupBy("i").agg(
        F.max(F.when(F.col("kind") == _SHORT, F.col("n"))).alias("short"),
        F.max(F.when(F.col("kind") == _TOTAL, F.col("n"))).alias("total"),
        F.max(F.when((F.col("kind") == _COUNT) & (F.col("rank") == k), F.col("n"))).alias("least"),
        F.collect_list(F.when(F.col("kind") == _COUNT, F.struct("n", "value"))).alias("counted"),
    )
    ways, sure, again, full = {}, [], [], []
    totals = []
    for r in first.collect():  # a row for each column, of at most CANDIDATES counters
        name, short, least = names[r["i"]], r["short"], r["least"] or 0
        counted = sorted(((c["n"], c["value"]) for c in r["counted"]), key=lambda c: (-c[0], c[1]))
        totals.append((name, r["total"]))
        likely = [c for c in counted if c[0] + short >= least]
        if short == 0:
            ways[name] = "counters"
            sure += [(name, v, n) for n, v in counted[:k]]
        elif least > short and len(likely) <= CANDIDATES:
            ways[name] = "recount"
            again += [(r["i"], v) for _, v in likely]
        else:
            ways[name] = "full"
            full.append(r["i"])
    spark = df.sparkSession
    counts = spark.createDataFrame(sure, "column string, value string, n long")
    columns = F.array(*[F.lit(n) for n in names])

    def exploded(which: list[int]) -> DataFrame:
        long = texts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("value")) for i in which])).alias("t")).select("t.*")
        return long.filter(F.col("value").isNotNull())

    def summed_up(long: DataFrame) -> DataFrame:
        return long.groupBy("i", "value").agg(F.count(F.lit(1)).alias("n")).select(F.element_at(columns, F.col("i") + 1).alias("column"), "value", "n")

    if again:
        candidates = spark.createDataFrame(again, "i int, value string")
        counts = counts.unionByName(summed_up(exploded(sorted({i for i, _ in again})).join(F.broadcast(candidates), ["i", "value"], "left_semi")))
    if full:
        counts = counts.unionByName(summed_up(exploded(full)))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).filter(F.col("rank") <= k)
    whole = spark.createDataFrame(totals, "column string, total long")
    return Found(ranked.join(F.broadcast(whole), "column").select("column", "value", "n", "total", "rank"), ways)
