"""Exact ranks and quantiles over data of any size: counts of values, dealt by range, with running sums per range.

A built-in exact percentile keeps all distinct values of a column in one task. Here a column's values
are counted, cut into ranges at quantiles of a sample drawn by hash, and summed up within each range; only the sums
of the ranges are put in order together. Nothing is run when a plan is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import number

#: Ranges of a column's or group's values; each is sorted by a task that may spill.
RANGES = 64
#: Values of a key from which its ranges are cut.
SLOTS = 1024
#: Rows of a group whose median one task may find; there are at most a row in so many such groups beyond.
LARGE = 1_000_000


def edges(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _edges: RANGES - 1 values that cut a key's values into ranges of about as many.

    They come from at most SLOTS values of a key, in each slot of a hash the one with the least hash, and so
    are the same in every evaluation, however rows are dealt and in whatever order they arrive: a plan
    that reads them twice needs that, as does a task that is run again.
    """
    hashed = F.xxhash64("value")
    drawn = counts.groupBy(*keys, F.pmod(hashed, F.lit(SLOTS)).alias("_slot")).agg(F.min_by("value", hashed).alias("_value"))
    held = drawn.groupBy(*keys).agg(F.array_sort(F.collect_list("_value")).alias("_drawn"))  # SLOTS values a key
    at = [F.get("_drawn", F.floor(F.size("_drawn") * (i / RANGES)).cast("int")) for i in range(1, RANGES)]
    return held.select(*keys, F.array(*at).alias("_edges"))


def below(counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts (keys, value, n: a row for each value) with below: how many values of the key are smaller."""
    cut = edges(counts, keys)  # a row for each key: named columns, or groups of over LARGE rows
    parted = (counts.join(F.broadcast(cut), keys) if keys else counts.join(F.broadcast(cut))).withColumn("_part", F.size(F.filter("_edges", lambda e: e <= F.col("value")))).drop("_edges")
    sums = parted.groupBy(*keys, "_part").agg(F.sum("n").alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_part")
    ahead = sums.select(*keys, "_part", (F.sum("_n").over(order) - F.col("_n")).alias("_ahead"))  # a row for each range of a key
    inside = F.sum("n").over(Window.partitionBy(*keys, "_part").orderBy("value")) - F.col("n")
    return parted.withColumn("_inside", inside).join(F.broadcast(ahead), [*keys, "_part"]).withColumn("below", F.col("_ahead") + F.col("_inside")).drop("_part", "_inside", "_ahead")


def quantiles(df: DataFrame, names: list[str], probabilities: list[float]) -> DataFrame:
    """column and q: the exact quantiles, on the line between the neighbouring values, of up to a few dozen numeric columns."""
    return _quantiles(_counts(df, names), probabilities)


def quantiles_now(df: DataFrame, names: list[str], probabilities: list[float]) -> dict[str, list[float]]:
    """What quantiles finds, by column. It is run here, and keeps the counts of values meanwhile: five parts of its plan read them, and over a cached table Spark would count for each."""
    counts = _counts(df, names).persist()
    try:
        return {r["column"]: r["q"] for r in _quantiles(counts, probabilities).collect()}  # a row for each column
    finally:
        counts.unpersist()


def _counts(df: DataFrame, names: list[str]) -> DataFrame:
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), number(df, n).alias("value")) for n in names])).alias("c")).select("c.*").filter(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _quantiles(counts: DataFrame, probabilities: list[float]) -> DataFrame:
    placed = below(counts, ["column"])
    totals = counts.groupBy("column").agg((F.sum("n") - 1).alias("_last"))
    placed = placed.join(F.broadcast(totals), "column")

    def at(rank):
        return F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("n")), F.col("value")))

    picked, out = [], []
    for k, p in enumerate(probabilities):
        h = F.lit(p) * F.col("_last")
        picked += [at(F.floor(h)).alias(f"lo{k}"), at(F.ceil(h)).alias(f"hi{k}")]
        share = F.lit(p) * F.col("last") - F.floor(F.lit(p) * F.col("last"))
        out.append(F.col(f"lo{k}") * (1 - share) + F.col(f"hi{k}") * share)
    one = placed.groupBy("column").agg(F.max("_last").alias("last"), *picked)
    return one.select("column", F.array(*out).alias("q"))


def medians(rows: DataFrame, keys: list[str], large: int = LARGE) -> DataFrame:
    """keys, median: the exact median of rows (keys, value) by key, nulls left out.

    A group of up to ``large`` rows is held by one task. The values of a larger one are counted and
    dealt by range, so no task holds them; such groups are few, as each takes ``large`` rows.
    """
    known = rows.filter(F.col("value").isNotNull())
    wide = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > large).select(*keys)
    small = known.join(F.broadcast(wide), keys, "left_anti").groupBy(*keys).agg(F.median("value").alias("median"))
    counts = known.join(F.broadcast(wide), keys, "left_semi").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg((F.sum("n") - 1).alias("_last"))
    placed = below(counts, keys).join(F.broadcast(totals), keys)
    picked = [F.max(F.when((F.col("below") <= r) & (r < F.col("below") + F.col("n")), F.col("value"))) for r in (F.floor(F.col("_last") / 2), F.ceil(F.col("_last") / 2))]
    found = placed.groupBy(*keys).agg(picked[0].alias("_lo"), picked[1].alias("_hi"))
    return small.unionByName(found.select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias("median")))
