"""Root causes in combinations of dimensions, by a search of the lattice level by level.

Level one has a segment for each value of each dimension, level two for each pair of values of two
dimensions, and so on. Beside its change a segment carries the sum of all that its rows add and of all that they
take away. No part of it can change by more than the larger of the two, so once the change
that the best segments reach is known, a segment whose bound lies below has no children worth making. A
combination is made only of rows whose every shorter combination is still open; how many there were in
all, and how many were never made, is told for each level.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import kind, r2, r4
from tidemark.operators.rca import NO_CHANGE, SMALL, Analysis
from tidemark.sources.scratch import folder

#: Open segments of one level that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Room for rounding in sums: a bound counts as below the threshold only if it is so by this share.
_SLACK = 1e-9


@dataclass
class Level:
    """depth, segments made, those still open to children, and the change that the best ``top`` reached so far."""

    depth: int
    made: int
    open: int
    threshold: float


@dataclass
class Lattice:
    """segments: the best of all levels; levels: what the search did."""

    segments: DataFrame
    levels: list[Level]


def _value(analysis: Analysis, name: str) -> Column:
    c = F.col(f"`{name}`")
    text = F.when(c, "True").otherwise("False") if isinstance(kind(analysis.df, name), T.BooleanType) else c.cast("string")
    return F.when(c.isNotNull(), text).otherwise("Unknown")


def _key(parts: list[Column]) -> Column:
    """Values of a combination as one text; lengths keep different ones apart."""
    return F.concat_ws("", *[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts])


def search(analysis: Analysis, depth: int = 3, top: int = 10) -> Lattice:
    """The ``top`` segments of the largest change over combinations of one to ``depth`` dimensions.

    Columns: rank, depth, dimensions and segment (arrays of equal length), baseline, event, delta, growth_pct,
    contribution_pct, event_rows, baseline_rows. Order is by the change's size at four decimals, then the shorter combination, then
    dimensions and values. A null value is the value Unknown. Changes add up over segments for sum and
    count alone, so an average is refused.
    """
    if analysis.request.aggregation == "avg":
        raise ValueError("changes of an average do not add up over segments")
    if not analysis.dims:
        raise ValueError("there are no dimensions to explain by")
    if depth < 1 or top < 1:
        raise ValueError("depth and top must be at least 1")
    spark, dims = analysis.df.sparkSession, analysis.dims
    one = F.col("_metric") if analysis.request.aggregation == "sum" else F.lit(1.0)
    moved = F.when(F.col("_event"), one).otherwise(0.0) - F.when(F.col("_base"), one * analysis.scale).otherwise(0.0)
    rows = analysis.rows.select("_metric", "_event", "_base", moved.alias("_moved"), *[_value(analysis, n).alias(f"v{i}") for i, n in enumerate(dims)])
    gains, losses = F.sum(F.greatest("_moved", F.lit(0.0))), F.sum(F.greatest(-F.col("_moved"), F.lit(0.0)))
    sums = [analysis.of("base", F.col("_metric")).alias("b"), analysis.of("event", F.col("_metric")).alias("e"), F.count(F.when(F.col("_event"), 1)).alias("event_rows"), F.count(F.when(F.col("_base"), 1)).alias("baseline_rows"), F.greatest(gains, losses).alias("bound")]
    base = folder(spark, f"lattice-{uuid.uuid4().hex}")
    best, levels, still, threshold = None, [], {}, 0.0
    order = [F.desc(F.abs("delta")), "depth", "dimensions", "segment"]
    for d in range(1, min(depth, len(dims)) + 1):
        made = _level(rows, list(combinations(range(len(dims)), d)), still, sums)
        if made is None:
            break
        made.write.parquet(f"{base}/{d}")
        made = spark.read.parquet(f"{base}/{d}")
        names = F.transform("combination", lambda i: F.element_at(F.array(*[F.lit(n) for n in dims]), i + 1))
        told = made.select(F.lit(d).alias("depth"), names.alias("dimensions"), "segment", "b", "e", r4(F.col("e") - F.col("b")).alias("delta"), "event_rows", "baseline_rows")
        best = (told if best is None else best.unionByName(told)).orderBy(*order).limit(top)
        best.write.parquet(f"{base}/best{d}")
        best = spark.read.parquet(f"{base}/best{d}")
        count, least = best.agg(F.count(F.lit(1)), F.min(F.abs("delta"))).first()
        threshold = least if count == top else 0.0
        alive = made.filter(F.col("bound") >= threshold * (1 - _SLACK) - 1e-4)  # changes are compared at four decimals
        alive.select("combination", "key").write.parquet(f"{base}/open{d}")
        still = {"rows": spark.read.parquet(f"{base}/open{d}"), "count": 0, "depth": d}
        still["count"] = still["rows"].count()
        levels.append(Level(d, made.count(), still["count"], threshold))
    total = analysis.total()["delta"]
    share = F.lit(None).cast("double") if abs(total) < NO_CHANGE else r2((F.col("e") - F.col("b")) / F.lit(total) * 100)
    ranked = best.select(
        "depth", "dimensions", "segment", r4(F.col("b")).alias("baseline"), r4(F.col("e")).alias("event"), "delta", r2((F.col("e") - F.col("b")) / F.greatest(F.abs("b"), F.lit(SMALL)) * 100).alias("growth_pct"), share.alias("contribution_pct"), "event_rows", "baseline_rows"
    )
    by = F.sort_array(F.collect_list(F.struct((-F.abs("delta")).alias("_size"), *ranked.columns)))  # top rows
    placed = ranked.agg(by.alias("all")).select(F.posexplode("all").alias("at", "s")).select((F.col("at") + 1).alias("rank"), "s.*").drop("_size")
    return Lattice(placed, levels)


def _level(rows: DataFrame, combos: list[tuple[int, ...]], still: dict, sums: list[Column]) -> DataFrame | None:
    """Segments of one level: rows exploded to combinations, of which those with a closed parent are left out before they are summed."""
    values = lambda combo: [F.col(f"v{i}") for i in combo]
    measures = ["_metric", "_event", "_base", "_moved"]
    if still:
        live = {tuple(r[0]) for r in still["rows"].select("combination").distinct().collect()}  # a row for each combination of dimensions
        combos = [c for c in combos if all(p in live for p in combinations(c, len(c) - 1))]
    if not combos:
        return None
    one = [F.struct(F.array(*[F.lit(i) for i in c]).alias("combination"), F.array(*values(c)).alias("segment")) for c in combos]
    long = rows.select(*measures, F.explode(F.array(*one)).alias("_c")).select(*measures, "_c.combination", "_c.segment")
    if still:
        size = len(combos[0])
        opened = still["rows"].select(F.col("combination").alias("_of"), F.col("key").alias("_key"))
        opened = F.broadcast(opened) if still["count"] <= BROADCAST_ROWS else opened
        for left_out in range(size):
            at = [k for k in range(size) if k != left_out]
            parent = F.array(*[F.col("combination")[k] for k in at])
            long = long.join(opened, (F.col("_of") == parent) & (F.col("_key") == _key([F.col("segment")[k] for k in at])), "left_semi")
    made = long.groupBy("combination", "segment").agg(*sums)
    size = len(combos[0])
    return made.withColumn("key", _key([F.col("segment")[k] for k in range(size)]))
