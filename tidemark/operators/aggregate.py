"""Aggregation, overview, breakdown, cross-tabulation and correlation."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import aggregate_of, is_moment, is_numeric, kind, moment, number, r2, r4
from tidemark.functions.quantiles import below, medians, quantiles
from tidemark.operators.filters import apply_filters, require
from tidemark.operators.heavy_hitters import heavy_hitters
from tidemark.plans.requests import AggregationQuery, BreakdownQuery, CrossTabQuery, Metric

#: Fixed values of the interface.
MAX_AXIS, MAX_COLUMNS, TOP_CATEGORIES, DIMENSIONS = 50, 50, 10, 5
DATE_NAME = r"(?i)(date|time|created|updated|launched|timestamp|period|dob|registered|_at)"


def check_metrics(df: DataFrame, metrics: list[Metric]) -> None:
    """Sums and the like need numbers, extremes numbers, dates or text that is mostly numbers; anything can be counted."""
    require(df, [m.column for m in metrics])
    for m in metrics:
        dtype = kind(df, m.column)
        if m.aggregation == "count" or is_numeric(dtype) or m.aggregation in ("min", "max") and is_moment(dtype):
            continue
        if m.aggregation in ("min", "max") and isinstance(dtype, T.StringType):
            share = df.filter(F.col(m.column).isNotNull()).agg(F.avg(number(df, m.column).isNotNull().cast("double"))).first()[0]
            if (share or 0) >= 0.7:
                continue
        raise ValueError(f"{m.aggregation} of {m.column} needs numbers")


def _grouped_value(df: DataFrame, m: Metric) -> Column:
    value = aggregate_of(F.col(f"`{m.column}`") if m.aggregation == "count" or is_moment(kind(df, m.column)) else number(df, m.column), m.aggregation)
    if m.aggregation == "count" or is_moment(kind(df, m.column)):
        return value
    return r4(F.coalesce(value, F.lit(0.0)) if m.aggregation == "sum" else value)


def _scalar_value(df: DataFrame, m: Metric) -> Column:
    value = F.count(F.col(f"`{m.column}`")).cast("double") if m.aggregation == "count" else aggregate_of(number(df, m.column), m.aggregation)
    return r4(F.coalesce(value, F.lit(0.0)))


def _grouped(kept: DataFrame, keys: dict[str, Column], metrics: list[Metric]) -> DataFrame:
    """keys and a column for each metric; medians are found apart, where no task has to hold a group, and joined."""
    middle = [m for m in metrics if m.aggregation == "median" and not is_moment(kind(kept, m.column))]
    plain = [m for m in metrics if m not in middle]
    if not middle:
        return kept.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*[_grouped_value(kept, m).alias(m.label) for m in plain])
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(keys.values())]).alias("_key")  # nulls within a struct are equal
    made = kept.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), *[_grouped_value(kept, m).alias(m.label) for m in plain])
    for m in middle:
        found = medians(kept.select(key, number(kept, m.column).alias("value")), ["_key"])
        made = made.join(found.select("_key", r4(F.col("median")).alias(m.label)), "_key", "left")
    return made.select(*[F.col(f"_key.k{i}").alias(k) for i, k in enumerate(keys)], *[F.col(f"`{m.label}`") for m in metrics])


def groups(df: DataFrame, query: AggregationQuery) -> DataFrame:
    """All groups before paging. Null keys form groups; without dimensions there is one row, or none without rows."""
    require(df, query.dimensions)
    check_metrics(df, query.metrics)
    kept = apply_filters(df, query.filters)
    if not query.dimensions:
        plain = [m for m in query.metrics if m.aggregation != "median"]
        one = kept.agg(*[_scalar_value(kept, m).alias(m.label) for m in plain], F.count(F.lit(1)).alias("_rows")).filter("_rows > 0").drop("_rows")
        middle = [m for m in query.metrics if m.aggregation == "median"]
        if middle:
            halves = quantiles(kept, list(dict.fromkeys(m.column for m in middle)), [0.5])
            found = halves.agg(*[F.coalesce(r4(F.max(F.when(F.col("column") == m.column, F.col("q")[0]))), F.lit(0.0)).alias(m.label) for m in middle])
            one = one.join(F.broadcast(found))  # one row
        return one.select(*[F.col(f"`{m.label}`") for m in query.metrics])
    return _grouped(kept, {d: F.col(f"`{d}`") for d in query.dimensions}, query.metrics)


def aggregate(df: DataFrame, query: AggregationQuery) -> DataFrame:
    """A page of groups: sorted, nulls last, ties by the dimensions."""
    made = groups(df, query)
    by = query.sort_by or query.metrics[0].label
    require(made, [by])
    key = F.col(f"`{by}`")
    order = [key.desc_nulls_last() if query.descending else key.asc_nulls_last()] + [F.col(f"`{d}`").asc_nulls_last() for d in query.dimensions if d != by]
    return made.orderBy(*order).offset(query.offset).limit(query.limit)


def total_rows(df: DataFrame, query: AggregationQuery) -> DataFrame:
    return groups(df, query).agg(F.count(F.lit(1)).alias("total_rows"))


def rollup(df: DataFrame, dimensions: list[str], metrics: list[Metric], cube: bool = False) -> DataFrame:
    """Subtotals of every leading list of dimensions, or of every set of them; level tells which are summed over."""
    made = df.cube(*dimensions) if cube else df.rollup(*dimensions)
    return made.agg(F.grouping_id().alias("level"), *[_grouped_value(df, m).alias(m.label) for m in metrics])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)][:MAX_COLUMNS]


def default_correlation_columns(df: DataFrame) -> list[str]:
    """What is correlated where no columns are named: the first eight numeric ones."""
    return [n for n in numeric_columns(df) if not isinstance(kind(df, n), T.BooleanType)][:8]


def date_column(df: DataFrame) -> str | None:
    """The first column with a date's type, or text with a date's name; numbers are never dates."""
    import re

    return next((f.name for f in df.schema if is_moment(f.dataType) or isinstance(f.dataType, T.StringType) and re.search(DATE_NAME, f.name)), None)


def categorical_columns(df: DataFrame) -> list[str]:
    chosen = date_column(df)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != chosen][:DIMENSIONS]


def overview_numeric(df: DataFrame) -> DataFrame:
    """column, sum, mean, median, min, max, std of every numeric column: one pass over the rows, and exact medians."""
    names = numeric_columns(df)
    how = ("sum", "mean", "min", "max", "std")
    one = df.agg(*[r4(F.coalesce(aggregate_of(number(df, n), h), F.lit(0.0))).alias(f"{i}_{h}") for i, n in enumerate(names) for h in how])
    rows = F.array(*[F.struct(F.lit(n).alias("column"), *[F.col(f"{i}_{h}").alias(h) for h in how]) for i, n in enumerate(names)])
    medians = quantiles(df, names, [0.5])
    joined = one.select(F.inline(rows)).join(F.broadcast(medians), "column", "left")  # a row for each column
    return joined.select("column", "sum", "mean", r4(F.coalesce(F.col("q")[0], F.lit(0.0))).alias("median"), "min", "max", "std")


def overview_temporal(df: DataFrame) -> DataFrame:
    """date_column, min_date, max_date, range_days of the first date column."""
    name = date_column(df)
    if name is None:
        return df.sparkSession.createDataFrame([], "date_column string, min_date date, max_date date, range_days int")
    when = moment(df, name)
    one = df.agg(F.min(when).alias("lo"), F.max(when).alias("hi"))
    seconds = F.unix_seconds(F.col("hi").cast("timestamp")) - F.unix_seconds(F.col("lo").cast("timestamp"))
    return one.select(F.lit(name).alias("date_column"), F.to_date("lo").alias("min_date"), F.to_date("hi").alias("max_date"), F.floor(seconds / 86400).cast("int").alias("range_days"))


def value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """column, value, n of every non-null value; counted in one shuffle with partial sums."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").cast("string").alias("value")) for n in names])).alias("c")).select("c.*")
    return long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_categories(df: DataFrame, names: list[str], k: int = TOP_CATEGORIES) -> DataFrame:
    """column, value, n, pct of non-null, rank: the k most frequent values of each column."""
    return heavy_hitters(df, names, k).rows.select("column", "value", "n", r2(F.col("n") / F.col("total") * 100).alias("pct"), "rank")


def breakdown(df: DataFrame, query: BreakdownQuery) -> DataFrame:
    """category, value, pct of the top groups, the rest as Other if asked for. Null categories are left out."""
    require(df, [query.dimension])
    kept = apply_filters(df, query.filters)
    kept = kept.filter(F.col(f"`{query.dimension}`").isNotNull())
    if query.metric:
        check_metrics(df, [query.metric])
    category = F.col(f"`{query.dimension}`").cast("string")
    if query.metric is None:
        made = kept.groupBy(category.alias("category")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    else:
        made = _grouped(kept, {"category": category}, [query.metric]).toDF("category", "value").select("category", F.col("value").cast("double").alias("value"))
    made = made.filter(F.col("value").isNotNull())
    total = made.agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n_groups"))
    top = made.orderBy(F.desc("value"), "category").limit(query.top_n)
    rows = top
    if query.include_other:
        shown = top.agg(F.sum("value").alias("shown"))
        rest = total.join(F.broadcast(shown)).filter(F.col("n_groups") > query.top_n).select(F.lit("Other").alias("category"), r4(F.col("total") - F.col("shown")).alias("value"))  # one row each
        rows = top.unionByName(rest)
    whole = F.greatest(F.lit(1e-9), F.col("total"))
    return rows.join(F.broadcast(total)).select("category", r4(F.col("value")).alias("value"), r2(r4(F.col("value")) / whole * 100).alias("pct"))


def crosstab(df: DataFrame, query: CrossTabQuery) -> DataFrame:
    """row, column, value for every pair of labels; pairs without rows are 0. More than 50 labels on an axis are refused."""
    require(df, [query.row, query.column])
    kept = apply_filters(df, query.filters)
    kept = kept.filter(F.col(f"`{query.row}`").isNotNull() & F.col(f"`{query.column}`").isNotNull())
    named = kept.withColumns({"_row": F.col(f"`{query.row}`").cast("string"), "_column": F.col(f"`{query.column}`").cast("string")})
    if query.metric is None:
        made = named.groupBy("_row", "_column").agg(F.count(F.lit(1)).cast("double").alias("value"))
    else:
        made = _grouped(named, {"_row": F.col("_row"), "_column": F.col("_column")}, [query.metric]).toDF("_row", "_column", "value").withColumn("value", F.col("value").cast("double"))
    cells = made.limit(MAX_AXIS * MAX_AXIS + 1).collect()  # one more than a grid may have
    axes = [sorted({r[c] for r in cells}) for c in ("_row", "_column")]
    for name, axis in zip((query.row, query.column), axes, strict=True):
        if len(axis) > MAX_AXIS:
            raise ValueError(f"{name} has more than {MAX_AXIS} values")
    known = {(r["_row"], r["_column"]): r["value"] for r in cells}
    grid = [(x, y, known.get((x, y))) for x in axes[0] for y in axes[1]]
    made = df.sparkSession.createDataFrame(grid, "row string, column string, value double")
    return made.select("row", "column", r4(F.coalesce("value", F.lit(0.0))).alias("value"))


def _products(width: int, pairs: list[tuple[int, int, int, int]]):
    """Sums over rows of ranks (lists of (k, r)): for each pair (i, j, k of i, k of j) of r_k r_l, r_k squared and r_l squared."""
    i, j, k, m = (np.array(x, np.int32) for x in zip(*pairs, strict=True))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                lists = b.column("ranks").slice(lo, 2000)
                cells, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
                dense = np.zeros((len(sizes), width))
                dense[np.repeat(np.arange(len(sizes)), sizes), cells.field("k").to_numpy(zero_copy_only=False)] = cells.field("r").to_numpy(zero_copy_only=False)
                total += dense.T @ dense
        columns = (i, j, total[k, m], total[k, k], total[m, m])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["i", "j", "xy", "xx", "yy"])

    return task


def _spearman(values: DataFrame, n: int) -> DataFrame:
    """i, j, value for every pair of columns c0 to c(n-1): Pearson's coefficient of average ranks over the rows that have both.

    Columns with nulls in the same rows are of one kind, and a column is ranked once for each kind of its
    partners. Ranks come by counting, are gathered by row, and one pass sums the products of all pairs.
    """
    pairs = list(combinations(range(n), 2))
    differs = values.agg(*[F.max((F.col(f"c{i}").isNull() != F.col(f"c{j}").isNull()).cast("int")) for i, j in pairs]).first()
    kinds = list(range(n))
    for (i, j), d in zip(pairs, differs, strict=True):
        if not d:
            kinds[j] = min(kinds[j], kinds[i])
    number_of = {t: k for k, t in enumerate(sorted({(i, kinds[j]) for i, j in pairs} | {(j, kinds[i]) for i, j in pairs}))}
    masked = [F.struct(F.lit(k).alias("k"), F.when(F.col(f"c{kind_}").isNotNull(), F.col(f"c{i}")).alias("value")) for (i, kind_), k in number_of.items()]
    long = values.withColumn("_row", F.monotonically_increasing_id()).select("_row", F.explode(F.array(*masked)).alias("t")).select("_row", "t.k", "t.value").filter(F.col("value").isNotNull())
    counts = long.groupBy("k", "value").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("k").agg(F.sum("n").alias("_size"))  # a row for each k
    ranks = below(counts, ["k"]).join(F.broadcast(sizes), "k").select("k", "value", (F.col("below") + (F.col("n") + 1) / 2 - (F.col("_size") + 1) / 2).alias("r"))
    rows = long.join(ranks, ["k", "value"]).groupBy("_row").agg(F.collect_list(F.struct("k", "r")).alias("ranks"))  # as many as there are k
    asked = [(i, j, number_of[i, kinds[j]], number_of[j, kinds[i]]) for i, j in pairs]
    sums = rows.mapInArrow(_products(len(number_of), asked), "i int, j int, xy double, xx double, yy double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("xy", "xx", "yy")])
    return sums.select("i", "j", F.when((F.col("xx") > 0) & (F.col("yy") > 0), r4(F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))).alias("value"))


def _pearson(x: Column, y: Column) -> Column:
    flat = (F.max(x) == F.min(x)) | (F.max(y) == F.min(y))
    return F.when(~flat, r4(F.try_divide(F.covar_samp(x, y), F.sqrt(F.var_samp(x) * F.var_samp(y)))))


def correlation(df: DataFrame, columns: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """x, y, value for every pair of columns, over the rows that have both; null where a column does not vary."""
    names = columns or [n for n in numeric_columns(df) if not isinstance(kind(df, n), T.BooleanType)]
    require(df, names)
    if not 2 <= len(names) <= MAX_COLUMNS:
        raise ValueError("correlation needs 2 to 50 numeric columns")
    values = df.select(*[number(df, n).alias(f"c{i}") for i, n in enumerate(names)])
    pairs = list(combinations(range(len(names)), 2))

    def masked(i: int, j: int) -> tuple[Column, Column]:
        both = F.col(f"c{i}").isNotNull() & F.col(f"c{j}").isNotNull()
        return F.when(both, F.col(f"c{i}")), F.when(both, F.col(f"c{j}"))

    own = [F.when(F.max(f"c{i}") != F.min(f"c{i}"), 1.0).alias(f"r{i}_{i}") for i in range(len(names))]
    if method == "pearson":
        one = values.agg(*own, *[_pearson(*masked(i, j)).alias(f"r{i}_{j}") for i, j in pairs])
    else:
        one = values.agg(*own)
        found = _spearman(values, len(names))
        both = found.unionByName(found.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
        diagonal = one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(i).alias("j"), F.col(f"r{i}_{i}").alias("value")) for i in range(len(names))])))
        label = lambda c: F.element_at(F.array(*[F.lit(n) for n in names]), F.col(c) + 1)
        return both.unionByName(diagonal).select(label("i").alias("x"), label("j").alias("y"), "value")
    cells = [F.struct(F.lit(names[i]).alias("x"), F.lit(names[j]).alias("y"), F.col(f"r{min(i, j)}_{max(i, j)}").alias("value")) for i in range(len(names)) for j in range(len(names))]
    return one.select(F.inline(F.array(*cells)))
