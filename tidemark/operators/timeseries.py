"""Calendar series: dense buckets, trailing windows, running sums, growth; and the series that models start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import aggregate_of, bucket, is_moment, kind, moment, number, percent_change, r2, r4, step
from tidemark.operators.filters import apply_filters, require
from tidemark.plans.requests import TimeSeriesQuery


def check_date_column(df: DataFrame, name: str) -> None:
    """Dates, or text of which 70 % of the known values can be read as dates."""
    require(df, [name])
    dtype = kind(df, name)
    if is_moment(dtype):
        return
    share = df.agg(F.try_divide(F.count(moment(df, name)), F.count(F.col(name)))).first()[0] if isinstance(dtype, T.StringType) else 0
    if (share or 0) < 0.7:
        raise ValueError(f"{name} does not hold dates")


def spine(buckets: DataFrame, granularity: str, keys: list[str] = ()) -> DataFrame:
    """Every bucket from the first to the last, for each key."""
    ends = buckets.groupBy(*keys).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).filter("lo is not null")
    return ends.select(*keys, F.explode(F.sequence("lo", "hi", step(granularity))).alias("bucket")).withColumn("bucket", F.col("bucket").cast("date"))


def resample(df: DataFrame, date_column: str, value: Column, how: str, granularity: str, fill: float | None = 0.0, keys: list[str] = ()) -> DataFrame:
    """keys, bucket, value: one row for each calendar period; those without rows get ``fill``. Rows shrink to buckets before any window sees them."""
    dated = df.select(*keys, bucket(moment(df, date_column), granularity).alias("bucket"), value.alias("v")).filter(F.col("bucket").isNotNull())
    made = dated.groupBy(*keys, "bucket").agg(aggregate_of(F.col("v"), how).cast("double").alias("value"))
    full = spine(made, granularity, keys).join(made, [*keys, "bucket"], "left")
    return full if fill is None else full.withColumn("value", F.coalesce("value", F.lit(fill)))


def time_series(df: DataFrame, query: TimeSeriesQuery) -> DataFrame:
    """timestamp date, value and what the query asks for of rolling_avg, cumulative, growth_pct."""
    check_date_column(df, query.date_column)
    require(df, [query.metric.column])
    kept = apply_filters(df, query.filters)
    points = resample(kept, query.date_column, number(kept, query.metric.column), query.metric.aggregation, query.granularity)
    order = Window.orderBy("bucket")  # one row for each period
    out = [F.col("bucket").alias("timestamp"), r4(F.col("value")).alias("value")]
    if query.rolling:
        out.append(r4(F.avg("value").over(order.rowsBetween(1 - query.rolling, 0))).alias("rolling_avg"))
    if query.cumulative:
        out.append(r4(F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("cumulative"))
    if query.growth:
        out.append(r2(percent_change(F.col("value"), F.lag("value").over(order))).alias("growth_pct"))
    return points.select(*out)


def prepare_series(df: DataFrame, date_column: str, metric_column: str, how: str = "sum", granularity: str = "day", keys: list[str] = ()) -> DataFrame:
    """keys, bucket, value without gaps: an empty period sums to 0, a missing mean lies on the line between its neighbours."""
    require(df, [date_column, metric_column, *keys])
    value = number(df, metric_column)
    made = resample(df.filter(value.isNotNull()), date_column, value, how, granularity, 0.0 if how == "sum" else None, keys)
    if how == "sum":
        return made
    order = Window.partitionBy(*keys).orderBy("bucket") if keys else Window.orderBy("bucket")
    known = F.when(F.col("value").isNotNull(), F.col("at"))
    placed = made.withColumn("at", F.row_number().over(order))
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    placed = placed.withColumns({"v0": F.last("value", True).over(before), "v1": F.first("value", True).over(after), "a0": F.last(known, True).over(before), "a1": F.first(known, True).over(after)})
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * F.try_divide(F.col("at") - F.col("a0"), F.col("a1") - F.col("a0"))
    return placed.select(*keys, "bucket", F.coalesce("value", line, "v1", "v0").alias("value"))
