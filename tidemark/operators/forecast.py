"""Trend and season by least squares, in relational form.

A regression on time and season dummies equals one on time after taking out each season's means, so
two groupings and a join give the fit, of one series or of every series key at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import r4, step
from tidemark.functions.student import t_quantile
from tidemark.operators.timeseries import prepare_series
from tidemark.plans.requests import ForecastRequest

#: Seasons in a cycle, by cadence.
PERIOD = {"day": 7, "month": 12, "week": 52}


def season(when: Column, cadence: str) -> Column:
    if cadence == "day":
        return F.weekday(when)
    if cadence == "month":
        return F.month(when) - 1
    return (F.weekofyear(when) - 1) % 52


def _seasonal(rows: int, cadence: str) -> bool:
    return rows >= 2 * PERIOD[cadence]


def fit(series: DataFrame, cadence: str, seasonal: bool) -> tuple[DataFrame, DataFrame]:
    """(season, n_d, t_d, y_d) and one row (slope, sxx, sse, n, p, lowest, last) of a series (bucket, value)."""
    order = Window.orderBy("bucket")  # one row for each period
    placed = series.select("bucket", "value", (F.row_number().over(order) - 1).cast("double").alias("t"), (season(F.col("bucket"), cadence) if seasonal else F.lit(0)).alias("season"))
    means = placed.groupBy("season").agg(F.count(F.lit(1)).alias("n_d"), F.avg("t").alias("t_d"), F.avg("value").alias("y_d"))
    centred = placed.join(F.broadcast(means), "season").select("bucket", "value", "t", (F.col("t") - F.col("t_d")).alias("dt"), (F.col("value") - F.col("y_d")).alias("dy"))  # at most 52 seasons
    sums = centred.agg(
        F.sum(F.col("dt") * F.col("dt")).alias("sxx"),
        F.sum(F.col("dt") * F.col("dy")).alias("sxy"),
        F.sum(F.col("dy") * F.col("dy")).alias("syy"),
        F.count(F.lit(1)).alias("n"),
        F.max("bucket").alias("last"),
        F.min("value").alias("lowest"),
    )
    slope = F.try_divide("sxy", "sxx")
    return means, sums.select(slope.alias("slope"), "sxx", (F.col("syy") - slope * F.col("sxy")).alias("sse"), "n", "last", "lowest")


def forecast(df: DataFrame, request: ForecastRequest) -> DataFrame:
    """step, bucket, predicted, lower, upper for the periods after the last. Needs max(14, 2 horizons) periods."""
    series = prepare_series(df, request.date_column, request.metric_column, request.aggregation, request.cadence)
    rows = series.count()
    if rows < max(14, 2 * request.horizon):
        raise ValueError(f"{rows} periods are too few to forecast {request.horizon}")
    seasonal = _seasonal(rows, request.cadence)
    parameters = PERIOD[request.cadence] + 1 if seasonal else 2
    if rows <= parameters:
        raise ValueError(f"{rows} periods are too few for {parameters} parameters")
    means, one = fit(series, request.cadence, seasonal)
    ahead = one.select("*", F.explode(F.sequence(F.lit(1), F.lit(request.horizon))).alias("step"))
    dated = ahead.withColumn("bucket", (F.col("last") + F.col("step") * step(request.cadence)).cast("date")).withColumn("t", F.col("n") - 1 + F.col("step"))
    # a season that history lacks is forecast by the first season it has
    first = means.agg(F.min_by(F.struct("n_d", "t_d", "y_d"), "season").alias("first"))
    own = dated.withColumn("season", season(F.col("bucket"), request.cadence) if seasonal else F.lit(0)).join(means, "season", "left").join(F.broadcast(first))  # one row
    n_d, t_d, y_d = (F.coalesce(F.col(c), F.col(f"first.{c}")) for c in ("n_d", "t_d", "y_d"))
    away = F.col("t") - t_d
    spread = F.sqrt(F.greatest(F.lit(1e-12), F.col("sse") / (F.col("n") - parameters)))
    leverage = 1 / n_d + away * away / F.col("sxx")
    width = F.lit(t_quantile(0.975, rows - parameters)) * spread * F.sqrt(F.greatest(F.lit(1.0), 1 + leverage))
    predicted = y_d + F.col("slope") * away
    floor = F.lit(not request.allow_negative and request.aggregation == "sum") & (F.col("lowest") >= 0)
    lower = F.when(floor, F.greatest(F.lit(0.0), predicted - width)).otherwise(predicted - width)
    return own.select("step", "bucket", r4(predicted).alias("predicted"), r4(lower).alias("lower"), r4(predicted + width).alias("upper"))


def fit_series(series: DataFrame, cadence: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, season, n_d, t_d, y_d), and a row for each key (slope, sxx, sse, n, p, last, lowest), of many dense series (keys, bucket, value).

    A series of at least two cycles gets a mean for each season, a shorter one a single mean; p is the
    number of parameters. Seasons, sums and counts are kept by key, so no series passes through a task whole
    but for its numbering, which is a row for each period.
    """
    by = Window.partitionBy(*keys)
    placed = series.select(*keys, "bucket", "value", (F.row_number().over(by.orderBy("bucket")) - 1).cast("double").alias("t"), F.count(F.lit(1)).over(by).alias("rows"))
    seasonal = F.col("rows") >= 2 * PERIOD[cadence]
    placed = placed.withColumns({"season": F.when(seasonal, season(F.col("bucket"), cadence)).otherwise(0), "p": F.when(seasonal, PERIOD[cadence] + 1).otherwise(2)})
    means = placed.groupBy(*keys, "season").agg(F.count(F.lit(1)).alias("n_d"), F.avg("t").alias("t_d"), F.avg("value").alias("y_d"))
    centred = placed.join(means, [*keys, "season"]).select(*keys, "bucket", "value", "p", (F.col("t") - F.col("t_d")).alias("dt"), (F.col("value") - F.col("y_d")).alias("dy"))
    products = {"sxx": ("dt", "dt"), "sxy": ("dt", "dy"), "syy": ("dy", "dy")}
    sums = centred.groupBy(*keys).agg(*[F.sum(F.col(a) * F.col(b)).alias(n) for n, (a, b) in products.items()], F.count(F.lit(1)).alias("n"), F.max("p").alias("p"), F.max("bucket").alias("last"), F.min("value").alias("lowest"))
    slope = F.try_divide("sxy", "sxx")
    return means, sums.select(*keys, slope.alias("slope"), "sxx", (F.col("syy") - slope * F.col("sxy")).alias("sse"), "n", "p", "last", "lowest")


def forecast_series(df: DataFrame, request: ForecastRequest, keys: list[str]) -> DataFrame:
    """keys, step, bucket, predicted, lower, upper, for every series of df: as forecast does for one.

    Series of fewer than max(14, 2 horizons) periods, or no more than parameters, are left out. Null keys
    are a series of their own. Widths come from a table of quantiles by degrees of freedom, a row for each
    different length of series.
    """
    named = {k: f"_key{i}" for i, k in enumerate(keys)}
    own = list(named.values())
    keyed = df.select(*[F.struct(F.col(f"`{k}`")).alias(v) for k, v in named.items()], F.col(f"`{request.date_column}`"), F.col(f"`{request.metric_column}`"))  # a struct of null is no null, so null keys meet in joins
    series = prepare_series(keyed, request.date_column, request.metric_column, request.aggregation, request.cadence, own)
    means, sums = fit_series(series, request.cadence, own)
    long = sums.filter((F.col("n") >= max(14, 2 * request.horizon)) & (F.col("n") > F.col("p"))).withColumn("freedom", (F.col("n") - F.col("p")).cast("int"))
    degrees = [r[0] for r in long.select("freedom").distinct().collect()]  # no more than periods of the longest series
    quantile = df.sparkSession.createDataFrame([(v, t_quantile(0.975, v)) for v in degrees], "freedom int, t95 double")
    ahead = long.join(F.broadcast(quantile), "freedom").select("*", F.explode(F.sequence(F.lit(1), F.lit(request.horizon))).alias("step"))
    dated = ahead.withColumn("bucket", (F.col("last") + F.col("step") * step(request.cadence)).cast("date")).withColumn("t", F.col("n") - 1 + F.col("step"))
    seasonal = F.col("p") > 2
    first = means.groupBy(*own).agg(F.min_by(F.struct("n_d", "t_d", "y_d"), "season").alias("first"))  # for a season that history lacks
    placed = dated.withColumn("season", F.when(seasonal, season(F.col("bucket"), request.cadence)).otherwise(0)).join(means, [*own, "season"], "left").join(first, own)
    n_d, t_d, y_d = (F.coalesce(F.col(c), F.col(f"first.{c}")) for c in ("n_d", "t_d", "y_d"))
    away = F.col("t") - t_d
    spread = F.sqrt(F.greatest(F.lit(1e-12), F.col("sse") / F.col("freedom")))
    width = F.col("t95") * spread * F.sqrt(F.greatest(F.lit(1.0), 1 + 1 / n_d + away * away / F.col("sxx")))
    predicted = y_d + F.col("slope") * away
    floor = F.lit(not request.allow_negative and request.aggregation == "sum") & (F.col("lowest") >= 0)
    lower = F.when(floor, F.greatest(F.lit(0.0), predicted - width)).otherwise(predicted - width)
    names = [F.col(v)[k].alias(k) for k, v in named.items()]
    return placed.select(*names, "step", "bucket", r4(predicted).alias("predicted"), r4(lower).alias("lower"), r4(predicted + width).alias("upper"))


def with_band(forecasts: DataFrame) -> DataFrame:
    """forecasts with band: how far apart the bounds lie, 0 at least."""
    return forecasts.withColumn("band", r4(F.greatest(F.lit(0.0), F.col("upper") - F.col("lower"))))
