"""Anomalies of a metric over time: deviation from a trailing window, and isolation forests."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import r2, r4
from tidemark.operators.timeseries import prepare_series
from tidemark.plans.requests import AnomalyRequest

#: Fixed values of the detectors.
THRESHOLDS = {"low": 3.0, "medium": 2.5, "high": 2.0}
CONTAMINATION = {"low": 0.01, "medium": 0.03, "high": 0.05}
FOREST_MIN_POINTS, TREES, SEED, FLAT = 20, 100, 42, 1e-9


def run_facts(series: DataFrame, request: AnomalyRequest, today: Column | None = None) -> DataFrame:
    """Where a run's results come from: start_date, end_date, observations, recency_lag_days (0 at least), cadence, aggregation, method, threshold, of a prepared series (bucket, value)."""
    today = F.current_date() if today is None else today
    one = series.agg(F.min("bucket").alias("start_date"), F.max("bucket").alias("end_date"), F.count(F.lit(1)).alias("observations"))
    said = {"cadence": request.cadence, "aggregation": request.aggregation, "method": "rolling_z"}
    lag = F.greatest(F.lit(0), F.datediff(today, "end_date"))
    return one.select("*", lag.alias("recency_lag_days"), *[F.lit(v).alias(k) for k, v in said.items()], F.lit(THRESHOLDS[request.sensitivity]).alias("threshold"))


#: Fixed values of the ladder below: deviations in z and in percent from which a point is critical, high or medium.
def severity(z: Column, deviation: Column) -> Column:
    return (
        F.when((F.abs(z) >= 4) | (F.abs(deviation) >= 75), "critical")
        .when((F.abs(z) >= 3) | (F.abs(deviation) >= 50), "high")
        .when((F.abs(z) >= 2.5) | (F.abs(deviation) >= 25), "medium")
        .otherwise("low")
    )


def rolling_scores(series: DataFrame, window: int, keys: list[str] = ()) -> DataFrame:
    """series (keys, bucket, value) with expected, spread, z, overall and n: each point against the window before it.

    The mean needs max(2, window // 2) points and is carried back to the first points; a missing
    deviation is that of the whole series, and none is below 0.0001.
    """
    order = Window.partitionBy(*keys).orderBy("bucket")
    prior = order.rowsBetween(-window, -1)
    least = max(2, window // 2)
    enough = F.count("value").over(prior) >= least
    whole = Window.partitionBy(*keys)
    scored = series.withColumns(
        {
            "_mean": F.when(enough, F.avg("value").over(prior)),
            "_std": F.when(enough, F.stddev_samp("value").over(prior)),
            "overall": F.stddev_samp("value").over(whole),
            "n": F.count(F.lit(1)).over(whole),
        }
    )
    ahead = order.rowsBetween(0, Window.unboundedFollowing)
    scored = scored.withColumn("expected", F.first("_mean", True).over(ahead)).withColumn("spread", F.greatest(F.coalesce("_std", "overall"), F.lit(1e-4)))
    return scored.withColumn("z", (F.col("value") - F.col("expected")) / F.col("spread")).drop("_mean", "_std")


def detect_anomalies(df: DataFrame, request: AnomalyRequest, keys: list[str] = ()) -> DataFrame:
    """keys, bucket, value, expected, z_score, deviation_pct, severity. Flat series have none. A series below max(14, 2 windows) periods is refused; with keys, such ones have none."""
    series = prepare_series(df, request.date_column, request.metric_column, request.aggregation, request.cadence, keys)
    if not keys and (have := series.count()) < (least := max(14, 2 * request.window)):
        raise ValueError(f"{have} periods are too few, {least} are needed")
    scored = rolling_scores(series, request.window, keys)
    found = scored.filter((F.col("n") >= max(14, 2 * request.window)) & (F.col("overall") >= FLAT) & (F.abs("z") >= THRESHOLDS[request.sensitivity]))
    deviation = (F.col("value") - F.col("expected")) / F.greatest(F.abs("expected"), F.lit(1e-6)) * 100
    return found.select(*keys, "bucket", r4(F.col("value")).alias("value"), r4(F.col("expected")).alias("expected"), r4(F.col("z")).alias("z_score"), r2(deviation).alias("deviation_pct"), severity(F.col("z"), deviation).alias("severity"))


def _depth(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def forest_scores(points: np.ndarray, trees: int = TREES, seed: int = SEED, sample: int = 256) -> np.ndarray:
    """Isolation score of each row, from 0 to 1; the larger the sooner random cuts set it apart."""
    rng = np.random.default_rng(seed)
    m = min(sample, len(points))
    total = np.zeros(len(points))
    for _ in range(trees):
        stack = [(points[rng.choice(len(points), m, replace=False)], np.arange(len(points)), 0)]
        while stack:
            own, rows, depth = stack.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if len(own) <= 1 or depth >= np.ceil(np.log2(max(m, 2))) or not len(open_):
                total[rows] += depth + _depth(len(own))
                continue
            k = rng.choice(open_)
            cut = rng.uniform(low[k], high[k])
            left = points[rows, k] < cut
            side = own[:, k] < cut
            for s, r in ((own[side], rows[left]), (own[~side], rows[~left])):
                if len(r) and len(s):
                    stack.append((s, r, depth + 1))
                elif len(r):
                    total[r] += depth + 1
    return 2 ** (-total / trees / max(float(_depth(m)), 1e-9))


def isolation_anomalies(df: DataFrame, request: AnomalyRequest, keys: list[str] = ()) -> DataFrame:
    """keys, bucket, value, score, severity of the points that a forest over (value, position) sets apart; a series is one group, of one row for each period."""
    series = prepare_series(df, request.date_column, request.metric_column, request.aggregation, request.cadence, keys)
    share = CONTAMINATION[request.sensitivity]
    names = list(keys) or ["_all"]
    series = series if keys else series.withColumn("_all", F.lit(1))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bucket")
        value = frame["value"].to_numpy(float)
        if len(frame) < FOREST_MIN_POINTS or value.std() < FLAT:
            return frame.iloc[:0].assign(score=0.0, severity="")[[*names, "bucket", "value", "score", "severity"]]
        scores = forest_scores(np.column_stack([value, np.arange(len(value))]))
        above = scores - np.quantile(scores, 1 - share)
        z = np.abs(value - value.mean()) / max(value.std(ddof=1), 1e-4)
        rank = np.select([(above >= 0.15) | (z >= 4), (above >= 0.10) | (z >= 3), (above >= 0.05) | (z >= 2.5)], ["critical", "high", "medium"], "low")
        out = frame.assign(score=np.round(above, 4), severity=rank)
        return out[above > 0][[*names, "bucket", "value", "score", "severity"]]

    kinds = ", ".join(f"`{k}` {series.schema[k].dataType.simpleString()}" for k in names)
    made = series.groupBy(*names).applyInPandas(one, f"{kinds}, bucket date, value double, score double, severity string")
    return made if keys else made.drop("_all")
