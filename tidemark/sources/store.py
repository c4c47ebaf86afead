"""Result tables of anomalies, forecasts and audit records: replaced by scope, always within one organisation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.snapshots import SCOPE, ResultTable


def in_scope(org: str, dataset: str, metric: str, low: date | None = None, high: date | None = None, when: str = "bucket") -> Column:
    own = (F.col("org_id") == org) & (F.col("dataset_id") == dataset) & (F.col("metric") == metric)
    return own if low is None else own & F.col(when).between(F.lit(low), F.lit(high))


def replace(existing: DataFrame, new: DataFrame, scope: Column) -> DataFrame:
    """existing less the rows in scope, plus new. A row whose scope is unknown stays."""
    return existing.filter(~F.coalesce(scope, F.lit(False))).unionByName(new)


def replace_range(existing: DataFrame, new: DataFrame, org: str, dataset: str, metric: str, when: str = "bucket") -> DataFrame:
    """replace within the dates that new spans; without new rows nothing changes."""
    ends = new.agg(F.min(when).alias("_lo"), F.max(when).alias("_hi"))
    marked = existing.join(F.broadcast(ends))  # one row
    stays = ~F.coalesce(in_scope(org, dataset, metric) & F.col(when).between(F.col("_lo"), F.col("_hi")), F.lit(False))
    return marked.filter(stays).drop("_lo", "_hi").unionByName(new)


def listed(table: DataFrame, org: str, metric: str | None = None, severity: str | None = None, when: str = "bucket", limit: int = 100, offset: int = 0) -> DataFrame:
    """An organisation's rows, newest first."""
    found = table.filter(F.col("org_id") == org)
    if metric:
        found = found.filter(F.col("metric") == metric)
    if severity:
        found = found.filter(F.col("severity") == severity)
    return found.orderBy(F.desc(when), "metric").offset(offset).limit(limit)


def listed_anomalies(table: DataFrame, org: str, dataset: str, metric: str | None = None, severity: str | None = None, when: str = "bucket") -> DataFrame:
    """A dataset's stored anomalies, newest first, with deviation_pct: how far value lies from expected, in percent of it; null where either is."""
    found = table.filter((F.col("org_id") == org) & (F.col("dataset_id") == dataset))
    if metric:
        found = found.filter(F.col("metric") == metric)
    if severity:
        found = found.filter(F.col("severity") == severity.lower())
    away = (F.col("value") - F.col("expected")) / F.greatest(F.abs("expected"), F.lit(1e-6)) * 100
    return found.withColumn("deviation_pct", F.when(F.col("expected").isNotNull(), F.round(away, 2))).orderBy(F.desc(when), "metric")


def listed_datasets(catalog: DataFrame, org: str, limit: int = 50, offset: int = 0, when: str = "created_at") -> DataFrame:
    """A page of an organisation's datasets, newest first."""
    return catalog.filter(F.col("org_id") == org).orderBy(F.desc(when), "dataset_id").offset(offset).limit(limit)


def summary(anomalies: DataFrame, forecasts: DataFrame, org: str) -> DataFrame:
    """One row: anomalies by severity, all of them, forecasts, metrics in either table."""
    a, f = anomalies.filter(F.col("org_id") == org), forecasts.filter(F.col("org_id") == org)
    levels = ("critical", "high", "medium", "low")
    counts = a.agg(F.count(F.lit(1)).alias("anomalies"), *[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in levels])
    made = f.agg(F.count(F.lit(1)).alias("forecasts"))
    metrics = a.select("metric").union(f.select("metric")).distinct().agg(F.count(F.lit(1)).alias("metrics"))
    return counts.join(F.broadcast(made)).join(F.broadcast(metrics))  # one row each


def audit(table: DataFrame, org: str, action: str, details: Column, at: Column) -> DataFrame:
    """table with a record appended."""
    one = table.sparkSession.range(1).select(F.lit(org).alias("org_id"), F.lit(action).alias("action"), details.alias("details"), at.alias("at"))
    return table.unionByName(one)


def sync_columns(catalog: DataFrame, profile: DataFrame, dataset: str) -> DataFrame:
    """catalog (dataset_id, column, classification, nullable) with a dataset's columns replaced by those of its profile."""
    new = profile.select(F.lit(dataset).alias("dataset_id"), "column", "classification", (F.col("null_count") > 0).alias("nullable"))
    return replace(catalog, new, F.col("dataset_id") == dataset)


def sync_dataset(datasets: DataFrame, dataset: str, profile: DataFrame, rows: int) -> DataFrame:
    """datasets (dataset_id, status, row_count, n_columns, ...) with a profiled dataset ready, its rows and its columns counted; others as they are."""
    own = F.coalesce(F.col("dataset_id") == dataset, F.lit(False))
    columns = profile.agg(F.count(F.lit(1)).alias("_columns"))
    kept = datasets.columns
    told = {"status": F.when(own, "ready").otherwise(F.col("status")), "row_count": F.when(own, rows).otherwise(F.col("row_count")).cast("long"), "n_columns": F.when(own, F.col("_columns")).otherwise(F.col("n_columns")).cast("long")}
    return datasets.join(F.broadcast(columns)).withColumns(told).select(*kept)  # one row


def save(new: DataFrame, path: str, scopes: list[tuple[str, str, str]] | None = None) -> int:
    """Replace the rows of scopes (by default those that new holds) by new's in the versioned table under a path; all others stay. A scope that is named and has no new rows is emptied."""
    return ResultTable(new.sparkSession, path, new.schema).replace_all(new, scopes)


def load(spark: SparkSession, path: str, schema: str, org: str | None = None) -> DataFrame:
    """The newest rows saved under a path; of an organisation, from its folders alone."""
    return ResultTable(spark, path, schema).read(org)


def with_id(results: DataFrame, when: str = "bucket") -> DataFrame:
    """results with an id that follows from scope and date."""
    return results.withColumn("id", F.sha2(F.concat_ws("|", *SCOPE, F.col(when).cast("string")), 256))


def by_id(results: DataFrame, org: str, key: str) -> DataFrame:
    """The result of an organisation with this id; another's is not found."""
    return results.filter((F.col("org_id") == org) & (F.col("id") == key))


def listed_forecasts(table: DataFrame, org: str, metric: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """An organisation's forecasts, by date."""
    found = table.filter(F.col("org_id") == org)
    return (found.filter(F.col("metric") == metric) if metric else found).orderBy("bucket", "metric").offset(offset).limit(limit)


def totals(catalog: DataFrame, org: str) -> DataFrame:
    """datasets, cleaned, cleaned_pct of an organisation's catalog (org_id, dataset_id, status, row_count), and its rows."""
    own = catalog.filter(F.col("org_id") == org)
    cleaned = F.count(F.when(F.col("status") == "cleaned", 1))
    return own.agg(F.count(F.lit(1)).alias("datasets"), cleaned.alias("cleaned"), F.coalesce(F.round(cleaned / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100, 2), F.lit(0.0)).alias("cleaned_pct"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"))


def default_columns(profile: DataFrame) -> DataFrame:
    """date_column, metric_column, dimension: of a profile (column, classification, position) the first of each class, or null."""

    def first(kind: str) -> Column:
        return F.min_by(F.when(F.col("classification") == kind, F.col("column")), F.when(F.col("classification") == kind, F.col("position")))

    return profile.agg(first("datetime").alias("date_column"), first("numeric").alias("metric_column"), first("categorical").alias("dimension"))
