"""Cleaning: every step is a plan of its own; the pipeline runs them in a fixed order and reports what each did."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import day, number, r4
from tidemark.functions.quantiles import quantiles, quantiles_now
from tidemark.operators.aggregate import value_counts
from tidemark.operators.profile import METRIC_NAME, Figures, figures
from tidemark.plans.requests import CleaningConfig

#: What a placeholder among identifiers looks like; bounds of the outlier rule.
PLACEHOLDER = r"(?i)(9999|unknown|dummy|temp|null|test)"
OUTLIER_MIN_ROWS, OUTLIER_FACTOR = 10, 1.5
#: Changed spellings up to which their map is broadcast; a longer one is joined by a shuffle.
MAP_ROWS = 100_000


def normalize_name(name: str) -> str:
    return re.sub("_+", "_", re.sub("[^a-z0-9_]+", "_", name.strip().lower())).strip("_") or "unnamed_col"


def normalize_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Snake case headers, and which changed. Two headers that become one are refused."""
    names = [normalize_name(c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names collide: {sorted(n for n in set(names) if names.count(n) > 1)}")
    return df.toDF(*names), {a: b for a, b in zip(df.columns, names, strict=True) if a != b}


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def duplicate_report(df: DataFrame) -> DataFrame:
    """rows, duplicates, duplicate_pct, rows_after: what drop_duplicates would take."""
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    one = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("rows_after"))
    gone = F.col("rows") - F.col("rows_after")
    return one.select("rows", gone.alias("duplicates"), F.coalesce(F.round(gone / F.nullif("rows", F.lit(0)) * 100, 2), F.lit(0.0)).alias("duplicate_pct"), "rows_after")


def impute_number(df: DataFrame, name: str, how: str) -> DataFrame:
    """Nulls (and what is no number) become the median, the mean (4 digits) or zero; a column of nulls becomes zero."""
    n = number(df, name)
    if how == "zero":
        return df.withColumn(name, F.coalesce(n, F.lit(0.0)))
    if how not in ("median", "mean"):
        return df
    found = quantiles(df, [name], [0.5]).agg(F.max(F.col("q")[0]).alias("v")) if how == "median" else df.agg(F.avg(n).alias("v"))
    value = found.select(F.coalesce(r4(F.col("v")), F.lit(0.0)).alias("_fill"))
    return df.join(F.broadcast(value)).withColumn(name, F.coalesce(n, F.col("_fill"))).drop("_fill")  # one row


def impute_category(df: DataFrame, name: str, how: str) -> DataFrame:
    """Nulls become the most frequent value (of equals the smallest; Unknown without any) or Unknown."""
    c = F.col(f"`{name}`")
    if how == "unknown":
        return df.withColumn(name, F.coalesce(c, F.lit("Unknown")))
    if how != "mode":
        return df
    counts = df.filter(c.isNotNull()).groupBy(c.alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.orderBy(F.desc("_n"), "_value").limit(1).agg(F.coalesce(F.max("_value"), F.lit("Unknown")).alias("_fill"))
    return df.join(F.broadcast(best)).withColumn(name, F.coalesce(c, F.col("_fill"))).drop("_fill")  # one row


def _title(text):
    """Capitals after every character that is no letter."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), F.initcap), "")


def spellings(df: DataFrame, name: str) -> DataFrame:
    """value, canonical: spellings that differ in case or outer blanks become the one in title case if it occurs, else the smallest most frequent."""
    counts = df.filter(F.col(f"`{name}`").isNotNull()).groupBy(F.col(f"`{name}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    forms = counts.groupBy(F.trim("value").alias("form")).agg(F.sum("n").alias("n"))
    best = forms.groupBy(F.lower("form").alias("folded")).agg(F.max(F.when(F.col("form") == _title(F.col("form")), F.col("form"))).alias("title"), F.min_by("form", F.struct(-F.col("n"), F.col("form"))).alias("common"))
    return counts.join(best, F.lower(F.trim("value")) == F.col("folded")).select("value", F.coalesce("title", "common").alias("canonical"))


def normalize_categories(df: DataFrame, name: str) -> DataFrame:
    """Nulls stay and take no part in a join; the map of changed spellings is broadcast unless it is long."""
    changed = spellings(df, name).filter("value <> canonical")
    few = changed.limit(MAP_ROWS + 1).collect()
    if not few:
        return df
    c = F.col(f"`{name}`")
    told = changed if len(few) > MAP_ROWS else F.broadcast(df.sparkSession.createDataFrame(few, changed.schema))
    known = df.filter(c.isNotNull()) if len(few) > MAP_ROWS else df
    made = known.join(told.withColumnsRenamed({"value": "_value", "canonical": "_canonical"}), c == F.col("_value"), "left").withColumn(name, F.coalesce("_canonical", c)).select(*[F.col(f"`{x}`") for x in df.columns])
    return made if known is df else made.unionByName(df.filter(c.isNull()))


def iso_dates(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.date_format(day(df, name), "yyyy-MM-dd"))


def cast_report(df: DataFrame, name: str, to: str) -> DataFrame:
    """column, success, failure of reading the known values as number or date."""
    read = number(df, name) if to == "number" else day(df, name)
    known = F.col(f"`{name}`").isNotNull()
    return df.agg(F.lit(name).alias("column"), F.count(read).alias("success"), F.count(F.when(known & read.isNull(), 1)).alias("failure"))


def outlier_bounds(df: DataFrame, name: str) -> DataFrame:
    """lower, upper: quartiles less and plus 1.5 times their distance, 4 digits; null for fewer than ten values."""
    known = df.agg(F.count(number(df, name)).alias("known"))
    one = known.join(F.broadcast(quantiles(df, [name], [0.25, 0.75])), how="left")  # one row each
    reach = (F.col("q")[1] - F.col("q")[0]) * OUTLIER_FACTOR
    enough = F.col("known") >= OUTLIER_MIN_ROWS
    return one.select(F.when(enough, r4(F.col("q")[0] - reach)).alias("lower"), F.when(enough, r4(F.col("q")[1] + reach)).alias("upper"))


def outlier_report(df: DataFrame, name: str) -> DataFrame:
    """column, lower, upper, outliers, negatives, invalid: negatives where the column is named like a metric, which has none."""
    n = number(df, name)
    counted = df.join(F.broadcast(outlier_bounds(df, name)))  # one row
    out = counted.agg(F.max("lower").alias("lower"), F.max("upper").alias("upper"), F.count(F.when((n < F.col("lower")) | (n > F.col("upper")), 1)).alias("outliers"), F.count(F.when(n < 0, 1)).alias("negatives"))
    invalid = F.when(F.lit(bool(re.search(METRIC_NAME, name))), F.col("negatives")).otherwise(0).cast("long")
    return out.select(F.lit(name).alias("column"), "lower", "upper", "outliers", "negatives", invalid.alias("invalid"))


def outlier_samples(df: DataFrame, name: str, n: int = 5) -> DataFrame:
    """value: up to n distinct outliers, those farthest out first."""
    value = number(df, name)
    far = df.join(F.broadcast(outlier_bounds(df, name))).select(value.alias("value"), F.greatest(F.col("lower") - value, value - F.col("upper")).alias("beyond"))  # one row
    return far.filter("beyond > 0").groupBy("value").agg(F.max("beyond").alias("beyond")).orderBy(F.desc("beyond"), "value").limit(n).select("value")


def cap_outliers(df: DataFrame, name: str) -> DataFrame:
    bounds = outlier_bounds(df, name).withColumnsRenamed({"lower": "_lower", "upper": "_upper"})
    n = number(df, name)
    return df.join(F.broadcast(bounds)).withColumn(name, F.when(n.isNotNull(), F.least(F.greatest(n, "_lower"), "_upper"))).drop("_lower", "_upper")  # one row


def reference_audit(df: DataFrame, name: str) -> DataFrame:
    """column, missing, placeholders of an identifier."""
    c = F.col(f"`{name}`")
    return df.agg(F.lit(name).alias("column"), F.count(F.when(c.isNull(), 1)).alias("missing"), F.count(F.when(c.cast("string").rlike(PLACEHOLDER), 1)).alias("placeholders"))


def _fills(df: DataFrame, names: list[str], how: str) -> dict[str, float]:
    """What nulls of numeric columns become; one job for all columns."""
    if how == "zero" or not names:
        return dict.fromkeys(names, 0.0)
    if how == "median":
        known = {c: q[0] for c, q in quantiles_now(df, names, [0.5]).items()}
    else:
        known = df.agg(*[F.avg(number(df, n)).alias(n) for n in names]).first().asDict()
    return {n: round(known.get(n) or 0.0, 4) for n in names}


def _modes(df: DataFrame, names: list[str]) -> dict[str, str]:
    """The most frequent value of each column, of equals the smallest; one job for all columns."""
    best = value_counts(df, names).groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    known = {r["column"]: r["value"] for r in best.collect()}  # a row for each column
    return {n: known.get(n, "Unknown") for n in names}


def _bounds(df: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """Outlier bounds of the columns with ten values or more; one job for all columns."""
    counts = df.agg(*[F.count(number(df, n)).alias(n) for n in names]).first().asDict()
    out = {}
    for name, (low, high) in quantiles_now(df, names, [0.25, 0.75]).items():
        if counts[name] >= OUTLIER_MIN_ROWS:
            out[name] = (round(low - (high - low) * OUTLIER_FACTOR, 4), round(high + (high - low) * OUTLIER_FACTOR, 4))
    return out


def clean(df: DataFrame, config: CleaningConfig = CleaningConfig()) -> tuple[DataFrame, DataFrame]:
    """The cleaned table and a report (step, column, detail).

    Identifiers and dates are never imputed; text is turned into numbers before nulls are filled, and
    outliers are judged after. The figures that decide are gathered for all columns at once from the
    table without duplicates, which is kept for that; the cleaned table is then one projection of it.
    What is kept stays so while the result may be read; clean_and_save lets go of it.
    """
    out, report, _ = _cleaned(df, config)
    return out, df.sparkSession.createDataFrame(report, _REPORT)


_REPORT = "step string, column string, detail string"


def _cleaned(df: DataFrame, config: CleaningConfig) -> tuple[DataFrame, list[tuple[str, str | None, str]], DataFrame]:
    """The cleaned table, the report, and the table that is kept meanwhile."""
    report: list[tuple[str, str | None, str]] = []
    if config.remove_duplicates:
        df = drop_duplicates(df)
        report.append(("dedup", None, "exact duplicates dropped"))
    if config.normalize_names:
        df, renamed = normalize_names(df)
        report += [("rename", new, old) for old, new in renamed.items()]
    kept = base = df.persist()
    found = figures(base)
    kinds = {k: [f for f in found if f.classification == k] for k in ("identifier", "datetime", "numeric", "categorical", "text")}
    base = _clean_numbers(base, kinds["numeric"], config, report)
    base = _clean_texts(base, kinds["categorical"] + kinds["text"], config, report)
    if config.convert_types:
        for f in kinds["datetime"]:
            base = iso_dates(base, f.name)
            report.append(("convert", f.name, f"{f.dates} dates, {f.known - f.dates} failures"))
    for f in kinds["identifier"] + kinds["datetime"]:
        if f.known < f.rows:
            report.append(("nulls", f.name, f"{f.rows - f.known} nulls left in {f.classification}"))
    names = [f.name for f in kinds["identifier"]]
    if config.check_references and names:
        one = base.agg(*[F.count(F.when(F.col(f"`{n}`").cast("string").rlike(PLACEHOLDER), 1)).alias(n) for n in names]).first()
        report += [("references", f.name, f"{f.rows - f.known} missing, {one[f.name]} placeholders") for f in kinds["identifier"]]
    return base, report, kept


def clean_and_save(df: DataFrame, base: str, org: str, dataset: str, config: CleaningConfig = CleaningConfig(), fmt: str = "parquet") -> DataFrame:
    """Clean a table, write it as the dataset's cleaned artifact, and tell of it in one row: rows_before, rows_after, duplicates_removed, columns_modified (sorted array), steps (array of step, column, detail), elapsed_ms, location.

    Nothing stays cached. The location is relative to ``base``.
    """
    from tidemark.sources.tables import write_clean  # sources read names by this module

    began = time.monotonic()
    before = df.count()
    out, report, kept = _cleaned(df, config)
    try:
        path = write_clean(out, base, org, dataset, fmt)
        after = kept.count()
    finally:
        kept.unpersist()
    changed = sorted({c for step, c, detail in report if c and (step in ("convert", "categories") or step == "nulls" and "filled" in detail or step == "outliers" and config.outliers == "cap")})
    steps = [(step, c, detail) for step, c, detail in report]
    row = (before, after, before - after, changed, steps, round((time.monotonic() - began) * 1000, 2), path.removeprefix(base.rstrip("/") + "/"))
    return df.sparkSession.createDataFrame([row], f"rows_before long, rows_after long, duplicates_removed long, columns_modified array<string>, steps array<struct<{_REPORT.replace(' string', ': string')}>>, elapsed_ms double, location string")


def preview_summary(df: DataFrame, config: CleaningConfig = CleaningConfig()) -> DataFrame:
    """One row of what clean would do: rows_before, rows_after (estimated), duplicates, duplicate_pct, columns_to_modify (sorted array of cleaned names, renaming alone not counted)."""
    acts = {r["column"]: set(r["actions"].split(",")) - {"", "rename"} for r in preview(df, config).collect()}  # a row for each column
    named = sorted((normalize_name(c) if config.normalize_names else c) for c, own in acts.items() if own)
    one = duplicate_report(df)
    left = F.col("rows_after") if config.remove_duplicates else F.col("rows")
    return one.select(F.col("rows").alias("rows_before"), left.alias("rows_after"), "duplicates", "duplicate_pct", F.array(*[F.lit(n) for n in named]).cast("array<string>").alias("columns_to_modify"))


def _clean_numbers(df: DataFrame, found: list[Figures], config: CleaningConfig, report: list) -> DataFrame:
    if not found:
        return df
    if config.convert_types:
        texts = [f for f in found if not f.numeric_type]
        df = df.withColumns({f.name: number(df, f.name) for f in texts})
        report += [("convert", f.name, f"{f.numbers} numbers, {f.known - f.numbers} failures") for f in texts]
    holes = [f for f in found if f.numbers < f.rows and (f.numeric_type or config.convert_types)]
    if config.numeric_nulls in ("median", "mean", "zero") and holes:
        fills = _fills(df, [f.name for f in holes], config.numeric_nulls)
        df = df.withColumns({f.name: F.coalesce(number(df, f.name), F.lit(fills[f.name])) for f in holes})
        report += [("nulls", f.name, f"{f.rows - f.numbers} filled by {config.numeric_nulls}") for f in holes]
    if config.outliers in ("report", "cap"):
        names = [f.name for f in found]
        bounds = _bounds(df, names)
        values = {n: number(df, n) for n in bounds}
        if bounds:
            one = df.agg(*[F.count(F.when((values[n] < lo) | (values[n] > hi), 1)).alias(n) for n, (lo, hi) in bounds.items()]).first()
            report += [("outliers", n, f"{one[n]} outside {lo} to {hi}") for n, (lo, hi) in bounds.items()]
        if config.outliers == "cap":
            df = df.withColumns({n: F.when(values[n].isNotNull(), F.least(F.greatest(values[n], F.lit(lo)), F.lit(hi))) for n, (lo, hi) in bounds.items()})
    return df


def _clean_texts(df: DataFrame, found: list[Figures], config: CleaningConfig, report: list) -> DataFrame:
    found = [f for f in found if isinstance(df.schema[f.name].dataType, T.StringType)]
    holes = [f for f in found if f.known < f.rows]
    if config.categorical_nulls in ("mode", "unknown") and holes:
        names = [f.name for f in holes]
        fills = _modes(df, names) if config.categorical_nulls == "mode" else dict.fromkeys(names, "Unknown")
        df = df.withColumns({n: F.coalesce(F.col(f"`{n}`"), F.lit(v)) for n, v in fills.items()})
        report += [("nulls", f.name, f"{f.rows - f.known} filled by {config.categorical_nulls}") for f in holes]
    if config.normalize_categories:
        for f in found:
            if f.classification == "categorical":
                df = normalize_categories(df, f.name)
                report.append(("categories", f.name, "spellings unified"))
    return df


def preview(df: DataFrame, config: CleaningConfig = CleaningConfig()) -> DataFrame:
    """column (original name), missing, missing_pct, actions: what clean would do, without doing it."""
    rows = []
    for f in figures(df):
        nulls, acts = f.rows - f.known, []
        if config.normalize_names and normalize_name(f.name) != f.name:
            acts.append("rename")
        if f.classification == "numeric":
            acts += ["impute"] * bool(nulls and config.numeric_nulls != "none") + ["convert"] * bool(config.convert_types and not f.numeric_type) + ["cap"] * (config.outliers == "cap")
        elif f.classification in ("categorical", "text"):
            acts += ["impute"] * bool(nulls and config.categorical_nulls != "none") + ["unify"] * bool(config.normalize_categories and f.classification == "categorical")
        elif f.classification == "datetime" and config.convert_types:
            acts.append("convert")
        rows.append((f.name, nulls, round(nulls / max(1, f.rows) * 100, 2), ",".join(acts)))
    return df.sparkSession.createDataFrame(rows, "column string, missing long, missing_pct double, actions string")
