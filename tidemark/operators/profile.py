"""Column profiles and the data quality score.

Two passes over the rows: one wide aggregate for everything that is a count, an extreme or a quantile,
and one count of values by column. What a column is taken for is decided from those few figures.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import day, is_moment, is_numeric, kind, moment, number, r2, r4
from tidemark.functions.quantiles import quantiles
from tidemark.operators.aggregate import DATE_NAME, top_categories, value_counts

#: Names by which columns are told, the texts of a boolean, and the shape of a UUID.
ID_NAME = r"(?i)(_id|id|_key|_uuid|_code|_number)$|^id_|^key_|^code_|^uuid_|^ref_"
METRIC_NAME = r"(?i)(price|cost|amount|spend|revenue|profit|margin|rate|ratio|percent|score|balance|total|weight|discount|salary|val|value)"
BOOLEANS = ["true", "1", "yes", "y", "t", "false", "0", "no", "n", "f"]
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: Weights and grades of the score.
WEIGHTS = {"completeness": 0.30, "uniqueness": 0.25, "type_consistency": 0.20, "date_validity": 0.15, "reasonableness": 0.10}
GRADES = [(90.0, "Excellent"), (75.0, "Good"), (50.0, "Fair")]


@dataclass
class Figures:
    """What the passes say of one column."""

    name: str
    rows: int
    known: int
    distinct: int
    numbers: int
    dates: int
    valid_dates: int
    whole: int
    negatives: int
    uuids: int
    mean_length: float
    spaces: int
    booleans: int
    separators: int
    numeric_type: bool
    moment_type: bool
    integer_type: bool
    boolean_type: bool

    @property
    def classification(self) -> str:
        if self._identifier():
            return "identifier"
        if self.boolean_type or self.known and self.distinct <= 2 and self.booleans == self.known:
            return "boolean"
        dated = self.separators > 0 or bool(re.search(DATE_NAME, self.name))
        if self.moment_type or not self.numeric_type and self.known and dated and self.dates >= 0.7 * self.known:
            return "datetime"
        if self.numeric_type or self.known and self.numbers >= 0.85 * self.known:
            return "numeric"
        share = self.distinct / max(1, self.known) * 100
        if self.distinct <= 100 or share <= 15 or self.mean_length <= 30 and self.distinct <= 500:
            return "categorical"
        return "text"

    def _identifier(self) -> bool:
        if re.search(METRIC_NAME, self.name) or re.search(DATE_NAME, self.name) or self.moment_type or self.boolean_type:
            return False
        if re.search(ID_NAME, self.name):
            return self.numeric_type or self.known > 0 and self.mean_length <= 64 and self.spaces == 0
        return self.rows > 1 and self.distinct == self.rows and (self.integer_type or self.uuids == self.known)


def figures(df: DataFrame) -> list[Figures]:
    """What classification and scores rest on, for every column: each value is parsed once, in a projection, and then counted."""
    asked: list[Column] = [F.count(F.lit(1)).alias("rows")]
    parsed = df.select(
        *[x for i, f in enumerate(df.schema) for x in (F.col(f"`{f.name}`").alias(f"c{i}"), number(df, f.name).alias(f"n{i}"), (F.lit(None).cast("date") if is_numeric(f.dataType) else day(df, f.name)).alias(f"d{i}"))]
    )
    for i in range(len(df.columns)):
        c, text, n, d = F.col(f"c{i}"), F.col(f"c{i}").cast("string"), F.col(f"n{i}"), F.col(f"d{i}")
        asked += [
            F.count(c).alias(f"known_{i}"),
            F.count(n).alias(f"numbers_{i}"),
            F.count(d).alias(f"dates_{i}"),
            F.count(F.when(F.year(d).between(1900, 2099), 1)).alias(f"valid_dates_{i}"),
            F.count(F.when(n == F.floor(n), 1)).alias(f"whole_{i}"),
            F.count(F.when(n < 0, 1)).alias(f"negatives_{i}"),
            F.count(F.when(text.rlike(UUID), 1)).alias(f"uuids_{i}"),
            F.avg(F.length(text)).alias(f"mean_length_{i}"),
            F.count(F.when(F.instr(text, " ") > 0, 1)).alias(f"spaces_{i}"),
            F.count(F.when(F.lower(F.trim(text)).isin(BOOLEANS), 1)).alias(f"booleans_{i}"),
            F.count(F.when(text.rlike("[-/:]"), 1)).alias(f"separators_{i}"),
        ]
    one = parsed.agg(*asked).first().asDict()
    counts = {r["column"]: r["n"] for r in value_counts(df, df.columns).groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each column
    names = ("known", "numbers", "dates", "valid_dates", "whole", "negatives", "uuids", "spaces", "booleans", "separators")
    return [
        Figures(
            name=f.name,
            rows=one["rows"],
            distinct=counts.get(f.name, 0),
            mean_length=one[f"mean_length_{i}"] or 0.0,
            numeric_type=is_numeric(f.dataType) and not isinstance(f.dataType, T.BooleanType),
            moment_type=is_moment(f.dataType),
            integer_type=isinstance(f.dataType, T.IntegralType),
            boolean_type=isinstance(f.dataType, T.BooleanType),
            **{n: one[f"{n}_{i}"] for n in names},
        )
        for i, f in enumerate(df.schema)
    ]


def profile_columns(df: DataFrame, found: list[Figures] | None = None) -> DataFrame:
    """column, classification, null_count, null_pct, distinct_count, distinct_pct."""
    rows = [
        (f.name, f.classification, f.rows - f.known, round((f.rows - f.known) / max(1, f.rows) * 100, 2), f.distinct, round(f.distinct / max(1, f.known) * 100, 2))
        for f in found or figures(df)
    ]
    return df.sparkSession.createDataFrame(rows, "column string, classification string, null_count long, null_pct double, distinct_count long, distinct_pct double")


def _least(columns: int, k: int):
    """The k least texts of each column of a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[set[str]] = [set() for _ in range(columns)]
        for b in batches:
            for i in range(columns):
                held[i] = set(sorted(held[i] | set(pc.unique(b.column(i).drop_null()).to_pylist()), key=str.encode)[:k])
        rows = [(i, v) for i, own in enumerate(held) for v in own]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.string())], names=["i", "value"])

    return task


def samples(df: DataFrame, k: int = 5) -> DataFrame:
    """column, samples: k distinct values of each column as text, the first in order of their bytes, so that the same table gives the same ones; each task keeps k."""
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(df.columns)])
    found = texts.mapInArrow(_least(len(df.columns), k), "i int, value string").groupBy("i").agg(F.slice(F.array_sort(F.collect_set("value")), 1, k).alias("samples"))  # k values a task
    names = F.array(*[F.lit(c) for c in df.columns])
    every = df.sparkSession.range(len(df.columns)).select(F.col("id").cast("int").alias("i"))
    return every.join(F.broadcast(found), "i", "left").select(F.element_at(names, F.col("i") + 1).alias("column"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


#: Bytes of a value by type, where they are fixed.
_WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "date": 4, "float": 4, "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}


def memory(df: DataFrame) -> DataFrame:
    """column, bytes: what the values of each column take, texts by their UTF-8, nulls nothing."""
    sizes = []
    for f in df.schema:
        c, width = F.col(f"`{f.name}`"), _WIDTHS.get(f.dataType.simpleString())
        sizes.append(F.count(c) * width if width else F.coalesce(F.sum(F.octet_length(c.cast("string"))), F.lit(0)))
    one = df.agg(*[x.cast("long").alias(f"b{i}") for i, x in enumerate(sizes)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"b{i}").alias("bytes")) for i, f in enumerate(df.schema)])))


def profile_numeric(df: DataFrame, names: list[str]) -> DataFrame:
    """column, min, max, mean, median, std, p25, p50, p75, is_integer, inconsistent of numeric columns."""
    asked = []
    for i, name in enumerate(names):
        n = number(df, name)
        asked += [
            F.min(n).alias(f"min_{i}"),
            F.max(n).alias(f"max_{i}"),
            F.avg(n).alias(f"mean_{i}"),
            F.coalesce(F.stddev_samp(n), F.lit(0.0)).alias(f"std_{i}"),
            F.coalesce(F.bool_and(n == F.floor(n)), F.lit(False)).alias(f"whole_{i}"),
            (F.count(F.col(f"`{name}`")) - F.count(n)).alias(f"bad_{i}"),
        ]
    one, middle = df.agg(*asked), quantiles(df, names, [0.25, 0.5, 0.75])
    rows = [
        F.struct(
            F.lit(name).alias("column"),
            *[r4(F.col(f"{s}_{i}")).alias(s) for s in ("min", "max", "mean")],
            r4(F.col(f"std_{i}")).alias("std"),
            F.col(f"whole_{i}").alias("is_integer"),
            F.col(f"bad_{i}").alias("inconsistent"),
        )
        for i, name in enumerate(names)
    ]
    joined = one.select(F.inline(F.array(*rows))).join(F.broadcast(middle), "column", "left")  # a row for each column
    cuts = [r4(F.col("q")[k]).alias(p) for k, p in enumerate(("p25", "p50", "p75"))]
    return joined.select("column", "min", "max", "mean", r4(F.col("q")[1]).alias("median"), "std", *cuts, "is_integer", "inconsistent")


def suspicious(df: DataFrame, names: list[str]) -> DataFrame:
    """column, negatives (of metric-like names), extremes (more than five deviations off, from 20 values on), suspicious; two passes for all columns."""
    values = {n: number(df, n) for n in names}
    limits = df.agg(*[x for i, v in enumerate(values.values()) for x in (r4(F.avg(v)).alias(f"_mean{i}"), r4(F.stddev_samp(v)).alias(f"_std{i}"), F.count(v).alias(f"_known{i}"))])
    asked = []
    for i, (name, v) in enumerate(values.items()):
        metric_like = bool(re.search(METRIC_NAME, name) or "qty" in name.lower())
        far = (F.col(f"_known{i}") >= 20) & (F.col(f"_std{i}") > 0) & (F.abs(v - F.col(f"_mean{i}")) > 5 * F.col(f"_std{i}"))
        asked += [F.count(F.when(F.lit(metric_like) & (v < 0), 1)).alias(f"_neg{i}"), F.count(F.when(far, 1)).alias(f"_far{i}")]
    one = df.join(F.broadcast(limits)).agg(*asked)  # one row
    rows = [F.struct(F.lit(n).alias("column"), F.col(f"_neg{i}").alias("negatives"), F.col(f"_far{i}").alias("extremes"), (F.col(f"_neg{i}") + F.col(f"_far{i}")).alias("suspicious")) for i, n in enumerate(names)]
    return one.select(F.inline(F.array(*rows)))


def profile_datetime(df: DataFrame, name: str) -> DataFrame:
    """column, min_date, max_date, range_days, invalid: what cannot be read, or lies outside 1900 to 2099."""
    when = moment(df, name)
    fine = F.year(when).between(1900, 2099)
    one = df.agg(F.min(F.when(fine, when)).alias("lo"), F.max(F.when(fine, when)).alias("hi"), (F.count(F.col(f"`{name}`")) - F.count(F.when(fine, 1))).alias("invalid"))
    return one.select(F.lit(name).alias("column"), F.to_date("lo").alias("min_date"), F.to_date("hi").alias("max_date"), F.datediff("hi", "lo").alias("range_days"), "invalid")


def profile_categories(df: DataFrame, names: list[str]) -> DataFrame:
    return top_categories(df, names)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """rows, duplicate_rows, duplicate_pct; nulls are equal to each other."""
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    one = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))
    return one.select("rows", "duplicate_rows", r2(F.col("duplicate_rows") / F.greatest(F.col("rows"), F.lit(1)) * 100).alias("duplicate_pct"))


def quality_score(df: DataFrame) -> DataFrame:
    """score, grade and the five components, each the share of cells, rows or values without fault."""
    found = figures(df)
    rows, cells = found[0].rows if found else 0, max(1, sum(f.rows for f in found))
    dup = duplicate_rows(df).first()["duplicate_rows"]
    dates = [f for f in found if f.classification == "datetime"]
    numeric = [f for f in found if f.classification == "numeric"]
    odd = suspicious(df, [f.name for f in numeric]).agg(F.sum("suspicious")).first()[0] if numeric else 0
    bad = {
        "completeness": (sum(f.rows - f.known for f in found), cells),
        "uniqueness": (dup, max(1, rows)),
        "type_consistency": (sum(f.known - f.numbers for f in numeric), cells),
        "date_validity": (sum(f.known - f.valid_dates for f in dates), sum(f.known for f in dates)),
        "reasonableness": (odd, sum(f.numbers for f in numeric)),
    }
    parts = {k: max(0.0, 100 * (1 - n / of)) if of else 100.0 for k, (n, of) in bad.items()}
    score = round(sum(WEIGHTS[k] * v for k, v in parts.items()), 1)
    grade = next((g for least, g in GRADES if score >= least), "Poor")
    schema = "score double, grade string, " + ", ".join(f"{k} double" for k in parts)
    return df.sparkSession.createDataFrame([(score, grade, *[round(v, 1) for v in parts.values()])], schema)
