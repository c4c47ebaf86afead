"""Profiles of growing tables from sketches that are kept for each file.

A file's row for a column has its counts, extremes and sum, a HyperLogLog sketch of its distinct values and, of
numbers, a KLL sketch of their distribution. All of them merge, so a table's profile comes from the rows
of the files it has now, and only files that are new or have changed are ever read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import is_numeric, r2, r4

#: Size of the sketches. Distinct counts are then off by 0.8 % in one deviation, quantiles by 0.9 % of the rows in rank (99 of 100 times).
HLL_LOG, KLL_SIZE = 14, 400
DISTINCT_ERROR, RANK_ERROR = 0.008, 0.009
_SCHEMA = "file string, modified timestamp, bytes long, column string, type string, rows long, known long, low double, high double, least string, most string, total double, distinct binary, spread binary"


def _normal(path: Column) -> Column:
    """One way to write a local path."""
    return F.regexp_replace(path, "^file:/+", "file:/")


class FileProfiles:
    """Sketches of a parquet table's files, in a folder of their own."""

    def __init__(self, spark: SparkSession, table: str, path: str) -> None:
        self.spark, self.table, self.path = spark, table.rstrip("/"), path

    def files(self) -> DataFrame:
        """file, modified, bytes of what the table has now; contents are not read."""
        listed = self.spark.read.format("binaryFile").options(pathGlobFilter="*.parquet", recursiveFileLookup=True).load(self.table)
        return listed.select(_normal(F.col("path")).alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))

    def _kept(self) -> DataFrame:
        empty = self.spark.createDataFrame([], _SCHEMA)
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return empty
        return self.spark.read.schema(empty.schema).parquet(self.path)

    def update(self) -> list[str]:
        """Sketch the files that are new or have changed since they were sketched; which these were."""
        known = self._kept().select("file", "modified", "bytes").distinct()
        fresh = self.files().join(known, ["file", "modified", "bytes"], "left_anti")
        paths = sorted(r["file"] for r in fresh.select("file").collect())  # Spark's reader takes paths from the driver too
        if not paths:
            return []
        rows = self.spark.read.parquet(*paths)
        named = rows.select(_normal(F.col("_metadata.file_path")).alias("_file"), *[F.col(f"`{c}`") for c in rows.columns])
        asked, told = [F.count(F.lit(1)).alias("rows")], []
        for i, f in enumerate(rows.schema):
            c, number = F.col(f"`{f.name}`"), is_numeric(f.dataType) and not isinstance(f.dataType, T.BooleanType)
            text, value = c.cast("string"), c.cast("double")
            asked += [F.count(c).alias(f"known{i}"), F.hll_sketch_agg(text, F.lit(HLL_LOG)).alias(f"distinct{i}")]
            asked += [F.min(value).alias(f"low{i}"), F.max(value).alias(f"high{i}"), F.sum(value).alias(f"total{i}"), F.kll_sketch_agg_double(value, F.lit(KLL_SIZE)).alias(f"spread{i}")] if number else [F.min(text).alias(f"least{i}"), F.max(text).alias(f"most{i}")]
            none = {"low": "double", "high": "double", "total": "double", "spread": "binary", "least": "string", "most": "string"}
            have = ("low", "high", "total", "spread") if number else ("least", "most")
            cells = {n: F.col(f"{n}{i}") if n in have else F.lit(None).cast(t) for n, t in none.items()}
            told.append(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"known{i}").alias("known"), *[cells[n].alias(n) for n in ("low", "high", "least", "most", "total")], F.col(f"distinct{i}").alias("distinct"), cells["spread"].alias("spread")))
        made = named.groupBy("_file").agg(*asked).select(F.col("_file").alias("file"), "rows", F.inline(F.array(*told)))
        empty = self.spark.createDataFrame([], _SCHEMA)
        fresh.join(made, "file").select(*empty.columns).write.mode("append").parquet(self.path)
        return paths

    def profile(self) -> DataFrame:
        """column, type, rows, null_count, null_pct, distinct_count (estimated), min, max, mean, p25, median, p75 of the table as its sketched files make it up.

        Numbers have min and max as text too; figures that only numbers have are null for other columns.
        """
        now = self._kept().join(F.broadcast(self.files()), ["file", "modified", "bytes"], "left_semi").dropDuplicates(["file", "column"])
        cut = lambda p: F.when(F.col("high").isNotNull(), r4(F.kll_sketch_get_quantile_double("spread", F.lit(p))))
        one = now.groupBy("column").agg(
            F.max("type").alias("type"), F.sum("rows").alias("rows"), F.sum("known").alias("known"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"),
            F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct_count"), F.kll_merge_agg_double("spread").alias("spread"),
        )
        nulls = F.col("rows") - F.col("known")
        return one.select(
            "column", "type", "rows", nulls.alias("null_count"), r2(nulls / F.greatest("rows", F.lit(1)) * 100).alias("null_pct"), "distinct_count", F.coalesce("least", F.col("low").cast("string")).alias("min"), F.coalesce("most", F.col("high").cast("string")).alias("max"),
            r4(F.try_divide("total", "known")).alias("mean"), *[cut(p).alias(n) for n, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))],
        )
