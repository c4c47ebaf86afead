"""A corpus from raw documents to packed sequences, stage by stage.

Each stage gets the documents that its predecessor kept, written as Parquet and read again, and returns
the columns of documents; the last returns pieces of packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, line_dedup, ngram_jaccard, packing, toxicity

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of their language stay."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, less the lines of windows that occurred before; n_chars follows the text."""
    cut = line_dedup.line_dedup(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


#: A digit, a letter or any character beyond ASCII.
_WORDED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _less_emptied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs less those with an empty text whose raw text had words: all their lines occurred before.

    Rows are told by the columns that no stage changes. Of empty ones that share all of these, as many stay as had no words at first.
    """
    key = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")]).alias("key")
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wordless = raw.filter(~F.col("text").rlike(_WORDED)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    empty = docs.filter("text = ''").select(key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).join(wordless, "key")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return docs.filter("text is null or text != ''").unionByName(empty.withColumn("rank", rank).filter("rank <= n").select("doc.*"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, and none of those that line dedup emptied."""
    return ngram_jaccard.drop_near_duplicates(_less_emptied(spark, docs, sf_dir)).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, as pieces with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Scores of a trained network and a tokenizer stand in the way of SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus. What a stage wrote for itself goes when its result is written, and that when the next one is. What the returned rows rest on stays."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        before = common.written()
        made = stage(spark, docs, sf_dir)
        path = common.scratch_path(spark, f"pipeline-{name}")
        made.write.parquet(path)
        common.release(spark, [p for p in common.written() if p not in before and p != path] + last)
        docs, last = spark.read.parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)
