"""Most frequent values and file profiles against full counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators.aggregate import top_categories
from tidemark.operators.file_profiles import DISTINCT_ERROR, RANK_ERROR, FileProfiles
from tidemark.operators.heavy_hitters import heavy_hitters


def test_first_values_are_those_of_a_full_count_by_each_way(spark):
    rng = random.Random(8)
    rows = [(rng.choice("abc"), f"v{min(int(rng.paretovariate(0.7)), 5000)}", f"u{k}", None if k % 3 else k % 5) for k in range(20_000)]
    df = spark.createDataFrame(rows, "few string, skewed string, unique string, gaps int").repartition(6)
    found = heavy_hitters(df, df.columns, 7, counters=100)
    assert found.ways == {"few": "counters", "skewed": "recount", "unique": "full", "gaps": "counters"}
    got = {}
    for r in found.rows.orderBy("rank").collect():
        got.setdefault(r["column"], []).append((r["value"], r["n"]))
        assert r["total"] == sum(x[df.columns.index(r["column"])] is not None for x in rows)
    for i, name in enumerate(df.columns):
        counts = Counter(str(r[i]) for r in rows if r[i] is not None)
        assert got[name] == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:7]
    with pytest.raises(ValueError):
        heavy_hitters(df, ["few"], 9, counters=3)


def test_counters_that_tie_with_what_was_lost_are_counted_in_full(spark):
    """Every value occurs twice, so no counter is ahead of the values without one."""
    df = spark.createDataFrame([(f"v{k % 600}",) for k in range(1200)], "x string").coalesce(1)
    found = heavy_hitters(df, ["x"], 3, counters=50)
    assert found.ways == {"x": "full"} and [(r["value"], r["n"]) for r in found.rows.orderBy("rank").collect()] == [("v0", 2), ("v1", 2), ("v10", 2)]
    none = spark.createDataFrame([], "x string")
    assert heavy_hitters(none, ["x"], 3).rows.count() == 0
    shares = top_categories(df.unionByName(df.limit(2)), ["x"], 1).first()
    assert shares["pct"] == round(shares["n"] / 1202 * 100, 2)


def test_profiles_of_a_growing_table_read_new_files_only(spark, tmp_path):
    table, kept = str(tmp_path / "table"), str(tmp_path / "kept")
    part = lambda lo, hi: spark.range(lo, hi).select((F.col("id") % 7000).alias("k"), F.sqrt("id").alias("x"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("n"), F.col("id") % 900)).alias("name"))
    part(0, 30_000).repartition(3).write.parquet(table)
    profiles = FileProfiles(spark, table, kept)
    assert len(profiles.update()) == 3 and profiles.update() == []
    part(30_000, 50_000).repartition(2).write.mode("append").parquet(table)
    assert len(profiles.update()) == 2
    got = {r["column"]: r for r in profiles.profile().collect()}
    whole = part(0, 50_000)
    for name in ("k", "x", "name"):
        exact = whole.agg(F.count_distinct(name)).first()[0]
        assert abs(got[name]["distinct_count"] - exact) <= 4 * DISTINCT_ERROR * exact
        assert got[name]["rows"] == 50_000 and got[name]["null_count"] == whole.filter(F.col(name).isNull()).count()
    for column, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)):
        below = whole.filter(F.col("x") <= got["x"][column]).count() / 50_000
        assert abs(below - p) <= 2 * RANK_ERROR
    assert (got["name"]["min"], got["name"]["max"], got["name"]["median"]) == ("n1", "n99", None) and float(got["x"]["max"]) == pytest.approx(49_999**0.5)
    assert got["x"]["mean"] == pytest.approx(whole.agg(F.avg("x")).first()[0], abs=1e-3)
    # a file that is gone counts no more, one that is written anew is read again
    whole.limit(100).coalesce(1).write.mode("overwrite").parquet(table)
    assert len(profiles.update()) == 1 and {r["rows"] for r in profiles.profile().collect()} == {100}
