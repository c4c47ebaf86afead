"""Keys and references against exact inclusion."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import references


def test_keys_and_references_with_orphans_nulls_and_repeats(spark):
    rng = random.Random(4)
    shops = spark.createDataFrame([(k * 3, f"S{k}", k % 4) for k in range(400)], "shop_id long, code string, zone int")
    sales = spark.createDataFrame(
        [(k, rng.choice([None, *(3 * rng.randrange(400) for _ in range(9))]) if k % 50 else 1_000_001, f"S{rng.randrange(400)}" if k % 20 else "gone", f"x{k}") for k in range(3000)], "sale long, shop_id int, code string, note string"
    )
    keys, found = references.discover({"shops": shops, "sales": sales})
    assert {tuple(r)[:2] for r in keys.collect()} == {("shops", "shop_id"), ("shops", "code"), ("sales", "sale"), ("sales", "note")}
    got = {(r["child"], r["child_column"], r["parent"], r["parent_column"]): (r["known"], r["orphans"]) for r in found.collect()}
    known = [r["shop_id"] for r in sales.collect() if r["shop_id"] is not None]
    assert got["sales", "shop_id", "shops", "shop_id"] == (len(known), 60)
    assert got["sales", "code", "shops", "code"] == (3000, 150)
    assert ("shops", "zone", "sales", "sale") in got and ("sales", "note", "shops", "code") not in got
    named = references.discover({"shops": shops, "sales": sales}, by_name=True)[1]
    assert {r["child_column"] for r in named.collect()} == {"shop_id", "code"}
    assert references.discover({"shops": shops, "sales": sales}, 0.0, True)[1].count() == 0
    assert references.discover({"sales": sales.limit(0)})[1].count() == 0
    with pytest.raises(ValueError):
        references.discover({})


def test_what_the_filter_lets_through_is_settled_exactly(spark, monkeypatch):
    """A filter so full that it rejects nothing changes no result."""
    monkeypatch.setattr(references, "_filter", lambda df, name: np.ones(references.BITS, bool))
    parent = spark.range(0, 2000, 2).withColumnRenamed("id", "k")
    child = spark.range(2000).select((F.col("id") % 1000 + 2).alias("k"))
    assert references.discover({"p": parent, "c": child}, 0.05, True)[1].filter("child = 'c'").count() == 0
    found = references.discover({"p": parent, "c": child}, 0.6, True)[1].filter("child = 'c'").first()
    assert found["orphans"] == 1000


def test_the_filter_of_a_key_has_all_its_values(spark):
    df = spark.range(20_000).select((F.col("id") * 7).alias("k"))
    made = references._filter(df, "k")
    hashes = lambda d: np.array([r[0] for r in d.select(F.xxhash64(F.col("k").cast("string"))).collect()])
    assert made[references._positions(hashes(df))].all()
    others = made[references._positions(hashes(df.select((F.col("k") + 1).alias("k"))))].all(axis=0)
    assert others.mean() < 0.001
