"""Forests over tables: depths against recursion, and the same scores however rows are dealt."""

import numpy as np
import pytest

from tidemark.operators import isolation


def _table(spark, parts: int):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(size=(2000, 2)), [[9.0, -8.0], [7.5, 9.0], [-9.0, 0.5]]])
    rows = [(int(k), float(a), float(b)) for k, (a, b) in enumerate(points)] + [(9000, None, 1.0), (9001, 1.0, float("nan"))]
    return spark.createDataFrame(rows, "k long, a double, b double").repartition(parts), points


def _depth(forest, node: int, point) -> float:
    if forest.feature[node] < 0:
        return forest.depth[node]
    return _depth(forest, forest.low[node] if point[forest.feature[node]] < forest.cut[node] else forest.high[node], point)


def test_scores_follow_from_paths_and_not_from_partitions(spark):
    df, points = _table(spark, 3)
    forest = isolation.fit(df, ["k"], ["a", "b"], trees=40)
    got = {r["k"]: r["score"] for r in isolation.isolation_scores(df, ["k"], ["a", "b"], forest=forest).collect()}
    assert got.keys() == set(range(len(points))) and len(forest.roots) == 40 and forest.sample == 256
    for k in (0, 17, 999, 2000, 2001, 2002):
        mean = np.mean([_depth(forest, r, points[k]) for r in forest.roots])
        assert got[k] == pytest.approx(2 ** (-mean / isolation.mean_depth(256)), abs=6e-5)
    assert {2000, 2001} <= set(sorted(got, key=got.get)[-5:])  # the far corners
    other = {r["k"]: r["score"] for r in isolation.isolation_scores(_table(spark, 11)[0], ["k"], ["a", "b"], trees=40).collect()}
    assert other == got


def test_trees_split_every_sample_and_stop_where_nothing_varies(spark):
    same = spark.createDataFrame([(k, 1.0) for k in range(50)], "k long, a double")
    forest = isolation.fit(same, ["k"], ["a"], trees=3)
    assert (forest.feature == -1).all() and len(forest.feature) == 3
    assert {r["score"] for r in isolation.isolation_scores(same, ["k"], ["a"], forest=forest).collect()} == {0.5}
    assert isolation.isolation_scores(same.limit(0), ["k"], ["a"]).count() == 0
    few = spark.createDataFrame([(k, float(k)) for k in range(4)], "k long, a double")
    made = isolation.fit(few, ["k"], ["a"], trees=5)
    for root in made.roots:
        assert {_depth(made, root, [float(k)]) > 0 for k in range(4)} == {True}


def test_a_forest_reads_its_table_once(spark):
    df, points = _table(spark, 3)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    forest = isolation.fit(df.mapInArrow(counted, df.schema), ["k"], ["a", "b"], trees=5, sample=50)
    assert (len(forest.roots), forest.sample, read.value) == (5, 50, len(points) + 2)
