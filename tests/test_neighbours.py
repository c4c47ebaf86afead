"""Nearest neighbours over an index against brute force in numpy."""

import numpy as np
import pytest

from tidemark.operators import neighbours

SF = "/root/testdata/sf0.1/embeddings.parquet"


def brute(ids, rows, asked, k):
    unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit[asked] @ unit.T, 6)
    return {int(ids[q]): [int(ids[j]) for j in np.lexsort((ids, -s))[:k]] for q, s in zip(asked, scores, strict=True)}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_recall_over_all_vectors_and_the_exact_mode(spark, tmp_path):
    vectors = spark.read.parquet(SF)
    local = vectors.toPandas()
    ids, rows = local["vec_id"].to_numpy(), np.stack(local["embedding"]).astype(np.float64)
    asked = np.flatnonzero(ids % 50 == 0)
    want = brute(ids, rows, asked, 10)
    index = neighbours.build(vectors, str(tmp_path / "index"))
    assert index.lists.count() == len(ids) and 1 < index.probes <= len(index.centroids) == 44
    queries = vectors.filter("vec_id % 50 = 0")
    got = found(neighbours.search(index, queries))
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.95
    assert found(neighbours.search(index, queries, probes=len(index.centroids))) == want


def test_lists_of_any_size_are_dealt_into_blocks(spark, tmp_path, monkeypatch):
    """A third of all vectors are one and the same, and blocks hold five."""
    monkeypatch.setattr(neighbours, "BLOCK", 5)
    rng = np.random.default_rng(1)
    rows = np.concatenate([np.tile(rng.normal(size=8), (60, 1)), rng.normal(size=(120, 8)), np.zeros((2, 8))])
    ids = np.arange(len(rows)) * 3 % 197
    index = neighbours.build(spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, rows, strict=True)], "vec_id long, embedding array<double>"), str(tmp_path / "index"), lists=6)
    queries = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids[::2], rows[::2], strict=True)], "vec_id long, embedding array<double>")
    search = neighbours.search(index, queries, 7, probes=6)
    assert found(search) == brute(ids, rows, np.arange(0, len(rows), 2), 7)
    plan = search._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_rows_that_are_no_vectors_and_an_empty_table(spark, tmp_path):
    odd = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [1.0]), (5, [1.0, None]), (None, [1.0, 0.0]), (6, [float("nan"), 1.0]), (7, [0.0, 0.0])]
    index = neighbours.build(spark.createDataFrame(odd, "id int, v array<double>"), str(tmp_path / "odd"), id_col="id", vector_col="v")
    got = found(neighbours.search(index, spark.createDataFrame(odd, "id int, v array<double>"), 9, probes=9, id_col="id", vector_col="v"))
    assert got == {1: [1, 2, 7], 2: [2, 1, 7], 7: [1, 2, 7]}
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.search(neighbours.build(none, str(tmp_path / "none")), none).count() == 0
    again = neighbours.load(spark, str(tmp_path / "odd"))
    assert again.probes == index.probes and np.array_equal(again.centroids, index.centroids)


def test_kmeans_refills_empty_lists():
    rows = neighbours._unit(np.repeat(np.eye(4), 25, axis=0))
    made = neighbours.kmeans(rows, 4, seed=0)
    assert len(np.unique((rows @ made.T).argmax(axis=1))) == 4
    with pytest.raises(ValueError):
        neighbours.kmeans(rows[:2], 3)
