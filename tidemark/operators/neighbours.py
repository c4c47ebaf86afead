"""Nearest neighbours by cosine over an inverted-file index.

Centroids come from spherical k-means over a bounded sample. Every vector is written to the list of its
nearest centroid. A query asks the lists of its ``probes`` nearest centroids: vectors and queries of a list
are dealt into blocks, each two blocks meet in one task, a matrix product scores them exactly, and the
best of each query leave it. So a list or a set of queries of any size is split, and no pair of rows is
ever made. With all lists probed the search is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bounds: rows of the training sample, lists of an index, bytes of centroids that tasks get.
SAMPLE, LISTS, CENTROID_BYTES = 20_000, 4096, 64 << 20
#: Vectors and queries of a block.
BLOCK = 2048
_CALIBRATION = 200


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros stays one."""
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def kmeans(rows: np.ndarray, k: int, rounds: int = 15, seed: int = 5) -> np.ndarray:
    """Centroids (unit rows) of unit rows. A centroid that loses all its rows moves to the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centroids = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        scores = rows @ centroids.T
        own = scores.argmax(axis=1)
        sums, sizes = np.zeros_like(centroids), np.bincount(own, minlength=k)
        np.add.at(sums, own, rows)
        empty = np.flatnonzero(sizes == 0)
        if len(empty):
            sums[empty] = rows[np.argsort(scores[np.arange(len(rows)), own])[: len(empty)]]
        made = _unit(sums)
        if np.allclose(made, centroids, atol=1e-9):
            break
        centroids = made
    return centroids


def _probes_for(rows: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """Fewest lists with which some hundred rows of the sample find that share of their k best within the sample."""
    asked = rows[np.linspace(0, len(rows) - 1, min(_CALIBRATION, len(rows))).astype(int)]
    own = (rows @ centroids.T).argmax(axis=1)
    order = np.argsort(-(asked @ centroids.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centroids)), order.shape), axis=1)
    best = np.argsort(-(asked @ rows.T), axis=1)[:, :k]
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).reshape(-1))
    return int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)]) + 1


@dataclass
class Index:
    """An index in a folder: ``lists`` (list int, id, vector), a folder for each list, and ``centroids``."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    probes: int
    id_type: str

    @property
    def lists(self) -> DataFrame:
        return self.spark.read.schema(f"id {self.id_type}, vector array<double>, list int").parquet(f"{self.path}/lists")


def _valid(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    own = vectors.select(F.col(f"`{id_col}`").alias("id"), vector.alias("vector"))
    return own.filter(F.col("id").isNotNull() & (F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))


def _nearest(centroids, dim: int, probes: int):
    def task(batches):
        c = centroids.value
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                scores = _unit(_matrix(part.column("vector"), dim)) @ c.T
                best = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
                row = np.repeat(np.arange(part.num_rows), best.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(best.reshape(-1).astype(np.int32)), *(part.column(c).take(pa.array(row)) for c in ("id", "vector"))], names=["list", "id", "vector"])

    return task


def _assigned(own: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """Rows (list, id, vector): each vector with its ``probes`` nearest lists."""
    held = own.sparkSession.sparkContext.broadcast(centroids)  # at most CENTROID_BYTES
    return own.mapInArrow(_nearest(held, centroids.shape[1], probes), f"list int, id {own.schema['id'].dataType.simpleString()}, vector array<double>")


def build(vectors: DataFrame, path: str, lists: int | None = None, k: int = 10, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> Index:
    """Write an index of all vectors below ``path``.

    Rows without an id, and vectors that are null, hold nulls or have another length than the first, are
    left out; vectors of zeros have similarity 0 to all. Centroids are trained on at most ``sample``
    vectors, in order of a hash of their ids: the root of the rows' number of them unless ``lists`` is
    given, at most LISTS. probes is the number of lists by which the sample's own neighbours are found
    with ``recall``.
    """
    spark = vectors.sparkSession
    first = vectors.filter(F.size(f"`{vector_col}`") > 0).select(F.size(f"`{vector_col}`")).first()
    dim = first[0] if first else 1
    own = _valid(vectors, id_col, vector_col, dim)
    rows = own.count()
    drawn = own.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()  # at most sample rows
    points = _unit(_matrix(drawn.column("vector"), dim)) if rows else np.zeros((1, dim))
    n = max(1, min(lists or int(np.sqrt(rows)), LISTS, len(points), CENTROID_BYTES // (8 * dim)))
    centroids = kmeans(points, n)
    probes = _probes_for(points, centroids, min(k + 1, len(points)), recall)
    # a list of a third of all rows is written by as many tasks as its rows fill
    spread = _assigned(own, centroids, 1).withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(max(1, rows // (n * BLOCK)))))
    spread.repartition("list", "_salt").drop("_salt").write.partitionBy("list").parquet(f"{path}/lists")
    kept = [(i, probes, own.schema["id"].dataType.simpleString(), c.tolist()) for i, c in enumerate(centroids)]
    spark.createDataFrame(kept, "list int, probes int, id_type string, centroid array<double>").write.parquet(f"{path}/centroids")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    kept = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # at most LISTS rows
    return Index(spark, path, np.array([r["centroid"] for r in kept]), kept[0]["probes"], kept[0]["id_type"])


def _best(dim: int, k: int, kinds: pa.Schema):
    def unit(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return kinds.empty_table()
        q, v = (_unit(_matrix(t.column("vector"), dim)) for t in (queries, vectors))
        scores = np.round(q @ v.T, 6)
        ids = vectors.column("id").combine_chunks()
        order = pa.compute.sort_indices(pa.table({"id": ids}), [("id", "ascending")]).to_numpy()  # of equal scores the lowest id wins
        top = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, :k]]
        row = np.repeat(np.arange(len(q)), top.shape[1])
        return pa.table({"query_id": queries.column("id").take(pa.array(row)), "id": pa.chunked_array([ids]).take(pa.array(top.reshape(-1))), "score": scores[row, top.reshape(-1)]}).cast(kinds)

    return unit


def _counts(rows: DataFrame, name: str) -> DataFrame:
    return F.broadcast(rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name)))  # a row for each list


def search(index: Index, queries: DataFrame, k: int = 10, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank int, id, score: for every query the k vectors of highest cosine (six decimals, ties by id), of the lists probed.

    probes is the index's by default; as many as it has lists make the search exact. A query that is no
    vector of the index's length gets no rows; one without ``k`` vectors in its lists gets fewer.
    """
    dim, lists = index.centroids.shape[1], len(index.centroids)
    asked = _assigned(_valid(queries, id_col, vector_col, dim), index.centroids, min(probes or index.probes, lists))
    vectors = index.lists.select("list", "id", "vector")
    held, asking = _counts(vectors, "nv"), _counts(asked, "nq")
    both = held.join(asking, "list")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(F.broadcast(both), "list").select("list", place("nq").alias("q"), every("nv").alias("v"), "id", "vector")
    right = vectors.join(F.broadcast(both), "list").select("list", every("nq").alias("q"), place("nv").alias("v"), "id", "vector")
    kinds = pa.schema([("query_id", _arrow(asked, "id")), ("id", _arrow(vectors, "id")), ("score", pa.float64())])
    names = f"query_id {asked.schema['id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    found = left.groupBy("list", "q", "v").cogroup(right.groupBy("list", "q", "v")).applyInArrow(_best(dim, k, kinds), names)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    return df.limit(0).select(name).toArrow().schema.field(name).type
