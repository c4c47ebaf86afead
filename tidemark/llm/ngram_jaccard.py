"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

Documents with the same n-gram set form a class, and one of them stands for it. Signatures of the
representatives are cut into bands; those that agree on a band meet by a shuffle on the band's hash.

Pairs that met are verified once, in one of two exact ways. Where more than ``_DENSE`` representatives
share a band, they are parts of a dense group (groups that share a member are one): its members are
dealt into blocks, every two blocks meet in a task of their own, where those pairs are compared that
share a band, and what leaves the task are link counts and a spanning forest, not pairs. All other pairs are listed, without repeats, and joined
to the texts. Classes of documents are the connected components of verified links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_by_skewed_key, materialize, mix, partitions, release_others, sized, slices, utf8, words, written

#: A pair at similarity 0.8 shares one of 30 bands of 7 rows with probability 0.999, one at 0.3 with 0.007.
N, THRESHOLD, BANDS, ROWS = 5, 0.8, 30, 7
RECALL = 1 - (1 - THRESHOLD**ROWS) ** BANDS
#: Representatives in a band from which on they are compared in blocks: listed pairs send each text once for every other one.
_DENSE = 8
_BLOCK = 128
_BYTES = 400_000
_MOST_BANDS = 400
_WEIGHTS = mix(np.arange(1001, 1065, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def banding(threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bands and rows: the most rows, up to ROWS, with which a pair at ``threshold`` shares a band with probability ``recall`` in at most _MOST_BANDS bands."""
    if not (0 < threshold <= 1 and 0 < recall < 1):
        raise ValueError("threshold must be above 0 and at most 1, recall between 0 and 1")
    for rows in range(ROWS, 0, -1):
        missed = 1 - threshold**rows
        bands = 1 if missed == 0 else max(1, math.ceil(math.log(1 - recall) / math.log(missed) - 1e-9))
        if bands <= _MOST_BANDS or rows == 1:
            return bands, rows


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(raw: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's n-grams (with repeats), and where each text's begin. A text of fewer than n words has one n-gram of them all."""
    *_, hashes, first = words(raw, at)
    counts = np.diff(first)
    each = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(each)])
    where = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], each)
    size = np.repeat(np.minimum(counts, n), each)
    total = size.astype(np.uint64)
    full = size == n
    for k in range(n):
        if full.all():
            total += hashes[where + k] * _WEIGHTS[k]
        else:
            own = size > k
            total[own] += hashes[where[own] + k] * _WEIGHTS[k]
    return mix(total), begin


def signatures(grams: np.ndarray, begin: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts by bands) of texts that have an n-gram each."""
    low, seeds = np.empty((bands * rows, len(begin) - 1), np.uint64), _seeds(bands * rows)
    for k in range(bands * rows):
        low[k] = np.minimum.reduceat((grams ^ seeds[k]) * (seeds[k] | np.uint64(1)), begin[:-1])
    out = np.zeros((bands, len(begin) - 1), np.uint64)
    for b in range(bands):
        h = np.full(len(begin) - 1, b + 1, np.uint64)
        for r in range(rows):
            h = mix(h * _WEIGHTS[60] + low[b * rows + r])
        out[b] = h
    return np.ascontiguousarray(out.T)


def _sign(n: int, bands: int, rows: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            for i, j in slices(np.diff(at), _BYTES):
                grams, begin = shingles(raw[at[i] : at[j]], at[i : j + 1] - at[i], n)
                some = np.flatnonzero(np.diff(begin))
                if not len(some):
                    continue
                starts = np.append(begin[some], begin[-1])
                keys = signatures(grams, starts, bands, rows)
                sets = [np.unique(grams[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                identity = np.array([(mix(s).sum(), mix(s ^ _WEIGHTS[63]).sum() ^ np.uint64(len(s))) for s in sets], np.uint64)  # 128 bits of a set
                ends = pa.py_buffer(np.arange(0, 16 * len(sets) + 1, 16, dtype=np.int32))
                same = pa.Array.from_buffers(pa.binary(), len(sets), [None, ends, pa.py_buffer(identity.tobytes())])
                own = pa.array(some + i)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(own), batch.column("id").take(own), same, lists], names=["row", "id", "same", "bands"]
                )

    return task


def _similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= threshold * (len(a) + len(b) - both)


def _sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    out = []
    raw, at = utf8(texts)
    for i, j in slices(np.diff(at), _BYTES):
        grams, begin = shingles(raw[at[i] : at[j]], at[i : j + 1] - at[i], n)
        out += [np.unique(grams[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
    return out


def _verify_pairs(n: int, threshold: float):
    """Columns text of a, text of b, then those to pass on; rows below the threshold go."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                b = batch.slice(k, 200)
                left, right = _sets(b.column(0), n), _sets(b.column(1), n)
                held = pa.array([_similar(x, y, threshold) for x, y in zip(left, right, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays(b.columns[2:], names=b.schema.names[2:]).filter(held)

    return task


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of a with every set of b."""
    common = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(common), 4096):
        part = common[lo : lo + 4096]
        sides = []
        for sets in (a, b):
            m = np.zeros((len(sets), len(part)), np.float32)
            for i, s in enumerate(sets):
                own = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")]
                at = np.searchsorted(part, own)
                m[i, at[part[at] == own]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _verify_units(n: int, threshold: float):
    """Rows (unit, left boolean, right boolean, rep, size, bands, text) sorted by unit; one unit is in memory at a time. Pairs that share no band are left out, as they are elsewhere.

    Yields (a, b, weight): link weights of a with b null, and edges of a spanning forest with weight null.
    """

    def verified(rows: list[tuple], texts: list[pa.Array]) -> pa.RecordBatch:
        sets = [s for t in texts for s in _sets(t, n)]
        left = [k for k, r in enumerate(rows) if r[1]]
        right = [k for k, r in enumerate(rows) if r[2]]
        both = _shared([sets[k] for k in left], [sets[k] for k in right])
        sizes = [np.array([len(sets[k]) for k in own], np.float32) for own in (left, right)]
        linked = both >= threshold * (sizes[0][:, None] + sizes[1][None, :] - both)
        bands = np.array([r[5] for r in rows])
        met = np.zeros(linked.shape, bool)
        for k in range(bands.shape[1]):
            met |= bands[left, k][:, None] == bands[right, k][None, :]
        linked &= met
        reps, weight = np.array([r[3] for r in rows]), np.array([r[4] for r in rows], np.int64)
        linked &= reps[left][:, None] < reps[right][None, :] if left == right else True
        total = np.zeros(len(rows), np.int64)
        np.add.at(total, left, linked @ weight[right])
        np.add.at(total, right, linked.T @ weight[left])
        root = np.arange(len(rows))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, j in zip(*np.nonzero(linked), strict=True):
            x, y = find(left[i]), find(right[j])
            if x != y:
                root[max(x, y)] = min(x, y)
        top = np.array([find(k) for k in range(len(rows))])
        inner = np.flatnonzero(top != np.arange(len(rows)))
        some = np.flatnonzero(total)
        a = pa.array(np.concatenate([reps[some], reps[inner]]).astype(np.int64))
        b = pa.array([None] * len(some) + reps[top[inner]].tolist(), pa.int64())
        w = pa.array(total[some].tolist() + [None] * len(inner), pa.int64())
        return pa.RecordBatch.from_arrays([a, b, w], names=["a", "b", "weight"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows, texts = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(6)]
            for k, row in enumerate(zip(*columns, strict=True)):
                if row[0] != unit and rows:
                    yield verified(rows, texts)
                    rows, texts = [], []
                unit = row[0]
                rows.append(row)
                texts.append(batch.column(6).slice(k, 1))
        if rows:
            yield verified(rows, texts)

    return task


def _star(edges: DataFrame, small: bool, total: int) -> DataFrame:
    """One star step: every node hands its neighbours (small: the lower ones and itself) the lowest node it knows."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = down if small else down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    lowest = materialize(lowest.select("u", F.least("u", "m").alias("m"), "degree"), "star-lowest")
    told = join_by_skewed_key(near, lowest, ["u"], "degree", total)
    if small:
        return told.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
    return told.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether all edges are stars: no node has two ends above it, or is both below and above another."""
    below, above = F.col("u").alias("node"), F.col("v").alias("node")
    ends = edges.select(below, F.lit(1).alias("low"), F.lit(0).alias("top")).unionByName(edges.select(above, F.lit(0).alias("low"), F.lit(1).alias("top")))
    return ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("top").alias("top")).filter("low > 1 or (low > 0 and top > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): the lowest node of its connected component. Alternates large and small stars until only stars are left."""
    now = materialize(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _settled(now):
        now = materialize(_star(now, False, 2 * now.count()), "edges")
        now = materialize(_star(now, True, now.count()), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def jaccard_join(
    docs: DataFrame, n: int = N, threshold: float = THRESHOLD, bands: int | None = None, rows: int | None = None, id_col: str = "doc_id", text_col: str = "text", target_recall: float = RECALL
) -> DataFrame:
    """One row per document: row, id, class_id, n_links long, keep boolean.

    Two documents are linked if the Jaccard similarity of their sets of ``n`` consecutive words (A-Z
    lowered) is at least ``threshold``; classes are the connected components, class_id the lowest id in
    one, n_links the number of documents linked to this one, copies included. keep is true for one
    document of each class, that with the lowest id (of rows that share it, one). A text of fewer words
    has the one n-gram of them all; null, empty and wordless texts are classes of their own. Null ids
    come before others. Other columns are not read. A pair at the threshold is found with probability
    ``target_recall`` or more, unless both bands and rows are given.
    """
    bands, rows = _chosen(threshold, target_recall, bands, rows)
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return _join(materialize(own, "jaccard-docs"), n, threshold, bands, rows)


def _chosen(threshold: float, recall: float, bands: int | None, rows: int | None) -> tuple[int, int]:
    if (bands is None) != (rows is None):
        raise ValueError("give both bands and rows, or neither")
    return banding(threshold, recall) if bands is None else (bands, rows)


def drop_near_duplicates(
    docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", target_recall: float = RECALL, bands: int | None = None, rows: int | None = None
) -> DataFrame:
    """The rows of docs that jaccard_join would keep, with all their columns."""
    bands, rows = _chosen(threshold, target_recall, bands, rows)
    before = written()
    packed = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "jaccard-docs")
    keyed = packed.select("row", F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{text_col}`").cast("string").alias("text"))
    gone = materialize(_join(keyed, n, threshold, bands, rows).filter(~F.col("keep")).select("row"), "near-duplicates")
    release_others(docs.sparkSession, before, "jaccard-docs", "near-duplicates")
    return packed.join(sized(gone, gone.count()), "row", "left_anti").select("doc.*")


def _join(keyed: DataFrame, n: int, threshold: float, bands: int, rows: int) -> DataFrame:
    kind = keyed.schema["id"].dataType.simpleString()
    signed = materialize(keyed.mapInArrow(_sign(n, bands, rows), f"row long, id {kind}, same binary, bands array<long>"), "signatures")
    best = F.min(F.struct("id", "row", "bands")).alias("best")
    classes = signed.groupBy("same").agg(best, F.count(F.lit(1)).alias("size"))
    classes = materialize(classes.select("same", "size", F.col("best.row").alias("rep"), F.col("best.id").alias("id"), "best.bands"), "classes")
    edges, weights = _links(keyed.select("row", "text"), classes, n, threshold)
    roots = components(edges)
    linked = classes.select("same", "size", "rep", "id").join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(weights, "rep", "left")
    linked = materialize(linked.withColumn("root", F.coalesce("root", "rep")), "linked")
    lowest = linked.groupBy("root").agg(F.min(F.struct("id", "rep")).alias("low"), F.count(F.lit(1)).alias("n"))
    lowest = materialize(lowest, "class-ids")
    named = join_by_skewed_key(linked, lowest, ["root"], "n", classes.count())
    named = materialize(
        named.select("same", "size", "rep", F.col("low.id").alias("class_id"), F.col("low.rep").alias("first"), (F.coalesce("weight", F.lit(0)) + F.col("size") - 1).alias("n_links")), "named-classes"
    )
    told = join_by_skewed_key(signed.select("row", "same"), named, ["same"], "size", signed.count())
    told = told.select("row", "class_id", "n_links", (F.col("row") == F.col("first")).alias("keep"), F.lit(True).alias("worded"))
    worded = F.col("worded").isNotNull()
    return keyed.select("row", "id").join(told, "row", "left").select(
        "row",
        "id",
        F.when(worded, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("keep", F.lit(True)).alias("keep"),
    )


def _links(texts: DataFrame, classes: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) that span every component of linked classes, and (rep, weight): documents in the classes linked to a class."""
    banded = classes.select("rep", F.posexplode("bands").alias("band", "hash")).select("rep", F.xxhash64("band", "hash").alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("hub")).filter("m > 1")
    buckets = materialize(buckets, "buckets")
    met = materialize(join_by_skewed_key(banded, buckets, ["key"], "m", classes.count()), "bucket-members")
    crowded = met.filter(F.col("m") > _DENSE)
    dense = components(crowded.select(F.col("rep").alias("u"), F.col("hub").alias("v")))
    dense = materialize(dense.select(F.col("node").alias("rep"), F.col("root").alias("group")), "dense")
    few = met.filter(F.col("m") <= _DENSE).join(dense, "rep", "left").select("key", "rep", "group")
    pairs = few.alias("x").join(few.alias("y"), "key").filter("x.rep < y.rep and not (x.group <=> y.group and x.group is not null)")
    pairs = materialize(pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct(), "pairs")
    needed = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).unionByName(dense.select(F.col("rep").alias("row"))).distinct()
    needed = materialize(needed, "needed")
    held = texts.join(sized(needed, needed.count()), "row", "left_semi").withColumnRenamed("row", "rep")
    held = materialize(held.join(classes.select("rep", "size", "bands"), "rep"), "needed-texts")
    left, right = (held.select(F.col("rep").alias(c), F.col("size").alias(f"size_{c}"), F.col("text").alias(f"text_{c}")) for c in "ab")
    paired = pairs.join(left, "a").join(right, "b").select("text_a", "text_b", "a", "b", "size_a", "size_b")
    links = materialize(paired.mapInArrow(_verify_pairs(n, threshold), "a long, b long, size_a long, size_b long"), "links")
    blocks = dense.groupBy("group").agg(F.count(F.lit(1)).alias("c")).select("group", F.ceil(F.col("c") / _BLOCK).cast("int").alias("blocks"), "c")
    dealt = join_by_skewed_key(dense, materialize(blocks, "blocks"), ["group"], "c", max(1, dense.count())).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    meets = dealt.select("rep", "group", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    units = meets.select("rep", F.xxhash64("group", lo, hi).alias("unit"), (F.col("block") == lo).alias("left"), (F.col("block") == hi).alias("right"))
    shipped = units.join(held, "rep").select("unit", "left", "right", "rep", "size", "bands", "text").repartition(partitions(texts.sparkSession), "unit").sortWithinPartitions("unit", "rep")
    found = materialize(shipped.mapInArrow(_verify_units(n, threshold), "a long, b long, weight long"), "dense-links")
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(found.filter("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")))
    weights = (
        links.select(F.col("a").alias("rep"), F.col("size_b").alias("weight"))
        .unionByName(links.select(F.col("b").alias("rep"), F.col("size_a").alias("weight")))
        .unionByName(found.filter("b is null").select(F.col("a").alias("rep"), "weight"))
    )
    return edges, weights.groupBy("rep").agg(F.sum("weight").alias("weight"))
