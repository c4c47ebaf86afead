"""SimHash near-dedup by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. A segment, filled with zeros to 23
bits, is decoded with the perfect binary Golay code [23, 12, 7]: it lies within 3 bits of exactly one
codeword, its nearest. What lies one bit from it is within 4 bits of that same codeword. So of two
segments that differ in at most one bit, each has the nearest codeword of the other among its own
codewords within 4 bits, of which there are at most six.

Of at most three errors over three segments, either some segment has none and one of the others at most
one, or each segment has exactly one. The first is met by keys of one whole segment and a codeword of
another, the second by codewords of the first two and that half of the third which has no error. Every
key has 33 bits or more. Fingerprints that share a key, nearest for one of them, are compared bit by bit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_by_skewed_key, materialize, mix, partitions
from tidemark.llm.ngram_jaccard import components

#: Fixed values of the code: its length, the bits of a message and the generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
LENGTH, MESSAGE, GENERATOR = 23, 12, 0b101011100011
#: Offset and width of each segment, and of the halves of the last one.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
HALVES = ((43, 11), (54, 10))
DISTANCE, WORDS, SEED = 3, 3, 42
#: Bytes of text cut into words at once; fingerprints compared in one task's matrix; pairs listed at once.
_PIECE, _BLOCK, _PAIRS = 1 << 20, 2048, 1 << 21
#: A group of more members hands on a tree of its links, not every link.
_LISTED = 8
_BLANK = re.compile(rb"[ \t-\r]")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words divided by the generator, over GF(2)."""
    left = words.astype(np.int64)
    for bit in range(LENGTH - 1, LENGTH - MESSAGE - 1, -1):
        left = np.where(left >> bit & 1, left ^ (GENERATOR << (bit - (LENGTH - MESSAGE))), left)
    return left


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every syndrome: the pattern of at most three bits that has it, and the five of four bits (or that first one again, where there are none)."""
    pattern = lambda bits: sum(1 << b for b in bits)
    few = np.array([pattern(c) for k in range(4) for c in combinations(range(LENGTH), k)])
    leader = np.zeros(1 << (LENGTH - MESSAGE), np.int64)
    leader[_syndromes(few)] = few
    four = np.array([pattern(c) for c in combinations(range(LENGTH), 4)])
    at = _syndromes(four)
    order = np.argsort(at, kind="stable")
    owners, first = np.unique(at[order], return_index=True)
    near = np.repeat(leader[:, None], 6, axis=1)
    near[owners, 1:] = four[order][first[:, None] + np.arange(5)]
    return leader, near


_LEADER, _NEAR = _tables()


def codewords(segments: np.ndarray) -> np.ndarray:
    """Indices (n by 6) of the codewords within four bits of each segment, the nearest first; where there are fewer, the nearest is repeated."""
    return (segments[:, None] ^ _NEAR[_syndromes(segments)]) >> (LENGTH - MESSAGE)


def _bits(fingerprints: np.ndarray, at: int, width: int) -> np.ndarray:
    return (fingerprints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (n by 108) of each fingerprint, and which columns are made of nearest codewords only. Keys repeat where a segment has one codeword."""
    whole = [_bits(fingerprints, *s) for s in SEGMENTS]
    coded = [codewords(w) for w in whole]
    out, nearest = [], []
    for kind, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        out.append((np.int64(kind) << 40 | whole[i] << MESSAGE)[:, None] | coded[j])
        nearest += [True] + [False] * 5
    both = (coded[0][:, :, None] << MESSAGE | coded[1][:, None, :]).reshape(len(fingerprints), -1)
    for kind, half in enumerate(HALVES, 6):
        out.append((np.int64(kind) << 40 | _bits(fingerprints, *half) << 2 * MESSAGE)[:, None] | both)
        nearest += [True] + [False] * 35
    return np.concatenate(out, axis=1), np.array(nearest)


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, some at a time, cut between words."""
    at = 0
    while at < len(text):
        gap = _BLANK.search(text, at + _PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end].lower().split()
        at = end


def _ones(shingles: Iterator[bytes]) -> tuple[np.ndarray, int]:
    """How many of the hashes have each bit, lowest first, and how many there are."""
    found = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), "<u8")
    bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64), len(found)


def fingerprint(text: bytes, n: int = WORDS) -> int:
    """SimHash of a text's runs of ``n`` words; 0 without words. Memory does not grow with the text's length."""
    total, count, tail, most = np.zeros(64, np.int64), 0, [], 0
    for words in _pieces(text):
        most += len(words)
        words = tail + words
        if len(words) >= n:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            ones, k = _ones(joined[a:b] for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True))
            total, count = total + ones, count + k
        tail = words[-(n - 1) :] if n > 1 else []
    if 0 < most < n:
        total, count = _ones(iter([b" ".join(tail)]))
    return int(((2 * total > count).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def _sign(n: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            found = np.array([fingerprint(t.as_py() or b"", n) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found.view(np.int64))], names=["id", "fp"])

    return task


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 4096):
            fp = b.column("fp").slice(lo, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
            found, nearest = keys(fp)
            order = np.argsort(found, axis=1, kind="stable")  # of equal keys the nearest comes first
            ranked = np.take_along_axis(found, order, axis=1)
            own = np.ones(ranked.shape, bool)
            own[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
            fps = np.broadcast_to(fp[:, None], ranked.shape)[own]
            yield pa.RecordBatch.from_arrays([pa.array(ranked[own]), pa.array(fps.view(np.int64)), pa.array(nearest[order][own])], names=["key", "fp", "nearest"])


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= DISTANCE


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links between two sets of fingerprints, an edge from every linked one to the lowest of its component."""
    linked = _close(a[:, None], b[None, :])
    nodes = np.unique(np.concatenate([a, b]))
    label, rows, columns = np.arange(len(nodes)), *np.nonzero(linked)
    i, j = np.searchsorted(nodes, a)[rows], np.searchsorted(nodes, b)[columns]
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


_EDGES = "u long, v long, key long"


def _edges(u: np.ndarray, v: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
    """Links of fingerprints u and v; with a key, members u of a crowded group."""
    none = pa.nulls(len(u), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), none if v is None else pa.array(v.view(np.int64)), none if key is None else pa.array(key)], names=["u", "v", "key"])


def _listed(fp: np.ndarray, nearest: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links within small groups, all pairs of many groups compared at once; some millions of pairs are held."""
    owner = np.repeat(np.arange(len(start)), size)
    member = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    near = nearest[member]
    left, group = member[near], owner[near]
    width = size[group]
    ends = np.cumsum(width)
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, side="right")))
        w = width[at:to]
        i = np.repeat(left[at:to], w)
        j = np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(start[group[at:to]], w)
        own = (i != j) & _close(fp[i], fp[j])
        u, v = np.maximum(fp[i[own]], fp[j[own]]), np.minimum(fp[i[own]], fp[j[own]])
        two = np.unique(np.stack([u, v], axis=1), axis=0)
        yield _edges(np.ascontiguousarray(two[:, 0]), np.ascontiguousarray(two[:, 1]))
        at = to


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, nearest) sorted by key. Links of each group, or of a group above _BLOCK its members, for _units."""

    def done(key: np.ndarray, fp: np.ndarray, nearest: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        some = (size > 1) & (np.add.reduceat(nearest, start) > 0)
        start, size = start[some], size[some]
        small = size <= _LISTED
        yield from _listed(fp, nearest, start[small], size[small])
        for s, k in zip(start[~small].tolist(), size[~small].tolist(), strict=True):
            own = fp[s : s + k]
            if k > _BLOCK:
                yield _edges(own, None, key[s : s + k])
            else:
                yield _edges(*_forest(own[nearest[s : s + k]], own))

    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        if not b.num_rows:
            continue
        key, fp, nearest = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        held.append((key, fp.view(np.uint64), nearest.astype(bool)))
        whole = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = int(np.searchsorted(whole[0], key[-1]))  # the last group may go on
        if cut:
            yield from done(*(x[:cut] for x in whole))
        if len(whole[0]) - cut > 2 * _BLOCK and whole[0][cut] == key[-1]:
            spare = _BLOCK + 1  # of a crowded group so many stay that the rest is seen to be crowded too
            yield _edges(whole[1][cut:-spare], None, whole[0][cut:-spare])
            cut = len(whole[0]) - spare
        held = [tuple(x[cut:] for x in whole)]
    if held:
        yield from done(*held[0])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (unit, left, right, fp) sorted by unit: trees of links between the two blocks of each unit."""

    def done(rows: list[np.ndarray]) -> pa.RecordBatch:
        left, right, fp = (np.concatenate(x) for x in zip(*rows, strict=True))
        return _edges(*_forest(fp[left], fp[right]))

    at, rows = None, []
    for b in batches:
        unit, left, right, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in range(4))
        cuts = np.concatenate([[0], np.flatnonzero(unit[1:] != unit[:-1]) + 1, [len(unit)]]) if len(unit) else np.zeros(1, int)
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if unit[s] != at and rows:
                yield done(rows)
                rows = []
            at = unit[s]
            rows.append((left[s:e].astype(bool), right[s:e].astype(bool), fp[s:e].view(np.uint64)))
    if rows:
        yield done(rows)


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) that span every component of distinct fingerprints (column fp long) linked at DISTANCE bits or fewer."""
    n = partitions(fps.sparkSession)
    spread = fps.select("fp").repartition(n).mapInArrow(_keyed, "key long, fp long, nearest boolean")
    found = materialize(spread.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_within, _EDGES), "simhash-links")
    crowded = found.filter(F.col("key").isNotNull()).select("key", F.col("u").alias("fp"))
    blocks = crowded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).select("key", "m", F.ceil(F.col("m") / _BLOCK).cast("int").alias("blocks"))
    blocks = materialize(blocks, "simhash-crowded")
    dealt = join_by_skewed_key(crowded, blocks, ["key"], "m", max(1, crowded.count())).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    meets = dealt.select("key", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    units = meets.select(F.xxhash64("key", lo, hi).alias("unit"), (F.col("block") == lo).alias("left"), (F.col("block") == hi).alias("right"), "fp")
    more = units.repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(_units, _EDGES)
    return found.filter(F.col("key").isNull()).select("u", "v").unionByName(more.select("u", "v")).distinct()


def simhash_dedup(docs: DataFrame, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 lowercase hex digits), component_id, n_docs long, keep boolean.

    Words are runs of anything but blanks (space, tab to carriage return), A-Z lowered; a bit of the
    fingerprint is 1 if more than half of the XXH64 hashes of all runs of ``n`` words have it, repeats
    included. A text of fewer words has the one run of them all; null, empty and wordless texts have
    fingerprint zero and are linked like any other. Documents are linked at three bits of difference or
    fewer. component_id is the lowest id that links lead to, null only where no document of the component
    has an id; n_docs is the component's size; keep is true for the documents that have the component's id
    (of rows that share an id, all). An empty table gives no rows. Other columns are not read.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    signed = materialize(texts.mapInArrow(_sign(n), f"id {kind}, fp long"), "simhash")
    groups = materialize(signed.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")), "simhash-groups")
    roots = materialize(components(links(groups)), "simhash-roots")
    rooted = materialize(groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-rooted")
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("k"))
    named = materialize(named, "simhash-components")
    told = join_by_skewed_key(rooted.select("fp", "n", "root"), named, ["root"], "k", max(1, rooted.count()))
    told = materialize(told.select("fp", "n", "component_id", "n_docs"), "simhash-named")
    out = join_by_skewed_key(signed, told, ["fp"], "n", max(1, signed.count()))
    return out.select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_docs", F.col("id").eqNullSafe(F.col("component_id")).alias("keep"))
