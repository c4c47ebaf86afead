"""Prefix trie of conversations from padded matrices of turn ids.

A turn's id is the MD5 of its role and text, a conversation the row of its turns' ids. Shards are ranges of
these rows in lexical order. A shard numbers its ids in order and fills rows with zeros to a matrix, some
columns at a time; numpy's lexsort orders the rows, a column's mask says where a row differs from the one
before, and masks accumulated by OR along a row mark where nodes start at every depth. reduceat over the
starts counts members and finds the lowest, and sums over children run from the deepest column up.

A node whose rows reach a shard's first or last row may go on next door. A shard has at most as many of
these as its first and last row have turns. They are handed on as parts and put together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, join_by_skewed_key, materialize, partitions

#: Columns of a matrix that are held at once, turns of a shard, ids of one piece of a list.
_COLUMNS, _TURNS, _PIECE = 32, 1_000_000, 512
_ROOT = hashlib.md5(b"").digest()
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODES = "kind string, conv_id long, depth long, parent_conv_id long, parent binary, node binary, n_convs long, n_children long, n_leaves long, saved_tokens long, n_words long, ends_sha256 string, shard int, piece int, ids string"
_FIELDS = [f.split()[0] for f in _NODES.split(", ")]


def turn_sequences(rows: DataFrame) -> DataFrame:
    """(conv_id long, turns array of (id binary, n_words int)) of rows (conv_id, turn, role, text).

    Turns are in order, a null number first, and those that share a number by their ids. Null role or text
    counts as empty; words are runs of anything but blanks. Rows without conv_id belong to no conversation
    and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    identity = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), identity.alias("id"), words.cast("int").alias("n_words"))
    narrow = rows.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["n_words"].alias("n_words")))
    return narrow.groupBy("conv_id").agg(ordered.alias("turns"))


def share_heads(sequences: DataFrame, every: int = 20, kinds: int = 4) -> DataFrame:
    """Sequences whose first h turns are those of conversation c - c % every (as many as it has), h being crc32 of the decimal c modulo ``kinds``; % has the sign of c."""
    heads = sequences.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, kinds - 1).alias("shared"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % kinds).cast("int")
    own = sequences.withColumns({"h": h, "head": F.col("conv_id") - F.col("conv_id") % every})
    none = F.array().cast(sequences.schema["turns"].dataType)
    shared = F.when(F.col("h") > 0, F.slice(F.coalesce("shared", none), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(none)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(heads, "head", "left").select("conv_id", F.concat(shared, rest).alias("turns"))


def _codes(raw: np.ndarray) -> np.ndarray:
    """Numbers from 1 of 16-byte ids, in their order."""
    two = raw.view(">u8").reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((two[:, 1], two[:, 0]))
    ranked = two[order]
    out = np.empty(len(two), np.int64)
    out[order] = 1 + np.concatenate([np.zeros(min(1, len(two)), np.int64), np.cumsum((ranked[1:] != ranked[:-1]).any(axis=1))])
    return out


def _padded(codes: np.ndarray, first: np.ndarray, lengths: np.ndarray, rows: np.ndarray, at: int, width: int) -> np.ndarray:
    """Columns at to at + width of the matrix of some rows; zero where a row is over."""
    place = np.arange(at, at + width)
    inside = place[None, :] < lengths[rows][:, None]
    where = np.where(inside, first[rows][:, None] + place[None, :], 0)
    return np.where(inside, codes[where], 0)


class Shard:
    """Nodes of a shard's rows, by depth: start (row in order), size, low (lowest id), parent (index one depth up), words, and the sums over subtrees."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, words: np.ndarray, lengths: np.ndarray):
        first = np.cumsum(lengths) - lengths
        longest = int(lengths.max(initial=0))
        order = np.argsort(ids, kind="stable")
        for at in range((max(longest, 1) - 1) // _COLUMNS * _COLUMNS, -1, -_COLUMNS):  # the last columns first; sorts are stable
            own = lengths[order] > at
            rows = order[own]
            matrix = _padded(codes, first, lengths, rows, at, min(_COLUMNS, longest - at))
            order = np.concatenate([order[~own], rows[np.lexsort(matrix.T[::-1])]]) if matrix.shape[1] else order
        self.order, self.ids, self.lengths, self.first = order, ids[order], lengths[order], first[order]
        n = len(order)
        self.start, self.size = [np.zeros(1, np.int64)], [np.array([n])]
        self.low, self.parent, self.words = [np.array([ids.min()])], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        rows, changed = np.arange(n), np.zeros(n, bool)
        changed[0] = True
        for at in range(0, longest, _COLUMNS):
            own = np.flatnonzero(self.lengths[rows] > at)
            between = np.cumsum(changed)[own]
            rows = rows[own]
            carried = np.diff(between, prepend=0) > 0
            matrix = _padded(codes, self.first, self.lengths, rows, at, min(_COLUMNS, longest - at))
            differs = np.ones(matrix.shape, bool)
            differs[1:] = matrix[1:] != matrix[:-1]
            differs[:, 0] |= carried
            masks = np.logical_or.accumulate(differs, axis=1)
            for j in range(matrix.shape[1]):
                self._column(rows, masks[:, j], matrix[:, j] > 0, at + j, words)
            changed = masks[:, -1]
        self.children = [np.bincount(p, minlength=len(s)) for p, s in zip(self.parent[1:], self.start[:-1], strict=True)] + [np.zeros(len(self.start[-1]), np.int64)]

    def _column(self, rows: np.ndarray, mask: np.ndarray, there: np.ndarray, column: int, words: np.ndarray) -> None:
        cut = np.flatnonzero(mask)
        size, low = np.diff(np.append(cut, len(rows))), np.minimum.reduceat(self.ids[rows], cut)
        real = there[cut]
        start = rows[cut[real]]
        self.start.append(start)
        self.size.append(size[real])
        self.low.append(low[real])
        self.parent.append(np.searchsorted(self.start[-2], start, side="right") - 1)
        self.words.append(words[self.first[start] + column].astype(np.int64))

    def open(self, depth: int) -> np.ndarray:
        """Which nodes of a depth reach the first or the last row."""
        start = self.start[depth]
        return (start == 0) | (start + self.size[depth] == len(self.order))

    def ends(self, depth: int) -> dict[int, np.ndarray]:
        """Of the nodes at which conversations end, their ids, lowest first."""
        start, size = self.start[depth], self.size[depth]
        over = np.flatnonzero(self.lengths == depth)
        node = np.searchsorted(start, over, side="right") - 1
        cuts = np.flatnonzero(np.diff(node, prepend=-1))
        assert (over < start[node] + size[node]).all()
        return {int(node[c]): np.sort(self.ids[over[c:d]]) for c, d in zip(cuts, np.append(cuts, len(over))[1:], strict=True)}


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _names(key: bytes) -> list[bytes]:
    """A name for each prefix of a conversation's ids, the empty one first."""
    h = hashlib.md5()
    out = [_ROOT]
    for k in range(0, len(key), 16):
        h.update(key[k : k + 16])
        out.append(h.digest())
    return out


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, conv_id, key, words) of one shard. Gives whole nodes, parts of open nodes, and pieces of open nodes' lists of ends."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    column = {c: table.column(c).combine_chunks() for c in table.column_names}
    column = {c: v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for c, v in column.items()}
    number = column["shard"][0].as_py()
    ids, keys = column["conv_id"].to_numpy(), column["key"]
    words = column["words"].values.slice(column["words"].offsets[0].as_py(), column["words"].offsets[-1].as_py() - column["words"].offsets[0].as_py())
    lengths = np.diff(column["words"].offsets.to_numpy()).astype(np.int64)
    raw = np.frombuffer(b"".join(keys.to_pylist()), np.uint8)
    tree = Shard(ids, _codes(raw), words.to_numpy(zero_copy_only=False), lengths)
    edge = [_names(keys[int(tree.order[k])].as_py()) for k in (0, -1)]
    depths = len(tree.start)
    saved, leaves = (np.zeros(len(tree.start[-1]), np.int64) for _ in range(2))
    for depth in range(depths - 1, -1, -1):
        start, size, children, is_open = tree.start[depth], tree.size[depth], tree.children[depth], tree.open(depth)
        below = tree.open(depth + 1) if depth + 1 < depths else np.zeros(0, bool)
        if depth + 1 < depths:
            up, n = tree.parent[depth + 1], len(start)
            shut = ~below
            saved_up, leaves_up, children = (np.bincount(up[shut], x[shut], minlength=n).astype(np.int64) for x in (saved, leaves, np.ones(len(up))))
        else:
            saved_up, leaves_up = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        # parts of open nodes leave themselves and their open children out
        saved = saved_up + np.where(is_open, 0, (size - 1) * tree.words[depth])
        leaves = np.where(is_open | (children > 0), leaves_up, 1)
        ends = tree.ends(depth)
        digests = [hashlib.sha256(_joined(ends[k]).encode()).hexdigest() if k in ends else _EMPTY for k in range(len(start))]
        name = [edge[0][depth] if s == 0 else edge[1][depth] if o else None for s, o in zip(start.tolist(), is_open.tolist(), strict=True)]
        up = tree.parent[depth]
        if depth:
            over = tree.open(depth - 1)[up]
            parent = [(edge[0] if s == 0 else edge[1])[depth - 1] if o else None for s, o in zip(tree.start[depth - 1][up].tolist(), over.tolist(), strict=True)]
            above = tree.low[depth - 1][up]
        else:
            over, parent, above = np.ones(1, bool), [None], np.zeros(1, np.int64)
        out = {
            "kind": np.where(is_open, "part", "node"), "conv_id": tree.low[depth], "depth": np.full(len(start), depth), "parent_conv_id": pa.array(above, mask=over), "parent": pa.array(parent, pa.binary()),
            "node": pa.array(name, pa.binary()), "n_convs": size, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "n_words": tree.words[depth],
            "ends_sha256": pa.array(digests, pa.string(), mask=is_open), "shard": np.full(len(start), number, np.int32), "piece": np.zeros(len(start), np.int32), "ids": pa.nulls(len(start), pa.string()),
        }
        yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in (out[f] for f in _FIELDS)], names=_FIELDS)
        lists = [(name[k], piece, _joined(ids_[lo : lo + _PIECE])) for k, ids_ in ends.items() if is_open[k] for piece, lo in enumerate(range(0, len(ids_), _PIECE))]
        if lists:
            own = {"kind": pa.array(["ends"] * len(lists)), "node": pa.array([x[0] for x in lists], pa.binary()), "shard": pa.array([number] * len(lists), pa.int32()), "piece": pa.array([x[1] for x in lists], pa.int32()), "ids": pa.array([x[2] for x in lists])}
            blank = {"parent": pa.binary(), "ends_sha256": pa.string()}
            yield pa.RecordBatch.from_arrays([own.get(f, pa.nulls(len(lists), blank.get(f, pa.int64()))) for f in _FIELDS], names=_FIELDS)


def _recombine(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Open nodes from their parts summed by node: children, leaves and savings of the open ones below them come in from the deepest up."""
    held = [p for p in parts if len(p)]
    if not held:
        return
    table = pd.concat(held, ignore_index=True)
    index = {n: k for k, n in enumerate(table["node"])}
    up = np.array([index[p] if d else -1 for p, d in zip(table["parent"], table["depth"], strict=True)])
    depth, size, words = (table[c].to_numpy(np.int64) for c in ("depth", "n_convs", "n_words"))
    children, leaves, saved = (table[c].to_numpy(np.int64).copy() for c in ("n_children", "n_leaves", "saved_tokens"))
    saved += (size - 1) * words
    order = np.argsort(-depth, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        leaves[own] = np.where(children[own] > 0, leaves[own], 1)
        if depth[own[0]]:
            for total, x in ((children, np.ones(len(own), np.int64)), (leaves, leaves[own]), (saved, saved[own])):
                np.add.at(total, up[own], x)
    low = table["conv_id"].to_numpy(np.int64)
    above = pd.array(np.where(up < 0, 0, low[up]), dtype="Int64")
    above[up < 0] = pd.NA
    yield pd.DataFrame({"conv_id": low, "depth": depth, "parent_conv_id": above, "node": table["node"], "n_convs": size, "n_children": children, "n_leaves": leaves, "saved_tokens": saved})


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of lists (node, ids) in order, hashed as they come."""
    at, h = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([h.hexdigest()])], names=["node", "ends_sha256"])

    for b in batches:
        for node, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if node != at:
                if at is not None:
                    yield done()
                at, h = node, hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.encode())
    if at is not None:
        yield done()


def prefix_trie(sequences: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (longs), ends_sha256 string.

    sequences: (conv_id long, turns array of (id binary of 16 bytes, n_words int)), one row a conversation.
    A node is a distinct sequence of the first ``depth`` turns of some conversation, from the root without
    turns; conv_id is the lowest id of its members, the conversations that start with it, n_convs their
    number and parent_conv_id that of the node one turn shorter (null for the root). n_leaves counts the
    childless nodes of its subtree, itself included; saved_tokens sums over the subtree (n_convs - 1) times
    the words of a node's last turn. ends_sha256 is the SHA-256 of the ids, ascending and joined by commas,
    of the members that have no further turn. A conversation without turns ends at the root; no
    conversations give no nodes. A conversation's ids (16 bytes a turn, never its texts) are one row, and
    Spark samples such rows to cut ranges.
    """
    spark = sequences.sparkSession
    keyed = sequences.select("conv_id", F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "").alias("key"), F.transform("turns", lambda t: t["n_words"]).alias("words"))
    keyed = materialize(keyed.select("conv_id", F.unhex("key").alias("key"), "words"), "trie-rows")
    n = shards or max(partitions(spark), int(keyed.agg(F.sum(F.size("words") + 1)).first()[0] or 0) // _TURNS + 1)
    ranged = keyed.repartitionByRange(n, "key", "conv_id").select(F.spark_partition_id().alias("shard"), "conv_id", "key", "words")
    grown = materialize(ranged.mapInArrow(_grow, _NODES), "trie-nodes")
    of = lambda kind: grown.filter(F.col("kind") == kind)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = of("part").groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("n_words").alias("n_words"), *sums)
    schema = "conv_id long, depth long, parent_conv_id long, node binary, n_convs long, n_children long, n_leaves long, saved_tokens long"
    edges = materialize(parts.coalesce(1).mapInPandas(_recombine, schema), "trie-edges")  # at most two conversations a shard
    pieces = of("ends").select("node", "shard", "piece", "ids").repartition(partitions(spark), "node").sortWithinPartitions("node", "shard", "piece")
    ended = materialize(pieces.mapInArrow(_digest, "node binary, ends_sha256 string"), "trie-ends")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    whole = edges.join(ended, "node", "left").select(*names, F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    nodes = of("node").select(*names, "ends_sha256", "parent")
    above = edges.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    orphans = nodes.filter(F.col("parent").isNotNull())
    if edges.count() <= BROADCAST_ROWS:
        adopted = orphans.join(F.broadcast(above), "parent")
    else:
        brood = materialize(orphans.groupBy("parent").agg(F.count(F.lit(1)).alias("brood")).join(above, "parent"), "trie-broods")
        adopted = join_by_skewed_key(orphans, brood, ["parent"], "brood", max(1, orphans.count()))
    adopted = adopted.withColumn("parent_conv_id", F.col("above")).select(*names, "ends_sha256")
    return whole.unionByName(nodes.filter(F.col("parent").isNull()).select(*names, "ends_sha256")).unionByName(adopted)


def node_turns(nodes: DataFrame, sequences: DataFrame) -> DataFrame:
    """nodes with the id of each one's last turn (turn_id binary, null for the root), by which texts can be looked up."""
    turns = sequences.select("conv_id", F.posexplode("turns").alias("at", "turn")).select("conv_id", (F.col("at") + 1).cast("long").alias("depth"), F.col("turn.id").alias("turn_id"))
    return nodes.join(turns, ["conv_id", "depth"], "left")
