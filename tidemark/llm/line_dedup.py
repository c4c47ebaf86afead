"""Line dedup by overlapping windows of consecutive lines.

Each document gives 128-bit hashes of its windows of three lines (all its lines, if it has fewer). A hash
that occurs again, in a later document or further down in the same one, marks its window as a later
occurrence. Overlapping and adjoining windows of a document merge into covered spans, whose lines go.
First occurrences stay; first is by document id, then place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_by_skewed_key, materialize, mix, prefix_hash, release_others, second_hash, sized, slices, span_hash, utf8, written

WINDOW = 3
_BYTES = 1_000_000
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _line_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each line's bytes, and where each text's lines begin (n + 1). An empty text is one empty line."""
    feeds, texts = np.flatnonzero(raw == 10), np.arange(len(at) - 1)
    doc = np.concatenate([texts, np.searchsorted(at, feeds, side="right") - 1])
    start, end = np.concatenate([at[:-1], feeds + 1]), np.concatenate([at[1:], feeds])
    start, end = start[np.lexsort((start, doc))], end[np.lexsort((end, doc))]
    lengths = mix((end - start).astype(np.uint64) + _STEP)
    two = (mix(span_hash(prefix, start, end) ^ lengths) for prefix in (prefix_hash(raw, lower=False), second_hash(raw)))
    return *two, np.searchsorted(np.sort(doc), np.arange(len(at)))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, at = utf8(b.column("text"))
        for i, j in slices(np.diff(at), _BYTES):
            *lines, first = _line_hashes(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            counts = np.diff(first)
            each = np.maximum(counts - WINDOW + 1, 1)
            begin = np.concatenate([[0], np.cumsum(each)])
            place = np.arange(begin[-1]) - np.repeat(begin[:-1], each)
            size = np.repeat(np.minimum(counts, WINDOW), each)
            where = np.repeat(first[:-1], each) + place
            both = []
            for own in lines:
                h = mix(size.astype(np.uint64))
                for k in range(WINDOW):
                    more = size > k
                    h[more] = mix(h[more] * _STEP + own[where[more] + k])
                both.append(h)
            h, g = both
            doc = np.repeat(np.arange(j - i), each)
            order = np.lexsort((place, g, h, doc))
            again = np.zeros(len(h), bool)
            same = np.all([x[order][1:] == x[order][:-1] for x in (doc, h, g)], axis=0)
            again[order[1:][same]] = True
            own = pa.array(doc + i)
            yield pa.RecordBatch.from_arrays(
                [b.column("row").take(own), b.column("id").take(own), pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(again)],
                names=["row", "id", "hash", "twin", "at", "n", "again"],
            )


def later_windows(texts: DataFrame) -> DataFrame:
    """(row, at, n): windows of texts (row unique, id, text) that occurred before."""
    kind = texts.schema["id"].dataType.simpleString()
    found = materialize(texts.select("row", "id", "text").mapInArrow(_windows, f"row long, id {kind}, hash long, twin long, at int, n int, again boolean"), "line-windows")
    within = found.filter("again").select("row", "at", "n")
    firsts = found.filter("not again")
    total = firsts.count()
    best = F.min(F.struct("id", "row")).alias("best")
    groups = firsts.groupBy("hash", "twin").agg(best, F.count(F.lit(1)).alias("size")).filter("size > 1")
    groups = materialize(groups.select("hash", "twin", F.col("best.row").alias("first"), "size"), "line-groups")
    across = join_by_skewed_key(firsts, groups, ["hash", "twin"], "size", total).filter(F.col("row") != F.col("first")).select("row", "at", "n")
    return across.unionByName(within)


def _keep(text: str | None, windows: list[dict] | None) -> tuple[str | None, int]:
    if not windows or text is None:
        return text, 0
    lines = text.split("\n")
    edges = np.zeros(len(lines) + 1, np.int32)
    for w in windows:
        edges[w["at"]] += 1
        edges[w["at"] + w["n"]] -= 1
    gone = np.cumsum(edges)[:-1] > 0
    return "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), int(gone.sum())


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j in slices(np.diff(utf8(b.column(0))[1]), 4 * _BYTES):
            yield b.slice(i, j - i)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text, windows, then those to pass on; some megabytes of text at a time."""
    for b in _small(batches):
        kept = [_keep(t, w) for t, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int32()), *b.columns[2:]], names=["text", "lines_removed", *b.schema.names[2:]]
        )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``text_col`` less the lines that later occurrences cover, and lines_removed int.

    Lines end at a line feed. Rows are ordered by id (null first), rows that share an id in any fixed
    order. Only rows that lose lines shuffle with their texts, the rest pass straight through. A null text stays null and has no lines; an empty text is one empty line, so every one but
    the first counts it as removed and stays empty. A document whose lines all go keeps an empty text.
    A column of docs named lines_removed is replaced.
    """
    own = [c for c in docs.columns if c != "lines_removed"]
    before = written()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc"), F.monotonically_increasing_id().alias("row"))
    keyed = materialize(packed, "line-docs")
    text = F.col(f"doc.`{text_col}`").cast("string")
    texts = keyed.select("row", F.col(f"doc.`{id_col}`").alias("id"), text.alias("text")).filter(F.col("text").isNotNull())
    spans = materialize(later_windows(texts).groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("windows")), "line-spans")
    release_others(docs.sparkSession, before, "line-docs", "line-spans")
    touched = sized(spans.select("row"), spans.count())
    rest = [c for c in own if c != text_col]
    passed = [F.col(f"doc.`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]
    wide = keyed.join(touched, "row", "left_semi").join(spans.hint("merge"), "row").select(text.alias("text"), "windows", *passed)
    schema = "".join(f", c{i} {wide.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(rest)))
    cut = wide.mapInArrow(_cut, f"text string, lines_removed int{schema}")
    whole = keyed.join(touched, "row", "left_anti").select(text.alias("text"), F.lit(0).alias("lines_removed"), *passed)
    return cut.unionByName(whole).select(*[F.col("text").alias(c) if c == text_col else F.col(f"c{rest.index(c)}").alias(c) for c in own], "lines_removed")
