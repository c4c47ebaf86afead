"""Removal of repeated byte strings by suffix sorting of whatever may repeat.

Every ``length``-byte string holds one anchor: the ``GRAM``-byte gram with the smallest hash in it, the
leftmost of equals. Equal strings have equal anchors at equal places, so a string whose anchor occurs
once in the corpus occurs once. Anchors are tested with the two-pass Bloom filter of exact dedup; the
rest carry the bytes around them (their context), which shows every string that has this anchor.

Of equal contexts (128 bits of hash) only the earliest is looked at further: all strings of the others
occur earlier. The distinct contexts of an anchor meet in one shard, which drops the ranges of distances
between start and anchor whose common bytes (by hash) no second context has, and is sorted by recursive
external induction; neighbours that share ``length`` symbols are equal strings, so what is removed there
rests on bytes, not on hashes.

An anchor with more than ``_MEET`` distinct contexts is split by where strings have it: strings that
begin ``a`` to ``b`` bytes before their anchor all hold the bytes from ``a`` before it to ``length - b``
behind it, so contexts cut to such strings need to meet only if these agree too. Halving the range again
and again ends with whole strings, of which distinct ones do not meet. No group is left out or cut short.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_by_skewed_key, materialize, mix, partitions, powers, prefix_hash, release, second_hash, sized, slices, span_hash, utf8, written
from tidemark.llm.exact_dedup import FILTER_BYTES, possibly_repeated, slice_count
from tidemark.llm.induced_sort import Budget, suffixes

LENGTH, GRAM = 100, 40
#: Distinct contexts of an anchor that may meet in one shard.
_MEET = 2000
#: Bytes of texts of which contexts are cut at once.
_CUT = 1 << 20
#: Bytes that are searched for anchors at once, so that their arrays stay in a core's cache.
_BYTES = 60_000
#: An odd number that spreads the hashes by which anchors are ordered, and the bits of a key that hold a place.
_ORDER, _PLACE = np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0xFFFFFFFF)
#: Lowest bits, in a number that tells where starts are, of the first start and of how far the last one is behind it; the anchor's distance from the first takes the lowest.
_BEGIN, _END = 32, 16
#: Ranges of distances between start and anchor, of which a shard leaves those out that no two contexts share.
_RANGES = 4
#: Bytes of contexts that a shard is planned for, and what its sort may keep in memory.
_SHARD, MEMORY = 32 << 20, 8 << 20


def anchors(raw: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of string starts that share an anchor: text, first start, last start, anchor place, anchor hash, two context hashes."""
    n, window = len(raw) - length + 1, length - gram + 1
    long = np.flatnonzero(np.diff(at) >= length)
    if not len(long):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 3
    prefix = prefix_hash(raw, lower=False)
    grams = len(raw) - gram + 1
    least = (prefix[gram:] - prefix[:grams]) * powers(len(raw))[1][:grams]
    least ^= least >> np.uint64(32)
    least *= _ORDER
    least &= ~_PLACE  # 32 bits of hash, which the place follows: of equal hashes the leftmost is the least
    least |= np.arange(grams, dtype=np.uint64)
    width = 1
    while width < window:
        step = min(width, window - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    anchor = least & _PLACE
    low, high = at[long], at[long + 1] - length + 1  # starts of strings in each text
    begin = np.unique(np.concatenate([np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, low, high]))
    end = np.append(begin[1:], n) - 1
    own = np.searchsorted(low, begin, side="right") - 1
    valid = (own >= 0) & (begin < high[own])
    begin, end, own = begin[valid], end[valid], own[valid]
    doc, q = long[own], anchor[begin].astype(np.int64)
    shape = mix(((q - begin).astype(np.uint64) << np.uint64(32)) | (end - begin).astype(np.uint64))
    twin = mix(span_hash(second_hash(raw), begin, end + length) + shape)
    return doc, begin - at[doc], end - at[doc], q - at[doc], span_hash(prefix, q, q + gram), mix(span_hash(prefix, begin, end + length) ^ shape), twin


def _anchor_rows(length: int, gram: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = utf8(b.column("text"))
            for i, j in slices(np.diff(at), _BYTES):
                doc, begin, end, q, h, context, twin = anchors(raw[at[i] : at[j]], at[i : j + 1] - at[i], length, gram)
                own = pa.array(doc + i)
                spot = begin << _BEGIN | (end - begin) << _END | (q - begin)
                yield pa.RecordBatch.from_arrays(
                    [b.column("row").take(own), b.column("id").take(own), pa.array(spot.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in (h, context, twin))],
                    names=["row", "id", "spot", "hash", "context", "twin"],
                )

    return task


def _placed(anchored: DataFrame) -> DataFrame:
    """Begin, end and place of runs of starts, from the one number that they are kept as."""
    begin = F.shiftright("spot", _BEGIN)
    after = lambda shift: (begin + F.shiftright("spot", shift).bitwiseAND((1 << _END) - 1)).cast("int")
    return anchored.select("row", "id", begin.cast("int").alias("begin"), after(_END).alias("end"), after(0).alias("place"), "hash", "context", "twin")


def _listed(lists: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The list that each element of lists of structs belongs to, and the elements by field."""
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    return np.repeat(np.arange(len(lists)), counts), {f.name: c.to_numpy(zero_copy_only=False) for f, c in zip(flat.type, flat.flatten(), strict=True)}


def _cut_contexts(length: int):
    """Rows row, id, text, spans: each span's bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.diff(utf8(whole.column("text"))[1])
            for i, j in slices(sizes, _CUT):
                b = whole.slice(i, j - i)
                raw, at = utf8(b.column("text"))
                own, spans = _listed(b.column("spans"))
                data, start = raw.tobytes(), at[own] + spans["begin"]
                cut = [data[x:y] for x, y in zip(start.tolist(), (start + spans["end"] - spans["begin"] + length).tolist(), strict=True)]
                rows = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(rows) for c in ("row", "id")), *(pa.array(spans[c]) for c in ("begin", "end", "place", "hash", "n")), pa.array(cut, pa.binary())],
                    names=["row", "id", "begin", "end", "place", "hash", "n", "bytes"],
                )

    return task


def _split_contexts(length: int, low: int, high: int):
    """Contexts (row, id, begin, end, place, hash, bytes) cut to strings that begin low..high bytes before the anchor, those of each half of the range apart."""
    middle = (low + high) // 2

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin, end, place, old = (b.column(c).to_numpy() for c in ("begin", "end", "place", "hash"))
            texts = b.column("bytes").to_pylist()
            for first, last in ((low, middle), (middle + 1, high)):
                from_, to = np.maximum(begin, place - last), np.minimum(end, place - first)
                own = np.flatnonzero(from_ <= to) if first <= last else np.zeros(0, np.int64)
                from_, to = from_[own], to[own]
                cut = [texts[k][i : j + length] for k, i, j in zip(own.tolist(), (from_ - begin[own]).tolist(), (to - begin[own]).tolist(), strict=True)]
                at = np.concatenate([[0], np.cumsum([len(x) for x in cut], dtype=np.int64)])
                raw = np.frombuffer(b"".join(cut), np.uint8)
                known = at[:-1] + place[own] - from_
                prefix, shape = prefix_hash(raw, lower=False), mix((place[own] - from_).astype(np.uint64) + mix(old[own].view(np.uint64)))
                key = mix(span_hash(prefix, known - first, known - last + length) ^ mix(old[own].view(np.uint64) + np.uint64(first)))
                whole, twin = mix(span_hash(prefix, at[:-1], at[1:]) ^ shape), mix(span_hash(second_hash(raw), at[:-1], at[1:]) + shape)
                rows = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(c).take(rows) for c in ("row", "id")),
                        *(pa.array(x.astype(np.int32)) for x in (from_, to, place[own])),
                        *(pa.array(x.view(np.int64)) for x in (key, whole, twin)),
                        pa.array(np.full(len(own), first, np.int32)),
                        pa.array(cut, pa.binary()),
                    ],
                    names=["row", "id", "begin", "end", "place", "hash", "context", "twin", "low", "bytes"],
                )

    return task


def _ranges(length: int, gram: int) -> list[tuple[int, int]]:
    """Ranges of distances from a string's start to its anchor, the farthest first."""
    edges = np.unique(np.linspace(0, length - gram + 1, _RANGES + 1).astype(int)).tolist()
    return [(a, b - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)][::-1]


def _cores(raw: np.ndarray, at: np.ndarray, begin: np.ndarray, place: np.ndarray, key: np.ndarray, ranges: list[tuple[int, int]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each range and context: a hash of the anchor's key and of the bytes that all strings within the range hold, and whether the context has such strings."""
    prefix, end = prefix_hash(raw, lower=False), begin + np.diff(at) - length
    core, some = np.zeros((len(ranges), len(begin)), np.uint64), np.zeros((len(ranges), len(begin)), bool)
    for r, (low, high) in enumerate(ranges):
        own = np.flatnonzero(np.maximum(begin, place - high) <= np.minimum(end, place - low))
        some[r, own] = True
        known = at[own] + place[own] - begin[own]
        core[r, own] = mix(span_hash(prefix, known - low, known - high + length) ^ mix(key[own] + np.uint64(r)))
    return core, some


def _shared_ranges(core: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Ranges in which another context has the same core: a string of any other range occurs once."""
    for r in range(len(core)):
        own = np.flatnonzero(some[r])
        order = own[np.argsort(core[r, own])]
        same = core[r, order[1:]] == core[r, order[:-1]]
        some[r, order] = np.append(same, False)[: len(order)] | np.append(False, same)[: len(order)]
    return some


def _sort_shard(length: int, gram: int, memory: int):
    """Contexts row, begin, place, hash, bytes of one shard, in the order of documents and places; gives the runs of strings that also start earlier.

    What is sorted are the parts of contexts whose strings may occur in others too, by the bytes that all strings of a part hold.
    """
    ranges = _ranges(length, gram)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cores, sizes, rows, begins = [], [], [], [], []
        with tempfile.TemporaryFile() as spool, tempfile.TemporaryFile() as file:  # the text: an end mark below all bytes behind each part, and a lower one at the end
            for b in batches:
                row, begin, place, key = (b.column(k).to_numpy() for k in range(4))
                texts = b.column(4).to_pylist()
                at = np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])
                raw = np.frombuffer(b"".join(texts), np.uint8)
                cores.append(_cores(raw, at, begin.astype(np.int64), place.astype(np.int64), key.view(np.uint64), ranges, length))
                spool.write(raw.data)
                held.append((row, begin, place, at))
            if not held:
                return
            shared = _shared_ranges(*(np.concatenate(x, axis=1) for x in zip(*cores, strict=True)))
            spool.seek(0)
            done = 0
            for row, begin, place, at in held:
                own = shared[:, done : done + len(row)].T
                done += len(row)
                raw = np.frombuffer(spool.read(int(at[-1])), np.uint8)
                edge = np.zeros((len(row), 1), bool)
                k, first = np.nonzero(own & ~np.hstack([edge, own[:, :-1]]))
                last = np.nonzero(own & ~np.hstack([own[:, 1:], edge]))[1]
                start = np.maximum(begin[k], place[k] - np.array([high for _, high in ranges])[first])
                stop = np.minimum(begin[k] + np.diff(at)[k], place[k] - np.array([low for low, _ in ranges])[last] + length)
                size = stop - start
                symbols = np.ones(size.sum() + len(size), np.uint16)
                source = np.repeat(at[k] + start - begin[k] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                symbols[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = raw[source].astype(np.uint16) + 2
                file.write(symbols.data)
                sizes.append(size)
                rows.append(row[k])
                begins.append(start)
            file.write(np.zeros(1, np.uint16).data)
            file.flush()
            size, row, begin = (np.concatenate(x) for x in (sizes, rows, begins))
            if not len(size):
                return
            t = np.asarray(np.memmap(file, np.uint16, "r"))
            at = np.concatenate([[0], np.cumsum(size + 1)])
            again = _again(t, at, size, length, Budget(memory))
            for k in range(0, len(size), 10_000):
                low, high = at[k], at[min(k + 10_000, len(size))]
                place = np.flatnonzero(again[low:high]) + low
                if not len(place):
                    continue
                first = np.flatnonzero(np.append(True, place[1:] != place[:-1] + 1))
                last = np.append(first[1:], len(place)) - 1  # an end mark is never set, so runs stay within a part
                own = np.searchsorted(at, place[first], side="right") - 1
                start = begin[own] + place[first] - at[own]
                stop = start + place[last] - place[first] + length
                yield pa.RecordBatch.from_arrays([pa.array(row[own]), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["row", "begin", "stop"])

    return task


def _again(t: np.ndarray, at: np.ndarray, size: np.ndarray, length: int, budget: Budget) -> np.ndarray:
    """Marks each place of t where a string begins that also begins at a lower place."""
    again, lowest = budget.array(len(t), bool), -1  # lowest place of the strings last seen, of which more may follow
    for positions, prefixes in suffixes(t, 258, budget):
        owner = np.searchsorted(at, positions, side="right") - 1
        whole = np.flatnonzero((owner < len(size)) & (positions - at[owner] + length <= size[np.minimum(owner, len(size) - 1)]))
        if not len(whole):
            if len(prefixes) and prefixes.min() < length:
                lowest = -1
            continue
        group = np.cumsum(prefixes < length)
        goes_on = lowest >= 0 and group[whole[0]] == 0
        positions, group = positions[whole], group[whole]
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        low = np.minimum.reduceat(positions, head)
        again[positions] = True
        if goes_on:
            again[lowest] = True
            low[0] = min(int(low[0]), lowest)
        again[low] = False
        lowest = int(low[-1])
    return again


def _apart(contexts: DataFrame, total: int, tag: str) -> tuple[DataFrame, DataFrame]:
    """Of equal contexts (context, twin) the earliest, and (row, begin, end) of the others."""
    rest = [c for c in contexts.columns if c not in ("context", "twin", "id", "row", "begin")]
    best = F.min_by(F.struct("id", "row", "begin", *rest), F.struct("id", "row", "begin")).alias("best")
    first = materialize(contexts.groupBy("context", "twin").agg(best, F.count(F.lit(1)).alias("size")), tag)
    repeated = first.filter("size > 1").select("context", "twin", "size", F.col("best.row").alias("first_row"), F.col("best.begin").alias("first_begin"))
    copies = join_by_skewed_key(contexts.select("context", "twin", "row", "begin", "end"), repeated, ["context", "twin"], "size", total)
    return first.select("best.*"), copies.filter((F.col("first_row") != F.col("row")) | (F.col("first_begin") != F.col("begin"))).select("row", "begin", "end")


def _meeting(contexts: DataFrame, total: int, tag: str) -> DataFrame:
    """contexts whose hash others have too, with how many have it."""
    groups = materialize(contexts.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), tag)
    return join_by_skewed_key(contexts, groups, ["hash"], "n", total)


def _divided(crowded: DataFrame, length: int, gram: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Crowded anchors, split until at most _MEET contexts meet: contexts by smaller groups, and (row, begin, end) of equal ones."""
    kind = crowded.schema["id"].dataType.simpleString()
    schema = f"row long, id {kind}, begin int, end int, place int, hash long, context long, twin long, low int, bytes binary"
    meeting, copies = [], []
    ranges = [(0, length - gram)]
    waiting = {ranges[0]: crowded}
    while waiting:
        (low, high), rows = waiting.popitem()
        split = materialize(rows.mapInArrow(_split_contexts(length, low, high), schema), "split")
        total = split.count()
        if not total:
            continue
        distinct, others = _apart(split, total, "split-contexts")
        copies.append(others)
        met = materialize(_meeting(distinct, total, "split-groups"), "split-met")
        meeting.append(met.filter(F.col("n") <= _MEET))
        still = met.filter(F.col("n") > _MEET)
        if low < high and not still.isEmpty():
            middle = (low + high) // 2
            for a, b in ((low, middle), (middle + 1, high)):
                if a <= b:
                    waiting[a, b] = still.filter(F.col("low") == a)
    return meeting, copies


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, filter_bytes: int = FILTER_BYTES, memory: int | None = None) -> DataFrame:
    """(row, begin, stop): byte ranges covered by strings that also start earlier, of keyed (row unique, id, text)."""
    spark = keyed.sparkSession
    kind = keyed.schema["id"].dataType.simpleString()
    texts = keyed.select("row", "id", "text")
    before = written()
    made = texts.mapInArrow(_anchor_rows(length, gram), f"row long, id {kind}, spot long, hash long, context long, twin long")
    # the slices of the filter follow from the bytes that may hold an anchor: two in a window on average, counted as three
    total_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = int(3 * total_bytes / (length - gram + 2)) + 1
    made = materialize(made.withColumn("slice", F.pmod(F.xxhash64("hash"), F.lit(slice_count(expected, filter_bytes))).cast("int")), "anchors", ["slice"])
    maybe = possibly_repeated(made, expected, filter_bytes, only=True)
    release(spark, [p for p in written() if p not in before and "/anchors-" in p])
    maybe = _placed(maybe)
    total = maybe.count()
    distinct, copies = _apart(maybe, total, "contexts")
    met = _meeting(distinct, total, "anchor-groups")
    spans = materialize(met.groupBy("row").agg(F.collect_list(F.struct("begin", "end", "place", "hash", "n")).alias("spans")), "context-spans")
    owners = spans.select("row")
    held = keyed.join(sized(owners, owners.count()), "row", "left_semi").join(spans.hint("merge"), "row").select("row", "id", "text", "spans")
    cut = materialize(held.mapInArrow(_cut_contexts(length), f"row long, id {kind}, begin int, end int, place int, hash long, n long, bytes binary"), "context-bytes")
    crowded = cut.filter(F.col("n") > _MEET).drop("n")
    meeting, others = ([], []) if crowded.isEmpty() else _divided(crowded, length, gram)
    columns = ["id", "row", "begin", "place", "hash", "bytes"]
    to_sort = cut.filter(F.col("n") <= _MEET).select(*columns)
    for rows in meeting:
        to_sort = to_sort.unionByName(rows.select(*columns))
    for rows in others:
        copies = copies.unionByName(rows)
    size = to_sort.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = to_sort.repartition(max(partitions(spark), -(-size // _SHARD)), "hash").sortWithinPartitions("id", "row", "begin")
    sorted_out = shards.select("row", "begin", "place", "hash", "bytes").mapInArrow(_sort_shard(length, gram, MEMORY if memory is None else memory), "row long, begin int, stop int")
    return copies.select("row", "begin", (F.col("end") + length).cast("int").alias("stop")).unionByName(sorted_out)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text, spans, then those to pass on."""
    for whole in batches:
        for i, j in slices(np.diff(utf8(whole.column(0))[1]), _CUT):
            b = whole.slice(i, j - i)
            raw, at = utf8(b.column(0))
            own, spans = _listed(b.column(1))
            begin, stop = at[own] + spans["begin"], at[own] + spans["stop"]
            order = np.lexsort((begin, own))
            own, begin, far = own[order], begin[order], np.maximum.accumulate(stop[order])
            new = np.append(True, (own[1:] != own[:-1]) | (begin[1:] > far[:-1]))[: len(own)]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(own))[: len(first)] - 1
            runs = np.bincount(own[first], minlength=b.num_rows)
            low, high = (np.sort(np.concatenate(x)).tolist() for x in ((at[:-1], far[last]), (begin[first], at[1:])))
            data = raw.tobytes()
            parts = [data[x:y] for x, y in zip(low, high, strict=True)]  # one more than runs in each text
            ends = np.cumsum(runs + 1).tolist()
            left = [b"".join(parts[x:y]) for x, y in zip([0, *ends], ends)]  # noqa: B905
            n, kept = np.diff(at), np.array([len(x) for x in left], np.int64)
            digest = [hashlib.sha256(x).hexdigest() for x in left]
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.binary()), pa.array(n), pa.array(n - kept), pa.array(runs.astype(np.int64)), pa.array(digest, pa.string()), *b.columns[2:]],
                names=["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", *b.schema.names[2:]],
            )


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, kept binary (what is left of the text), n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null counts as empty. A byte goes if a ``length``-byte string that covers it
    also starts earlier: in a row with a smaller id (null smallest; among rows that share an id, in any
    fixed order) or earlier in the same text. Strings are judged on the input and never cross texts; a
    cut may fall inside a character, so what is left is bytes. Other columns are not read.
    """
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    keyed = materialize(own, "suffix-docs")
    before = written()
    spans = materialize(repeated_spans(keyed, length, gram).groupBy("row").agg(F.collect_list(F.struct("begin", "stop")).alias("spans")), "spans")
    release(docs.sparkSession, [p for p in written() if p not in before and "/spans-" not in p])
    touched = sized(spans.select("row"), spans.count())
    kind = keyed.schema["id"].dataType.simpleString()
    joined = keyed.join(touched, "row", "left_semi").join(spans.hint("merge"), "row").select("text", "spans", "id")
    cut = joined.mapInArrow(_remove, f"kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, id {kind}")
    raw, none = F.col("text").cast("binary"), F.lit(0).cast("long")
    whole = keyed.join(touched, "row", "left_anti").select(raw.alias("kept"), F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), "id")
    return cut.unionByName(whole).withColumnRenamed("id", id_col)
