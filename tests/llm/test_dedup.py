"""Exact, line, near-duplicate and suffix dedup against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from cases import SCHEMA, documents

from tidemark.llm import common, exact_dedup, induced_sort, line_dedup, ngram_jaccard, suffix_dedup

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = set(range(48, 58)) | set(range(97, 123))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def unique(rows):
    """Rows as a list with ids that brute force can order: null first, rows that share an id in any order."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def words(text):
    out, now = [], ""
    for ch in (text or "").translate(LOWER):
        if ord(ch) > 127 or ord(ch) in WORD:
            now += ch
        elif now:
            out.append(now)
            now = ""
    return [*out, now] if now else out


def test_jobs_do_not_grow_with_the_slices_and_nothing_is_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: pytest.fail("broadcast"))
    jobs = {}
    for slices in (1, 40):
        rows = spark.range(3000).select((F.xxhash64(F.col("id") % 2500)).alias("hash"), "id").withColumn("slice", F.pmod(F.xxhash64("hash"), F.lit(slices)).cast("int"))
        rows.write.partitionBy("slice").parquet(str(tmp_path / str(slices)))
        hashes = spark.read.schema("hash long, id long, slice int").parquet(str(tmp_path / str(slices)))
        spark.sparkContext.setJobGroup(f"slices-{slices}", "flags")
        flagged = exact_dedup.possibly_repeated(hashes, 3000, 1)
        jobs[slices] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"slices-{slices}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        maybe = {r["id"] for r in flagged.filter("maybe").collect()}
        assert flagged.count() == 3000 and {k for k in range(3000) if k < 500 or k >= 2500} <= maybe and len(maybe) < 1010
        only = exact_dedup.possibly_repeated(hashes, 3000, 1, only=True)
        assert {r["id"] for r in only.collect()} == maybe and only.columns == ["id", "hash", "maybe"]
    assert jobs[1] == jobs[40] <= 6


@pytest.mark.parametrize("filter_bytes", [64 << 20, 64])
def test_exact(docs, filter_bytes):
    groups = defaultdict(list)
    for r in documents():
        groups[hashlib.sha256((r[1] or "").translate(LOWER).encode()).hexdigest()].append(r[0])
    got = exact_dedup.exact_dedup(docs, filter_bytes=filter_bytes).collect()
    assert len(got) == docs.count()
    for r in got:
        own = groups[r["text_sha256"]]
        assert r["group_size"] == len(own) and r["keep_id"] == max(own, key=lambda i: (i is not None, i or 0))
    kept = defaultdict(list)
    for r in got:
        if r["kept"]:
            kept[r["text_sha256"]].append(r["doc_id"])
    assert len(kept) == len(groups) and all(len(v) == 1 and v[0] == max(groups[k], key=lambda i: (i is not None, i or 0)) for k, v in kept.items())


def test_lines(docs):
    seen, want = set(), []
    for r in unique(documents()):
        if r[1] is None:
            want.append((r[0], None, 0))
            continue
        lines = r[1].split("\n")
        gone = set()
        for i in range(max(1, len(lines) - 2)):
            w = tuple(lines[i : i + 3])
            if w in seen:
                gone.update(range(i, i + len(w)))
            seen.add(w)
        want.append((r[0], "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    out = line_dedup.line_dedup(docs)
    assert out.columns == [*docs.columns, "lines_removed"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["doc_id"], r["text"], r["lines_removed"]) for r in out.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("dense", [48, 2])
def test_jaccard(docs, monkeypatch, dense):
    monkeypatch.setattr(ngram_jaccard, "_DENSE", dense)
    monkeypatch.setattr(ngram_jaccard, "_BLOCK", 4)
    rows = documents()
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root, links = list(range(len(rows))), defaultdict(int)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(i)
    low = lambda own: min((rows[i][0] for i in own), key=lambda x: (x is not None, x or 0))
    want = sorted(str((rows[i][0], low(own), links[i])) for own in classes.values() for i in own)
    got = ngram_jaccard.jaccard_join(docs).collect()
    assert sorted(str((r["id"], r["class_id"], r["n_links"])) for r in got) == want
    assert sum(r["keep"] for r in got) == len(classes)
    kept = ngram_jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(classes)


def test_recall_at_the_threshold():
    assert 1 - (1 - 0.8**ngram_jaccard.ROWS) ** ngram_jaccard.BANDS > 0.999


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])
def test_bands_reach_the_recall_at_any_threshold(threshold):
    for recall in (0.9, 0.99, ngram_jaccard.RECALL):
        bands, rows = ngram_jaccard.banding(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands > recall - 1e-9
    assert ngram_jaccard.banding(0.8) == (30, 7)


def test_pairs_at_a_low_threshold_are_found(spark):
    rng, rows = random.Random(8), []
    for k in range(100):
        same, a, b = ([f"{c}{k}x{rng.randrange(10**9)}" for _ in range(m)] for c, m in (("s", 52), ("a", 23), ("b", 23)))
        rows += [(2 * k, " ".join(same + a)), (2 * k + 1, " ".join(same + b))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ngram_jaccard.drop_near_duplicates(docs, threshold=0.5).count() == 100
    assert ngram_jaccard.jaccard_join(docs, threshold=0.5).filter("n_links = 1").count() == 200


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    loops = {a for a, b in edges if a == b}
    got = {r["node"]: r["root"] for r in ngram_jaccard.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[x] == find(x) for x in got) and set(root) - set(got) <= loops
    assert ngram_jaccard.components(spark.createDataFrame([], "u long, v long")).count() == 0


def by_brute_force(t):
    order = sorted(range(len(t)), key=lambda i: t[i:], reverse=True)
    shared = [0]
    for a, b in zip(order[:-1], order[1:], strict=True):
        k = 0
        while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        shared.append(min(k, induced_sort.CAP))
    return order, shared


def by_induction(t, symbols, budget):
    out = [(p, q) for block in induced_sort.suffixes(t, symbols, budget) for p, q in zip(block[0].tolist(), block[1].tolist(), strict=True)]
    return [p for p, _ in out], [q for _, q in out]


@pytest.mark.parametrize(("lane", "block"), [(1 << 15, 1 << 17), (8, 7), (1, 5)])
@pytest.mark.parametrize("memory", [0, 500, 1 << 30])
def test_suffix_order_and_common_prefixes(monkeypatch, lane, block, memory):
    monkeypatch.setattr(induced_sort, "_LANE", lane)
    monkeypatch.setattr(induced_sort, "_BLOCK", block)
    rng = np.random.default_rng(1)
    for k in range(60):
        symbols = int(rng.integers(1, 6))
        t = rng.integers(1, symbols + 1, int(rng.integers(0, 90)))
        if k % 3 == 0:
            t = np.tile(t[: len(t) // 7], 8)
        if k % 7 == 0:
            t = np.repeat(t, rng.integers(1, 12, len(t)))
        t = np.append(t, 0).astype(np.uint16 if k % 2 else np.int32)
        budget = induced_sort.Budget(memory)
        assert by_induction(t, symbols + 1, budget) == by_brute_force(t.tolist())
        assert memory < 1000 or budget.left == memory


def test_a_shard_larger_than_memory_goes_to_disk():
    rng = np.random.default_rng(2)
    half = rng.integers(1, 250, 150_000)
    t = np.concatenate([half, half[1000:], [0]]).astype(np.uint16)  # names repeat, so the sort recurs
    small, large = induced_sort.Budget(50_000), induced_sort.Budget(1 << 40)
    got = by_induction(t, 250, small)
    assert small.written > 2 * t.nbytes and small.writes > 20 and large.written == 0
    assert got == by_induction(t, 250, large)
    for p, q, shared in zip(got[0][:-1:97], got[0][1::97], got[1][1::97], strict=False):
        a, b = t[p : p + 254].tolist(), t[q : q + 254].tolist()
        same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert a >= b and shared == min(same, induced_sort.CAP)


@pytest.mark.parametrize(("meet", "memory"), [(2000, 8 << 20), (2000, 0), (2, 0)])
def test_suffixes(docs, monkeypatch, meet, memory):
    monkeypatch.setattr(suffix_dedup, "_MEET", meet)
    monkeypatch.setattr(suffix_dedup, "MEMORY", memory)
    seen, want = set(), []
    for r in unique(documents()):
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            if s in seen:
                gone[k : k + 100] = True
            seen.add(s)
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want.append((r[0], len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest(), left))
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert sorted(str((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"]))) for r in got) == sorted(map(str, want))
    assert any(w[2] for w in want)


def test_empty_tables(nothing):
    assert exact_dedup.exact_dedup(nothing).count() == 0
    assert line_dedup.line_dedup(nothing).count() == 0
    assert ngram_jaccard.jaccard_join(nothing).count() == 0
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


def test_words_and_slices():
    texts = ["", "Ab c", "É-x", "c"]
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    start, end, h, first = common.words(np.frombuffer(b"".join(raw), np.uint8), at)
    assert np.diff(first).tolist() == [0, 2, 2, 1] and h[1] == h[-1] and len(set(h.tolist())) == 4
    assert list(common.slices(np.array([5, 5, 20, 1]), 10)) == [(0, 2), (2, 3), (3, 4)]


def test_recall_of_the_join_close_to_the_threshold(spark):
    """1,500 pairs of texts at a similarity of 0.80 to 0.85, whole join: hardly one is lost."""
    rng = random.Random(12)
    rows, close = [], []
    for k in range(1500):
        text = [f"v{rng.randrange(10**6)}" for _ in range(rng.randint(95, 125))]
        other = list(text)
        for at in (rng.randint(10, 30), rng.randint(50, 70)):
            other[at] = f"z{rng.randrange(10**6)}"
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (text, other))
        close.append(len(a & b) / len(a | b))
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    assert 0.8 <= min(close) and max(close) < 0.85
    found = {r["id"]: r["class_id"] for r in ngram_jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("id", "class_id").collect()}
    assert all(found[2 * k] == 2 * k for k in range(1500))
    assert np.mean([found[2 * k + 1] == 2 * k for k in range(1500)]) >= 0.99


def test_equal_strings_have_equal_anchors_in_one_run_each():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 100, n, np.uint8)) for n in (0, 99, 100, 340, 0, 1000)] + [b"a" * 400]
    texts.append(b"xyz" + texts[3] + texts[5][200:500])
    at = np.cumsum([0, *map(len, texts)])
    seen, starts = {}, set()
    for k, begin, end, q, h, *_ in zip(*suffix_dedup.anchors(np.frombuffer(b"".join(texts), np.uint8), at, 100, 40), strict=True):
        for start in range(begin, end + 1):
            assert start <= q <= start + 60 and (k, start) not in starts
            starts.add((k, start))
            assert seen.setdefault(texts[k][start : start + 100], (q - start, h)) == (q - start, h)
    assert starts == {(k, s) for k, t in enumerate(texts) for s in range(len(t) - 99)}


def test_only_strings_that_may_repeat_are_sorted(monkeypatch):
    """Contexts that share an anchor and no string of 100 bytes do not reach the sort, those that share some do by their part."""
    rng = np.random.default_rng(6)
    gram, apart = bytes(rng.integers(97, 123, 40, np.uint8)), [bytes(rng.integers(97, 123, 120, np.uint8)) for _ in range(50)]
    rows = [(k, 0, 60, 7, apart[k][:60] + gram + apart[k][60:]) for k in range(50)]
    sizes, again = [], suffix_dedup._again
    monkeypatch.setattr(suffix_dedup, "_again", lambda t, *a: sizes.append(len(t)) or again(t, *a))

    def shard(rows):
        batch = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["row", "begin", "place", "hash", "bytes"])
        halves = [batch.slice(0, 20), batch.slice(20)]
        return [tuple(r.values()) for out in suffix_dedup._sort_shard(100, 40, 8 << 20)(iter(halves)) for r in out.to_pylist()]

    assert shard(rows) == [] and not sizes
    twin = apart[3][40:60] + gram + apart[3][60:100] + apart[40][:20]  # the bytes 40 to 140 of row 3, and others behind
    assert shard([*rows, (50, 5, 25, 7, twin)]) == [(50, 5, 105)]
    assert sizes and sizes[0] < 300


def test_removed_runs_end_with_their_text():
    spans = [[{"begin": 0, "stop": 3}], [{"begin": 2, "stop": 4}, {"begin": 0, "stop": 2}], [{"begin": 4, "stop": 5}, {"begin": 0, "stop": 1}, {"begin": 0, "stop": 3}]]
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(["abc", "abcd", "abécd"]), pa.array(spans, kind), pa.array([1, 2, 3])], names=["text", "spans", "id"])
    for b in (batch, batch.slice(1)):
        got = [r for out in suffix_dedup._remove(iter([b])) for r in out.to_pylist()]
        want = [(1, b"", 3, 3, 1), (2, b"", 4, 4, 1), (3, "abécd".encode()[3:4] + "abécd".encode()[5:], 6, 4, 2)][-b.num_rows :]
        assert [(r["id"], r["kept"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got] == want
        assert all(r["kept_sha256"] == hashlib.sha256(r["kept"]).hexdigest() for r in got)


def test_texts_of_a_group_are_not_sent_once_a_pair(spark, monkeypatch):
    """Three groups of 30 near copies: 1,305 links, and no more listed pairs than texts."""
    rng, rows, listed = random.Random(8), [], []
    for group in range(3):
        text = [f"v{rng.randrange(10**6)}" for _ in range(400)]
        for k in range(30):
            rows.append((100 * group + k, " ".join(f"z{group}-{k}" if i == 10 * k + 7 else w for i, w in enumerate(text))))
    kept = ngram_jaccard.materialize

    def spied(df, tag, *a):
        out = kept(df, tag, *a)
        listed.extend([out.count()] if tag == "pairs" else [])
        return out

    monkeypatch.setattr(ngram_jaccard, "materialize", spied)
    got = ngram_jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["id"], r["class_id"], r["n_links"]) for r in got) == [(k, k // 100 * 100, 29) for k, _ in rows]
    assert len(listed) == 1 and listed[0] <= len(rows)
