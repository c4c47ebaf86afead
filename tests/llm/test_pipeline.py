"""The pipeline's stages against brute force, and the queries without SQL on the same small tables."""

import random
import zlib
from collections import Counter, defaultdict

import __spark_entry__ as entry
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from cases import documents
from test_dedup import unique, words
from test_text import BENCH, corpus
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EMPTY = {3000: None, 3001: "", 3002: "", 3003: "...", 3004: "...", 3005: "\n\n"}


def planted() -> tuple[list[tuple], list[tuple], dict[str, set[int]]]:
    """Documents, labels, and ids by text of those planted more than once."""
    docs, labels = corpus(200)
    rng = random.Random(6)
    lexicon = sorted({w for _, t, *_ in docs for w in t.split(" ") if w.isalpha() and not w.startswith("zork")})
    prose = lambda k: "\n".join(" ".join(rng.choice(lexicon) for _ in range(9)) for _ in range(k))
    groups = defaultdict(set)
    for k in range(4):
        text = prose(1 + 3 * k)
        for j in range(2 + 5 * k):
            groups[text].add(2000 + 100 * k + j)
    docs += [(i, t, "en", "s", len(t)) for t, own in groups.items() for i in own]
    docs += [(i, t, "en", "s", 0) for i, t in EMPTY.items()]
    docs += [(5000 + r[0], r[1], "en", "s", len(r[1] or "")) for r in documents() if r[0] is not None]
    for k in range(6):
        w = [rng.choice(lexicon) for _ in range(60)]
        for j in range(3):
            docs.append((6000 + 10 * k + j, " ".join([*w[: 59 - j], "changed", *w[60 - j :]]), "en", "s", 0))
    docs.append((7000, "start " + " ".join(f"w{k}" for k in range(2, 13)) + " end", "en", "s", 0))
    # Rows that share an id: one had words and goes, the other was empty and stays.
    text = next(iter(groups))
    docs += [(4000, text, "en", "s", 5), (4000, "", "en", "s", 0), (None, text, "en", "s", 5), (None, "", "en", "s", 0)]
    return docs, labels, groups


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs, labels, _ = planted()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def outputs(spark, folder, tmp_path_factory):
    """Rows that go into the first stage and that each stage leaves."""
    path = str(tmp_path_factory.mktemp("stages"))
    d = spark.read.parquet(f"{folder}/documents.parquet")
    found = [d.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, d, folder).write.parquet(f"{path}/{name}")
        d = spark.read.parquet(f"{path}/{name}")
        found.append(d.collect())
    return found


def test_one_of_each_group_of_copies_is_packed(outputs):
    clean = [r["doc_id"] for r in outputs[1]]
    packed = [r["doc_id"] for r in outputs[-1] if r["piece"] == 0]
    for own in planted()[2].values():
        assert own <= set(clean) and len(own & set(packed)) <= 1
    # A null id comes first, so its text is the first occurrence of the smallest group.
    assert sum(len(own & set(packed)) for own in planted()[2].values()) == 3
    assert packed.count(None) == 2 and packed.count(4000) == 1
    assert set(EMPTY) <= set(clean) and all(packed.count(i) == 1 for i in EMPTY)


def pairs(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def test_line_dedup_leaves_first_occurrences(outputs):
    seen, want, cut = set(), Counter(), 0
    for r in unique(outputs[1]):
        if r["text"] is None:
            want[r["doc_id"], None] += 1
            continue
        lines, gone = r["text"].split("\n"), set()
        for i in range(max(1, len(lines) - 2)):
            w = tuple(lines[i : i + 3])
            if w in seen:
                gone.update(range(i, i + len(w)))
            seen.add(w)
        cut += 0 < len(gone) < len(lines)
        want[r["doc_id"], "\n".join(x for i, x in enumerate(lines) if i not in gone)] += 1
    assert pairs(outputs[2]) == want and cut > 5


def test_near_duplicates_leave_one_of_each_class(outputs):
    wordless = Counter(r["doc_id"] for r in outputs[0] if r["text"] is not None and not words(r["text"]))
    rows = []
    for r in unique(outputs[2]):
        if r["text"] == "":
            if not wordless[r["doc_id"]]:
                continue
            wordless[r["doc_id"]] -= 1
        rows.append(r)
    sets = []
    for r in rows:
        w = words(r["text"])
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert pairs(outputs[3]) == pairs([r for i, r in enumerate(rows) if find(i) == i])
    assert sum(find(i) != i for i in range(len(rows))) >= 12


def test_decontamination_leaves_documents_without_a_window(outputs):
    windows = {tuple(w[k : k + 10]) for w in (words(t) for _, t in BENCH) if w for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    assert pairs(outputs[4]) == pairs([r for r in outputs[3] if not hit(words(r["text"]))])
    assert 7000 in {r["doc_id"] for r in outputs[3]} - {r["doc_id"] for r in outputs[4]}


def pieces(rows, capacity=2048):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in rows:
        x = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(x) % capacity or capacity, len(x) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[r["doc_id"], k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())] += 1
    return want


def test_packing_has_all_that_is_left(outputs):
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in outputs[5]) == pieces(outputs[4])


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.split("_")[0] in ("op1", "op3", "op7", "op8", "op9", "op10")])
def test_queries_without_sql(spark, folder, outputs, name):
    got = entry.queries()[name](spark, folder).collect()
    if name.startswith("op9"):
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces(outputs[0])
        return
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in outputs[0])
    if name.startswith("op1_"):
        for own in planted()[2].values():
            low = None if 2000 in own else min(own)
            assert {r["class_id"] for r in got if r["doc_id"] in own} == {low} and not any(r["keep"] for r in got if r["doc_id"] in own and r["doc_id"] != low)
    elif name.startswith("op3"):
        whole = Counter()
        for r in outputs[0]:
            whole[r["doc_id"]] += sum(k[3] * v for k, v in pieces([r]).items())
        have = Counter()
        for r in got:
            have[r["doc_id"]] += r["n_tokens"]
        assert have == whole
    elif name.startswith("op8"):
        seen, want = set(), Counter()
        for r in unique(outputs[0]):
            b = (r["text"] or "").encode()
            gone = np.zeros(len(b), bool)
            for k in range(len(b) - 99):
                if b[k : k + 100] in seen:
                    gone[k : k + 100] = True
                seen.add(b[k : k + 100])
            want[r["doc_id"], len(b), int(gone.sum())] += 1
        assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got) == want
    else:
        _, labels, _ = planted()
        label = {i: t if name.startswith("op7") else q for i, q, t in labels}
        right = [r["predicted"] == label[r["doc_id"]] for r in got if r["doc_id"] in label]
        assert all(0 <= r["score"] <= 1 for r in got) and np.mean(right) > 0.85
        cut, modulus, fold = (0.7, 3, 1) if name.startswith("op7") else (0.3, 5, 0)
        assert all(r["predicted"] == (r["score"] >= cut) for r in got)
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % modulus == fold) for r in got)


def test_stages_with_clashing_columns_repeated_ids_and_no_rows(spark, folder, tmp_path):
    """Extra columns named like inner ones stay as they are through all stages but the last."""
    docs = [(k % 30, f"some words of text number {k} and more of them {k % 7}", "en", "s", 5, 0.5, "t", 1, 2, "r", None) for k in range(60)]
    extra = "score double, _text string, row long, hash long, doc string, spans int"
    d = spark.createDataFrame(docs, f"{SCHEMA}, {extra}")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for rows in (d, d.limit(0)):
            out = stage(spark, rows, str(tmp_path))
            assert name == "packing" or out.columns == d.columns
            path = str(tmp_path / f"{name}-{rows is d}")
            out.write.parquet(path)
            assert (spark.read.parquet(path).count() > 0) == (rows is d)
        d = spark.read.parquet(str(tmp_path / f"{name}-True"))


def test_a_first_result_is_whole_after_a_second_run(spark, outputs, folder):
    docs = [r for r in outputs[4]]
    d = spark.createDataFrame(docs, SCHEMA)
    pack = dict(corpus_pipeline.STAGES)["packing"]
    first = pack(spark, d, folder)
    second = pack(spark, d.limit(10), folder)
    assert second.count() >= 10 and first.count() == len(outputs[5])
    whole = corpus_pipeline.run(spark, folder)
    corpus_pipeline.run(spark, folder)
    assert whole.count() == len(outputs[5])
