"""Token store and packing against the tokenizer itself."""

import glob
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.orc as orc
import pytest
from cases import SCHEMA, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing, token_store, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def encoded(texts: list[str | None]) -> list[list[int]]:
    out = []
    for i, j, ids, begin in tokens.encode_column(PATH, pa.array(texts, pa.string())):
        assert i == len(out) and j - i == len(begin) - 1
        out += [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)]
    return out


def test_pieces_give_the_ids_of_whole_texts(plain):
    rng = random.Random(2)
    parts = [" ", " ", "\n", "\t", "a", "é", "1", ".", ",", "'", "'s", "!", "…", "\xa0", "　", "͡", "😀", "\r", ";", "don't", "²", "字", "\x1c", "<|endoftext|>", "'LL", "\u0085"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
    for some in (texts, [t for t in texts if "<|" not in t]):  # the second in one run of pieces
        for t, got in zip(some, encoded(some), strict=True):
            assert got == [*plain.encode(t, add_special_tokens=False).ids, 0], repr(t)


def test_special_strings_are_special_tokens(plain):
    text = "a <|endoftext|> b"
    assert encoded([text, None, "b"]) == [[64, 220, 50256, 275, 0], [0], [65, 0]]
    assert plain.encode(text, add_special_tokens=False).ids == [64, 220, 50256, 275]


def test_the_store_starts_anew(plain, monkeypatch):
    monkeypatch.setattr(tokens, "STORED_PIECES", 5)
    monkeypatch.setattr(tokens, "_BYTES", 40)
    texts = [f"word{k} and others, {k}" for k in range(60)]
    assert encoded(texts) == [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, texts = Tokenizer.from_file(path), ["Some words, in  here", "", "'s\n x"]
    for i, j, ids, begin in tokens.encode_column(path, pa.array(texts)):
        assert [ids[a : b - 1].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in texts[i:j]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_text(plain, texts):
    assert encoded(texts) == [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_ids_of_any_type(spark, tmp_path):
    docs = spark.createDataFrame([("b", "two words"), ("a", "one"), (None, "x")], "doc_id string, text string")
    token_store.write_tokens(docs, str(tmp_path / "s"), PATH)
    assert [r["doc_id"] for r in token_store.token_manifest(spark, str(tmp_path / "s")).orderBy("start").collect()] == [None, "a", "b"]
    assert {r["doc_id"] for r in packing.pack(docs, PATH).collect()} == {None, "a", "b"}


def test_store(spark, plain, tmp_path):
    docs = spark.createDataFrame(documents(), SCHEMA)
    path = str(tmp_path / "store")
    token_store.write_tokens(docs, path, PATH)
    rows = token_store.token_manifest(spark, path).collect()
    want = defaultdict(list)
    for r in documents():
        x = [*plain.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want[r[0]].append((len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    files = glob.glob(f"{path}/*.orc")
    assert files and sum(orc.ORCFile(f).nrows for f in files) == len(rows)
    one = token_store.read_tokens(spark, path).filter("doc_id = 3")
    assert one.count() == len(want[3]) and "EqualTo(doc_id,3)" in one._jdf.queryExecution().toString()


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(spark, plain, capacity):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = packing.pack(docs, PATH, capacity).collect()
    want = defaultdict(list)
    for r in rows:
        x = [*plain.encode(r[1] or "", add_special_tokens=False).ids, 0]
        first = len(x) % capacity or capacity
        cuts = [0, *range(first, len(x) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[r[0], k].append((a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())))
    have = defaultdict(list)
    for r in got:
        have[r["doc_id"], r["piece"]].append((r["start"], r["length"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) <= 1.25 * sum(r["length"] for r in got) / capacity + 1


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(100):
        capacity = rng.randint(1, 40)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
        bins = []
        for x in sorted(lengths, reverse=True):
            fit = [k for k, free in enumerate(bins) if free >= x]
            if fit:
                bins[min(fit, key=bins.__getitem__)] -= x
            else:
                bins.append(capacity - x)
        slots = packing.plan({x: lengths.count(x) for x in set(lengths)}, capacity)
        load, placed = defaultdict(int), 0
        for s in slots:
            for r in range(s.first_rank, s.end_rank):
                k = r - s.first_rank
                bin_, offset = s.first_sequence + k // s.per_sequence, s.offset + k % s.per_sequence * s.length
                assert load[bin_] == offset
                load[bin_] += s.length
                placed += 1
        assert placed == len(lengths) and len(load) == len(bins) and all(v <= capacity for v in load.values())


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    token_store.write_tokens(none, str(tmp_path / "s"), PATH)
    assert token_store.token_manifest(spark, str(tmp_path / "s")).count() == 0 and packing.pack(none, PATH).count() == 0
