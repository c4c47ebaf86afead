"""Fingerprints and their links against plain loops."""

import random

import numpy as np
import pytest
import xxhash

from cases import SCHEMA, documents
from tidemark.llm import queries, simhash


def _plain(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    found = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def _roots(values: list[int]) -> dict[int, int]:
    own = sorted(set(values))
    a = np.array(own, np.uint64)
    root = list(range(len(own)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(own)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 3):
            x, y = find(i), find(i + 1 + int(j))
            root[max(x, y)] = min(x, y)
    return {v: own[find(k)] for k, v in enumerate(own)}


def _wanted(rows: list[tuple]) -> list[tuple]:
    prints = [_plain(r[1]) for r in rows]
    roots, low = _roots(prints), {}
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            low[roots[p]] = min(r[0], low.get(roots[p], r[0]))
    return sorted(((r[0], f"{p:016x}", low.get(roots[p])) for r, p in zip(rows, prints, strict=True)), key=str)


def _flipped(rng: random.Random, value: int, k: int) -> int:
    for b in rng.sample(range(64), k):
        value ^= 1 << b
    return value


def test_query_gives_components_of_all_documents(spark, tmp_path):
    rng, words = random.Random(4), [f"w{k}" for k in range(60)]
    rows = documents(n=120)
    for k in range(150):  # near copies of long texts, chained
        base = rows[-1][1].split(" ") if k % 10 else [rng.choice(words) for _ in range(300)]
        base[rng.randrange(len(base))] = rng.choice(words)
        rows.append((1000 - k, " ".join(base), "en", None, 0, 0, "x", None, 1))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op13_simhash(spark, str(tmp_path)).collect()
    want = _wanted(rows)
    assert sorted((tuple(r) for r in found), key=str) == want
    sizes = [w[2] for w in want]
    assert max(sizes.count(c) for c in set(sizes)) > 5 and len({w[1] for w in want}) > 100


def test_every_pair_within_three_bits_shares_a_key_that_is_nearest_for_one():
    rng = random.Random(9)
    a = [rng.getrandbits(64) for _ in range(4000)] + [0, (1 << 64) - 1]
    for k in (1, 2, 3):
        b = [_flipped(rng, v, k) for v in a]
        x, nearest = simhash.keys(np.array(a, np.uint64))
        y, _ = simhash.keys(np.array(b, np.uint64))
        assert (x[:, nearest][:, :, None] == y[:, None, :]).any(axis=(1, 2)).all()


def test_code_is_perfect():
    every = np.arange(1 << 23)
    own = simhash._syndromes(every)
    assert (np.bincount(own) == 1 << 12).all()
    near = simhash._LEADER[own]
    assert np.bitwise_count(near).max() == 3 and (simhash._syndromes(every ^ near) == 0).all()


def test_crowded_keys_are_dealt_into_blocks_and_lose_no_link(spark):
    rng = random.Random(2)
    values = [rng.getrandbits(21) << 43 | 12345 for _ in range(2500)]
    values += [_flipped(rng, rng.choice(values), rng.randint(1, 3)) for _ in range(2500)] + [_flipped(rng, rng.getrandbits(64), 0) for _ in range(300)]
    values = sorted(set(values))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    root = {v: v for v in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        x, y = find(u), find(v)
        root[max(x, y)] = min(x, y)
    want = _roots(values)
    groups, same = {}, {}
    for v, s in zip(values, signed, strict=True):
        groups.setdefault(find(s), set()).add(v)
        same.setdefault(want[v], set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, same.values()))
    assert len(edges) < 20 * len(values)


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_fingerprint_of_a_text_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(simhash, "_PIECE", piece)
    rng = random.Random(piece)
    for _ in range(200):
        text = "".join(rng.choice("abAB éÉ \t\n\x0b\x1f ") for _ in range(rng.randint(0, 90)))
        assert simhash.fingerprint(text.encode()) == _plain(text), repr(text)


def test_empty_table_and_documents_without_words(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_dedup(none).count() == 0
    few = spark.createDataFrame([(4, None), (None, ""), (2, " \n"), (7, "word")], "doc_id long, text string")
    found = {r["id"]: (r["fingerprint"], r["component_id"], r["n_docs"], r["keep"]) for r in simhash.simhash_dedup(few).collect()}
    assert found[4] == ("0" * 16, 2, 3, False) and found[2][3] and found[None] == ("0" * 16, 2, 3, False) and found[7][1] == 7
