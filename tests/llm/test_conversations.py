"""Prefix tries and repairs of conversations against plain recursion over small tables with every awkward trait."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from tidemark.llm import conversation_repair, prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, kind string, audit string, sig int"


def conversations(seed: int = 5, n: int = 70) -> list[tuple]:
    rng = random.Random(seed)
    said = ["Yes.", "no", "", " \t", "Is it so?", "a b  c\nd.", None, "Ende! ", "…", "x" * 400 + "."]
    rows = []
    for c in [*range(-25, n), 10**12]:
        roles = ["system"] * rng.randint(0, 1) + ["user", "assistant"] * rng.randint(0, 4)
        for k, role in enumerate(roles):
            role = rng.choice([role] * 8 + ["tool", None, "", "user"])
            turn = None if rng.random() < 0.05 else k + (rng.random() < 0.1)
            rows.append((c, turn, role, rng.choice(said[:3] if k < 2 else said), "x", None, 1))
    rows += [(500, k, "ua"[k % 2], f"{k % 7}.", "x", None, 1) for k in range(150)] + [(501, k, "ua"[k % 2], f"{k % 7 if k < 90 else 8}.", "x", None, 1) for k in range(120)]
    rows += [rows[3], rows[3], (None, 0, "user", "none", None, None, None), (None, None, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


def _first_nulls(x):
    return (x is not None, x or 0)


def _trie(own: dict[int, list[tuple]]) -> set[tuple]:
    members: dict[tuple, list[int]] = {}
    for c, turns in own.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below: dict[tuple, list[tuple]] = {}
    for path in members:
        if path:
            below.setdefault(path[:-1], []).append(path)
    out, sums = set(), {}
    for path in sorted(members, key=len, reverse=True):
        kids = below.get(path, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves, saved = sum(sums[k][0] for k in kids) or 1, sum(sums[k][1] for k in kids) + (len(members[path]) - 1) * words
        sums[path] = leaves, saved
        ends = ",".join(str(c) for c in sorted(c for c in members[path] if len(own[c]) == len(path)))
        parent = min(members[path[:-1]]) if path else None
        out.add((min(members[path]), len(path), parent, len(members[path]), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _sequences(rows: list[tuple]) -> dict[int, list[tuple]]:
    own: dict[int, list[tuple]] = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            said = (role or "", text or "")
            own.setdefault(c, []).append((_first_nulls(turn), hashlib.md5(f"{len(said[0].encode())}:{said[0]}{said[1]}".encode()).hexdigest(), said))
    return {c: [t[2] for t in sorted(turns)] for c, turns in own.items()}


def _rebuilt(own: dict[int, list[tuple]]) -> dict[int, list[tuple]]:
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


@pytest.mark.parametrize("shards", [1, 3, 9])
def test_trie_is_that_of_plain_recursion_however_many_shards(spark, shards):
    rows = conversations()
    made = prefix_trie.share_heads(prefix_trie.turn_sequences(spark.createDataFrame(rows, SCHEMA)))
    found = prefix_trie.prefix_trie(made, shards).collect()
    assert len(found) == len({tuple(r) for r in found}) and {tuple(r) for r in found} == _trie(_rebuilt(_sequences(rows)))


def test_trie_of_one_hot_conversation_and_of_none(spark):
    rows = [(c, k, "user", f"turn {k} of all.") for c in range(600) for k in range(5)] + [(c, 0, "user", str(c)) for c in range(600, 640)]
    seq = prefix_trie.turn_sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {tuple(r) for r in prefix_trie.prefix_trie(seq, 7).collect()}
    assert found == _trie(_sequences(rows))
    assert prefix_trie.prefix_trie(seq.limit(0)).count() == 0
    bare = spark.createDataFrame([(3, []), (2, [])], seq.schema)
    assert [tuple(r)[:6] for r in prefix_trie.prefix_trie(bare).collect()] == [(2, 0, None, 2, 0, 1)]
    assert {r["depth"]: r["turn_id"] is None for r in prefix_trie.node_turns(prefix_trie.prefix_trie(seq), seq).collect()}[0] is True


def _damaged(rows: list[tuple]) -> dict:
    out: dict = {}
    for c, turn, role, text, *_ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own = out.setdefault(c, [])
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(own, key=lambda t: (_first_nulls(t[0]), t[1], t[2])) for c, own in out.items()}


def _repaired(turns: list[tuple]) -> tuple:
    seen, rows, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in turns:
        last = text.strip(" \t\n\x0b\x0c\r")[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        rows.append((role, text, fault))

    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i: int, last: str, inserts: int = 0) -> tuple:
        """Least (cost, audit, turns) of the rows from i on; last: the initial that came out last."""
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []

        def way(cost, letter, role, text, j, inserts=0):
            if to := follows.get((last, role[:1])):
                c, a, o = best(j, to, inserts)
                found.append((c + cost, letter + a, ((role, text), *o)))

        if i < len(rows):
            role, text, fault = rows[i]
            c, a, o = best(i + 1, last)
            found.append((c + 4, "D" + a, o))
            if fault not in ("blank", "duplicate"):
                for letter, price, r in [("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")]:
                    way(price + 3 * (fault == "truncated"), letter, r, text, i + 1)
        if inserts < 3:
            for r in ("user", "assistant"):
                way(3, "I", r, "", i, inserts + 1)
        return min(found, default=(10**6, "", ()))

    cost, audit, out = best(0, "")
    numbers = {t[0] for t in turns} - {None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    initials = [r[0][:1] for r in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest


def test_repairs_are_those_of_plain_search(spark, tmp_path):
    rows = conversations(8, 160)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r["conv_id"]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    want = {c: _repaired(turns) for c, turns in _damaged(rows).items()}
    assert found == want
    assert any(not t for t in _damaged(rows).values()) and len({w[6] for w in want.values()}) > 30


def test_automaton_shares_suffixes_and_tables_without_rows_give_none(spark):
    import numpy as np

    code = {s: k for k, s in enumerate(conversation_repair.SYMBOLS)}
    signatures = ["suaua", "uaua", "ua", "xua", "", "Uaua"]
    made = conversation_repair.Automaton(np.array([code[s] for s in "".join(signatures)]), np.array([len(s) for s in signatures]))
    assert len(made.cost) == len({s[k:] for s in signatures for k in range(len(s) + 1)})  # a node for each distinct suffix
    assert list(made.audits()) == ["KKKKK", "KKKK", "KK", "DKK", "", "KKKK"]
    none = spark.createDataFrame([], SCHEMA)
    assert conversation_repair.repair(conversation_repair.damage(none)).count() == 0
    # without copies, as a table comes; and by the join that is not broadcast
    plain = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "tool", "cut"), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    before, conversation_repair._BROADCAST_BYTES = conversation_repair._BROADCAST_BYTES, -1
    try:
        got = {r["conv_id"]: (r["cost"], r["audit"], [tuple(t) for t in r["repaired"]]) for r in conversation_repair.repair(plain).collect()}
    finally:
        conversation_repair._BROADCAST_BYTES = before
    assert got == {1: (7, "IKD", [("user", ""), ("assistant", "Hi.")]), 2: (4, "D", [])}
