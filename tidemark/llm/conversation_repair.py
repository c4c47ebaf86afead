"""Repair of the turn structure of conversations with a suffix-shared automaton.

A conversation's rows give a signature, one symbol a row: the role's class and whether the row is sound,
truncated or has to go. Which edits mend it best from some row on follows from the grammar's state before
that row and from the signature's rest alone. So the distinct signatures of all conversations are read
from their ends into an automaton that shares suffixes: a node stands for one suffix, is made of its first
symbol and the node of the rest, and carries for each grammar state the cost to go and the first edit of
the best audit suffix, which goes on at the next node. Shards are ranges of reversed signatures, so those
that share a suffix meet in one shard, but for the few at its edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_by_skewed_key, materialize, partitions

#: Costs of edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Fixed values of a signature: roles s, u, a or another (o) when sound, capitals when truncated, x for blank and repeated rows.
SYMBOLS = "suaoSUAOx"
#: Grammar states: nothing yet, after the system turn, after a user turn, after an assistant turn. An insert leads from each to _NEXT.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = np.array([_USER, _USER, _ASSISTANT, _USER])
_NEVER = np.int64(1) << 60
#: Edits by rank of their initials; the lowest rank wins a tie.
_LETTERS = np.array(list("DIKR"))
_D, _I, _K, _R = range(4)
#: A table of solved signatures may be broadcast up to so many bytes.
_BROADCAST_BYTES = 16 << 20

#: A character that is no blank.
_SEEN = r"[^\x20\x09-\x0D]"


def _keeps() -> np.ndarray:
    """State after keeping a row, by symbol and state; -1 where the grammar forbids it."""
    to = np.full((len(SYMBOLS), 4), -1)
    for k, symbol in enumerate(SYMBOLS):
        if symbol in "sS":
            to[k, _START] = _SYSTEM
        elif symbol in "uU":
            to[k, [_START, _SYSTEM, _ASSISTANT]] = _USER
        elif symbol in "aA":
            to[k, _USER] = _ASSISTANT
    return to


_KEEP = _keeps()
_EXTRA = np.array([TRUNCATED if s in "SUAO" else 0 for s in SYMBOLS])
_GOES = np.array([s == "x" for s in SYMBOLS])


class Automaton:
    """Nodes in order of their depth from the end: node 0 is the empty suffix. cost, edit: by node and state; of an edit I the one after it follows in the same node."""

    def __init__(self, signatures: np.ndarray, lengths: np.ndarray):
        """signatures: symbols of all signatures one after the other; lengths: of each."""
        ends = np.cumsum(lengths)
        top = np.zeros(len(lengths), np.int64)
        cost, edit = [np.array([[0, _NEVER, _NEVER, 0]])], [np.full((1, 4), -1)]
        self._relax(cost[0], edit[0])
        symbols, rest = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        made = 1
        last = cost[0]
        base = 0
        active = np.flatnonzero(lengths)
        for depth in range(1, int(lengths.max(initial=0)) + 1):
            active = active[lengths[active] >= depth]
            pairs, at = np.unique(top[active] * len(SYMBOLS) + signatures[ends[active] - depth], return_inverse=True)
            symbol, after = pairs % len(SYMBOLS), pairs // len(SYMBOLS)
            own, first = self._step(last[after - base], symbol)
            cost.append(own)
            edit.append(first)
            symbols.append(symbol)
            rest.append(after)
            top[active] = made + at
            last, base, made = own, made, made + len(pairs)
        self.cost, self.edit, self.symbol, self.rest, self.top = np.concatenate(cost), np.concatenate(edit), np.concatenate(symbols), np.concatenate(rest), top

    @staticmethod
    def _relax(cost: np.ndarray, edit: np.ndarray) -> None:
        """Let each state insert a turn first, where that is cheaper, or as cheap and before in ASCII. After a user or an assistant turn a second insert in a row leads back and never pays; the other two states go on from there."""
        for states in ([_USER, _ASSISTANT], [_START, _SYSTEM]):
            inserted, now = np.minimum(cost[:, _NEXT[states]] + INSERT, _NEVER), cost[:, states]
            better = (inserted < now) | ((inserted == now) & (now < _NEVER) & (edit[:, states] > _I))
            cost[:, states], edit[:, states] = np.where(better, inserted, now), np.where(better, _I, edit[:, states])

    def _step(self, after: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        extra = np.where(_GOES[symbol], _NEVER, _EXTRA[symbol])[:, None]
        to = _KEEP[symbol]
        kept = np.where(to < 0, _NEVER, np.take_along_axis(after, np.maximum(to, 0), axis=1) + extra)
        choices = np.minimum(np.stack([after + DELETE, np.full_like(after, _NEVER), kept, after[:, _NEXT] + REROLE + extra]), _NEVER)
        edit = choices.argmin(axis=0)  # the first of equals: the lowest letter
        cost = np.take_along_axis(choices, edit[None], axis=0)[0]
        self._relax(cost, edit)
        return cost, edit

    def audits(self) -> Iterator[str]:
        """The best edits of each signature, read off its path to the end."""
        for top in self.top.tolist():
            out, node, state = [], top, _START
            while True:
                e = int(self.edit[node, state])
                if e < 0:
                    break
                out.append(e)
                if e == _I:
                    state = int(_NEXT[state])
                    continue
                if e == _K:
                    state = int(_KEEP[self.symbol[node], state])
                elif e == _R:
                    state = int(_NEXT[state])
                node = int(self.rest[node])
            yield "".join(_LETTERS[out])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One automaton over the signatures of a task, which has a range of the reversed ones."""
    held = [b.column("sig") for b in batches if b.num_rows]
    if not held:
        return
    signatures = pa.chunked_array(held, pa.string()).to_pylist()
    code = np.zeros(256, np.int64)
    code[[ord(s) for s in SYMBOLS]] = np.arange(len(SYMBOLS))
    raw = np.frombuffer("".join(signatures).encode(), np.uint8)
    made = Automaton(code[raw], np.array([len(s) for s in signatures], np.int64))
    audits = list(made.audits())
    for lo in range(0, len(signatures), 10_000):
        part = slice(lo, lo + 10_000)
        yield pa.RecordBatch.from_arrays([pa.array(signatures[part]), pa.array(made.cost[made.top[part], _START]), pa.array(audits[part])], names=["sig", "cost", "audit"])


def solve(signatures: DataFrame, per_shard: int = 50_000) -> DataFrame:
    """(sig, cost long, audit) of every distinct signature (column sig string)."""
    own = signatures.select("sig").distinct()
    own = materialize(own, "signatures")
    n = max(partitions(own.sparkSession), own.count() // per_shard + 1)
    return materialize(own.repartitionByRange(n, F.reverse("sig")).mapInArrow(_solve, "sig string, cost long, audit string"), "repairs")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turns: list of (turn, role, text, blank, cut, copies) in order) with each row's fault, the signature and the counts."""
    counted = ("gaps", "blank", "duplicate", "truncated", "illegal")
    pairs = {"su", "ua", "au"}
    for b in batches:
        signatures, counts, rows = [], [], []
        for turns in b.column("turns").to_pylist():
            seen, symbols, own, initials = set(), [], [], []
            faults = dict.fromkeys(counted, 0)
            for t in turns:
                for _ in range(t["copies"]):
                    role, text = t["role"], t["text"]
                    again = (role, text) in seen
                    seen.add((role, text))
                    fault = "blank" if t["blank"] else "duplicate" if again else "truncated" if t["cut"] else None
                    if fault:
                        faults[fault] += 1
                    kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
                    symbols.append("x" if fault in ("blank", "duplicate") else kind.upper() if fault else kind)
                    initials.append(role[:1])
                    own.append({"role": role, "text": text, "fault": fault})
            faults["illegal"] = sum(x + y not in pairs for x, y in zip(initials, initials[1:], strict=False))
            numbers = {t["turn"] for t in turns} - {None}
            faults["gaps"] = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
            signatures.append("".join(symbols))
            counts.append([faults[c] for c in counted])
            rows.append(own)
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("fault", pa.string())]))
        columns = [pa.array(list(x), pa.int64()) for x in zip(*counts, strict=True)] or [pa.array([], pa.int64())] * len(counted)
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(rows, kind), pa.array(signatures, pa.string()), *columns], names=["conv_id", "turns", "sig", *counted])


def apply_audit(turns: list[dict], audit: str) -> list[dict]:
    """The repaired turns: the grammar's state gives the role of what is inserted or renamed."""
    out, state, at = [], _START, iter(turns)
    for edit in audit:
        row = next(at) if edit != "I" else None
        if edit == "D":
            continue
        if edit == "K":
            state = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}[row["role"][0]]
            out.append({"role": row["role"], "text": row["text"]})
        else:
            state = int(_NEXT[state])
            out.append({"role": "user" if state == _USER else "assistant", "text": row["text"] if row else ""})
    return out


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    for b in batches:
        fixed = [apply_audit(t, a) for t, a in zip(b.column("turns").to_pylist(), b.column("audit").to_pylist(), strict=True)]
        names = [n for n in b.schema.names if n not in ("turns", "sig")]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(fixed, kind)], names=[*names, "repaired"])


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows as the contract damages them, by crc32 of conversation and turn; copies is 0 for a dropped row and 2 for a repeated one."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = (F.coalesce(F.col(c).cast("string"), blank) for c in ("role", "text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _truncated(text: Column) -> Column:
    """Whether the last character that is no blank is none of . ! ?; only the text's end is looked at where that decides."""
    return ~F.regexp_like(text, F.lit(r"[.!?][\x20\x09-\x0D]*\z"))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired (array of role, text).

    rows: conv_id, turn, role, text (strings; null counts as one blank), and how often each stands there
    (copies; 1 without that column, 0 for a conversation's lost rows). A conversation's rows are taken by
    turn, null first, then by role and text. A row's first fault counts: blank (nothing but blanks),
    duplicate (role and text stood before), truncated (the last character that is no blank is none of
    ``.!?``). gaps are the numbers missing between the lowest and highest turn; illegal counts neighbours
    whose roles' initials are not su, ua or au. The repair gives roles of initials ``(s?(ua)+)?`` at least
    cost: keep 0, rerole 3, delete 4 (blank and duplicate rows have to go), insert an empty turn 3, and 3
    for every truncated row that stays; audit has the edits' initials, least in ASCII among the cheapest.
    A role without an initial can't be kept. Without rows: zeros, an empty audit, nothing repaired. A null
    conv_id is a conversation of its own. Other columns are not read. One conversation is one row of a task.
    """
    have = rows.columns
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    copies = F.col("copies") if "copies" in have else F.lit(1)
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.cast("int").alias("copies"))
    turn = F.struct("turn", "role", "text", (~F.regexp_like("text", F.lit(_SEEN))).alias("blank"), _truncated(F.col("text")).alias("cut"), "copies")
    grouped = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("copies") > 0, turn))).alias("turns"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    counts = "gaps long, blank long, duplicate long, truncated long, illegal long"
    signed = grouped.mapInArrow(_sign, f"conv_id {kind}, turns array<struct<role: string, text: string, fault: string>>, sig string, {counts}")
    signed = materialize(signed, "signed-conversations")
    frequent = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    frequent = materialize(frequent, "signature-counts")
    solved = frequent.join(solve(frequent), "sig")
    total, size = frequent.agg(F.sum("n"), F.sum(2 * F.length("sig") + 16)).first()
    if (size or 0) <= _BROADCAST_BYTES:
        joined = signed.join(F.broadcast(solved.drop("n")), "sig")
    else:
        joined = join_by_skewed_key(signed, solved, ["sig"], "n", total).drop("n")
    wide = joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns")
    return wide.mapInArrow(_apply, f"conv_id {kind}, {counts}, cost long, audit string, repaired array<struct<role: string, text: string>>")
