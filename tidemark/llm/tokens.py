"""Token ids by a public tokenizer, each distinct word of a worker encoded once.

Texts of a batch lie end to end and are cut, in numpy, where the pattern of a byte-level pre-tokenizer
must begin a new piece whatever stands around it: at a change between letters, digits, other signs and
white space (but for an apostrophe before a letter, and a space, which goes with what follows it), and
within white space before its last character. So the ids of the pieces, one after the other, are the ids
of the text. Which class a character belongs to is asked of the pre-tokenizer itself. Pieces are looked
up through an Arrow dictionary, and only those new to the worker go to the tokenizer.

Texts that hold the string of a special token, and all texts where the tokenizer works otherwise, are
encoded whole.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tidemark.llm.common import slices, utf8

#: Pieces kept in a worker; beyond it the store starts anew.
STORED_PIECES = 500_000
#: Bytes of text cut and looked up at a time.
_BYTES = 2_000_000
_LETTER, _DIGIT, _SIGN, _SPACE = 1, 2, 3, 4
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Encodes texts to 32-bit ids."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        by_bytes = said.get("pre_tokenizer") == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.by_piece = by_bytes and said.get("normalizer") is None and said.get("truncation") is None and len(feed) == 1
        self.feed = feed[0] if len(feed) == 1 else -1
        self.whole = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes = np.zeros(0x110000, np.int8)  # by code point; 0 where not asked yet
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _class(self, sign: str) -> int:
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for kind, before in ((_LETTER, "a"), (_DIGIT, "1"), (_SIGN, "!")):
            if len(cut(before + sign)) == 1:
                return kind
        return _SPACE

    def _classes(self, raw: np.ndarray) -> np.ndarray:
        """The class of the character that each byte belongs to."""
        points, place = raw, None
        if len(raw) and raw.max() >= 0x80:
            place = np.flatnonzero((raw & 0xC0) != 0x80)
            lead = raw[place].astype(np.int32)
            points = lead.copy()
            wide = np.flatnonzero(lead >= 0xC0)
            at, first = place[wide], lead[wide]
            length = 2 + (first >= 0xE0) + (first >= 0xF0)
            value = first & (0x7F >> length)
            for k in range(1, 4):
                more = length > k
                value[more] = (value[more] << 6) | (raw[at[more] + k] & 0x3F)
            points[wide] = value
        own = self.classes[points]
        if not own.all():
            for p in np.unique(points[own == 0]).tolist():
                self.classes[p] = self._class(chr(p))
            own = self.classes[points]
        return own if place is None else np.repeat(own, np.diff(np.append(place, len(raw))))

    def cuts(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where pieces begin in texts laid end to end (at: where each text begins, and the end)."""
        kind = self._classes(raw)
        begins = np.zeros(len(raw) + 1, bool)
        begins[at] = True
        cut = np.zeros(len(raw), bool)
        cut[1:] = kind[1:] != kind[:-1]
        cut[1:] &= ~((kind[:-1] == _SPACE) & (raw[:-1] == 32))
        cut[1:] &= ~((raw[:-1] == 39) & (kind[1:] == _LETTER))
        space = np.flatnonzero((kind[1:] == _SPACE) & (kind[:-1] == _SPACE) & ((raw[1:] & 0xC0) != 0x80)) + 1
        lead = raw[space].astype(np.int32)
        after = space + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        inner = ~begins[np.minimum(after, len(raw))]
        inner[inner] = kind[after[inner]] != _SPACE
        cut[space[inner]] = True
        cut |= begins[:-1]
        return np.flatnonzero(cut)

    def _learn(self, pieces: list[bytes]) -> None:
        """Store the ids of new pieces: those that do not end in white space by one text with a line feed between them, the others one by one."""
        spaces = {p for p in pieces if p[-1] < 33 or p[-1] > 126 and self.classes[ord(p.decode()[-1])] == _SPACE}
        plain = [p for p in pieces if p not in spaces]
        for k in range(0, len(plain), 2000):
            own = plain[k : k + 2000]
            text = b"\n".join(own).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == self.feed), len(ids))
            self._store(own, ids, np.append(0, ends[:-1] + 1), np.diff(ends, prepend=-1) - 1)
        for p in spaces:
            ids = np.array(self.tokenizer.encode(p.decode(), add_special_tokens=False).ids, np.uint32)
            self._store([p], ids, np.zeros(1, np.int64), np.array([len(ids)]))

    def _store(self, pieces: list[bytes], ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        first, last = len(self.known), len(self.known) + len(pieces)
        while last > len(self.at):
            self.at, self.size = (np.append(x, np.zeros(len(x), np.int64)) for x in (self.at, self.size))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(len(self.ids), np.uint32))
        self.known.update(zip(pieces, range(first, last), strict=True))
        self.at[first:last], self.size[first:last] = self.used + starts, sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _by_piece(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = self.cuts(raw, at)
        if len(self.known) > STORED_PIECES:
            self.forget()
        ends = np.append(begin, len(raw)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        _, places, data = pieces.dictionary.buffers()
        data, places = data.to_pybytes(), np.frombuffer(places, np.int32)[: len(pieces.dictionary) + 1].tolist()
        distinct = [data[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
        if lacking := [p for p in distinct if p not in self.known]:
            self._learn(lacking)
        own = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[pieces.indices.to_numpy()]
        size = self.size[own]
        upto = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(self.at[own] - upto[:-1], size)
        where += np.arange(upto[-1])
        return self.ids[where], upto[np.searchsorted(begin, at)]

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end (UTF-8 bytes, at as in cuts), and where each text's ids begin (n + 1)."""
        texts = raw.tobytes()
        if self.by_piece and not any(x in texts for x in self.whole):
            return self._by_piece(raw, at)
        ids, ends = [], [0]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = texts[a:b]
            if self.by_piece and not any(x in own for x in self.whole):
                ids.append(self._by_piece(raw[a:b], np.array([0, b - a]))[0])
            else:
                ids.append(np.array(self.tokenizer.encode(own.decode(), add_special_tokens=False).ids, np.uint32))
            ends.append(ends[-1] + len(ids[-1]))
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array(ends)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_column(path: str, column: pa.Array, end_id: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a text column (null: empty): first row, end row, ids with ``end_id`` behind each text, and where each text's ids begin (n + 1)."""
    own = encoder(path)
    raw, at = utf8(column)
    for i, j in slices(np.diff(at), _BYTES):
        ids, begin = own.encode(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        out = np.full(len(ids) + j - i, end_id, "<u4")
        places = np.arange(len(ids)) + np.repeat(np.arange(j - i), np.diff(begin))
        out[places] = ids
        yield i, j, out, begin + np.arange(j - i + 1)


def crc(ids: np.ndarray) -> int:
    """Of ids as little-endian 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
