"""Suffix order and common prefixes of texts larger than memory, by recursive induced sorting.

A suffix is S if it is smaller than the one to its right, else L; an S behind an L is a seed. A scan in
rising order induces all L suffixes from the sorted seeds, and a scan in sinking order all S suffixes
from the L ones. Both scans run on a priority queue of tuples (first symbol, position, common prefix):
tuples leave by first symbol, and those with one first symbol in the order in which they came, which is
the order of the suffixes behind them. The common prefix of a tuple with the one before it in its symbol
is one more than the least common prefix among what was scanned between their two sources.

Seeds are sorted by the same two scans: started from seeds in the order of their first symbols alone,
the scans sort the substrings from each seed to the next, and the common prefixes tell which are equal.
Where some are, their names form a text of at most half the length, which is sorted by recursion; its
common prefixes, counted in names, become those of the seeds.

Queues, sorted rows and texts share a budget of memory; what goes beyond it lies in files of the task.
Where many first symbols are rare (names), a lane of the queue holds several of them, and the scans take
all its tuples at once, with those that they feed to their own lane. Common prefixes are exact up to ``CAP`` symbols and CAP beyond it.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

CAP, _SAME = 253, 255
#: Tuples in a scanned block, and in a lane of the queue that holds several symbols.
_BLOCK, _LANE = 1 << 17, 1 << 15
_NEVER = np.iinfo(np.int64).max
Columns = tuple[np.ndarray, ...]


class Budget:
    """Bytes that may be kept in memory; counts what was written instead."""

    def __init__(self, memory: int) -> None:
        self.left, self.written, self.writes = memory, 0, 0

    def take(self, size: int) -> bool:
        if size > self.left:
            return False
        self.left -= size
        return True

    def array(self, n: int, dtype: type) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if n and not self.take(size):
            self.written, self.writes = self.written + size, self.writes + 1
            return np.asarray(np.memmap(tempfile.TemporaryFile(), dtype, "w+", shape=(n,)))
        return np.zeros(n, dtype)

    def free(self, array: np.ndarray) -> None:
        if array.base is None:
            self.left += array.nbytes


class _Store:
    """Blocks of columns, in memory or in a file."""

    def __init__(self, budget: Budget) -> None:
        self.budget, self.file, self.end = budget, None, 0

    def keep(self, columns: Columns) -> tuple:
        size = sum(c.nbytes for c in columns)
        if self.budget.take(size):
            return columns
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(self.end)
        places = []
        for c in columns:
            places.append((self.end, c.dtype))
            self.end += self.file.write(np.ascontiguousarray(c).data)
        self.budget.written, self.budget.writes = self.budget.written + size, self.budget.writes + 1
        return tuple(places)

    def read(self, block: tuple, start: int, stop: int, last: bool = True) -> Columns:
        """Rows of a block; whoever reads a block in memory for the last time gives its bytes back."""
        if isinstance(block[0], np.ndarray):
            if last:
                self.budget.left += (stop - start) * sum(c.itemsize for c in block)
            return tuple(c[start:stop] for c in block)
        out = []
        for place, dtype in block:
            self.file.seek(place + start * dtype.itemsize)
            out.append(np.frombuffer(self.file.read((stop - start) * dtype.itemsize), dtype))
        return tuple(out)


class Queue(_Store):
    """Priority queue of (key, position, prefix): lanes of keys, each in order of arrival."""

    def __init__(self, edges: np.ndarray, budget: Budget) -> None:
        super().__init__(budget)
        self.edges, self.lanes = edges, [deque() for _ in edges]
        self.pending: list[Columns] = []
        self.waiting = 0

    def put(self, columns: Columns) -> None:
        """Columns sorted by the first, the key."""
        if len(columns[0]):
            self.pending.append(columns)
            self.waiting += len(columns[0])
            if self.waiting > _BLOCK:
                self.flush()

    def flush(self) -> None:
        if not self.pending:
            return
        columns = self.pending[0]
        if len(self.pending) > 1:
            columns = tuple(np.concatenate(c) for c in zip(*self.pending, strict=True))
            order = np.argsort(columns[0], kind="stable")
            columns = tuple(c[order] for c in columns)
        self.pending, self.waiting = [], 0
        at = np.append(np.searchsorted(columns[0], self.edges), len(columns[0]))
        block = self.keep(columns)
        for lane in np.flatnonzero(np.diff(at)).tolist():
            self.lanes[lane].append((block, int(at[lane]), int(at[lane + 1])))

    def back(self, lane: int, columns: Columns) -> None:
        """Columns that all belong to the lane, which is being taken."""
        if len(columns[0]):
            self.lanes[lane].append((self.keep(columns), 0, len(columns[0])))

    def take(self, lane: int, most: int) -> Columns | None:
        """The next rows of a lane, about ``most`` of them."""
        parts, n = [], 0
        while self.lanes[lane] and n < most:
            block, start, stop = self.lanes[lane].popleft()
            if stop - start > most:
                self.lanes[lane].appendleft((block, start + most, stop))
                stop = start + most
            parts.append(self.read(block, start, stop))
            n += stop - start
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else None


class Rows(_Store):
    """Positions in order, each with its common prefix with the one before; read forwards or backwards."""

    def __init__(self, budget: Budget) -> None:
        super().__init__(budget)
        self.blocks: list[tuple[tuple, int]] = []
        self.pending: list[Columns] = []
        self.count = self.waiting = 0

    def append(self, positions: np.ndarray, prefixes: np.ndarray) -> None:
        if len(positions):
            self.pending.append((positions, prefixes))
            self.count += len(positions)
            self.waiting += len(positions)
            if self.waiting >= _BLOCK:
                self.flush()

    def flush(self) -> None:
        if self.pending:
            columns = tuple(np.concatenate(c) for c in zip(*self.pending, strict=True))
            self.blocks.append((self.keep(columns), len(columns[0])))
            self.pending, self.waiting = [], 0

    def forwards(self) -> Iterator[Columns]:
        """Leaves the rows in place."""
        self.flush()
        for block, n in self.blocks:
            yield self.read(block, 0, n, last=False)

    def backwards(self) -> Iterator[Columns]:
        """Takes the rows away; prefixes are with the row before in this order."""
        self.flush()
        carried = np.zeros(1, np.uint8)
        while self.blocks:
            block, n = self.blocks.pop()
            positions, prefixes = self.read(block, 0, n)
            yield positions[::-1], np.concatenate([carried, prefixes[:0:-1]])
            carried = prefixes[:1]


class _Seeds:
    """Rows read backwards, with the key of each position."""

    def __init__(self, rows: Rows, key) -> None:
        self.blocks, self.key = rows.backwards(), key
        self.keys = self.positions = self.prefixes = np.zeros(0, np.int64)
        self.at = 0

    def below(self, key: int, most: int) -> Columns | None:
        """The next of the seeds with a lower key; None if there is none left."""
        while self.at == len(self.keys):
            block = next(self.blocks, None)
            if block is None:
                return None
            self.positions, self.prefixes = block
            self.keys, self.at = self.key(self.positions), 0
        stop = min(self.at + int(np.searchsorted(self.keys[self.at :], key)), self.at + most)
        if stop == self.at:
            return None
        own = slice(self.at, stop)
        self.at = stop
        return self.keys[own], self.positions[own], self.prefixes[own]


class RangeMin:
    """Least value in inclusive ranges of an array of bytes: a table over spans of 2, 4, 8... in blocks of ``step``."""

    def __init__(self, values: np.ndarray, step: int = 1) -> None:
        self.values, self.step = values, step
        if step > 1:
            padded = np.full(-(-len(values) // step) * step, _SAME, np.uint8)
            padded[: len(values)] = values
            cells = padded.reshape(-1, step)
            self.ahead = np.minimum.accumulate(cells, axis=1).reshape(-1)
            self.back = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].reshape(-1)
            values = cells.min(axis=1)
        self.n = len(values)
        self.spans = np.empty((max(1, self.n.bit_length()), self.n), np.uint8)  # row k: least of 2**k values from each place on
        self.spans[0] = values
        for k in range(1, len(self.spans)):
            width = 1 << (k - 1)
            self.spans[k, : self.n - 2 * width + 1] = np.minimum(self.spans[k - 1, : self.n - 2 * width + 1], self.spans[k - 1, width : self.n - width + 1])
        self.flat = self.spans.reshape(-1)

    def _whole(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.frexp((last - first + 1).astype(np.float32))[1] - 1 if self.n < 1 << 24 else np.frexp((last - first + 1).astype(np.float64))[1] - 1
        row = level * np.int64(self.n)
        return np.minimum(self.flat[row + first], self.flat[row + last + 1 - (1 << level)])

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        if self.step == 1:
            return self._whole(first, last)
        a, b = first // self.step, last // self.step
        out = np.minimum(self.back[first], self.ahead[last])
        far = np.flatnonzero(b > a + 1)
        out[far] = np.minimum(out[far], self._whole(a[far] + 1, b[far] - 1))
        near = np.flatnonzero(a == b)
        at, stop = first[near].copy(), last[near]
        least = self.values[at]
        while len(open_ := np.flatnonzero(at < stop)):
            at[open_] += 1
            least[open_] = np.minimum(least[open_], self.values[at[open_]])
        out[near] = least
        return out


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least value in inclusive ranges: one by one where they are few or short, by a table elsewhere."""
    if (last - first).sum() > 8 * len(values):
        return RangeMin(values)(first, last)
    return np.minimum.reduceat(np.append(values, values[-1:]), np.stack([first, last + 1], axis=1).reshape(-1))[::2]


class _Running:
    """For each target of a bucket that is scanned in several blocks: the least prefix since its last tuple."""

    def __init__(self) -> None:
        self.targets, self.least = np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def of(self, targets: np.ndarray) -> np.ndarray:
        if not len(self.targets):
            return np.zeros(len(targets), np.uint8)
        at = np.minimum(np.searchsorted(self.targets, targets), len(self.targets) - 1)
        return np.where(self.targets[at] == targets, self.least[at], 0).astype(np.uint8)

    def pass_by(self, least: int, targets: np.ndarray, since: np.ndarray) -> None:
        old = ~np.isin(self.targets, targets)
        merged = np.concatenate([self.targets[old], targets.astype(np.int64)])
        values = np.concatenate([np.minimum(self.least[old], least).astype(np.uint8), since])
        order = np.argsort(merged)
        self.targets, self.least = merged[order], values[order]


class _Scan:
    """One scan over a text: ascending, or descending where flip is set (keys are then counted from the top)."""

    def __init__(self, t: np.ndarray, lanes: np.ndarray, flip: bool, budget: Budget) -> None:
        self.t, self.flip, self.top = t, flip, int(lanes[-1]) - 1  # lanes: lower bounds of symbols, and the end
        edges = (lanes[-1] - lanes[:0:-1]) if flip else lanes[:-1]
        self.edges, self.ends = edges, np.append(edges[1:], lanes[-1])
        self.queue = Queue(edges, budget)

    def key(self, positions: np.ndarray) -> np.ndarray:
        symbols = self.t[positions]
        return self.t.dtype.type(self.top) - symbols if self.flip else symbols

    def _before(self, keys, positions: np.ndarray, strict) -> tuple[np.ndarray, np.ndarray]:
        """Key of the position before each, and which of these are induced."""
        before = self.key(positions - 1)  # position 0 reads the end symbol and is taken out
        return before, np.where(strict, before > keys, before >= keys) & (positions > 0)

    def _induced(self, positions: np.ndarray, prefixes: np.ndarray, before: np.ndarray, go: np.ndarray, running: _Running | None) -> Columns:
        """Tuples (key, position, prefix), sorted by key, that a scanned block gives."""
        source = np.flatnonzero(go)
        order = np.argsort(before[source], kind="stable")
        source = source[order]
        key = before[source]
        first = np.append(True, key[1:] != key[:-1])[: len(key)]
        value = np.zeros(len(key), np.uint8)
        follows = np.flatnonzero(~first)
        value[follows] = _least(prefixes, source[follows - 1] + 1, source[follows])
        if running is not None:
            heads = np.flatnonzero(first)
            value[heads] = np.minimum(np.minimum.accumulate(prefixes)[source[heads]], running.of(key[heads]))
            least = np.append(np.minimum.accumulate(prefixes[::-1])[::-1], np.uint8(_SAME))
            tails = np.append(heads[1:], len(key)) - 1 if len(heads) else heads
            running.pass_by(int(least[0]), key[heads], least[source[tails] + 1])
        return key, positions[source] - 1, value + (value < CAP)

    def _run(self, position: int) -> int:
        """How often the symbol at a position follows itself, itself included, up to CAP."""
        part = self.t[position : position + CAP]
        other = np.flatnonzero(part != part[0])
        return int(other[0]) if len(other) else len(part)

    def _bucket(self, key: int, more, back, seeds) -> Iterator[Columns]:
        """Scan one symbol: its tuples, which may add to themselves (more gives, back adds), then its seeds (by ``seeds``)."""
        running, last = _Running(), None
        while (block := more()) is not None:
            positions, prefixes = block
            if last is None:
                prefixes = np.concatenate([np.zeros(1, np.uint8), prefixes[1:]])
            last = int(positions[-1])
            before, go = self._before(key, positions, False)
            made = self._induced(positions, prefixes, before, go, running)
            own = int(np.searchsorted(made[0], key, side="right"))  # no induced key is lower
            back(tuple(c[:own] for c in made))
            self.queue.put(tuple(c[own:] for c in made))
            yield positions, prefixes, np.zeros(len(positions), bool), before < key
        start = True
        while (block := seeds()) is not None:
            positions, prefixes = block
            if start:
                seam = 0 if last is None else min(self._run(last), self._run(int(positions[0])))
                prefixes = np.concatenate([np.array([seam], np.uint8), prefixes[1:]])
            start = False
            before, go = self._before(key, positions, True)
            self.queue.put(self._induced(positions, prefixes, before, go, running))
            yield positions, prefixes, np.ones(len(positions), bool), before < key

    def __call__(self, rows: Rows) -> Iterator[Columns]:
        """Blocks (positions, prefixes, from a seed, position before has a lower key) in the order of the scan; rows: the seeds, last first."""
        seeds = _Seeds(rows, self.key)
        for lane, (low, end) in enumerate(zip(self.edges.tolist(), self.ends.tolist(), strict=True)):
            self.queue.flush()
            if end - low == 1:
                more = lambda lane=lane: (block := self.queue.take(lane, _BLOCK)) and block[1:]
                seed = lambda end=end: (block := seeds.below(end, _BLOCK)) and block[1:]
                yield from self._bucket(low, more, lambda made, lane=lane: self.queue.back(lane, made), seed)
            else:
                yield from self._lane(lane, end, seeds)
        if self.queue.file:
            self.queue.file.close()

    def _lane(self, lane: int, end: int, seeds: _Seeds) -> Iterator[Columns]:
        """Scan a lane of several symbols at once."""
        none = (np.zeros(0, self.t.dtype), np.zeros(0, np.int32), np.zeros(0, np.uint8))
        parts, own = [], []
        while (block := self.queue.take(lane, _NEVER)) is not None:
            parts.append(block)
        while (block := seeds.below(end, _BLOCK)) is not None:
            own.append(block)
        if not parts and not own:
            return
        n = sum(len(c[0]) for c in parts)
        keys, positions, prefixes = (np.concatenate(c) for c in zip(*(parts + own or [none]), strict=True))
        kind = np.zeros(len(keys), np.int8)
        kind[n:] = 2
        order = np.lexsort((kind, keys)) if n < len(keys) else np.argsort(keys, kind="stable")
        keys, positions, prefixes, kind = keys[order], positions[order], prefixes[order], kind[order]
        before, go = self._before(keys, positions, kind == 2)
        source, run = np.full(len(keys), -1), np.ones(len(keys), np.int64)
        waves, base = [(keys, positions, prefixes, kind, before, go, source, run)], len(keys)
        at = np.arange(base)
        while True:  # what the lane gives to itself, step by step
            keys, positions, _, _, before, go, _, run = waves[-1]
            inner = np.flatnonzero(go & (before < end))
            if not len(inner):
                break
            key, position = before[inner], positions[inner] - 1
            again, on = self._before(key, position, False)
            run = np.where(key == keys[inner], run[inner] + 1, 1)
            waves.append((key, position, np.full(len(inner), CAP, np.uint8), np.ones(len(inner), np.int8), again, on, at[inner], run))
            at = np.arange(len(inner)) + at[-1] + 1
        if len(waves) == 1:
            yield from self._scanned(keys, positions, self._starts(keys, prefixes, kind, positions, run), kind, before, go, end)
            return
        keys, positions, prefixes, kind, before, go, source, run = (np.concatenate(c) for c in zip(*waves, strict=True))
        order = self._ordered(keys, kind, source, base)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        keys, positions, prefixes, kind, before, go, source, run = (c[order] for c in (keys, positions, prefixes, kind, before, go, source, run))
        prefixes = self._starts(keys, prefixes, kind, positions, run)
        made = np.flatnonzero(kind == 1)
        origin = place[source[made]]
        follows = np.append(False, (made[1:] == made[:-1] + 1) & (keys[made[1:]] == keys[made[:-1]]))
        follows &= np.append(False, keys[origin[1:]] == keys[origin[:-1]])
        heads = made[~follows]
        prefixes[heads[prefixes[heads] == CAP]] = 1  # behind a tuple that another symbol gave
        made, last, origin = made[follows], origin[np.flatnonzero(follows) - 1], origin[follows]
        open_ = np.arange(len(made))
        while len(open_):  # prefixes rest on those of earlier tuples in the lane: lower them until all agree
            value = _least(prefixes, last[open_] + 1, origin[open_])
            value += value < CAP
            lower = made[open_[value != prefixes[made[open_]]]]
            prefixes[made[open_]] = value
            changed = np.zeros(len(prefixes) + 1, np.int64)
            changed[lower + 1] = 1
            changed = np.cumsum(changed)
            open_ = np.flatnonzero(changed[origin + 1] > changed[last + 1])
        yield from self._scanned(keys, positions, prefixes, kind, before, go, end)

    def _starts(self, keys: np.ndarray, prefixes: np.ndarray, kind: np.ndarray, positions: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Prefixes, set where a symbol begins and where its seeds begin."""
        prefixes = prefixes.copy()
        seam = np.flatnonzero((kind[1:] == 2) & (kind[:-1] < 2)) + 1
        prefixes[seam] = 1
        for k in seam[(run[seam - 1] > 1) & (keys[seam] == keys[seam - 1])].tolist():
            prefixes[k] = min(int(run[k - 1]), self._run(int(positions[k])))
        prefixes[np.append(True, keys[1:] != keys[:-1])] = 0
        return prefixes

    @staticmethod
    def _ordered(keys: np.ndarray, kind: np.ndarray, source: np.ndarray, base: int) -> np.ndarray:
        """Order of tuples, of which the first ``base`` are in order and the others follow their sources, by doubling the steps back to these."""
        own = keys[base:].astype(np.int64)
        slot = np.searchsorted(keys[:base].astype(np.int64) * 3 + kind[:base], own * 3 + 1)  # how many fixed ones lie ahead
        scale = len(keys) + 2
        full = np.concatenate([(np.arange(base) + 1) * scale, slot * scale])
        where = full[base:].copy()
        full[base:] += np.unique(own, return_inverse=True)[1] + 1
        back = np.concatenate([np.arange(base), source[base:]])
        while True:
            ahead, now = full[back[base:]], full[base:]
            order = np.lexsort((ahead, now))
            new = np.append(True, (now[order][1:] != now[order][:-1]) | (ahead[order][1:] != ahead[order][:-1]))
            nth = np.empty(len(own), np.int64)
            nth[order] = np.cumsum(new)
            done = bool((back[base:] < base).all())
            full[base:] = where + nth
            if new.all() or done:
                break
            back = back[back]
        return np.argsort(full, kind="stable")

    def _scanned(self, keys: np.ndarray, positions: np.ndarray, prefixes: np.ndarray, kind: np.ndarray, before: np.ndarray, go: np.ndarray, end: int) -> Iterator[Columns]:
        self.queue.put(self._induced(positions, prefixes, before, go & (before >= end), None))
        yield positions, prefixes, kind == 2, before < keys


def _lanes(t: np.ndarray, symbols: int) -> np.ndarray:
    """Lower bounds of ranges of symbols, and the end: rare symbols share one, up to about _LANE suffixes."""
    shift = max(0, (symbols - 1).bit_length() - 16)
    counts = np.zeros(((symbols - 1) >> shift) + 1, np.int64)
    for k in range(0, len(t), _BLOCK):
        counts += np.bincount(t[k : k + _BLOCK] >> shift, minlength=len(counts))
    edges, held = [0], 0
    for k, n in enumerate(counts.tolist()):
        if held and held + n > _LANE:
            edges.append(k << shift)
            held = 0
        held += n
    return np.array([*edges, symbols], np.int64)


def _first_seeds(t: np.ndarray, lanes: np.ndarray, budget: Budget) -> Rows:
    """All seeds by first symbol and, where equal, by how often it follows itself; the highest first. Seeds alike in both count as the same."""
    found = Queue(lanes[:-1], budget)
    rising, run = True, 1  # of the position behind the block; the end symbol is S
    for low in range((len(t) - 1) // _BLOCK * _BLOCK, -1, -_BLOCK):
        high = min(low + _BLOCK, len(t) - 1)
        part = t[max(low - 1, 0) : high + 1].astype(np.int64)
        step = np.sign(np.diff(part))
        other = np.where(step != 0, np.arange(len(step)), len(step))
        other = np.minimum.accumulate(other[::-1])[::-1]
        up = np.append(step, 1 if rising else -1)[other] > 0
        runs = np.minimum(other - np.arange(len(step)) + np.where(other == len(step), run, 1), 255)
        inner = 1 if low else 0
        at = np.arange(inner, len(step))
        mine = at[(at > 0) & up[at] & (part[at - 1] > part[at])] if len(at) else at
        order = np.argsort(part[mine], kind="stable")
        mine = mine[order]
        found.put((part[mine].astype(t.dtype), (mine + low - inner).astype(np.int32), runs[mine].astype(np.uint8)))
        if len(step) > inner:
            rising, run = bool(up[inner]), int(runs[inner])
    rows, last = Rows(budget), None
    found.flush()
    for lane in range(len(lanes) - 2, -1, -1):
        block = found.take(lane, _NEVER)
        if block is None:
            continue
        key = block[0].astype(np.int64) * 256 + 255 - block[2]
        order = np.argsort(key, kind="stable")[::-1]
        key, positions = key[order], block[1][order]
        ahead = np.append(key[0] if last is None else last, key[:-1])
        shared = np.minimum(np.minimum(255 - key % 256, 255 - ahead % 256), CAP)
        prefixes = np.where(key == ahead, _SAME, np.where(key // 256 == ahead // 256, shared, 0)).astype(np.uint8)
        if last is None:
            prefixes[0] = 0
        last = key[-1]
        rows.append(positions, prefixes)
    rows.append(np.array([len(t) - 1], np.int32), np.zeros(1, np.uint8))  # the end symbol
    return rows


def _two_scans(t: np.ndarray, lanes: np.ndarray, seeds: Rows, budget: Budget) -> Iterator[Columns]:
    """All suffixes but that of the end symbol, highest first, as blocks (positions, prefixes, is a seed)."""
    falling = Rows(budget)
    for positions, prefixes, seed, _ in _Scan(t, lanes, False, budget)(seeds):
        falling.append(positions[~seed], prefixes[~seed])
    for positions, prefixes, fell, behind_lower in _Scan(t, lanes, True, budget)(falling):
        yield positions, prefixes, ~fell & behind_lower & (positions > 0)


def _sorted_seeds(t: np.ndarray, lanes: np.ndarray, budget: Budget) -> Rows:
    """Seeds of t, highest first, with their common prefixes."""
    rows, least, names = Rows(budget), np.uint8(_SAME), 0
    for positions, prefixes, seed in _two_scans(t, lanes, _first_seeds(t, lanes, budget), budget):
        at = np.flatnonzero(seed)
        if not len(at):
            least = min(least, prefixes.min())
            continue
        cut = np.minimum.reduceat(prefixes[: at[-1] + 1], np.append(0, at[:-1] + 1))  # what lies between one seed and the next
        cut[0] = min(cut[0], least)
        if not rows.count:
            cut[0] = 0
        least = prefixes[at[-1] + 1 :].min() if at[-1] + 1 < len(prefixes) else np.uint8(_SAME)
        names += int((cut != _SAME).sum())
        rows.append(positions[at], cut)
    rows.append(np.array([len(t) - 1], np.int32), np.zeros(1, np.uint8))
    names += 1
    return rows if names == rows.count else _by_names(rows, len(t), names, budget)


def _by_names(rows: Rows, n: int, names: int, budget: Budget) -> Rows:
    """Order seeds, of which some are the same up to the next, by sorting the text of their names."""
    count, last = rows.count, -1
    by_place = Queue(np.arange(0, n, _BLOCK), budget)
    apart = budget.array(names, np.uint8)  # common prefix of each name with the one below it
    for positions, prefixes in rows.forwards():
        new = prefixes != _SAME
        own = names - 1 - (last + np.cumsum(new))
        heads = np.flatnonzero(new)
        above = own[heads] + 1
        apart[above[above < names]] = prefixes[heads][above < names]
        last += int(new.sum())
        order = np.argsort(positions)
        by_place.put((positions[order], own[order].astype(np.int32)))
    for _ in rows.backwards():
        pass  # gives the memory back
    by_place.flush()
    text, places, at = budget.array(count, np.int32), budget.array(count, np.int32), 0
    for lane in range(len(by_place.edges)):
        if (block := by_place.take(lane, _NEVER)) is not None:
            order = np.argsort(block[0])
            places[at : at + len(order)], text[at : at + len(order)] = block[0][order], block[1][order]
            at += len(order)
    out, between, ahead = Rows(budget), RangeMin(apart, 32), None
    for own, prefixes in suffixes(text, names, budget):
        previous = np.append(own[0] if ahead is None else ahead, own[:-1])
        k = prefixes.astype(np.int64)
        shared = np.full(len(own), CAP)
        short = np.flatnonzero(k < CAP)
        if ahead is None:
            short = short[1:]
        a, b, k = own[short], previous[short], k[short]
        x, y = text[a + k], text[b + k]
        shared[short] = np.minimum(places[a + k] - places[a] + between(np.minimum(x, y) + 1, np.maximum(x, y)).astype(np.int64), CAP)
        if ahead is None:
            shared[0] = 0
        ahead = own[-1]
        out.append(places[own], shared.astype(np.uint8))
    for array in (text, places, apart):
        budget.free(array)
    return out


def suffixes(t: np.ndarray, symbols: int, budget: Budget) -> Iterator[Columns]:
    """Blocks (positions, prefixes) of all suffixes of t, highest first; prefixes are common with the suffix before (0 for the first).

    t holds numbers below ``symbols`` and ends with a 0, its only one.
    """
    lanes = _lanes(t, symbols)
    for positions, prefixes, _ in _two_scans(t, lanes, _sorted_seeds(t, lanes, budget), budget):
        yield positions, prefixes
    yield np.array([len(t) - 1], np.int32), np.zeros(1, np.uint8)
