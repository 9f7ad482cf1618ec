"""External induced sorting of suffixes with their common prefixes, in bounded memory.

The symbols of a shard are in an array that may be a file; buckets of suffixes wait in ``Queue``, a monotone priority queue on disk: entries
are (position, common prefix with the entry before) and leave in order of symbol, then of arrival. Arrival is in suffix order, as
in induced sorting: the sorted suffixes that begin at local minima (S*) push their predecessors (L), these push theirs, and from the
other end all L push the S. A pushed suffix shares one symbol more with the one pushed before it than the suffixes that
pushed the two, whose common prefix is the least one of the stretch of the stream between them; so the values are carried along and
never taken from the text again, but for the one place in each bucket where L and S meet, and between the S*, where they come from binary
search over hash sums.

The S* order comes from the same induction over unsorted S*, which sorts the pieces between them; equal pieces get equal names, and the string of
names is sorted recursively, by induction while its alphabet is small, else, which is nearly every shard of real text, by doubling of ranks in memory.

Symbol 0 ends a segment; every 0 counts as a symbol of its own, in order of position. Common prefixes are cut at ``cap``.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Entries handled at once, entries that wait in memory, and the largest alphabet for another level of induction.
CHUNK, WAITING, ALPHABET = 1 << 16, 1 << 22, 2048
_TUPLE = np.dtype([("at", np.int64), ("lcp", np.int32)])


class Queue:
    """First-in first-out buckets that go to an unnamed file when more than ``WAITING`` entries wait."""

    def __init__(self, symbols: int):
        self.memory: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        self.disk: list[list[tuple[int, int]]] = [[] for _ in range(symbols)]
        self.waiting, self.file = 0, None

    def push(self, symbol: int, entries: np.ndarray) -> None:
        self.memory[symbol].append(entries)
        self.waiting += len(entries)
        if self.waiting > WAITING:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for symbol, parts in enumerate(self.memory):
            if parts:
                entries = np.concatenate(parts)
                self.disk[symbol].append((self.file.tell(), len(entries)))
                self.file.write(entries.tobytes())
                parts.clear()
        self.waiting = 0

    def pop(self, symbol: int, back: bool = False) -> Iterator[np.ndarray]:
        """What waits in a bucket now, by chunks in order of arrival, or by chunks from the end; it leaves the queue."""
        disk, self.disk[symbol] = self.disk[symbol], []
        memory, self.memory[symbol] = self.memory[symbol], []
        self.waiting -= sum(map(len, memory))
        whole = np.concatenate(memory) if memory else np.zeros(0, _TUPLE)
        parts = [(place + k * _TUPLE.itemsize, min(CHUNK, n - k)) for place, n in disk for k in range(0, n, CHUNK)]
        parts += [(-1 - k, min(CHUNK, len(whole) - k)) for k in range(0, len(whole), CHUNK)]
        for place, n in reversed(parts) if back else parts:
            if place < 0:
                yield whole[-1 - place : -1 - place + n]
            else:
                self.file.seek(place)
                yield np.frombuffer(self.file.read(n * _TUPLE.itemsize), _TUPLE)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Least:
    """Minima of stretches of one chunk."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[: len(last) - width], last[width:]))
            width *= 2

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of values[first..last] each, ``last`` included."""
        out = np.empty(len(first), np.int32)
        level = np.frexp(last - first + 1)[1] - 1
        for k in np.unique(level):
            own = level == k
            table = self.levels[k]
            out[own] = np.minimum(table[first[own]], table[last[own] - (1 << int(k)) + 1])
        return out


class _Pass:
    """One scan, upwards for the L or downwards for the S."""

    def __init__(self, symbols: np.ndarray, larger: np.ndarray, want_larger: bool, alphabet: int, cap: int):
        self.symbols, self.larger, self.want, self.cap = symbols, larger, want_larger, cap
        self.queue, self.done = Queue(alphabet), Queue(alphabet)
        self.since = np.full(alphabet, -1, np.int32)  # least common prefix since the last push; -1: none was pushed

    def scan(self, entries: np.ndarray) -> None:
        """Takes entries of the stream in order and pushes the predecessors of the kind wanted."""
        at, lcp = entries["at"], entries["lcp"]
        before = at - 1
        own = np.flatnonzero((before >= 0) & (self.larger[np.maximum(before, 0)] == self.want))
        whole = int(lcp.min())
        if len(own):
            symbol = self.symbols[before[own]]
            order = np.argsort(symbol, kind="stable")
            own, symbol = own[order], symbol[order]
            least = _Least(lcp)
            first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
            head = symbol[first]
            start = np.concatenate([[0], own[:-1] + 1])
            start[first] = 0
            value = least.of(start, own)
            value[first] = np.minimum(value[first], self.since[head])
            value = np.minimum(value + 1, self.cap)
            value[first[self.since[head] < 0]] = 0
            rows = np.empty(len(own), _TUPLE)
            rows["at"], rows["lcp"] = before[own], value
            stop = np.append(first[1:], len(own))
            tail = own[stop - 1]
            rest = np.full(len(head), self.cap, np.int32)
            inner = tail + 1 < len(lcp)
            rest[inner] = least.of(tail[inner] + 1, np.full(inner.sum(), len(lcp) - 1))
            known = self.since >= 0
            self.since[known] = np.minimum(self.since[known], whole)
            self.since[head] = rest
            for a, b, s in zip(first, stop, head, strict=True):
                self.queue.push(int(s), rows[a:b])
        else:
            known = self.since >= 0
            self.since[known] = np.minimum(self.since[known], whole)

    def drain(self, symbol: int) -> None:
        """Scans a bucket of the queue, with what it pushes into itself, and keeps it."""
        while True:
            empty = True
            for entries in self.queue.pop(symbol):
                empty = False
                self.scan(entries)
                self.done.push(symbol, entries)
            if empty:
                return


def _last_of(queue: Queue, symbol: int) -> int | None:
    if queue.memory[symbol]:
        return int(queue.memory[symbol][-1]["at"][-1])
    if queue.disk[symbol]:
        place, n = queue.disk[symbol][-1]
        queue.file.seek(place + (n - 1) * _TUPLE.itemsize)
        return int(np.frombuffer(queue.file.read(_TUPLE.itemsize), _TUPLE)["at"][0])
    return None


def _backwards(queue: Queue, symbol: int) -> Iterator[np.ndarray]:
    """A kept bucket from its end, each entry with the common prefix to the one that leaves before it."""
    carry = 0
    for entries in queue.pop(symbol, back=True):
        back = entries[::-1].copy()
        values = back["lcp"].copy()
        back["lcp"][0] = carry
        back["lcp"][1:] = values[:-1]
        carry = int(values[-1])
        yield back


def _induce(symbols: np.ndarray, larger: np.ndarray, seeds: Iterator[tuple[int, np.ndarray]], alphabet: int, cap: int, meet: Callable[[int, int], int]) -> Iterator[np.ndarray]:
    """All suffixes in order from the S* in order (by bucket); each entry with the common prefix to the one before."""
    by_bucket = dict(seeds)
    up = _Pass(symbols, larger, True, alphabet, cap)
    for c in range(alphabet):
        up.drain(c)
        star = by_bucket.pop(c, None)
        if star is not None:
            last = _last_of(up.done, c)
            star = star.copy()
            star["lcp"][0] = 0 if last is None or c == 0 else meet(last, int(star["at"][0]))
            for k in range(0, len(star), CHUNK):
                up.scan(star[k : k + CHUNK])
    down = _Pass(symbols, larger, False, alphabet, cap)
    kept = Queue(alphabet)
    for c in range(alphabet - 1, 0, -1):
        down.drain(c)
        smallest = _last_of(down.done, c)
        for k, part in enumerate(_backwards(up.done, c)):
            kept.push(c, part)
            if k == 0 and smallest is not None:
                part = part.copy()
                part["lcp"][0] = meet(int(part["at"][0]), smallest)
            down.scan(part)
    ends = np.flatnonzero(symbols == 0)
    for k in range(0, len(ends), CHUNK):
        rows = np.zeros(len(ends[k : k + CHUNK]), _TUPLE)
        rows["at"] = ends[k : k + CHUNK]
        yield rows
    for c in range(1, alphabet):
        # back in upward order: first the L, then the S
        last = None
        for part in _backwards(kept, c):
            last = int(part["at"][-1])
            yield part
        first = True
        for part in _backwards(down.done, c):
            if first and last is not None:
                part["lcp"][0] = meet(last, int(part["at"][0]))
            first = False
            yield part
    for q in (up.queue, up.done, down.queue, down.done, kept):
        q.close()


def _kinds(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each suffix is larger than its next one, the S* positions)."""
    n = len(symbols)
    differs = np.flatnonzero(np.append(symbols[1:] != symbols[:-1], True))
    end = differs[np.searchsorted(differs, np.arange(n))]
    larger = np.zeros(n, bool)
    inner = end < n - 1
    larger[inner] = symbols[end[inner]] > symbols[end[inner] + 1]
    larger[symbols == 0] = False  # an end is smaller than what follows
    star = np.flatnonzero(~larger[1:] & larger[:-1]) + 1
    return larger, star


def _doubled(names: np.ndarray, steps: int) -> np.ndarray:
    """Order of the suffixes of a string of names by their first ``steps`` names; shorter ones first."""
    rank, width = names.astype(np.int64), 1
    while True:
        second = np.full(len(rank), -1, np.int64)
        second[:-width] = rank[width:]
        order = np.lexsort((second, rank))
        if width * 2 >= steps:
            return order
        a, b = rank[order], second[order]
        new = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        if new[-1] == len(rank) - 1:
            return order
        rank = np.empty(len(rank), np.int64)
        rank[order] = new
        width *= 2
        if width >= len(rank):
            return np.argsort(rank, kind="stable")


def suffixes(symbols: np.ndarray, alphabet: int, cap: int, same: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[np.ndarray]:
    """Runs of (at, lcp) of all suffixes in order. ``symbols`` ends with 0; ``same(a, b, n)`` says which stretches of n symbols at
    a and b are equal (ends included as symbols)."""
    if same is None:
        power = np.uint64(0x9E3779B97F4A7C15)
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(symbols), power)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
        inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(symbols), np.uint64(pow(int(power), -1, 1 << 64)))]))
        same = lambda a, b, n: (sums[a + n] - sums[a]) * inverse[a] == (sums[b + n] - sums[b]) * inverse[b]
    ends = np.flatnonzero(symbols == 0)
    left = lambda a: ends[np.searchsorted(ends, a)] - a  # noqa: E731  symbols up to the end of the segment

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), np.minimum(np.minimum(left(a), left(b)), cap)
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = same(a, b, middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low

    larger, star = _kinds(symbols)
    meet = lambda a, b: int(common(np.array([a]), np.array([b]))[0])

    def seeds(order: np.ndarray, lcp: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        rows = np.empty(len(order), _TUPLE)
        rows["at"], rows["lcp"] = order, lcp
        bucket = symbols[order]
        if not len(order):
            return
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
            yield int(bucket[a]), rows[a:b]

    unsorted = star[np.argsort(symbols[star], kind="stable")]
    order = star
    if len(star) > 1:
        is_star = np.zeros(len(symbols), bool)
        is_star[star] = True
        pieces = np.concatenate([p["at"][is_star[p["at"]]] for p in _induce(symbols, larger, seeds(unsorted, np.zeros(len(star), np.int32)), alphabet, 0, lambda a, b: 0)])
        index = np.searchsorted(star, pieces)
        size = np.append(np.diff(star), 1)[index]
        a, b, n = pieces[:-1], pieces[1:], size[:-1]
        # a piece that holds an end is like no other one
        equal = (n == size[1:]) & (left(a) > n) & (left(b) > n)
        equal[equal] = same(a[equal], b[equal], n[equal] + 1)
        names = np.empty(len(star), np.int64)
        names[index] = np.concatenate([[0], np.cumsum(~equal)])
        if equal.any():
            distinct = int(names.max()) + 1
            if distinct + 1 <= ALPHABET:
                inner = np.append(names + 1, 0)
                found = np.concatenate([p["at"] for p in suffixes(inner, distinct + 1, cap)])
                order = star[found[found < len(star)]]
            else:
                order = star[_doubled(names, cap)]
        else:
            order = pieces
    lcp = np.concatenate([[0], common(order[:-1], order[1:])]) if len(order) else np.zeros(0, np.int64)
    yield from _induce(symbols, larger, seeds(order, lcp), alphabet, cap, meet)
