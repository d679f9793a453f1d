"""External induced suffix sorting with common-prefix values.

Suffixes that start a local minimum (S*) are sorted first; every other suffix's place follows by induction, in two
passes over symbols. A pass is driven by a priority queue of tuples (symbol, arrival, position, common prefix with the
tuple before): popping gives suffixes in order, and each popped suffix pushes the one before it in the text. The queue
keeps its tuples in files once they pass a memory budget. A pushed suffix's common prefix is one more than the least of
those popped since the last push for the same symbol (range minima over the popped batch, a running minimum between).

S* suffixes are sorted in memory if they are few enough; else their substrings are named and the string of names is sorted
by the same procedure (recursion). Comparison stops at cap symbols: suffixes that agree so far count as equal.

Work goes by batches of numpy arrays; a pass handles each suffix once. The text may be a memory map.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

BATCH = 1 << 18


class SpillQueue:
    """Tuples (position, common prefix) by symbol, first in first out within a symbol; beyond budget bytes they go to a file."""

    def __init__(self, folder: str, budget: int):
        self.budget, self.held, self.heap = budget, 0, {}
        self.file = tempfile.TemporaryFile(dir=folder)
        self.spilled = 0

    def push(self, symbols: np.ndarray, positions: np.ndarray, prefixes: np.ndarray) -> None:
        """Adds tuples, sorted by symbol and then by arrival."""
        if not len(symbols):
            return
        cuts = np.flatnonzero(np.diff(symbols)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(symbols)], strict=True):
            self.heap.setdefault(int(symbols[a]), []).append((positions[a:b], prefixes[a:b]))
        self.held += positions.nbytes + prefixes.nbytes
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        for chunks in self.heap.values():
            kept = []
            for chunk in chunks:
                if isinstance(chunk[0], int):
                    kept.append(chunk)
                    continue
                at = self.file.seek(0, os.SEEK_END)
                self.file.write(np.ascontiguousarray(chunk[0]).tobytes())
                self.file.write(np.ascontiguousarray(chunk[1]).tobytes())
                kept.append((at, len(chunk[0])))
                self.spilled += 1
            chunks[:] = kept
        self.held = 0

    def _load(self, chunk) -> tuple[np.ndarray, np.ndarray]:
        if not isinstance(chunk[0], int):
            return chunk
        self.file.seek(chunk[0])
        return np.frombuffer(self.file.read(8 * chunk[1]), np.int64), np.frombuffer(self.file.read(chunk[1]), np.uint8)

    def symbols(self) -> list[int]:
        return sorted(self.heap)

    def pop(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples of a symbol in batches, those pushed meanwhile too."""
        while chunks := self.heap.get(symbol):
            some, size = [], 0
            while chunks and size < BATCH:
                chunk = chunks.pop(0)
                some.append(self._load(chunk))
                size += len(some[-1][0])
                if chunk is some[-1]:
                    self.held -= chunk[0].nbytes + chunk[1].nbytes
            if not chunks:
                del self.heap[symbol]
            yield (some[0] if len(some) == 1 else (np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some])))

    def close(self) -> None:
        self.file.close()


def range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first..last] for each pair, first <= last."""
    width = last - first + 1
    level = np.frexp(width.astype(np.float64))[1] - 1
    out, table = np.empty(len(first), values.dtype), values
    for k in range(int(level.max(initial=0)) + 1):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[first[own]], table[last[own] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def is_small(text: np.ndarray) -> np.ndarray:
    """For each position whether its suffix is smaller than the next one (type S); the last one is."""
    n = len(text)
    out = np.empty(n, bool)
    out[n - 1] = True
    for stop in range(n - 1, 0, -BATCH * 4):
        start = max(0, stop - BATCH * 4)
        a, b = text[start:stop], text[start + 1 : stop + 1]
        differs = np.where(a != b, np.arange(stop - start), stop - start)
        at = np.minimum.accumulate(differs[::-1])[::-1]
        less = np.append(a < b, out[stop])
        out[start:stop] = less[at]
    return out


def _packed(symbols: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """Each position's next symbols as one number, and how many."""
    per = max(1, 63 // bits)
    padded = np.concatenate([symbols, np.zeros(per, symbols.dtype)]).astype(np.uint64)
    out = np.zeros(len(symbols), np.uint64)
    for k in range(per):
        out = (out << np.uint64(bits)) | padded[k : k + len(symbols)]
    return out, per


def _refine(n: int, key: Callable[[np.ndarray, int], np.ndarray | None]) -> np.ndarray:
    """Ranks (places of a group's first member) of n items by key(items, round), round after round while groups are tied."""
    rank, items, step = np.zeros(n, np.int64), np.arange(n), 0
    while len(items):
        keys = key(items, step)
        if keys is None:
            break
        if step:
            order = np.lexsort((keys, rank[items]))
        else:
            order = np.argsort(keys, kind="stable")
        items, keys = items[order], keys[order]
        head = rank[items]
        new_old = np.append(True, head[1:] != head[:-1])
        new = new_old | np.append(True, keys[1:] != keys[:-1])
        at = np.arange(len(items))
        begin_old = np.maximum.accumulate(np.where(new_old, at, 0))
        begin = np.maximum.accumulate(np.where(new, at, 0))
        rank[items] = head + begin - begin_old
        alone = new & np.append(new[1:], True)
        items = items[~alone]
        step += 1
    return rank


def _common(words: np.ndarray, per: int, bits: int, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of suffixes a and b, at most cap."""
    out, live, end = np.zeros(len(a), np.int64), np.arange(len(a)), len(words) - 1
    for at in range(0, cap, per):
        x = words[np.minimum(a[live] + at, end)] ^ words[np.minimum(b[live] + at, end)]
        same = np.zeros(len(live), np.int64)
        for k in range(per):
            same += x >> np.uint64(bits * (per - 1 - k)) == 0
        out[live] += same
        live = live[same == per]
    return np.minimum(out, cap).astype(np.uint8)


def sorted_minima(text: np.ndarray, small: np.ndarray, cap: int, base: int, folder: str, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the S* suffixes in order, and the common prefix of each with the one before."""
    places = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    bits = max(1, int(text.max()).bit_length())
    words, per = _packed(text, bits)
    end = len(text) - 1
    if len(places) <= base:
        rank = _refine(len(places), lambda items, step: words[np.minimum(places[items] + step * per, end)] if step * per < cap else None)
        order = places[np.argsort(rank, kind="stable")]
    else:
        # Name the substrings from each S* to the next (by symbol, then type), then sort the string of names.
        typed, each = _packed(text.astype(np.int64) * 2 + small, bits + 1)
        length = np.append(np.diff(places) + 1, 1)

        def key(items: np.ndarray, step: int) -> np.ndarray | None:
            left = length[items] - step * each
            if not (left > 0).any():
                return None
            own = typed[np.minimum(places[items] + step * each, end)]
            hidden = np.clip(each - left, 0, each).astype(np.uint64) * np.uint64(bits + 1)
            return np.where(left > 0, own >> hidden << hidden, 0)

        names = np.unique(_refine(len(places), key), return_inverse=True)[1] + 1
        reduced = np.append(names, 0)
        order = np.empty(len(places), np.int64)
        at = len(places)
        for positions, _ in suffixes(reduced, len(reduced), base, folder, budget, prefixes=False):
            own = positions[positions < len(places)]
            order[at - len(own) : at] = places[own[::-1]]
            at -= len(own)
    prefix = np.zeros(len(order), np.uint8)
    if len(order) > 1 and cap < 256:
        prefix[1:] = _common(words, per, bits, order[:-1], order[1:], cap)
    return order, prefix


class _Pass:
    """One direction of the induction."""

    def __init__(self, text: np.ndarray, cap: int, folder: str, budget: int, prefixes: bool):
        self.text, self.cap, self.queue, self.prefixes = text, cap, SpillQueue(folder, budget), prefixes
        if prefixes:
            self.least = np.full(int(text.max()) + 1, -1, np.int16)  # of what was popped since the symbol's last push

    def scan(self, positions: np.ndarray, prefix: np.ndarray, allowed: Callable[[np.ndarray], np.ndarray]) -> None:
        """Pops go by: pushes the suffix before each, where allowed by its symbol."""
        before = positions - 1
        symbols = self.text[before]
        chosen = np.flatnonzero((positions > 0) & allowed(symbols))
        symbols = symbols[chosen]
        order = np.argsort(symbols, kind="stable")
        symbols, chosen = symbols[order], chosen[order]
        new = np.zeros(len(chosen), np.uint8)
        if self.prefixes:
            whole = int(prefix.min()) if len(prefix) else self.cap
            if len(chosen):
                head = np.append(True, symbols[1:] != symbols[:-1])
                first = np.where(head, 0, np.append(0, chosen[:-1] + 1))
                least = range_minima(prefix, first, chosen).astype(np.int16)
                own = symbols[head]
                least[head] = np.minimum(least[head], self.least[own])
                new = np.minimum(least + 1, self.cap).astype(np.uint8)
                np.minimum(self.least, whole, out=self.least)
                last = chosen[np.append(head[1:], True)]
                rest = np.full(len(own), self.cap, np.int16)
                some = last + 1 < len(prefix)
                rest[some] = range_minima(prefix, last[some] + 1, np.full(some.sum(), len(prefix) - 1))
                self.least[own] = rest
            else:
                np.minimum(self.least, whole, out=self.least)
        self.queue.push(symbols, before[chosen], new)


def _direct(text: np.ndarray, a: int, b: int, cap: int) -> int:
    x, y = text[a : a + cap], text[b : b + cap]
    n = min(len(x), len(y))
    differs = np.flatnonzero(x[:n] != y[:n])
    return int(differs[0]) if len(differs) else n


def suffixes(text: np.ndarray, cap: int, base: int, folder: str, budget: int, prefixes: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of text from the greatest to the least, in batches: positions, and the common prefix (at most cap) of each with
    the one given before it. text ends with 0, which is nowhere else; cap is below 256 if prefixes are asked for."""
    small = is_small(text)
    stars, star_prefix = sorted_minima(text, small, cap, base, folder, budget)
    del small
    star_symbols = text[stars]
    up, done = _Pass(text, cap, folder, budget, prefixes), SpillQueue(folder, budget)
    heads = np.append(True, star_symbols[1:] != star_symbols[:-1])
    begins = dict(zip(star_symbols[heads].tolist(), np.flatnonzero(heads).tolist(), strict=True))
    ends = dict(zip(star_symbols[heads].tolist(), [*np.flatnonzero(heads)[1:].tolist(), len(stars)], strict=True))
    todo = sorted(begins)
    seen = set(todo)
    heapq.heapify(todo)

    def note(queue: SpillQueue, sign: int) -> None:
        for s in queue.heap:
            if s not in seen:
                seen.add(s)
                heapq.heappush(todo, sign * s)

    while todo:
        c = heapq.heappop(todo)
        last = None
        for positions, prefix in up.queue.pop(c):
            done.push(np.full(len(positions), c), positions, prefix)
            up.scan(positions, prefix, lambda s: s >= c)  # noqa: B023
            last = positions[-1]
            note(up.queue, 1)
        if c in begins:
            a, b = begins[c], ends[c]
            prefix = star_prefix[a:b].copy()
            prefix[0] = 0 if last is None or not prefixes else _direct(text, int(last), int(stars[a]), cap)
            for at in range(a, b, BATCH):
                up.scan(stars[at : min(b, at + BATCH)], prefix[at - a : at - a + BATCH], lambda s: s > c)  # noqa: B023
            note(up.queue, 1)
    up.queue.close()
    down = _Pass(text, cap, folder, budget, prefixes)
    # From above: smaller-type suffixes of a symbol first, then its larger-type ones, backwards. The last suffix stands alone below all.
    todo = [-s for s in done.symbols()]
    seen = set(done.symbols())
    heapq.heapify(todo)
    while todo:
        c = -heapq.heappop(todo)
        last = None
        for positions, prefix in down.queue.pop(c):
            yield positions, prefix
            down.scan(positions, prefix, lambda s: s <= c)  # noqa: B023
            last = positions[-1]
            note(down.queue, -1)
        carry = 0
        for positions, prefix in _backwards(done, c):
            if last is not None and prefixes:
                carry = _direct(text, int(last), int(positions[0]), cap)
            own = np.append(np.uint8(carry), prefix[:-1])
            yield positions, own
            down.scan(positions, own, lambda s: s < c)  # noqa: B023
            carry, last = int(prefix[-1]), None
            note(down.queue, -1)
    yield np.array([len(text) - 1]), np.zeros(1, np.uint8)
    done.close()
    down.queue.close()


def _backwards(done: SpillQueue, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A symbol's tuples from the last to the first."""
    chunks = done.heap.pop(symbol, [])
    while chunks:
        some, size = [], 0
        while chunks and size < BATCH:
            positions, prefix = done._load(chunks.pop())
            some.append((positions[::-1], prefix[::-1]))
            size += len(positions)
        yield np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some])
