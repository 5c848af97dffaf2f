"""External induced suffix sorting with common-prefix values.

``suffix_blocks`` sorts the suffixes of an integer text and gives, with each, the length of its common prefix with the one
before it, up to a limit.  It is recursive induced sorting.  Its working set does not grow with the text: it is at most four times ``memory`` (tuples and lists in memory, and the block
at hand) and ``SYMBOL_BYTES`` for each symbol, of which a reduced text has 2,048 at most.  The text itself is the caller's, and arrays with random access are mapped from files:

* Suffix tuples (position, common prefix) wait in a priority queue, ordered by first symbol and then by arrival; it is made of sorted runs,
  which are merged as they grow.  It is emptied in rising order for L-type and in falling order for S-type suffixes, block by block, and
  every suffix taken out sends its predecessor into the queue.
* Runs and lists live in a ``Store``: beyond its bound the largest go to its file, from which they are read in blocks.
  Arrays that need random access (types, places and names of LMS suffixes) are mapped from files where they are large.
* LMS substrings are sorted by one induction and named by comparing neighbours symbol by symbol.  The reduced text of names is written as
  digits, so that its alphabet stays small, and sorted by the same function; where the names fit into ``memory``, they are
  sorted there by rank doubling instead, which ends the recursion.
* The final induction carries common prefixes: a predecessor's is one more than the least value since the last suffix
  sent to the same symbol, found by a range minimum over the block and a running minimum for each symbol.

A block's suffixes are handled as whole arrays, so there is no Python loop over suffixes.  The file has no name once it is open, so
nothing stays behind if the process dies; a task that is run again starts afresh.
"""

from __future__ import annotations

import os
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np

from groundspark.llm.common import gather, ramp

#: Bytes that queues and lists may hold before they go to disk.
MEMORY = 96 << 20
#: Bytes a name that rank doubling takes.
NAME_BYTES = 72
#: Bytes that lists, queues and their ranges take for each symbol of an alphabet, beside what is counted.
SYMBOL_BYTES = 1024
#: Bytes of an array's object, which count too where arrays are small.
ARRAY_BYTES = 128


class Store:
    """Columns with a common bound on the memory that they hold."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.held, self.spills = memory, 0, 0
        self.columns: set[Column] = set()
        self.file, self.end = None, 0

    @property
    def block(self) -> int:
        """Elements that are handled at a time."""
        return max(16, self.memory // 256)

    def charge(self, size: int) -> None:
        self.held += size
        if self.held > self.memory:
            for column in sorted(self.columns, key=lambda c: c.size, reverse=True):
                if self.held <= self.memory // 2:
                    break
                column.spill()

    def write(self, values: np.ndarray) -> int:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="suffix-")
        self.file.seek(self.end)
        self.file.write(memoryview(values).cast("B"))
        at, self.end = self.end, self.end + values.nbytes
        return at

    def read(self, at: int, dtype: np.dtype, count: int) -> np.ndarray:
        self.file.flush()
        return np.frombuffer(os.pread(self.file.fileno(), count * dtype.itemsize, at), dtype)

    def array(self, n: int, dtype) -> np.ndarray:
        """Zeros with random access, mapped from a file if they are many."""
        if n * np.dtype(dtype).itemsize <= self.memory // 8:
            return np.zeros(n, dtype)
        self.spills += 1
        with tempfile.TemporaryFile(prefix="suffix-") as file:
            file.truncate(n * np.dtype(dtype).itemsize)
            return np.asarray(np.memmap(file, dtype, "r+", shape=(n,)))

    def close(self) -> None:
        self.columns.clear()
        if self.file is not None:
            self.file.close()
            self.file = None


class Column:
    """An append-only list of numbers: parts in the store's file, in order, and a growing array in memory for the rest.

    ``FAN`` parts of a level become one of the next, so a column has few parts, however often it spills; the file keeps the space of the old ones.
    """

    FAN = 8
    __slots__ = ("store", "dtype", "places", "counts", "levels", "held", "used", "size", "count", "__weakref__")

    def __init__(self, store: Store, dtype):
        self.store, self.dtype = store, np.dtype(dtype)
        self.places, self.counts, self.levels = array("q"), array("q"), bytearray()
        self.held: np.ndarray | None = None
        self.used = self.size = self.count = 0

    def append(self, values: np.ndarray) -> None:
        n = len(values)
        if not n:
            return
        room = 0 if self.held is None else len(self.held)
        if self.used + n > room:
            grown = np.empty(max(self.used + n, min(2 * room, room + self.store.block)), dtype=self.dtype)
            if self.used:
                grown[: self.used] = self.held[: self.used]
            self.held = grown
        self.held[self.used : self.used + n] = values
        self.used += n
        self.count += n
        more = ARRAY_BYTES + self.held.nbytes - self.size
        self.size += more
        self.store.columns.add(self)
        self.store.charge(more)

    def spill(self) -> None:
        if self.used:
            self._written(self.held[: self.used], 0)
            self.store.spills += 1
        self.held, self.used = None, 0
        self.store.held -= self.size
        self.size = 0

    def _written(self, values: np.ndarray, level: int) -> None:
        self.places.append(self.store.write(values))
        self.counts.append(len(values))
        self.levels.append(level)
        while len(self.levels) >= self.FAN and self.levels[-self.FAN] == self.levels[-1]:
            some = list(zip(self.places[-self.FAN :], self.counts[-self.FAN :]))
            level = self.levels[-1] + 1
            del self.places[-self.FAN :], self.counts[-self.FAN :], self.levels[-self.FAN :]
            begin = self.store.end
            for at, count in some:
                for k in range(0, count, self.store.block):
                    self.store.write(self.store.read(at + k * self.dtype.itemsize, self.dtype, min(self.store.block, count - k)))
            self.places.append(begin)
            self.counts.append(sum(count for _, count in some))
            self.levels.append(level)

    def slice(self, a: int, b: int) -> np.ndarray:
        out, begin = [], 0
        for at, count in zip(self.places, self.counts):
            if a < min(b, begin + count):
                to = min(b, begin + count)
                out.append(self.store.read(at + (a - begin) * self.dtype.itemsize, self.dtype, to - a))
                a = to
            begin += count
            if a >= b:
                break
        if a < b:
            out.append(self.held[a - begin : b - begin].copy())
        return out[0] if len(out) == 1 else np.concatenate(out)

    def blocks(self, most: int, reverse: bool = False) -> Iterator[np.ndarray]:
        """The numbers in order, ``most`` at a time."""
        for at in range(0, self.count, most):
            to = min(self.count, at + most)
            yield self.slice(self.count - to, self.count - at)[::-1] if reverse else self.slice(at, to)

    def forget(self) -> None:
        """No longer counted; a reader that has begun may go on."""
        self.store.held -= self.size
        self.store.columns.discard(self)
        self.size = 0

    def clear(self) -> None:
        self.forget()
        self.places, self.counts, self.levels = array("q"), array("q"), bytearray()
        self.held, self.used, self.count = None, 0, 0


class Tuples:
    """Suffix tuples: positions and common prefixes."""

    __slots__ = ("positions", "prefixes")

    def __init__(self, store: Store, place, kind):
        self.positions, self.prefixes = Column(store, place), Column(store, kind)

    def append(self, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.positions.append(positions)
        self.prefixes.append(prefixes)

    def blocks(self, most: int, reverse: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return zip(self.positions.blocks(most, reverse), self.prefixes.blocks(most, reverse))

    def shifted(self, most: int, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks from the end, each prefix moved on to the next suffix: the prefix with the one before in the other direction."""
        for positions, prefixes in self.blocks(most, reverse=True):
            moved = np.concatenate([np.array([first], dtype=prefixes.dtype), prefixes[:-1]])
            first = int(prefixes[-1])
            yield positions, moved

    def forget(self) -> None:
        self.positions.forget()
        self.prefixes.forget()

    def clear(self) -> None:
        self.positions.clear()
        self.prefixes.clear()

    @property
    def count(self) -> int:
        return self.positions.count


class Run:
    """Suffix tuples sorted by first symbol: ``bounds`` of the range of each of ``symbols``, and which of these are not taken yet."""

    __slots__ = ("level", "tuples", "symbols", "bounds", "live", "left")

    def __init__(self, level: int, tuples: Tuples, symbols: np.ndarray, bounds: np.ndarray):
        self.level, self.tuples, self.symbols, self.bounds = level, tuples, symbols.astype(np.int32), bounds.astype(np.int64)
        self.live, self.left = np.ones(len(symbols), dtype=bool), len(symbols)

    def at(self, symbol: int) -> int:
        """The symbol's place, or -1."""
        k = int(np.searchsorted(self.symbols, symbol))
        return k if k < len(self.symbols) and self.symbols[k] == symbol and self.live[k] else -1

    def range(self, k: int) -> tuple[Run, int, int]:
        return self, int(self.bounds[k]), int(self.bounds[k + 1])


class Taken:
    """A queue's tuples, in the order of arrival."""

    def __init__(self, ranges: list[tuple[Run, int, int]]):
        self.ranges = ranges

    def blocks(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, n = [], 0
        for run, a, b in self.ranges:
            while a < b:
                to = min(b, a + most - n)
                held.append((run.tuples.positions.slice(a, to), run.tuples.prefixes.slice(a, to)))
                n, a = n + to - a, to
                if n == most:
                    yield _joined(held)
                    held, n = [], 0
        if held:
            yield _joined(held)


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return parts[0] if len(parts) == 1 else (np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts]))


class Queues:
    """The priority queue: suffix tuples by first symbol and, within it, arrival, as sorted runs; ``FAN`` runs of a level are merged into one."""

    FAN = 16

    def __init__(self, store: Store, place, kind):
        self.store, self.place, self.kind = store, place, kind
        self.runs: list[Run] = []

    def push(self, symbols: np.ndarray, bounds: np.ndarray, positions: np.ndarray, prefixes: np.ndarray) -> None:
        """Tuples sorted by symbol (``bounds``: of the symbols' ranges)."""
        tuples = Tuples(self.store, self.place, self.kind)
        tuples.append(positions, prefixes)
        self.runs.append(Run(0, tuples, symbols, bounds))
        while len(self.runs) >= self.FAN and self.runs[-self.FAN].level == self.runs[-1].level:
            self._merge()

    def _merge(self) -> None:
        some = self.runs[-self.FAN :]
        del self.runs[-self.FAN :]
        merged, level = Tuples(self.store, self.place, self.kind), some[0].level + 1
        total = sum(int(np.diff(run.bounds)[run.live].sum()) for run in some)
        if total and total <= self.store.block:
            found = []
            for run in some:
                sizes = np.diff(run.bounds)[run.live]
                index = np.repeat(run.bounds[:-1][run.live], sizes) + ramp(sizes)
                found.append((np.repeat(run.symbols[run.live], sizes), run.tuples.positions.slice(0, run.tuples.count)[index], run.tuples.prefixes.slice(0, run.tuples.count)[index]))
            symbol, positions, prefixes = (np.concatenate(c) for c in zip(*found))
            order = np.argsort(symbol, kind="stable")
            symbol = symbol[order]
            first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
            merged.append(positions[order], prefixes[order])
            self.runs.append(Run(level, merged, symbol[first], np.append(first, total)))
        elif total:
            symbols, bounds = np.unique(np.concatenate([run.symbols[run.live] for run in some])), [0]
            for s in symbols.tolist():
                for positions, prefixes in Taken([run.range(k) for run in some if (k := run.at(s)) >= 0]).blocks(self.store.block):
                    merged.append(positions, prefixes)
                bounds.append(merged.count)
            self.runs.append(Run(level, merged, symbols, np.array(bounds)))
        for run in some:
            run.tuples.forget()

    def take(self, symbol: int) -> Taken | None:
        """A queue; it is empty afterwards."""
        found = []
        for run in self.runs:
            k = run.at(symbol)
            if k >= 0:
                run.live[k] = False
                run.left -= 1
                found.append(run.range(k))
        return Taken(found) if found else None

    def tidy(self) -> None:
        """Free runs that are all taken."""
        for run in self.runs:
            if not run.left:
                run.tuples.forget()
        self.runs = [run for run in self.runs if run.left]


class RangeMinimum:
    """Minima of ranges (both ends included) no longer than ``longest``."""

    def __init__(self, values: np.ndarray, longest: int):
        self.levels = [values]
        width = 1
        while 2 * width <= min(longest, len(values)):
            top = self.levels[-1]
            self.levels.append(np.minimum(top[:-width], top[width:]))
            width *= 2

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        span = high - low + 1
        level = np.frexp(span)[1] - 1
        out = np.empty(len(low), dtype=self.levels[0].dtype)
        for j in np.unique(level).tolist() if len(level) else []:
            at = np.flatnonzero(level == j)
            row = self.levels[j]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << j) + 1])
        return out


class _Sender:
    """Sends predecessors to queues; with ``prefixes`` it also works out their common prefixes."""

    def __init__(self, text: np.ndarray, symbols: int, limit: int, store: Store, prefixes: bool, place, kind):
        self.text, self.symbols, self.limit, self.wanted, self.kind = text, symbols, limit, prefixes, kind
        self.queues = Queues(store, place, kind)
        self.least = np.full(symbols, limit, dtype=np.int64)  # since the last suffix sent to a queue
        self.begun = np.zeros(symbols, dtype=bool)

    def send(self, chosen: np.ndarray, positions: np.ndarray, prefixes: np.ndarray) -> None:
        """``positions`` and ``prefixes`` are a block in order; the predecessors of those at ``chosen`` go out."""
        before = positions[chosen] - 1
        symbol = self.text[before]
        order = np.argsort(symbol, kind="stable")
        sorted_symbol, before = symbol[order], before[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_symbol[1:] != sorted_symbol[:-1]])) if len(before) else np.zeros(0, dtype=np.int64)
        ends = np.append(first[1:], len(before))
        found = self._prefixes(chosen[order], sorted_symbol, first, ends, prefixes) if self.wanted else np.zeros(len(before), dtype=self.kind)
        if len(before):
            self.queues.push(sorted_symbol[first], np.append(first, len(before)), before, found)

    def _prefixes(self, k: np.ndarray, symbol: np.ndarray, first: np.ndarray, ends: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
        n, limit = len(prefixes), self.limit
        if not len(k):
            self.least = np.minimum(self.least, int(prefixes.min()))
            return np.zeros(0, dtype=self.kind)
        low = np.empty(len(k), dtype=np.int64)
        low[1:] = k[:-1] + 1
        low[first] = 0
        minimum = RangeMinimum(prefixes, int(max((k - low).max(), n - k[ends - 1].min())) + 1)
        found = minimum(low, k).astype(np.int64)
        heads = symbol[first]
        found[first] = np.minimum(found[first], self.least[heads])
        found = np.minimum(found + 1, limit)
        found[first[~self.begun[heads]]] = 0
        self.begun[heads] = True
        self.least = np.minimum(self.least, int(prefixes.min()))
        last = k[ends - 1]
        inner = last + 1 < n
        self.least[heads] = limit
        self.least[heads[inner]] = minimum(last[inner] + 1, np.full(int(inner.sum()), n - 1))
        return found.astype(self.kind)


class _Level:
    """One text of the recursion."""

    def __init__(self, text: np.ndarray, limit: int, store: Store):
        self.text, self.limit, self.store, self.block = text, limit, store, store.block
        self.n, self.symbols = len(text), 1 + max(int(text[a : a + self.block].max()) for a in range(0, len(text), self.block))
        self.place = np.int32 if self.n < 2**31 else np.int64
        self.kind = np.uint8 if limit < 255 else np.uint16
        self.is_l = self._types()
        self.lms = self._lms()

    def _types(self) -> np.ndarray:
        """Is a suffix larger than the next one?  From the end, a block at a time."""
        is_l = self.store.array(self.n, bool)
        for b in range(self.n - 1, 0, -self.block):
            a = max(0, b - self.block)
            part = self.text[a : b + 1]
            change = np.flatnonzero(part[1:] != part[:-1])
            known = int(change[-1]) + 1 if len(change) else 0
            is_l[a : a + known] = np.repeat(part[change] > part[change + 1], np.diff(np.concatenate([[-1], change])))
            is_l[a + known : b] = is_l[b]
        return is_l

    def _lms(self) -> np.ndarray:
        """Places of S-type suffixes after an L-type one, rising."""
        found = Column(self.store, self.place)
        for a in range(1, self.n, self.block):
            part = self.is_l[a - 1 : a + self.block]
            found.append(np.flatnonzero(part[:-1] & ~part[1:]) + a)
        out, at = self.store.array(found.count, self.place), 0
        for part in found.blocks(self.block):
            out[at : at + len(part)] = part
            at += len(part)
        found.clear()
        return out

    def run_at(self, position: int) -> int:
        """Symbols like the one here, from here on, up to the limit."""
        part = self.text[position : position + self.limit]
        other = np.flatnonzero(part != part[0])
        return int(other[0]) if len(other) else len(part)

    def seeds(self) -> dict[int, Tuples]:
        return {}

    def add_seeds(self, seeds: dict[int, Tuples], positions: np.ndarray, prefixes: np.ndarray) -> None:
        """Add suffixes, those with one first symbol side by side, to that symbol's seeds."""
        symbol = self.text[positions]
        first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        for a, b, s in zip(first.tolist(), [*first[1:].tolist(), len(symbol)], symbol[first].tolist()):
            if s not in seeds:
                seeds[s] = Tuples(self.store, self.place, self.kind)
            seeds[s].append(positions[a:b], prefixes[a:b])

    def induce(self, seeds: dict[int, Tuples], prefixes_too: bool) -> tuple[dict[int, Tuples], dict[int, Tuples], np.ndarray, Column]:
        """For each symbol L-type suffixes rising and S-type falling, the common prefix at the seam between the two, and all LMS places falling.

        Without ``prefixes_too`` only the last of these is kept.
        """
        is_l, cap, store = self.is_l, self.limit, self.store
        sender = _Sender(self.text, self.symbols, cap, store, prefixes_too, self.place, self.kind)
        rising: dict[int, Tuples] = {}
        for c in range(self.symbols):
            depth = 0
            while (queue := sender.queues.take(c)) is not None:
                begin = depth > 0
                for positions, prefixes in queue.blocks(self.block):
                    if begin:
                        prefixes = prefixes.copy()
                        prefixes[0] = min(depth, cap)
                        begin = False
                    rising.setdefault(c, Tuples(store, self.place, self.kind)).append(positions, prefixes)
                    sender.send(np.flatnonzero((positions > 0) & is_l[positions - 1]), positions, prefixes)
                depth += 1
            sender.queues.tidy()
            if (own := seeds.pop(c, None)) is not None:
                begin = True
                for positions, prefixes in own.blocks(self.block):
                    if begin:
                        prefixes = prefixes.copy()
                        prefixes[0] = min(depth, self.run_at(int(positions[0])), cap)
                        begin = False
                    sender.send(np.flatnonzero((positions > 0) & is_l[positions - 1]), positions, prefixes)
                own.clear()
        sender = _Sender(self.text, self.symbols, cap, store, prefixes_too, self.place, self.kind)
        falling: dict[int, Tuples] = {}
        seam, places = np.zeros(self.symbols, dtype=self.kind), Column(store, self.place)
        for c in range(self.symbols - 1, -1, -1):
            depth = 0
            while (queue := sender.queues.take(c)) is not None:
                begin = depth > 0
                for positions, prefixes in queue.blocks(self.block):
                    if begin:
                        prefixes = prefixes.copy()
                        prefixes[0] = min(depth, cap)
                        begin = False
                    after_l = is_l[positions - 1] & (positions > 0)
                    if prefixes_too:
                        falling.setdefault(c, Tuples(store, self.place, self.kind)).append(positions, prefixes)
                    else:
                        places.append(positions[after_l])
                    sender.send(np.flatnonzero((positions > 0) & ~after_l), positions, prefixes)
                depth += 1
            sender.queues.tidy()
            if c in rising:
                largest = int(next(rising[c].positions.blocks(1, reverse=True))[0])
                seam[c] = min(depth, self.run_at(largest), cap)
                for positions, prefixes in rising[c].shifted(self.block, int(seam[c])):
                    sender.send(np.flatnonzero((positions > 0) & ~is_l[positions - 1]), positions, prefixes)
                if not prefixes_too:
                    rising.pop(c).clear()
        last = np.array([self.n - 1], dtype=self.place)
        places.append(last)
        falling.setdefault(int(self.text[self.n - 1]), Tuples(store, self.place, self.kind)).append(last, np.zeros(1, dtype=self.kind))
        return rising, falling, seam, places

    def named(self, places: Column) -> tuple[np.ndarray, int]:
        """(names of LMS substrings by place, number of names), from all LMS places in falling order of their substrings.

        Substrings that agree in more symbols than the limit have one name.
        """
        m, text = len(self.lms), self.text
        names, rank, before = self.store.array(m, np.int64), -1, None
        number = self.store.array(self.n, self.place)  # of an LMS place
        for a in range(0, m, self.block):
            number[self.lms[a : a + self.block]] = np.arange(a, min(m, a + self.block))
        for positions in places.blocks(self.block, reverse=True):
            index = number[positions]
            sizes = np.minimum(self.lms[np.minimum(index + 1, m - 1)] - positions, self.limit).astype(np.int64) + 1
            own = (positions, sizes)
            if before is not None:
                positions, sizes = np.concatenate([before[0], positions]), np.concatenate([before[1], sizes])
            new = sizes[1:] != sizes[:-1]
            same = np.flatnonzero(~new)
            ends = np.cumsum(sizes[same])
            cuts = np.searchsorted(ends, np.arange(self.block, int(ends[-1]) if len(ends) else 0, self.block)) + 1
            for part in np.split(same, np.unique(cuts)):
                if len(part):
                    other = gather(text, positions[part], sizes[part]) != gather(text, positions[part + 1], sizes[part])
                    new[part] = np.logical_or.reduceat(other, np.cumsum(sizes[part]) - sizes[part])
            if before is None:
                new = np.concatenate([[True], new])
            names[index] = rank + np.cumsum(new)
            rank += int(new.sum())
            before = (own[0][-1:], own[1][-1:])
        return names, rank + 1

    def reduced_order(self, names: np.ndarray, n_names: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (indices of LMS suffixes in order, names that each has in common with the one before)."""
        m, steps = len(names), self.limit // 2 + 1  # names lie two symbols apart at least
        if n_names == m:
            order = self.store.array(m, np.int64)
            for a in range(0, m, self.block):
                part = names[a : a + self.block]
                order[part] = np.arange(a, a + len(part))
            for a in range(0, m, self.block):
                part = order[a : a + self.block]
                yield part, np.zeros(len(part), dtype=np.int64)
            return
        bits = max(1, (n_names - 1).bit_length())
        digits = 1 if bits <= 11 else 2
        width = -(-bits // digits)
        if m * NAME_BYTES <= self.store.memory or m * digits > 0.9 * self.n:
            order, common = doubled(np.array(names), steps)
            for a in range(0, m, self.block):
                yield order[a : a + self.block], common[a : a + self.block]
            return
        text = self.store.array(m * digits + 1, np.uint16)
        for a in range(0, m, self.block):
            part = names[a : a + self.block]
            for d in range(digits):
                text[a * digits + d : (a + len(part)) * digits : digits] = (part >> (width * (digits - 1 - d)) & ((1 << width) - 1)) + 1
        inner = digits * steps
        carry = inner
        for positions, prefixes in suffix_blocks(text, inner, self.store):
            at = np.flatnonzero((positions % digits == 0) & (positions < m * digits))
            if not len(at):
                carry = min(carry, int(prefixes.min()))
                continue
            low = np.minimum.reduceat(prefixes[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1])).astype(np.int64)
            low[0] = min(int(low[0]), carry)
            rest = prefixes[at[-1] + 1 :]
            carry = int(rest.min()) if len(rest) else inner
            yield positions[at].astype(np.int64) // digits, low // digits

    def ordered_seeds(self, names: np.ndarray, n_names: int) -> dict[int, Tuples]:
        """LMS suffixes in order with their common prefixes, by first symbol."""
        m, text, lms, seeds, before = len(self.lms), self.text, self.lms, self.seeds(), None
        for index, known in self.reduced_order(names, n_names):
            other = np.concatenate([index[:1] if before is None else before, index[:-1]])
            x, y = np.minimum(index + known, m - 1), np.minimum(other + known, m - 1)
            common = (lms[x] - lms[index]).astype(np.int64)
            p, q, begin = lms[x].astype(np.int64), lms[y].astype(np.int64), common.copy()
            if before is None:
                common[0] = self.limit
            k = np.flatnonzero(common < self.limit)
            while len(k):
                more = common[k] - begin[k]
                k = k[text[p[k] + more] == text[q[k] + more]]
                common[k] += 1
                k = k[common[k] < self.limit]
            if before is None:
                common[0] = 0
            self.add_seeds(seeds, lms[index], np.minimum(common, self.limit))
            before = index[-1:]
        return seeds

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        seeds = self.seeds()
        for a in range(0, len(self.lms), self.block):
            part = self.lms[a : a + self.block]
            part = part[np.argsort(self.text[part], kind="stable")]
            self.add_seeds(seeds, part, np.zeros(len(part), dtype=self.kind))
        _, _, _, places = self.induce(seeds, prefixes_too=False)
        names, n_names = self.named(places)
        places.clear()
        rising, falling, seam, _ = self.induce(self.ordered_seeds(names, n_names), prefixes_too=True)
        for c in range(self.symbols):
            up, down = rising.pop(c, None), falling.pop(c, None)
            if up is not None:
                begin = True
                for positions, prefixes in up.blocks(self.block):
                    if begin:
                        prefixes = prefixes.copy()
                        prefixes[0], begin = 0, False
                    yield positions, prefixes
                up.clear()
            if down is not None:
                yield from down.shifted(self.block, int(seam[c]) if up is not None else 0)
                down.clear()


def doubled(names: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes of a text of names, names that each has in common with the one before), right up to ``steps`` names."""
    m = len(names)
    ranks, width = [names], 1
    while ranks[-1].max() < m - 1 and width < steps:
        now = ranks[-1]
        behind = np.zeros(m, dtype=np.int64)
        behind[: max(0, m - width)] = now[width:] + 1
        key = now * (m + 1) + behind
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(m, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], sorted_key[1:] != sorted_key[:-1]]))
        ranks.append(rank)
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    common = np.zeros(m, dtype=np.int64)
    x, y = order[1:].copy(), order[:-1].copy()
    for j in range(len(ranks) - 1, -1, -1):
        k = np.flatnonzero((x < m) & (y < m))
        k = k[ranks[j][x[k]] == ranks[j][y[k]]]
        x[k] += 1 << j
        y[k] += 1 << j
        common[1:][k] += 1 << j
    return order, common


def suffix_blocks(text: np.ndarray, limit: int, store: Store) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (suffixes in order, common prefix with the suffix before, at most ``limit``) of an integer text.

    The text's last symbol must be 0 and stand nowhere else.  Suffixes that agree in ``limit`` symbols or more come in any order
    among themselves.
    """
    if len(text) == 1:
        yield np.zeros(1, dtype=np.int32), np.zeros(1, dtype=np.uint8)
        return
    yield from _Level(text, limit, store).blocks()


def sort_suffixes(text: np.ndarray, limit: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """``suffix_blocks`` as two whole arrays."""
    store = Store(memory)
    try:
        suffixes, common = zip(*suffix_blocks(text, limit, store))
        return np.concatenate(suffixes), np.concatenate(common)
    finally:
        store.close()
