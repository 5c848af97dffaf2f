"""Mergeable radix tries over bytes: a leaf is a term, with the number of its documents and a counter for each source.

A trie is held in the order of its traversal, which is the order of bytes and thus of code points in UTF-8: of each leaf the bytes after those that it
shares with the leaf before (``shared`` is the depth of the node where the two part).  A run of leaves is a segment, one row of a table; any segments merge, since documents and
counters are sums.  All work on leaves is in sorts and numpy sums, without a Python object for a node.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa

#: So many counters take about as much memory as a leaf.
COUNTERS = 4
#: Leaves of one segment, and leaves (by weight) from one of its marks to the next.
SEGMENT, MARK = 8192, 64
#: One segment.  ``sizes``: sources of each leaf; ``places`` (into ``names``) and ``counts`` end to end; ``sums``: occurrences of each name; ``marks``: terms at even distances (where the first stands differs from segment to segment).
SEGMENT_SCHEMA = "lang string, first binary, last binary, leaves int, shared array<int>, suffixes array<binary>, docs array<bigint>, names array<string>, sizes array<int>, places array<int>, counts array<bigint>, sums array<bigint>, marks array<binary>"
_TYPES = {
    "lang": pa.string(), "first": pa.binary(), "last": pa.binary(), "leaves": pa.int32(), "shared": pa.list_(pa.int32()), "suffixes": pa.list_(pa.binary()), "docs": pa.list_(pa.int64()), "names": pa.list_(pa.string()),
    "sizes": pa.list_(pa.int32()), "places": pa.list_(pa.int32()), "counts": pa.list_(pa.int64()), "sums": pa.list_(pa.int64()), "marks": pa.list_(pa.binary()),
}
_WIDE = 32


def shared_prefixes(terms: list[bytes]) -> np.ndarray:
    """Bytes that each of some sorted terms shares with the one before."""
    n = len(terms)
    out = np.zeros(n, dtype=np.int32)
    if n < 2:
        return out
    wide = np.array([t[:_WIDE] for t in terms], dtype=f"S{_WIDE}").view(np.uint8).reshape(n, _WIDE)
    lengths = np.fromiter(map(len, terms), np.int64, n)
    differ = np.concatenate([wide[1:] != wide[:-1], np.ones((n - 1, 1), dtype=bool)], axis=1).argmax(axis=1)
    out[1:] = np.minimum(differ, np.minimum(lengths[1:], lengths[:-1]))
    for k in np.flatnonzero(out == _WIDE).tolist():
        a, b = terms[k - 1], terms[k]
        j, end = _WIDE, min(len(a), len(b))
        while j < end and a[j] == b[j]:
            j += 1
        out[k] = j
    return out


class Trie:
    """``terms`` in byte order, ``docs`` of each, and sorted entries (``leaf``, ``place`` into ``names``, ``counts``)."""

    __slots__ = ("terms", "docs", "names", "leaf", "place", "counts")

    def __init__(self, terms: list[bytes], docs: np.ndarray, names: list[str], leaf: np.ndarray, place: np.ndarray, counts: np.ndarray):
        self.terms, self.docs, self.names, self.leaf, self.place, self.counts = terms, docs, names, leaf, place, counts

    @classmethod
    def counted(cls, docs: Mapping[bytes, int], sources: Mapping[str, Mapping[bytes, int]]) -> Trie:
        """Of the documents of each term, and the occurrences of each term in each source."""
        terms = sorted(docs)
        number = dict(zip(terms, range(len(terms))))
        names = sorted(sources)
        leaf = [np.fromiter(map(number.__getitem__, sources[s]), np.int64, len(sources[s])) for s in names]
        counts = [np.fromiter(sources[s].values(), np.int64, len(sources[s])) for s in names]
        place = np.repeat(np.arange(len(names)), [len(x) for x in leaf])
        return cls._summed(terms, np.fromiter(map(docs.__getitem__, terms), np.int64, len(terms)), names, np.concatenate([np.zeros(0, np.int64), *leaf]), place, np.concatenate([np.zeros(0, np.int64), *counts]))

    @classmethod
    def _summed(cls, terms: list[bytes], docs: np.ndarray, names: list[str], leaf: np.ndarray, place: np.ndarray, counts: np.ndarray) -> Trie:
        key = leaf * max(1, len(names)) + place
        order = np.argsort(key, kind="stable")
        key, counts = key[order], counts[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        leaf, place = np.divmod(key[starts], max(1, len(names)))
        return cls(terms, docs, names, leaf, place, np.add.reduceat(counts, starts) if len(starts) else counts)

    @classmethod
    def merged(cls, tries: list[Trie]) -> Trie:
        if len(tries) == 1:
            return tries[0]
        terms = sorted(set().union(*(t.terms for t in tries)))
        number, names = dict(zip(terms, range(len(terms)))), sorted({s for t in tries for s in t.names})
        place_of = {s: k for k, s in enumerate(names)}
        docs = np.zeros(len(terms), dtype=np.int64)
        leaf, place = [], []
        for t in tries:
            at = np.fromiter(map(number.__getitem__, t.terms), np.int64, len(t.terms))
            docs[at] += t.docs  # a trie holds a term once
            leaf.append(at[t.leaf])
            place.append(np.array([place_of[s] for s in t.names], dtype=np.int64)[t.place] if t.names else t.place)
        return cls._summed(terms, docs, names, np.concatenate(leaf), np.concatenate(place), np.concatenate([t.counts for t in tries]))

    def __len__(self) -> int:
        return len(self.terms)

    def weight(self) -> float:
        """Memory of leaves and counters, in leaves."""
        return len(self.terms) + len(self.leaf) / COUNTERS

    def where(self, kept: np.ndarray) -> Trie:
        """Only some leaves."""
        at, inside = np.flatnonzero(kept), kept[self.leaf]
        return Trie([self.terms[k] for k in at.tolist()], self.docs[at], self.names, (np.cumsum(kept) - 1)[self.leaf[inside]], self.place[inside], self.counts[inside])

    def segment(self, lang: str, first: int, last: int) -> pa.RecordBatch:
        """A row of ``SEGMENT_SCHEMA`` of the leaves ``first`` to ``last`` (not itself)."""
        terms = self.terms[first:last]
        shared = shared_prefixes(terms)
        a, b = np.searchsorted(self.leaf, [first, last])
        used, place = np.unique(self.place[a:b], return_inverse=True)
        sums = np.zeros(len(used), dtype=np.int64)
        np.add.at(sums, place, self.counts[a:b])
        sizes = np.bincount(self.leaf[a:b] - first, minlength=len(terms))
        weight = np.cumsum(1 + sizes / COUNTERS)
        marks = np.searchsorted(weight, np.arange(zlib.crc32(terms[-1], int(sums.sum()) & 0xFFFFFFFF) % MARK, weight[-1], MARK), side="right")
        row = {
            "lang": lang, "first": terms[0], "last": terms[-1], "leaves": len(terms), "shared": shared, "suffixes": [t[k:] for t, k in zip(terms, shared.tolist())], "docs": self.docs[first:last], "names": [self.names[k] for k in used.tolist()],
            "sizes": sizes.astype(np.int32), "places": place.astype(np.int32), "counts": self.counts[a:b], "sums": sums, "marks": [terms[k] for k in marks.tolist()],
        }
        return pa.RecordBatch.from_arrays([pa.array([row[k]], kind) for k, kind in _TYPES.items()], names=list(_TYPES))

    def segments(self, lang: str, size: int = SEGMENT) -> Iterator[pa.RecordBatch]:
        for first in range(0, len(self.terms), size):
            yield self.segment(lang, first, min(first + size, len(self.terms)))


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[str, Trie]]:
    """(lang, trie) of each segment."""
    names = {k: batch.schema.get_field_index(k) for k in _TYPES}
    column = lambda k: batch.column(names[k])
    numbers = lambda k, i: column(k)[i].values.to_numpy(zero_copy_only=False)
    for i, lang in enumerate(column("lang").to_pylist()):
        terms, before = [], b""
        for shared, suffix in zip(numbers("shared", i).tolist(), column("suffixes")[i].values.to_pylist()):
            before = before[:shared] + suffix if shared else suffix
            terms.append(before)
        leaf = np.repeat(np.arange(len(terms)), numbers("sizes", i))
        yield lang, Trie(terms, numbers("docs", i), column("names")[i].as_py(), leaf, numbers("places", i).astype(np.int64), numbers("counts", i))


def cut_points(terms: list[bytes], bounds: Iterable[bytes]) -> list[int]:
    return [0, *[bisect_left(terms, b) for b in bounds], len(terms)]
