"""Vectorised word hashes of whole texts: no Python loop over words."""

from __future__ import annotations

import numpy as np

from groundspark.llm.common import mix64

#: Bytes hashed at a time (bounds the temporary arrays); a longer text is hashed as one piece.
PIECE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CODES = mix64(np.arange(1, 257, dtype=np.uint64))
_POWERS = np.ones(1, dtype=np.uint64)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WHITE = np.zeros(256, dtype=bool)
WHITE[[32, *range(9, 14)]] = True
#: Everything in ASCII but letters also parts words here.
NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[[*range(97, 123), *range(65, 91), *range(128, 256)]] = False


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        more = np.full(max(n, 64), _BASE, dtype=np.uint64)
        more[0] = 1
        _POWERS = np.multiply.accumulate(more)
    return _POWERS


def _hash_piece(raw: np.ndarray, parts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words in a piece."""
    space = parts[raw]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    raw = raw[starts[0] :]
    at = starts - starts[0]
    lengths = np.diff(np.append(at, len(raw)))
    place = np.arange(len(raw), dtype=np.int64)
    place -= np.repeat(at, lengths)
    values = codes[raw]
    values *= _powers(int(lengths.max()))[place]
    return mix64(np.add.reduceat(values, at)), starts


def word_hashes(texts: list[str | None], lower: bool = True, parts: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word of all texts, offsets of the texts among them); ``lower`` folds A-Z.

    Words are the runs of bytes that don't part words; ``parts`` says which bytes do.
    """
    codes = np.where(parts, np.uint64(0), _CODES)
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    counts, found = np.zeros(len(data), dtype=np.int64), []
    k = 0
    while k < len(data):
        last, size = k, 0
        while last < len(data) and (last == k or size + len(data[last]) < PIECE_BYTES):
            size += len(data[last]) + 1
            last += 1
        joined = b" ".join(data[k:last])
        raw = np.frombuffer(joined.translate(_LOWER) if lower else joined, dtype=np.uint8)
        hashes, starts = _hash_piece(raw, parts, codes)
        bounds = np.cumsum([0, *[len(d) + 1 for d in data[k:last]]])
        counts[k:last] = np.diff(np.searchsorted(starts, bounds))
        found.append(hashes)
        k = last
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return (np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)), offsets
