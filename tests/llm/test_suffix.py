"""External suffix sorting and the places of repeated windows, far beyond their memory bound."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest


def some_text(n, seed=4):
    rng = np.random.default_rng(seed)
    half = rng.integers(2, 200, n // 2).astype(np.uint16)
    return np.concatenate([half, half[: len(half) - 7], rng.integers(2, 60, 9).astype(np.uint16), np.zeros(1, np.uint16)])


def sorted_on_disk(text, memory):
    """(suffixes, prefixes, peak bytes beside the results, longest block, store)."""
    from groundspark.llm.suffix import Store, suffix_blocks

    store = Store(memory)
    suffixes, common = np.empty(len(text), dtype=np.int32), np.empty(len(text), dtype=np.uint8)
    tracemalloc.start()
    at, longest = 0, 0
    for a, b in suffix_blocks(text, 60, store):
        suffixes[at : at + len(a)], common[at : at + len(a)] = a, b
        at, longest = at + len(a), max(longest, len(a))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    store.close()
    assert at == len(text)
    return suffixes, common, peak, longest, store


@pytest.mark.parametrize("memory,short", [(1 << 16, 20_000), (1 << 18, 40_000)])
def test_memory_does_not_grow_with_the_text(memory, short):
    from groundspark.llm.suffix import SYMBOL_BYTES, sort_suffixes

    sorted_on_disk(some_text(2000), memory)  # what is imported at first use isn't the sort's
    peaks = []
    for n in (short, 4 * short):
        text = some_text(n)
        suffixes, common, peak, longest, store = sorted_on_disk(text, memory)
        assert peak < 4 * memory + 2048 * SYMBOL_BYTES and longest <= store.block
        peaks.append(peak)
    assert store.spills > 500 and store.end > 8 * memory  # what is held on disk, and more than all that may stay in memory
    assert peaks[1] < 1.25 * peaks[0]
    wanted, prefixes = sort_suffixes(text, 60)
    assert (common == prefixes).all()
    padded = np.concatenate([text, np.zeros(60, np.uint16)])
    for k in range(0, 60, 7):
        assert (padded[suffixes + k] == padded[wanted + k]).all()


def test_repeated_windows_of_one_frequent_anchor():
    from groundspark.llm.passages import Pieces

    rng, window = random.Random(3), 20
    some = lambda: bytes(rng.randrange(97, 101) for _ in range(rng.randrange(8, 14)))
    core = bytes(rng.randrange(97, 105) for _ in range(12))
    segments = sorted({some() + core + some() for _ in range(2500)})
    windows = Counter(s[i : i + window] for s in segments for i in range(len(s) - window + 1))
    wanted, places = {}, []
    for k, s in enumerate(segments):
        first = rng.randrange(1000)
        stands = [(2 * k, first)] + [(2 * k + 1, 5)] * (k % 50 == 0)
        places.append((stands + stands[:1], s))  # a text that came from two tasks gives its place twice
        covered = np.zeros(len(s) + 2, dtype=int)
        for i in range(len(s) - window + 1):
            if windows[s[i : i + window]] > 1 or len(stands) > 1:
                covered[i + 1 : i + 1 + window] = 1
        edges = np.flatnonzero(np.diff(covered))
        for owner, at in stands:
            if len(edges):
                wanted[owner] = [(a + at, b + at) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
    for memory in (1 << 14, 96 << 20):
        pieces, found = Pieces(window, memory), {}
        for stands, s in places:
            pieces.add(s, b"".join(np.array([o, 7], "<u8").tobytes() for o, _ in stands), np.array([f for _, f in stands], "<i8").tobytes())
        for batch in pieces.spans():
            for key, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(int(np.frombuffer(key, "<u8")[0]), set()).update(map(tuple, np.frombuffer(spans, "<i8").reshape(-1, 2).tolist()))
        assert (pieces.store.spills > 50) == (memory < 1 << 20)
        pieces.store.close()
        assert {o: sorted(f) for o, f in found.items()} == wanted
