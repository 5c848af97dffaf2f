"""Removal of repeated passages by suffix arrays, byte for byte.

A byte goes if a string of ``window`` (200) bytes that covers it also starts anywhere else, in the same document or another.
Strings never cross documents, and are judged on the input.

Shards.  Equal windows must meet in one shard without sending every suffix.  Each window has an anchor: the run of
``window // 2`` bytes or so inside it with the least hash, the leftmost of equals.  Consecutive windows with one
anchor form a segment; equal windows have equal anchors, so an anchor that stands once in all texts rules its segment
out, exactly.  Segments of repeated anchors are dealt to shards by anchor.

Sorting.  A shard's distinct segments are sorted by external induced sorting (``suffix.py``), some ``SORT_BYTES`` at a time;
neighbouring suffixes with a common prefix of a window or more, and segments that occur several times, give the repeated windows.
An anchor's segments stay together, so a very frequent anchor may fill far more than that: texts, places and queues then go to disk, and a
task holds no more than ``suffix.MEMORY`` bytes of them.

Equal texts are one text with a number of copies: with two or more, each byte of a text of a window or more goes.
Texts are told apart by their 128-bit digests.  A text that makes up a large share of all rows isn't shuffled: what is known of it is broadcast.

Defined cases: null text is empty; shorter texts than a window lose nothing; an empty table gives no rows; repeated rows
are copies of each other; other columns stay as they are, whatever their names (``__key``, ``__spans`` and ``__whole`` are taken).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.llm.common import Scratch, bounded_batches, hot_keys, map_arrow, mix64, ramp, spread_join, table, tidy
from groundspark.llm.suffix import MEMORY, Column, Store, suffix_blocks

WINDOW = 200
#: Bytes hashed at a time, bytes of text for one shard of anchors, and bytes of segments sorted at a time.
PIECE_BYTES, SHARD_BYTES, SORT_BYTES = 1 << 20, 16 << 20, 4 << 20
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_CODES = mix64(np.arange(301, 557, dtype=np.uint64))


def gram_of(window: int) -> int:
    return max(1, window * 96 // 200)


def _rolling(raw: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes at each place, by doubling."""
    part, size, power = _CODES[raw], 1, _BASE
    out, done = None, 0
    while True:
        if length & size:
            if out is None:
                out, done = part, size
            else:  # the part stands before what is done
                out, done = part[: len(part) - done] * np.uint64(pow(int(_BASE), done, 1 << 64)) + out[size:][: len(part) - done], done + size
        if size * 2 > length:
            return out[: len(raw) - length + 1]
        part = part[:-size] * power + part[size:]
        power = np.uint64(int(power) * int(power) & 0xFFFFFFFFFFFFFFFF)
        size *= 2


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(data: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, windows, anchor hash) of each segment, by document and place."""
    gram, out = gram_of(window), []
    long = [k for k, d in enumerate(data) if len(d) >= window]
    i = 0
    while i < len(long):
        j, size = i, 0
        while j < len(long) and (j == i or size + len(data[long[j]]) <= PIECE_BYTES):
            size += len(data[long[j]])
            j += 1
        docs = np.array(long[i:j])
        lengths = np.array([len(data[k]) for k in long[i:j]], dtype=np.int64)
        raw = np.frombuffer(b"".join(data[k] for k in long[i:j]), dtype=np.uint8)
        begins = np.cumsum(lengths) - lengths
        bits = np.uint64(max(1, int(len(raw)).bit_length()))
        hashes = _rolling(raw, gram)
        low = (np.uint64(1) << bits) - np.uint64(1)
        least = _sliding_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), window - gram + 1)
        starts = np.repeat(begins, lengths - window + 1) + ramp(lengths - window + 1)
        anchor = (least[starts] & low).astype(np.int64)
        owner = np.repeat(np.arange(len(docs)), lengths - window + 1)
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
        counts = np.diff(np.append(first, len(starts)))
        out.append((docs[owner[first]], starts[first] - begins[owner[first]], counts, mix64(hashes[anchor[first]])))
        i = j
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out))  # type: ignore[return-value]


def _bytes(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _numbered(keys: bytes) -> tuple[bytes, np.ndarray]:
    """(distinct keys of 16 bytes end to end, the number of each key)."""
    pairs = np.frombuffer(keys, "<u8").reshape(-1, 2)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    found = pairs[order]
    new = np.concatenate([[True], (found[1:] != found[:-1]).any(axis=1)]) if len(found) else np.zeros(0, dtype=bool)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return found[new].tobytes(), number


def anchors(keyed: DataFrame, shards: int, window: int) -> DataFrame:
    """Rows (shard, keys, counts, anchors): distinct anchors of each text; the lowest bit says that it has several segments there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys, texts = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(key)
                    keys.append(key)
                    texts.append(text)
            doc, _, _, anchor = segments(_bytes(texts), window)
            if not len(doc):
                continue
            order = np.lexsort((anchor, doc))
            doc, anchor = doc[order], anchor[order] & ~np.uint64(1)
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])]))
            several = np.diff(np.append(first, len(doc))) > 1
            doc, anchor = doc[first], anchor[first] | several.astype(np.uint64)
            shard = ((anchor >> np.uint64(1)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            bounds, all_keys, out = np.searchsorted(shard[order], np.arange(shards + 1)), np.frombuffer(b"".join(keys), "V16"), []
            for k in range(shards):
                part = order[bounds[k] : bounds[k + 1]]
                if len(part):
                    own, counts = np.unique(doc[part], return_counts=True)
                    out.append((k, all_keys[own].tobytes(), counts.astype("<u4").tobytes(), anchor[part].astype("<u8").tobytes()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["shard", "keys", "counts", "anchors"])

    return keyed.select("key", "text").mapInArrow(tidy(run), "shard int, keys binary, counts binary, anchors binary")


def repeated_anchors(packed: DataFrame, shards: int) -> DataFrame:
    """Rows (key, anchors): for each text its anchors that stand more than once in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for shard, keys, counts, values in zip(*[c.to_pylist() for c in batch.columns]):
                held.setdefault(shard, []).append((keys, np.frombuffer(counts, "<u4"), np.frombuffer(values, "<u8")))
        for parts in held.values():
            texts, key = _numbered(b"".join(p[0] for p in parts))
            anchor, key = np.concatenate([p[2] for p in parts]), np.repeat(key, np.concatenate([p[1] for p in parts]))
            order = np.argsort(anchor, kind="stable")
            a = anchor[order] >> np.uint64(1)
            same = a[1:] == a[:-1]
            k = order[np.concatenate([same, [False]]) | np.concatenate([[False], same]) | ((anchor[order] & np.uint64(1)) == 1)]
            anchor, key = anchor[k], key[k]
            order = np.lexsort((anchor, key))
            anchor, key = anchor[order], key[order]
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1])]) if len(key) else np.zeros(0, dtype=bool)
            anchor, key = anchor[new], key[new]
            # texts that came from several tasks are one again: what is left alone without a second segment is no repeat
            _, inverse, n = np.unique(anchor >> np.uint64(1), return_inverse=True, return_counts=True)
            keep = (n[inverse] > 1) | ((anchor & np.uint64(1)) == 1)
            anchor, key = anchor[keep], key[keep]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
            ends = np.append(first[1:], len(key))
            for at in range(0, len(first), 8192):
                f, e = first[at : at + 8192], ends[at : at + 8192]
                yield pa.RecordBatch.from_arrays([pa.array([texts[16 * x : 16 * x + 16] for x in key[f].tolist()], pa.binary()), pa.array([(anchor[x:y] >> np.uint64(1)).astype("<u8").tobytes() for x, y in zip(f.tolist(), e.tolist())], pa.binary())], names=["key", "anchors"])

    return packed.repartitionById(shards, F.col("shard")).mapInArrow(tidy(run), "key binary, anchors binary").groupBy("key").agg(F.collect_list("anchors").alias("anchors"))


def candidate_segments(joined: DataFrame, window: int) -> DataFrame:
    """Rows (anchor, segment, keys, firsts) for ``key, text, anchors``: the segments of repeated anchors, a row for each distinct one of a batch, with its places packed."""

    def cut(keys: list[bytes], data: list[bytes], lists: list) -> pa.RecordBatch | None:
        doc, first, counts, anchor = segments(data, window)
        wanted = [np.frombuffer(b"".join(x), "<u8") for x in lists]
        bounds = np.searchsorted(doc, np.arange(len(data) + 1))
        keep = np.concatenate([np.isin(anchor[a:b] >> np.uint64(1), w) for a, b, w in zip(bounds[:-1].tolist(), bounds[1:].tolist(), wanted)] or [np.zeros(0, dtype=bool)])
        k = np.flatnonzero(keep)
        if not len(k):
            return None
        f, c = first[k], counts[k]
        number: dict[bytes, int] = {}
        at = np.fromiter((number.setdefault(data[i][a:b], len(number)) for i, a, b in zip(doc[k].tolist(), f.tolist(), (f + c - 1 + window).tolist())), np.int64, len(k))
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], np.arange(len(number) + 1))
        owner, f = np.frombuffer(b"".join(keys), "V16")[doc[k][order]], f[order].astype(np.int64)
        ranges = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        return pa.RecordBatch.from_arrays(
            [pa.array((anchor[k][order[bounds[:-1]]] >> np.uint64(1)).astype(np.int64)), pa.array(list(number), pa.binary()), pa.array([owner[a:b].tobytes() for a, b in ranges], pa.binary()), pa.array([f[a:b].tobytes() for a, b in ranges], pa.binary())],
            names=["anchor", "segment", "keys", "firsts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            fresh = []
            for k, key in enumerate(batch.column(0).to_pylist()):
                if key not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(key)
                    fresh.append(k)
            some = batch.take(pa.array(fresh, pa.int64()))
            if fresh and (out := cut(some.column(0).to_pylist(), _bytes(some.column(1).to_pylist()), some.column(2).to_pylist())) is not None:
                yield out

    return joined.select("key", "text", "anchors").mapInArrow(tidy(run), "anchor long, segment binary, keys binary, firsts binary")


class Pieces:
    """Distinct segments, in order of arrival, and the places where they stand; all of it in columns that go to disk beyond ``memory``."""

    def __init__(self, window: int, memory: int = MEMORY):
        self.window, self.store = window, Store(memory)
        self.text, self.lengths = Column(self.store, np.uint16), Column(self.store, np.int64)
        self.places = [Column(self.store, np.uint64), Column(self.store, np.uint64), Column(self.store, np.int64), Column(self.store, np.int64)]  # key, first, piece
        self.last, self.number = None, -1
        self.fresh: list[bytes] = []
        self.found: list[tuple[bytes, bytes, int]] = []
        self.pending = self.size = 0

    def add(self, piece: bytes, keys: bytes, firsts: bytes) -> None:
        """Equal pieces come one after the other."""
        if piece != self.last:
            self.fresh.append(piece)
            self.last, self.number = piece, self.number + 1
            self.size += len(piece)
        self.found.append((keys, firsts, self.number))
        self.pending += len(piece) + len(keys)
        if self.pending > 1 << 20:
            self.flush()

    def flush(self) -> None:
        if self.fresh:
            lengths = np.array([len(p) for p in self.fresh], dtype=np.int64)
            text = np.ones(int(lengths.sum()) + len(lengths), dtype=np.uint16)  # 1 behind each segment; bytes are 2 and more, the end is 0
            text[np.repeat(np.cumsum(lengths + 1) - (lengths + 1), lengths) + ramp(lengths)] = np.frombuffer(b"".join(self.fresh), np.uint8).astype(np.uint16) + 2
            self.text.append(text)
            self.lengths.append(lengths)
        if self.found:
            keys, first = np.frombuffer(b"".join(k for k, _, _ in self.found), "<u8").reshape(-1, 2), np.frombuffer(b"".join(f for _, f, _ in self.found), "<i8")
            piece = np.repeat(np.array([n for _, _, n in self.found], dtype=np.int64), [len(f) // 8 for _, f, _ in self.found])
            for column, values in zip(self.places, (keys[:, 0], keys[:, 1], first, piece)):
                column.append(values)
        self.fresh, self.found, self.pending = [], [], 0

    def place_blocks(self) -> Iterator[np.ndarray]:
        """Places as rows (key, key, first, piece)."""
        for block in zip(*[c.blocks(self.store.block) for c in self.places]):
            yield np.stack([c.view(np.int64) for c in block], axis=1)

    def several(self) -> np.ndarray:
        """For each piece: does it stand in more than one place?  (A text that came from several tasks gives the same places again.)"""
        out, before = self.store.array(self.number + 1, bool), None
        for rows in self.place_blocks():
            if before is not None:
                rows = np.concatenate([before, rows])
            begins = np.flatnonzero(np.concatenate([[True], rows[1:, 3] != rows[:-1, 3]]))
            head = np.repeat(rows[begins], np.diff(np.append(begins, len(rows))), axis=0)
            out[rows[(rows[:, :3] != head[:, :3]).any(axis=1), 3]] = True
            before = rows[begins[-1] : begins[-1] + 1]
        return out

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first windows, last windows of runs of repeated windows, by piece; for each piece its first run, one more at the end)."""
        store, window, n_pieces = self.store, self.window, self.number + 1
        n = self.text.count + 1
        text, at = store.array(n, np.uint16), 0
        for part in self.text.blocks(store.block):
            text[at : at + len(part)] = part
            at += len(part)
        self.text.clear()
        begins, at = store.array(n_pieces + 1, np.int64), 0
        for part in self.lengths.blocks(store.block):
            begins[at + 1 : at + 1 + len(part)] = begins[at] + np.cumsum(part + 1)
            at += len(part)
        several, repeated, before = self.several(), store.array(n + 1, bool), None
        for suffixes, common in suffix_blocks(text, window, store):
            k = np.flatnonzero(common >= window)
            repeated[suffixes[k]] = True
            repeated[suffixes[k[k > 0] - 1]] = True
            if len(k) and k[0] == 0:
                repeated[before] = True
            before = suffixes[-1]
        # windows of pieces that stand in several places are repeated; one that starts near a piece's end would reach over it
        for k in range(0, n_pieces, max(1, store.block // 512)):
            own = np.arange(k, min(n_pieces, k + max(1, store.block // 512)))
            lengths = begins[own + 1] - begins[own] - 1
            twice = own[several[own]]
            fit = begins[twice + 1] - begins[twice] - window
            repeated[np.repeat(begins[twice], fit) + ramp(fit)] = True
            repeated[np.repeat(begins[own] + lengths - window + 1, window) + ramp(np.full(len(own), window))] = False
        firsts, lasts, before = Column(store, np.int64), Column(store, np.int64), False
        for a in range(0, n + 1, store.block):
            part = repeated[a : a + store.block]
            change = np.diff(np.concatenate([[before], part]).view(np.int8))
            firsts.append(np.flatnonzero(change == 1) + a)
            lasts.append(np.flatnonzero(change == -1) + a - 1)
            before = part[-1]
        both = []
        for column in (firsts, lasts):
            whole, at = store.array(column.count, np.int64), 0
            for part in column.blocks(store.block):
                whole[at : at + len(part)] = part
                at += len(part)
            column.clear()
            both.append(whole)
        first, last = both
        to = np.searchsorted(first, begins)
        owner = begins[np.maximum(np.searchsorted(begins, first, side="right") - 1, 0)]
        return first - owner, last - owner, to

    def spans(self) -> Iterator[pa.RecordBatch]:
        """Rows (key, spans): the byte ranges that repeated windows cover, by text."""
        self.flush()
        if self.number < 0:
            return
        first, last, to = self.runs()
        for rows in self.place_blocks():
            piece = rows[:, 3]
            each = to[piece + 1] - to[piece]
            rows, each, piece = rows[each > 0], each[each > 0], piece[each > 0]
            if not len(rows):
                continue
            run = np.repeat(to[piece], each) + ramp(each)
            start = np.repeat(rows[:, 2], each)
            key, number = _numbered(np.ascontiguousarray(np.repeat(rows[:, :2], each, axis=0)).tobytes())
            order = np.argsort(number, kind="stable")
            covered = np.stack([start + first[run], start + last[run] + self.window], axis=1)[order]
            ends = np.searchsorted(number[order], np.arange(len(key) // 16 + 1)).tolist()
            joined = [merged(covered[a:b]).astype("<i8").tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([key[16 * k : 16 * k + 16] for k in range(len(joined))], pa.binary()), pa.array(joined, pa.binary())], names=["key", "spans"])


def repeated_spans(found: DataFrame, shards: int, window: int, sort_bytes: int = SORT_BYTES, memory: int = MEMORY) -> DataFrame:
    """Rows (key, spans): covered byte ranges (pairs of 64-bit numbers) of texts; a text may have several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, last = Pieces(window, memory), None
        try:
            for batch in batches:
                for anchor, piece, keys, firsts in zip(*[c.to_pylist() for c in batch.columns]):
                    if anchor != last:
                        if pieces.size > sort_bytes:
                            yield from pieces.spans()
                            pieces.store.close()
                            pieces = Pieces(window, memory)
                        pieces.last, last = None, anchor
                    pieces.add(piece, keys, firsts)
            yield from pieces.spans()
        finally:
            pieces.store.close()

    return found.repartition(shards, "anchor").sortWithinPartitions("anchor", "segment").mapInArrow(tidy(run), "key binary, spans binary")


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal ranges (n x 2) of overlapping or touching ones."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


def spans_of(docs: DataFrame, scratch: Scratch, window: int = WINDOW, text: str = "text", sort_bytes: int = SORT_BYTES, memory: int = MEMORY) -> DataFrame:
    """``docs`` with ``__key`` (of its text), ``__spans`` (an array of byte ranges, packed, to remove; null: none) and ``__whole`` (all of it goes)."""
    spark = docs.sparkSession
    keyed = docs.withColumn("__key", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    texts = keyed.select(F.col("__key").alias("key"), F.col(text).alias("text"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    counted = scratch.keep(texts.select("key", size.alias("size")).groupBy("key").agg(F.count("*").alias("n"), F.first("size").alias("size")), "counted")
    total = counted.agg(F.sum(F.col("n") * F.col("size"))).first()[0] or 0
    hot = hot_keys(counted, "key", "n")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // SHARD_BYTES))
    repeated = scratch.keep(repeated_anchors(anchors(texts, shards, window), shards), "anchors")
    found = candidate_segments(spread_join(texts, repeated.hint("shuffle_hash"), "key", "inner", hot), window)
    runs = repeated_spans(found, shards, window, sort_bytes, memory)
    copies = counted.filter((F.col("size") >= window) & (F.col("n") > 1)).select("key", "size")
    once = scratch.keep(runs.groupBy("key").agg(F.collect_list("spans").alias("spans")), "spans")
    info = once.join(copies, "key", "full_outer").select(F.col("key").alias("__key"), F.when(F.col("size").isNull(), F.col("spans")).alias("__spans"), F.col("size").isNotNull().alias("__whole"))
    return spread_join(keyed, info.hint("shuffle_hash"), "__key", "left", hot).withColumn("__whole", F.coalesce("__whole", F.lit(False)))


def _ranges(data: bytes, spans: list[bytes] | None, whole: bool) -> np.ndarray:
    if whole:
        return np.array([[0, len(data)]])
    if not spans:
        return np.zeros((0, 2), dtype=np.int64)
    return merged(np.frombuffer(b"".join(spans), "<i8").reshape(-1, 2))


def _kept(data: bytes, ranges: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in ranges.tolist():
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def report(docs: DataFrame, scratch: Scratch | None = None, window: int = WINDOW, **bounds) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    found = spans_of(docs.select("doc_id", "text"), scratch or Scratch(docs.sparkSession, "passages"), window, **bounds)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data, spans, whole in zip(_bytes(batch.column(1).to_pylist()), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            ranges = _ranges(data, spans, whole)
            rows.append((len(data), int((ranges[:, 1] - ranges[:, 0]).sum()), len(ranges), hashlib.sha256(_kept(data, ranges)).hexdigest()))
        n, removed, count, sha = zip(*rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_arrow(found.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "__spans", "__whole"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, scratch: Scratch | None = None, window: int = WINDOW, text: str = "text") -> DataFrame:
    """All columns of ``docs``, without the repeated passages; bytes of a character that is cut through go with it."""
    columns = docs.columns
    found = spans_of(docs, scratch or Scratch(docs.sparkSession, "passages"), window, text)
    at = columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        texts = batch.column(at).to_pylist()
        for t, data, spans, whole in zip(texts, _bytes(texts), batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist()):
            ranges = _ranges(data, spans, whole)
            out.append(t if not len(ranges) else _kept(data, ranges).decode("utf-8", "ignore"))
        return pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.string()), *batch.columns[at + 1 : len(columns)]], names=columns)

    return map_arrow(found.select(*columns, "__spans", "__whole"), run, docs.schema)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages go from the texts; every document stays."""
    bounded_batches(spark)
    cleaned = remove(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return report(table(spark, sf_dir, "documents"))
