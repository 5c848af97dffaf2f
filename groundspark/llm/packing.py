"""Packing of documents into token windows by an order-preserving dynamic programme.

Within one input partition the documents' ids stand end to end, in the order in which the table holds them.  A window is at most
``window`` ids; cuts are chosen at document ends (free), sentence ends (``sentence``) or, where a sentence
is longer than two steps of ``INSIDE_STEP`` ids, inside it (``inside``).  The programme minimises padding plus these
truncation penalties; the best previous cut is the front of a monotone queue, so each boundary costs O(1).
A stretch of ``STRETCH`` ids is solved at a time and its last windows are carried into the next, so memory is bounded
and only a partition's very end is short: that rest is cut by powers of two, lengths which are not padded.

Defined cases: null or empty texts are one end id; an empty table gives no rows; repeated rows are packed one by
one; other columns are ignored; a document longer than a window is cut into as many pieces as needed.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.llm.common import bounded_batches, ramp, table, tidy
from groundspark.llm.tokens import public_path, word_encoder

WINDOW, END_ID, STRETCH = 4096, 2, 1 << 20
SENTENCE_PENALTY, INSIDE_PENALTY, INSIDE_STEP = 2, 16, 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def choose_cuts(boundaries: np.ndarray, penalties: np.ndarray, window: int) -> list[int]:
    """Cuts (ends of windows) for boundaries 0 < b1 < ... < bm, all gaps at most ``window``; the last is always cut.

    cost[j] = min over j - window <= i < j of cost[i] + (window - (j - i)) + penalty[j].
    """
    b, p = [0, *boundaries.tolist()], [0, *penalties.tolist()]
    cost, back = [0] * len(b), [0] * len(b)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (cost + position, position, index), increasing in the first
    for j in range(1, len(b)):
        at = b[j]
        least = at - window
        while queue[0][1] < least:
            queue.popleft()
        front = queue[0]
        cost[j] = c = front[0] + window - at + p[j]
        back[j] = front[2]
        c += at
        while queue and queue[-1][0] >= c:
            queue.pop()
        queue.append((c, at, j))
    cuts, j = [], len(b) - 1
    while j:
        cuts.append(b[j])
        j = back[j]
    return cuts[::-1]


def with_inner(ends: np.ndarray, kinds: np.ndarray, step: int, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """Add a cut at each ``step`` inside gaps longer than two steps."""
    gaps = np.diff(np.concatenate([[0], ends]))
    long = np.flatnonzero(gaps > 2 * step)
    counts = (gaps[long] - 1) // step
    inner = np.repeat(ends[long] - gaps[long], counts) + (ramp(counts) + 1) * step
    both, order = np.concatenate([ends, inner]), np.argsort(np.concatenate([ends, inner]), kind="stable")
    return both[order], np.concatenate([kinds, np.full(len(inner), inside)])[order]


def powers(rest: int) -> list[int]:
    """Lengths, powers of two in falling order, that sum to ``rest``."""
    return [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


class Packer:
    """Takes documents' ids in order and gives rows of pieces; holds a bounded stretch of ids."""

    def __init__(self, window: int, sentence_end: np.ndarray, first_sequence: int, stretch: int = STRETCH, sentence: int = SENTENCE_PENALTY, inside: int = INSIDE_PENALTY):
        self.window, self.sentence_end, self.sequence, self.stretch = window, sentence_end, first_sequence, max(stretch, 4 * window)
        self.sentence, self.inside = sentence, inside
        self.docs: list[tuple[int, int, int]] = []  # (doc_id, ids of it before this stretch, all its ids)
        self.ids: list[np.ndarray] = []
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, len(ids)))
        self.ids.append(ids)
        self.held += len(ids)
        if self.held >= self.stretch:
            self.solve(last=False)

    def solve(self, last: bool) -> None:
        if not self.held:
            return
        ids = np.concatenate(self.ids)
        ends = np.cumsum([len(x) for x in self.ids])
        free = np.zeros(len(ids) + 1, dtype=bool)
        free[ends] = True
        at = np.flatnonzero(self.sentence_end[ids]) + 1
        boundaries = np.union1d(at, ends)
        boundaries, kinds = with_inner(boundaries, np.where(free[boundaries], 0, self.sentence), min(INSIDE_STEP, max(1, self.window // 2)), self.inside)
        cuts = choose_cuts(boundaries, kinds, self.window)
        if last:
            begin = cuts[-2] if len(cuts) > 1 else 0
            cuts = cuts[:-1] + (begin + np.cumsum(powers(cuts[-1] - begin))).tolist()
        else:
            cuts = cuts[:-2]
        self.emit(ids, ends, cuts)

    def emit(self, ids: np.ndarray, ends: np.ndarray, cuts: list[int]) -> None:
        """Rows for all windows up to the last cut; what is behind it is held."""
        ends_list, k, begin = ends.tolist(), 0, 0
        raw = ids.astype("<u4")
        for cut in cuts:
            at = begin
            while at < cut:
                doc_id, before, total = self.docs[k]
                first = ends_list[k] - len(self.ids[k])
                stop = min(cut, ends_list[k])
                self.rows.append((doc_id, before + at - first, stop - at, zlib.crc32(raw[at:stop]), total, self.sequence, at - begin))
                at = stop
                k += stop == ends_list[k]
            self.sequence += 1
            begin = cut
        if k < len(self.docs):
            first = ends_list[k] - len(self.ids[k])
            doc_id, before, total = self.docs[k]
            self.docs = [(doc_id, before + begin - first, total), *self.docs[k + 1 :]]
            self.ids = [self.ids[k][begin - first :], *self.ids[k + 1 :]]
        else:
            self.docs, self.ids = [], []
        self.held = len(ids) - begin

    def take(self) -> pa.RecordBatch | None:
        rows, self.rows = self.rows, []
        if not rows:
            return None
        columns = list(zip(*rows))
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=names)


_ENDS: dict[str, np.ndarray] = {}


def _sentence_ends(path: str, library) -> np.ndarray:
    """By id: does the token end a word with a full stop, question mark or exclamation mark."""
    if path not in _ENDS:
        size = max(library.get_vocab(with_added_tokens=True).values()) + 1
        ends = np.zeros(size, dtype=bool)
        for token, number in library.get_vocab().items():
            ends[number] = token.endswith((".</w>", "!</w>", "?</w>"))
        _ENDS[path] = ends
    return _ENDS[path]


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents (``doc_id``, ``text``) placed in sequences; see the module's docstring for the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        encoder = word_encoder(path)
        packer = Packer(window, _sentence_ends(path, encoder.library), (context.partitionId() if context else 0) << 32)
        for batch in batches:
            ids, offsets = encoder.encode(batch.column(1).to_pylist())
            for doc_id, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                packer.add(doc_id, np.append(ids[a:b], np.int32(end_id)))
            if (out := packer.take()) is not None:
                yield out
        packer.solve(last=True)
        if (out := packer.take()) is not None:
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), SCHEMA)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: pieces of documents in sequences."""
    bounded_batches(spark)
    return pack(docs, public_path("word_bpe_49k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return pack(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))
