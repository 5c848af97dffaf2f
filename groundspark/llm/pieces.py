"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut where no piece of the vocabulary can reach across (before runs of the space mark, around line ends, between
letters and other signs; checked against the vocabulary when it is loaded).  The distinct parts of a batch
that the worker doesn't know yet are encoded together: their symbols stand in one flat array; each round finds, for every
part, the least rank among its neighbouring pairs (a segmented minimum), merges all leftmost occurrences of that
pair at once, and compacts the array, until no pair of any part is in the vocabulary.  Known parts are table lookups.

Pieces made of space marks only share one score in such vocabularies and come last: what is left of a run is cut by length, the
way leftmost merges do.  Symbols outside the vocabulary become their UTF-8 bytes' pieces.

Defined cases: null and empty texts have no ids; text is never normalised beyond the mark for spaces (the model must say
the same, or loading fails); decoding gives the text back, the mark itself as a space; invalid byte runs decode to the
replacement character.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.llm.common import bounded_batches, cut, gather, map_arrow, ramp, table
from groundspark.llm.tokens import MEMORY_WORDS, WordTable, public_path

MARK = "▁"
_NONE = np.int32(np.iinfo(np.int32).max)


def _leftmost(n: int, known: set[int]) -> list[int]:
    """Lengths of pieces that leftmost merges make of ``n`` marks, all pairs having the same rank."""
    run, k = [1] * n, 0
    while k < len(run) - 1:
        if run[k] + run[k + 1] in known:
            run[k : k + 2] = [run[k] + run[k + 1]]
            k = 0
        else:
            k += 1
    return run


class Vocabulary:
    """Pieces, ranks of pairs, and how texts may be cut."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as found:
            model.ParseFromString(found.read())
        n = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or not n.add_dummy_prefix or any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("only plain BPE models without normalisation are supported")
        self.pieces = [p.piece for p in model.pieces]
        normal = [k for k, p in enumerate(model.pieces) if p.type == 1]
        self.number = {self.pieces[k]: k for k in normal}
        self.unknown = next(k for k, p in enumerate(model.pieces) if p.type == 2)
        self.byte = np.array([next((k for k, p in enumerate(model.pieces) if p.type == 6 and p.piece == f"<0x{b:02X}>"), self.unknown) for b in range(256)], dtype=np.int32)
        marks = [k for k in normal if set(self.pieces[k]) == {MARK} and len(self.pieces[k]) > 1]
        self.mark, self.longest_mark = self.number[MARK], max([1, *(len(self.pieces[k]) for k in marks)])
        if len({model.pieces[k].score for k in marks}) > 1:
            raise ValueError("pieces of space marks have several scores")
        known = {len(self.pieces[k]) for k in marks}
        self.rests = [_leftmost(n, known) for n in range(self.longest_mark)]
        if any(_leftmost(n, known) != [self.longest_mark] * (n // self.longest_mark) + self.rests[n % self.longest_mark] for n in range(4 * self.longest_mark)):
            raise ValueError("runs of space marks have no period")
        scored = sorted((k for k in normal if k not in set(marks)), key=lambda k: (-model.pieces[k].score, k))
        keys, ranks, self.by_rank = [], [], []
        for k in scored:
            piece = self.pieces[k]
            if len(piece) < 2:
                continue
            for at in range(1, len(piece)):
                a, b = self.number.get(piece[:at]), self.number.get(piece[at:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    ranks.append(len(self.by_rank))
            self.by_rank.append(k)
        if any(model.pieces[a].score == model.pieces[b].score for a, b in zip(self.by_rank, self.by_rank[1:])):
            raise ValueError("scores of pieces are not distinct")
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys, self.pair_ranks = np.array(keys, dtype=np.int64)[order], np.array(ranks, dtype=np.int32)[order]
        self.by_rank = np.array(self.by_rank, dtype=np.int32)
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[self._slot(self.pair_keys)] = True
        self._cuts()
        # decoding
        control = {k for k, p in enumerate(model.pieces) if p.type == 3}
        byte_value = {int(k): b for b, k in enumerate(self.byte.tolist()) if k != self.unknown}
        raw = [b"" if k in control else bytes([byte_value[k]]) if k in byte_value else " ⁇ ".encode() if k == self.unknown else p.replace(MARK, " ").encode() for k, p in enumerate(self.pieces)]
        self.raw, self.decimal = raw, [str(k) for k in range(len(raw))]

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x9E3779B1)) >> np.int64(13)) & np.int64((1 << 22) - 1)

    def _cuts(self) -> None:
        """Patterns whose boundaries no piece reaches across; characters for which the finer one doesn't hold are ``odd``."""
        letter = re.compile(r"[^\W\d_]")
        odd: set[str] = set()
        for k in self.by_rank.tolist():
            piece = self.pieces[k]
            for a, b in zip(piece, piece[1:]):
                if b == MARK and a != MARK or "\n" in (a, b):
                    raise ValueError("a piece reaches over a space mark or a line end")
                if a != MARK and bool(letter.match(a)) != bool(letter.match(b)):
                    odd |= {c for c in (a, b) if not c.isascii()} or {a, b}
        self.fine = re.compile(rf"{MARK}*(?:[^\W\d_]+|[^\w\n{MARK}](?:(?![\n{MARK}])[\W\d_])*|[\d_](?:(?![\n{MARK}])[\W\d_])*)|\n|{MARK}+")
        self.coarse = re.compile(rf"{MARK}*[^\n{MARK}]+|\n|{MARK}+")
        self.odd = re.compile("[" + "".join(map(re.escape, sorted(odd))) + "]") if odd else None

    def parts(self, text: str) -> list[str]:
        marked = MARK + text.replace(" ", MARK)
        return (self.coarse if self.odd and self.odd.search(text) else self.fine).findall(marked)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of pieces; ``_NONE`` for pairs that don't merge."""
        keys = left.astype(np.int64) << 20 | right
        k = np.flatnonzero((left >= 0) & (right >= 0) & self.maybe[self._slot(keys)])
        out = np.full(len(keys), _NONE, dtype=np.int32)
        at = np.minimum(np.searchsorted(self.pair_keys, keys[k]), len(self.pair_keys) - 1)
        out[k] = np.where(self.pair_keys[at] == keys[k], self.pair_ranks[at], _NONE)
        return out

    def merge(self, parts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each part."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        distinct, inverse = np.unique(codes, return_inverse=True)
        # symbols: pieces, or -1 - code point where the vocabulary has no such piece
        symbol = np.array([self.number.get(chr(c), -1 - int(c)) for c in distinct.tolist()], dtype=np.int32)[inverse]
        owner = np.repeat(np.arange(len(parts)), lengths)
        done_symbol, done_owner = [], []
        rank = self.ranks(symbol[:-1], symbol[1:])
        rank[owner[1:] != owner[:-1]] = _NONE
        rank = np.append(rank, _NONE)
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(first, len(owner)))
            least = np.minimum.reduceat(rank, first)
            going = np.repeat(least != _NONE, sizes)
            if not going.all():
                done_symbol.append(symbol[~going])
                done_owner.append(owner[~going])
                symbol, owner, rank, sizes, least = symbol[going], owner[going], rank[going], sizes[least != _NONE], least[least != _NONE]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            begins = np.concatenate([[True], np.diff(hit) != 1])
            turn = hit - hit[np.maximum.accumulate(np.where(begins, np.arange(len(hit)), 0))]
            hit = hit[turn & 1 == 0]  # of overlapping occurrences the leftmost
            symbol[hit] = self.by_rank[rank[hit]]
            keep = np.ones(len(symbol), dtype=bool)
            keep[hit + 1] = False
            to = np.cumsum(keep) - 1
            symbol, owner, rank = symbol[keep], owner[keep], rank[keep]
            at = to[hit]
            redo = np.unique(np.concatenate([at, at[at > 0] - 1]))
            redo = redo[redo < len(symbol) - 1]
            rank[redo] = np.where(owner[redo] == owner[redo + 1], self.ranks(symbol[redo], symbol[redo + 1]), _NONE)
            rank[-1] = _NONE
        symbol, owner = np.concatenate(done_symbol or [symbol]), np.concatenate(done_owner or [owner])
        order = np.argsort(owner, kind="stable")
        symbol, owner = self._spelled(*self._runs(symbol[order], owner[order]))
        return cut(symbol, np.searchsorted(owner, np.arange(len(parts) + 1)))

    def _runs(self, symbol: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of single space marks become their longest pieces, left to right."""
        is_mark = symbol == self.mark
        same = is_mark[1:] & is_mark[:-1] & (owner[1:] == owner[:-1])
        if not same.any():
            return symbol, owner
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        sizes = np.diff(np.append(first, len(symbol)))
        table = [self.number.get(MARK * n, self.unknown) for n in range(1, self.longest_mark + 1)]
        whole, rest = np.where(is_mark[first], sizes // self.longest_mark, 0), sizes % self.longest_mark
        flat = np.array([table[n - 1] for r in self.rests for n in r], dtype=np.int32)
        counts = np.array([len(r) for r in self.rests], dtype=np.int64)
        # each run: its longest pieces, then what stands for the rest; other symbols stay
        ends = np.where(is_mark[first], counts[rest], 1)
        full = np.repeat(np.int32(table[-1]), int(whole.sum()))
        tail = np.where(np.repeat(is_mark[first], ends), flat[np.minimum(np.repeat((np.cumsum(counts) - counts)[rest], ends) + ramp(ends), max(0, len(flat) - 1))] if len(flat) else 0, np.repeat(symbol[first], ends))
        who, place = np.concatenate([np.repeat(np.arange(len(first)), whole), np.repeat(np.arange(len(first)), ends)]), np.concatenate([np.zeros(len(full), dtype=bool), np.ones(len(tail), dtype=bool)])
        order = np.lexsort((place, who))
        return np.concatenate([full, tail])[order].astype(np.int32), owner[first][who[order]]

    def _spelled(self, symbol: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters become the pieces of their bytes."""
        if (symbol >= 0).all():
            return symbol, owner
        unknown = np.unique(symbol[symbol < 0])
        spelled = [self.byte[np.frombuffer(chr(-1 - int(c)).encode("utf-8", "surrogatepass"), np.uint8)] for c in unknown]
        flat, counts = np.concatenate(spelled), np.array([len(s) for s in spelled])
        lengths, starts = np.ones(len(symbol), dtype=np.int64), np.arange(len(symbol), dtype=np.int64)
        k = np.flatnonzero(symbol < 0)
        which = np.searchsorted(unknown, symbol[k])
        lengths[k], starts[k] = counts[which], len(symbol) + (np.cumsum(counts) - counts)[which]
        return gather(np.concatenate([symbol, flat]), starts, lengths).astype(np.int32), np.repeat(owner, lengths)


class PieceEncoder:
    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.table = WordTable(self.vocabulary.merge)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the offsets of the texts among them."""
        if len(self.table.numbers) > MEMORY_WORDS:
            self.table.clear()
        number, parts = self.table.numbers.__getitem__, self.vocabulary.parts
        found = [np.zeros(0, dtype=np.int32) if not t else np.fromiter(map(number, p), np.int32, len(p)) for t in texts for p in (parts(t) if t else [],)]
        self.table.learn()
        w = np.concatenate(found) if found else np.zeros(0, dtype=np.int32)
        lengths = self.table.length[w]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return gather(self.table.flat, self.table.start[w], lengths), ends[np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)]

    def decode(self, ids: Sequence[int]) -> str:
        raw = b"".join(map(self.vocabulary.raw.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " and len(ids) and self.vocabulary.pieces[ids[0]].startswith(MARK) else raw).decode("utf-8", "replace")


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, text: str = "text", tokens: str = "tokens") -> DataFrame:
    """All columns of ``docs`` and the ids of ``text`` as ``tokens``, which takes the place of a column of that name."""
    columns = [c for c in docs.columns if c != tokens]
    kept = docs.select(*columns)
    at = columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, offsets = encoder(path).encode(batch.column(at).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], names=[*columns, tokens])

    return map_arrow(kept, run, _with(kept, tokens, "array<int>"))


def decode(rows: DataFrame, path: str, tokens: str = "tokens", text: str = "text") -> DataFrame:
    """All columns of ``rows`` and the text of ``tokens`` (null: empty) as ``text``, which takes the place of a column of that name."""
    columns = [c for c in rows.columns if c != text]
    kept = rows.select(*columns)
    at = columns.index(tokens)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([e.decode(x or []) for x in batch.column(at).to_pylist()], pa.string())], names=[*columns, text])

    return map_arrow(kept, run, _with(kept, text, "string"))


def _with(df: DataFrame, name: str, kind: str):
    from pyspark.sql.types import StructType, _parse_datatype_string

    return StructType([*df.schema.fields]).add(name, _parse_datatype_string(kind))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    path = public_path("piece_bpe_32k.model")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path)
        ids, offsets = e.encode(batch.column(1).to_pylist())
        decimal, rows = e.vocabulary.decimal.__getitem__, []
        for x in cut(ids, offsets):
            x = x.tolist()
            rows.append((len(x), hashlib.sha256(",".join(map(decimal, x)).encode()).hexdigest(), hashlib.sha256(e.decode(x).encode("utf-8", "surrogatepass")).hexdigest()))
        n, a, b = zip(*rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(docs, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
