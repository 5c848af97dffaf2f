"""Token-id files compressed by a pair grammar, with random access to each document.

A shard of documents, in ascending ``doc_id``, is cut into blocks of at most about ``BLOCK_IDS`` ids.  In a block,
frequent pairs of neighbouring symbols are repeatedly replaced by nonterminals (Re-Pair): each round counts all
pairs, takes those seen most often as rules and replaces their occurrences left to right, until no pair is
frequent enough to pay for its rule.  A pair never holds a document's end id, so no rule crosses a
document and each document is a range of symbols.

A file row holds: ``shard``, ``block``, the documents' ids and symbol offsets, the rules (left, right), each
rule's expansion length, and the symbols.  ``read_documents`` expands only the symbols asked for; expansion
lengths give each document's token count without expanding anything.  Rows are written with the table
format's own commit protocol, so a lost executor leaves no half-written file.

Defined cases: null or empty texts are one end id; an empty table gives an empty file; repeated rows are
kept, each with its own range; other columns are ignored; null ``doc_id`` sorts first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundspark.llm.common import Scratch, bounded_batches, gather, table, tidy
from groundspark.llm.tokens import byte_encoder, public_path

END_ID, BLOCK_IDS = 0, 1 << 20
#: A pair becomes a rule if it is seen so often; so many rules at most come from one round.
LEAST_COUNT, ROUND_RULES = 24, 6000
#: Bytes of text in one shard, and the most shards (their bounds stand in the plan); beyond it shards grow, blocks and memory do not.
SHARD_BYTES, MOST_SHARDS = 16 << 20, 4096
FILE_SCHEMA = "shard int, block int, doc_ids binary, doc_ids_null binary, ends binary, left binary, right binary, rule_lengths binary, symbols_low binary, symbols_high binary, n_tokens long"


# ---- the grammar of one block -------------------------------------------------------------------------------

#: Bits of a counting table at most and at least; it shrinks with the symbols.
_BITS, _LEAST_BITS = 21, 10


def _bucket(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """Pairs of symbols (int32) to buckets of a counting table."""
    found = left.view(np.uint32) * np.uint32(2654435761)
    found ^= right.view(np.uint32) * np.uint32(2246822519)
    found >>= np.uint32(32 - bits)
    return found


def _replaced(at: np.ndarray) -> np.ndarray:
    """Which of these ascending places are replaced: in a run of overlapping occurrences the first, third, ..."""
    begins = np.concatenate([[True], np.diff(at) != 1])
    return (at - at[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]) & 1 == 0


def _round(symbols: np.ndarray, end_id: int, least: int, most_rules: int, newest: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(places of pairs that become rules, the rule of each, the rules' pairs as keys, whether other pairs are as frequent).

    With ``newest`` only pairs with a symbol from there on are counted, without it all pairs; both counts are exact, after a table by hash
    has left out the rare ones.
    """
    a, b = symbols[:-1], symbols[1:]
    fits = (a != end_id) & (b != end_id)
    if newest is not None:
        new = symbols >= newest
        fits &= new[:-1] | new[1:]
    at = np.flatnonzero(fits)
    bits = min(_BITS, max(_LEAST_BITS, int(2 * len(at)).bit_length()))
    a, b = a[at], b[at]
    bucket = _bucket(a, b, bits)
    often = np.flatnonzero(np.bincount(bucket, minlength=1 << bits) >= least)
    # only these buckets, few since each stands for ``least`` places, have a row in the tables that follow
    row_of = np.full(1 << bits, -1, dtype=np.int32)
    row_of[often] = np.arange(len(often), dtype=np.int32)
    row = row_of[bucket]
    hot = np.flatnonzero(row >= 0)
    at, row = at[hot], row[hot]
    keys = a[hot].astype(np.int64) << 32
    keys |= b[hot]
    owner = np.zeros(len(often), dtype=np.int64)
    owner[row] = keys
    other = np.flatnonzero(owner[row] != keys)
    if len(other):  # pairs that share their bucket with another get rows of their own
        more, number = np.unique(keys[other], return_inverse=True)
        row[other] = len(owner) + number
        owner = np.concatenate([owner, more])
    counts = np.bincount(row, minlength=len(owner))
    chosen = np.flatnonzero(counts >= least)
    left_over = len(chosen) > most_rules
    if left_over:
        chosen = chosen[np.argsort(-counts[chosen], kind="stable")[:most_rules]]
    rank = np.full(len(owner), -1, dtype=np.int32)
    rank[chosen] = np.arange(len(chosen), dtype=np.int32)
    rule = rank[row]
    ruled = np.flatnonzero(rule >= 0)
    return at[ruled], rule[ruled], owner[chosen], left_over


def compress(ids: np.ndarray, base: int, end_id: int, least: int = LEAST_COUNT, most_rules: int = ROUND_RULES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, left, right): symbols from ``base`` on are rules.

    Rounds end when no pair is left that is seen ``least`` times.  Replacing makes only pairs with a new symbol more frequent, and it leaves no
    place of a pair that became a rule: each is replaced, or the replacement beside it takes one of its symbols.  So after a round over all
    pairs come rounds over those with a symbol of the round before; only where a round had more frequent pairs than rules (``left_over``)
    all pairs are counted again.  A rule that no place is left for in its round, because its pairs overlap others, is not made.
    """
    symbols = ids.astype(np.int32)
    lefts, rights, known, newest, again = [], [], 0, None, False
    while len(symbols) >= 2:
        at, rule, pairs, left_over = _round(symbols, end_id, least, most_rules, newest)
        again = left_over or (again and newest is not None)
        if not len(at):
            if not again:
                break
            newest = None
            continue
        odd = _replaced(at)
        at, rule = at[odd], rule[odd]
        used = np.bincount(rule, minlength=len(pairs)) > 0
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        newest = base + known
        symbols[at] = newest + (np.cumsum(used, dtype=np.int32) - 1)[rule]
        symbols = symbols[keep]
        lefts.append((pairs[used] >> 32).astype(np.int32))
        rights.append((pairs[used] & 0xFFFFFFFF).astype(np.int32))
        known += int(used.sum())
    none = np.zeros(0, dtype=np.int32)
    return symbols, np.concatenate(lefts or [none]), np.concatenate(rights or [none])


def rule_lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Terminals in each rule's expansion; a rule only refers to earlier rounds' rules, so each pass settles a level."""
    lengths = np.zeros(len(left), dtype=np.int64)
    size = lambda x: np.where(x < base, 1, lengths[np.maximum(x - base, 0)]) if len(lengths) else np.ones(len(x), dtype=np.int64)
    while len(left):
        a, b = size(left), size(right)
        now = np.where((a > 0) & (b > 0), a + b, 0)
        if (now == lengths).all():
            break
        lengths = now
    return lengths


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for: all rules' expansions are laid out once, then one table lookup."""
    lengths = rule_lengths(left, right, base)
    flat = np.concatenate([np.arange(base, dtype=np.int32), np.zeros(int(lengths.sum()), dtype=np.int32)])
    start = np.concatenate([np.arange(base, dtype=np.int64), base + np.cumsum(lengths) - lengths])
    size = np.concatenate([np.ones(base, dtype=np.int64), lengths])
    done = np.zeros(len(left), dtype=bool)
    while not done.all():
        ready = ~done & np.where(left < base, True, done[np.maximum(left - base, 0)]) & np.where(right < base, True, done[np.maximum(right - base, 0)])
        k = np.flatnonzero(ready)
        for side, shift in ((left[k], np.zeros(len(k), dtype=np.int64)), (right[k], size[left[k]])):
            to = gather(np.arange(len(flat), dtype=np.int64), start[base + k] + shift, size[side])
            flat[to] = gather(flat, start[side], size[side])
        done |= ready
    return gather(flat, start[symbols], size[symbols])


# ---- files --------------------------------------------------------------------------------------------------


def _block(shard: int, block: int, doc_ids: list, sizes: list[int], ids: np.ndarray, base: int, end_id: int) -> dict:
    symbols, left, right = compress(ids, base, end_id)
    lengths = np.concatenate([np.ones(base, dtype=np.int64), rule_lengths(left, right, base)])
    ends = np.searchsorted(np.cumsum(lengths[symbols]), np.cumsum(sizes)) + 1
    known = np.array([d is None for d in doc_ids])
    return {
        "shard": shard, "block": block, "doc_ids": np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), "doc_ids_null": np.packbits(known).tobytes(), "ends": ends.astype("<u4").tobytes(),
        "left": left.astype("<u4").tobytes(), "right": right.astype("<u4").tobytes(), "rule_lengths": lengths[base:].astype("<u4").tobytes(),
        "symbols_low": (symbols & 0xFFFF).astype("<u2").tobytes(), "symbols_high": (symbols >> 16).astype("u1").tobytes(), "n_tokens": int(len(ids)),
    }


def _blocks(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"shard": pa.int32(), "block": pa.int32(), "n_tokens": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=kinds.get(k, pa.binary())) for k in rows[0]], names=list(rows[0]))


def write_token_file(docs: DataFrame, path: str, vocabulary: str, ranks: str | None, vocabulary_size: int, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode ``doc_id, text`` and write the file at ``path``: shards hold ascending ranges of ``doc_id``.

    The ranges come from counts of ``doc_id`` and bytes over all rows; equal ids stay in one range.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    shards = min(MOST_SHARDS, max(1, -(-int(total) // shard_bytes)))
    bounds = docs.stat.approxQuantile("doc_id", [k / shards for k in range(1, shards)], 0.1 / shards) if shards > 1 else []
    bounds = sorted(set(int(b) for b in bounds))
    ids = F.array(*[F.lit(b) for b in bounds]) if bounds else None
    shard = F.size(F.filter(ids, lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    dealt = docs.withColumn("shard", F.coalesce(F.when(F.col("doc_id").isNotNull(), shard), F.lit(0))).repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(vocabulary, ranks)
        shard, block, doc_ids, sizes, held, count = None, 0, [], [], [], 0
        for batch in batches:
            found, offsets = encoder.encode(batch.column(1).to_pylist())
            for doc_id, at, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                if held and (at != shard or count >= BLOCK_IDS):
                    yield _blocks([_block(shard, block, doc_ids, sizes, np.concatenate(held), vocabulary_size, end_id)])
                    block = block + 1 if at == shard else 0
                    doc_ids, sizes, held, count = [], [], [], 0
                shard = at
                doc_ids.append(doc_id)
                sizes.append(b - a + 1)
                held += [found[a:b], np.array([end_id], dtype=np.int32)]
                count += b - a + 1
        if held:
            yield _blocks([_block(shard, block, doc_ids, sizes, np.concatenate(held), vocabulary_size, end_id)])

    dealt.mapInArrow(tidy(run), FILE_SCHEMA).write.mode("overwrite").option("compression", "zstd").parquet(path)


def open_block(row: dict, base: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, symbol ends, symbols, left, right) of a file row."""
    ids = np.frombuffer(row["doc_ids"], "<i8")
    null = np.unpackbits(np.frombuffer(row["doc_ids_null"], "u1"), count=len(ids))
    symbols = np.frombuffer(row["symbols_low"], "<u2").astype(np.int32) | np.frombuffer(row["symbols_high"], "u1").astype(np.int32) << 16
    return [None if n else i for i, n in zip(ids.tolist(), null.tolist())], np.frombuffer(row["ends"], "<u4").astype(np.int64), symbols, np.frombuffer(row["left"], "<u4").astype(np.int32), np.frombuffer(row["right"], "<u4").astype(np.int32)


def read_document(row: dict, index: int, base: int) -> np.ndarray:
    """Random access: the ids of one document of a file row, expanding nothing else."""
    _, ends, symbols, left, right = open_block(row, base)
    return expand(symbols[(ends[index - 1] if index else 0) : ends[index]], left, right, base)


def read_token_file(spark: SparkSession, path: str, vocabulary_size: int, digest: bool = False) -> DataFrame:
    """Rows (shard, block, pos, doc_id, tokens) of a file; with ``digest`` n_tokens and ids_crc32 in place of the tokens."""
    schema = "shard int, block int, pos int, doc_id long, " + ("n_tokens long, ids_crc32 long" if digest else "tokens array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, ends, symbols, left, right = open_block(row, vocabulary_size)
                ids = expand(symbols, left, right, vocabulary_size).astype("<u4")
                lengths = np.concatenate([np.ones(vocabulary_size, dtype=np.int64), np.frombuffer(row["rule_lengths"], "<u4").astype(np.int64)])
                to = np.cumsum(lengths[symbols])[ends - 1]
                pieces = [ids[a:b] for a, b in zip([0, *to[:-1].tolist()], to.tolist())]
                n = len(doc_ids)
                first = [pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(doc_ids, pa.int64())]
                if digest:
                    rest = [pa.array([len(x) for x in pieces], pa.int64()), pa.array([zlib.crc32(x) for x in pieces], pa.int64())]
                    names = ["shard", "block", "pos", "doc_id", "n_tokens", "ids_crc32"]
                else:
                    rest = [pa.array([x.astype(np.int32) for x in pieces], pa.list_(pa.int32()))]
                    names = ["shard", "block", "pos", "doc_id", "tokens"]
                yield pa.RecordBatch.from_arrays(first + rest, names=names)

    return spark.read.parquet(path).mapInArrow(tidy(run), schema)


def with_starts(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Add ``start``: ids of all documents before, by ascending shard, block and position.

    Only the blocks' token counts (one row for each million ids) meet in one window; inside a block a running sum suffices.
    """
    blocks = spark.read.parquet(path).select("shard", "block", F.col("n_tokens").alias("block_tokens"))
    before = blocks.select("shard", "block", (F.sum("block_tokens").over(Window.orderBy("shard", "block")) - F.col("block_tokens")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("shard", "block").orderBy("pos")) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(before, ["shard", "block"]).withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    scratch, size = Scratch(spark, "tokenfile"), 50257
    path = scratch.path("ids")
    write_token_file(table(spark, sf_dir, "documents"), path, public_path("byte_bpe_50k.json"), public_path("byte_bpe_50k.tiktoken"), size)
    rows = read_token_file(spark, path, size, digest=True)
    return with_starts(spark, path, rows).select("doc_id", "start", "n_tokens", "ids_crc32")
