"""Toxicity by compression distance.

Texts are coded word by word, 8 bytes (a hash) for each word, because zstandard can't express the match of a short word;
a match of a whole word then saves about half its code, and chance matches of letters don't exist.

Dictionaries.  zstandard's trainer makes one dictionary from the toxic and, apart from it, three from the ordinary documents of a sample that is
bounded in rows; texts of the sample are taken whole, and the trainer alone decides what a dictionary holds.  Its samples are a class's coded text
in pieces of two neighbouring words, each distinct pair once: a word that stands beside many others counts often, one in many copies of a text once.
The trainer drops some words, frequent ones too, depending on where they stand (in a trial 10 of the 100 most frequent), so ordinary text is trained on in three orders.  Dictionaries are loaded as
content, one after the other; their entropy tables, which describe one dictionary alone, are not used.

Scores.  A document is cut into windows of ``WINDOW_WORDS`` words, all of it.  A window's gain is its compressed length with the
ordinary dictionaries less that with the toxic one before them: what toxic text says about the window beyond ordinary text.  A
document's figures are its clear gains beyond those that as many windows of clean documents show by chance (in
standard deviations, so that a long clean text doesn't add up to a toxic one) and its number of windows, and a logistic curve over these gives the score.
The curve is calibrated in ``PARTS`` turns: the documents of one part get their figures from dictionaries trained on the other parts.

Defined cases: where the trainer refuses a sample as too small, all its pairs are the dictionary (and a warning is logged);
texts of under two words teach nothing; null or empty text has no window and gets the curve's value at gain 0; without both labels in the
sample every score is the share of toxic rows (0 if none); rows are scored one by one, so repeated rows get equal scores;
of labels that contradict each other toxic wins, and of several texts with one labelled id the smallest is used; an empty table gives no rows.
Labels, language, source and ids never enter a score.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from groundspark.llm.common import Scratch, bounded_batches, map_arrow, mix64, ramp, table, tidy
from groundspark.llm.words import NOT_LETTER, word_hashes

#: Bound of the sample: labelled documents of each class (those with the least hashes of their ids); their texts are taken whole.
SAMPLE_DOCS = 3000
#: Bytes of the toxic and of each ordinary dictionary.
TOXIC_BYTES, ORDINARY_BYTES = 16 << 10, 128 << 10
#: Parts of the sample that calibrate in turn.
PARTS = 3
#: Level 5 is the first that indexes every position of a dictionary; a gain over ``CLEAR`` bytes counts as clear.
WINDOW_WORDS, LEVEL, CLEAR = 24, 5, 3
#: What toxic rows weigh together when thresholds are set (clean documents come first).
TOXIC_WEIGHT = 0.25
#: Standard deviation of a clean document's own rate of clear gains, as a share of the mean rate.
RATE_SPREAD = 0.5
FIGURES = 2
#: What is measured of a document: sum and sum of squares of its clear gains, windows, largest clear gain.
MEASURES = 4


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: list[float] = field(default_factory=lambda: [0.0] * FIGURES + [-50.0])
    #: Mean and variance of a clean window's clear gain.
    chance: tuple[float, float] = (0.0, 0.0)


def word_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(word codes of all texts, offsets of the texts); only letters make words."""
    return word_hashes([(t or "").lower() for t in texts], parts=NOT_LETTER)


def pairs(texts: list[str | None]) -> np.ndarray:
    """Rows (code, next code) of neighbouring words of one text, each distinct row once."""
    codes, offsets = word_codes(texts)
    inside = np.ones(max(len(codes) - 1, 0), dtype=bool)
    ends = offsets[1:-1]
    inside[ends[(ends > 0) & (ends < len(codes))] - 1] = False
    return _distinct(np.stack([codes[:-1], codes[1:]], axis=1)[inside])


def _distinct(found: np.ndarray) -> np.ndarray:
    """Distinct rows in the order of their hashes, which has nothing to do with the order of texts."""
    _, first = np.unique(mix64(mix64(found[:, 0]) + found[:, 1]), return_index=True)
    return found[first]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary that zstandard trains; of a sample that is too small for it, the sample."""
    try:
        return zstandard.train_dictionary(size, samples, k=8, d=8, f=22, accel=1).as_bytes()
    except zstandard.ZstdError as refused:
        logging.getLogger(__name__).warning("%d pairs of words are too few to train a dictionary (%s): they are the dictionary", len(samples), refused)
        return b"".join(samples)


def dictionaries(toxic: np.ndarray, ordinary: np.ndarray) -> tuple[bytes, bytes]:
    """(toxic, ordinary) contents from the classes' pairs."""
    samples = [row.tobytes() for row in _distinct(ordinary)]
    half = len(samples) // 2
    orders = (samples, samples[::-1], samples[half:] + samples[:half])
    return dictionary([row.tobytes() for row in _distinct(toxic)], TOXIC_BYTES), b"".join(dictionary(order, ORDINARY_BYTES) for order in orders)


class Scorer:
    """Compressors of a model; ``features(texts)`` gives a row for each text."""

    def __init__(self, model: Model):
        self.model = model
        self.compressors = [self._compressor(d) for d in (model.ordinary, model.toxic + model.ordinary)]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        lengths = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=lengths)

    def gains(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window of words."""
        segments = np.stack([starts * 8, lengths * 8], axis=1).astype("<u8").tobytes()
        buffer = zstandard.BufferWithSegments(codes.tobytes(), segments)
        sizes = []
        for compressor in self.compressors:
            result = compressor.multi_compress_to_buffer(buffer, threads=1)
            sizes.append(np.fromiter(map(len, result), np.int64, len(result)))
        return sizes[0] - sizes[1]

    def measures(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text, see ``MEASURES``."""
        codes, offsets = word_codes(texts)
        n_words = np.diff(offsets)
        counts = -(-n_words // WINDOW_WORDS)
        out = np.zeros((len(n_words), MEASURES))
        has = np.flatnonzero(counts)
        if not len(has) or not self.model.ordinary:
            return out
        inside = ramp(counts[has]) * WINDOW_WORDS
        starts = np.repeat(offsets[:-1][has], counts[has]) + inside
        gain = self.gains(codes, starts, np.minimum(WINDOW_WORDS, np.repeat(n_words[has], counts[has]) - inside)).astype(np.float64)
        at = (np.cumsum(counts) - counts)[has]
        clear = np.where(gain > CLEAR, gain, 0)
        out[has] = np.stack([np.add.reduceat(clear, at), np.add.reduceat(clear**2, at), counts[has], np.maximum.reduceat(clear, at)], axis=1)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        w = np.array(self.model.weights)
        z = figures(self.measures(texts), self.model.chance) @ w[:-1] + w[-1]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def figures(measured: np.ndarray, chance: tuple[float, float]) -> np.ndarray:
    """Columns: clear gains beyond chance (logarithm), number of windows (logarithm)."""
    total, _, windows, _ = measured.T
    beyond = (total - chance[0] * windows) / np.sqrt(1 + chance[1] * windows + (RATE_SPREAD * chance[0] * windows) ** 2)
    return np.stack([np.log1p(np.maximum(beyond, 0)), np.log1p(windows)], axis=1)


def chance_of(clean: np.ndarray) -> tuple[float, float]:
    """Mean and variance of a window's clear gain in measured clean documents, as if the largest gain had been seen once more (such gains are rare)."""
    once_more = max(clean[:, 3].max(initial=0), CLEAR)
    windows = 1 + clean[:, 2].sum()
    mean = (clean[:, 0].sum() + once_more) / windows
    return float(mean), float((clean[:, 1].sum() + once_more**2) / windows - mean**2)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights (last: intercept) by Newton steps; a class's total weight doesn't depend on its number of rows."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y == 1, TOXIC_WEIGHT / max(1, (y == 1).sum()), (1 - TOXIC_WEIGHT) / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        gradient = x1.T @ (share * (p - y)) + ridge * len(y) * np.append(w[:-1], 0)
        hessian = (x1.T * (share * p * (1 - p) + 1e-9)) @ x1 + np.diag([*[ridge * len(y)] * x.shape[1], 1e-9])
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


_SCORERS: dict[tuple, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    key = (hash(model.toxic), hash(model.ordinary), tuple(model.weights), model.chance)
    if key not in _SCORERS:
        if len(_SCORERS) > PARTS:
            _SCORERS.clear()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


def held_out(doc_id):
    """The fold that never trains: crc32 of the id's text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> Model:
    """Train on at most ``SAMPLE_DOCS`` labelled documents of each class, drawn by hash among all of them.

    Texts and their pairs stay with the workers, which train the dictionaries, a model in each task; dictionaries and the figures of
    calibrating documents come to the driver.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "toxicity")
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    draw = [usable.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS) for k in (0, 1)]
    chosen = spark.createDataFrame([tuple(r) for d in draw for r in d.collect()], "doc_id long, toxic int")
    sampled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    # equal texts are in one part
    sampled = scratch.keep(sampled.select("text", "toxic", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).withColumn("part", F.pmod("text_hash", F.lit(PARTS))), "sampled")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        toxic, part = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        kinds = [(t, p) for t in (0, 1) for p in range(PARTS)]
        found = [pairs(batch.column(0).filter(pa.array((toxic == t) & (part == p))).to_pylist()).astype("<u8").tobytes() for t, p in kinds]
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in kinds], pa.int32()), pa.array([p for _, p in kinds], pa.int64()), pa.array(found, pa.binary())], names=["toxic", "part", "pairs"])

    def train(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[list[np.ndarray]] = [[], []]
            for batch in batches:
                for kind, packed in zip(*[c.to_pylist() for c in batch.columns]):
                    held[kind].append(np.frombuffer(packed, "<u8").reshape(-1, 2))
            ordinary, toxic = (np.concatenate([np.zeros((0, 2), dtype=np.uint64), *h]) for h in held)
            held.clear()
            contents = dictionaries(toxic, ordinary) if len(ordinary) and len(toxic) else (b"", b"")
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *[pa.array([c], pa.binary()) for c in contents]], names=["number", "toxic", "ordinary"])

        return tidy(run)

    found = scratch.keep(map_arrow(sampled.select("text", "toxic", "part"), cut, "toxic int, part long, pairs binary"), "pairs")
    # dictionary k is trained without part k, the last one with all parts; a task each (the sample is bounded)
    tasks = [found.filter(F.col("part") != k).select("toxic", "pairs").coalesce(1).mapInArrow(train(k), "number int, toxic binary, ordinary binary") for k in range(PARTS + 1)]
    contents = {r["number"]: (bytes(r["toxic"]), bytes(r["ordinary"])) for r in reduce(DataFrame.unionByName, tasks).collect()}
    *models, model = [Model(*contents.get(k, (b"", b""))) for k in range(PARTS + 1)]

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        part, x = batch.column(3).to_numpy(), np.zeros((batch.num_rows, MEASURES))
        for k in np.unique(part).tolist():
            x[part == k] = _scorer(models[k]).measures(batch.column(0).filter(pa.array(part == k)).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *[pa.array(c) for c in x.T]], names=["toxic", "text_hash", *[f"m{k}" for k in range(MEASURES)]])

    schema = "toxic int, text_hash long, " + ", ".join(f"m{k} double" for k in range(MEASURES))
    measured = map_arrow(sampled.select("text", "toxic", "text_hash", "part"), measure, schema).collect()
    rows = {(r["text_hash"], r["toxic"]): [r[f"m{k}"] for k in range(MEASURES)] for r in measured}
    scratch.drop()
    y = np.array([k[1] for k in sorted(rows)])
    if not model.ordinary or len(np.unique(y)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Model(b"", b"", [0.0] * FIGURES + [float(np.log((share + 1e-9) / (1 - share + 1e-9)))])
    x = np.array([rows[k] for k in sorted(rows)])
    model.chance = chance_of(x[y == 0])
    model.weights = _logistic(figures(x, model.chance), y).tolist()
    return model


def with_scores(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and the score (0 to 1) as ``into``, which takes the place of a column of that name."""
    columns = [c for c in docs.columns if c != into]
    kept = docs.select(*columns)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = _scorer(model).score(batch.column(columns.index(text)).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*columns, into])

    return map_arrow(kept, run, StructType([*kept.schema.fields, StructField(into, DoubleType())]))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score of 0.5 or more go."""
    bounded_batches(spark)
    model = fit(docs, table(spark, sf_dir, "labels"))
    return with_scores(docs, model, into="__toxicity").filter("__toxicity < 0.5").select(*docs.columns)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    # scores are needed for texts only; the id rides along
    scored = with_scores(docs, model, into="score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
