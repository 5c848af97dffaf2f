"""A stored approximate index of vectors: an inverted file, parted by cell, of which a search reads the cells nearest to each question.

Centres are fitted by spherical k-means on a bounded sample (``sample_rows`` of the rows, in the order of a hash of their ids, thus the same for the same table); all rows are then assigned
to their nearest centre and written with ``partitionBy("cell")``, so cells that no question probes aren't opened.  How many cells a question probes is calibrated at build time: rows of the
sample are asked exactly, and the number of cells is taken that holds the share ``target`` of their true neighbours.

A search deals whole cells to tasks, which pack them into blocks; a block of questions, each with its cells as bits, meets every block, and a task scores each cell of a block for the questions
that probe it.  So a question's vector isn't copied to its cells, and a task gives the best few of a block, not of each cell.

Folders: ``cells/cell=.../``, ``centres``, ``about`` (one row: dim, cells, probes, target, expected).  Vectors that are null, zero or not finite take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from groundspark.operators import search
from groundspark.operators.search import CHUNK_BLOCK, EVERYTHING, MOST_BROADCAST, QUESTION_BLOCK, TILE

#: Bound on the sample that centres are fitted on, on centres, and on the rows that calibrate (all are held by the driver).
SAMPLE_ROWS, MOST_CELLS, CALIBRATING = 32_768, 4096, 256
_ABOUT = "dim int, cells int, probes int, target double, expected double"


def _unit(values: np.ndarray) -> np.ndarray:
    return values / np.maximum(np.linalg.norm(values, axis=1), 1e-300)[:, None]


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Unit centres by rounds of assignment and mean; a centre that loses its rows takes the row that is worst off."""
    rng = np.random.default_rng(seed)
    rows = _unit(sample)
    cells = min(cells, len(rows))
    centres = rows[np.sort(rng.choice(len(rows), cells, replace=False))]
    for _ in range(rounds):
        similarity = rows @ centres.T
        owner = similarity.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, rows)
        empty = np.flatnonzero(np.bincount(owner, minlength=cells) == 0)
        sums[empty] = rows[np.argsort(similarity.max(axis=1), kind="stable")[: len(empty)]]
        centres = _unit(sums)
    return centres


def usable(chunks: DataFrame) -> DataFrame:
    """Rows whose vector has a direction."""
    size = F.aggregate(F.col("embedding"), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return chunks.filter((size > 0) & (size < float("inf")))


def with_cell(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """All columns, and the nearest centre as ``cell``."""
    at = chunks.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((values @ centres.T).argmax(axis=1).astype(np.int32))], names=[*batch.schema.names, "cell"])

    return chunks.mapInArrow(run, StructType([*chunks.schema.fields]).add("cell", "integer"))


def _parts(spark: SparkSession, rows: int, block: int) -> int:
    """Tasks for an even deal of rows: of at most ``block`` rows or so, and no fewer than run at a time, if there are rows for these."""
    return max(-(-rows // block), min(spark.sparkContext.defaultParallelism, -(-rows // 256)), 1)


def packed_cells(rows: DataFrame) -> DataFrame:
    """Rows (key, ids, cells, vectors) of up to ``CHUNK_BLOCK`` rows (chunk_id, cell, embedding) of one task, by their ids; ``vectors`` are unit vectors of doubles, end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids = table.column(0).combine_chunks()
            order = pc.array_sort_indices(ids)
            values = table.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)[order.to_numpy()]
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(order))
            cells = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), table.column(1).combine_chunks().take(order))
            return pa.RecordBatch.from_arrays([pa.array([EVERYTHING]), listed, cells, pa.array([memoryview(_unit(values)).cast("B")], pa.binary())], names=["key", "ids", "cells", "vectors"])

        total = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, min(CHUNK_BLOCK - total, batch.num_rows - at))
                held.append(part)
                at, total = at + part.num_rows, total + part.num_rows
                if total == CHUNK_BLOCK:
                    yield packed()
                    total = 0
        if held:
            yield packed()

    return rows.mapInArrow(run, "key string, ids array<string>, cells array<int>, vectors binary")


def _score_cells(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """For pairs of blocks (ids, cells, vectors, asked), the best ``n`` of each question in those cells that it probes."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, cells, asked = batch.column(0)[k].values, batch.column(1)[k].values.to_numpy(), batch.column(3)[k].values
            if not len(asked):
                continue
            query, window = asked.field(0).to_numpy(), asked.field(1).to_numpy()
            vectors = asked.field(2).flatten().to_numpy(zero_copy_only=False).reshape(len(asked), -1)
            chunks = np.frombuffer(batch.column(2)[k].as_buffer(), dtype=np.float64).reshape(-1, vectors.shape[1])
            probed = np.stack([np.frombuffer(b.as_buffer(), np.uint8) for b in asked.field(3)])
            order = np.argsort(cells, kind="stable")
            runs = np.split(order, np.flatnonzero(np.diff(cells[order])) + 1)
            for a in range(0, len(asked), TILE[0]):
                bits = probed[a : a + TILE[0]]
                top = search.best_of(vectors[a : a + TILE[0]], n)
                for rows in runs:
                    cell = int(cells[rows[0]])
                    only = np.flatnonzero(bits[:, cell >> 3] >> (7 - (cell & 7)) & 1)
                    for first in range(0, len(rows) if len(only) else 0, TILE[1]):
                        places = rows[first : first + TILE[1]]
                        top.add(chunks[places], places, only)
                if top.held:
                    at, similarity, i = top.prune()
                    yield pa.RecordBatch.from_arrays([pa.array(query[a + at]), pa.array(window[a + at]), ids.take(pa.array(i)), pa.array(similarity)], names=["query_id", "window_id", "chunk_id", "similarity"])


@dataclass(frozen=True)
class VectorIndex:
    """An index that stands at ``path``."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, chunks: DataFrame, path: str, cells: int = 0, target: float = 0.95, n: int = 10, sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
        """Index ``chunks`` (chunk_id, embedding, and any other columns but cell); the default number of cells is the square root of the rows."""
        spark = chunks.sparkSession
        rows = usable(chunks).withColumn("chunk_id", F.col("chunk_id").cast("string"))
        count = rows.count()
        if not count:
            raise ValueError("no vector to index")
        cells = min(MOST_CELLS, cells or max(1, round(count**0.5)), sample_rows)
        picked = rows.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding")).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample_rows).select("embedding").toArrow()
        sample = picked.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(picked.num_rows, -1)
        centres = fit_centres(sample, cells)
        # an even deal, however few files the rows lie in
        with_cell(rows.repartition(_parts(spark, count, CHUNK_BLOCK)), centres).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
        spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        index = cls(spark, path)
        probes, expected = index._calibrated(_unit(sample[:CALIBRATING]), centres, n, target)
        about = spark.createDataFrame([(sample.shape[1], len(centres), probes, target, expected)], _ABOUT)
        about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        return index

    def about(self) -> dict:
        return self.spark.read.schema(_ABOUT).parquet(f"{self.path}/about").first().asDict()

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    def centres(self) -> np.ndarray:
        """All centres: at most ``MOST_CELLS`` vectors."""
        return np.array([r["centre"] for r in self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()], dtype=np.float64)

    def _calibrated(self, asked: np.ndarray, centres: np.ndarray, n: int, target: float) -> tuple[int, float]:
        """(cells to probe, share of true neighbours in these): the place of each true neighbour's cell in the order of its question's cells."""
        questions = self.spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(asked)], "query_id long, embedding array<double>")
        near = self._exact(questions, n).join(self.rows().select("chunk_id", "cell"), "chunk_id").select("query_id", "cell").collect()
        order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(centres))[None, :], axis=1)
        places = np.sort([int(place[r["query_id"], r["cell"]]) for r in near])
        probes = int(places[min(len(places) - 1, int(np.ceil(target * len(places))) - 1)]) + 1
        return probes, float((places < probes).mean())

    def _exact(self, questions: DataFrame, n: int, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
        asked = questions.select("query_id", "embedding", F.lit(None).cast("array<array<string>>").alias("windows"))
        return search.nearest(asked, self.rows().select("chunk_id", F.lit("").alias("scheme"), "embedding"), n, most_broadcast)

    def nearest(self, questions: DataFrame, n: int, probes: int = 0, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
        """Rows (query_id, window_id, chunk_id, similarity) of the best ``n`` in the ``probes`` cells nearest to each question (0: as calibrated), of ``query_id, embedding``."""
        centres = self.centres()
        probes = min(len(centres), probes or self.about()["probes"])
        if probes == len(centres):  # nothing to leave out: no question is copied to cells
            return self._exact(usable(questions), n, most_broadcast)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    cells = np.argsort(-(_unit(values) @ centres.T), axis=1, kind="stable")[:, :probes]
                    bits = np.zeros((batch.num_rows, len(centres)), dtype=np.uint8)
                    np.put_along_axis(bits, cells, 1, axis=1)
                    probed = pa.array([b.tobytes() for b in np.packbits(bits, axis=1)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([EVERYTHING] * batch.num_rows), batch.column(0), batch.column(1), probed], names=["key", "query_id", "embedding", "probed"])

        count = questions.count()
        asked = usable(questions).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        probed = asked.repartition(_parts(self.spark, count, QUESTION_BLOCK)).mapInArrow(run, "key string, query_id long, embedding array<double>, probed binary")
        return self._found(probed, count, n, most_broadcast)

    def _found(self, probed: DataFrame, size: int, n: int, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
        """``probed``: key, query_id, embedding, and the cells that a question probes as bits, the first of them the highest of the first byte."""

        def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = None
            for batch in batches:
                for bits in batch.column(0):
                    seen = np.frombuffer(bits.as_buffer(), np.uint8) | (0 if seen is None else seen)
            if seen is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(np.unpackbits(seen)), pa.int32())], names=["cell"])

        # only cells that some question probes are opened
        seen = probed.select("probed").mapInArrow(cells_of, "cell int").filter("cell >= 0").distinct()
        rows = self.rows().join(F.broadcast(seen), "cell", "left_semi")
        sizes = self.rows().groupBy("cell").agg(F.ceil(F.count("*") / CHUNK_BLOCK).alias("several"))
        dealt = rows.join(F.broadcast(sizes), "cell").repartition(_parts(self.spark, self.rows().count(), CHUNK_BLOCK // 2), "cell", F.pmod(F.xxhash64("chunk_id"), "several"))
        packed = packed_cells(dealt.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("cell").cast("int").alias("cell"), "embedding"))
        keyed = probed.select("key", "query_id", F.lit(0).alias("window_id"), "embedding", "probed")
        return search.met(keyed, packed, _score_cells, n, size, most_broadcast)
