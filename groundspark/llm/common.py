"""Shared plumbing of the training-data operators: reading, Arrow batches, shared scratch tables."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; long texts make batches of few rows, so that a worker's memory stays bounded.
ARROW_ROWS, ARROW_BYTES = 4096, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the dataset, read by Spark only (the path may be one that local file calls can't open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes too: a batch of very long texts must not fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of our own only where the session names none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "groundspark-shared")
    return found


class Scratch:
    """Written tables in the shared folder that cut lineage; ``drop`` frees one as soon as nothing needs it.

    What a result still reads lives as long as the application: the file system removes the folder when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        path, files = self._files()
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _files(self, part: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(part) if part else self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, part: str) -> str:
        return f"{self.root}/{part}"

    def keep(self, df: DataFrame, part: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(part))
        # shuffle files of what is done go as soon as the driver's collector finds their plans unused; otherwise they may fill disks
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.parquet(self.path(part))

    def drop(self, part: str = "") -> None:
        path, files = self._files(part)
        files.delete(path, True)


#: Keys that a table may hold more often than one in so many rows, and the least number of rows that makes a key hot.
HOT_KEYS, LEAST_HOT = 1000, 1000


def hot_keys(counted: DataFrame, key: str, times: str = "count", least_hot: int = LEAST_HOT) -> list:
    """Keys of ``counted`` (key, times) that hold over 1 / HOT_KEYS of all rows: fewer than HOT_KEYS, however large the table."""
    most = max(least_hot, (counted.agg(F.sum(times)).first()[0] or 0) // HOT_KEYS)
    return [r[0] for r in counted.filter(F.col(key).isNotNull() & (F.col(times) > most)).select(key).collect()]


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", hot: list | None = None, least_hot: int = LEAST_HOT) -> DataFrame:
    """``left`` (a written table) joined with ``right``, which has one row a key; no task gets all rows of a hot key.

    The rows of ``right`` for hot keys (see ``hot_keys``) are broadcast; all others are joined as the planner likes.
    """
    if hot is None:
        hot = hot_keys(left.groupBy(key).count(), key, least_hot=least_hot)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    spread = left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how)
    return spread.unionByName(left.filter(~F.coalesce(is_hot, F.lit(False))).join(right.filter(~is_hot), key, how))


def release() -> None:
    """Give freed memory back to the system: a worker serves many stages, and what one has freed must not count against the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and then ``release``."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str) -> DataFrame:
    """One output batch for each input batch; ``None`` for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                if out is not None and out.num_rows:
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(tidy(run), schema)


def cut(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Slices of ``values`` between consecutive offsets."""
    return [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def ramp(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of ``lengths``, end to end."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    starts = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) - np.repeat(starts, lengths)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of values[s:s+n] for each start and length, without a Python loop."""
    lengths = np.asarray(lengths, dtype=np.int64)
    ends = np.cumsum(lengths)
    return values[np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lengths), lengths)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (fixed published multipliers)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
