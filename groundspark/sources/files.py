"""Readers and writers of sources, manifests, chunks and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.functions.vectors import norm
from groundspark.operators.report import render
from groundspark.schema import MANIFEST, SOURCES


def read_sources(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The CSV of sources; ``limit`` takes the first rows of the file (0 or none: all)."""
    found = spark.read.schema(SOURCES).csv(path, header=True, multiLine=True, quote='"', escape='"')
    return found.limit(limit) if limit else found


def write_manifest(results: DataFrame, path: str) -> None:
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    results.select(*names).write.mode("overwrite").csv(path, header=True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).csv(path, header=True)


def write_raw(docs: DataFrame, path: str) -> None:
    """One row for each URL, so sources that share a scheme and kind don't overwrite each other."""
    docs.dropDuplicates(["url"]).write.mode("overwrite").parquet(path)


def parse_header(raw):
    """A map of the ``# KEY: value`` lines before the rule of dashes."""
    head = F.split(raw, "\n-{8,}", 2)[0]
    keys = F.regexp_extract_all(head, F.lit(r"(?m)^# ([^:\n]+):[ \t]*(.*)$"), F.lit(1))
    values = F.regexp_extract_all(head, F.lit(r"(?m)^# ([^:\n]+):[ \t]*(.*)$"), F.lit(2))
    return F.map_from_arrays(F.transform(keys, F.lower), values)


def write_chunks_text(chunks: DataFrame, path: str) -> None:
    render(chunks).orderBy("line_no").select("value").write.mode("overwrite").text(path)


def write_collection(chunks: DataFrame, path: str, dim: int) -> None:
    """Replace a collection: chunks with vectors of one length, parted by scheme so that filters prune files."""
    checked = chunks.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector's length is not {dim}"))))
    checked.write.mode("overwrite").partitionBy("scheme").parquet(path)


def open_collection(spark: SparkSession, path: str) -> DataFrame:
    """The collection; fails where there is none."""
    return spark.read.parquet(path)


def collection_size(spark: SparkSession, path: str) -> int:
    return open_collection(spark, path).count()


def disk_usage(spark: SparkSession, path: str) -> int:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def vector_preview(chunks: DataFrame, dims: int = 10, rows: int = 5) -> DataFrame:
    return chunks.orderBy("chunk_id").limit(rows).select("chunk_id", F.slice("embedding", 1, dims).alias("first"), F.round(norm(F.col("embedding")), 6).alias("norm"), F.substring("text", 1, 100).alias("text"))
