"""Keeps a table of retrieval chunks up to date with a growing table of documents, reading only what is new.

A document whose id is over the high-water mark is new.  Its lines are cleaned, furniture goes, texts that the chunks already hold are skipped (of copies the smallest id stays),
the rest is cut into windows of words, and chunks with personal data are withheld as a whole.  Output, all under one folder:

* ``chunks/batch=.../scheme=...``: doc_id, pos, lang, text, n_words, pii, doc_digest;
* ``marks/batch=...``: low, high, n_docs, n_chunks of each finished run.  The mark is the largest ``high``.

A run names its batch after the mark that it starts from, writes its chunks by dynamic partition overwrite, and its mark last; readers take only batches with a mark.  So a run that
was cut short leaves nothing visible, and the next one writes the same batch again.  Rows that arrive during a run are left to the next.  Two runs at a time aren't meant.

Ids must grow: a row with an id at or under the mark isn't seen again, nor is a row without an id.  Null text is empty and gives no chunk; null or blank lang is the scheme ``unknown``;
an empty table writes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from groundspark.functions import routing, text
from jobs.common import command_line, log, made, named

CHUNKS = "doc_id long, pos int, lang string, text string, n_words int, pii string, doc_digest string, batch string, scheme string"
MARKS = "low long, high long, n_docs long, n_chunks long, batch string"


def committed(spark: SparkSession, output: str) -> DataFrame:
    """The chunks of all finished runs; files of other batches aren't opened."""
    marks = spark.read.schema(MARKS).parquet(f"{output}/marks").select("batch")
    return spark.read.schema(CHUNKS).parquet(f"{output}/chunks").join(F.broadcast(marks), "batch", "left_semi")


def chunks_of(docs: DataFrame, chunk_max_words: int) -> DataFrame:
    """Rows of ``CHUNKS`` but batch, for ``doc_id, lang, text, doc_digest``."""
    lines = F.filter(F.transform(F.split(text.plain_spaces(F.col("text")), "\n"), text.strip), lambda x: (x != "") & ~text.is_furniture(x))
    cut = docs.select("doc_id", "lang", "doc_digest", F.posexplode(text.word_windows(F.array_join(lines, " "), chunk_max_words)).alias("pos", "chunk"))
    told = cut.withColumn("pii", routing.detect_pii(F.col("chunk")))  # once; a window's words stand one space apart
    return told.select("doc_id", "pos", "lang", routing.withheld(F.col("chunk"), F.col("pii")).alias("text"), F.size(F.split("chunk", " ")).alias("n_words"), "pii", "doc_digest", named("lang").alias("scheme"))


def finish(spark: SparkSession, output: str, mark: tuple) -> None:
    """Make a batch visible."""
    spark.createDataFrame([mark], MARKS).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/marks")


def refresh(spark: SparkSession, documents: str, output: str, chunk_max_words: int = 160) -> DataFrame:
    """Takes in what is new in ``documents`` (doc_id, text, lang) and returns all chunks of the output."""
    made(spark, f"{output}/chunks", CHUNKS, "batch", "scheme")
    made(spark, f"{output}/marks", MARKS, "batch")
    low = spark.read.schema(MARKS).parquet(f"{output}/marks").agg(F.max("high")).first()[0]
    source = spark.read.parquet(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    new = source.filter("doc_id is not null") if low is None else source.filter(F.col("doc_id") > low)
    high = new.agg(F.max("doc_id")).first()[0]
    if high is None:
        log.info("corpus_refresh: nothing in %s over mark %s", documents, low)
        return committed(spark, output)
    batch = "start" if low is None else f"after{low}"
    read, wrote = Observation("read"), Observation("wrote")
    taken = new.filter(F.col("doc_id") <= high).observe(read, F.count(F.lit(1)).alias("n"))
    # the planner's partial aggregation leaves one row of a large group of copies in each task
    distinct = taken.groupBy(F.sha2("text", 256).alias("doc_digest")).agg(F.min(F.struct("doc_id", "lang", "text")).alias("d")).select("d.*", "doc_digest")
    held = committed(spark, output).filter("pos = 0").select("doc_digest")
    chunks = chunks_of(distinct.join(held, "doc_digest", "left_anti"), chunk_max_words).withColumn("batch", F.lit(batch)).observe(wrote, F.count(F.lit(1)).alias("n"))
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "scheme").parquet(f"{output}/chunks")
    finish(spark, output, (low, high, read.get["n"], wrote.get["n"], batch))
    log.info("corpus_refresh: read %d documents (%s to %d) of %s, wrote %d chunks as batch %s of %s", read.get["n"], low, high, documents, wrote.get["n"], batch, output)
    return committed(spark, output)


if __name__ == "__main__":
    command_line("corpus_refresh", ("documents", "output"), refresh)
