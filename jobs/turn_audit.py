"""Audits the turns of conversations as they arrive: personal data, declined answers, advice and figures; a log without personal data stays.

A file stream over a folder of turns (conv_id, turn, role, text): each run takes the files that came since the last one, in bounded batches, and ends.  Output, all under one folder:

* ``turns/role=...``: conv_id, turn, pii, n_words, n_figures, declined, advice, text (withheld as a whole where it holds personal data);
* ``summary/role=...``: turns, withheld, declined, advised, figures of each role, of all turns so far;
* ``checkpoint``: which files were taken.

The stream's checkpoint and the sink's log together make every file count once, also after a lost driver; the summary is written anew from the turns each time.
Null text is empty; null or blank role is ``unknown``; figures, declines and advice are looked for in answers only.  Each row is a turn: a turn that stands in two files is there twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.functions import contract, routing, text
from jobs.common import command_line, log, named, table_or_none

TURNS = "conv_id long, turn long, role string, text string"
AUDITED = "conv_id long, turn long, pii string, n_words int, n_figures int, declined boolean, advice string, text string, role string"


def stream_path(path: str) -> str:
    """A pattern that fits just this path, which may then be a folder or a single file."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[{") else f"{path[:-1]}[{path[-1]}]"


def audited(turns: DataFrame) -> DataFrame:
    said, is_answer = F.coalesce("text", F.lit("")), F.coalesce(F.col("role") == "assistant", F.lit(False))
    return turns.select(
        "conv_id", "turn", routing.detect_pii(said).alias("pii"), text.word_count(said).alias("n_words"), F.when(is_answer, F.size(contract.figures(said))).otherwise(0).alias("n_figures"),
        (is_answer & contract.is_decline(said)).alias("declined"), F.when(is_answer, contract.find_advice(said)).alias("advice"), routing.redact(said).alias("text"), named("role").alias("role"),
    )


def summarised(turns: DataFrame) -> DataFrame:
    count = lambda condition, name: F.count_if(condition).alias(name)
    return turns.groupBy("role").agg(F.count("*").alias("turns"), count(F.col("pii").isNotNull(), "withheld"), count(F.col("declined"), "declined"), count(F.col("advice").isNotNull(), "advised"), F.sum("n_figures").alias("figures"))


def audit(spark: SparkSession, conversations: str, output: str, files_per_batch: int = 100) -> DataFrame:
    """Takes in the files that are new in ``conversations`` and returns all audited turns of the output."""
    source = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", files_per_batch).parquet(stream_path(conversations))
    sink = audited(source).writeStream.format("parquet").partitionBy("role").option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True)
    query = sink.start(f"{output}/turns")
    try:
        query.awaitTermination()
    finally:
        query.stop()
    read = sum(p["numInputRows"] for p in query.recentProgress)
    done = table_or_none(spark, f"{output}/turns", AUDITED)
    totals = summarised(done)
    totals.coalesce(1).write.mode("overwrite").partitionBy("role").parquet(f"{output}/summary")
    log.info("turn_audit: read %d new turns of %s, %s now holds %d", read, conversations, output, done.count())
    return done


if __name__ == "__main__":
    command_line("turn_audit", ("conversations", "output"), audit)
