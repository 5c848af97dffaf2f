"""Conversations in which each answer enters the memory that the next turn sees.

The n-th user turns of all conversations are answered together, as one batch, so there are as many rounds as the longest conversation has user turns.  What was said in a round is
written before the next begins: ``said/batch=.../round=...`` under the given folder holds question, resolved question, answer and outcome, and the memory is read from it.

What is remembered: a turn with personal data is answered by a refusal, and neither it nor the refusal is kept (its question is stored withheld, and no later turn sees it); where no
answer could be written, only the question is remembered; every other question is remembered as it was asked, with its answer.  A later batch (of a stream, say) sees all earlier ones
and writes its own again if it is run again, so a stream and one batch give equal rows if each conversation's turns arrive in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundspark.config import DEFAULT, DEMO, EngineConfig, Profile
from groundspark.functions.routing import redact
from groundspark.operators.memory import resolve_followups
from groundspark.schema import MESSAGES

SAID = "conv_id long, turn long, question string, resolved string, inherited string, category string, outcome string, answer string, citation string, batch int, round int"
#: (query_id, question) -> (query_id, category, outcome, answer, citation), one row each
Answers = Callable[[DataFrame], DataFrame]


def said(spark: SparkSession, folder: str) -> DataFrame:
    """All that was said so far."""
    spark.createDataFrame([], SAID).write.mode("ignore").partitionBy("batch", "round").parquet(f"{folder}/said")
    return spark.read.schema(SAID).parquet(f"{folder}/said")


def remembered(rows: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) that later turns may see; a question has an even place, its answer the odd one behind it."""
    kept = rows.filter("category <> 'pii'")
    questions = kept.select("conv_id", (2 * F.col("turn")).alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text"))
    answers = kept.filter("outcome <> 'unavailable'").select("conv_id", (2 * F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text"))
    return questions.unionByName(answers)


def converse(turns: DataFrame, answers: Answers, folder: str, batch: int = 0, config: EngineConfig = DEFAULT, profile: Profile = DEMO) -> DataFrame:
    """Rows of ``SAID`` for this batch of user turns (conv_id, turn, text).  Ids lie below 2 ** 43, turns below 2 ** 20."""
    spark = turns.sparkSession
    rounds = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    numbered = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("text", F.lit("")).alias("text")).withColumn("round", rounds)
    earlier = said(spark, folder).filter(F.col("batch") < batch)
    last = numbered.agg(F.max("round")).first()[0] or 0
    for k in range(1, last + 1):
        now = numbered.filter(F.col("round") == k)
        own = spark.read.schema(SAID).parquet(f"{folder}/said").filter((F.col("batch") == batch) & (F.col("round") < k))
        # only of conversations that go on
        seen = remembered(earlier.unionByName(own)).join(now.select("conv_id"), "conv_id", "left_semi")
        asked = now.select("conv_id", (2 * F.col("turn")).alias("turn"), F.lit("user").alias("role"), "text")
        rewritten = resolve_followups(seen.unionByName(asked), config, profile).select("conv_id", F.floor(F.col("turn") / 2).cast("long").alias("turn"), "resolved", "changed", "scheme")
        put = now.join(rewritten, ["conv_id", "turn"], "left").select("conv_id", "turn", "text", F.coalesce("resolved", "text").alias("resolved"), F.when(F.col("changed"), F.col("scheme")).alias("inherited"))
        keyed = put.withColumn("query_id", F.shiftleft(F.col("conv_id"), 20) + F.col("turn"))
        found = answers(keyed.select("query_id", F.col("resolved").alias("question"))).select("query_id", "category", "outcome", "answer", "citation")
        rows = keyed.join(found, "query_id").select("conv_id", "turn", redact(F.col("text")).alias("question"), redact(F.col("resolved")).alias("resolved"), "inherited", "category", "outcome", F.when(F.col("category") == "pii", redact(F.col("answer"))).otherwise(F.col("answer")).alias("answer"), "citation")
        rows.withColumns({"batch": F.lit(batch), "round": F.lit(k)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "round").parquet(f"{folder}/said")
    return spark.read.schema(SAID).parquet(f"{folder}/said").filter((F.col("batch") == batch) & (F.col("round") <= last))


def converse_stream(turns: DataFrame, answers: Answers, folder: str, config: EngineConfig = DEFAULT, profile: Profile = DEMO):
    """A started query over a stream of user turns: each micro-batch is a batch of ``converse``; it ends when all that is there is answered."""
    def step(rows: DataFrame, number: int) -> None:
        converse(rows, answers, folder, number, config, profile)

    return turns.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def memory(spark: SparkSession, folder: str) -> DataFrame:
    """The messages that the next turn of each conversation would see."""
    return remembered(said(spark, folder)).select(*[f.split()[0] for f in MESSAGES.split(", ")])
