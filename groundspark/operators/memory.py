"""Conversation memory over (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundspark.config import DEFAULT, DEMO, EngineConfig, Profile
from groundspark.functions.followup import resolve
from groundspark.functions.routing import detect_pii, detect_scheme


def storable(messages: DataFrame) -> DataFrame:
    """Trimmed messages without blank ones and ones with personal data."""
    return messages.withColumn("text", F.trim("text")).filter((F.col("text") != "") & detect_pii(F.col("text")).isNull())


def buffer(messages: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """The newest messages of each conversation."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return storable(messages).withColumn("place", place).filter(F.col("place") <= max(0, config.memory_max_messages)).drop("place")


def with_referent(messages: DataFrame, config: EngineConfig = DEFAULT, profile: Profile = DEMO, scheme=None) -> DataFrame:
    """Add ``referent``: the scheme that stored earlier turns are about (the newest user turn naming one, else any turn)."""
    kept = storable(messages).withColumn("named", detect_scheme(F.col("text"), profile) if scheme is None else scheme)
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-config.memory_max_messages, -1)
    of_user = F.last(F.when(F.col("role") == "user", F.col("named")), ignorenulls=True).over(w)
    return kept.withColumn("referent", F.coalesce(of_user, F.last("named", ignorenulls=True).over(w))).drop("named")


def resolve_followups(messages: DataFrame, config: EngineConfig = DEFAULT, profile: Profile = DEMO) -> DataFrame:
    """User turns with their rewritten question."""
    asked = with_referent(messages, config, profile).filter("role = 'user'")
    return asked.withColumn("r", resolve(F.col("text"), F.col("referent"), config, profile)).select("conv_id", "turn", "text", "referent", "r.*")


def transcript(messages: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """One text for each conversation's buffer."""
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return buffer(messages, config).groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))
