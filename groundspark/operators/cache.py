"""Content-addressed cache of generated answers, as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.schema import CACHE


def request_key(model: Column, system: Column, user: Column, temperature: Column, max_tokens: Column, version: int = 1) -> Column:
    """A hash of all that decides an answer, field names in alphabetical order."""
    fields = F.struct(max_tokens.alias("max_tokens"), model.alias("model"), system.alias("system"), temperature.alias("temperature"), user.alias("user"), F.lit(version).alias("v"))
    return F.sha2(F.to_json(fields), 256)


def lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """``requests`` (with ``key``) and the cached ``text`` and ``model``; blank entries are misses."""
    usable = cache.filter(F.trim("text") != "").dropDuplicates(["key"]).select("key", F.col("text").alias("cached_text"), F.col("model").alias("cached_model"))
    return requests.join(usable, "key", "left")


def store(answers: DataFrame, path: str) -> None:
    """Append answers that aren't blank and aren't there yet; two first hex digits part the files."""
    spark = answers.sparkSession
    new = answers.select("key", "text", "model").filter(F.trim("text") != "").dropDuplicates(["key"]).join(load(spark, path).select("key"), "key", "left_anti")
    new.withColumn("shard", F.substring("key", 1, 2)).write.mode("append").partitionBy("shard").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The cache; empty where there is none yet."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)


def clear(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
