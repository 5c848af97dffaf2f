"""Removal of blocks that repeat across or within documents, and of navigation furniture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.config import DEFAULT, DEMO, EngineConfig, Profile
from groundspark.functions.text import let, tokens


def leading_shingle(block: Column, config: EngineConfig = DEFAULT) -> Column:
    """The first words of a block; null for short blocks, which are exempt."""
    return let(tokens(block), lambda t: F.when(F.size(t) >= config.shingle_least_words, F.array_join(F.slice(t, 1, config.shingle_words), " ")))


def repeat_share(block: Column, config: EngineConfig = DEFAULT) -> Column:
    """The share of a block's words inside windows that it holds twice or more."""
    n = config.shingle_words

    def covered(t: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.struct(F.array_join(F.slice(t, i, n), " ").alias("w"), i.alias("i")))

        def of_sorted(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["w"] == x["w"])) | (F.get(s, k + 1)["w"] == x["w"]))
            return let(F.array_sort(F.transform(twice, lambda x: x["i"])), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - x, F.lit(n)))), F.lit(0), lambda a, x: a + x))

        return F.when(F.size(t) < n, F.lit(0.0)).otherwise(let(F.array_sort(windows), of_sorted) / F.size(t))

    return let(tokens(block), covered)


def is_furniture(block: Column, config: EngineConfig = DEFAULT, profile: Profile = DEMO) -> Column:
    """Long, of navigation words, and repeating itself."""
    known = F.array(*[F.lit(w) for w in profile.chrome_vocabulary])
    share = let(tokens(block), lambda t: F.when(F.size(t) > 0, F.size(F.filter(t, lambda x: F.array_contains(known, x))) / F.size(t)).otherwise(F.lit(0.0)))
    return (F.size(tokens(block)) > config.shingle_words) & (share >= config.chrome_vocabulary_share) & (repeat_share(block, config) >= config.self_repeat_share)


def boilerplate_shingles(blocks: DataFrame, config: EngineConfig = DEFAULT, profile: Profile = DEMO) -> DataFrame:
    """Rows (shingle, reason) for ``doc_id, block``: in several documents, several times in one, or furniture."""
    keyed = blocks.select("doc_id", leading_shingle(F.col("block"), config).alias("shingle"), is_furniture(F.col("block"), config, profile).alias("furniture")).filter("shingle is not null")
    per_doc = keyed.groupBy("shingle", "doc_id").agg(F.count("*").alias("n"), F.bool_or("furniture").alias("furniture"), F.count_if(~F.col("furniture")).alias("plain"))
    found = per_doc.groupBy("shingle").agg(F.count_if(F.col("plain") > 0).alias("docs"), F.max("plain").alias("most"), F.bool_or("furniture").alias("furniture"))
    return found.filter("docs > 1 or most > 1 or furniture").select("shingle", F.when(F.col("furniture"), "furniture").when(F.col("docs") > 1, "shared").otherwise("repeated").alias("reason"))


def drop_boilerplate(blocks: DataFrame, config: EngineConfig = DEFAULT, profile: Profile = DEMO) -> DataFrame:
    """The blocks (all columns) whose leading shingle is no boilerplate; Spark broadcasts the list of shingles only if it is small."""
    keyed = blocks.withColumn("__shingle", leading_shingle(F.col("block"), config))
    bad = boilerplate_shingles(blocks, config, profile).select(F.col("shingle").alias("__shingle"))
    return keyed.join(bad, "__shingle", "left_anti").drop("__shingle")


def emptied(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids of documents that lost all their blocks; a load with such documents should be held back."""
    return before.select("doc_id").distinct().join(after.select("doc_id").distinct(), "doc_id", "left_anti")
