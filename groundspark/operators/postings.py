"""The lexical side of re-ranking from a stored list of postings, so that no candidate's text is read or split again.

``write_postings`` keeps, for each chunk, its distinct words (``postings``: term, chunk_id, in_text, in_source, parted by a hash of the term and sorted by it) and
which of the profile's schemes its text names in full (``mentions``).  ``rerank_stored`` joins the candidates' question terms with these on (bucket, term, chunk_id): a
frequent word is no hot key, since the chunk is part of it, and only buckets of asked terms are opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.config import DEFAULT, DEMO, EngineConfig, Profile
from groundspark.functions.text import normalise, tokens
from groundspark.operators.search import ranked_by

BUCKETS = 64


def _bucket():
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")


def write_postings(chunks: DataFrame, path: str, names: tuple[str, ...] | None = None, profile: Profile = DEMO) -> None:
    """Postings of ``chunk_id, text, source_url, page_title``; ``names``: what may be mentioned (the profile's schemes)."""
    names = tuple(s.name for s in profile.schemes) if names is None else names
    keyed = chunks.withColumn("chunk_id", F.col("chunk_id").cast("string"))
    in_text, about = F.array_distinct(tokens(F.coalesce("text", F.lit("")))), F.array_distinct(tokens(F.concat_ws(" ", "source_url", "page_title")))
    each = keyed.select("chunk_id", in_text.alias("a"), about.alias("b")).select("chunk_id", "a", "b", F.explode(F.array_union("a", "b")).alias("term"))
    rows = each.select("term", "chunk_id", F.array_contains("a", F.col("term")).alias("in_text"), F.array_contains("b", F.col("term")).alias("in_source"))
    rows.withColumn("bucket", _bucket()).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    whole = normalise(F.col("text"))
    said = F.filter(F.array(*[F.when(whole.contains(normalise(F.lit(n))), F.lit(n)) for n in names]), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")
    keyed.select("chunk_id", "scheme", said.alias("mentions")).write.mode("overwrite").parquet(f"{path}/mentions")


def rerank_stored(spark: SparkSession, candidates: DataFrame, path: str, config: EngineConfig = DEFAULT, profile: Profile = DEMO) -> DataFrame:
    """What ``search.rerank`` adds, for ``query_id, window_id, chunk_id, similarity, terms, schemes`` of written chunks; also ``scheme``."""
    asked = candidates.select("query_id", "chunk_id", F.explode("terms").alias("term")).withColumn("bucket", _bucket())
    stored = spark.read.parquet(f"{path}/postings").join(F.broadcast(asked.filter("bucket >= 0").select("bucket").distinct()), "bucket", "left_semi")
    hits = asked.join(stored, ["bucket", "term", "chunk_id"]).groupBy("query_id", "chunk_id").agg(F.collect_list(F.when(F.col("in_text"), F.col("term"))).alias("found"), F.bool_or("in_source").alias("subject"))
    full = candidates.join(hits, ["query_id", "chunk_id"], "left").join(spark.read.parquet(f"{path}/mentions"), "chunk_id")
    matched = F.array_intersect("terms", F.coalesce("found", F.array().cast("array<string>")))
    names = F.arrays_overlap("mentions", "schemes") & (F.size("schemes") > 0)
    return ranked_by(full.withColumns({"matched_terms": matched, "names_scheme": F.coalesce(names, F.lit(False)), "subject": F.coalesce("subject", F.lit(False))}), config, profile).drop("found", "subject", "mentions")
