"""Checks and counts over chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.config import DEFAULT, DEMO, EngineConfig, Profile
from groundspark.functions.text import is_table_block, word_count
from groundspark.functions.urls import is_allowed_url
from groundspark.operators.embed import Embedder, embed
from groundspark.operators.running import running_sums
from groundspark.operators.search import nearest

_REQUIRED = ("chunk_id", "scheme", "doc_type", "source_url", "page_title", "fetched_at", "text")


def validate(chunks: DataFrame, config: EngineConfig = DEFAULT, profile: Profile = DEMO) -> DataFrame:
    """Rows (chunk_id, problem)."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in _REQUIRED]
    told = F.array(F.when(word_count(F.col("text")) > config.chunk_max_words, F.lit("too many words")), F.when(~is_allowed_url(F.col("source_url"), profile.allowed_domains), F.lit("source not allowed")), *missing)
    rows = chunks.select("chunk_id", F.explode(F.filter(told, lambda x: x.isNotNull())).alias("problem"))
    twice = chunks.groupBy("chunk_id").count().filter("count > 1").select("chunk_id", F.lit("id is not unique").alias("problem"))
    return rows.unionByName(twice)


def counts(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.groupBy(key).agg(F.count("*").alias("n"))


def word_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, least, most and floored mean words, tables."""
    n = word_count(F.col("text"))
    return chunks.select(n.alias("w"), is_table_block(F.col("text")).alias("t")).agg(
        F.count("*").alias("n_chunks"), F.min("w").alias("min_words"), F.max("w").alias("max_words"), F.floor(F.sum("w") / F.greatest(F.count("*"), F.lit(1))).cast("long").alias("mean_words"), F.count_if("t").alias("n_tables")
    )


def fact_coverage(chunks: DataFrame, facts: dict[str, tuple[str, ...]] = DEMO.facts) -> DataFrame:
    """Rows (fact, n_chunks, n_schemes, found): one pass over the chunks, a column for each fact."""
    text = F.lower(F.col("text"))
    hits = F.filter(F.array(*[F.when(_any_of(text, needles), F.lit(name)) for name, needles in facts.items()]), lambda x: x.isNotNull())
    seen = chunks.select("scheme", F.explode(hits).alias("fact")).groupBy("fact").agg(F.count("*").alias("n_chunks"), F.countDistinct("scheme").alias("n_schemes"))
    named = chunks.sparkSession.createDataFrame([(n,) for n in facts], "fact string")
    return named.join(seen, "fact", "left").select("fact", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_schemes", F.lit(0)).alias("n_schemes"), F.col("n_chunks").isNotNull().alias("found"))


def _any_of(text, needles):
    out = F.lit(False)
    for needle in needles:
        out = out | text.contains(needle)
    return out


def cardinalities(chunks: DataFrame, vectors: DataFrame, stored: DataFrame, dim: int) -> DataFrame:
    """Rows (check, wanted, found, ok): a vector for each chunk, each of ``dim`` numbers, and every chunk in the collection."""
    sides = {"chunks": (chunks, F.lit(True)), "vectors": (vectors, F.coalesce(F.size("embedding") == dim, F.lit(False))), "stored": (stored, F.lit(True))}
    parts = [df.select(F.lit(name).alias("side"), fits.alias("fits")) for name, (df, fits) in sides.items()]
    counted = parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(*[F.count_if(F.col("side") == name).alias(name) for name in sides], F.count_if((F.col("side") == "vectors") & F.col("fits")).alias("fitting"))
    told = [("vectors", "chunks", "vectors"), ("widths", "vectors", "fitting"), ("stored", "chunks", "stored")]
    rows = F.array(*[F.struct(F.lit(check).alias("check"), F.col(wanted).alias("wanted"), F.col(found).alias("found")) for check, wanted, found in told])
    return counted.select(F.inline(rows)).withColumn("ok", F.col("wanted") == F.col("found"))


def sanity_check(collection: DataFrame, embedder: Embedder, config: EngineConfig = DEFAULT, profile: Profile = DEMO) -> DataFrame:
    """Rows (check, value, ok): the best hit of a question that the corpus answers beats that of an unrelated one, and reaches the floor."""
    asked = collection.sparkSession.createDataFrame(list(enumerate(profile.probes)), "query_id long, question string").withColumn("windows", F.lit(None).cast("array<array<string>>"))
    best = nearest(embed(asked, embedder, "question"), collection, 1).agg(*[F.max(F.when(F.col("query_id") == k, F.col("similarity"))).alias(name) for k, name in enumerate(("real", "unrelated"))])
    real, beaten = F.col("real"), F.col("real") > F.coalesce("unrelated", F.lit(-1.0))
    rows = [("ranking", real - F.col("unrelated"), beaten), ("floor", real, real >= config.min_similarity)]
    return best.select(F.inline(F.array(*[F.struct(F.lit(check).alias("check"), value.alias("value"), F.coalesce(ok, F.lit(False)).alias("ok")) for check, value, ok in rows])))


def render(chunks: DataFrame) -> DataFrame:
    """Rows (line_no, value) of a readable dump in ``chunk_id`` order, with a running total of characters."""
    summed = running_sums(chunks, {"line_no": F.lit(1), "chars": F.length("text")}, ("chunk_id",))
    total = F.col("chars") + F.length("text")
    return summed.select((F.col("line_no") + 1).alias("line_no"), F.concat_ws("\n", F.format_string("[%s] %s / %s (%d characters so far)", "chunk_id", "scheme", "section", total), F.col("text"), F.lit("")).alias("value"))
