"""The engine's front door: ingest sources, inspect a collection, retrieve, ask, converse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.config import DEFAULT, DEMO, EngineConfig, Profile
from groundspark.functions.text import clean_block
from groundspark.operators import answer, boilerplate, chunk, dialogue, embed, memory, report, search
from groundspark.sources import fetch, files


def ingest(spark: SparkSession, sources: DataFrame, collection: str, embedder: embed.Embedder | None = None, fetcher: fetch.Fetch = fetch.http_fetch, manifest: str | None = None, config: EngineConfig = DEFAULT, profile: Profile = DEMO) -> DataFrame:
    """Fetch, parse, clean, chunk, embed and store; returns the stored collection.

    Failed sources stand in the manifest and don't end the run; a page that the removal of boilerplate leaves without any block does.
    """
    embedder = embedder or embed.HashingEmbedder(config.embedding_dim)
    pages = fetch.loaded(fetch.fetched(sources, fetcher, config, profile), config).persist()
    if manifest:
        files.write_manifest(fetch.manifest(pages), manifest)
    ok = pages.filter("status = 'ok'")
    blocks = ok.select(F.col("url").alias("doc_id"), F.posexplode("blocks").alias("block_pos", "block")).withColumn("block", clean_block(F.col("block"))).filter("block <> ''").persist()
    kept = boilerplate.drop_boilerplate(blocks, config, profile).persist()
    empty = [r["doc_id"] for r in boilerplate.emptied(blocks, kept).limit(20).collect()]
    if empty:
        raise ValueError(f"nothing is left of {empty}")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block_pos", "block"))), lambda s: s["block"])
    chunks = chunk.chunk_documents(kept.groupBy("doc_id").agg(ordered.alias("blocks")), config)
    full = chunks.join(ok.select(F.col("url").alias("doc_id"), "scheme", "doc_type", F.col("url").alias("source_url"), F.col("title").alias("page_title"), F.date_format(F.current_date(), "yyyy-MM-dd").alias("fetched_at")), "doc_id")
    numbered = embed.embed(chunk.number_chunks(full), embedder).drop("doc_id", "chunk_pos")
    files.write_collection(numbered, collection, embedder.dim)
    for held in (kept, blocks, pages):
        held.unpersist()
    return files.open_collection(spark, collection)


def inspect(collection: DataFrame, embedder: embed.Embedder | None = None, config: EngineConfig = DEFAULT, profile: Profile = DEMO) -> DataFrame:
    """Rows (gate, subject, problem) of what is wrong with a collection: chunks, facts that nothing states, vectors, ranking; none if all is well."""
    embedder = embedder or embed.HashingEmbedder(config.embedding_dim)
    row = lambda gate, subject, problem: [F.lit(gate).alias("gate"), subject.alias("subject"), problem.alias("problem")]
    found = report.validate(collection, config, profile).select(*row("chunks", F.col("chunk_id"), F.col("problem")))
    facts = report.fact_coverage(collection, profile.facts).filter("not found").select(*row("facts", F.col("fact"), F.lit("no chunk states it")))
    counts = report.cardinalities(collection, collection.filter("embedding is not null"), collection, embedder.dim).filter("not ok").select(*row("counts", F.col("check"), F.format_string("%d of %d", "found", "wanted")))
    sane = report.sanity_check(collection, embedder, config, profile).filter("not ok").select(*row("sanity", F.col("check"), F.format_string("%.3f", "value")))
    return found.unionByName(facts).unionByName(counts).unionByName(sane)


def retrieve(questions: DataFrame, collection: DataFrame, embedder: embed.Embedder | None = None, top_k: int = 0, config: EngineConfig = DEFAULT, profile: Profile = DEMO) -> DataFrame:
    """Hits for a batch of ``query_id, question``."""
    return search.retrieve(embed.embed(questions, embedder or embed.HashingEmbedder(config.embedding_dim), "question"), collection, top_k, config, profile)


def ask(questions: DataFrame, collection: DataFrame, embedder: embed.Embedder | None = None, generator: answer.Generator | None = None, cache: DataFrame | None = None, config: EngineConfig = DEFAULT, profile: Profile = DEMO) -> DataFrame:
    """Answers for a batch of ``query_id, question``."""
    return answer.ask(embed.embed(questions, embedder or embed.HashingEmbedder(config.embedding_dim), "question"), collection, generator, cache, config, profile)


def converse(messages: DataFrame, collection: DataFrame, embedder: embed.Embedder | None = None, generator: answer.Generator | None = None, cache: DataFrame | None = None, config: EngineConfig = DEFAULT, profile: Profile = DEMO) -> DataFrame:
    """Answers to all user turns of ``conv_id, turn, role, text``: follow-ups are asked with the scheme that stored earlier turns are about.

    Turns with personal data are refused and never part of the memory that later turns see.  Ids lie below 2 ** 43, turns below 2 ** 20.
    """
    asked = messages.filter("role = 'user'").select("conv_id", "turn", "text")
    rewritten = memory.resolve_followups(messages, config, profile).select("conv_id", "turn", "resolved", "changed", "scheme")
    turns = asked.join(rewritten, ["conv_id", "turn"], "left").select((F.shiftleft(F.col("conv_id").cast("long"), 20) + F.col("turn")).alias("query_id"), "conv_id", "turn", F.coalesce("resolved", "text").alias("question"), F.coalesce("changed", F.lit(False)).alias("changed"), "scheme")
    answers = ask(turns.select("query_id", "question"), collection, embedder, generator, cache, config, profile)
    return turns.drop("question").join(answers, "query_id")


def converse_live(turns: DataFrame, collection: DataFrame, folder: str, batch: int = 0, embedder: embed.Embedder | None = None, generator: answer.Generator | None = None, cache: DataFrame | None = None, config: EngineConfig = DEFAULT, profile: Profile = DEMO) -> DataFrame:
    """Answers to user turns (conv_id, turn, text), each answer remembered by the turns behind it; see ``operators.dialogue``."""
    return dialogue.converse(turns, lambda asked: ask(asked, collection, embedder, generator, cache, config, profile), folder, batch, config, profile)
