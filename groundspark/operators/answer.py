"""From questions and hits to answers: context, citation, generation behind an interface, contract."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.config import DEFAULT, DEMO, EngineConfig, Profile
from groundspark.functions.contract import is_decline, ungrounded_figures, verify
from groundspark.functions.routing import classify, clarification, names_supported_topic, probable_scheme, refusal
from groundspark.functions.urls import is_allowed_url
from groundspark.operators.cache import lookup, request_key
from groundspark.operators.search import above_floor, retrieve

SYSTEM = "Answer from the numbered context only, in three sentences or fewer, with one link from it and no advice. Say so where it does not hold the answer."
DECLINED = "That information is not in the sources that I have."


class Generator(Protocol):
    name: str

    def complete(self, questions: list[str], contexts: list[str]) -> list[str]: ...


class Extractive:
    """The first sentences of the best block that share a word with the question."""

    name = "extractive"

    def complete(self, questions: list[str], contexts: list[str]) -> list[str]:
        out = []
        for question, context in zip(questions, contexts):
            wanted = {w for w in question.lower().split() if len(w) > 3}
            body = context.split("\n", 1)[-1].replace("\n", " ")
            sentences = [s.strip() for s in body.replace("? ", ". ").replace("! ", ". ").split(". ") if s.strip()]
            chosen = [s for s in sentences if wanted & set(s.lower().split())][:2] or sentences[:1]
            out.append(". ".join(s.rstrip(".") for s in chosen) + "." if chosen else DECLINED)
        return out


def within_budget(hits: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Hits above the floor, by rank, while their texts fit; the first always stays, and the first that doesn't fit ends it."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.length("text") + config.context_block_overhead).over(w)
    return above_floor(hits, config).withColumns({"used_chars": used, "block_no": F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))}).filter((F.col("used_chars") <= config.max_context_chars) | (F.col("block_no") == 1))


def build_context(hits: DataFrame, config: EngineConfig = DEFAULT, profile: Profile = DEMO) -> DataFrame:
    """Rows (query_id, context, citation, fetched_at): numbered blocks, and the first hit whose source is allowed."""
    block = F.concat(F.format_string("[%d] %s | %s\n", F.col("block_no").cast("int"), F.col("page_title"), F.col("source_url")), F.col("text"))
    blocks = within_budget(hits, config).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", block.alias("b")))), lambda s: s["b"]), "\n\n").alias("context"))
    return blocks.join(pick_citation(hits, config, profile), "query_id", "left")


def pick_citation(hits: DataFrame, config: EngineConfig = DEFAULT, profile: Profile = DEMO) -> DataFrame:
    allowed = above_floor(hits, config).filter(is_allowed_url(F.col("source_url"), profile.allowed_domains))
    return allowed.groupBy("query_id").agg(F.min_by(F.struct(F.col("source_url").alias("citation"), "fetched_at"), "rank").alias("s")).select("query_id", "s.*")


def describe_error(message: Column) -> Column:
    return F.when(message.rlike("(?i)rate.?limit|429|quota"), "rate limit").when(message.rlike("(?i)api.?key|401|unauthori[sz]ed"), "key").otherwise("other")


def generate(asked: DataFrame, generator: Generator) -> DataFrame:
    """Add ``generated`` and ``error`` for ``question, context``, in batches; a batch that fails is asked one by one, and what fails again is a value."""

    def alone(question: str, context: str) -> tuple[str | None, str | None]:
        try:
            return generator.complete([question], [context])[0], None
        except Exception as error:  # noqa: BLE001  any failure of a model is an answer's state, not the batch's
            return None, f"{type(error).__name__}: {error}"

    @F.pandas_udf("generated string, error string")
    def completed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for questions, contexts in batches:
            pairs = list(zip(questions.tolist(), contexts.tolist()))
            try:
                rows = [(text, None) for text in generator.complete(*map(list, zip(*pairs)))] if pairs else []
            except Exception:  # noqa: BLE001
                rows = [alone(*pair) for pair in pairs]
            yield pd.DataFrame(rows, columns=["generated", "error"], dtype=object)

    return asked.withColumn("__told", completed("question", "context")).withColumns({"generated": F.col("__told.generated"), "error": F.col("__told.error")}).drop("__told")


def ask(questions: DataFrame, chunks: DataFrame, generator: Generator | None = None, cache: DataFrame | None = None, config: EngineConfig = DEFAULT, profile: Profile = DEMO) -> DataFrame:
    """Answers for a batch of ``query_id, question, embedding``.

    Refused and underspecified questions are settled by expressions and never reach the search; those without usable context
    never reach the generator; cached answers aren't generated again.
    Rows: query_id, question, category, outcome (answered, declined, refused, underspecified, no_context, unavailable), answer, citation, ungrounded, key, model.
    """
    generator = generator or Extractive()
    none, no_figures = F.lit(None).cast("string"), F.array().cast("array<string>")
    routed = questions.withColumn("category", classify(F.col("question"))).withColumn("on_topic", names_supported_topic(F.col("question")))
    columns = ["query_id", "question", "category", "outcome", "answer", "citation", "ungrounded", "key", "model"]
    plain = dict(citation=F.lit(profile.help_link), ungrounded=no_figures, key=none, model=none)
    refused = routed.filter("category <> 'factual'").withColumns(plain | {"outcome": F.lit("refused"), "answer": refusal(F.col("category"), profile)})
    vague = routed.filter("category = 'factual' and not on_topic").withColumns(plain | {"category": F.lit("underspecified"), "outcome": F.lit("underspecified"), "answer": clarification(probable_scheme(F.col("question"), profile), profile)})
    open_ = routed.filter("category = 'factual' and on_topic")
    hits = retrieve(open_.select("query_id", "question", "embedding"), chunks, config=config, profile=profile)
    contexts = build_context(hits, config, profile).filter("citation is not null")
    nothing = open_.join(contexts.select("query_id"), "query_id", "left_anti").withColumns(plain | {"outcome": F.lit("no_context"), "answer": F.lit(f"{DECLINED} {profile.help_link}")})
    key = request_key(F.lit(generator.name), F.lit(SYSTEM), F.concat_ws("\n", "question", "context"), F.lit(0.0), F.lit(512))
    asked = open_.join(contexts, "query_id").withColumn("key", key)
    if cache is None:
        done = generate(asked, generator)
    else:
        both = lookup(asked, cache)
        done = both.filter("cached_text is not null").withColumns({"generated": F.col("cached_text"), "error": none}).unionByName(generate(both.filter("cached_text is null"), generator)).drop("cached_text", "cached_model")
    checked = done.withColumn("v", verify(F.col("generated"), F.col("citation"), F.col("fetched_at"), F.col("context"), config, profile))
    failed = F.col("error").isNotNull()
    outcome = F.when(failed, "unavailable").when(~F.col("v.ok"), "refused").when(is_decline(F.col("v.answer"), config), "declined").otherwise("answered")
    told = F.when(failed, F.concat(F.lit("No answer could be written ("), describe_error(F.col("error")), F.lit(f"). {profile.help_link}"))).otherwise(F.col("v.answer"))
    cited = F.when(failed, F.lit(profile.help_link)).otherwise(F.col("v.citation"))
    answered = checked.withColumns({"outcome": outcome, "answer": told, "ungrounded": ungrounded_figures(F.col("generated"), F.col("context")), "model": F.lit(generator.name)}).withColumn("citation", cited)
    out = answered.select(*columns)
    for part in (refused, vague, nothing):
        out = out.unionByName(part.select(*columns))
    return out


def cacheable(answers: DataFrame) -> DataFrame:
    """Rows (key, text, model) worth keeping: generated, and with every figure grounded."""
    return answers.filter("key is not null and outcome <> 'unavailable' and size(ungrounded) = 0").select("key", F.col("answer").alias("text"), "model")
