"""Answers enter the memory of the next turn; a stream and a batch agree; personal data is never kept."""

from pathlib import Path

from pyspark.sql import functions as F

from groundspark import api
from groundspark.functions import routing
from groundspark.operators import dialogue, embed

TURNS = "conv_id long, turn long, text string"
SAID = [
    (1, 0, "which one has a lock-in?"), (1, 1, "and its exit load?"), (1, 5, "my PAN is ABCDE1234F, its nav?"), (3, 0, None), (4, 1, "its nav?"),
    (2, 5, "exit load of Acorn Overnight Fund"), (2, 6, "service down please, minimum sip"), (2, 7, "its benchmark?"),
]


def told(asked):
    """Names a scheme in the answer to one question, and fails for another."""
    q = F.col("question")
    category = routing.classify(q)
    outcome = F.when(category != "factual", "refused").when(q.contains("service down"), "unavailable").otherwise("answered")
    answer = F.when(q.contains("lock-in"), "Acorn Gilt Fund has none.").when(outcome == "unavailable", "Acorn Arbitrage Fund is not to be remembered").otherwise(F.concat(F.lit("said: "), q))
    return asked.select("query_id", category.alias("category"), outcome.alias("outcome"), answer.alias("answer"), F.lit("https://www.example.com").alias("citation"))


def rows(df):
    return sorted(map(tuple, df.select("conv_id", "turn", "question", "resolved", "inherited", "category", "outcome", "answer").collect()))


def test_answers_are_remembered_and_streams_agree(spark, tmp_path):
    turns = spark.createDataFrame(SAID, TURNS)
    whole = rows(dialogue.converse(turns, told, str(tmp_path / "whole")))
    by = {(r[0], r[1]): r for r in whole}
    assert len(by) == len(SAID) and by[1, 0][5] == "advisory" and by[1, 1][4] == "Acorn Gilt Fund"  # "which one": a refusal is remembered too
    assert by[1, 5][5] == "pii" and by[1, 5][2] == "[withheld: pan]" and by[4, 1][4] is None
    assert by[2, 7][4] == "Acorn Overnight Fund" and by[2, 7][3] == "What is the benchmark for Acorn Overnight Fund?"
    source = tmp_path / "turns"
    for part in (lambda t: t < 6, lambda t: t >= 6):  # two files, in order
        spark.createDataFrame([r for r in SAID if part(r[1])], TURNS).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(str(source))
        query = dialogue.converse_stream(stream, told, str(tmp_path / "stream"))
        query.awaitTermination()
    streamed = dialogue.said(spark, str(tmp_path / "stream"))
    assert rows(streamed) == whole and streamed.select("batch").distinct().count() == 2
    again = dialogue.converse(spark.createDataFrame([r for r in SAID if r[1] >= 6], TURNS), told, str(tmp_path / "stream"), batch=1)
    assert rows(again) == [r for r in whole if r[1] >= 6] and rows(dialogue.said(spark, str(tmp_path / "stream"))) == whole
    kept = dialogue.memory(spark, str(tmp_path / "whole"))
    assert not [r for r in kept.collect() if "PAN" in r["text"] or "withheld" in r["text"] or "not to be remembered" in r["text"]]
    assert not [p for p in Path(tmp_path / "whole").rglob("*") if p.is_file() and b"ABCDE1234F" in p.read_bytes()]
    assert dialogue.converse(turns.limit(0), told, str(tmp_path / "none")).collect() == []


def test_live_conversation_over_a_collection(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "All schemes", "The exit load of Acorn Gilt Fund is 1%.", "https://www.example.com/gilt", "Gilt", "2024-05-01"), ("b", "All schemes", "The benchmark is the index.", "https://www.example.com/i", "Index", "2024-05-01")], "chunk_id string, scheme string, text string, source_url string, page_title string, fetched_at string")
    embedder = embed.HashingEmbedder(128)
    stored = embed.embed(chunks, embedder)
    turns = spark.createDataFrame([(1, 0, "What is the exit load of Acorn Gilt Fund?"), (1, 1, "and its exit load?")], TURNS)
    found = {r["turn"]: r for r in api.converse_live(turns, stored, str(tmp_path / "c"), embedder=embedder).collect()}
    assert found[0]["outcome"] == "answered" and "1%" in found[0]["answer"] and found[1]["inherited"] == "Acorn Gilt Fund" and found[1]["outcome"] == "answered"
