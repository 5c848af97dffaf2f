"""Running sums and postings against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from groundspark.operators import chunk, postings, report, running, search


@pytest.mark.parametrize("range_rows", [7, 1 << 20])
def test_running_sums_equal_a_loop(spark, range_rows):
    rng = random.Random(6)
    rows = [(rng.choice([None, "a", "b", "b", "b"]), k, rng.choice([None, 1, -2, 5_000_000_000])) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(5)
    found = running.running_sums(df, {"before": F.col("v"), "place": F.lit(1)}, ("g", "k"), range_rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" in plan
    got = {(r["g"], r["k"]): (r["before"], r["place"]) for r in found.collect()}
    total = 0
    for place, (g, k, v) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))):
        assert got[g, k] == (total, place)
        total += v or 0
    assert len(running.range_bounds(df, ("g", "k"), 9)) == 8
    empty = running.running_sums(df.limit(0), {"before": F.col("v")}, ("g", "k"), range_rows)
    assert empty.columns == ["g", "k", "v", "before"] and empty.count() == 0


def test_chunk_numbers_and_dumps_need_no_single_task(spark):
    chunks = spark.createDataFrame([(d, p, "A b", f"text {d} {p}") for d in range(30) for p in range(d % 4)], "doc_id long, chunk_pos int, scheme string, text string")
    numbered = chunk.number_chunks(chunks)
    assert "SinglePartition" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert [r["chunk_id"] for r in numbered.orderBy("doc_id", "chunk_pos").collect()] == [f"a-b-{k + 1:04d}" for k in range(chunks.count())]
    dump = report.render(numbered.withColumn("section", F.lit("s")))
    assert "SinglePartition" not in dump._jdf.queryExecution().executedPlan().toString()
    lines = dump.orderBy("line_no").collect()
    assert [r["line_no"] for r in lines] == list(range(1, len(lines) + 1)) and f"({sum(len(r['text']) for r in chunks.collect())} characters so far)" in lines[-1]["value"]


def test_stored_postings_give_the_same_ranks(spark, tmp_path):
    rng = random.Random(2)
    words = "exit load ratio fund the of expense units acorn gilt overnight riskometer été".split()
    rows = [(f"c{k:02d}", rng.choice(["All schemes", "Acorn Gilt Fund", "Acorn Overnight Fund"]), None if k == 5 else " ".join(rng.choices(words, k=9)) + rng.choice(["", " Acorn Gilt Fund."]), f"https://www.example.com/{rng.choice(words)}", None if k % 3 else "Exit page") for k in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id string, scheme string, text string, source_url string, page_title string")
    postings.write_postings(chunks, str(tmp_path / "p"))
    candidates = spark.createDataFrame([(q, k % 2, f"c{k:02d}", rng.random(), terms, schemes) for q, (terms, schemes) in enumerate([(["riskometer", "exit"], ["Acorn Gilt Fund"]), ([], []), (["zzz"], ["Acorn Overnight Fund", "Acorn Gilt Fund"]), (["load", "été", "t"], [])]) for k in range(0, 60, q + 1)], "query_id long, window_id int, chunk_id string, similarity double, terms array<string>, schemes array<string>")
    columns = ["query_id", "chunk_id", "rank", "scheme", "matched_terms", "names_scheme", F.round("score", 9), F.round("best_similarity", 9)]
    of = lambda df: sorted(map(repr, df.select(*columns).collect()))
    stored = postings.rerank_stored(spark, candidates, str(tmp_path / "p"))
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "text" not in "".join(p.split("\n")[0] for p in plan.split("ReadSchema")[1:]).replace("in_text", "")
    assert of(stored) == of(search.rerank(candidates.join(chunks, "chunk_id")))
