"""Both limits of chunks, and many needles in one pass."""

import random

import pytest
from pyspark.sql import functions as F

from groundspark.config import DEFAULT
from groundspark.operators import chunk, needles


def made(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "naïve", "x" * rng.choice([3, 9, 40]), "1,234.5%", "-", "it's", "中文字符", "e.g.", "Ω_Ω"])
    return rng.choice([" ", "  ", "\n"]).join(word() for _ in range(n))


@pytest.mark.parametrize("spans", [None, chunk.piece_spans, lambda t: [(k, k + 1) for k, c in enumerate(t) if not c.isspace()]])
def test_no_part_breaks_a_limit_and_no_word_is_lost(spans):
    for seed in range(40):
        text = made(seed, random.Random(seed).choice([0, 1, 7, 90, 400]))
        for most_words, most_tokens in ((160, 256), (10, 30), (1, 5), (50, 8)):
            parts = chunk.fit_limits(text, most_words, most_tokens, spans)
            assert "".join("".join(parts).split()) == "".join(text.split())  # every sign, in order
            for p in parts:
                assert len(p.split()) <= most_words and (spans is None or len(spans(p)) <= most_tokens)
    assert chunk.fit_limits("one two", 5, 5, chunk.piece_spans) == ["one two"] and chunk.fit_limits("a\n  b", 5, 5, chunk.piece_spans) == ["a\n  b"]


def test_a_tables_header_stands_before_every_part():
    header = "Scheme NAV"
    table = header + " " + " ".join(f"{k}.5" for k in range(300))
    lead = " ".join(chunk.lead_of(table.split(), DEFAULT))
    parts = chunk.fit_limits(table, 160, 120, chunk.piece_spans)
    assert len(parts) > 4 and all(p.startswith(lead) for p in parts) and all(len(chunk.piece_spans(p)) <= 120 for p in parts)
    told = [w for k, p in enumerate(parts) for w in p.split()[0 if k == 0 else len(lead.split()) :]]
    assert told == table.split()


def test_chunks_of_documents_keep_both_limits(spark):
    docs = [(k, [made(k, 300), "HEADING " + str(k), made(k + 50, 20), "a | b | c\n" * 80]) for k in range(6)]
    found = chunk.chunk_documents(spark.createDataFrame(docs, "doc_id long, blocks array<string>")).collect()
    assert all(len(r["text"].split()) <= DEFAULT.chunk_max_words and len(chunk.piece_spans(r["text"])) <= DEFAULT.max_embed_tokens for r in found)
    for k, blocks in docs:
        said = " ".join(r["text"] for r in sorted((r for r in found if r["doc_id"] == k), key=lambda r: r["chunk_pos"]))
        assert set(" ".join(blocks).split()) - {w for w in " ".join(blocks).split() if len(w) > 30} <= set(said.split())


def test_query_of_limits_on_a_table(spark, tmp_path):
    from groundspark.plans import catalogue

    texts = [made(k, 500) for k in range(4)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.QUERIES["chunk_limits"](spark, str(tmp_path)).collect()
    assert found and all(r["n_words"] <= DEFAULT.chunk_max_words and r["n_tokens"] <= DEFAULT.max_embed_tokens for r in found)


def test_tokenizers_files_give_spans():
    path = "/opt/tokenizers/byte_bpe_50k.json"
    pytest.importorskip("tokenizers")
    try:
        open(path).close()
    except OSError:
        pytest.skip("no tokenizer here")
    spans = chunk.tokenizer_spans(path)
    parts = chunk.fit_limits(made(3, 200), 60, 40, spans)
    assert all(len(spans(p)) <= 40 for p in parts) and "".join("".join(parts).split()) == "".join(made(3, 200).split())


def test_needles_equal_contains(spark, monkeypatch):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choices("abé ", k=n))
    listed = [(k, some(rng.choice([1, 2, 3, 6]))) for k in range(300)] + [(300, ""), (301, "a"), (302, "a")]
    texts = [(k, some(40)) for k in range(50)] + [(50, None), (51, ""), (52, "zzz")]
    df = spark.createDataFrame(texts, "doc_id long, t string")
    wanted = {k: [n for n, x in sorted(listed) if x and t and x in t] for k, t in texts}
    for size in (needles.GROUP_BYTES, 300):
        monkeypatch.setattr(needles, "GROUP_BYTES", size)
        found = needles.needles_in(df, F.col("t"), listed)
        assert {r["doc_id"]: r["needles"] for r in found.collect()} == wanted
    assert {tuple(r["needles"]) for r in needles.needles_in(df, F.col("t"), [(1, "")]).collect()} == {()}
    table = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "k long, x string")
    assert needles.needles_of(table, "k", "x") == [(1, "abc")]
    with pytest.raises(ValueError, match="more than"):
        needles.needles_of(table, "k", "x", 2)


def test_results_leave_in_small_batches(spark):
    """A task gives back text as it goes, and not all results of ten thousand rows at once."""
    import pyarrow as pa

    from groundspark.operators import chunk, flat, html

    docs = spark.range(0, 4, 1, 1).selectExpr("id as doc_id", "array('a heading:', 'two words') as blocks")
    pages = spark.range(0, 4, 1, 1).selectExpr("id as page_id", "if(id = 3, null, concat('<body><p>', repeat('many words here. ', 20), '</p></body>')) as html")
    for found, rows in ((chunk.chunk_documents(docs), 4), (html.page_blocks(pages), 3)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == rows and "ArrowEvalPython" not in plan and "MapInArrow" in plan
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(["x" * 100_000] * 100)], names=["k", "t"])
    sizes = [b.num_rows for b in flat.flat_batches(iter([batch]), lambda t: iter([(t,), ("y",)]), ["k", "out"])]
    assert sum(sizes) == 200 and max(sizes) <= 24
