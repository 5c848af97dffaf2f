"""Operators on small tables."""

import numpy as np
from pyspark.sql import functions as F

from groundspark import api
from groundspark.config import DEFAULT
from groundspark.operators import answer, boilerplate, cache, chunk, embed, html, memory, report, search
from groundspark.sources import fetch, files
from groundspark.streaming.conversation import remember

PAGE = """<html><head><title> Exit&nbsp;load  facts </title><style>x</style></head><body><nav><a>Home</a></nav><div class="cookie-bar">We use cookies</div>
<main><h1>Exit load</h1><p>The exit load is 1% within 12 months of purchase.</p><ul><li><p>nested once</p></li></ul><table><tr><th>Plan</th><td>1</td><td>2</td></tr></table>%s</main><footer>bottom</footer></body></html>"""


def test_html_blocks_and_fallback(spark):
    title, blocks = html.extract(PAGE.replace("%s", "<p>" + "More text about the load. " * 12 + "</p>"))
    assert title == "Exit load facts" and blocks[:4] == ["Exit load", "The exit load is 1% within 12 months of purchase.", "nested once", "Plan | 1 | 2"]
    assert not any("cookies" in b or "bottom" in b or "Home" in b for b in blocks)
    wrapped = '<body><div class="search-page">' + "<p>real words of the page here</p>" * 20 + "</div></body>"
    assert len(html.extract(wrapped)[1]) == 20
    assert html.decode("é€".encode()) == "é€" and html.decode(b"caf\xe9 \x93ok\x94") == "café “ok”" and html.decode(None) == ""
    assert html.extract("") == ("", []) and html.extract("<p>open <b>tags")[1] == ["open tags"]
    df = spark.createDataFrame([(bytearray(b"%PDF-1.4"), "text/html"), (bytearray(b"<html>"), "application/pdf; x"), (bytearray(b"<html>"), None)], "c binary, t string")
    assert [r["k"] for r in df.select(html.kind(F.col("c"), F.col("t")).alias("k")).collect()] == ["pdf", "pdf", "html"]
    assert html.pdf_blocks(["SCHEME FACTS\n\nline one\nline two\n\nA 1 2\nB 3 4"]) == ("SCHEME FACTS", ["SCHEME FACTS", "line one line two", "A 1 2\nB 3 4"])


def test_boilerplate_shared_repeated_and_furniture(spark):
    long, menu = " ".join(f"t{k}" for k in range(14)), "home menu about contact " * 6
    rows = [(1, long), (2, long + " more"), (3, "five words are too few"), (4, "five words are too few"), (5, "alone in here with six words"), (6, "twice in one document right here"), (6, "twice in one document right here"), (7, menu), (8, "kept text of the eighth document here")]
    blocks = spark.createDataFrame(rows, "doc_id long, block string")
    kept = boilerplate.drop_boilerplate(blocks)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 8]
    assert {r["shingle"][:5]: r["reason"] for r in boilerplate.boilerplate_shingles(blocks).collect()} == {"t0 t1": "shared", "twice": "repeated", "home ": "furniture"}
    assert sorted(r["doc_id"] for r in boilerplate.emptied(blocks, kept).collect()) == [1, 2, 6, 7]


def test_chunks_keep_words_headings_and_tables():
    blocks = ["Exit load:", "One sentence here. " * 100, "Fees", "More", "a | b | c\n1 | 2 | 3", "tail words.", "LAST HEADING"]
    chunks = chunk.chunk_blocks(blocks)
    assert chunks[0][1].startswith("Exit load:\nOne sentence") and all(len(t.split()) <= DEFAULT.chunk_max_words for _, t in chunks)
    assert ("Fees More", "Fees More\na | b | c\n1 | 2 | 3") in chunks and chunks[-1] == ("LAST HEADING", "LAST HEADING")
    second = chunks[1][1].split()
    assert second[:30] == chunks[0][1].split()[-30:]
    plain = chunk.chunk_blocks([" ".join(f"w{k}" for k in range(500)) + "."])
    parts = [t.split() for _, t in plain]
    assert parts[-1][:30] == parts[-2][-30:] and sum(parts[:-1], []) + parts[-1][30:] == [f"w{k}" for k in range(499)] + ["w499."]
    halves = chunk.fit_limits("a b c d e", 99, 4, lambda t: [(k, k + 1) for k, c in enumerate(t) if c != " " for _ in range(2)])
    assert " ".join(halves) == "a b c d e" and all(len(h.split()) <= 2 for h in halves)
    assert chunk.chunk_blocks([]) == [] and chunk.chunk_blocks(["", "  "]) == []
    table = chunk.split_table("H1 H2\n" + "\n".join(f"r{k} 1 2 3" for k in range(30)), 22)
    assert all(p.startswith("H1 H2\n") and len(p.split()) <= 22 for p in table) and sum(p.count("r") for p in table) == 30


def test_numbers_run_over_all_documents(spark):
    docs = spark.createDataFrame([(2, ["b one two.", "x"]), (1, ["a."]), (3, None)], "doc_id long, blocks array<string>")
    chunks = chunk.chunk_documents(docs).withColumn("scheme", F.lit("My Scheme"))
    assert [r["chunk_id"] for r in chunk.number_chunks(chunks).orderBy("chunk_id").collect()] == ["my-scheme-0001", "my-scheme-0002", "my-scheme-0003"]


def test_reports(spark):
    rows = [("a-1", "s", "k", "https://www.example.com/", "p", "", "d", "exit load 1%"), ("a-1", "s", "k", "https://bad.net/", "p", "", "d", "w " * 161), ("a-2", "t", "k", "https://example.org", None, "", "d", "x | y | z")]
    chunks = spark.createDataFrame(rows, "chunk_id string, scheme string, doc_type string, source_url string, page_title string, section string, fetched_at string, text string")
    assert sorted((r["chunk_id"], r["problem"]) for r in report.validate(chunks).collect()) == [("a-1", "id is not unique"), ("a-1", "source not allowed"), ("a-1", "too many words"), ("a-2", "page_title is missing")]
    assert tuple(report.word_stats(chunks).first()) == (3, 3, 161, 56, 1)
    cover = {r["fact"]: (r["n_chunks"], r["found"]) for r in report.fact_coverage(chunks, {"load": ("exit load",), "none": ("zzz",)}).collect()}
    assert cover == {"load": (1, True), "none": (0, False)}
    assert "(12 characters so far)" in report.render(chunks.limit(1)).first()["value"]


def searchable(spark, n=40, dim=8):
    rng = np.random.default_rng(1)
    names = ["Acorn Overnight Fund", "Acorn Gilt Fund", "All schemes"]
    rows = [(f"c{k:02d}", names[k % 3], rng.standard_normal(dim).tolist(), f"text {k} expense ratio" if k % 4 == 0 else f"text {k} Acorn Overnight Fund", "https://www.example.com/expense", f"page {k}", "2024-05-01") for k in range(n)]
    return spark.createDataFrame(rows, "chunk_id string, scheme string, embedding array<double>, text string, source_url string, page_title string, fetched_at string")


def test_search_equals_a_loop_and_batches_equal_single_questions(spark):
    chunks = searchable(spark)
    rng = np.random.default_rng(2)
    asked = [(1, "expense ratio of Acorn Overnight Fund and Acorn Gilt Fund", rng.standard_normal(8).tolist()), (2, "what is the exit load", rng.standard_normal(8).tolist())]
    questions = spark.createDataFrame(asked, "query_id long, question string, embedding array<double>")
    hits = search.retrieve(questions, chunks, top_k=5).orderBy("query_id", "rank").collect()
    data = [r.asDict() for r in chunks.collect()]
    for q, _, v in asked:
        own = [h for h in hits if h["query_id"] == q]
        sims = {d["chunk_id"]: float(np.dot(d["embedding"], v) / np.linalg.norm(d["embedding"]) / np.linalg.norm(v)) for d in data}
        assert all(abs(h["similarity"] - sims[h["chunk_id"]]) < 1e-12 for h in own)
        assert [h["score"] for h in own] == sorted((h["score"] for h in own), reverse=True)
        assert abs(own[0]["best_similarity"] - max(sims.values())) < 1e-12
        alone = search.retrieve(questions.filter(F.col("query_id") == q), chunks, top_k=5).orderBy("rank").collect()
        assert [h["chunk_id"] for h in own] == [h["chunk_id"] for h in alone]
    both = [h["scheme"] for h in hits if h["query_id"] == 1]
    assert len(both) >= 5 and {"Acorn Overnight Fund", "Acorn Gilt Fund"} <= set(both)
    assert len([h for h in hits if h["query_id"] == 2]) == 5
    row_bonus = [h for h in hits if h["query_id"] == 1 and h["scheme"] == "All schemes" and h["names_scheme"]]
    assert all(h["score"] > h["similarity"] + 0.39 for h in row_bonus)


def test_search_without_chunks_of_the_scheme_falls_back(spark):
    chunks = searchable(spark).filter("scheme = 'Acorn Gilt Fund'")
    questions = spark.createDataFrame([(1, "nav of Acorn Overnight Fund", [1.0] * 8)], "query_id long, question string, embedding array<double>")
    hits = search.retrieve(questions, chunks).collect()
    assert len(hits) == 6 and {h["scheme"] for h in hits} == {"Acorn Gilt Fund"}
    assert search.retrieve(questions.limit(0), chunks).count() == 0


def test_hashed_vectors_hold_every_word_of_long_documents(spark, tmp_path):
    from groundspark.plans import catalogue

    plain, late = "same " * 300, "same " * 300 + "alpha beta " * 200
    by_word = {w: embed.HashingEmbedder(64).encode([w])[0] for w in ("same", "alpha", "beta")}
    whole = 300 * by_word["same"] + 200 * by_word["alpha"] + 200 * by_word["beta"]
    assert abs(embed.HashingEmbedder(64).encode([late])[0] - whole / (whole @ whole) ** 0.5).max() < 1e-6
    spark.createDataFrame([(1, plain), (2, late), (3, plain), (4, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    digest = {r["doc_id"]: r["digest"] for r in catalogue.QUERIES["embed_hash"](spark, str(tmp_path)).collect()}
    assert digest[1] == digest[3] and len({digest[1], digest[2], digest[4]}) == 3


def test_terms(spark):
    df = spark.createDataFrame([("What is the expense ratio of Acorn Overnight Fund, a ratio?", ["Acorn Overnight Fund"])], "q string, s array<string>")
    assert df.select(search.content_terms(F.col("q"), F.col("s")).alias("t")).first()["t"] == ["expense", "ratio"]
    assert df.select(search.lexical_score(F.lit("Ratio only; expenses"), F.array(F.lit("expense"), F.lit("ratio"))).alias("x")).first()["x"] == 0.5
    assert df.select(search.lexical_score(F.lit("x"), F.array().cast("array<string>")).alias("x")).first()["x"] == 0


def test_context_budget_stops_at_the_first_overflow(spark):
    rows = [(1, k, f"c{k}", 0.9 - k / 100, "x" * n, "https://www.example.com/", "p", "d", 0.9) for k, n in enumerate((4000, 4000, 4000, 10), 1)] + [(2, 1, "d1", 0.9, "y" * 20000, "https://bad.net/", "p", "d", 0.9)]
    hits = spark.createDataFrame(rows, "query_id long, rank int, chunk_id string, similarity double, text string, source_url string, page_title string, fetched_at string, best_similarity double")
    assert sorted((r["query_id"], r["chunk_id"]) for r in answer.within_budget(hits).collect()) == [(1, "c1"), (1, "c2"), (2, "d1")]
    assert {r["query_id"]: r["citation"] for r in answer.pick_citation(hits).collect()} == {1: "https://www.example.com/"}


def test_memory_buffer_referents_and_stream(spark, tmp_path):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"message {k}") for k in range(24)] + [(2, 0, "user", "about Acorn Gilt Fund"), (2, 1, "assistant", "Acorn Overnight Fund too"), (2, 2, "user", "my otp is 445566"), (2, 3, "user", " "), (2, 4, "user", "its fees?")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    kept = memory.buffer(messages).collect()
    assert sorted(r["turn"] for r in kept if r["conv_id"] == 1) == list(range(14, 24)) and sorted(r["turn"] for r in kept if r["conv_id"] == 2) == [0, 1, 4]
    last = memory.resolve_followups(messages).filter("conv_id = 2 and turn = 4").first()
    assert last["referent"] == "Acorn Gilt Fund" and last["resolved"] == "What is the fees for Acorn Gilt Fund?"
    assert memory.transcript(messages.filter("conv_id = 2")).first()["transcript"].startswith("user: about Acorn")
    messages.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = remember(spark.readStream.schema(messages.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("update").format("memory").queryName("buffers").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r["turn"] for r in spark.table("buffers").filter("conv_id = 1").collect()) == list(range(14, 24))


def test_cache_keys_and_store(spark, tmp_path):
    key = lambda **changed: cache.request_key(*[F.lit(changed.get(n, v)) for n, v in (("model", "m"), ("system", "s"), ("user", "u"), ("temperature", 0.0), ("max_tokens", 5))])
    row = spark.range(1).select(key().alias("a"), key().alias("b"), key(user="v").alias("c"), key(model="n").alias("d"), key(system="t").alias("e"), key(temperature=0.5).alias("f")).first()
    assert row["a"] == row["b"] and len(set(row)) == 5
    path = str(tmp_path / "cache")
    cache.store(spark.createDataFrame([("aa1", "text", "m"), ("ab2", " ", "m")], "key string, text string, model string"), path)
    cache.store(spark.createDataFrame([("aa1", "other", "m"), ("ac3", "more", "m")], "key string, text string, model string"), path)
    assert sorted((r["key"], r["text"]) for r in cache.load(spark, path).collect()) == [("aa1", "text"), ("ac3", "more")]
    found = cache.lookup(spark.createDataFrame([("aa1",), ("zz",)], "key string"), cache.load(spark, path))
    assert {r["key"]: r["cached_text"] for r in found.collect()} == {"aa1": "text", "zz": None}
    cache.clear(spark, path)
    assert cache.load(spark, path).count() == 0


def site():
    """Stands for the network; made inside a function so that it travels to the workers by value."""

    def get(url):
        if "busy" in url:
            return 503, "text/html", b""
        if "gone" in url:
            return 200, "text/html", b"<title>Page not found</title><body><p>" + b"x " * 300 + b"</p></body>"
        name = url.rsplit("/", 1)[1]
        unique = " ".join(f"The {name} expense ratio of item {k} is {k}.{len(name)}% of assets." for k in range(30))
        return 200, "text/html", f"<title>{name} facts</title><body><main><p>Shared intro words that stand on each and every page of the site.</p><h2>Expense ratio</h2><p>{unique}</p></main></body>".encode()

    return get


def test_from_sources_to_answers(spark, tmp_path):
    from dataclasses import replace

    config = replace(DEFAULT, fetch_backoff=0.0, embedding_dim=64, min_similarity=0.05)
    (tmp_path / "sources.csv").write_text('url,scheme,doc_type,notes\nhttps://www.example.com/large,Acorn Overnight Fund,page,"a, b"\nhttps://www.example.com/small,Acorn Gilt Fund,page,\nhttps://bad.net/x,Acorn Gilt Fund,page,\nhttps://www.example.com/busy,Acorn Gilt Fund,page,\nhttps://www.example.com/gone,Acorn Gilt Fund,page,\n')
    sources = files.read_sources(spark, str(tmp_path / "sources.csv"))
    assert sources.count() == 5 and files.read_sources(spark, str(tmp_path / "sources.csv"), 2).count() == 2
    collection = api.ingest(spark, sources, str(tmp_path / "collection"), fetcher=site(), manifest=str(tmp_path / "manifest"), config=config, embedder=embed.HashingEmbedder(64))
    told = {r["url"].rsplit("/", 1)[1]: (r["status"], r["error"] or "") for r in files.read_manifest(spark, str(tmp_path / "manifest")).collect()}
    assert told["large"][0] == told["small"][0] == "ok" and told["x"] == ("error", "source not allowed") and told["busy"] == ("error", "status 503") and "does not exist" in told["gone"][1]
    texts = [r["text"] for r in collection.collect()]
    assert texts and not any("Shared intro" in t for t in texts) and files.collection_size(spark, str(tmp_path / "collection")) == len(texts) and files.disk_usage(spark, str(tmp_path / "collection")) > 0
    asked = spark.createDataFrame([(1, "What is the expense ratio of Acorn Overnight Fund?"), (2, "Should I invest?"), (3, "Acorn Overnight Fund"), (4, "mail me at a@b.org")], "query_id long, question string")
    found = {r["query_id"]: r for r in api.ask(asked, collection, embed.HashingEmbedder(64), config=config).collect()}
    assert found[1]["outcome"] == "answered" and found[1]["citation"] == "https://www.example.com/large" and "Last updated from sources:" in found[1]["answer"]
    assert (found[2]["category"], found[3]["outcome"], found[4]["category"]) == ("advisory", "underspecified", "pii") and "a@b.org" not in found[4]["answer"]
    kept = answer.cacheable(api.ask(asked, collection, embed.HashingEmbedder(64), config=config))
    again = {r["query_id"]: r for r in api.ask(asked, collection, embed.HashingEmbedder(64), cache=kept, config=config).collect()}
    assert again[1]["outcome"] == "answered" and again[1]["key"] == found[1]["key"]
    assert files.vector_preview(collection).count() == min(5, len(texts))
    told = {(r["gate"], r["subject"]) for r in api.inspect(collection, embed.HashingEmbedder(64), config).collect()}
    assert ("facts", "lock-in") in told and ("facts", "expense ratio") not in told and not any(gate in ("chunks", "counts") for gate, _ in told)
    said = [(7, 0, "user", "What is the expense ratio of Acorn Overnight Fund?"), (7, 1, "assistant", "It is 1.5%."), (7, 2, "user", "and its expense ratio?"), (7, 3, "user", "my otp is 445566"), (7, 4, "user", "what about it?"), (8, 0, "user", "its expense ratio?")]
    turns = {(r["conv_id"], r["turn"]): r for r in api.converse(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"), collection, embed.HashingEmbedder(64), config=config).collect()}
    assert len(turns) == 5 and turns[7, 2]["question"] == "What is the expense ratio for Acorn Overnight Fund?" and turns[7, 2]["citation"] == "https://www.example.com/large"
    assert turns[7, 3]["category"] == "pii" and (turns[7, 4]["changed"], turns[7, 4]["outcome"]) == (False, "underspecified") and not turns[8, 0]["changed"]


def faulty():
    """A generator that fails for one question; made inside a function so that it travels to the workers by value."""

    class Faulty:
        name = "faulty"

        def complete(self, questions, contexts):
            if any("exit load" in q for q in questions):
                raise RuntimeError("429: rate limit")
            return ["The expense ratio is 1%." for _ in questions]

    return Faulty()


def test_a_generators_failure_is_a_value(spark):
    chunks = searchable(spark).withColumn("embedding", F.array_repeat(F.lit(1.0), 8))
    asked = spark.createDataFrame([(1, "expense ratio?", [1.0] * 8), (2, "exit load?", [1.0] * 8)], "query_id long, question string, embedding array<double>").coalesce(1)
    answers = answer.ask(asked, chunks, faulty())
    found = {r["query_id"]: r for r in answers.collect()}
    assert found[1]["outcome"] == "answered" and found[2]["outcome"] == "unavailable" and "rate limit" in found[2]["answer"]
    assert 2 not in {r["query_id"] for r in answers.join(answer.cacheable(answers).select("key"), "key").collect()}


def test_cardinalities_and_sanity(spark):
    chunks = spark.createDataFrame([("a", "All schemes", "the exit load of acorn multi asset fund is high", [0.0]), ("b", "All schemes", "x", [0.0])], "chunk_id string, scheme string, text string, embedding array<double>")
    assert [tuple(r) for r in report.cardinalities(chunks, chunks.limit(1), chunks, 2).collect()] == [("vectors", 2, 1, False), ("widths", 1, 0, False), ("stored", 2, 2, True)]
    embedder = embed.HashingEmbedder(256)
    stored = embed.embed(chunks.drop("embedding"), embedder)
    assert {r["check"]: r["ok"] for r in report.sanity_check(stored, embedder).collect()} == {"ranking": True, "floor": True}
    assert {r["check"]: r["ok"] for r in report.sanity_check(stored.filter("chunk_id = 'b'"), embedder).collect()} == {"ranking": False, "floor": False}


def test_retries_wait_longer_each_time():
    calls, waits = [], []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("reset")
        return 200, "", b"ok"

    assert fetch.with_retries(flaky, "u", sleep=waits.append)[0] == 200 and waits == [2.0, 4.0]


def test_raw_header(spark):
    raw = "# URL: https://x\n# TITLE: a: b\n" + "-" * 72 + "\n# NOT: this"
    assert spark.createDataFrame([(raw,)], "raw string").select(files.parse_header(F.col("raw")).alias("m")).first()["m"] == {"url": "https://x", "title": "a: b"}
