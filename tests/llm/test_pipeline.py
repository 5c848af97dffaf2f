"""The pipeline's stages keep their contracts, and the entry module works without them."""

import random


def test_stages_in_order_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30, 200))) for _ in range(120)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = [(k, t, "en", f"s{k % 4}", len(t)) for k, t in enumerate(texts)]
    rows += [(200, texts[3], "en", "s1", 1), (201, texts[4] + " tail", "en", "s1", 1), (202, "too short", "en", "s1", 1), (203, None, None, None, None)]
    rows += [(210 + k, f"{texts[5 + k]} {passage}", "en", "s2", 1) for k in range(2)]
    for k in range(12):
        words_ = texts[20 + k].split()[::-1]
        for bad in ("slurword", "badword"):
            words_.insert(rng.randrange(len(words_)), bad)
        rows.append((300 + k, " ".join(words_), "en", "s3", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, 0) for k in range(120)] + [(300 + k, 0, 1) for k in range(12)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, df = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
        out = f"{tmp_path}/{len(seen)}"
        df.write.parquet(out)
        df = spark.read.parquet(out)
        seen.append({r["doc_id"] for r in df.select("doc_id").distinct().collect()})
        assert name == "packing" or df.columns == docs.columns
    assert {202, 203} & seen[0] == set() and set(range(120)) <= seen[0]
    assert not set(range(300, 312)) & seen[1] and set(range(120)) <= seen[1]
    assert not {200, 201} & seen[2] and set(range(120)) <= seen[2]
    assert seen[3] == seen[2] == seen[4]
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))


def test_one_row_of_each_group_of_near_duplicates_stays(spark):
    from groundspark.llm.jaccard import near_duplicate_stage
    from groundspark.llm.passages import suffix_stage

    rng = random.Random(4)
    a, b, c, d = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(4))
    rows = [(1, a), (1, a), (2, a), (None, b), (None, b), (3, c), (4, c), (4, d), (5, None), (5, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = near_duplicate_stage(spark, docs, "")
    wanted = sorted([(1, a), (None, b), (3, c), (4, d), (5, None), (5, None)], key=repr)
    assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=repr) == wanted
    assert {r["text"] for r in suffix_stage(spark, kept, "").collect()} >= {a, b, c, d}


def test_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 13)] == [1] * 12 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
