"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators and stages use for columns of their own, or add.
CLASHING = "key size n shard spans whole anchors root component_id node n_shingles lost_words lost_lines kept n_words base_failed toxicity score toxic part tokens host path rule action verdict row first law slot".split()


def texts():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    prose = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(8)]
    long = " ".join(rng.choice(vocabulary) for _ in range(460_000))  # some 3 MiB
    return [*prose, prose[0], long, None, "", " \t\n ", "word"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(None if k == 3 else k // 2, t, None if k % 5 == 0 else "en", None if k % 3 == 0 else "s", k, *[f"{c}{k}" for c in CLASHING]) for k, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[1]], DOCS + ", " + ", ".join(f"{c} string" for c in CLASHING)).repartition(3)


def carried(df):
    """Rows as (doc_id, clashing columns), in order."""
    return sorted(([r["doc_id"], *[r[c] for c in CLASHING]] for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["quality rules", "toxicity", "n-gram Jaccard join", "suffix-array dedup"])
def test_stages_carry_other_columns(spark, clashing, tmp_path, name):
    import corpus_pipeline

    spark.createDataFrame([(k, 1, int(k == 2)) for k in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, clashing, str(tmp_path))
    assert out.columns == clashing.columns
    found, given = carried(out), carried(clashing)
    assert found and all(row in given for row in found)
    if name == "suffix-array dedup":
        assert found == given
    if name == "n-gram Jaccard join":  # two rows of the first text, and one row twice
        assert len(found) == len(given) - 2
    if name == "quality rules":  # eight texts, a copy, the long one and a row twice; the short ones go
        assert len(found) == 11
    assert stage(spark, clashing.limit(0), str(tmp_path)).collect() == []


def test_operators_carry_other_columns(spark, clashing):
    from groundspark.llm.jaccard import groups
    from groundspark.llm.packing import pack
    from groundspark.llm.passages import report
    from groundspark.llm.pieces import decode, encode
    from groundspark.llm.tokens import public_path
    from groundspark.llm.urls import judge

    given, path = carried(clashing), public_path("piece_bpe_32k.model")
    both = decode(encode(clashing, path, tokens="ids"), path, tokens="ids", text="again")
    assert carried(both) == given and {r["again"] for r in both.filter("text is null or text = ''").collect()} == {""}
    judged = judge(clashing.withColumn("url", clashing.text))
    assert all(c in judged.columns for c in CLASHING) and judged.filter("verdict not in ('allow', 'block')").count() == 0
    assert sorted(r["action"] for r in judged.collect()) == sorted(r["action"] for r in clashing.collect())
    n = len(given)
    grouped = groups(clashing.select("doc_id", "text"))
    assert grouped.count() == n and report(clashing).count() == n
    assert {r["component_id"] for r in grouped.filter("doc_id = 4 and n_shingles = 56").collect()} == {0}
    packed = pack(clashing, public_path("word_bpe_49k.json"))
    pieces = packed.selectExpr("sum(length) as a", "max(length) as b").first()
    whole = sum(r["doc_tokens"] for r in packed.filter("start = 0").collect())
    assert pieces["a"] == whole and pieces["b"] <= 4096


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "pipeline"])
def test_empty_tables(spark, tmp_path, name):
    import __spark_entry__

    empty = {
        "documents": DOCS, "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string", "embeddings": "vec_id long, embedding array<float>",
        "benchmark": "item_id long, text string",
    }
    for table, schema in empty.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    query = next(q for n, q in __spark_entry__.queries().items() if n == name or n.startswith(f"{name}_"))
    assert query(spark, str(tmp_path)).collect() == []
