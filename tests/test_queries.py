"""Every query against its SQL at the smallest scale, and the plans of the hot ones."""

import os

import pytest

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")


def rows(found):
    return sorted(repr([round(v, 6) + 0.0 if isinstance(v, float) else v for v in r]) for r in found)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return connection


def names():
    from groundspark.plans import catalogue

    return list(catalogue.QUERIES)


@pytest.mark.parametrize("name", names())
def test_query_equals_its_sql(spark, duck, name):
    from groundspark.plans import catalogue

    df = catalogue.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    found = rows(df.select(*columns).collect())
    if name not in catalogue.ORACLE_SQL:
        assert found
        return
    wanted = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(wanted.columns) == columns
    assert found == rows(wanted.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", ["window_chunks", "chunk_ids", "job1_corpus_refresh"])
def test_windows_of_long_texts_that_read_like_tables_equal_sql(spark, tmp_path, name):
    import duckdb
    from groundspark.plans import catalogue
    from jobs import queries as jobs

    texts = ["Scheme Ratio Load " + " ".join(f"Row {k} 1.5% 2.0 {k}" for k in range(90)), " ".join(["La"] * 90 + ["\u00ed."] * 90 + ["\u00d3."] * 90), "one two", None, " \n", " ".join(f"w{k}" for k in range(320))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang").write.parquet(str(tmp_path / "documents.parquet"))
    small = duckdb.connect()
    small.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df, wanted = (catalogue.QUERIES | jobs.QUERIES)[name](spark, str(tmp_path)), small.sql((catalogue.ORACLE_SQL | jobs.ORACLE_SQL)[name])
    columns = sorted(df.columns)
    assert rows(df.select(*columns).collect()) == rows(wanted.select(*columns).fetchall()) != []


@pytest.mark.parametrize("name,role,key", [("ask_batch", "user", "query_id"), ("verify_answer", "assistant", "answer_id"), ("decline_flag_turns", "assistant", "answer_id")])
def test_all_turns_are_asked_and_judged(spark, duck, name, role, key):
    from groundspark.plans import catalogue

    literal = catalogue.QUESTIONS if role == "user" else catalogue.ANSWERS
    turns = duck.sql(f"select conv_id * 1000 + turn + 1000 from conversations where role = '{role}'").fetchall()
    assert sorted(r[key] for r in catalogue.QUERIES[name](spark, SMALL).collect()) == sorted([k for k, *_ in literal] + [k for (k,) in turns])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_and_plans(spark):
    import __spark_entry__
    from groundspark.plans import catalogue

    assert __spark_entry__.entry(spark).count() > 0
    assert "ReadSchema: struct<doc_id:bigint,source:string,lang:string>" in plan(catalogue.QUERIES["text_slug"](spark, SMALL)).replace("lang:string,source:string", "source:string,lang:string")
    for name in names():
        assert "CartesianProduct" not in plan(catalogue.QUERIES[name](spark, SMALL)), name


def test_filters_reach_the_files(spark, tmp_path):
    from groundspark.sources import files

    df = spark.createDataFrame([("a", "s1", [1.0, 0.0]), ("b", "s2", [0.0, 1.0])], "chunk_id string, scheme string, embedding array<double>")
    files.write_collection(df, str(tmp_path / "c"), 2)
    found = files.open_collection(spark, str(tmp_path / "c")).filter("scheme in ('s1') and chunk_id = 'a'")
    assert "PartitionFilters: [isnotnull(scheme" in plan(found) and "PushedFilters: [IsNotNull(chunk_id), EqualTo(chunk_id,a)]" in plan(found)
    with pytest.raises(Exception, match="length is not 3"):
        files.write_collection(df, str(tmp_path / "d"), 3)
