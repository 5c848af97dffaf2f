"""The jobs over growing copies of tables: two runs, runs cut short, remote-looking paths, and their SQL."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import corpus_refresh, queries, turn_audit

SMALL = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
DOCS = "doc_id long, text string, lang string, source string"


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def chunk_rows(df):
    return rows(df.select("doc_id", "pos", "lang", "text", "n_words", "pii", "scheme"))


def some_docs():
    many = " ".join(f"w{k}" for k in range(400))
    texts = ["One line\nRead more\nand another", many, None, "", "write to a.b@example.org please", "One line\nRead more\nand another", "   \n loading...", "short"]
    return [(k, t, ["en", None, " ", "de"][k % 4], "s") for k, t in enumerate(texts)]


def test_refresh_takes_only_what_is_new(spark, tmp_path):
    docs, out = some_docs(), str(tmp_path / "out")
    first, more = docs[:4], [*docs[4:], (None, "no id", "en", "s"), (8, "One line\nRead more\nand another", "en", "s"), (8, "fresh text of a repeated id", "en", "s"), (9, docs[1][1] + " tail", "fr", "s"), (9, docs[1][1] + " tail", "fr", "s")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(first, DOCS).write.parquet(path)
    one = chunk_rows(corpus_refresh.refresh(spark, path, out))
    assert len(one) == 1 + 3  # windows of 160 words; null and empty texts give none
    assert chunk_rows(corpus_refresh.refresh(spark, path, out)) == one  # nothing new
    spark.createDataFrame(more, DOCS).write.mode("append").parquet(path)
    two = corpus_refresh.refresh(spark, path, out)
    found = {(r["doc_id"], r["pos"]): r for r in two.collect()}
    assert set(found) == {(0, 0), (1, 0), (1, 1), (1, 2), (4, 0), (7, 0), (8, 0), (9, 0), (9, 1), (9, 2)}
    assert found[4, 0]["text"] == "[withheld: email]" and found[4, 0]["pii"] == "email" and found[0, 0]["text"] == "One line and another"
    assert [found[k]["scheme"] for k in ((0, 0), (1, 0), (7, 0), (9, 0))] == ["en", "unknown", "de", "fr"] and found[1, 0]["lang"] is None and found[8, 0]["text"].startswith("fresh")
    marks = spark.read.schema(corpus_refresh.MARKS).parquet(f"{out}/marks").orderBy("high").collect()
    assert [(m["low"], m["high"], m["batch"], m["n_docs"]) for m in marks] == [(None, 3, "start", 4), (3, 9, "after3", 8)] and sum(m["n_chunks"] for m in marks) == len(found)
    # the same as one run over everything
    assert chunk_rows(corpus_refresh.refresh(spark, path, str(tmp_path / "whole"))) == chunk_rows(two)
    before = sorted(p.stat().st_mtime_ns for p in Path(out).rglob("part-*"))
    assert chunk_rows(corpus_refresh.refresh(spark, path, out)) == chunk_rows(two) and sorted(p.stat().st_mtime_ns for p in Path(out).rglob("part-*")) == before


def test_a_run_cut_short_is_not_seen_and_done_again(spark, tmp_path, monkeypatch):
    path, out = str(tmp_path / "documents.parquet"), str(tmp_path / "out")
    spark.createDataFrame(some_docs()[:2], DOCS).write.parquet(path)
    one = chunk_rows(corpus_refresh.refresh(spark, path, out))
    spark.createDataFrame(some_docs()[4:], DOCS).write.mode("append").parquet(path)

    def lost(*_):
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as patched:
        patched.setattr(corpus_refresh.log, "info", lost)  # after both writes: nothing is done twice
        with pytest.raises(RuntimeError):
            corpus_refresh.refresh(spark, path, str(tmp_path / "late"))
    late = chunk_rows(corpus_refresh.refresh(spark, path, str(tmp_path / "late")))
    with monkeypatch.context() as patched:
        patched.setattr(corpus_refresh, "finish", lost)  # the chunks are written, the mark isn't
        with pytest.raises(RuntimeError):
            corpus_refresh.refresh(spark, path, out)
    assert chunk_rows(corpus_refresh.committed(spark, out)) == one
    assert chunk_rows(corpus_refresh.refresh(spark, path, out)) == late
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_new_rows_are_found_by_the_files_statistics(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(some_docs(), DOCS).write.parquet(path)
    plan = spark.read.parquet(path).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").filter(F.col("doc_id") > 3)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(doc_id,3)" in plan and "source" not in plan.split("ReadSchema")[1]
    empty = str(tmp_path / "none.parquet")
    spark.createDataFrame([], DOCS).write.parquet(empty)
    assert corpus_refresh.refresh(spark, empty, str(tmp_path / "e")).collect() == []


def test_audit_takes_each_file_once(spark, tmp_path):
    path, out = str(tmp_path / "conversations.parquet"), str(tmp_path / "out")
    first = [(1, 0, "user", "my PAN is ABCDE1234F"), (1, 1, "assistant", "You should wait. The load is 1% within 2 years."), (2, 0, None, None), (2, 1, " ", "one two")]
    more = [(3, 0, "assistant", "That information is not in the sources."), (3, 1, "user", "That information is not in 3 years"), (1, 2, "assistant", "")]
    spark.createDataFrame(first, turn_audit.TURNS).coalesce(1).write.parquet(path)
    one = turn_audit.audit(spark, path, out)
    found = {(r["conv_id"], r["turn"]): r for r in one.collect()}
    assert len(found) == 4 and found[1, 0]["text"] == "[withheld: pan]" and (found[1, 1]["n_figures"], found[1, 1]["advice"], found[1, 1]["declined"]) == (2, "You should", False)
    assert [found[k]["role"] for k in ((2, 0), (2, 1))] == ["unknown", "unknown"] and found[2, 0]["n_words"] == 0 and "ABCDE1234F" not in repr(found)
    assert rows(turn_audit.audit(spark, path, out)) == rows(one)
    spark.createDataFrame(more, turn_audit.TURNS).coalesce(1).write.mode("append").parquet(path)
    two = turn_audit.audit(spark, path, out, files_per_batch=1)
    assert len(rows(two)) == 7 and {r["turn"]: r["declined"] for r in two.filter("conv_id = 3").collect()} == {0: True, 1: False}
    assert rows(two) == rows(turn_audit.audit(spark, path, str(tmp_path / "whole")))
    summary = {r["role"]: r for r in spark.read.parquet(f"{out}/summary").collect()}
    assert (summary["assistant"]["turns"], summary["assistant"]["declined"], summary["assistant"]["advised"], summary["user"]["withheld"]) == (3, 1, 1, 1)
    assert not [q for q in spark.streams.active]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_job_equals_its_sql(spark, name):
    import duckdb

    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    wanted = duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(wanted.columns) == columns
    assert rows(df.select(*columns)) == sorted(map(repr, wanted.select(*[f'"{c}"' for c in columns]).fetchall()))


def test_command_line(spark, tmp_path):
    spark.createDataFrame(some_docs(), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    (tmp_path / "config.json").write_text(json.dumps({"documents": f"{tmp_path}/documents.parquet", "output": "/nowhere", "chunk_max_words": 100}))
    done = subprocess.run([sys.executable, "-m", "jobs.corpus_refresh", "--config", f"{tmp_path}/config.json", "--output", f"{tmp_path}/out"], cwd=ROOT, capture_output=True, text=True, timeout=600, env=os.environ | {"PYTHONPATH": str(ROOT)})
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 8 documents (None to 7)" in done.stderr and chunk_rows(corpus_refresh.committed(spark, f"{tmp_path}/out")) == chunk_rows(corpus_refresh.refresh(spark, f"{tmp_path}/documents.parquet", f"{tmp_path}/again", 100))


def test_refresh_looks_for_personal_data_once(spark):
    docs = spark.createDataFrame([(1, "en", "x", "d")], "doc_id long, lang string, text string, doc_digest string")
    plan = corpus_refresh.chunks_of(docs, 160)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Z]{5}[0-9]{4}[A-Z]") == 1
