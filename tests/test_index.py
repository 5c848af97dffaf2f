"""The stored index against exact search, and what it and the filtered search read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundspark.operators import index, search
from groundspark.sources import files


def clustered(spark, n, dim=16, groups=40, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((groups, dim)) * 2
    rows = middles[rng.integers(0, groups, n)] + rng.standard_normal((n, dim))
    found = [(f"c{k}", ["a", "b", "c"][k % 3], v.tolist()) for k, v in enumerate(rows)]
    return spark.createDataFrame([*found, ("zero", "a", [0.0] * dim), ("none", "a", None), ("odd", "b", [float("nan")] * dim)], "chunk_id string, scheme string, embedding array<double>").repartition(4), rows


def exact(rows, asked, n):
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    out = {}
    for k, v in enumerate(asked):
        s = unit @ (v / np.linalg.norm(v))
        out[k] = sorted(((-x, f"c{i}") for i, x in enumerate(s)))[:n]
    return out


@pytest.mark.parametrize("n", [600, 6000])
def test_recall_at_two_sizes_and_pruned_cells(spark, tmp_path, n):
    chunks, rows = clustered(spark, n)
    built = index.VectorIndex.build(chunks, str(tmp_path / "i"), target=0.95, sample_rows=2000)
    about = built.about()
    assert built.rows().count() == n and about["cells"] == round(n**0.5) and 0 < about["probes"] < about["cells"] and about["expected"] >= 0.95
    rng = np.random.default_rng(8)
    asked = rows[rng.choice(n, 40, replace=False)] + 0.3 * rng.standard_normal((40, rows.shape[1]))
    questions = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(asked)], "query_id long, embedding array<double>")
    found = built.nearest(questions, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "PartitionFilters: [(cell" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    wanted = exact(rows, asked, 10)
    pairs = {(r["query_id"], r["chunk_id"]) for r in found.collect()}
    assert sum((k, c) in pairs for k, best in wanted.items() for _, c in best) >= 0.9 * 400
    shuffled = built.nearest(questions, 10, most_broadcast=0)
    assert {(r["query_id"], r["chunk_id"]) for r in shuffled.collect()} == pairs
    # the whole index is exact, by either join
    for most in (search.MOST_BROADCAST, 0):
        full = built.nearest(questions, 10, probes=about["cells"], most_broadcast=most).collect()
        assert {(r["query_id"], r["chunk_id"]) for r in full} == {(k, c) for k, best in wanted.items() for _, c in best} and len(full) == 400


def test_a_search_reads_chunks_once_and_only_seen_schemes(spark, tmp_path):
    chunks, rows = clustered(spark, 300)
    files.write_collection(chunks.filter("embedding is not null"), str(tmp_path / "c"), 16)
    stored = files.open_collection(spark, str(tmp_path / "c"))
    many = [(k, rows[k % 300].tolist(), [["a", "b"], ["b"]] if k % 2 else None) for k in range(1500)]
    questions = spark.createDataFrame(many, "query_id long, embedding array<double>, windows array<array<string>>")
    found = search.nearest(questions, stored, 3)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert found.groupBy("query_id", "window_id").count().filter("count = 3").count() == 750 + 2 * 750
    salted = search.nearest(questions.filter("query_id < 40"), stored, 3, most_broadcast=0)
    by = lambda df: sorted(map(tuple, df.select("query_id", "window_id", "chunk_id", F.round("similarity", 9)).collect()))
    assert by(salted) == by(found.filter("query_id < 40"))
    filtered = search.nearest(questions.filter("windows is not null").withColumn("windows", F.array(F.array(F.lit("b")))), stored, 3)
    plan = filtered._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and {r["chunk_id"] for r in filtered.collect()} <= {f"c{k}" for k in range(1, 300, 3)}
    assert search.nearest(questions.limit(0), stored, 3).collect() == []


def test_ties_go_to_the_smaller_id_across_blocks(spark, monkeypatch):
    chunks = spark.createDataFrame([(f"c{k:03d}", "a", [1.0, float(k % 2)]) for k in range(200)], "chunk_id string, scheme string, embedding array<double>").repartition(7)
    found = search.nearest(spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>").withColumn("windows", F.lit(None).cast("array<array<string>>")), chunks, 5)
    assert [r["chunk_id"] for r in found.orderBy("chunk_id").collect()] == ["c000", "c002", "c004", "c006", "c008"]


def test_an_index_needs_a_vector(spark, tmp_path):
    with pytest.raises(ValueError, match="no vector"):
        index.VectorIndex.build(spark.createDataFrame([("a", None)], "chunk_id string, embedding array<double>"), str(tmp_path / "i"))


def test_scoring_holds_one_pair_of_blocks_at_a_time():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    chunks = rng.normal(size=(128, 4))
    chunks /= np.linalg.norm(chunks, axis=1)[:, None]

    def pairs(several):
        for k in range(several):
            asked = [{"query_id": 256 * k + j, "window_id": 0, "embedding": v} for j, v in enumerate(rng.normal(size=(256, 4)).tolist())]
            asked = pa.array([asked], pa.list_(pa.struct([("query_id", pa.int64()), ("window_id", pa.int32()), ("embedding", pa.list_(pa.float64()))])))
            yield pa.RecordBatch.from_arrays([pa.array([[f"{i:04d}" for i in range(128)]]), pa.array([chunks.tobytes()], pa.binary()), asked], names=["ids", "vectors", "asked"])

    def peak(several):
        tracemalloc.start()
        rows = sum(b.num_rows for b in search._score(pairs(several), 60))
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == several * 256 * 60
        return top

    peak(1)
    assert peak(40) < 1.5 * peak(4)


def test_an_index_search_gives_the_best_of_a_block_and_deals_one_files_rows_to_tasks(spark, tmp_path):
    chunks, rows = clustered(spark, 2000)
    built = index.VectorIndex.build(chunks.coalesce(1), str(tmp_path / "i"), sample_rows=2000)
    asked = rows[::2]
    questions = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(asked)], "query_id long, embedding array<double>").coalesce(1)
    found = built.nearest(questions, 7, probes=9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "RoundRobinPartitioning(4)" in plan and "hashpartitioning(cell" in plan  # no vector is copied to its cells
    cell = {r["chunk_id"]: r["cell"] for r in built.rows().collect()}
    centres, unit = built.centres(), rows / np.linalg.norm(rows, axis=1)[:, None]
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((-r["similarity"], r["chunk_id"]))
    for k in range(0, len(asked), 50):
        v = asked[k] / np.linalg.norm(asked[k])
        probed = set(np.argsort(-(v @ centres.T), kind="stable")[:9].tolist())
        wanted = sorted((-x, f"c{i}") for i, x in enumerate(unit @ v) if cell[f"c{i}"] in probed)[:7]
        assert [c for _, c in sorted(got[k])] == [c for _, c in wanted]


def test_scoring_sums_and_parts_few_candidates_at_a_time():
    import tracemalloc

    rng = np.random.default_rng(1)
    unit = lambda n: (lambda v: v / np.linalg.norm(v, axis=1)[:, None])(rng.normal(size=(n, 64)))
    asked, chunks = unit(256), unit(4096)

    def scored():
        top = search._Best(asked, 60)
        top.add(chunks, np.arange(4096))
        return top.prune()

    scored()
    tracemalloc.start()
    at, _, i = scored()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(at) == 256 * 60 and set(i[at == 5]) == set(np.argsort(-(asked @ chunks.T)[5])[:60].tolist())
    assert peak < 1.8 * 8 * 256 * 4096  # one tile, and no second one
