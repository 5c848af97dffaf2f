"""Approximate nearest neighbours by a forest of random-projection trees, with exact reranking.

Trees are fitted on a bounded sample (``SAMPLE`` distinct vectors, drawn by hash); a node splits by the plane between
two centres that a few 2-means steps find from two random points.  Every vector is indexed: it goes down each
tree to a leaf.  A query searches all trees through one shared priority queue: the node whose planes it is on the
right side of by the largest margin comes first, whatever its tree, until the leaves taken hold
``LEAST_CANDIDATES`` vectors and ``CANDIDATE_SHARE`` of all (a vector counts once for each tree).  Leaves and the queries that reach them are brought together by (tree,
leaf) and each leaf gives a query its best few by the exact cosine; the best of these are the answer.

Equal vectors are one point of the index, with its ``k + 1`` smallest ids (no more can be in an answer), so a very common vector
doesn't fill a leaf.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no part; fewer than
``k`` candidates give all of them; an empty table gives no rows; other columns are ignored.  Repeated ids are told apart
from the query's own by id only.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundspark.llm.common import Scratch, bounded_batches, map_arrow, table, tidy

SAMPLE, TREES, LEAF_SAMPLE, SEED = 16_384, 20, 64, 7
#: Vectors in the leaves that a query takes, counted once for each tree that holds them.
LEAST_CANDIDATES, CANDIDATE_SHARE = 20_000, 0.55


@dataclass
class Forest:
    """Inner nodes of all trees: plane normals and offsets; children are inner nodes (>= 0) or leaves (-1 - leaf)."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: list[int]
    leaves: int


def _plane(points: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """The plane between two centres (2-means from two random points)."""
    a, b = points[rng.choice(len(points), 2, replace=False)]
    some = points[rng.choice(len(points), min(len(points), 256), replace=False)]
    for _ in range(4):
        left = ((some - a) ** 2).sum(1) <= ((some - b) ** 2).sum(1)
        if left.all() or not left.any():
            break
        a, b = some[left].mean(0), some[~left].mean(0)
    normal = a - b
    return normal, float(-(normal @ ((a + b) / 2)))


def grow(sample: np.ndarray, trees: int = TREES, leaf: int = LEAF_SAMPLE, seed: int = SEED) -> Forest:
    rng = np.random.default_rng(seed)
    normals, offsets, children, roots, leaves = [], [], [], [], 0
    for _ in range(trees):
        todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(sample)), -1, 0)]  # points, parent, side
        root = None
        while todo:
            points, parent, side = todo.pop()
            at = None
            if len(points) > leaf:
                for _ in range(3):
                    normal, offset = _plane(sample[points], rng)
                    right = sample[points] @ normal + offset > 0
                    if 0.05 < right.mean() < 0.95:
                        break
                if not 0 < right.mean() < 1:  # no plane parts them: any direction's median
                    normal = rng.standard_normal(sample.shape[1])
                    cast = sample[points] @ normal
                    offset = -float(np.median(cast))
                    right = cast + offset > 0
                if 0 < right.mean() < 1:
                    at = len(normals)
                    normals.append(normal)
                    offsets.append(offset)
                    children.append([0, 0])
                    todo += [(points[~right], at, 0), (points[right], at, 1)]
            if at is None:
                at = -1 - leaves
                leaves += 1
            if parent >= 0:
                children[parent][side] = at
            else:
                root = at
        roots.append(root)
    dim = sample.shape[1]
    return Forest(np.array(normals).reshape(-1, dim), np.array(offsets), np.array(children, dtype=np.int64).reshape(-1, 2), roots, leaves)


def leaves_of(forest: Forest, vectors: np.ndarray) -> np.ndarray:
    """The leaf of each vector in each tree (n x trees)."""
    out = np.empty((len(vectors), len(forest.roots)), dtype=np.int64)
    for t, root in enumerate(forest.roots):
        node = np.full(len(vectors), root, dtype=np.int64)
        k = np.flatnonzero(node >= 0)
        while len(k):
            at = node[k]
            side = ((vectors[k] * forest.normals[at]).sum(1) + forest.offsets[at] > 0).astype(np.int64)
            node[k] = forest.children[at, side]
            k = k[node[k] >= 0]
        out[:, t] = -1 - node
    return out


def search(forest: Forest, sizes: np.ndarray, query: np.ndarray, wanted: int) -> list[int]:
    """Leaves for a query, best first, from one queue over all trees, until they hold ``wanted`` vectors (copies of trees count)."""
    margins = forest.normals @ query + forest.offsets
    queue = [(-np.inf, root) for root in forest.roots]
    heapq.heapify(queue)
    found, held = [], 0
    while queue and held < wanted:
        bound, node = heapq.heappop(queue)
        if node < 0:
            found.append(-1 - node)
            held += sizes[-1 - node]
            continue
        m = margins[node]
        for side, reach in ((0, -m), (1, m)):
            heapq.heappush(queue, (max(bound, -reach), int(forest.children[node, side])))
    return found


# ---- tables -------------------------------------------------------------------------------------------------


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(rows vec_id, embedding that take part, their length)."""
    number = F.col("embedding").cast("array<double>")
    fine = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(number, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).filter(fine)
    most = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = most["dim"] if most else 0
    return rows.filter(F.size("embedding") == dim), dim


def points(rows: DataFrame, k: int) -> DataFrame:
    """Rows (embedding, ids): distinct vectors with their ``k + 1`` smallest ids."""
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    return rows.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its ``k`` best different vectors, nearest first, ties to the smaller id."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    again = np.concatenate([[False], (query[1:] == query[:-1]) & (vec[1:] == vec[:-1])]) if len(query) else np.zeros(0, dtype=bool)
    query, vec, score = query[~again], vec[~again], score[~again]
    if not len(query):
        return query, vec, score
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[place < k], vec[place < k], score[place < k]


def nearest(vectors: DataFrame, is_query, k: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for the rows of ``vectors`` (vec_id, embedding) that ``is_query`` (a condition) picks."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "neighbours")
    rows, dim = usable(vectors)
    answer = "query_id long, vec_id long, score double"
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    distinct = scratch.keep(points(rows, k), "points")
    sample = _matrix(distinct.select("embedding").orderBy(F.xxhash64("embedding")).limit(SAMPLE).toArrow().column("embedding").combine_chunks(), dim)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    forest = grow(sample)
    total = distinct.count()
    shared = spark.sparkContext.broadcast(forest)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch.column(0), dim)
        leaves = leaves_of(shared.value, x / np.linalg.norm(x, axis=1, keepdims=True))
        at = pa.array(np.repeat(np.arange(len(x)), leaves.shape[1]))
        return pa.RecordBatch.from_arrays([pa.array(leaves.ravel()), batch.column(0).take(at), batch.column(1).take(at)], names=["leaf", "embedding", "ids"])

    kind = distinct.schema["embedding"].dataType.simpleString()  # floats or doubles, as they come
    indexed = scratch.keep(map_arrow(distinct.select("embedding", "ids"), place, f"leaf long, embedding {kind}, ids array<long>"), "indexed")
    sizes = np.zeros(forest.leaves, dtype=np.int64)
    counted = indexed.groupBy("leaf").count().toPandas()  # a row for each leaf: bounded by the sample
    sizes[counted["leaf"].to_numpy()] = counted["count"].to_numpy()
    held = spark.sparkContext.broadcast(sizes)
    wanted = max(LEAST_CANDIDATES, int(CANDIDATE_SHARE * total))

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch.column(1), dim)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        found = [search(shared.value, held.value, q, wanted) for q in x]
        at = pa.array(np.repeat(np.arange(len(x)), [len(f) for f in found]))
        leaves = pa.array(np.concatenate([np.array(f, dtype=np.int64) for f in found]))
        return pa.RecordBatch.from_arrays([leaves, batch.column(1).take(at), batch.column(0).take(at)], names=["leaf", "embedding", "query_id"])

    routed = map_arrow(rows.filter(is_query).select("vec_id", "embedding"), route, f"leaf long, embedding {kind}, query_id long")

    def rerank(batches):
        parts: list = []
        vec: list = [[], [], []]  # this leaf's unit vectors, ids; queries
        leaf = None

        def close() -> None:
            v, ids, asked = vec
            if v and asked:
                x = np.concatenate(v)
                x_norm = np.linalg.norm(x, axis=1)
                flat, counts = np.concatenate([np.concatenate(i) for i in ids]), np.concatenate([[len(a) for a in i] for i in ids])
                first = np.cumsum(counts) - counts
                q_ids, q = np.concatenate([a for a, _ in asked]), np.concatenate([b for _, b in asked])
                score = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * x_norm)
                take = min(k + 1, len(x))
                top = np.argpartition(-score, take - 1, axis=1)[:, :take] if take < len(x) else np.tile(np.arange(len(x)), (len(q), 1))
                edge = np.take_along_axis(score, top, 1).min(axis=1, keepdims=True)
                row, col = np.nonzero(score >= edge)  # ties at the edge stay
                n = counts[col]
                vid = flat[np.repeat(first[col], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                qid, s = np.repeat(q_ids[row], n), np.repeat(score[row, col], n)
                other = vid != qid
                parts.append(_best(qid[other], vid[other], s[other], k))
                if len(parts) > 64:
                    parts[:] = [_best(*(np.concatenate(c) for c in zip(*parts)), k)]
            vec[:] = [[], [], []]

        for batch in batches:
            leaves = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(leaves[1:] != leaves[:-1]) + 1, [len(leaves)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if leaves[a] != leaf:
                    close()
                    leaf = leaves[a]
                part = batch.slice(a, b - a)
                asks = part.column(3).is_valid().to_numpy(zero_copy_only=False)
                x = _matrix(part.column(1), dim)
                if asks.any():
                    vec[2].append((part.column(3).to_numpy(zero_copy_only=False)[asks].astype(np.int64), x[asks]))
                if not asks.all():
                    vec[0].append(x[~asks])
                    vec[1].append([np.array(i, dtype=np.int64) for i, q in zip(part.column(2).to_pylist(), asks) if not q])
        close()
        if parts:
            qid, vid, score = _best(*(np.concatenate(c) for c in zip(*parts)), k)
            yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(vid), pa.array(score)], names=["query_id", "vec_id", "score"])

    empty_ids, no_query = F.lit(None).cast("array<long>"), F.lit(None).cast("long")
    both = indexed.select("leaf", "embedding", "ids", no_query.alias("query_id")).unionByName(routed.select("leaf", "embedding", empty_ids.alias("ids"), "query_id"))
    found = both.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(tidy(rerank), answer)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
