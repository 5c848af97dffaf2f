"""Filtered nearest-neighbour search and hybrid re-ranking for batches of questions.

Chunks are read once, whatever the number of questions: their vectors (and nothing else) are dealt evenly to tasks, which pack them into blocks of a key (the scheme, or all); the questions
are packed into blocks of the keys that their windows see, and the two meet in a join on the key.  The questions' side is broadcast if its size, counted before, is at most
``MOST_BROADCAST`` bytes; a larger one is copied to ``SALTS`` salts of each key and joined by a shuffle.  Where every question is filtered, only the partitions of schemes that some window
sees are read.  Each pair of blocks is one piece of work: matrix products in tiles, of which the best few of each question stay.  A task holds one pair at a time, so its memory doesn't grow
with questions or chunks.  The search is exact; ``operators.index`` reads only some cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.config import DEFAULT, DEMO, EngineConfig, Profile
from groundspark.functions.routing import detect_schemes
from groundspark.functions.text import normalise, tokens

#: Vectors and questions of one block, those of one matrix product, bytes of questions that are broadcast, and copies of them beyond that.
CHUNK_BLOCK, QUESTION_BLOCK, TILE = 32_768, 2048, (512, 4096)
#: Candidates that are summed again at a time: two blocks of so many vectors are held.
SUMMED = 1 << 13
MOST_BROADCAST, SALTS = 64 << 20, 64
_NEAR = "query_id long, window_id int, chunk_id string, similarity double"
#: The key of windows that see everything; no scheme's name has a zero in it.
EVERYTHING = "\0"


def scheme_filter(schemes: Column, profile: Profile = DEMO) -> Column:
    """The schemes that a search may see: those named and the global one; null for all."""
    return F.when(F.size(schemes) > 0, F.array_distinct(F.concat(schemes, F.array(F.lit(profile.global_scheme)))))


def windows_of(schemes: Column, profile: Profile = DEMO) -> Column:
    """An array of windows (arrays of schemes): one for each named scheme with the global one, and one for that alone; null: one window of all."""
    everything = F.lit(profile.global_scheme)
    return F.when(F.size(schemes) > 0, F.concat(F.transform(schemes, lambda s: F.array(s, everything)), F.array(F.array(everything))))


def nearest(questions: DataFrame, chunks: DataFrame, n: int, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Rows (query_id, window_id, chunk_id, similarity), the best ``n`` of each window, ties to the smaller id.

    ``questions``: query_id, embedding, windows (as ``windows_of`` makes them); ``chunks``: chunk_id, scheme, embedding.  Chunks without a vector, or with one of zeros, take no part.
    """
    windows = F.coalesce("windows", F.array(F.lit(None).cast("array<string>")))
    asked = questions.select(F.col("query_id").cast("long").alias("query_id"), F.posexplode(windows).alias("window_id", "seen"), F.col("embedding").cast("array<double>").alias("embedding"))
    keyed = asked.select(F.explode(F.coalesce(F.array_distinct("seen"), F.array(F.lit(EVERYTHING)))).alias("key"), "query_id", "window_id", "embedding")
    # no vector is needed for these counts, so a model that makes them isn't run
    size = keyed.agg(F.count("*").alias("rows"), F.coalesce(F.bool_or(F.col("key") == EVERYTHING), F.lit(False)).alias("all"), F.coalesce(F.bool_or(F.col("key") != EVERYTHING), F.lit(False)).alias("some")).first()
    usable = chunks.filter("embedding is not null").select(F.col("chunk_id").cast("string").alias("chunk_id"), "scheme", "embedding")
    if not size["all"]:
        usable = usable.join(F.broadcast(keyed.filter(F.col("key") > "").select(F.col("key").alias("scheme")).distinct()), "scheme", "left_semi")
    # a count of the rows alone, for an even deal
    parts = max(-(-(total := chunks.select("chunk_id").count()) // CHUNK_BLOCK), min(chunks.sparkSession.sparkContext.defaultParallelism, -(-total // TILE[1])), 1)
    usable = usable.repartition(parts)
    keys = [k for k, wanted in ((F.lit(EVERYTHING), size["all"]), (F.col("scheme"), size["some"])) if wanted]
    return best(keyed, usable.select("chunk_id", F.array(*keys).cast("array<string>").alias("keys"), "embedding"), n, size["rows"], most_broadcast)


def best(keyed: DataFrame, chunks: DataFrame, n: int, rows: int, most_broadcast: int = MOST_BROADCAST, salts: int = SALTS) -> DataFrame:
    """The best ``n`` of each question and window among the chunks that share a key with it.

    ``keyed``: key, query_id, window_id, embedding, of ``rows`` rows; ``chunks``: chunk_id, keys, embedding.
    """
    return met(keyed, packed_vectors(chunks), _score, n, rows, most_broadcast, salts)


def met(keyed: DataFrame, packed: DataFrame, score: Callable[[Iterator[pa.RecordBatch], int], Iterator[pa.RecordBatch]], n: int, rows: int, most_broadcast: int = MOST_BROADCAST, salts: int = SALTS) -> DataFrame:
    """The best ``n`` of each question and window over all pairs of blocks with one key; ``score`` takes the columns of ``packed`` but the key, and then ``asked``, all columns of the questions but the key."""
    member = F.struct(*[c for c in keyed.columns if c != "key"])
    several = keyed.groupBy("key").agg(F.ceil(F.count("*") / QUESTION_BLOCK).alias("several"))
    dealt = keyed.filter("embedding is not null").join(F.broadcast(several), "key").withColumn("block", F.pmod(F.xxhash64("query_id", "window_id"), "several"))
    blocks = dealt.groupBy("key", "block").agg(F.collect_list(member).alias("asked"))
    if rows * _row_bytes(keyed) <= most_broadcast:
        joined = packed.join(F.broadcast(blocks), "key")
    else:
        salted = packed.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)))
        joined = salted.join(blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["key", "salt"])
    scored = joined.select(*[c for c in packed.columns if c != "key"], "asked").mapInArrow(lambda batches: score(batches, n), _NEAR)
    place = F.row_number().over(Window.partitionBy("query_id", "window_id").orderBy(F.desc("similarity"), "chunk_id"))
    return scored.withColumn("place", place).filter(F.col("place") <= n).drop("place")


def _row_bytes(keyed: DataFrame) -> int:
    """Bytes of one question: the widest vector is looked up in one row, since all have one length."""
    first = keyed.select(F.size("embedding")).first()
    return 64 + 8 * max(1, (first[0] or 0) if first else 1)


def packed_vectors(chunks: DataFrame) -> DataFrame:
    """Rows (key, ids, vectors) of up to ``CHUNK_BLOCK`` chunks of one task with that key, by their ids; ``vectors`` are unit vectors of doubles, end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        total = 0

        def packed(key: str) -> pa.RecordBatch:
            found, parts = zip(*held.pop(key))
            ids = pa.concat_arrays(found)
            order = pc.array_sort_indices(ids)
            rows = np.concatenate(parts)[order.to_numpy()]
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(order))
            return pa.RecordBatch.from_arrays([pa.array([key]), listed, pa.array([memoryview(np.ascontiguousarray(rows)).cast("B")], pa.binary())], names=["key", "ids", "vectors"])

        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            size = np.linalg.norm(values, axis=1)
            fit = np.isfinite(size) & (size > 0)
            unit = values / np.where(fit, size, 1)[:, None]
            ids, keys = batch.column(0), batch.column(1)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(keys.offsets.to_numpy()))
            names, place = np.unique(np.array(keys.flatten().to_pylist(), dtype=object), return_inverse=True)
            for k, name in enumerate(names.tolist()):
                rows = owner[(place == k) & fit[owner]]
                for first in range(0, len(rows), CHUNK_BLOCK):
                    part = rows[first : first + CHUNK_BLOCK]
                    held.setdefault(name, []).append((ids.take(pa.array(part)), unit[part]))
                    total += len(part)
                    if sum(len(x) for x, _ in held[name]) >= CHUNK_BLOCK:
                        total -= sum(len(x) for x, _ in held[name])
                        yield packed(name)
            while total > CHUNK_BLOCK:  # many keys: the fullest goes
                name = max(held, key=lambda x: sum(len(y) for y, _ in held[x]))
                total -= sum(len(x) for x, _ in held[name])
                yield packed(name)
        for name in list(held):
            yield packed(name)

    return chunks.mapInArrow(run, "key string, ids array<string>, vectors binary")


class _Best:
    """The best of each question of one tile's row so far: candidates by place of question and chunk."""

    def __init__(self, questions: np.ndarray, n: int):
        self.questions, self.n = questions, n
        self.edge = np.full(len(questions), -np.inf)  # what the n-th best had, where there are n
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, chunks: np.ndarray, places: np.ndarray, only: np.ndarray | None = None) -> None:
        """Chunks at ``places``, for all questions or those at ``only``; what lies within rounding of the edge is summed again, always in one order, so that equal vectors tie."""
        questions = self.questions if only is None else self.questions[only]
        near = questions @ chunks.T
        edge = self.edge.copy() if only is None else self.edge[only]
        fresh = np.flatnonzero(np.isinf(edge))
        if len(chunks) > self.n:
            for k in range(0, len(fresh), 64):  # a partition copies its rows
                some = fresh[k : k + 64]
                edge[some] = np.partition(near[some], -self.n, axis=1)[:, -self.n]
        at, i = np.nonzero(near >= (edge - 1e-9)[:, None])
        del near
        for k in range(0, len(at), SUMMED):
            a, c = at[k : k + SUMMED], i[k : k + SUMMED]
            self.parts.append((a if only is None else only[a], (questions[a] * chunks[c]).sum(axis=1), places[c]))
            self.held += len(a)
            if self.held > max(1 << 17, 2 * self.n * len(self.questions)):
                self.prune()
        if self.held and len(fresh):
            self.prune()  # an early edge spares later tiles their partition

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, similarity, chunk) of the best, ties to the earlier chunk."""
        at, similarity, i = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((i, -similarity, at))
        at = at[order]
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        kept = order[rank < self.n]
        self.edge[at[rank == self.n - 1]] = similarity[order[rank == self.n - 1]]
        self.parts = [(at[rank < self.n], similarity[kept], i[kept])]
        self.held = len(kept)
        return self.parts[0]


def best_of(questions: np.ndarray, n: int) -> _Best:
    """The best ``n`` of questions whose vectors have any length."""
    return _Best(questions / np.maximum(np.linalg.norm(questions, axis=1), 1e-300)[:, None], n)


def _score(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids, asked = batch.column(0)[k].values, batch.column(2)[k].values
            if not len(asked):
                continue
            query, window = asked.field(0).to_numpy(), asked.field(1).to_numpy()
            vectors = asked.field(2).flatten().to_numpy(zero_copy_only=False).reshape(len(asked), -1)
            chunks = np.frombuffer(batch.column(1)[k].as_buffer(), dtype=np.float64).reshape(-1, vectors.shape[1])
            for a in range(0, len(asked), TILE[0]):
                top = best_of(vectors[a : a + TILE[0]], n)
                for first in range(0, len(chunks), TILE[1]):
                    top.add(chunks[first : first + TILE[1]], np.arange(first, min(first + TILE[1], len(chunks))))
                if top.held:
                    at, similarity, i = top.prune()
                    yield pa.RecordBatch.from_arrays([pa.array(query[a + at]), pa.array(window[a + at]), ids.take(pa.array(i)), pa.array(similarity)], names=["query_id", "window_id", "chunk_id", "similarity"])


def merged(found: DataFrame) -> DataFrame:
    """One row for each question and chunk: that of the first window."""
    place = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("window_id"))
    return found.withColumn("place", place).filter("place = 1").drop("place")


def content_terms(question: Column, schemes: Column, profile: Profile = DEMO) -> Column:
    """Distinct words that carry meaning, longest first, then by letters."""
    of_schemes = F.flatten(F.transform(schemes, tokens))
    stop = F.array(*[F.lit(w) for w in profile.stopwords])
    left = F.filter(F.array_distinct(tokens(question)), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w) & ~F.array_contains(of_schemes, w))
    return F.transform(F.array_sort(F.transform(left, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda s: s["w"])


def matched_terms(text: Column, terms: Column) -> Column:
    return F.array_intersect(terms, tokens(F.coalesce(text, F.lit(""))))


def lexical_score(text: Column, terms: Column) -> Column:
    """The share of terms that a text has as whole words."""
    return F.when(F.size(terms) > 0, F.size(matched_terms(text, terms)) / F.size(terms)).otherwise(F.lit(0.0))


def mentions_scheme(text: Column, schemes: Column) -> Column:
    whole = normalise(text)
    return F.exists(schemes, lambda s: whole.contains(normalise(s)))


def with_normal_text(chunks: DataFrame) -> DataFrame:
    """Chunks with the normal form of their text, made once for each chunk and not for each question that it is a candidate of; ``rerank`` uses it."""
    return chunks.withColumn("__normal", normalise(F.col("text")))


def rerank(candidates: DataFrame, config: EngineConfig = DEFAULT, profile: Profile = DEMO) -> DataFrame:
    """Add matched_terms, names_scheme, score, rank and best_similarity (over all candidates of the question).

    ``candidates``: query_id, chunk_id, similarity, text, scheme, source_url, page_title, terms, schemes, window_id.
    """
    subject = F.size(matched_terms(F.concat_ws(" ", "source_url", "page_title"), F.col("terms"))) > 0
    normal = F.col("__normal") if "__normal" in candidates.columns else normalise(F.col("text"))
    matched, named = F.array_intersect("terms", F.split(normal, " ")), F.exists("schemes", lambda s: normal.contains(normalise(s)))
    found = candidates.withColumns({"matched_terms": matched, "names_scheme": named, "__subject": subject})
    return ranked_by(found, config, profile, "__subject").drop("__subject", "__normal")


def ranked_by(found: DataFrame, config: EngineConfig = DEFAULT, profile: Profile = DEMO, subject: str = "subject") -> DataFrame:
    """Add score, rank and best_similarity to candidates with their lexical side: terms, matched_terms, names_scheme and whether the source is about the question."""
    bonus = F.when(F.col("names_scheme") & F.col(subject) & (F.col("scheme") == profile.global_scheme), config.global_row_bonus).otherwise(0.0)
    lexical = F.when(F.size("terms") > 0, F.size("matched_terms") / F.size("terms")).otherwise(F.lit(0.0))
    scored = found.withColumn("score", F.col("similarity") + config.lexical_weight * lexical + bonus)
    w = Window.partitionBy("query_id")
    return scored.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("score"), F.desc("similarity"), "window_id", "chunk_id")), "best_similarity": F.max("similarity").over(w)})


def cover(ranked: DataFrame, top_k: int = DEFAULT.top_k) -> DataFrame:
    """The first ``top_k``, and with two schemes or more one further best hit of each named scheme."""
    beyond = F.col("rank") > top_k
    place = F.row_number().over(Window.partitionBy("query_id", "scheme", beyond).orderBy("rank"))
    reserved = beyond & (F.size("schemes") >= 2) & F.array_contains("schemes", F.col("scheme")) & (F.col("__place") == 1)
    return ranked.withColumn("__place", place).filter(~beyond | reserved).drop("__place")


def retrieve(questions: DataFrame, chunks: DataFrame, top_k: int = 0, config: EngineConfig = DEFAULT, profile: Profile = DEMO) -> DataFrame:
    """Hits of each question (query_id, question, embedding): filtered windows, merged, re-ranked, with every named scheme covered.

    Where the collection holds nothing that the filter lets through, the question is asked without it and its terms keep the schemes' words.
    """
    top_k = top_k or config.top_k
    fetch = max(top_k, config.top_k_fetch)
    named = questions.withColumn("schemes", detect_schemes(F.col("question"), profile)).withColumn("windows", windows_of(F.col("schemes"), profile))
    present = chunks.select("scheme").distinct()
    seen = named.select("query_id", F.explode(F.flatten("windows")).alias("scheme")).distinct().join(present, "scheme", "left_semi").select("query_id", F.lit(True).alias("__seen")).distinct()
    fits = F.col("__seen") | (F.size("schemes") == 0)
    asked = named.join(seen, "query_id", "left").withColumns({"windows": F.when(fits, F.col("windows")), "schemes": F.when(fits, F.col("schemes")).otherwise(F.array().cast("array<string>"))}).drop("__seen")
    # terms come from each question once, before the join that copies them to its candidates
    hits = merged(nearest(asked, chunks, fetch)).join(asked.select("query_id", "question", "schemes", content_terms(F.col("question"), F.col("schemes"), profile).alias("terms")), "query_id")
    full = hits.join(with_normal_text(chunks.drop("embedding")).withColumn("chunk_id", F.col("chunk_id").cast("string")), "chunk_id")
    return cover(rerank(full, config, profile), top_k)


def above_floor(hits: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    return hits.filter(F.col("similarity") >= config.min_similarity)


def has_usable_context(hits: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Rows (query_id, usable, any_keyword_hit): judged by the best of all candidates, returned or not."""
    return hits.groupBy("query_id").agg((F.max("best_similarity") >= config.min_similarity).alias("usable"), F.bool_or(F.size("matched_terms") > 0).alias("any_keyword_hit"))
