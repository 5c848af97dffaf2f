"""Source divergence audit: how far the words of a source stand from those of the other sources of its language.

Each partition counts terms in byte tries, one a language, whose leaves hold a counter for each source; beyond ``TRIE_LEAVES`` leaves they are
written out as segments.  Segments are cut at the bounds of prefix ranges, which hold about ``RANGE_LEAVES`` leaves each (the bounds are quantiles of marks at
even distances inside all segments; first terms alone are nearly the same in all tries), and each range is merged into one trie, step by step, so a task holds that trie and little more.  Its traversal in UTF-8 order gives blocks of kept terms;
tasks over these blocks add up the divergence of all pairs of sources and keep the best ``top`` terms of each source, ties in the order of terms.

A term of any frequency is at most one leaf of each trie, so a common term is no hot key; neither is a source, which is a counter.  The sources of one language are held as
one array: the result has a row for each ordered pair of them, so that array is the square root of what is returned.

Defined cases: null text, lang and source are ''; each row is a document, repeated rows and ids too; a group without terms has counts of 0, a
language without kept terms has pairs of value 0 and no terms; a language of one source has no pairs; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundspark.llm.common import Scratch, bounded_batches, spread_join, table, tidy
from groundspark.llm.tries import COUNTERS, SEGMENT, SEGMENT_SCHEMA, Trie, cut_points, rows_of

LEAST_DOCS, TOP_TERMS, SCALE_STEPS, SCALE_STEP = 3, 200, 3, 1000  # shares are thousandths of thousandths of thousandths
#: Leaves of a task's tries, and about how many leaves (by weight) are read for one range, whose tries are merged whenever a ``RANGE_STEPS``-th of that has come.
TRIE_LEAVES, RANGE_LEAVES, RANGE_STEPS = 400_000, 1_600_000, 4
#: Numbers of one matrix.
CELLS = 1 << 20
#: Letters of ASCII in lower case and all other bytes from 128 on; the rest parts terms.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_PAIRS_AND_TERMS = "lang string, source string, part string, item string, value long"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLDED).split()


def _count(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    tries: dict[str, list[Trie]] = defaultdict(list)

    def written() -> Iterator[pa.RecordBatch]:
        for lang in sorted(tries):
            yield from Trie.merged(tries.pop(lang)).segments(lang, segment)

    for batch in batches:
        texts, langs, sources = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        holders: dict[str, Counter] = defaultdict(Counter)
        seen: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        for text, lang, source in zip(texts, langs, sources):
            found = terms_of(text)
            seen[lang][source].update(found)
            holders[lang].update(set(found))
        for lang, docs in holders.items():
            tries[lang].append(Trie.counted(docs, seen[lang]))
        if sum(len(t) for found in tries.values() for t in found) > TRIE_LEAVES:
            yield from written()
    yield from written()


def term_segments(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", segment: int = SEGMENT) -> DataFrame:
    """The tries of all partitions, as segments."""
    bounded_batches(docs.sparkSession)
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    return named.mapInArrow(tidy(lambda batches: _count(batches, segment)), SEGMENT_SCHEMA)


def range_bounds(found: DataFrame, leaves: int = RANGE_LEAVES) -> list[tuple[str, bytes]]:
    """First (lang, term) of each range but the first: about one for every ``leaves`` leaves of the table (by weight), as the planner's own range partitioning keeps them."""
    weight = found.agg(F.sum("leaves") + F.sum(F.size("counts")) / COUNTERS).first()[0] or 0
    ranges = -(-int(weight) // leaves)
    if ranges < 2:
        return []
    dealt = found.select("lang", F.explode("marks").alias("first")).repartitionByRange(ranges, "lang", "first")
    firsts = dealt.groupBy(F.spark_partition_id().alias("k")).agg(F.min(F.struct("lang", "first")).alias("low")).collect()
    return sorted((r["low"]["lang"], bytes(r["low"]["first"])) for r in firsts)[1:]


def merged_terms(found: DataFrame, least_docs: int = LEAST_DOCS, leaves: int = RANGE_LEAVES) -> DataFrame:
    """Segments of the terms in at least ``least_docs`` documents of their language; each range is merged by one task."""
    bounds = range_bounds(found, leaves)
    by_lang = defaultdict(list)
    for k, (lang, first) in enumerate(bounds):
        by_lang[lang].append((first, k + 1))
    langs = sorted(by_lang)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (lang, low, high) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                own = by_lang.get(lang, [])
                # the range before the first bound in this language began with an earlier language
                before = own[0][1] - 1 if own else max((n for x in langs[: bisect_left(langs, lang)] for _, n in by_lang[x]), default=0)
                firsts = [first for first, _ in own]
                a, b = bisect_right(firsts, low), bisect_right(firsts, high)
                if a == b:
                    yield with_part(batch.slice(k, 1), before + a)
                    continue
                ((_, trie),) = rows_of(batch.slice(k, 1))
                ends = cut_points(trie.terms, firsts[a:b])
                for j, (first, last) in enumerate(zip(ends[:-1], ends[1:])):
                    if first < last:
                        yield with_part(trie.segment(lang, first, last), before + a + j)

    def with_part(batch: pa.RecordBatch, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([part], pa.int32())], names=[*batch.schema.names, "part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tries, held, most = -1, defaultdict(list), 0, leaves // RANGE_STEPS

        def written() -> Iterator[pa.RecordBatch]:
            for lang in sorted(tries):
                trie = Trie.merged(tries.pop(lang))
                yield from trie.where(trie.docs >= least_docs).segments(lang)

        for batch in batches:
            for of_row, (lang, trie) in zip(batch.column(batch.num_columns - 1).to_pylist(), rows_of(batch)):
                if of_row != part:
                    yield from written()
                    part, held, most = of_row, 0, leaves // RANGE_STEPS
                tries[lang].append(trie)
                held += trie.weight()
                if held > most:
                    for x, parts in tries.items():
                        tries[x] = [Trie.merged(parts)]
                    held = sum(x[0].weight() for x in tries.values())
                    most = leaves // RANGE_STEPS + held
        yield from written()

    cut_up = found.mapInArrow(tidy(cut), SEGMENT_SCHEMA + ", part int")
    return cut_up.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part").mapInArrow(tidy(merge), SEGMENT_SCHEMA)


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 * count / total) for counts not over their total, by long division: exact for totals up to 9 * 10^15."""
    out, rest = np.zeros(np.broadcast(count, total).shape, dtype=np.int64), count
    for _ in range(SCALE_STEPS):
        digits, rest = np.divmod(rest * SCALE_STEP, total)
        out = out * SCALE_STEP + digits
    return out + 1


def _dense(trie: Trie, first: int, last: int, at: np.ndarray, sources: int) -> np.ndarray:
    counts = np.zeros((last - first, sources), dtype=np.int64)
    a, b = np.searchsorted(trie.leaf, [first, last])
    counts[trie.leaf[a:b] - first, at[trie.place[a:b]]] = trie.counts[a:b]
    return counts


def _score(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[list[str], np.ndarray]] = {}
        best: dict[tuple[str, str], list[tuple[int, bytes]]] = defaultdict(list)
        for batch in batches:
            extra = {k: batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("sources", "totals", "kept")}
            for k, (lang, trie) in enumerate(rows_of(batch)):
                sources, v = extra["sources"][k], extra["kept"][k]
                totals = np.array(extra["totals"][k], dtype=np.int64) + v
                all_counted = int(sum(extra["totals"][k])) + v
                place = {s: k for k, s in enumerate(sources)}
                at = np.array([place[s] for s in trie.names], dtype=np.int64)
                if lang not in sums:
                    sums[lang] = (sources, np.zeros((len(sources), len(sources)), dtype=np.int64))
                pairs, step = sums[lang][1], max(1, CELLS // len(sources))
                for first in range(0, len(trie), step):
                    last = min(first + step, len(trie))
                    counts = _dense(trie, first, last, at, len(sources))
                    p, q = share(counts + 1, totals), share(counts.sum(axis=1) + 1, all_counted)
                    for j, source in enumerate(sources):
                        away = p[:, j : j + 1] - p
                        pairs[j] += (away * away // p).sum(axis=0)
                        over = np.flatnonzero((counts[:, j] > 0) & (p[:, j] > q))
                        value = (p[over, j] - q[over]) ** 2 // q[over]
                        # stable: among equal values the traversal's order stands
                        over, value = (x[np.argsort(-value, kind="stable")[:top]] for x in (over, value))
                        found = best[lang, source]
                        found.extend((-int(n), trie.terms[first + int(i)]) for i, n in zip(over, value))
                        found.sort()
                        del found[top:]
        out = [(lang, s, "pair", t, int(n)) for lang, (names, pairs) in sums.items() for s, line in zip(names, pairs) for t, n in zip(names, line) if s != t]
        out += [(lang, s, "term", t.decode("utf-8", "replace"), -n) for (lang, s), found in best.items() for n, t in found]
        if out:
            columns = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(next(columns), kind) for kind in (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())], names=["lang", "source", "part", "item", "value"])

    return run


def divergence(docs: DataFrame, scratch: Scratch, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, range_leaves: int = RANGE_LEAVES) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): ``pair`` for each other source of the language, ``term`` for the ``top`` terms that a source uses more than its language.

    p of a term is 1 + floor(10^9 * (count + 1) / (N + V)), and the value floor((p - q)^2 / q), for a pair summed over the kept terms.
    """
    kept = scratch.keep(merged_terms(scratch.keep(term_segments(docs, text, lang, source), "segments"), least_docs, range_leaves), "kept")
    scratch.drop("segments")
    sums = kept.select("lang", F.explode(F.arrays_zip("names", "sums")).alias("x")).groupBy("lang", F.col("x.names").alias("source")).agg(F.sum("x.sums").alias("n"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]).distinct()
    by_lang = groups.join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("s"))
    sizes = kept.groupBy("lang").agg(F.sum("leaves").alias("kept"))
    totals = scratch.keep(by_lang.join(sizes, "lang", "left").select("lang", F.col("s.source").alias("sources"), F.col("s.n").alias("totals"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept")), "totals")
    scored = spread_join(kept, totals, "lang", "inner", least_hot=0).mapInArrow(tidy(_score(top)), _PAIRS_AND_TERMS)
    nothing = totals.select("lang", F.explode("sources").alias("source"), "sources").select("lang", "source", F.lit("pair").alias("part"), F.explode("sources").alias("item"), F.lit(0).cast("long").alias("value")).filter("source <> item")
    summed = scored.filter("part = 'pair'").unionByName(nothing).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    terms = scored.filter("part = 'term'").withColumn("rank", place).filter(F.col("rank") <= top)
    return summed.withColumn("rank", place).unionByName(terms)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"), Scratch(spark, "op11"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
tot AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
g AS (SELECT k.lang, grp.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(tot.total, 0) + v.v) AS p
      FROM kept k JOIN grp USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = k.lang AND c.source = grp.source AND c.term = k.term LEFT JOIN tot ON tot.lang = k.lang AND tot.source = grp.source),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(lt.total) + any_value(v.v)) AS q FROM c JOIN (SELECT lang, sum(total) AS total FROM tot GROUP BY lang) lt USING (lang) JOIN v USING (lang) GROUP BY lang, term),
ps AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(ps.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN ps ON ps.lang = a.lang AND ps.source = a.source AND ps.item = b.source),
terms AS (SELECT g.lang, g.source, 'term' AS part, g.term AS item, (p - q) * (p - q) // q AS value FROM g JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 200
"""
