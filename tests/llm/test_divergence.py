"""The divergence audit against plain integer arithmetic, and the tries under it."""

import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from groundspark.llm import divergence, tries
from groundspark.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, value string"


def plain(rows, least=3, top=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        names = sorted(s for x, s in groups if x == lang)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in names}
        share = lambda n, of: 1 + 10**9 * (n + 1) // (of + len(kept))
        far = lambda p, q: (p - q) ** 2 // q
        p = {s: {t: share(counts[lang, s][t], total[s]) for t in kept} for s in names}
        q = {t: share(sum(counts[lang, s][t] for s in names), sum(total.values())) for t in kept}
        pairs = [(sum(far(p[source][t], p[s][t]) for t in kept), s) for s in names if s != source]
        terms = [(far(p[source][t], q[t]), t) for t in kept if counts[lang, source][t] and p[source][t] > q[t]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "été", "ßen", "naïve", "中文字", "x1y", "don't", "zz", "théorie", "theory", "thesis", "\U0001d400b"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for k in range(90):
        text = None if k % 17 == 0 else "" if k % 19 == 0 else " ".join(rng.choices(words, k=rng.choice([1, 5, 40])))
        rows.append((k, text, rng.choice(["en", "en", "fr", None]), rng.choice(["a", "a", "a", "b", "c", None, ""]), "kept out"))
    return rows + [rows[3], rows[3], (None, "alone and only", "xx", "z", None), (None, "empty", "yy", "z", None), (7, None, "yy", "w", None), (1, "long " * 50_000 + "the", "en", "b", None)]


def test_divergence_equals_plain_arithmetic_with_any_number_of_ranges(spark):
    rows = made(1)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    wanted = plain(rows)
    assert any(r[2] == "term" for r in wanted) and ("yy", "z", "pair", "w", 0, 1) in wanted
    for range_leaves in (divergence.RANGE_LEAVES, 40):
        found = divergence.divergence(docs, Scratch(spark, "test"), range_leaves=range_leaves)
        assert sorted(map(tuple, found.select("lang", "source", "part", "item", "value", "rank").collect())) == wanted
    short = divergence.divergence(docs, Scratch(spark, "test"), least_docs=2, top=4, range_leaves=100)
    assert sorted(map(tuple, short.select("lang", "source", "part", "item", "value", "rank").collect())) == plain(rows, 2, 4)


def test_empty_table_and_bounds_of_ranges(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    found = divergence.divergence(nothing, Scratch(spark, "test"))
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"] and found.count() == 0
    # many partitions with the same terms: each range gets its part of every trie, and no more
    docs = spark.createDataFrame([(k, " ".join(f"t{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(k % 7, 500, 3)), "en", "s", None) for k in range(60)], SCHEMA).repartition(6)
    scratch = Scratch(spark, "test")
    written = scratch.keep(divergence.term_segments(docs, segment=50), "segments")
    bounds = divergence.range_bounds(written, 500)
    assert bounds == sorted(set(bounds))
    blocks = divergence.merged_terms(written, leaves=500)
    terms = [t for batch in blocks.toArrow().combine_chunks().to_batches() for _, trie in tries.rows_of(batch) for t in trie.terms]
    assert len(bounds) > 3 and len(terms) == len(set(terms)) == 500 and "Window" not in blocks._jdf.queryExecution().executedPlan().toString()


def test_ranges_are_even_where_all_tries_begin_with_the_same_term(spark):
    words = [f"t{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(500)]
    rng = random.Random(4)
    docs = spark.createDataFrame([(k, " ".join(w for w in words if w == words[0] or rng.random() < 0.9), "en", "s", None) for k in range(20)], SCHEMA)
    written = Scratch(spark, "test").keep(divergence.term_segments(docs.repartitionById(20, docs.doc_id.cast("int")), segment=1000), "segments")
    terms = [t for batch in written.toArrow().to_batches() for _, trie in tries.rows_of(batch) for t in trie.terms]
    bounds = [first for _, first in divergence.range_bounds(written, 1000)]
    in_range = Counter(bisect_right(bounds, t) for t in terms)
    assert written.count() == 20 and len(terms) > 8000 and max(in_range.values()) < 2000
    merged = [(t, n) for batch in divergence.merged_terms(written, leaves=1000).toArrow().to_batches() for _, trie in tries.rows_of(batch) for t, n in zip(trie.terms, trie.docs.tolist())]
    assert sorted(merged) == sorted((t, n) for t, n in Counter(terms).items() if n >= divergence.LEAST_DOCS)


def test_share_is_exact_for_large_counts():
    for n, total in ((1, 3), (0, 1), (4_999_999_999_999, 5_000_000_000_000), (123_456_789_012_345, 8_999_999_999_999_999)):
        assert int(divergence.share(np.array([n]), np.array([total]))[0]) == 1 + 10**9 * n // total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.binary(min_size=1, max_size=6), st.binary(min_size=0, max_size=3).map(lambda x: b"x" * 40 + x)), st.sampled_from("abc"), st.integers(1, 5)), max_size=60), st.integers(1, 4), st.integers(1, 9))
def test_merged_tries_hold_the_sums(entries, parts, size):
    pieces = []
    for k in range(parts):
        docs, sources = Counter(), defaultdict(Counter)
        for term, source, n in entries[k::parts]:
            docs[term] += 1
            sources[source][term] += n
        for row in tries.Trie.counted(docs, sources).segments("x", size):
            ((lang, piece),) = tries.rows_of(row)
            assert lang == "x" and piece.terms[0] == row.column(1)[0].as_py() and piece.terms[-1] == row.column(2)[0].as_py()
            pieces.append(piece)
    wanted, docs = defaultdict(Counter), Counter()
    for term, source, n in entries:
        wanted[term][source] += n
        docs[term] += 1
    if pieces:
        whole = tries.Trie.merged(pieces)
        some = whole.where(whole.docs > 1)
        for trie, terms in ((whole, sorted(wanted)), (some, sorted(t for t in wanted if docs[t] > 1))):
            assert trie.terms == terms and trie.docs.tolist() == [docs[t] for t in terms]
            found = defaultdict(dict)
            for leaf, place, n in zip(trie.leaf.tolist(), trie.place.tolist(), trie.counts.tolist()):
                found[trie.terms[leaf]][trie.names[place]] = n
            assert found == {t: dict(wanted[t]) for t in terms}
