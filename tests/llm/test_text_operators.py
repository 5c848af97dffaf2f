"""Quality rules, toxicity, URLs, Jaccard join and passages against brute force on small tables."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
R = random.Random(5)
VOCAB = ["".join(R.choice("abcdefgh") for _ in range(5)) for _ in range(400)]


def prose(n, rng=R):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def corpus():
    rng = random.Random(9)
    base = [prose(n, rng) for n in (0, 1, 3, 4, 5, 6, 30, 60, 80, 200, 400)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k, t in enumerate(base[6:]):
        w = t.split()
        for j in range(6):
            x = list(w)
            for _ in range(max(1, len(w) * j // 120)):
                x[rng.randrange(len(x))] = rng.choice(VOCAB)
            rows.append((100 + 10 * k + j, " ".join(x)))
    rows += [(900, None), (901, ""), (902, "  \t\n "), (903, base[8]), (903, base[8]), (904, base[8].upper()), (905, "Ünï " * 70), (906, "x" * 3000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, [(k, t, "en", None if k % 7 == 0 else f"s{k % 3}", 1) for k, t in corpus()])


def shingles(text):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    sets = [(k, shingles(t)) for k, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), k), k)
    return Counter((k, len(s), least[find(i)]) for i, (k, s) in enumerate(sets))


def test_jaccard_groups_are_those_of_brute_force(spark, docs):
    from groundspark.llm.jaccard import groups

    assert Counter(tuple(r) for r in groups(docs).select("doc_id", "n_shingles", "component_id").collect()) == components(corpus())


def test_jaccard_of_an_empty_table_and_extra_columns(spark):
    from pyspark.sql import functions as F

    from groundspark.llm.jaccard import groups, near_duplicate_stage

    empty = documents(spark, [])
    assert groups(empty).count() == 0
    clash = documents(spark, [(1, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", "s", 1), (3, "other", "en", "s", 1)]).withColumn("key", F.lit("x")).withColumn("root", F.lit(1))
    assert sorted(r["doc_id"] for r in near_duplicate_stage(spark, clash, "").collect()) == [1, 3]


def test_lists_for_the_driver_take_bytes_and_not_rows(spark):
    from pyspark.sql import functions as F

    from groundspark.llm import jaccard

    ids = spark.range(300_000)
    tracemalloc.start()
    try:
        bits = jaccard._filter_bits(ids.select(F.col("id").alias("doc_id")))
        frequent = jaccard._frequent(ids.select(F.xxhash64("id").alias("key"), (24 + F.col("id") % 3).alias("n")))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 40 << 20  # with an object for each row over 100 MB
    slots = {r[0] for r in ids.select(jaccard._slot(F.col("id"))).distinct().toLocalIterator()}
    assert int(np.bitwise_count(bits).sum()) == len(slots) and all(int(bits[k >> 6]) >> (k & 63) & 1 for k in slots)
    ranked = ids.select((24 + F.col("id") % 3).alias("n"), F.xxhash64("id").alias("key")).orderBy(F.desc("n"), "key").limit(jaccard.MOST_FREQUENT)
    assert sorted(frequent.hashes.view(np.int64).tolist()) == sorted(r["key"] for r in ranked.select("key").collect())


def test_sketches_never_part_sets_that_could_be_linked():
    from groundspark.llm.jaccard import bit_sketch, folded, most_apart, sketch_items
    from groundspark.llm.words import mix64

    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 7, 15, 16, 17, 40, 63, 64, 65, 190, 256, 700, 1030):
        for _ in range(20):
            common = int(rng.integers(max(1, int(0.76 * n)), n + 1))
            a = np.unique(mix64(rng.integers(0, 1 << 60, n).astype(np.uint64)))
            extra = int(rng.integers(0, max(1, int(common / 0.75 - len(a)) + 1)))
            b = np.unique(np.concatenate([a[:common], mix64(rng.integers(0, 1 << 60, extra).astype(np.uint64))]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 75 * (len(a) + len(b) - both):
                continue
            assert len(a) + len(b) - 2 * both <= min(most_apart(len(a)), most_apart(len(b)))
            assert set(sketch_items(a, None).tolist()) & set(sketch_items(b, None).tolist())
            x, y = np.frombuffer(bit_sketch(a), "u1"), np.frombuffer(bit_sketch(b), "u1")
            size = min(len(x), len(y))
            assert np.bitwise_count(folded(x, size) ^ folded(y, size)).sum() <= len(a) + len(b) - 2 * both


def brute_removal(rows, window):
    data = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(b[p : p + window] for _, b in data for p in range(len(b) - window + 1))
    out = []
    for k, b in data:
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - window + 1):
            if seen[b[p : p + window]] > 1:
                gone[p : p + window] = True
        kept = bytes(np.frombuffer(b, "u1")[~gone]) if len(b) else b""
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((k, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("window", [200, 40, 7])
def test_passages_are_those_of_brute_force(spark, docs, window):
    from groundspark.llm.passages import report

    assert Counter(tuple(r) for r in report(docs, window=window).collect()) == brute_removal(corpus(), window)


def test_suffixes_in_order_with_common_prefixes_and_spilled_queues():
    from groundspark.llm.suffix import sort_suffixes

    rng = np.random.default_rng(2)
    for turn in range(150):
        n, k, limit = int(rng.integers(1, 70)), int(rng.integers(1, 5)), int(rng.integers(1, 30))
        text = np.append(np.tile(rng.integers(1, k + 1, n), 1 + turn % 2), 0).astype(np.uint16)
        order, common = sort_suffixes(text, limit, memory=64 if turn % 3 == 0 else 1 << 20)
        t = text.tolist()
        assert sorted(order.tolist()) == list(range(len(t)))
        for i in range(1, len(t)):
            x, y = t[order[i - 1] :][:limit], t[order[i] :][:limit]
            assert x <= y
            assert common[i] == next((j for j, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_quality_counts_and_depleted_documents(spark):
    from groundspark.llm import quality

    rng = random.Random(1)
    shared = "shared line of the house number one and two and three and four and five and six"
    rows = [(k, prose(40, rng) + "\n" + shared, "en", "h", 1) for k in range(30)]
    rows += [(50, shared + "\n" + prose(12, rng), "en", "h", 1), (51, shared + "\n" + prose(12, rng), "en", "other", 1), (52, None, "en", None, 1), (53, "a b c d e f g h " * 5, "en", "h", 1), (54, "same\nsame\n\nsame # $", "en", "h", 1)]
    found = {r["doc_id"]: r for r in quality.judge(documents(spark, rows)).collect()}
    assert all(found[k]["kept"] for k in range(30)) and not found[50]["kept"] and found[51]["kept"]
    assert found[53]["n_repeat_words"] == 40 and found[53]["base_failed"] and found[52]["n_words"] == 0 and found[52]["base_failed"]
    assert (found[54]["n_dup_lines"], found[54]["n_symbols"], found[54]["word_chars"]) == (1, 2, 14)
    cleaned = {r["doc_id"]: r["text"] for r in quality.quality_stage(spark, documents(spark, rows), "").collect()}
    assert shared not in cleaned[3] and shared in cleaned[51] and 52 not in cleaned
    assert quality.judge(documents(spark, [])).count() == 0


def test_toxicity_held_out_accuracy_and_edge_texts(spark):
    from groundspark.llm import toxicity

    rng = random.Random(4)
    bad = ["vile", "awfulword", "nastything"]
    rows, labels = [], []
    for k in range(600):
        w = prose(rng.randrange(20, 200), rng).split()
        if k % 5 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((k, " ".join(w), "en", "s", 1))
        labels.append((k, 1, int(k % 5 == 0)))
    rows += [(9001, None, "en", "s", 1), (9002, "", "en", "s", 1), (9003, prose(20000, rng), "en", "s", 1)]
    docs, labels = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = {r["doc_id"]: r["toxicity"] for r in toxicity.with_scores(docs, toxicity.fit(docs, labels)).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    right = sum((scored[k] >= 0.5) == (k % 5 == 0) for k in held)
    assert right / len(held) > 0.97 and all(0 <= s <= 1 for s in scored.values()) and scored[9001] == scored[9002] < 0.5 and scored[9003] < 0.5
    none = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert max(r["toxicity"] for r in toxicity.with_scores(docs, none).collect()) < 0.5
    assert toxicity.with_scores(docs.limit(0), none).count() == 0


def plain_score(text, model):
    """Word by word and window by window, each compressed on its own."""
    import math

    import zstandard
    from groundspark.llm import toxicity

    words = [int(toxicity.word_codes([w])[0][0]) for w in re.findall("[a-z\\x80-\U0010ffff]+", (text or "").lower())]
    setting = zstandard.ZstdCompressionParameters.from_level(5, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    length = lambda raw, content: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=setting).compress(raw))
    gains = []
    for k in range(0, len(words), 24):
        raw = b"".join(w.to_bytes(8, "little") for w in words[k : k + 24])
        gains.append(length(raw, model.ordinary) - length(raw, model.toxic + model.ordinary))
    mean, variance = model.chance
    beyond = (sum(g for g in gains if g > 3) - mean * len(gains)) / math.sqrt(1 + variance * len(gains) + (0.5 * mean * len(gains)) ** 2)
    figures = [math.log1p(max(0, beyond)), math.log1p(len(gains)), 1]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(figures, model.weights))))


def test_toxicity_query_equals_plain_scores(spark, tmp_path):
    from groundspark.llm import toxicity

    rng = random.Random(8)
    rows, labels = [], []
    for k in range(240):
        w = prose(rng.randrange(2, 90), rng).split()
        if k % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(["vile", "äwful", "nasty"]) + rng.choice(["!", ",", ""])
            w *= 2
        rows.append((k, " ".join(w), "en", "s", 1))
        labels.append((k, 1, int(k % 4 == 0)))
    rows += [(500, None, "en", "s", 1), (501, "", "en", "s", 1), (502, "1 2 !", "en", "s", 1), (None, "vile", None, None, None), (503, prose(3000, rng) + " vile äwful", "en", "s", 1), rows[4], rows[5]]
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fit(docs, marks)
    assert model.toxic and model.ordinary
    key = lambda x: (x[0] is None, x)
    found = sorted(((r["doc_id"], r["held_out"], round(r["score"], 9), r["predicted"]) for r in toxicity.op3_toxicity(spark, str(tmp_path)).collect()), key=key)
    plain = [(i, plain_score(t, model)) for i, t, *_ in rows]
    assert found == sorted(((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0, round(s, 9), int(s >= 0.5)) for i, s in plain), key=key)


def test_toxicity_pairs_stay_inside_texts_and_small_samples_are_whole(caplog):
    from groundspark.llm import toxicity

    texts = ["a b c", "", None, "d", "c a b", "a b"]
    code = lambda w: int(toxicity.word_codes([w])[0][0])
    assert sorted(map(tuple, toxicity.pairs(texts).tolist())) == sorted((code(x), code(y)) for x, y in ("ab", "bc", "ca"))
    assert toxicity.pairs([None, ""]).shape == (0, 2)
    assert toxicity.dictionary([b"0123456789abcdef", b"fedcba9876543210"], 1 << 14) == b"0123456789abcdeffedcba9876543210" and "too few" in caplog.text


def test_url_rules_and_model(spark):
    from groundspark.llm import urls

    cases = [
        (1, "http://www.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "https://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
        (3, "http://a.net/es/", "a.net", "/es/", "net/es/", "block"), (4, "http://x.com", "x.com", "", None, "allow"), (5, "ftp://x.com/a#b", "x.com", "/a", "com/", "allow"), (6, None, "", "", None, "allow"),
        (7, "no scheme", "", "", None, "allow"), (8, "https://casino-bets.example.org/en/5", "casino-bets.example.org", "/en/5", None, "block"), (9, "https://river-library.example.org/en/5", "river-library.example.org", "/en/5", None, "allow"),
        (10, "a://b://c/d", "b:", "//c/d", None, "allow"), (11, "http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ]
    pages = spark.createDataFrame([(k, u) for k, u, *_ in cases], "page_id long, url string")
    found = {r["page_id"]: r for r in urls.judge(pages).collect()}
    for k, _, host, path, rule, verdict in cases:
        assert (found[k]["host"], found[k]["path"], found[k]["rule"], found[k]["verdict"]) == (host, path, rule, verdict), k
    held = urls.labelled_urls(seed=99, each=60)
    p = urls.default_model().probability([urls._text(u) for u, _ in held])
    assert np.mean((p >= 0.5) == np.array([y for _, y in held])) > 0.95
