"""Tokens, packing, token files, neighbours and shards against the libraries and brute force."""

import random
import zlib

import numpy as np
import pytest

TEXTS = [None, "", " ", "a", "Hello world. It's 5 o'clock!\n\nÀ la carte — naïve ½ cup", "x" * 5000, "日本語 と 😀 emoji", "tab\tand\x0bvertical \x85 \xa0 nbsp", "  two   spaces " * 30, "<|endoftext|> <s> ▁mark", "a <|endoftext|> b", "<|startoftext|>c <|ENDOFTEXT|>  d<|endoftext", "same text", "same text"]


def table(spark, texts=TEXTS):
    return spark.createDataFrame([(k * 3, t, "en", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def fuzz(n, seed=1):
    rng, signs = random.Random(seed), [*"ab eèÉ  \n\t.,'s1²½日😀\x85_-", "<|endoftext|>", "<|startoftext|>"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_ids_are_the_librarys(name, kind):
    from tokenizers import Tokenizer

    from groundspark.llm import tokens

    path = tokens.public_path(name)
    encoder = tokens.byte_encoder(path, tokens.public_path("byte_bpe_50k.tiktoken")) if kind == "byte" else tokens.word_encoder(path)
    library = Tokenizer.from_file(path)
    texts = [t or "" for t in TEXTS] + fuzz(1500)
    ids, offsets = encoder.encode(texts)
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_pieces_are_the_librarys_and_decode_back(spark):
    import sentencepiece

    from groundspark.llm import pieces
    from groundspark.llm.tokens import public_path

    path = public_path("piece_bpe_32k.model")
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=path), pieces.encoder(path)
    texts = [t or "" for t in TEXTS] + fuzz(1500, 2) + [" " * k for k in range(40)] + ["ab" * k for k in range(40)]
    ids, offsets = encoder.encode(texts)
    for k, t in enumerate(texts):
        own = ids[offsets[k] : offsets[k + 1]].tolist()
        assert own == library.encode(t), repr(t)
        assert encoder.decode(own) == library.decode(own)
    rows = pieces.decode(pieces.encode(table(spark), path).withColumnRenamed("text", "original"), path).collect()
    assert all((r["original"] or "").replace("▁", " ") == r["text"] for r in rows)


def test_packing_places_every_id_once_with_little_padding(spark):
    from tokenizers import Tokenizer

    from groundspark.llm import packing, tokens

    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice(["red", "green.", "blue", "over", "under!"]) for _ in range(rng.randrange(1, 3000))) for _ in range(40)]
    path = tokens.public_path("word_bpe_49k.json")
    rows = packing.pack(table(spark, texts), path, window=256).toPandas()
    library = Tokenizer.from_file(path)
    padding = 0
    for k, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        own = rows[rows.doc_id == 3 * k].sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n]) for a, n in zip(own.start, own.length)]
    for _, group in rows.sort_values("offset").groupby("sequence_id"):
        assert group.offset.tolist() == [0, *group.length.cumsum().tolist()[:-1]] and group.length.sum() <= 256
        n = int(group.length.sum())
        padding += 0 if n & (n - 1) == 0 else 256 - n
    assert padding < 0.03 * rows.length.sum()
    assert packing.pack(table(spark).limit(0), path).count() == 0


def test_cuts_are_the_cheapest():
    from groundspark.llm.packing import choose_cuts, powers, with_inner

    rng = np.random.default_rng(1)
    for _ in range(200):
        ends = np.unique(rng.integers(1, 60, rng.integers(1, 12)))
        ends, kinds = with_inner(ends, rng.integers(0, 4, len(ends)), 5, 3)
        best = {0: 0}
        for j, p in zip(ends.tolist(), kinds.tolist()):
            best[j] = min((best[i] + 12 - (j - i) + p for i in best if j - i <= 12), default=10**9)
        cuts, penalty = choose_cuts(ends, kinds, 12), dict(zip(ends.tolist(), kinds.tolist()))
        assert sum(12 - (b - a) + penalty[b] for a, b in zip([0, *cuts], cuts)) == best[int(ends[-1])]
    assert powers(13) == [8, 4, 1]


def test_grammar_round_trip_and_random_access():
    from groundspark.llm import tokenfile

    rng = np.random.default_rng(4)
    docs = [np.append(rng.integers(1, 30, rng.integers(0, 400)), 0) for _ in range(60)] + [np.array([7] * 999 + [0])]
    ids = np.concatenate(docs).astype(np.int32)
    symbols, left, right = tokenfile.compress(ids, 100, 0, least=5)
    assert len(symbols) < len(ids) and (tokenfile.expand(symbols, left, right, 100) == ids).all()
    row = tokenfile._block(0, 0, [None, *range(1, len(docs))], [len(d) for d in docs], ids, 100, 0)
    assert tokenfile.open_block(row, 100)[0][:2] == [None, 1]
    for k in (0, 5, len(docs) - 1):
        assert (tokenfile.read_document(row, k, 100) == docs[k]).all()
    empty = tokenfile.compress(np.zeros(0, dtype=np.int32), 100, 0)
    assert len(tokenfile.expand(*empty, 100)) == 0


def test_grammar_goes_on_until_no_pair_is_frequent():
    from groundspark.llm import tokenfile

    rng = np.random.default_rng(6)
    copies = np.tile(np.append(rng.integers(1, 5000, 700), 0), 600)
    prose = np.where(rng.random(60_000) < 0.02, 0, np.minimum(rng.zipf(1.3, 60_000), 4999))
    for ids, most in ((copies, 600 * 2), (prose, len(prose)), (np.array([7] * 5000 + [0]), 60)):
        ids = ids.astype(np.int32)
        symbols, left, right = tokenfile.compress(ids, 5000, 0)
        assert (tokenfile.expand(symbols, left, right, 5000) == ids).all() and len(symbols) <= most
        pairs = np.stack([symbols[:-1], symbols[1:]], axis=1)
        counts = np.unique(pairs[(pairs != 0).all(axis=1)], axis=0, return_counts=True)[1]
        assert counts.max(initial=0) < tokenfile.LEAST_COUNT


def test_token_file_is_read_back_in_order(spark, tmp_path):
    from tokenizers import Tokenizer

    from groundspark.llm import tokenfile, tokens

    path, size = str(tmp_path / "ids"), 50257
    json = tokens.public_path("byte_bpe_50k.json")
    docs = table(spark).orderBy("text")
    tokenfile.write_token_file(docs, path, json, None, size, shard_bytes=64)
    rows = tokenfile.with_starts(spark, path, tokenfile.read_token_file(spark, path, size, digest=True)).orderBy("doc_id").collect()
    full = {r["doc_id"]: r["tokens"] for r in tokenfile.read_token_file(spark, path, size).collect()}
    library, start = Tokenizer.from_file(json), 0
    for k, (row, text) in enumerate(zip(rows, TEXTS)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (3 * k, start, len(ids), zlib.crc32(ids)) and full[3 * k] == ids.tolist()
        start += len(ids)
    tokenfile.write_token_file(docs.limit(0), path, json, None, size)
    assert tokenfile.read_token_file(spark, path, size).count() == 0


def test_neighbours_recall_ties_and_odd_vectors(spark):
    from pyspark.sql import functions as F

    from groundspark.llm.neighbours import nearest

    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[40:60] = x[40]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0, None] * 8), (5200, [1.0]), (5250, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = nearest(df, F.col("vec_id") % 50 == 0).toPandas()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        s = unit @ unit[q]
        s[q] = -9
        best = np.lexsort((np.arange(3000), -np.round(s, 12)))[:5]
        own = found[found.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(own.score, s[own.vec_id], atol=1e-12)
        hits += len(set(own.vec_id) & set(best.tolist()))
    assert hits / 300 >= 0.9 and set(found.query_id) == set(range(0, 3000, 50))
    assert found[found.query_id == 50].sort_values("rank").vec_id.tolist() == [40, 41, 42, 43, 44]
    doubles = nearest(df.withColumn("embedding", F.col("embedding").cast("array<double>")).withColumn("leaf", F.lit("clash")), F.col("vec_id") == 50).orderBy("rank").toPandas()
    assert doubles.vec_id.tolist() == [40, 41, 42, 43, 44]
    few = nearest(df.filter("vec_id in (0, 1, 2, 5000)"), F.col("vec_id") == 0).collect()
    assert len(few) == 2 and nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_shards_are_near_equal_and_slots_gapless(spark):
    from groundspark.llm.sharding import assign

    rng = random.Random(6)
    rows = [(k, None if k % 50 == 0 else "t" * rng.randrange(1, 400) + str(rng.random()), rng.choice(["en", "de", None]), f"s{rng.randrange(5)}", 1) for k in range(1500)]
    rows += [(5000 + k, "hot " * 60, "en", "s0", 1) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    placed = assign(docs, shards=8).toPandas()
    sizes = placed.groupby("shard")["size"].sum()
    assert len(placed) == 2300 and sizes.index.tolist() == list(range(8)) and sizes.max() < 1.1 * sizes.min()
    for _, group in placed.groupby("shard"):
        assert sorted(group.slot) == list(range(len(group)))
    by_id = placed.set_index("doc_id")
    assert by_id.loc[0, "size"] == 1 and by_id.loc[0, "text_crc32"] == 0 and by_id.loc[5000, "text_crc32"] == zlib.crc32(b"hot " * 60)
    assert assign(docs.limit(0), shards=8).count() == 0
    assert assign(docs, target_bytes=100_000).select("shard").distinct().count() == -(-int(placed["size"].sum()) // 100_000)


def test_native_operators_run_no_python(spark):
    from groundspark.llm import quality
    from groundspark.llm.sharding import assign

    docs = table(spark)
    for df in (quality.judge(docs), assign(docs, shards=2)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(name in plan for name in ("Python", "Pandas", "Arrow", "CartesianProduct"))
