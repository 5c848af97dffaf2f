"""Cuts of the k-d tree against plain weighted medians, and equal texts on both sides of the limit."""

import random
import zlib
from collections import defaultdict

from groundspark.llm import sharding

POINTS = "text_key binary, piece int, weight long, leaf int, at array<long>, own long"


def plain_split(points, sizes):
    out = {}
    for leaf, stands in sizes.items():
        own = [p for p in points if p[3] == leaf]
        if stands < 2 or not own:
            out |= {(p[0], p[1]): leaf for p in own}
            continue
        spread = [max(p[4][d] for p in own) - min(p[4][d] for p in own) for d in range(4)]
        dim = spread.index(max(spread))
        z = lambda p: p[4][dim] * 2**20 + p[5]
        want, before, cut = sum(p[2] for p in own) * (stands // 2) / stands, 0, None
        weight = defaultdict(int)
        for p in own:
            weight[z(p)] += p[2]
        for value in sorted(weight):
            if before <= want:
                cut = value
            before += weight[value]
        out |= {(p[0], p[1]): leaf if z(p) < cut else leaf + stands // 2 for p in own}
    return out


def test_each_level_cuts_at_the_weighted_median_of_the_widest_coordinate(spark):
    rng = random.Random(12)
    points = []
    for k in range(400):
        leaf = rng.choice([0, 3, 5])
        at = [rng.randrange(w) if rng.random() < 0.9 else 7 for w in (65536, 200 if leaf else 65536, 65536 if leaf == 3 else 9, 40)]
        points.append((k.to_bytes(4, "big"), k % 2, rng.choice([1, 5, 900]), leaf, at, rng.randrange(2**20) if k % 7 else 11))
    sizes = {0: 3, 3: 2, 5: 1}
    found = sharding._split(spark.createDataFrame(points, POINTS), sizes, 6)
    assert {(bytes(r["text_key"]), r["piece"]): r["leaf"] for r in found.collect()} == plain_split(points, sizes)


def test_equal_texts_stay_together_unless_they_are_heavy(spark):
    rng = random.Random(3)
    light, heavy = "x" * 50, "heavy text " * 40
    texts = ["".join(rng.choices("abc ", k=rng.randrange(300))) for _ in range(1500)] + [light] * 3 + [heavy] * 200 + [None, None, ""]
    rows = [(k if k % 11 else None, t, rng.choice(["en", "de", None]), "s") for k, t in enumerate(texts)]
    placed = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards=4).collect()
    assert len(placed) == len(rows)
    of = defaultdict(list)
    for r in placed:
        of[r["text_crc32"]].append(r["shard"])
    crc = lambda t: zlib.crc32(t.encode())
    assert len(set(of[crc(light)])) == 1 and len(of[crc(light)]) == 3
    assert len(of[crc(heavy)]) == 200 and len(set(of[crc(heavy)])) > 1
    by = defaultdict(int)
    for r in placed:
        by[r["shard"]] += r["size"]
    assert sum(by.values()) == sum(len((t or "").encode()) + 1 for t in texts) and max(by.values()) < 1.1 * min(by.values())
    for shard in range(4):
        assert sorted(r["slot"] for r in placed if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in placed)))


def test_heavy_groups_are_dealt_alike_with_and_without_broadcast(spark, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choices("abc ", k=rng.randrange(200))) for _ in range(400)] + ["heavy text " * 40] * 150 + ["also heavy " * 30] * 40 + [None] * 3
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    found = lambda: sorted(tuple(r) for r in sharding.assign(docs, shards=4, least_hot=100).collect())
    broadcast = found()
    monkeypatch.setattr(sharding, "BROADCAST_LEAVES", 0)
    assert found() == broadcast and len(broadcast) == len(texts)
