"""K-d tree sharding by bytes, in DataFrame operations only.

Points are groups of rows with equal texts, weighed by bytes; a group heavier than a ``PIECE_SHARE`` of a shard is
cut into salted pieces, so a hot group spreads and shards stay near equal.  A point's coordinates are metadata scaled to
16 bits: size, smallest ``doc_id``, language and source (by hash).  Each level of the tree cuts every leaf at
its weighted median along its widest coordinate; ties within a coordinate are ordered by the point's own hash, so a
cut can fall anywhere.  Medians are found by three rounds of histograms (4096 bins a leaf each), which
together resolve all 36 bits of an ordered coordinate: nothing is sampled, and nothing comes to the driver but
the sums of all bytes and rows.  A leaf that stands for ``n`` shards is cut in the proportion of n//2 to the rest.

Defined cases: null text has size 1 and checksum 0; an empty table gives no rows; null metadata take coordinate 0; repeated rows are
placed one by one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundspark.llm.common import LEAST_HOT, Scratch, spread_join, table

PIECE_SHARE, SLOT_ROWS = 0.02, 50_000
_BINS, _ROUNDS = 12, 3  # bits of a histogram; rounds that resolve 36 bits: 16 of the coordinate, 20 of the hash
#: Up to so many rows the table of cuts (a row for each leaf, some 40 bytes) and that of heavy groups are broadcast.
BROADCAST_LEAVES = 50_000


def _small(cuts: DataFrame, shards: int) -> DataFrame:
    return F.broadcast(cuts) if shards <= BROADCAST_LEAVES else cuts


def _scaled(value: Column, low: Column, high: Column) -> Column:
    return F.coalesce(F.floor((value - low) / F.greatest(high - low, F.lit(1)) * 65535), F.lit(0)).cast("long")


def assign(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, scratch: Scratch | None = None, least_hot: int = LEAST_HOT) -> DataFrame:
    """Rows ``doc_id, size, text_crc32, shard, slot`` for ``doc_id, text, lang, source``; give ``shards`` or the bytes of one."""
    scratch = scratch or Scratch(docs.sparkSession, "sharding")
    bytes_ = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = scratch.keep(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(bytes_) + 1).cast("long").alias("size"),
            F.crc32(bytes_).alias("text_crc32"),
            F.unhex(F.md5(bytes_)).alias("text_key"),
            F.crc32(F.coalesce(F.col("lang"), F.lit("")).cast("binary")).alias("lang_code"),
            F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")).alias("source_code"),
        ),
        "rows",
    )
    totals = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    n, total = totals["n"], totals["bytes"] or 0
    shards = shards or max(1, -(-total // target_bytes))
    most = max(1, int(total / shards * PIECE_SHARE))
    heavy = rows.groupBy("text_key").agg(F.sum("size").alias("weight")).filter(F.col("weight") > most).select("text_key", F.ceil(F.col("weight") / most).cast("int").alias("pieces"))
    piece = F.coalesce(F.pmod(F.xxhash64("doc_id", "text_key", F.lit(7)), F.col("pieces")), F.lit(0)).cast("int")
    # at most 1 / PIECE_SHARE groups a shard are heavy: broadcast, or the few that hold many rows
    marked = rows.join(F.broadcast(heavy), "text_key", "left") if shards / PIECE_SHARE <= BROADCAST_LEAVES else spread_join(rows, scratch.keep(heavy, "heavy"), "text_key", least_hot=least_hot)
    dealt = scratch.keep(marked.withColumn("piece", piece).drop("pieces"), "dealt")
    groups = dealt.groupBy("text_key", "piece").agg(F.sum("size").alias("weight"), F.max("size").alias("size"), F.min("doc_id").alias("doc_id"), F.min("lang_code").alias("lang_code"), F.min("source_code").alias("source_code"))
    ends = rows.agg(*[f(c).alias(f"{k}_{c}") for c in ("size", "doc_id") for k, f in (("low", F.min), ("high", F.max))])
    point = groups.crossJoin(F.broadcast(ends)).select(  # one row
        "text_key", "piece", "weight", F.lit(0).alias("leaf"),
        F.array(_scaled(F.log2(F.col("size")) * 1000, F.log2(F.col("low_size")) * 1000, F.log2(F.col("high_size")) * 1000), _scaled(F.col("doc_id"), F.col("low_doc_id"), F.col("high_doc_id")), F.shiftright("lang_code", 16).cast("long"), F.shiftright("source_code", 16).cast("long")).alias("at"),
        F.pmod(F.xxhash64("text_key", "piece"), F.lit(1 << 20)).alias("own"),
    )
    points = scratch.keep(point, "points0")
    sizes = {0: shards}  # shards that each leaf stands for; leaves are named by their first shard
    level = 0
    while any(s > 1 for s in sizes.values()):
        level += 1
        points = scratch.keep(_split(points, sizes, shards), f"points{level}")
        scratch.drop(f"points{level - 1}")
        sizes = {k: v for leaf, s in sizes.items() for k, v in ([(leaf, s // 2), (leaf + s // 2, s - s // 2)] if s > 1 else [(leaf, s)])}
    placed = dealt.join(points.select("text_key", "piece", F.col("leaf").cast("int").alias("shard")), ["text_key", "piece"])
    return _with_slots(placed.select("doc_id", "size", "text_crc32", "shard", "text_key"), n).drop("text_key")


def _split(points: DataFrame, sizes: dict[int, int], shards: int) -> DataFrame:
    """Cut every leaf that stands for several shards; ``leaf`` becomes the first shard of the half."""
    spark = points.sparkSession
    plan = _small(spark.createDataFrame([(k, s, s // 2) for k, s in sizes.items()], "leaf int, stands long, left_stands long"), shards)
    dims = range(4)
    spread = points.groupBy("leaf").agg(F.sum("weight").alias("leaf_weight"), F.array(*[F.max(F.col("at")[d]) - F.min(F.col("at")[d]) for d in dims]).alias("spread"))
    widest = spread.join(plan, "leaf").select("leaf", "stands", "left_stands", (F.col("leaf_weight") * F.col("left_stands") / F.col("stands")).alias("want"), (F.array_position("spread", F.array_max("spread")).cast("int") - 1).alias("dim"))
    found = points.join(_small(widest, shards), "leaf", "left").withColumn("z", F.expr("at[dim] * 1048576 + own"))
    cut = widest.select("leaf", F.lit(0).cast("long").alias("prefix"), F.col("want").alias("rest"))
    for k in range(_ROUNDS):
        shift = _BINS * (_ROUNDS - 1 - k)
        bins = (
            found.select("leaf", "z", "weight")
            .join(_small(cut, shards), "leaf")
            .filter(F.shiftright("z", shift + _BINS) == F.col("prefix"))
            .groupBy("leaf", F.shiftright("z", shift).alias("bin"), "rest")
            .agg(F.sum("weight").alias("bin_weight"))
        )
        w = Window.partitionBy("leaf").orderBy("bin")
        running = bins.withColumn("before", F.sum("bin_weight").over(w) - F.col("bin_weight"))
        cut = running.filter(F.col("before") <= F.col("rest")).groupBy("leaf").agg(F.max_by(F.struct(F.col("bin").alias("prefix"), (F.col("rest") - F.col("before")).alias("rest")), "bin").alias("s")).select("leaf", "s.*")
    cuts = cut.select("leaf", F.col("prefix").alias("cut"))
    moved = found.join(_small(cuts, shards), "leaf", "left")
    leaf = F.when((F.col("stands") > 1) & (F.col("z") >= F.col("cut")), F.col("leaf") + F.col("left_stands").cast("int")).otherwise(F.col("leaf"))
    return moved.select("text_key", "piece", "weight", leaf.cast("int").alias("leaf"), "at", "own")


def _with_slots(placed: DataFrame, n: int) -> DataFrame:
    """Gapless places in each shard, by buckets of bounded size and the running counts of buckets."""
    buckets = max(1, -(-n // SLOT_ROWS))
    dealt = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(buckets)))
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("in_bucket"))
    before = counts.select("shard", "bucket", (F.sum("in_bucket").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("in_bucket")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_key", "size"))
    return dealt.withColumn("place", place).join(before, ["shard", "bucket"]).withColumn("slot", F.col("before") + F.col("place") - 1).drop("bucket", "place", "before")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
