"""Sharding by a k-d tree: nodes are split at distributed weighted medians along their widest dimension.

The dimensions are the documents' metadata: doc_id, source and lang (by their ranks), size. A node that is to give
k shards is split so that its left part holds the bytes of ceil(k / 2) of them; the split is
found by summing bytes over the leading bits of (scaled value, hash of the row) and refining the
bucket in which the sum passes the share, so no rows are sorted and equal values can part. With
``target_bytes`` k starts as all bytes over the target; leaves then hold about that many bytes.

Everything is made of DataFrame operations. Equal texts may go to different shards: a group of
copies can be a third of all rows, more than a shard holds.

Defined results: a null text has no bytes and no text_crc32 of its own (0, as an empty one);
null doc_id, source or lang count as the lowest value; rows with equal doc_id and metadata can
part; an empty table gives an empty result; other columns of the input are not used.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm.common import hash60, settle, table
from lodestrata.llm.mixing import FEW_SOURCES, attached, thresholds

SCALE, HASH_BITS = 2**20, 40
PER_ROW = 8
ROWS_A_SLICE = 1024


def _ranked(rows: DataFrame, name: str, rank: str) -> DataFrame:
    """Adds the rank, from 0, of a column's value among its distinct ones in their order, null first. Values that are few are broadcast."""
    values = settle(rows.select(name).distinct(), "kd-values")
    numbered = settle(with_number(values, [F.col(name).asc_nulls_first()], rank), "kd-ranks")
    few = F.broadcast(numbered) if numbered.count() <= FEW_SOURCES else numbered.hint("merge")
    return rows.join(few.withColumnRenamed(name, "_v"), F.col(name).eqNullSafe(F.col("_v"))).drop("_v")


def with_number(values: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the place, from 0, in the order: ranges are numbered alone and start after those before them."""
    ranges = settle(values.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "kd-ranges")
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row for each range
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return ranges.withColumn("_inside", inside).join(F.broadcast(starts), "_range").withColumn(name, (F.col("_start") + F.col("_inside")).cast("double")).drop("_range", "_start", "_inside")


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard: shards of nearly equal bytes, numbered from 0 in the order of the tree's leaves."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + PER_ROW).cast("long")
    rows = docs.select("doc_id", "source", "lang", size.alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"), F.monotonically_increasing_id().alias("_row"))
    # equal doc_ids and texts are parted by the place of the row, which is fixed once the rows are written
    rows = settle(_ranked(_ranked(settle(rows, "kd-read"), "source", "v1"), "lang", "v2").withColumns({
        "tie": F.shiftright(hash60(F.col("doc_id"), F.col("text_crc32"), F.col("_row")), 60 - HASH_BITS),
        "v0": F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)), "v3": F.col("size").cast("double"),
    }).drop("source", "lang", "_row"), "kd-rows")
    dims = ["v0", "v1", "v2", "v3"]
    ends = rows.agg(F.sum("size").alias("bytes"), *[f(v).alias(f"{f.__name__}_{v}") for v in dims for f in (F.min, F.max)]).first()
    if ends.bytes is None:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"))
    k = shards or max(1, round(ends.bytes / target_bytes))
    width = {v: (ends[f"max_{v}"] - ends[f"min_{v}"]) or 1.0 for v in dims}
    scaled = [F.floor((F.col(v) - F.lit(ends[f"min_{v}"])) / F.lit(width[v]) * (SCALE - 1)).cast("long").alias(v) for v in dims]
    rows = rows.select("doc_id", "size", "text_crc32", "tie", *scaled, F.lit(0).alias("_mix_key"), F.lit(k).alias("k"))
    for _ in range(ceil(log2(k)) if k > 1 else 0):
        spans = F.array(*[F.max(v) - F.min(v) for v in dims])
        nodes = rows.filter("k > 1").groupBy("_mix_key", "k").agg(F.sum("size").alias("bytes"), spans.alias("spans"))
        left = F.ceil(F.col("k") / 2).cast("int")
        nodes = nodes.select("_mix_key", left.alias("left"), F.round(F.col("bytes") * left / F.col("k")).cast("long").alias("budget"), F.array_position("spans", F.array_max("spans")).cast("int").alias("axis"))
        nodes = settle(nodes, "kd-nodes")
        at = F.element_at(F.array(*dims), F.col("axis"))
        keyed = attached(rows, nodes, k, "left").withColumn("hash", F.shiftleft(at, HASH_BITS) + F.col("tie"))
        found = thresholds(keyed.filter("k > 1").select("_mix_key", "hash", "size"), nodes.select("_mix_key", "budget"), k)
        nearer = F.col("words") - (F.col("budget") - F.col("below")) < F.col("budget") - F.col("below")
        cuts = found.select("_mix_key", F.when(nearer, F.col("high")).otherwise(F.col("low")).alias("cut"))
        right = F.col("hash") >= F.col("cut")
        parted = attached(keyed, cuts, k, "left").withColumn("right", F.coalesce(right, F.lit(False)))
        new_k = F.when(F.col("k") == 1, 1).when(F.col("right"), F.col("k") - F.col("left")).otherwise(F.col("left"))
        leaf = F.when((F.col("k") > 1) & F.col("right"), F.col("_mix_key") + F.col("left")).otherwise(F.col("_mix_key"))
        rows = settle(parted.select("doc_id", "size", "text_crc32", "tie", *dims, leaf.cast("int").alias("_mix_key"), new_k.cast("int").alias("k")), "kd-level")
    return rows.select("doc_id", "size", "text_crc32", F.col("_mix_key").alias("shard"))


def with_slots(sharded: DataFrame) -> DataFrame:
    """Adds slot, gapless from 0 in each shard. Rows are numbered in slices of a shard, and a slice starts after those before it."""
    n = sharded.count()
    shards = max(1, sharded.select("shard").distinct().count())
    slices = max(1, ceil(n / shards / ROWS_A_SLICE))
    # written with its slices, so that both readings below have the same
    rows = settle(sharded.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id()), slices).cast("int")), "kd-sharded")
    before = W.partitionBy("shard").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "slice").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(W.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32")) - 1
    return rows.withColumn("inside", inside).join(starts.hint("merge"), ["shard", "slice"]).withColumn("slot", (F.col("start") + F.col("inside")).cast("long")).drop("slice", "inside", "start")


def op6_kd_shards(spark, sf_dir: str) -> DataFrame:
    placed = with_slots(kd_shards(table(spark, sf_dir, "documents"), shards=24))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
