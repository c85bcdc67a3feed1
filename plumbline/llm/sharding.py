"""Sharding by rendezvous hashing of stable record keys over weighted shards.

The key and the shard list alone decide. A shard's score for a key depends on
no other shard, so one more shard takes rows only into itself, and a change of
one weight moves only what that shard gains or loses.

Null key: hashed as a fixed marker, all such rows share a shard. Null text: no
bytes (size 1, crc 0). Repeated rows share a shard and take slots of their own.
Ties of scores go to the lower shard. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import settle


def score(key: Column, shard: int, weight: float) -> Column:
    """-weight / ln(u), u uniform in (0, 1) from a hash of key and shard: a shard wins in proportion to its weight."""
    h = F.xxhash64(F.coalesce(key.cast("string"), F.lit("\x00null")), F.lit(shard))
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
    return F.lit(-float(weight)) / F.log(u)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard with the highest score; shards of weight 0 get nothing."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a weight")
    ranked = [F.struct(score(key, i, w).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights) if w > 0]
    return (-(F.greatest(*ranked)["i"] if len(ranked) > 1 else ranked[0]["i"])).cast("int")


def assign(
    docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", grown_weight: float = 1.0, buckets: int | None = None
) -> DataFrame:
    """key + size, text_crc32, law, shard, slot, grown_shard.

    slot counts each shard's rows from 0 without gaps. Rows are dealt to
    (shard, bucket) cells by hash; cell counts, shards x buckets of them, give
    each cell its first slot, so no shard is sorted in one task.
    """
    spark = docs.sparkSession
    buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    k, t = F.col(key), F.col(text)
    rows = docs.select(
        k,
        (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        rendezvous(k, weights).alias("shard"),
        rendezvous(k, [*weights, grown_weight]).alias("grown_shard"),
    )
    # The whole row decides the cell: rows of one key, however many, are dealt out.
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64(key, "size", "text_crc32", F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))
    rows = settle(rows)
    counts = rows.groupBy("shard", "_cell").count()
    first = counts.select(
        "shard", "_cell", F.expr("sum(count) over (partition by shard order by _cell) - count").alias("_first")
    )
    cell = "partition by shard, _cell order by {k}, size, text_crc32".format(k=f"`{key}`")
    numbered = rows.withColumn("_at", F.expr(f"row_number() over ({cell}) - 1"))
    return numbered.join(first, ["shard", "_cell"]).select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_at")).cast("long").alias("slot"), "grown_shard"
    )

