"""Weighted picks by equi-join.

A pick from a weighted group is a range lookup in its running weight.  The
guide table turns the range into a key: the running weight of a group is
scaled to ``nb`` buckets and every item is listed in the buckets it touches
(at most twice as many rows as items).  A uniform ``x`` in [0, nb) then joins
on ``(group, floor(x))`` and keeps the row with ``lo <= x < hi``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopgraph.functions.hashing import h


def guide_table(df: DataFrame, group: str, item: str, weight: str, block: int = 4096) -> DataFrame:
    """``(group, item, bucket, lo, hi, nb)`` plus the other columns of ``df``.

    Groups whose weights are all zero get equal weights.  Running weights are
    built per block of a group and shifted by the earlier blocks, so a large
    group is spread over many tasks.
    """
    stats = df.groupBy(group).agg(F.count(F.lit(1)).alias("_cnt"), F.sum(weight).alias("_sum"))
    w = F.when(F.col("_sum") > 0, F.col(weight)).otherwise(F.lit(1.0))
    rows = df.join(stats, group).withColumn("_w", w.cast("double")).withColumn(
        "_blk", h(item, 97) % F.ceil(F.col("_cnt") / F.lit(block))
    )
    inside = W.partitionBy(group, "_blk").orderBy(item)
    rows = rows.withColumn("_hi", F.sum("_w").over(inside.rowsBetween(W.unboundedPreceding, 0))).withColumn(
        "_lo",
        F.coalesce(F.sum("_w").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
    )
    blocks = rows.groupBy(group, "_blk").agg(F.max("_hi").alias("_tot"))
    over = W.partitionBy(group).orderBy("_blk")
    blocks = blocks.select(
        group,
        "_blk",
        F.coalesce(F.sum("_tot").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_off"),
        F.sum("_tot").over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_all"),
    )
    nb = F.col("_cnt").cast("double")
    scaled = (
        rows.join(blocks, [group, "_blk"])
        .withColumn("nb", nb)
        .withColumn("lo", (F.col("_off") + F.col("_lo")) / F.col("_all") * F.col("nb"))
        .withColumn("hi", (F.col("_off") + F.col("_hi")) / F.col("_all") * F.col("nb"))
        .filter("hi > lo")
    )
    last = F.greatest(F.least(F.ceil("hi") - 1, F.col("nb").cast("bigint") - 1), F.floor("lo"))
    return scaled.withColumn("bucket", F.explode(F.sequence(F.floor("lo"), last))).drop(
        "_cnt", "_sum", "_w", "_blk", "_hi", "_lo", "_off", "_all"
    )
