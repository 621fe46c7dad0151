"""Dense row numbers in a global order without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hopgraph.plans.scratch import Scratch

_LOW33 = (1 << 33) - 1


def number_rows(df: DataFrame, *order: Column | str, name: str = "rn", start: int = 0) -> DataFrame:
    """Append ``name`` = start, start+1, ... in the order of ``order``.

    Range-partition, sort each partition, number inside it, then shift by the
    row counts of the earlier partitions.  The table of counts has one row per
    partition, which bounds the broadcast.  ``order`` must be a total order for
    the result to be reproducible.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "number")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mono", F.monotonically_increasing_id())
    )
    stored = scratch.cut(tagged)
    part = F.shiftright("_mono", 33)
    offsets = (
        stored.groupBy(part.alias("_part"))
        .count()
        .withColumn(
            "_off",
            F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)),
        )
        .select("_part", F.coalesce("_off", F.lit(0)).alias("_off"))
    )
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_off") + F.col("_mono").bitwiseAND(F.lit(_LOW33)) + F.lit(start))
        .drop("_part", "_off", "_mono")
    )
