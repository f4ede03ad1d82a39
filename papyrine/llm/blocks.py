"""Prefix sums and ranks over groups of any size, in blocks that no single task must hold together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.storage import materialize


def running_sums(df: DataFrame, group: list[str], block: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over the rows of the same group up to and with this one, by block, then order.

    Only sums of blocks (aggregated before the shuffle) are put in order for a whole group; rows are sorted within
    their block. Blocks should be many for large groups, and must ascend in the wanted order.
    """
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, block).agg(F.sum(value).alias("_sum"))
    starts = sums.select(*group, block, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(starts, [*group, block])
    return joined.withColumn(out, F.col("_start") + F.sum(value).over(within)).drop("_start")


def ranged_sums(df: DataFrame, order: list, values: dict[str, str], name: str) -> DataFrame:
    """df, written, with a column for each item of values: the sum of that column over all rows up to and with this one.

    The rows are sorted by range into as many parts as shuffles have, so a task holds one part; the sums of the parts (one
    row each) are put in order by one task. Rows that are alike in order get sums in any order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("_part").agg(*(F.sum(v).alias(f"_{out}") for out, v in values.items()))
    starts = sums.select("_part", *(F.coalesce(F.sum(f"_{out}").over(before), F.lit(0)).alias(f"_{out}") for out in values))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(F.broadcast(starts), "_part")
    return joined.withColumns({out: F.col(f"_{out}") + F.sum(v).over(within) for out, v in values.items()}).drop("_part", *(f"_{out}" for out in values))
