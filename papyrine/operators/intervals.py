"""Timelines: months, unions, gaps and overlaps of intervals, by owner. Intervals have whole start and end, both inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_number(ts: Column) -> Column:
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("long")


def islands(intervals: DataFrame) -> DataFrame:
    """owner, start, end of the merged intervals; neighbours that touch or follow at once are one.

    Intervals without an end come after those of their start that have one, and those without a start last, each alone.
    """
    w = Window.partitionBy("owner").orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") <= before + 1, 0).otherwise(1)
    marked = intervals.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("owner", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("owner", "start", "end")


def union_length(intervals: DataFrame) -> DataFrame:
    """owner, n_islands, covered: the length of the union."""
    return islands(intervals).groupBy("owner").agg(F.count("*").alias("n_islands"), F.sum(F.col("end") - F.col("start") + 1).alias("covered"))


def gaps(intervals: DataFrame, least: int) -> DataFrame:
    """owner, gap_from, gap_to, length of stretches of least or more between an owner's islands."""
    w = Window.partitionBy("owner").orderBy(F.asc_nulls_last("start"))
    follows = islands(intervals).withColumn("next", F.lead("start").over(w))
    found = follows.select("owner", (F.col("end") + 1).alias("gap_from"), (F.col("next") - 1).alias("gap_to"))
    return found.filter(F.col("gap_to").isNotNull()).withColumn("length", F.col("gap_to") - F.col("gap_from") + 1).filter(F.col("length") >= least)


def overlaps(intervals: DataFrame, least: int) -> DataFrame:
    """owner, id_a, id_b, months of pairs id_a < id_b of one owner that share least or more.

    intervals also needs id. The join is on owner and a bucket of the interval's length class, so intervals of an owner
    that lie far apart never meet: each interval is put in every bucket it touches, and a pair is made where it begins.
    """
    width = 64
    cut = intervals.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    a = cut.select("owner", "bucket", F.col("id").alias("id_a"), F.col("start").alias("s_a"), F.col("end").alias("e_a"))
    b = cut.select("owner", "bucket", F.col("id").alias("id_b"), F.col("start").alias("s_b"), F.col("end").alias("e_b"))
    start, end = F.greatest("s_a", "s_b"), F.least("e_a", "e_b")
    pairs = a.join(b, ["owner", "bucket"]).filter((F.col("id_a") < F.col("id_b")) & (start <= end) & (F.floor(start / width) == F.col("bucket")))
    return pairs.select("owner", "id_a", "id_b", (end - start + 1).alias("shared")).filter(F.col("shared") >= least)


def overlap_matrix(intervals: DataFrame) -> DataFrame:
    """kind_a, kind_b, shared: summed over owners, for every ordered pair of kinds of intervals."""
    pairs = overlaps(intervals.select("owner", F.struct("kind", "id").alias("id"), "start", "end"), 1)
    both = pairs.select(F.col("id_a.kind").alias("kind_a"), F.col("id_b.kind").alias("kind_b"), "shared")
    turned = both.select(F.col("kind_b").alias("kind_a"), F.col("kind_a").alias("kind_b"), "shared")
    return both.unionAll(turned).groupBy("kind_a", "kind_b").agg(F.sum("shared").alias("shared"))


def years_and_months(months: Column) -> Column:
    return F.concat_ws(" ", F.when(months >= 12, F.concat(F.floor(months / 12).cast("string"), F.lit(" yr"))), F.when((months % 12 > 0) | (months < 12), F.concat((months % 12).cast("string"), F.lit(" mo"))))
