"""Evaluation and dataset preparation: ranks, AUC, correlations, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import group_percent


def midranks(rows: DataFrame, value: str, out: str, blocks: int = 64) -> DataFrame:
    """Adds the average rank of equal values.

    Only counts by value are put in order, in blocks between approximate quantiles, so no task sees all of them.
    """
    counts = rows.groupBy(value).agg(F.count("*").alias("_n"))
    splits = sorted(set(counts.approxQuantile(value, [i / blocks for i in range(1, blocks)], 0.01)))
    block = sum(((F.col(value) > s).cast("int") for s in splits), F.lit(0))
    counts = counts.withColumn("_block", block)
    sums = counts.groupBy("_block").agg(F.sum("_n").alias("_sum"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    upto = F.col("_start") + F.sum("_n").over(Window.partitionBy("_block").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranks = counts.join(starts, "_block").select(F.col(value), (upto - F.col("_n") + (F.col("_n") + 1) / 2).alias(out))
    return rows.join(ranks, value)


def roc_auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """n_positive, n_negative, auc from midranks (Mann-Whitney); null if a class is missing."""
    ranked = midranks(rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()), score, "_rank")
    sums = ranked.agg(F.sum(F.when(F.col(label) == 1, F.col("_rank"))).alias("r"), F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("n"))
    auc = F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("n"))
    return sums.select(F.col("p").alias("n_positive"), F.col("n").alias("n_negative"), F.round(auc, 6).alias("auc"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    ranked = midranks(midranks(rows.select(a, b).dropna(), a, "_ra"), b, "_rb")
    return ranked.agg(F.count("*").alias("n"), F.round(F.corr("_ra", "_rb"), 6).alias("spearman"))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], blocks: int = 64, count: str | None = None) -> DataFrame:
    """keys and a column for each share: the exact quantile of value, linear between neighbours. Nulls are left out.

    count: a column with how often a row counts.

    Only counts by value are put in order, in blocks between approximate quantiles, so no task sees a whole group.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg((F.sum(count) if count else F.count("*")).alias("_n"))
    splits = sorted(set(counts.approxQuantile("_v", [i / blocks for i in range(1, blocks)], 0.01)))
    counts = counts.withColumn("_block", sum(((F.col("_v") > s).cast("int") for s in splits), F.lit(0)))
    sums = counts.groupBy(*keys, "_block").agg(F.sum("_n").alias("_sum"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"), F.sum("_sum").over(group).alias("_all"))
    upto = F.col("_start") + F.sum("_n").over(Window.partitionBy(*keys, "_block").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.join(starts, [*keys, "_block"]).withColumn("_upto", upto)
    found = []
    for name, share in shares.items():
        place = share * (F.col("_all") - 1)
        low, high = (F.min(F.when(F.col("_upto") > at, F.col("_v"))) for at in (F.floor(place), F.ceil(place)))
        found += [low.alias(f"_low_{name}"), high.alias(f"_high_{name}"), F.first(place - F.floor(place)).alias(f"_part_{name}")]
    ends = placed.groupBy(*keys).agg(*found)
    return ends.select(*keys, *((F.col(f"_low_{x}") + F.col(f"_part_{x}") * (F.col(f"_high_{x}") - F.col(f"_low_{x}"))).alias(x) for x in shares))


def mean_by_label(rows: DataFrame, label: str, value: str) -> DataFrame:
    means = rows.groupBy(label).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"))
    middle = quantiles(rows, [label], value, {"median": 0.5, "p95": 0.95})
    return means.join(middle, label, "left").select(label, "n", "mean", "sd", "least", "most", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


def group_split(rows: DataFrame, group: str) -> DataFrame:
    """Adds split by the md5 of the group: 5% test, 5% val, else train; a group is never divided."""
    p = group_percent(F.col(group).cast("string"))
    return rows.withColumn("split", F.when(p < 5, "test").when(p < 10, "val").otherwise("train"))


def stratified_sample(rows: DataFrame, label: str, key: str, share: float) -> DataFrame:
    """Of each label the first round(n * share) rows by the md5 of the key.

    Counts by the first digits of the md5 tell where a label's sample ends; only rows with those digits are numbered.
    """
    marked = rows.withColumns({"_md5": F.md5(F.col(key).cast("string")), "_block": F.substring(F.md5(F.col(key).cast("string")), 1, 3)})
    counts = marked.groupBy(label, "_block").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(label)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select(label, "_block", before.alias("_before"), F.round(F.sum("_n").over(group) * share).cast("long").alias("_take"), F.col("_n").alias("_size"))
    placed = marked.join(places.filter("_before < _take"), [label, "_block"])
    whole = placed.filter("_before + _size <= _take")
    within = Window.partitionBy(label, "_block").orderBy("_md5", key)
    cut = placed.filter("_before + _size > _take").withColumn("_at", F.row_number().over(within)).filter("_before + _at <= _take")
    return whole.select(rows.columns).unionByName(cut.select(rows.columns))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_at = 1").drop("_at")


def at_most(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key, with their rank."""
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)
    return first.withColumn("rank", F.col("rank").cast("long"))


def precision_recall(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall of two 0/1 columns."""
    def count(p: int, a: int):
        return F.sum(((F.col(predicted) == p) & (F.col(actual) == a)).cast("long"))

    sums = rows.agg(count(1, 1).alias("tp"), count(1, 0).alias("fp"), count(0, 1).alias("fn"), count(0, 0).alias("tn"))
    return sums.select("*", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"))
