"""Mixing sources to target weights by weighted fair queueing.

Each source is shuffled by a hash of its documents' ids. A document's virtual finish time in pass e over its source is
(e * source size + sizes up to and with it) / target of the source, as if all sources were sent at once at rates in
proportion to their targets. All passes of all documents are put in the order of their finish times and cut where the
running total would exceed the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.blocks import ranged_sums, running_sums
from papyrine.storage import materialize

#: Passes over a source at most.
PASSES = 3
#: Steps of virtual time whose totals are gathered before the order within the last step is looked at.
STEPS = 4096
#: Up to this many documents of a mix are broadcast to be joined with their texts (25 MB); more are joined by a shuffle.
BROADCAST_ROWS = 250_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), passes: int = PASSES) -> DataFrame:
    """source, source_size, target, from rows of source and source_size (one for each source).

    Sources by code point, null last, take weights in turn and share the sum of all sizes; a target stops at passes
    times the source's size, and the others share the excess by weight. Level k gives the first k sources by size per
    weight their limit; the first level whose share is within the next source's limit holds. Empty tables give no rows.
    """
    total = sizes.agg(F.sum("source_size")).first()[0]
    named = ranged_sums(sizes.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], {"nth": "one"}, "mixing-sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    planned = named.withColumn("weight", weight.cast("long")).withColumn("limit", passes * F.col("source_size"))
    by_ratio = [(F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    planned = ranged_sums(planned.drop("nth"), by_ratio, {"level": "one", "limits": "limit", "upto": "weight"}, "mixing-levels")
    every = planned.agg(F.sum("weight")).first()[0]
    left = F.lit(total).cast("long") - F.col("limits") + F.col("limit")
    planned = planned.withColumns({"left": left, "shares": F.lit(every).cast("long") - F.col("upto") + F.col("weight")})
    holds = F.col("left").cast("decimal(19,0)") * F.col("weight").cast("decimal(19,0)") <= F.col("limit").cast("decimal(19,0)") * F.col("shares").cast("decimal(19,0)")
    cut = planned.filter(holds).agg(F.min(F.struct("level", "left", "shares")).alias("cut")).select("cut.*").first()
    level, left, shares = cut if cut and cut[0] is not None else (1, 0, 1)
    shared = (F.col("weight") * F.lit(left)).cast("double") / F.lit(shares).cast("double")
    return planned.select("source", "source_size", F.when(F.col("level") < level, F.col("limit").cast("double")).otherwise(shared).alias("target"))


def _size(text) -> Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), passes: int = PASSES) -> DataFrame:
    """doc_id, source, size, source_size, target, times for every row of docs (doc_id, text, source).

    times is how often the mix has the document, 0 to passes. Documents without words have size 0 and are never taken;
    a null source is a source. Repeated rows are documents of their own; rows that share doc_id, source and size are
    alike, so reruns give the same rows. Other columns are ignored.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size("text").alias("size"))
    rows = chosen.select("doc_id", "source", "size", F.concat(F.lit("."), "source").alias("_named"), key.alias("_key"))
    rows = materialize(rows.withColumn("_named", F.coalesce("_named", F.lit(""))).withColumn("_block", F.substring("_key", 1, 3)), "mixing-sizes")
    targets = source_targets(rows.groupBy("_named", "source").agg(F.sum("size").alias("source_size")).drop("_named"), weights, passes)
    targets = materialize(targets.withColumn("_named", F.coalesce(F.concat(F.lit("."), "source"), F.lit(""))).drop("source"), "mixing-targets")
    queued = running_sums(rows, ["_named"], "_block", ["_key", "doc_id", "size"], "size", "_upto")
    queued = materialize(queued.join(targets, "_named"), "mixing-queued")

    passed = queued.filter("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("_pass"))
    passed = passed.withColumn("_finish", (F.col("_pass") * F.col("source_size") + F.col("_upto")).cast("double") / F.col("target"))
    # At time 2 more than the budget has been sent: at time 1 it lacks less than a document of each source.
    passed = passed.withColumn("_step", F.least(F.floor(F.col("_finish") * STEPS), F.lit(2 * STEPS)).cast("int"))
    budget = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    totals = passed.groupBy("_step").agg(F.sum("size").alias("sent"))
    totals = totals.select("_step", F.sum("sent").over(Window.orderBy("_step")).alias("upto"), "sent")
    cut = totals.filter(F.col("upto") > budget).agg(F.min(F.struct("_step", F.col("upto") - F.col("sent")))).first()[0]
    step, sent = cut or (2 * STEPS + 1, 0)
    last = ranged_sums(passed.filter(F.col("_step") == step), ["_finish", "_named", "_key", "doc_id", "size", "_pass"], {"_within": "size"}, "mixing-last")
    last = last.filter(sent + F.col("_within") <= budget)
    last = last.groupBy("_named", "_upto").agg(F.count("*").alias("_last"))  # _upto differs among a source's rows of any size above 0
    earlier = sum((F.least(F.floor((k * F.col("source_size") + F.col("_upto")).cast("double") / F.col("target") * STEPS), F.lit(2 * STEPS)) < step).cast("long") for k in range(passes))
    out = queued.join(last, ["_named", "_upto"], "left").withColumn("times", earlier + F.coalesce("_last", F.lit(0)))
    times = F.when(F.col("size") > 0, F.col("times")).otherwise(0).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", times.alias("times"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), passes: int = PASSES) -> DataFrame:
    """The rows of docs, with all columns whatever their names, each as often as the mix has it.

    Of rows that are alike in doc_id, source and size, those taken more often come first by the text's hash.
    """
    keys = ["doc_id", "source", "size"]
    mixed = materialize(mix_sources(docs, weights, passes).select(*keys, "times"), "mixing-times")
    own = [F.col("doc_id").cast("long").alias("_d"), F.col("source").cast("string").alias("_s"), _size("text").alias("_z"), F.xxhash64("text").alias("_h")]
    chosen = docs.select(F.struct("*").alias("row"), *own)
    if mixed.groupBy(*keys).count().filter("count > 1").isEmpty():
        mixed, chosen = mixed.withColumn("nth", F.lit(1)), chosen.withColumn("_n", F.lit(1))
    else:
        mixed = mixed.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("times").desc())))
        chosen = chosen.withColumn("_n", F.row_number().over(Window.partitionBy("_d", "_s", "_z").orderBy("_h")))
    taken = mixed.filter("times > 0")
    if mixed.count() <= BROADCAST_ROWS:
        taken = F.broadcast(taken)
    same = F.col("_d").eqNullSafe(F.col("doc_id")) & F.col("_s").eqNullSafe(F.col("source")) & (F.col("_z") == F.col("size")) & (F.col("_n") == F.col("nth"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return chosen.join(taken, same).select("row", copies.alias("copy")).select("row.*")
