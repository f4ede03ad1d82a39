"""Skills: normalising, the cascade of matches between what is wanted and what is had, and scores of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.storage import materialize

CONFIDENCE = {"direct": 1.0, "related": 0.6, "partial": 0.4, "missing": 0.0}


def normalized(skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """skills(owner, skill) in canonical form by aliases(alias, canonical), else as it is; once per owner whatever the case."""
    names = skills.select("owner", F.lower(F.trim("skill")).alias("alias")).join(aliases, "alias", "left")
    return names.select("owner", F.lower(F.coalesce("canonical", "alias")).alias("skill")).distinct()


def cascade(pairs: DataFrame, have: DataFrame, want: DataFrame, relations: DataFrame) -> DataFrame:
    """left, right, skill, kind, confidence for every skill that right wants, against those that left has.

    Equal is direct; a relation (src, dst, ord) from the wanted skill is related; containment either way is partial;
    else missing. The first kind counts. Containment only looks at skills of the pair that had neither.
    """
    # Both sides are looked at four times, so they are made once.
    wanted = materialize(pairs.join(want.select(F.col("owner").alias("right"), "skill"), "right"), "cascade-wanted")
    had = materialize(have.select(F.col("owner").alias("left"), F.col("skill").alias("own")), "cascade-had")
    direct = wanted.join(had.withColumnRenamed("own", "skill"), ["left", "skill"], "left_semi").withColumn("kind", F.lit("direct"))
    rest = wanted.join(direct.select("left", "right", "skill"), ["left", "right", "skill"], "left_anti")
    linked = rest.join(relations.select(F.col("src").alias("skill"), F.col("dst").alias("own")), "skill").join(had, ["left", "own"], "left_semi")
    related = linked.select("left", "right", "skill").distinct().withColumn("kind", F.lit("related"))
    rest = rest.join(related.select("left", "right", "skill"), ["left", "right", "skill"], "left_anti")
    partial = rest.join(had, "left").filter(F.contains("own", "skill") | F.contains("skill", "own")).select("left", "right", "skill").distinct().withColumn("kind", F.lit("partial"))
    missing = rest.join(partial.select("left", "right", "skill"), ["left", "right", "skill"], "left_anti").withColumn("kind", F.lit("missing"))
    every = direct.select("left", "right", "skill", "kind").unionAll(related.select("left", "right", "skill", "kind")).unionAll(partial.select("left", "right", "skill", "kind")).unionAll(missing.select("left", "right", "skill", "kind"))
    confidence = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in CONFIDENCE.items()))
    return every.withColumn("confidence", confidence)


def match_scores(matches: DataFrame, most: float = 20.0) -> DataFrame:
    """left, right, counts by kind, and most * confidence / wanted skills."""
    counts = [F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in CONFIDENCE]
    return matches.groupBy("left", "right").agg(*counts, F.round(most * F.sum("confidence") / F.count("*"), 6).alias("score"))


def requirement_verdicts(scores: DataFrame) -> DataFrame:
    """met if all are direct, transferable if some are related only, partial if some match, else missing; weighted percentage earned."""
    total = F.col("n_direct") + F.col("n_related") + F.col("n_partial") + F.col("n_missing")
    verdict = F.when(F.col("n_direct") == total, "met").when(F.col("n_direct") > 0, "partial").when(F.col("n_related") > 0, "transferable").when(F.col("n_partial") > 0, "partial").otherwise("missing")
    earned = F.when(F.col("verdict") == "met", 1.0).when(F.col("verdict") == "partial", 0.6).when(F.col("verdict") == "transferable", 0.4).otherwise(0.0)
    return scores.withColumn("verdict", verdict).withColumn("earned", earned)


def keyword_overlap(pairs: DataFrame, texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """left, right, shared, overlap, jaccard of distinct words: texts(owner, word) of left against keywords(owner, word) of right."""
    n_left = texts.groupBy("owner").agg(F.count("*").alias("n_left"))
    n_right = keywords.groupBy("owner").agg(F.count("*").alias("n_right"))
    both = pairs.join(keywords.select(F.col("owner").alias("right"), "word"), "right").join(texts.select(F.col("owner").alias("left"), "word", F.lit(1).alias("hit")), ["left", "word"], "left")
    shared = both.groupBy("left", "right").agg(F.count("hit").alias("shared"))
    sized = shared.join(n_left.withColumnRenamed("owner", "left"), "left", "left").join(n_right.withColumnRenamed("owner", "right"), "right")
    union = F.coalesce("n_left", F.lit(0)) + F.col("n_right") - F.col("shared")
    return sized.select("left", "right", "shared", F.round(F.col("shared") / F.col("n_right"), 6).alias("overlap"), F.round(F.least(F.lit(1.0), 5 * F.col("shared") / union), 6).alias("similarity"))


def first_findings(findings: DataFrame, n: int) -> DataFrame:
    """Of each owner the n findings that weigh most: severity, then points, once per title."""
    rank = F.create_map(*(x for k, v in {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}.items() for x in (F.lit(k), F.lit(v))))
    ranked = findings.withColumn("_severity", F.element_at(rank, F.col("severity")))
    once = Window.partitionBy("owner", F.lower("title")).orderBy("_severity", F.col("points").desc(), "ord")
    kept = ranked.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    order = Window.partitionBy("owner").orderBy("_severity", F.col("points").desc(), "ord")
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= n).drop("_n", "_severity")
