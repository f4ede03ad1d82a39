"""What a reader takes away from a first look: skimmed text, strengths that it shows, first impression, visual order, and findings
of all kinds as one list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import text_of, words
from papyrine.operators.reports import INTERRUPTS, LOW_KINDS, interrupting
from papyrine.operators.statements import METRIC
from papyrine.operators.wording import metric_phrase

# Words that a look takes in of a statement, strengths that are kept, words of a summary's opening, names of what
# someone is, the points of a first impression, and what spoils the visual order.
SKIMMED, STRENGTHS, OPENING = 8, 6, 14
IDENTITY = r"(?i)(^|[^A-Za-z0-9_])(engineer|developer|scientist|analyst|student|undergraduate|graduate|researcher|designer|intern|architect|manager|consultant|specialist)([^A-Za-z0-9_]|$)"
WHO, SAME_ROLE, OTHER_ROLE, VISIBLE = 6.0, 6.0, 2.0, 8.0
MOST, SIZES, PAGES, LOW_LINES, MANY = 10.0, 2.0, 3.0, 1.5, 8
SEVERITIES = ["critical", "high", "medium", "low", "info"]


def head_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def skim_text(headings: DataFrame, statements: DataFrame) -> DataFrame:
    """doc_id, text: headings and titles whole, statements by their first SKIMMED words, in order (ord), on lines.

    A document's parts are gathered: they are what its pages hold.
    """
    rows = headings.select("doc_id", "ord", text_of(F.col("text")).alias("t")).unionByName(statements.select("doc_id", "ord", head_words(F.col("text"), SKIMMED).alias("t")))
    lines = F.sort_array(F.collect_list(F.struct("ord", "t")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("text"))


def strengths(statements: DataFrame, skim: DataFrame, n: int = STRENGTHS) -> DataFrame:
    """doc_id, place, label, visible: the first n different figures with their entry, and whether the skimmed text has the figure.

    statements: doc_id, ord, text, entry (its title). The figure is looked for without what it measures, whatever its case.
    """
    needle = F.btrim(F.regexp_replace(F.regexp_extract("text", METRIC, 0), r"^[^A-Za-z0-9$₹€£#]+", ""), F.lit(" ,;:()."))
    rows = statements.withColumns({"_phrase": metric_phrase(F.col("text")), "_needle": needle}).filter("_phrase <> ''")
    labelled = rows.select("doc_id", "ord", F.concat("_phrase", F.lit(" — "), "entry").alias("label"), "_needle")
    once = labelled.groupBy("doc_id", "label").agg(F.min(F.struct("ord", "_needle")).alias("f"))
    order = Window.partitionBy("doc_id").orderBy("f.ord", "label")
    kept = once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    seen = F.contains(F.lower(text_of(F.col("text"))), F.lower("f._needle"))
    return kept.join(skim, "doc_id", "left").select("doc_id", F.col("place").cast("long").alias("place"), "label", seen.alias("visible"))


def first_impression(people: DataFrame, strong: DataFrame) -> DataFrame:
    """doc_id, says_who, n_strong, n_visible, score (up to 20) of people (doc_id, summary, skim_role, full_role).

    WHO if the summary's opening names what the person is; SAME_ROLE if the skimmed text tells the role that the whole
    does, OTHER_ROLE if it tells another; VISIBLE times the share of strengths that a look shows.
    """
    shown = strong.groupBy("doc_id").agg(F.count("*").alias("n_strong"), F.sum(F.col("visible").cast("long")).alias("n_visible"))
    rows = people.join(shown, "doc_id", "left").na.fill(0, ["n_strong", "n_visible"]).withColumn("says_who", head_words(F.col("summary"), OPENING).rlike(IDENTITY))
    role = F.when(F.col("full_role").isNull(), 0.0).when(F.col("skim_role") == F.col("full_role"), SAME_ROLE).otherwise(OTHER_ROLE)
    share = F.coalesce(F.try_divide(F.col("n_visible"), F.col("n_strong")), F.lit(0.0))
    return rows.select("doc_id", "says_who", "n_strong", "n_visible", F.round(F.when(F.col("says_who"), WHO).otherwise(0.0) + role + VISIBLE * share, 4).alias("score"))


def visual_order(people: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, n_sizes, n_low_lines, n_early, score of people (doc_id, level, pages) and their sections (doc_id, section, kind,
    size of the heading or null, lines)."""
    sums = sections.groupBy("doc_id").agg(F.countDistinct(F.round("size", 1)).alias("n_sizes"), F.sum(F.when(F.col("kind").isin(LOW_KINDS), F.col("lines")).otherwise(0)).alias("n_low_lines"))
    early = interrupting(sections.select("doc_id", "section", "kind")).groupBy("doc_id").agg(F.count("*").alias("n_early"))
    rows = people.join(sums, "doc_id", "left").join(early, "doc_id", "left").na.fill(0, ["n_sizes", "n_low_lines", "n_early"])
    long = F.when((F.col("level") == "entry") & (F.col("pages") > 1), PAGES).when(F.col("n_low_lines") > MANY, LOW_LINES).otherwise(0.0)
    score = MOST - F.when(F.col("n_sizes") > 1, SIZES).otherwise(0.0) - long - INTERRUPTS * F.col("n_early")
    return rows.select("doc_id", "n_sizes", "n_low_lines", "n_early", F.round(F.greatest(F.lit(0.0), score), 4).alias("score"))


def insights(findings: DataFrame) -> DataFrame:
    """doc_id, place, source, title, severity, points of findings (doc_id, source, ord, title, severity, points): one of each
    title, the most severe with most points, in that order.

    Titles are the same whatever their case and what is added as '(also missing ...)'.
    """
    same = F.regexp_replace(F.lower(text_of(F.col("title"))), r"\s*\(also missing.*\)$", "")
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.lit(0)), F.lit(len(SEVERITIES) + 1))
    rows = findings.withColumns({"_title": same, "_rank": rank, "points": F.round("points", 1)})
    best = rows.groupBy("doc_id", "_title").agg(F.min(F.struct("_rank", (-F.col("points")).alias("p"), "ord", "source", "title", "severity")).alias("f"))
    order = Window.partitionBy("doc_id").orderBy("f._rank", "f.p", "f.ord", "_title")
    return best.select("doc_id", F.row_number().over(order).cast("long").alias("place"), "f.source", "f.title", "f.severity", (-F.col("f.p")).alias("points"))


def corpus_report(graded: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, n, grades A to D, n_metrics, n_vague, n_words, best: a row for each document with its n best statements' places.

    graded: of statements.graded(), with st; best are the places by grade, figures first, then in order.
    """
    order = Window.partitionBy("doc_id").orderBy("grade", (~F.col("has_metric")).cast("int"), "st")
    placed = graded.withColumn("_r", F.row_number().over(order))
    counts = [F.sum((F.col("grade") == g).cast("long")).alias(f"grade_{g.lower()}") for g in "ABCD"]
    best = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_r") <= n, F.struct("_r", "st")))), lambda x: x["st"].cast("string")), " ")
    return placed.groupBy("doc_id").agg(F.count("*").alias("n"), *counts, F.sum(F.col("has_metric").cast("long")).alias("n_metrics"), F.sum("n_vague").alias("n_vague"), F.sum(F.size(words(F.col("text")))).cast("long").alias("n_words"), best.alias("best"))
