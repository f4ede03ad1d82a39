"""Queries that rank, merge and place findings, and that look for the evidence of wanted skills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.functions.text import TOKENS, text_of
from papyrine.operators import evaluation, matching, reports
from papyrine.plans import report_queries, retrieval_queries, table_queries
from papyrine.tables import table

#: How much a signal in a text matters.
_SEVERITY = {"masked_metric": "critical", "todo": "high", "email": "medium", "license": "medium", "ipv4": "low", "url": "low", "percent": "info"}


def signal_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two findings of each document that matter most, by severity, then hits."""
    found = report_queries.signal_findings(spark, sf_dir)
    severity = F.coalesce(*(F.when(F.col("signal") == k, F.lit(v)) for k, v in _SEVERITY.items()))
    rows = found.select(F.col("doc_id").alias("owner"), severity.alias("severity"), F.col("n").cast("double").alias("points"), F.col("signal").alias("title"), F.col("signal").alias("ord"))
    return matching.first_findings(rows, 2).select("owner", "rank", "severity", "title", F.col("points").cast("long").alias("n"))


def hidden_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring lines that are hidden for the same reason, as one finding."""
    rows = reports.hidden_spans(report_queries._spans(spark, sf_dir)).filter("reason is not null")
    by_line = Window.partitionBy("doc_id").orderBy("line")
    goes_on = (F.lag("line").over(by_line) == F.col("line") - 1) & (F.lag("reason").over(by_line) == F.col("reason"))
    runs = rows.withColumn("fresh", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(F.first("reason").alias("reason"), F.min("line").alias("line"), F.count("*").alias("n_lines"))


#: Kinds of sections that stand for a customer's orders, in turn by key.
_KINDS = ["experience", "interests", "projects", "languages", "education", "skills", "references", "declaration", "publications", "personal", "summary"]


def early_low_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a customer's orders as sections, those of kinds that can wait but stand before the last key section."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("o_orderkey") % len(_KINDS) + 1).cast("int"))
    return reports.interrupting(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("section"), kind.alias("kind")))


def skill_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three lines of a document that hold a skill that a passage wants; pairs are those of BM25's three best.

    Skills under five letters must be words of their own.
    """
    pairs, _, want, _ = table_queries._skills(spark, sf_dir)
    wanted = pairs.join(want.withColumnRenamed("owner", "right"), "right").select("left", "skill").distinct()
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("left"), F.posexplode(F.split(F.lower(text_of(F.col("text"))), "\n")).alias("line", "text"))
    whole = F.array_contains(F.regexp_extract_all("text", F.lit(TOKENS["search"]), F.lit(0)), F.col("skill"))
    found = wanted.join(lines, "left").filter(F.contains("text", "skill") & ((F.length("skill") >= 5) | whole)).select("left", "skill", F.col("line").cast("long").alias("line"))
    return evaluation.at_most(found, ["left", "skill"], ["line"], 3)


def claim_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the percentage of wanted skills that it has, of those it has or lacks altogether; null for none."""
    scores = table_queries.skill_match_cascade(spark, sf_dir).groupBy("left").agg(F.sum("n_direct").alias("found"), F.sum("n_missing").alias("lost"))
    return scores.select("left", "found", "lost", F.round(F.try_divide(100.0 * F.col("found"), F.col("found") + F.col("lost")), 1).alias("cvi"))


def verdict_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of each passage with what is missing first, then partial, transferable and met, and by score."""
    rows = matching.requirement_verdicts(table_queries.skill_match_cascade(spark, sf_dir))
    place = F.array_position(F.array(*map(F.lit, ("missing", "partial", "transferable", "met"))), F.col("verdict"))
    return rows.select("right", "left", "verdict", F.row_number().over(Window.partitionBy("right").orderBy(place, "score", "left")).cast("long").alias("place"))


QUERIES = {
    "signal_ranks": signal_ranks,
    "hidden_runs": hidden_runs,
    "early_low_sections": early_low_sections,
    "skill_evidence": skill_evidence,
    "claim_index": claim_index,
    "verdict_order": verdict_order,
}

_RANKS = " ".join(f"WHEN '{k}' THEN {('critical', 'high', 'medium', 'low', 'info').index(v)}" for k, v in _SEVERITY.items())
_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SEVERITY.items())
_SPANS = report_queries.SQL["hidden_spans"]
SQL = {
    "signal_ranks": f"""
WITH f AS ({report_queries._CASES}), r AS (
  SELECT doc_id AS owner, row_number() OVER (PARTITION BY doc_id ORDER BY CASE signal {_RANKS} END, n DESC, signal) AS rank, CASE signal {_NAMES} END AS severity, signal AS title, n FROM f WHERE first <> '')
SELECT * FROM r WHERE rank <= 2""",
    "hidden_runs": _SPANS[: _SPANS.index("SELECT CASE")].replace("SELECT doc_id, unnest(range(0", "SELECT doc_id, unnest(range(0").replace("SELECT doc_id * 31 + line * 7 AS k FROM raw", "SELECT doc_id, line, doc_id * 31 + line * 7 AS k FROM raw").replace("AS b FROM k)", "AS b, doc_id, line FROM k)")
    + """, h AS (
  SELECT doc_id, line, CASE WHEN m = 3 THEN 'invisible' WHEN o < 0.1 THEN 'transparent' WHEN size < 4 THEN 'tiny' WHEN contrast < 1.25 THEN 'low_contrast' WHEN contrast < 1.6 THEN 'faint' END AS reason FROM c),
n AS (SELECT *, CASE WHEN lag(line) OVER w = line - 1 AND lag(reason) OVER w = reason THEN 0 ELSE 1 END AS fresh FROM h WHERE reason IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT doc_id, run, any_value(reason) AS reason, min(line) AS line, count(*) AS n_lines FROM r GROUP BY doc_id, run""",
    "early_low_sections": f"""WITH s AS (SELECT o_custkey AS doc_id, o_orderkey AS section, ({_KINDS})[o_orderkey % {len(_KINDS)} + 1] AS kind FROM orders),
m AS (SELECT *, max(section) FILTER (kind IN ('experience', 'projects', 'education', 'skills', 'publications')) OVER (PARTITION BY doc_id) AS last FROM s)
SELECT doc_id, section, kind, 1.5::DOUBLE AS points FROM m WHERE kind IN ('interests', 'languages', 'extracurricular', 'declaration', 'personal', 'references') AND section < last""",
    "skill_evidence": table_queries._PAIRS + """, w AS (SELECT DISTINCT l, skill FROM pairs JOIN want USING (r)),
lines AS (SELECT doc_id AS l, unnest(string_split(lower(coalesce(text, '')), chr(10))) AS text, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents)
SELECT * FROM (SELECT w.l AS "left", skill, line, row_number() OVER (PARTITION BY w.l, skill ORDER BY line) AS rank FROM w JOIN lines ON lines.l = w.l AND contains(text, skill) AND (length(skill) >= 5 OR list_contains(regexp_extract_all(text, '[a-z0-9_+#.-]+'), skill))) WHERE rank <= 3""",
    "claim_index": table_queries._CASCADE + """SELECT "left", sum(n_direct)::BIGINT AS found, sum(n_missing)::BIGINT AS lost, round(100.0::DOUBLE * sum(n_direct) / nullif(sum(n_direct) + sum(n_missing), 0), 1) AS cvi FROM matched GROUP BY 1""",
    "verdict_order": table_queries._CASCADE + """, judged AS (
  SELECT *, CASE WHEN n_direct = n_direct + n_related + n_partial + n_missing THEN 'met' WHEN n_direct > 0 THEN 'partial' WHEN n_related > 0 THEN 'transferable' WHEN n_partial > 0 THEN 'partial' ELSE 'missing' END AS verdict FROM matched)
SELECT "right", "left", verdict, row_number() OVER (PARTITION BY "right" ORDER BY list_position(['missing', 'partial', 'transferable', 'met'], verdict), score, "left") AS place FROM judged""",
}
