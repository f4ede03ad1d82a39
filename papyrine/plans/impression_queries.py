"""Queries on first looks: brands' statements and titles, customers' sections, and findings of several kinds together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators import impressions, roles
from papyrine.plans import finding_queries, grading_queries, role_queries, timeline_queries, wording_queries
from papyrine.storage import materialize
from papyrine.tables import table


def _brands(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A brand's statements with the part's name as their entry, and the skimmed text of both."""
    parts = table(spark, sf_dir, "part")
    rows = wording_queries._bullets(spark, sf_dir).join(parts.select(F.col("p_partkey").alias("st"), F.col("p_name").alias("entry")), "st")
    told = materialize(rows.select(F.col("owner").alias("doc_id"), (F.col("st") * 2 + 1).alias("ord"), "text", "entry"), "told")
    titles = parts.select(F.col("p_brand").alias("doc_id"), (F.col("p_partkey") * 2).alias("ord"), F.col("p_name").alias("text"))
    return told, materialize(impressions.skim_text(titles, told), "skim")


def skimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, skim = _brands(spark, sf_dir)
    return skim.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impressions.strengths(*_brands(spark, sf_dir))


def first_impression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of parts are families of roles; the summary is that of the brand's first part."""
    told, skim = _brands(spark, sf_dir)
    parts = table(spark, sf_dir, "part")
    families = parts.groupBy(F.col("p_type").alias("family")).agg(F.min("p_partkey").alias("place")).withColumn("keyword", F.col("family"))
    people = parts.groupBy(F.col("p_brand").alias("doc_id")).agg(F.min("p_partkey").alias("k")).withColumn("summary", F.concat(F.lit("Keen "), F.element_at(F.array(*map(F.lit, ["analyst", "cook", "engineer"])), (F.col("k") % 3 + 1).cast("int")), F.lit(" of all wares")))

    def named(rows: DataFrame, field: str) -> DataFrame:
        return roles.inferred_roles(people, rows.select("doc_id", F.lit("statements").alias("field"), "text"), families).select("doc_id", F.col("family").alias(field))

    whole = people.select("doc_id", "summary").join(named(skim, "skim_role"), "doc_id").join(named(told, "full_role"), "doc_id")
    return impressions.first_impression(whole, impressions.strengths(told, skim))


def visual_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as sections with headings of two sizes, and pages by their number."""
    orders = table(spark, sf_dir, "orders").withColumn("doc_id", F.col("o_custkey"))
    kind = F.element_at(F.array(*map(F.lit, finding_queries._KINDS)), (F.col("o_orderkey") % len(finding_queries._KINDS) + 1).cast("int"))
    sections = orders.select("doc_id", F.col("o_orderkey").alias("section"), kind.alias("kind"), F.when(F.col("o_orderkey") % 16 == 3, 13.0).when(F.col("o_orderkey") % 5 != 0, 12.0).alias("size"), (F.col("o_orderkey") % 6).alias("lines"))
    level = roles.levels(timeline_queries._dated(spark, sf_dir), timeline_queries.NOW).select(F.col("owner").alias("doc_id"), "level")
    people = orders.groupBy("doc_id").agg(F.ceil(F.count("*") / 10).alias("pages")).join(level, "doc_id")
    return impressions.visual_order(people, sections)


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' timelines, sections that stand too early and orders without priority as findings."""
    timeline = timeline_queries.QUERIES["timeline_checks"](spark, sf_dir).select(F.col("owner").alias("doc_id"), F.lit("timeline").alias("source"), F.coalesce("id", F.lit(0)).alias("ord"), F.concat(F.col("finding"), F.when(F.col("id") % 2 == 0, " (also missing: dates)").otherwise("")).alias("title"), F.when(F.col("severity") == "error", "critical").when(F.col("severity") == "warning", "medium").otherwise("low").alias("severity"), F.least(F.coalesce("months", F.lit(1)), F.lit(9)).cast("double").alias("points"))
    early = finding_queries.early_low_sections(spark, sf_dir).select("doc_id", F.lit("order").alias("source"), F.col("section").alias("ord"), F.concat(F.initcap("kind"), F.lit(" interrupts")).alias("title"), F.lit("low").alias("severity"), "points")
    return impressions.insights(timeline.unionByName(early))


QUERIES = {
    "skimmed": skimmed, "strengths": strengths, "first_impression": first_impression, "visual_order": visual_order, "insights": insights,
    "corpus_report": lambda s, d: impressions.corpus_report(materialize(grading_queries._graded(s, d), "graded")),
}

q = wording_queries.q
_S = wording_queries.statements
_SKIM = wording_queries._B + r""", told AS (SELECT owner AS doc_id, st * 2 + 1 AS ord, text, p_name AS entry FROM b JOIN part ON p_partkey = st),
pieces AS (SELECT p_brand AS doc_id, p_partkey * 2 AS ord, p_name AS t FROM part UNION ALL SELECT doc_id, ord, array_to_string(regexp_extract_all(text, '[^\x20\x09-\x0D]+')[1:8], ' ') FROM told),
skim AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY ord) AS s FROM pieces GROUP BY doc_id)
"""
_STRONG = _SKIM + f""", found AS (
  SELECT doc_id, ord, entry, regexp_replace(trim(regexp_replace(regexp_extract(text, {q(_S.METRIC + _S.MEASURED)}), '^[^A-Za-z0-9$₹€£#]+', ''), ' ,;:().'), '\\s+×', '×', 'g') AS phrase, trim(regexp_replace(regexp_extract(text, {q(_S.METRIC)}), '^[^A-Za-z0-9$₹€£#]+', ''), ' ,;:().') AS needle FROM told),
once AS (SELECT doc_id, phrase || ' — ' || entry AS label, min(ord) AS ord, arg_min(needle, ord) AS needle FROM found WHERE phrase <> '' GROUP BY 1, 2),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, label) AS place FROM once) WHERE place <= 6),
strong AS (SELECT doc_id, place, label, contains(lower(s), lower(needle)) AS visible FROM kept JOIN skim USING (doc_id))
"""
_TIMELINE = timeline_queries.SQL["timeline_checks"]
SQL = {
    "skimmed": _SKIM + "SELECT doc_id, length(s) AS n_chars, md5(s) AS text_md5 FROM skim",
    "strengths": _STRONG + "SELECT * FROM strong",
    "first_impression": _STRONG + r""",
families AS (SELECT p_type AS family, lower(p_type) AS w, min(p_partkey) AS place FROM part GROUP BY p_type),
texts AS (SELECT doc_id, 'skim' AS k, s AS t FROM skim UNION ALL SELECT doc_id, 'full', text FROM told),
scores AS (SELECT doc_id, k, family, place, count(*) AS n FROM (SELECT doc_id, k, unnest(regexp_extract_all(lower(t), '[a-z0-9_+#]+')) AS w FROM texts) JOIN families USING (w) GROUP BY ALL),
roles AS (SELECT doc_id, arg_max(family, n * 100000 - place) FILTER (k = 'skim') AS skim_role, arg_max(family, n * 100000 - place) FILTER (k = 'full') AS full_role FROM scores GROUP BY doc_id),
people AS (SELECT p_brand AS doc_id, ['analyst', 'cook', 'engineer'][min(p_partkey) % 3 + 1] <> 'cook' AS says_who FROM part GROUP BY p_brand),
shown AS (SELECT doc_id, count(*) AS n_strong, count(*) FILTER (visible) AS n_visible FROM strong GROUP BY doc_id)
SELECT doc_id, says_who, coalesce(n_strong, 0) AS n_strong, coalesce(n_visible, 0) AS n_visible,
  round(CASE WHEN says_who THEN 6 ELSE 0 END + CASE WHEN full_role IS NULL THEN 0 WHEN skim_role = full_role THEN 6 ELSE 2 END + coalesce(8 * n_visible / n_strong::DOUBLE, 0), 4) AS score
FROM people LEFT JOIN roles USING (doc_id) LEFT JOIN shown USING (doc_id)""",
    "visual_order": f"""
WITH lv AS ({role_queries.SQL['owner_levels']}),
s AS (SELECT o_custkey AS doc_id, o_orderkey AS section, ({finding_queries._KINDS})[o_orderkey % {len(finding_queries._KINDS)} + 1] AS kind, CASE WHEN o_orderkey % 16 = 3 THEN 13 WHEN o_orderkey % 5 <> 0 THEN 12 END AS size, o_orderkey % 6 AS lines FROM orders),
m AS (SELECT *, kind IN ('interests', 'languages', 'extracurricular', 'declaration', 'personal', 'references') AS low, max(section) FILTER (kind IN ('experience', 'projects', 'education', 'skills', 'publications')) OVER (PARTITION BY doc_id) AS last FROM s),
g AS (SELECT doc_id, count(DISTINCT size) AS n_sizes, coalesce(sum(lines) FILTER (low), 0)::BIGINT AS n_low_lines, count(*) FILTER (low AND section < last) AS n_early, ceil(count(*) / 10) AS pages FROM m GROUP BY doc_id)
SELECT doc_id, n_sizes, n_low_lines, n_early, round(greatest(0, 10 - CASE WHEN n_sizes > 1 THEN 2 ELSE 0 END - CASE WHEN level = 'entry' AND pages > 1 THEN 3 WHEN n_low_lines > 8 THEN 1.5 ELSE 0 END - 1.5 * n_early)::DOUBLE, 4) AS score FROM g JOIN lv ON owner = doc_id""",
    "insights": f"""
WITH t AS ({_TIMELINE}), e AS ({finding_queries.SQL['early_low_sections']}),
f AS (
  SELECT owner AS doc_id, 'timeline' AS source, coalesce(id, 0) AS ord, finding || CASE WHEN id % 2 = 0 THEN ' (also missing: dates)' ELSE '' END AS title, CASE severity WHEN 'error' THEN 'critical' WHEN 'warning' THEN 'medium' ELSE 'low' END AS severity, least(coalesce(months, 1), 9)::DOUBLE AS points, finding AS same FROM t
  UNION ALL SELECT doc_id, 'order', section, upper(kind[1]) || kind[2:] || ' interrupts', 'low', points, kind || ' interrupts' FROM e),
r AS (SELECT *, CASE severity WHEN 'critical' THEN 1 WHEN 'medium' THEN 3 ELSE 4 END AS k FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, same ORDER BY k, points DESC, ord) AS n FROM r)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, points DESC, ord, same) AS place, source, title, severity, points FROM o WHERE n = 1""",
    "corpus_report": grading_queries._GRADED + r""", placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY grade, NOT has_metric, st) AS r FROM graded)
SELECT doc_id, count(*) AS n, count(*) FILTER (grade = 'A') AS grade_a, count(*) FILTER (grade = 'B') AS grade_b, count(*) FILTER (grade = 'C') AS grade_c, count(*) FILTER (grade = 'D') AS grade_d, count(*) FILTER (has_metric) AS n_metrics,
  sum(n_vague)::BIGINT AS n_vague, sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))::BIGINT AS n_words, string_agg(st::VARCHAR, ' ' ORDER BY r) FILTER (r <= 3) AS best FROM placed GROUP BY doc_id""",
}
