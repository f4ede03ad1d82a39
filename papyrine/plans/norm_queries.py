"""Queries on norms of roles, on skills that are shown, and on rules asked for in SQL alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions import sql
from papyrine.operators import entries, norms
from papyrine.plans import wording_queries
from papyrine.tables import table

_KINDS = ["experience", "projects", "skills", "education", "summary"]
_LEVELS = ["entry", "mid", "senior"]


def _norm_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms as JSON: a market segment is a family, its nations are roles, and customers by key tell what a level expects.

    Nations by key lack levels, and every fifth nation has no norm.
    """
    asked = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("family"), F.col("c_nationkey").alias("role"), F.element_at(F.array(*map(F.lit, _LEVELS)), (F.col("c_custkey") % 3 + 1).cast("int")).alias("level"), "c_custkey")
    asked = asked.filter("role % 5 <> 0 and (role % 4 <> 1 or level = 'senior')")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("c_custkey") % 5 + 1).cast("int"))
    levels = asked.groupBy("family", "role", "level").agg(
        F.array_sort(F.collect_set(kind)).alias("expected_sections"), F.array_sort(F.collect_set(F.concat(F.lit("tool"), (F.col("c_custkey") % 7).cast("string")))).alias("typical_tools"),
        F.array_sort(F.collect_set(F.concat(F.element_at(F.array(*map(F.lit, ["alpha", "beta", "gamma"])), (F.col("c_custkey") % 3 + 1).cast("int")), F.lit(" by metric of time")))).alias("expected_metrics"),
        F.when(F.min(F.col("c_custkey")) % 2 == 0, F.array(F.lit("No baseline named"))).otherwise(F.array().cast("array<string>")).alias("anti_patterns"),
    )
    entry = F.struct(F.array_position(F.array(*map(F.lit, _LEVELS)), F.col("level")).alias("o"), F.col("level").alias("key"), F.struct("expected_sections", "typical_tools", "expected_metrics", "anti_patterns").alias("value"))
    held = levels.groupBy("family", "role").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["key"], e["value"]))).alias("seniority_levels"))
    role = F.struct(F.concat("family", F.lit("-"), F.col("role").cast("string")).alias("id"), F.concat(F.lit("Role "), F.col("role").cast("string")).alias("canonical_title"), F.array().cast("array<string>").alias("aliases"), "seniority_levels")
    files = held.groupBy(F.col("family").alias("role_family")).agg(F.collect_list(role).alias("roles"))
    return files.select(F.to_json(F.struct("role_family", "roles")).alias("j")).select(F.from_json("j", norms.SCHEMA).alias("x")).select("x.*")


def norm_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against the norm of their segment's nation: sections by key, and a text of tools, stages and a comparison."""
    k = F.col("c_custkey")
    kinds = F.filter(F.array(*(F.when(k % (i + 2) != 0, F.lit(name)) for i, name in enumerate(_KINDS))), lambda x: x.isNotNull())
    text = F.concat(F.lit("Tool"), (k % 7).cast("string"), F.lit(" and tool"), (k % 5).cast("string"), F.lit(" in stage "), F.when(k % 2 == 0, "Beta").otherwise("none"), F.when(k % 3 == 0, " compared with others").otherwise(""))
    level = F.element_at(F.array(*map(F.lit, [*_LEVELS, "staff"])), (k % 4 + 1).cast("int"))
    people = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string")).alias("role"), F.col("c_mktsegment").alias("family"), level.alias("level"), kinds.alias("kinds"), text.alias("text"))
    return norms.alignment(norms.chosen(people, norms.norm_table(_norm_files(spark, sf_dir))))


def shown_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers: parts' brands are listed skills, brands of returned lines shown, flags that lead away groups, segments topics."""
    bought = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("o_custkey", "doc_id")
    listed = bought.select("doc_id", F.col("p_brand").alias("skill")).distinct()
    shown = bought.filter("l_returnflag = 'R'").select("doc_id", F.upper("p_brand").alias("skill"))
    groups = bought.filter("l_quantity >= 49").select("doc_id", F.col("l_returnflag").alias("category"))
    topics = bought.filter("l_linenumber = 1").select("doc_id", F.col("p_brand").alias("topic"))
    return norms.narrative(listed, shown, groups, topics)


def marks_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    wording_queries._bullets(spark, sf_dir).createOrReplaceTempView("papyrine_bullets")
    return spark.sql("SELECT st, has_metric(text) AS metric, has_outcome(text) AS outcome, n_vague(text) AS n_vague, weak_opener(text) AS weak, is_passive(text) AS passive, verb_tier(text) AS tier, found_dates(concat(text, ' Mar ', 2000 + st % 20)) AS dates FROM papyrine_bullets")


def gaps_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of three months or more in which a customer has no order; an order lasts for one to three months."""
    sql.register(spark)
    table(spark, sf_dir, "orders").createOrReplaceTempView("papyrine_orders")
    spark.sql("SELECT o_custkey AS owner, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS start, year(o_orderdate) * 12 + month(o_orderdate) - 1 + o_orderkey % 3 AS `end` FROM papyrine_orders").createOrReplaceTempView("papyrine_posts")
    return spark.sql("SELECT * FROM timeline_gaps(TABLE(papyrine_posts) PARTITION BY owner ORDER BY (start, `end`), 3)")


QUERIES = {"norm_alignment": norm_alignment, "shown_skills": shown_skills, "marks_in_sql": marks_in_sql, "gaps_in_sql": gaps_in_sql}

q = wording_queries.q
_S, _W = wording_queries.statements, wording_queries.wording
_LIST = "[" + ", ".join(map(q, _KINDS)) + "]"
SQL = {
    "norm_alignment": f"""
WITH asked AS (SELECT c_mktsegment AS family, c_nationkey AS role, {_LEVELS}[c_custkey % 3 + 1] AS level, c_custkey % 3 AS place, c_custkey FROM customer WHERE c_nationkey % 5 <> 0 AND (c_nationkey % 4 <> 1 OR c_custkey % 3 = 2)),
norms AS (
  SELECT family, role, level, min(place) AS place, list(DISTINCT {_LIST}[c_custkey % 5 + 1]) AS sections, list(DISTINCT 'tool' || c_custkey % 7) AS tools, list(DISTINCT ['alpha', 'beta', 'gamma'][c_custkey % 3 + 1]) AS stages, min(c_custkey) % 2 = 0 AS lone FROM asked GROUP BY ALL),
people AS (
  SELECT c_custkey AS k, c_mktsegment AS family, c_nationkey AS role, {[*_LEVELS, "staff"]}[c_custkey % 4 + 1] AS level, list_filter(list_transform(range(1, 6), lambda i: CASE WHEN c_custkey % (i + 1) <> 0 THEN {_LIST}[i] END), lambda x: x IS NOT NULL) AS kinds,
    'tool' || c_custkey % 7 || ' and tool' || c_custkey % 5 || ' in stage ' || CASE WHEN c_custkey % 2 = 0 THEN 'beta' ELSE 'none' END || CASE WHEN c_custkey % 3 = 0 THEN ' compared with others' ELSE '' END AS t FROM customer),
tried AS (
  SELECT p.*, n.* EXCLUDE (family, role, level), CASE WHEN n.role = p.role AND n.level = p.level THEN 0 WHEN n.role = p.role THEN 1 WHEN n.level = p.level THEN 2 END AS fit, n.role AS norm_role,
    CASE WHEN n.role = p.role THEN n.place - (SELECT min(m.place) FROM norms m WHERE m.family = n.family AND m.role = n.role) ELSE (SELECT count(*) FROM norms m WHERE m.family = n.family AND m.role = n.role AND m.place < n.place) END AS at_place
  FROM people p LEFT JOIN norms n ON n.family = p.family AND (n.role = p.role OR n.level = p.level)),
best AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY fit NULLS LAST, at_place, family || '-' || norm_role) AS r FROM tried),
counted AS (
  SELECT k AS doc_id, coalesce(fit, 3) AS fit, len(list_filter(sections, lambda s: NOT list_contains(kinds, s))) AS ms, len(list_filter(tools, lambda s: NOT contains(t, s))) AS mt, len(tools) AS nt,
    0 AS mm, CASE WHEN lone AND NOT contains(t, 'compared') THEN 1 ELSE 0 END AS u, stages, t FROM best WHERE r = 1),
found AS (SELECT *, CASE WHEN fit = 3 THEN 0 ELSE len(list_filter(stages, lambda s: NOT contains(t, 'metric') AND NOT contains(t, s))) END AS lost FROM counted)
SELECT doc_id, fit::INTEGER AS fit, coalesce(ms, 0) AS missing_sections, coalesce(mt, 0) AS missing_tools, lost AS missing_metrics, CASE WHEN fit = 3 THEN 0 ELSE u END::BIGINT AS unlike,
  round(CASE WHEN fit = 3 THEN 5 ELSE greatest(0, least(10, 10 - 1.5 * ms - 3 * mt / nt::DOUBLE - (lost > 0)::INT - u)) END::DOUBLE, 4) AS score FROM found""",
    "shown_skills": """
WITH b AS (SELECT o_custkey AS doc_id, p_brand, l_returnflag, l_quantity, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
shown AS (SELECT DISTINCT doc_id, p_brand FROM b WHERE l_returnflag = 'R'),
l AS (SELECT doc_id, count(*) AS listed, count(*) FILTER (NOT has) AS unshown FROM (SELECT DISTINCT b.doc_id, b.p_brand, s.p_brand IS NOT NULL AS has FROM b LEFT JOIN shown s ON s.doc_id = b.doc_id AND s.p_brand = b.p_brand) GROUP BY doc_id),
g AS (SELECT doc_id, count(DISTINCT l_returnflag) AS off_groups FROM b WHERE l_quantity >= 49 GROUP BY doc_id),
t AS (SELECT b.doc_id, count(DISTINCT b.p_brand) AS unsupported FROM b LEFT JOIN shown s ON s.doc_id = b.doc_id AND s.p_brand = b.p_brand WHERE l_linenumber = 1 AND s.p_brand IS NULL GROUP BY b.doc_id),
j AS (SELECT doc_id, listed, unshown, coalesce(off_groups, 0) AS off_groups, coalesce(unsupported, 0) AS unsupported FROM l LEFT JOIN g USING (doc_id) LEFT JOIN t USING (doc_id))
SELECT *, round(greatest(0, 10 - 5 * unshown / listed::DOUBLE - least(2, 0.75::DOUBLE * off_groups) - (unsupported > 0)::INT), 4) AS score FROM j""",
    "marks_in_sql": wording_queries._B + f"""SELECT st, regexp_matches(text, {q(_S.METRIC)}) AS metric, regexp_matches(text, {q(_S.METRIC)}) OR regexp_matches(text, {q(_S.OUTCOME)}) AS outcome, len(regexp_extract_all(text, {q(_S.VAGUE)})) AS n_vague,
  regexp_matches(text, {q(_S.WEAK_OPENERS)}) AS weak, regexp_matches(text, {q(_W.PASSIVE)}) AS passive, CASE WHEN regexp_matches(text, {q(_W.HIDING)}) THEN 3 WHEN lower(regexp_extract(text, '[A-Za-z][A-Za-z0-9_-]*')) IN ({', '.join(map(q, _W.STRONG))}) THEN 1 ELSE 2 END::INTEGER AS tier,
  CASE WHEN regexp_extract(d, {q(entries.RANGE)}, 1) <> '' THEN regexp_extract(d, {q(entries.RANGE)}, 1) || ' – ' || regexp_extract(d, {q(entries.RANGE)}, 2) ELSE regexp_extract(d, {q(entries.SINGLE)}, 1) END AS dates
FROM (SELECT *, text || ' Mar ' || (2000 + st % 20) AS d FROM b)""",
    "gaps_in_sql": """
WITH p AS (SELECT o_custkey AS owner, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS s, year(o_orderdate) * 12 + month(o_orderdate) - 1 + o_orderkey % 3 AS e FROM orders),
r AS (SELECT owner, s, max(e) OVER (PARTITION BY owner ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p)
SELECT owner, before + 1 AS gap_from, s - 1 AS gap_to, s - before - 1 AS length FROM r WHERE s - before - 1 >= 3""",
}
