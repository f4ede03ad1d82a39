"""Queries on interviews about a brand's parts, and on orders as projects whose claims repositories show or don't."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators import claims, interview
from papyrine.plans import wording_queries
from papyrine.storage import materialize
from papyrine.tables import table

_KINDS = ["experience", "projects", "skills", "leadership", "publications"]


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand's graded statements; ten neighbouring parts are an entry."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("st") % 5 + 1).cast("int"))
    rows = wording_queries._graded(spark, sf_dir)
    return rows.select(F.col("owner").alias("doc_id"), kind.alias("kind"), F.floor(F.col("st") / 100).alias("entry"), F.col("st").alias("id"), F.col("st").alias("ord"), "text", "grade", "has_metric")


def interview_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of a brand's parts are requirements, names of its large parts values, those of small ones signals."""
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), "p_partkey", "p_type", "p_name", "p_size")
    first = lambda rows, column: rows.groupBy("doc_id", F.col(column).alias("text")).agg(F.min("p_partkey").alias("ord"))
    strongest = interview.claims(_statements(spark, sf_dir))
    return interview.plan(strongest, first(parts, "p_type"), first(parts.filter("p_size > 48 and p_partkey % 7 = 0"), "p_name"), first(parts.filter("p_size < 2 and p_partkey % 3 = 0"), "p_name"), parts.select("doc_id").distinct())


def interview_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for questions on claims, and for ones that only name a type of part."""
    rows = materialize(_statements(spark, sf_dir), "interview-statements")
    probed = interview.claims(rows).filter("n <= 3").select("doc_id", F.concat(F.lit("c"), F.col("n").cast("string")).alias("question"), F.col("id").cast("string").alias("probes"), F.lit("").alias("text"))
    typed = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("doc_id")).agg(F.min("p_type").alias("text")).select("doc_id", F.lit("t1").alias("question"), F.lit(None).cast("string").alias("probes"), F.concat("text", F.lit(" tasks with more quality")).alias("text"))
    return interview.evidence(probed.unionByName(typed), rows).filter("place <= 4")


def _projects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Orders as projects that claim the brands of their parts. Two of three have a repository, which lists every other brand
    in a manifest; every seventh links it, every eleventh links one that isn't public."""
    bought = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    k, brand = F.col("o_orderkey"), F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "")
    held = materialize(bought.groupBy("o_orderkey", "o_custkey", "o_orderdate").agg(F.array_sort(F.collect_set(brand)).alias("brands")), "projects")
    user, full = F.concat(F.lit("user"), F.col("o_custkey").cast("string")), F.concat(F.lit("user"), F.col("o_custkey").cast("string"), F.lit("/works-o"), k.cast("string"))
    link = F.when(k % 11 == 0, F.concat(F.lit(" github.com/"), user, F.lit("/none"))).when(k % 7 == 0, F.concat(F.lit(" see github.com/"), full, F.lit(".git"))).otherwise("")
    projects = held.select(F.col("o_custkey").alias("doc_id"), k.alias("entry_id"), user.alias("username"), F.concat(F.lit("Works O"), k.cast("string"), F.lit(" | parts")).alias("title"), F.concat(F.array_join("brands", ", "), link).alias("text"), (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("start"))
    made = F.add_months(F.to_date("o_orderdate"), (k % 9).cast("int"))
    repos = held.filter(k % 3 != 2).select(user.alias("username"), F.concat(F.lit("works-o"), k.cast("string")).alias("name"), full.alias("full_name"), user.alias("owner"), (k % 5 == 0).alias("fork"), F.date_format(made, "yyyy-MM-dd").alias("created_at"), F.lit(None).cast("string").alias("description"), F.array().cast("array<string>").alias("topics"))
    files = held.filter(k % 3 != 2).select(full.alias("full_name"), F.lit("go.mod").alias("path"), F.array_join(F.filter("brands", lambda b: F.right(b, F.lit(1)).isin("1", "3", "5")), " v1\n").alias("content"))
    names = table(spark, sf_dir, "part").select(brand.alias("phrase")).distinct().select("phrase", F.upper("phrase").alias("canonical"))
    languages = spark.createDataFrame([], "full_name string, language string")
    return projects, repos, claims.evidence(repos, languages, files, names), names


def repository_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = claims.checked(*_projects(spark, sf_dir))
    return checks.select("doc_id", "entry_id", "how", "full_name", F.array_join("found", " ").alias("found"), F.array_join("not_found", " ").alias("not_found"), "is_public", "is_fork", "is_foreign", "is_late")


def claim_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.verification(claims.checked(*_projects(spark, sf_dir)))


QUERIES = {"interview_plan": interview_plan, "interview_evidence": interview_evidence, "repository_claims": repository_claims, "claim_verification": claim_verification}

_STATEMENTS = wording_queries._ALL + f""", told AS (SELECT owner AS doc_id, {_KINDS}[st % 5 + 1] AS kind, st // 100 AS entry, st AS id, text, grade, has_metric FROM graded),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY grade, NOT has_metric, id) AS n FROM told WHERE kind <> 'skills')
"""
_CHECKS = """
WITH bought AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d, list_sort(list(DISTINCT regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g'))) AS brands FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL),
near AS (
  SELECT x.k, min(CASE WHEN y.k = x.k THEN 0 ELSE 1 END) AS m, arg_min('user' || x.c || '/works-o' || y.k, (CASE WHEN y.k = x.k THEN '0' ELSE '1' END) || 'works-o' || y.k) AS full_name
  FROM bought x JOIN bought y ON x.c = y.c AND y.k % 3 <> 2 AND (x.k::VARCHAR = y.k::VARCHAR OR starts_with(x.k::VARCHAR, y.k::VARCHAR) OR starts_with(y.k::VARCHAR, x.k::VARCHAR)) GROUP BY x.k),
matched AS (
  SELECT b.*, CASE WHEN b.k % 11 = 0 OR b.k % 7 = 0 THEN 'url' WHEN n.k IS NOT NULL THEN 'name' ELSE 'none' END AS how,
    CASE WHEN b.k % 11 = 0 THEN 'user' || c || '/none' WHEN b.k % 7 = 0 THEN 'user' || c || '/works-o' || b.k ELSE full_name END AS full_name FROM bought b LEFT JOIN near n ON n.k = b.k),
repos AS (SELECT 'user' || c || '/works-o' || k AS full_name, k AS rk, d AS rd, list_filter(brands, lambda b: right(b, 1) IN ('1', '3', '5')) AS shown FROM bought WHERE k % 3 <> 2),
checks AS (
  SELECT c AS doc_id, k AS entry_id, how, m.full_name, rk IS NOT NULL AS is_public, coalesce(rk % 5 = 0, false) AS is_fork, false AS is_foreign,
    coalesce(datediff('month', d, rd) + rk % 9 > 3, false) AS is_late,
    CASE WHEN rk IS NULL THEN [] ELSE list_filter(brands, lambda b: list_contains(shown, b)) END AS found, CASE WHEN rk IS NULL THEN [] ELSE list_filter(brands, lambda b: NOT list_contains(shown, b)) END AS not_found
  FROM matched m LEFT JOIN repos r USING (full_name))
"""
SQL = {
    "interview_plan": _STATEMENTS + """,
reqs AS (SELECT p_brand AS doc_id, p_type AS text, row_number() OVER (PARTITION BY p_brand ORDER BY min(p_partkey)) AS n FROM part GROUP BY p_brand, p_type),
wanted AS (
  SELECT p_brand AS doc_id, p_name AS text, 0 AS o, min(p_partkey) AS ord FROM part WHERE p_size > 48 AND p_partkey % 7 = 0 GROUP BY ALL
  UNION ALL SELECT p_brand, p_name, 1, min(p_partkey) FROM part WHERE p_size < 2 AND p_partkey % 3 = 0 GROUP BY ALL),
third AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o, ord) AS n FROM wanted)
SELECT doc_id, 1 AS round, n, id::VARCHAR AS probes, 'claim' AS why FROM ranked WHERE n <= 3
UNION ALL SELECT doc_id, 2, n, text, 'requirement' FROM reqs WHERE n <= 2
UNION ALL SELECT doc_id, 3, n, text, CASE o WHEN 0 THEN 'value' ELSE 'signal' END FROM third WHERE n <= 2
UNION ALL SELECT DISTINCT p_brand, 3, 1, 'general', 'general' FROM part WHERE p_brand NOT IN (SELECT doc_id FROM third)""",
    "interview_evidence": _STATEMENTS + r""",
probed AS (SELECT r.doc_id, 'c' || r.n AS question, t.text, t.id, row_number() OVER (PARTITION BY r.doc_id, r.n ORDER BY t.id) AS place FROM ranked r JOIN told t ON t.doc_id = r.doc_id AND t.entry = r.entry WHERE r.n <= 3),
asked AS (SELECT p_brand AS doc_id, list_distinct(regexp_extract_all(lower(min(p_type) || ' tasks with more quality'), '[a-z]{4,}')) AS w FROM part GROUP BY p_brand),
shared AS (SELECT t.doc_id, t.id, t.text, len(list_intersect(w, regexp_extract_all(lower(t.text), '[a-z]{4,}'))) AS n FROM told t JOIN asked a ON a.doc_id = t.doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, text DESC, id) AS place FROM shared WHERE n > 0)
SELECT doc_id, question, place, text FROM probed WHERE place <= 4 UNION ALL SELECT doc_id, 't1', place, text FROM best WHERE place <= 4""",
    "repository_claims": _CHECKS + "SELECT doc_id, entry_id, how, full_name, upper(array_to_string(found, ' ')) AS found, upper(array_to_string(not_found, ' ')) AS not_found, is_public, is_fork, is_foreign, is_late FROM checks",
    "claim_verification": _CHECKS + """SELECT doc_id, count(*) AS n_projects, count(*) FILTER (is_public) AS n_matched, sum(len(found) + len(not_found))::BIGINT AS n_claims,
  round(100.0::DOUBLE * sum(len(found)) / nullif(sum(len(found) + len(not_found)), 0), 1) AS cvi FROM checks GROUP BY doc_id""",
}
