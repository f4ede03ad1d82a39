"""Queries on postings: texts made of parts' names and types beside all documents, with titles, sections and cultures by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators import layout, postings, reports
from papyrine.plans import grading_queries, report_queries
from papyrine.tables import table

#: doc_id and text of every document and of a posting for each part (with negative ids), the same in both dialects.
TEXTS = """
SELECT doc_id, text FROM documents
UNION ALL
SELECT -1 - p_partkey AS doc_id, concat(
  CASE p_partkey % 8 WHEN 0 THEN 'Senior Engineer' WHEN 1 THEN 'Junior Clerk' WHEN 2 THEN 'Intern' WHEN 3 THEN 'Staff Writer' WHEN 4 THEN 'Team Lead' WHEN 5 THEN 'Director' WHEN 6 THEN 'Mid-level Cook' ELSE 'Worker' END, ' for ', p_type, chr(10),
  'We are ', CASE p_partkey % 5 WHEN 0 THEN 'a remote, fast-paced startup in fintech' WHEN 1 THEN 'a collaborative team with mentorship in healthcare' WHEN 2 THEN 'an established enterprise of metrics and kpis' WHEN 3 THEN 'for diversity and inclusion' ELSE 'a shop' END, chr(10),
  'Requirements', chr(10), '- ', p_size % 9, '+ years of experience with ', p_name, chr(10), '- Bachelor degree in ', p_type, chr(10), CASE WHEN p_partkey % 3 = 0 THEN concat('1. Certified in ', p_brand, chr(10)) ELSE '' END,
  'Nice to have', chr(10), '- Knowledge of ', p_brand, ' wares', chr(10), 'Responsibilities', chr(10), '- You will ship ', p_name, chr(10), '- Keep the ', p_type, ' in order') AS text FROM part"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = TEXTS.replace("FROM documents", "FROM {documents}").replace("FROM part", "FROM {part}")
    return spark.sql(said, documents=table(spark, sf_dir, "documents"), part=table(spark, sf_dir, "part"))


def posting_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = postings.posting_lines(texts(spark, sf_dir))
    return rows.groupBy("section", "kind").agg(F.count("*").alias("n_lines"), F.countDistinct("doc_id").alias("n_docs"))


def seniority_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select(F.coalesce(postings.seniority(F.col("text")), F.lit("none")).alias("level")).groupBy("level").agg(F.count("*").alias("n_docs"))


def culture_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select(F.explode(reports.tags(F.col("text"), reports.CULTURE)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n_docs"))


def industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select(F.coalesce(reports.first_tag(F.col("text"), reports.INDUSTRY), F.lit("none")).alias("industry")).groupBy("industry").agg(F.count("*").alias("n_docs"))


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of postings with their section and kind."""
    return postings.posting_lines(texts(spark, sf_dir)).filter("doc_id < 0")


def customers_without_urgent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    left = table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return left.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


QUERIES = {
    "posting_kinds": posting_kinds,
    "seniority_levels": seniority_levels,
    "culture_tags": culture_tags,
    "industries": industries,
    "requirements": requirements,
    "heading_styles": lambda s, d: layout.heading_styles(grading_queries.lines(texts(s, d))),
    "anti_join": customers_without_urgent_orders,
}


def _over_texts(sql: str) -> str:
    return sql.replace("FROM documents", f"FROM ({TEXTS})")


_KINDS_SQL = grading_queries.SQL["posting_kinds"]
SQL = {
    **{k: _over_texts(grading_queries.SQL[k]) for k in ("posting_kinds", "seniority_levels", "heading_styles")},
    **{k: _over_texts(report_queries.SQL[k]) for k in ("culture_tags", "industries")},
    "requirements": _over_texts(_KINDS_SQL[: _KINDS_SQL.index("kinds AS (")] + _KINDS_SQL[_KINDS_SQL.index("kinds AS (") :].replace("SELECT doc_id, section, CASE", "SELECT doc_id, line, text, section, CASE", 1).split("SELECT section, kind, count")[0] + "SELECT doc_id, line, text, section, kind FROM kinds WHERE doc_id < 0"),
    "anti_join": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY 1",
}
