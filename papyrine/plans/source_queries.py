"""Queries on LaTeX sources: a customer's orders as entries with nested arguments, their lines as items, and hidden text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.sources import latex
from papyrine.tables import table

_DATE = "concat(substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * month(o_orderdate) - 2, 3), ' ', year(o_orderdate))"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source a customer: a heading, then for each order two lines with its entry, a list with a line for each item, and one with hidden text for every third."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    b, n = "\\", "\n"
    items = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "p"))), lambda x: F.concat(F.lit(f"{b}item Part {b}textbf{{{b}emph{{"), x["p"].cast("string"), F.lit(f"}}}} at 5{b}% off{n}"))), "").alias("items"))
    entry = F.concat(
        F.lit(f"{b}job{{Works {b}textbf{{{b}emph{{o"), F.col("o_orderkey").cast("string"), F.lit("}} | Tools}"), F.lit(" {"), F.expr(_DATE), F.lit("} % {a comment"), F.lit(f"{n}  {{Office}}{n}{b}begin{{itemize}}{n}"), F.coalesce("items", F.lit("")), F.lit(f"{b}end{{itemize}}{n}"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(f"{b}textcolor{{white}}{{unseen {b}emph{{"), F.col("o_orderkey").cast("string"), F.lit(f"}}}}{n}"))).otherwise(""),
    )
    texts = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", entry.alias("t")))).alias("t"))
    return texts.select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit(f"{b}section{{Jobs {b}emph{{of}} all}}{n}"), F.array_join(F.transform("t", lambda x: x["t"]), "")).alias("text"))


def latex_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latex.events(_sources(spark, sf_dir)).select("doc_id", "line", "kind", "name", "text")


def latex_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latex.model(latex.events(_sources(spark, sf_dir)))


QUERIES = {"latex_events": latex_events, "latex_model": latex_model}

_EVENTS = f"""
WITH items AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
sizes AS (SELECT o_custkey AS doc_id, o_orderkey AS k, {_DATE} AS d, count(l_orderkey) AS n, 4 + count(l_orderkey) + (o_orderkey % 3 = 0)::INT AS lines FROM orders LEFT JOIN items ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, o_orderdate),
placed AS (SELECT *, 2 + coalesce(sum(lines) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS entry FROM sizes),
numbered AS (SELECT l_orderkey, p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, p) AS i FROM items),
events AS (
  SELECT DISTINCT doc_id, 1::BIGINT AS line, 'heading' AS kind, '\\section' AS name, 'Jobs of all' AS text, 0 AS entry, '' AS d FROM placed
  UNION ALL SELECT doc_id, line, 'entry', '\\job', 'Works o' || k || ' | Tools', entry, d FROM placed
  UNION ALL SELECT doc_id, line + 2 + i, 'item', '\\item', 'Part ' || p || ' at 5% off', entry, '' FROM numbered JOIN placed ON l_orderkey = k
  UNION ALL SELECT doc_id, line + 4 + n, 'hidden', '\\textcolor', 'unseen ' || k, entry, '' FROM placed WHERE k % 3 = 0)
"""
SQL = {
    "latex_events": _EVENTS + "SELECT doc_id, line, kind, name, text FROM events",
    "latex_model": _EVENTS + """SELECT doc_id, 't' || line AS line_id, 1 AS section, entry, kind, CASE WHEN kind = 'entry' THEN split_part(text, ' | ', 1) END AS title, CASE WHEN kind = 'entry' THEN 'Tools' END AS tags,
  CASE WHEN kind = 'entry' THEN d END AS dates, CASE WHEN kind = 'entry' THEN 'Office' END AS subtitle, CASE WHEN kind <> 'entry' THEN text END AS text FROM events""",
}
