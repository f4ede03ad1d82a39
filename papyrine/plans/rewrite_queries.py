"""Queries for perturbed statements, the number gate, anchors and placement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions.text import text_of, tokens
from papyrine.operators import rewrites, statements
from papyrine.plans.grading_queries import _STATEMENTS, _numbers
from papyrine.tables import table


def gate_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statements.statements(table(spark, sf_dir, "documents"), "doc_id")
    return rewrites.gate_matrix(rewrites.number_gate(rewrites.perturbed(rows)))


def turn_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user turn the assistant's turn of the conversation that shares most of its words."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("owner"), F.col("turn"), "role", tokens(F.col("text"), "anchor").alias("tokens"))
    asked = turns.filter("role = 'user'").select("owner", F.col("turn").alias("id"), "tokens")
    said = turns.filter("role = 'assistant'").select("owner", F.col("turn").alias("st"), "tokens")
    return rewrites.anchors(asked, said, 0.2)


def unit_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points and lines of documents as boxes on one page each: which line holds the point."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(text_of(F.col("text")), "\n")).alias("line", "text"))
    boxes = lines.select("doc_id", F.lit(0).alias("page"), F.col("line").cast("long").alias("line"), F.lit(36.0).alias("x0"), (14.0 * F.col("line")).alias("y0"), (36.0 + 5 * F.length("text")).alias("x1"), (14.0 * F.col("line") + 11).alias("y1"))
    units = table(spark, sf_dir, "events").select((F.col("user_id") % 1000).alias("doc_id"), F.lit(0).alias("page"), F.col("event_id").alias("unit"), (36.0 + F.col("event_id") % 400).alias("cx"), (1.0 + F.col("event_id") % 97).alias("cy"))
    return rewrites.placed_units(units, boxes)


QUERIES = {"gate_matrix": gate_matrix, "turn_anchors": turn_anchors, "unit_placement": unit_placement}

#: Perturbations of the texts of a table s, and what the number gate says of them.
_PERTURBED = r"""
w AS (SELECT *, string_split(text, ' ') AS w, regexp_extract(text, '[0-9]+') AS f FROM s),
made AS (
  SELECT * EXCLUDE (w, f), unnest(['trim', 'reorder', 'swap_opener', 'add_percent', 'add_count', 'inflate_number']) AS kind, unnest([true, true, true, false, false, false]) AS faithful, unnest([
    array_to_string(w[1:greatest(1, len(w) * 3 // 4)], ' '), regexp_replace(text, '^([^,]+), *(.+)$', '\2, \1'), regexp_replace(text, '^[^ ]+', 'Delivered'), text || ' by 37%', text || ' for 4321 users',
    CASE WHEN f = '' THEN text ELSE regexp_extract(text, '^[^0-9]*') || CASE WHEN length(f) <= 36 THEN (f::HUGEINT * 3 + 7)::VARCHAR ELSE '9' || f END || regexp_replace(text, '^[^0-9]*[0-9]+', '') END]) AS rewrite FROM w),
""" + f"""figures AS (SELECT *, {_numbers("rewrite")} AS said, {_numbers("text")} AS v FROM made WHERE rewrite <> text),
fresh AS (SELECT *, list_filter(said, lambda n: len(list_filter(v, lambda g: abs(n - g) <= greatest(1e-9::DOUBLE, 1e-6::DOUBLE * greatest(abs(n), abs(g))))) = 0) AS new, list_filter(v, lambda g: g > 0)[1:24] AS top FROM figures),
gated AS (
  SELECT *, len(list_filter(new, lambda n: len(list_filter(top, lambda a: len(list_filter(top, lambda b: a > b AND (abs(round((a - b) / a * 100) - n) <= 1
    OR abs((a - b) / a * 100 - n) <= 0.5 OR abs(a / b - n) <= 0.15::DOUBLE OR abs(round(a / b) - n) < 1e-9::DOUBLE))) > 0)) = 0)) = 0 AS accepted FROM fresh)
"""
SQL = {
    "gate_matrix": _STATEMENTS.rstrip() + ", s AS (SELECT text FROM statements)," + _PERTURBED.replace("[1:24] AS top", " AS top") + "SELECT kind, count(*) AS n, count(*) FILTER (accepted) AS n_accepted, count(*) FILTER (accepted = faithful) AS n_right FROM gated GROUP BY kind",
    "turn_anchors": """
WITH t AS (SELECT conv_id AS owner, turn, role, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9+#.%-]*')) AS w FROM conversations),
s AS (SELECT a.owner, a.turn AS id, b.turn AS st, len(list_intersect(a.w, b.w)) / len(a.w) AS score FROM t a JOIN t b ON a.owner = b.owner WHERE a.role = 'user' AND b.role = 'assistant' AND len(a.w) > 0)
SELECT owner, id, st, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY owner, id ORDER BY score DESC, st) AS r FROM s WHERE score >= 0.2) WHERE r = 1""",
    "unit_placement": """
WITH boxes AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents),
units AS (SELECT user_id % 1000 AS doc_id, event_id AS unit, 36.0 + event_id % 400 AS cx, 1.0 + event_id % 97 AS cy FROM events)
SELECT u.doc_id, unit, min(line) AS line FROM units u JOIN boxes b ON b.doc_id = u.doc_id
WHERE cx BETWEEN 33 AND 39 + 5 * length(text) AND cy BETWEEN 14 * line - 2 AND 14 * line + 13 GROUP BY 1, 2""",
}
