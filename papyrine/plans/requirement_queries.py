"""Queries on requirements: lines of a brand's postings against statements of its parts; words of parts' names are skills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators import requirements
from papyrine.plans import posting_queries, wording_queries
from papyrine.storage import materialize
from papyrine.tables import table


def _skilled(rows: DataFrame, keys: list[str], names: DataFrame) -> DataFrame:
    """rows with skills: the words of their text that are names."""
    words = rows.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_+#]+"), F.lit(0)))).alias("skill")).join(names, "skill")
    held = words.groupBy(*keys).agg(F.array_sort(F.collect_set("skill")).alias("skills"))
    return rows.join(held, keys, "left").withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    parts = table(spark, sf_dir, "part")
    words = parts.select(F.col("p_brand").alias("key"), "p_size", F.explode(F.split("p_name", " ")).alias("skill"))
    names = materialize(words.select("skill").distinct(), "skill-names")
    lines = posting_queries.requirements(spark, sf_dir).withColumn("p_partkey", -1 - F.col("doc_id")).join(parts.select("p_partkey", F.col("p_brand").alias("key")), "p_partkey")
    asked = materialize(_skilled(lines.select("key", (F.col("p_partkey") * 100 + F.col("line")).alias("req"), "kind", "text"), ["key", "req"], names), "requirements")
    told = materialize(_skilled(wording_queries._bullets(spark, sf_dir).select(F.col("owner").alias("key"), F.col("st").alias("id"), "text"), ["key", "id"], names), "statements")
    other = names.withColumnRenamed("skill", "other")
    relations = names.join(other, F.substring("skill", 1, 1) == F.substring("other", 1, 1)).filter("skill <> other")
    return asked, told, words.filter("p_size > 45").select("key", "skill").distinct(), relations


def requirement_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, told, _, _ = _inputs(spark, sf_dir)
    return requirements.retrieved(asked, told).select("key", "req", "id", F.round("score", 6).alias("score"), "rank")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, told, listed, relations = _inputs(spark, sf_dir)
    return requirements.verdicts(asked, told, materialize(requirements.retrieved(asked, told), "hits"), listed, relations)


def requirement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).withColumn("cited", F.array_join(F.transform("cited", lambda x: x.cast("string")), " "))


def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requirements.report(_judged(spark, sf_dir))


QUERIES = {"requirement_hits": requirement_hits, "requirement_report": requirement_report, "match_report": match_report}

_STOP = ", ".join(f"'{w}'" for w in requirements.STOP)
_LINES = posting_queries.SQL["requirements"]
_HITS = f"""
WITH lines AS ({_LINES}), bullets AS ({wording_queries._BULLETS.format(part='part')}),
names AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS skill FROM part),
listed AS (SELECT DISTINCT p_brand AS key, unnest(string_split(p_name, ' ')) AS skill FROM part WHERE p_size > 45),
asked AS (SELECT p_brand AS key, p_partkey * 100 + line AS req, kind, text FROM lines JOIN part ON p_partkey = -1 - doc_id),
split AS (SELECT key, req, kind, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9+#.-]{{2,}}'), lambda w: w NOT IN ({_STOP}))) AS w, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_+#]+')) AS t FROM asked),
told AS (SELECT owner AS key, st AS id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9+#.-]{{2,}}'), lambda w: w NOT IN ({_STOP}))) AS w, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_+#]+')) AS t FROM bullets),
wanted AS (SELECT * FROM (SELECT key, req, unnest(t) AS skill FROM split) SEMI JOIN names USING (skill)),
shows AS (SELECT * FROM (SELECT key, id, unnest(t) AS skill FROM told) SEMI JOIN names USING (skill)),
points AS (
  SELECT key, req, id, sum(p) AS score FROM (
    SELECT a.key, a.req, b.id, 1.0::DOUBLE / greatest(a.n, 1) AS p FROM (SELECT key, req, len(w) AS n, unnest(w) AS x FROM split) a JOIN (SELECT key, id, unnest(w) AS x FROM told) b ON a.key = b.key AND a.x = b.x
    UNION ALL SELECT a.key, a.req, b.id, 2.0 FROM wanted a JOIN shows b ON a.key = b.key AND a.skill = b.skill) GROUP BY ALL),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, req ORDER BY round(score, 9) DESC, id) AS rank FROM points) WHERE rank <= 3)
"""
_JUDGED = _HITS + """,
shown AS (SELECT DISTINCT key, req, skill FROM hits JOIN shows USING (key, id)),
known AS (SELECT key, req, skill FROM shown UNION SELECT s.key, s.req, l.skill FROM split s JOIN listed l ON l.key = s.key),
near AS (SELECT DISTINCT w.key, w.req FROM wanted w JOIN known k ON k.key = w.key AND k.req = w.req AND k.skill <> w.skill AND left(k.skill, 1) = left(w.skill, 1)),
counts AS (
  SELECT w.key, w.req, count(*) AS n, count(s.skill) AS shown, count(l.skill) AS listed FROM wanted w LEFT JOIN shown s ON s.key = w.key AND s.req = w.req AND s.skill = w.skill
  LEFT JOIN listed l ON l.key = w.key AND l.skill = w.skill GROUP BY 1, 2),
tops AS (SELECT key, req, max(score) AS top, list(id ORDER BY rank) AS ids FROM hits GROUP BY 1, 2),
ruled AS (
  SELECT s.key, s.req, s.kind, ids, CASE WHEN n IS NOT NULL AND shown = n THEN 'met high' WHEN n IS NOT NULL AND shown > 0 THEN 'partial med' WHEN n IS NOT NULL AND listed > 0 THEN 'partial low' WHEN n IS NOT NULL AND r.req IS NOT NULL THEN 'transferable low'
    WHEN n IS NOT NULL THEN 'missing high' WHEN coalesce(round(top, 9), 0) >= 0.5 THEN 'partial low' ELSE 'missing med' END AS rule
  FROM split s LEFT JOIN counts c ON c.key = s.key AND c.req = s.req LEFT JOIN tops t ON t.key = s.key AND t.req = s.req LEFT JOIN near r ON r.key = s.key AND r.req = s.req),
weighed AS (
  SELECT *, split_part(rule, ' ', 1) AS verdict, split_part(rule, ' ', 2) AS confidence, CASE kind WHEN 'required' THEN 3 WHEN 'education' THEN 2 WHEN 'certification' THEN 2 ELSE 1 END::DOUBLE AS weight,
    CASE split_part(rule, ' ', 1) WHEN 'met' THEN 1 WHEN 'partial' THEN 0.6 WHEN 'transferable' THEN 0.4 ELSE 0 END::DOUBLE AS earned FROM ruled),
judged AS (SELECT *, round((1 - earned) * weight * 3.5::DOUBLE, 1) AS uplift FROM weighed)
"""
SQL = {
    "requirement_hits": _HITS + "SELECT key, req, id, round(score, 6) AS score, rank FROM hits",
    "requirement_report": _JUDGED + "SELECT key, req, kind, verdict, confidence, CASE WHEN verdict = 'missing' THEN '' ELSE coalesce(array_to_string(ids[:2], ' '), '') END AS cited, uplift FROM judged",
    "match_report": _JUDGED + """SELECT key, round(sum(earned * weight) / sum(weight) * 100, 1) AS match, count(*) FILTER (verdict = 'met') AS n_met, count(*) FILTER (verdict IN ('partial', 'transferable')) AS n_partial, count(*) FILTER (verdict = 'missing') AS n_missing,
  round(sum(uplift), 1) AS uplift, arg_min(req, (-uplift * 1000, req)) FILTER (uplift > 0) AS next FROM judged GROUP BY key""",
}
