"""Queries for tags, formulaic phrases, findings, hidden spans, timelines and reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions.text import text_of
from papyrine.operators import reports, statements
from papyrine.operators.intervals import month_number
from papyrine.operators.textstats import SIGNALS
from papyrine.tables import table

_FOUND = ["email", "percent", "ipv4", "license", "url", "masked_metric", "todo"]


def formulaic_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.formulaic_share(statements.statements(table(spark, sf_dir, "documents"), "source"), "source")


def signal_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.signal_findings(table(spark, sf_dir, "documents"), _FOUND)


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as spans whose looks follow from their ids."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(text_of(F.col("text")), "\n")).alias("line", "text"))
    k = F.col("doc_id") * 31 + F.col("line") * 7
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), (k % 97 % 5).alias("render_mode"), (F.lit(1.0) - (k % 53 == 0).cast("double")).alias("opacity"), (F.lit(2.0) + k % 11).alias("size"), (k % 256).alias("r"), (k * 3 % 256).alias("g"), (k * 5 % 256).alias("b"), F.lit(255).alias("bg_r"), F.lit(255).alias("bg_g"), F.lit(255).alias("bg_b"))


def hidden_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.hidden_spans(_spans(spark, sf_dir))
    return rows.groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.avg("contrast"), 4).alias("contrast"))


def timeline_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries: every seventh has no dates, every eleventh ends before it starts, every second is full-time."""
    start = month_number(F.col("o_orderdate"))
    key = F.col("o_orderkey")
    entries = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), key.alias("id"), F.when(key % 7 != 0, start).alias("start"), F.when(key % 7 != 0, start + F.when(key % 11 == 0, -2).otherwise(key % 9)).alias("end"), (key % 2 == 0).alias("full_time"))
    return reports.timeline_findings(entries, 1998 * 12)


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a reader that takes two columns of lines, set side by side, row by row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split(text_of(F.col("text")), "\n")).alias("line", "text"), F.size(F.split(text_of(F.col("text")), "\n")).alias("n"))
    half = F.floor((F.col("n") + 1) / 2)
    placed = lines.select("doc_id", "text", F.lit(0).alias("page"), F.when(F.col("line") < half, 36.0).otherwise(320.0).alias("x0"), (14.0 * (F.col("line") % half)).alias("y0"))
    return reports.reading_order_integrity(docs, reports.rows_view(placed))


QUERIES = {
    "formulaic_phrases": formulaic_phrases,
    "signal_findings": signal_findings,
    "hidden_spans": hidden_spans,
    "timeline_findings": timeline_findings,
    "reading_order_integrity": reading_order,
}


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


_TEXT = "WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)"
_CASES = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS signal, regexp_extract(text, '{SIGNALS[n]}') AS first, len(regexp_extract_all(text, '{SIGNALS[n]}'))::BIGINT AS n, text FROM documents WHERE text IS NOT NULL" for n in _FOUND)


def _channel(c: str) -> str:
    return f"CASE WHEN {c} / 255.0::DOUBLE <= 0.03928::DOUBLE THEN {c} / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"


SQL = {
    "culture_tags": _TEXT + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS tag, count(*) AS n_docs FROM d WHERE {_has(v)}" for k, v in reports.CULTURE.items()) + ") WHERE n_docs > 0",
    "industries": _TEXT + " SELECT CASE " + " ".join(f"WHEN {_has(v)} THEN '{k}'" for k, v in reports.INDUSTRY.items()) + " ELSE 'none' END AS industry, count(*) AS n_docs FROM d GROUP BY 1",
    "formulaic_phrases": r"""
WITH s AS (SELECT source, trim(unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ ]+([A-Z(])', '\1' || chr(10) || '\2', 'g'), chr(10))), ' ' || chr(9) || chr(13)) AS text FROM documents),
c AS (SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(PHRASES)([^A-Za-z0-9_]|$)')) AS flagged FROM s WHERE text <> '' GROUP BY source)
SELECT *, round(flagged / n, 6) AS share, CASE WHEN flagged / n >= 0.35 THEN 'elevated' WHEN flagged / n >= 0.15 THEN 'moderate' ELSE 'low' END AS level FROM c""".replace("PHRASES", "|".join(reports.FORMULAIC)),
    "signal_findings": f"""
WITH f AS ({_CASES}), p AS (SELECT *, instr(text, first) AS a FROM f WHERE first <> '')
SELECT doc_id, signal, n, substring(text, greatest(1, a - 30), length(first) + a + 30 - greatest(1, a - 30)) AS context FROM p""",
    "hidden_spans": f"""
WITH raw AS (SELECT doc_id, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents),
k AS (SELECT doc_id * 31 + line * 7 AS k FROM raw),
spans AS (SELECT k % 97 % 5 AS m, CASE WHEN k % 53 = 0 THEN 0.0 ELSE 1.0 END AS o, 2 + k % 11 AS size, k % 256 AS r, k * 3 % 256 AS g, k * 5 % 256 AS b FROM k),
c AS (SELECT *, round(1.05::DOUBLE / (0.2126::DOUBLE * {_channel("r")} + 0.7152::DOUBLE * {_channel("g")} + 0.0722::DOUBLE * {_channel("b")} + 0.05::DOUBLE), 6) AS contrast FROM spans)
SELECT CASE WHEN m = 3 THEN 'invisible' WHEN o < 0.1 THEN 'transparent' WHEN size < 4 THEN 'tiny' WHEN contrast < 1.25 THEN 'low_contrast' WHEN contrast < 1.6 THEN 'faint' ELSE 'none' END AS reason,
  count(*) AS n, round(avg(contrast), 4) AS contrast FROM c GROUP BY 1""",
    "reading_order_integrity": r"""
WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
k AS (SELECT doc_id, unnest(p) AS t, unnest(range(0, len(p))) AS line, (len(p) + 1) // 2 AS half FROM l),
r AS (SELECT doc_id, round(14.0::DOUBLE * (line % half) / 3.0) AS y, CASE WHEN line < half THEN 36 ELSE 320 END AS x, t FROM k),
g AS (SELECT doc_id, y, string_agg(t, ' ' ORDER BY x, t) AS t FROM r GROUP BY doc_id, y),
views AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY y) AS text FROM g GROUP BY doc_id),
both_texts AS (SELECT doc_id, 'a' AS side, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS w FROM documents UNION ALL SELECT doc_id, 'b', regexp_extract_all(lower(text), '[a-z0-9_]+') FROM views),
pairs AS (SELECT doc_id, side, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [array_to_string(w, '')] END) AS pair FROM both_texts),
n AS (SELECT doc_id, pair, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM pairs GROUP BY doc_id, pair),
i AS (SELECT doc_id, round(2 * sum(least(a, b)) / (sum(a) + sum(b))::DOUBLE, 3) AS integrity FROM n GROUP BY doc_id)
SELECT doc_id, integrity, CASE WHEN integrity >= 0.95 THEN 'good' WHEN integrity >= 0.85 THEN 'fair' ELSE 'poor' END AS verdict FROM i""",
    "timeline_findings": """
WITH e AS (
  SELECT o_custkey AS owner, o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN m END AS s, CASE WHEN o_orderkey % 7 <> 0 THEN m + CASE WHEN o_orderkey % 11 = 0 THEN -2 ELSE o_orderkey % 9 END END AS e, o_orderkey % 2 = 0 AS full_time
  FROM (SELECT *, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m FROM orders)),
v AS (SELECT * FROM e WHERE e >= s),
marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY owner ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM v),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY owner ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM marked),
islands AS (SELECT owner, min(s) AS s, max(e) AS e FROM numbered GROUP BY owner, i),
found AS (
  SELECT owner, CASE WHEN s IS NULL THEN 'undated' WHEN e < s THEN 'end_before_start' WHEN e > 23976 THEN 'future' END AS finding FROM e
  UNION ALL SELECT a.owner, 'overlap' FROM v a JOIN v b ON a.owner = b.owner AND a.id < b.id WHERE a.full_time AND b.full_time AND least(a.e, b.e) - greatest(a.s, b.s) + 1 >= 3
  UNION ALL SELECT owner, 'gap' FROM (SELECT *, lead(s) OVER (PARTITION BY owner ORDER BY s) AS n FROM islands) WHERE n - e - 1 >= 7)
SELECT owner, finding, CASE WHEN finding = 'end_before_start' THEN 'error' WHEN finding IN ('future', 'overlap') THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM found WHERE finding IS NOT NULL GROUP BY 1, 2""",
}
