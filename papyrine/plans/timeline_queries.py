"""Queries on dated entries: orders of a customer as posts, studies and projects with dates in five spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators import timelines
from papyrine.operators.intervals import union_length
from papyrine.tables import table

NOW = 1998 * 12 + 6
_ENTRIES = """
  SELECT o_custkey AS owner, o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'education' WHEN 1 THEN 'projects' ELSE 'experience' END AS section,
    CASE o_orderkey % 9 WHEN 0 THEN 'Research Assistant' WHEN 4 THEN 'Part-time Clerk' ELSE 'Engineer' END AS title,
    CASE o_orderkey % 8 WHEN 0 THEN concat({mon}(o_orderdate), ' ', {year}, ' – ', {mon}({later}), ' ', year({later})) WHEN 1 THEN concat({month}, '/', {year}, ' - ', month({later}), '/', year({later}))
      WHEN 2 THEN concat({year}, ' - ', {year} + o_orderkey % 3) WHEN 3 THEN concat('Summer ', {year}) WHEN 4 THEN concat({mon}(o_orderdate), '. ', {year}, ' to present')
      WHEN 5 THEN concat({mon}({later}), ' ', year({later}), ' - ', {mon}(o_orderdate), ' ', {year}) WHEN 6 THEN '' ELSE concat('Expected ', {mon}({later}), ', ', year({later})) END AS dates
  FROM orders"""
_SPARK = _ENTRIES.format(mon="date_month", year="year(o_orderdate)", month="month(o_orderdate)", later="later")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("later", F.add_months(F.to_date("o_orderdate"), (F.col("o_orderkey") % 23).cast("int")))
    text = _SPARK.replace("date_month(o_orderdate)", "date_format(o_orderdate, 'MMM')").replace("date_month(later)", "date_format(later, 'MMMM')")
    return spark.sql(text.replace("FROM orders", "FROM {orders}"), orders=orders)


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("Clerk with "), F.col("c_custkey") % 14, F.lit("+ years of professional experience, "), F.col("c_custkey") % 5, F.lit(" yrs exp in sales"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), timelines.years_claimed(said).alias("claimed"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timelines.dated(_entries(spark, sf_dir), NOW)


def experience_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months that a customer's posts cover, as a label and in years, and the years claimed."""
    posts = _dated(spark, sf_dir).filter("section = 'experience' AND `end` >= start")
    covered = union_length(posts.select("owner", "start", "end")).join(_claims(spark, sf_dir), "owner", "left")
    return covered.select("owner", F.col("covered").alias("months"), timelines.months_label(F.col("covered")).alias("label"), F.round(F.col("covered") / 12, 1).alias("years"), "claimed")


def entry_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that had their dates beside them, without these."""
    rows = _entries(spark, sf_dir).select("id", timelines.undated_text(F.concat("title", F.lit(" ("), "dates", F.lit(")"))).alias("title"))
    return rows.groupBy("title").agg(F.count("*").alias("n"))


QUERIES = {
    "date_ranges": lambda s, d: _dated(s, d).select("id", "start", "end", "present", "expected", "precise", "part_time"),
    "timeline_checks": lambda s, d: timelines.timeline(_dated(s, d), _claims(s, d), NOW),
    "experience_length": experience_length,
    "entry_titles": entry_titles,
}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_DUCK = _ENTRIES.format(mon="mon", year="year(o_orderdate)", month="month(o_orderdate)", later="later").replace("mon(o_orderdate)", "strftime(o_orderdate, '%b')").replace("mon(later)", "strftime(later, '%B')").replace(
    "FROM orders", "FROM (SELECT *, o_orderdate::DATE + to_months((o_orderkey % 23)::INT) AS later FROM orders)"
)
_GROUPS = ", ".join(f"regexp_extract_all(lower(dates), {_q(timelines.DATE)}, {k}) AS g{k}" for k in range(1, 8))
_SEASON = "CASE {x} " + " ".join(f"WHEN '{k}' THEN {{{i}}}" for i, k in enumerate(timelines.SEASONS)) + " END"
_BEGIN = _SEASON.format(*(v[0] for v in timelines.SEASONS.values()), x="g5[i]")
_FINISH = _SEASON.format(*(v[1] + 12 * (v[1] < v[0]) for v in timelines.SEASONS.values()), x="g5[i]")
_MONTH = "list_position([" + ", ".join(f"'{m}'" for m in timelines.MONTHS) + "], g1[i])"
_YEAR = "(g2[i]::INT + CASE WHEN g2[i]::INT < 100 THEN 2000 ELSE 0 END) * 12"
_ONE = f"CASE WHEN coalesce(g1[i], '') <> '' THEN {_YEAR} + {_MONTH} - 1 WHEN coalesce(g3[i], '') <> '' THEN g4[i]::INT * 12 + g3[i]::INT - 1 WHEN coalesce(g5[i], '') <> '' THEN g6[i]::INT * 12 + {{season}} - 1 ELSE g7[i]::INT * 12 + {{alone}} END"
_DATED = f"""
WITH e AS ({_DUCK}), g AS (SELECT *, {_GROUPS} FROM e),
m AS (
  SELECT *, list_transform(range(1, len(g7) + 1), lambda i: {_ONE.format(season=_BEGIN, alone="0")}) AS a, list_transform(range(1, len(g7) + 1), lambda i: {_ONE.format(season=_FINISH, alone="11")}) AS b,
    regexp_matches(dates, {_q(timelines.PRESENT)}) AS present, regexp_matches(dates, {_q(timelines.EXPECTED)}) AS expected FROM g),
d AS (
  SELECT owner, id, section, title, a[1]::BIGINT AS start, (CASE WHEN len(a) > 0 THEN CASE WHEN present THEN {NOW} ELSE b[-1] END END)::BIGINT AS "end", present, expected,
    len(a) > 0 AND len(list_filter(range(1, len(a) + 1), lambda i: b[i] - a[i] >= 11)) = 0 AS precise, regexp_matches(title, {_q(timelines.PART_TIME)}) OR section <> 'experience' AS part_time FROM m),
jobs AS (SELECT * FROM d WHERE section = 'experience'), v AS (SELECT * FROM jobs WHERE "end" >= start), f AS (SELECT * FROM v WHERE NOT part_time),
marked AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY owner ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM v),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY owner ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM marked),
worked AS (SELECT owner, sum(e - s + 1)::BIGINT AS covered FROM (SELECT owner, min(start) AS s, max("end") AS e FROM numbered GROUP BY owner, i) GROUP BY owner),
claims AS (SELECT c_custkey AS owner, greatest(c_custkey % 14, c_custkey % 5) AS claimed FROM customer)
"""
SQL = {
    "date_ranges": _DATED + 'SELECT id, start, "end", present, expected, precise, part_time FROM d',
    "timeline_checks": _DATED + f"""
SELECT owner, 'end_before_start' AS finding, 'error' AS severity, id, NULL::BIGINT AS other, start - "end" AS months FROM d WHERE "end" < start
UNION ALL SELECT owner, 'future', 'warning', id, NULL, "end" - {NOW} FROM d WHERE "end" >= start AND "end" > {NOW} AND NOT present AND NOT expected AND section <> 'education'
UNION ALL SELECT owner, 'undated', 'info', id, NULL, NULL FROM jobs WHERE start IS NULL
UNION ALL SELECT x.owner, 'overlap', 'warning', x.id, y.id, least(x."end", y."end") - greatest(x.start, y.start) + 1 FROM f x JOIN f y ON x.owner = y.owner AND x.id < y.id
  AND least(x."end", y."end") - greatest(x.start, y.start) + 1 > CASE WHEN x.precise AND y.precise THEN 2 ELSE 12 END
UNION ALL SELECT owner, 'gap', 'info', id, n, s - "end" - 1 FROM (SELECT *, lead(id) OVER w AS n, lead(start) OVER w AS s, lead(precise) OVER w AS p FROM v WINDOW w AS (PARTITION BY owner ORDER BY start, id))
  WHERE s - "end" - 1 > CASE WHEN precise AND p THEN 6 ELSE 12 END
UNION ALL SELECT f.owner, 'before_graduation', 'info', id, NULL, grad - start FROM f JOIN (SELECT owner, max("end") AS grad FROM d WHERE section = 'education' GROUP BY owner) USING (owner) WHERE grad - start > 6 AND "end" > start + 3
UNION ALL SELECT owner, 'years_claim', 'warning', NULL, claimed, coalesce(covered, 0) FROM claims LEFT JOIN worked USING (owner) WHERE claimed * 12 > coalesce(covered, 0) + 12""",
    "experience_length": _DATED + """SELECT owner, covered AS months, CASE WHEN covered >= 12 THEN concat(covered // 12, ' yr ', covered % 12, ' mo') ELSE concat(covered, ' mo') END AS label, round(covered / 12, 1) AS years, claimed
FROM worked LEFT JOIN claims USING (owner)""",
    "entry_titles": f"""
WITH e AS ({_DUCK}), bare AS (SELECT regexp_replace(regexp_replace(concat(title, ' (', dates, ')'), {_q("(?i)" + timelines.DATE)}, ' ', 'g'), {_q(timelines.PRESENT)}, ' ', 'g') AS t FROM e)
SELECT trim(regexp_replace(t, {_q(timelines.LEFT_BARE)}, ' ', 'g'), ' ') AS title, count(*) AS n FROM bare GROUP BY 1""",
}
