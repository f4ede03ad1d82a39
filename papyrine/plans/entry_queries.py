"""Queries on sections of rows: a customer's orders as entries in five layouts, their lines as what is said about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators import entries
from papyrine.tables import table

#: Rows of lineitem that a task takes when entries are told apart.
ROWS_A_TASK = 250_000

#: By o_custkey % 5: titles in bold; plain rows left of bullets; larger titles over running text; items; bold titles with bullets.
_DATE = "concat(substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * month(o_orderdate) - 2, 3), ' ', year(o_orderdate))"
_ROWS = f"""
packed AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS l_quantity, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber),
heads AS (
  SELECT o_custkey AS doc_id, o_custkey % 5 AS layout, o_orderkey * 100 AS line, 0 AS what,
    concat(CASE WHEN o_custkey % 5 = 4 OR (o_custkey % 5 = 3 AND o_orderkey % 2 = 0) THEN '• ' ELSE '' END, CASE o_orderkey % 4
      WHEN 0 THEN concat('Works ', o_orderkey % 97, ' — Parts, Tools (', {_DATE}, ' – ', year(o_orderdate) + 2, ')') WHEN 1 THEN concat('Role ', o_orderkey % 13)
      WHEN 2 THEN concat('Study ', o_orderkey % 7, ', ', {_DATE}) ELSE concat('Post | Clerk ', year(o_orderdate)) END) AS text FROM orders),
more AS (
  SELECT o_custkey AS doc_id, o_custkey % 5 AS layout, o_orderkey * 100 + 1 + n AS line, 1 AS what, CASE n WHEN 0 THEN concat('Office ', o_orderkey % 31, CASE WHEN o_orderkey % 4 = 1 THEN concat(', ', {_DATE}, ' to present') ELSE '' END)
    ELSE 'As far as anyone who was there at that time and place can tell' END AS text
  FROM orders, (SELECT 0 AS n UNION ALL SELECT 1 AS n) x WHERE o_orderkey % 3 > n),
told AS (
  SELECT o_custkey AS doc_id, o_custkey % 5 AS layout, o_orderkey * 100 + 10 + 2 * l_linenumber AS line, 2 AS what,
    concat(CASE WHEN o_custkey % 5 IN (2, 4) THEN '' ELSE '• ' END, 'Shipped ', cast(l_quantity AS int), ' units by order ', l_partkey, '. Checked all of them') AS text FROM orders JOIN packed ON l_orderkey = o_orderkey),
turned AS (
  SELECT o_custkey AS doc_id, o_custkey % 5 AS layout, o_orderkey * 100 + 11 + 2 * l_linenumber AS line, 3 AS what, concat('100% recall of part ', l_partkey) AS text
  FROM orders JOIN packed ON l_orderkey = o_orderkey WHERE l_linenumber % 3 = 0),
every AS (SELECT * FROM heads UNION ALL SELECT * FROM more UNION ALL SELECT * FROM told UNION ALL SELECT * FROM turned),
body AS (
  SELECT doc_id, 0 AS section, CASE layout WHEN 0 THEN 'experience' WHEN 1 THEN 'projects' WHEN 2 THEN 'education' WHEN 3 THEN 'skills' ELSE 'experience' END AS kind, line, text,
    cast(CASE WHEN what = 0 THEN 36 WHEN what = 3 AND layout = 4 THEN 36 + line % 2 * 12 ELSE 48 END AS double) AS x0, cast(CASE WHEN layout = 2 AND what = 0 THEN 12 ELSE 10 END AS double) AS size,
    cast(CASE WHEN layout IN (0, 4) AND what IN (0, 3) THEN 1 ELSE 0 END AS double) AS bold, layout IN (0, 4) AND what IN (0, 3) AS first_bold FROM every)
"""


#: The rows of _ROWS out of narrow rows, an order's or a line's, that are dealt by customer before their texts are made.
_NARROW = """
SELECT o_custkey AS doc_id, o_orderkey, o_orderdate, false AS is_line, 0 AS l_linenumber, cast(0 AS double) AS l_quantity, cast(0 AS bigint) AS l_partkey FROM {orders}
UNION ALL
SELECT o_custkey, o_orderkey, o_orderdate, true, l_linenumber, cast(l_quantity AS double), l_partkey
FROM {orders} JOIN (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS l_quantity, min(l_partkey) AS l_partkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber) ON l_orderkey = o_orderkey"""
_MADE = f"""
SELECT doc_id, doc_id % 5 AS layout, r.* FROM (
  SELECT doc_id, explode(CASE WHEN is_line THEN array(
    named_struct('line', o_orderkey * 100 + 10 + 2 * l_linenumber, 'what', 2, 'text', concat(CASE WHEN doc_id % 5 IN (2, 4) THEN '' ELSE '• ' END, 'Shipped ', cast(l_quantity AS int), ' units by order ', l_partkey, '. Checked all of them')),
    CASE WHEN l_linenumber % 3 = 0 THEN named_struct('line', o_orderkey * 100 + 11 + 2 * l_linenumber, 'what', 3, 'text', concat('100% recall of part ', l_partkey)) END)
  ELSE array(
    named_struct('line', o_orderkey * 100, 'what', 0, 'text', concat(CASE WHEN doc_id % 5 = 4 OR (doc_id % 5 = 3 AND o_orderkey % 2 = 0) THEN '• ' ELSE '' END, CASE o_orderkey % 4
      WHEN 0 THEN concat('Works ', o_orderkey % 97, ' — Parts, Tools (', {_DATE}, ' – ', year(o_orderdate) + 2, ')') WHEN 1 THEN concat('Role ', o_orderkey % 13)
      WHEN 2 THEN concat('Study ', o_orderkey % 7, ', ', {_DATE}) ELSE concat('Post | Clerk ', year(o_orderdate)) END)),
    CASE WHEN o_orderkey % 3 > 0 THEN named_struct('line', o_orderkey * 100 + 1, 'what', 1, 'text', concat('Office ', o_orderkey % 31, CASE WHEN o_orderkey % 4 = 1 THEN concat(', ', {_DATE}, ' to present') ELSE '' END)) END,
    CASE WHEN o_orderkey % 3 > 1 THEN named_struct('line', o_orderkey * 100 + 2, 'what', 1, 'text', 'As far as anyone who was there at that time and place can tell') END) END) AS r FROM {{narrow}})
WHERE r IS NOT NULL"""


def _body(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    tasks = _parts(spark, lineitem)
    narrow = spark.sql(_NARROW, orders=table(spark, sf_dir, "orders"), lineitem=lineitem.repartition(tasks, "l_orderkey"))
    every = spark.sql(_MADE, narrow=narrow.repartition(tasks, "doc_id"))
    return spark.sql("WITH body" + _ROWS.split("body", 1)[1].replace("FROM every", "FROM {every}") + " SELECT * FROM body", every=every)


def _parts(spark: SparkSession, rows: DataFrame) -> int:
    """Tasks of so many rows that what a task sorts doesn't grow with the table; their number is read from the files' ends."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS_A_TASK + 1)


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.roles(entries.segmented(_body(spark, sf_dir)))


def entry_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roles(spark, sf_dir).select("doc_id", "section", "line", "entry", "part", "role", "group")


def entries_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.built(_roles(spark, sf_dir))


def entry_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of entries that have bullets: their number in the section, and their text with its wrapped rows."""
    rows = _roles(spark, sf_dir).filter("`group` > 0").groupBy("doc_id", "section", "entry", "group").agg(F.sort_array(F.collect_list(F.struct("line", entries.bare(F.col("text")).alias("t")))).alias("rows"))
    return rows.select("doc_id", "section", "entry", "group", F.size("rows").cast("long").alias("n_rows"), F.array_join(F.transform("rows", lambda x: x["t"]), " ").alias("text"))


QUERIES = {"entry_roles": entry_roles, "entries_built": entries_built, "entry_statements": entry_statements}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(names: list[str]) -> str:
    return "(" + ", ".join(map(_q, names)) + ")"


_RANGE, _SINGLE = entries.RANGE, entries.SINGLE
_BARE = f"trim(regexp_replace(text, {_q(entries.BULLET_SIGN)}, ''))"
_SEGMENTED = "WITH " + _ROWS + f""",
signs AS (
  SELECT *, {_BARE} AS t, regexp_matches(text, {_q(entries.BULLET)}) AS bullet, regexp_matches({_BARE}, {_q(_RANGE)}) AS ranged,
    regexp_matches({_BARE}, {_q(_RANGE)}) OR regexp_matches({_BARE}, {_q(_SINGLE)}) AS dated, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos FROM body),
whole AS (
  SELECT doc_id, count(*) FILTER (bullet AND first_bold) >= 2 AS bulleted, coalesce(min(x0) FILTER (first_bold), 0) AS title_x, bool_or(first_bold) AS any_bold, max(size) AS top, min(size) AS low,
    count(*) AS n, count(*) FILTER (bullet) AS bullets, list_sort(list(x0) FILTER (bullet))[count(*) FILTER (bullet) // 2 + 1] AS bullet_x FROM signs GROUP BY doc_id),
sized AS (
  SELECT s.*, w.* EXCLUDE (doc_id), NOT any_bold AND top - low >= 0.8 AND (SELECT count(*) FROM signs z WHERE z.doc_id = w.doc_id AND z.size >= w.top - 0.3) < n AS large FROM signs s JOIN whole w ON s.doc_id = w.doc_id),
kinds AS (
  SELECT *, kind IN {_in(entries.ENTRY_KINDS)} AND NOT any_bold AND NOT large AND bullets >= 2 AS plain, x0 > title_x + 6 AS far, kind IN {_in(entries.ITEM_KINDS)} AS items, kind IN {_in(entries.LIST_KINDS)} AND bullet AS listed,
    NOT bullet AND (x0 < bullet_x - 4 OR (dated AND len(string_split_regex(t, '\\s+')) <= 12)) AS candidate,
    CASE WHEN large THEN size >= top - 0.3 ELSE first_bold AND bold >= 0.25 END AND kind <> 'summary' AS raw FROM sized),
judged AS (
  SELECT *, bulleted AND raw AND NOT bullet AND NOT ranged AS soft, max(pos) FILTER (bullet) OVER b AS last_bullet, max(pos) FILTER (candidate) OVER b AS last_candidate
  FROM kinds WINDOW b AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
firm AS (
  SELECT *, CASE WHEN soft AND pos > 1 THEN NULL WHEN CASE WHEN soft THEN NOT far ELSE raw END THEN 'T' WHEN (listed OR pos = 1) AND items THEN 'L' ELSE 'R' END AS firm FROM judged),
decided AS (
  SELECT *, CASE WHEN firm IS NOT NULL THEN firm WHEN lag(firm) OVER w = 'L' THEN CASE WHEN far THEN 'R' ELSE 'T' END ELSE lag(firm) OVER w END AS d FROM firm WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
states AS (SELECT *, last_value(d IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS state FROM decided),
begun AS (
  SELECT *, CASE WHEN plain THEN pos = 1 OR coalesce(candidate AND last_bullet IS NOT NULL AND (last_candidate IS NULL OR last_candidate < last_bullet), false)
      ELSE pos = 1 OR CASE WHEN state = 'T' THEN bullet OR coalesce(lag(state) OVER w, 'R') <> 'T' OR ranged ELSE listed END END AS new,
    CASE WHEN NOT plain THEN state IN ('T', 'L') WHEN pos = 1 THEN NOT bullet AND x0 < bullet_x - 4 ELSE coalesce(candidate AND last_bullet IS NOT NULL AND (last_candidate IS NULL OR last_candidate < last_bullet), false) END AS titled
  FROM states WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
placed AS (SELECT *, (sum(new::INT) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS entry FROM begun),
fits AS (
  SELECT *, NOT titled AS rest, bool_or(titled) OVER (PARTITION BY doc_id, entry) AS has_title, count(*) FILTER (NOT titled) OVER e AS place,
    count(*) FILTER (NOT titled AND NOT (NOT bullet AND len(string_split_regex(t, '\\s+')) <= 10 AND t NOT LIKE '%.')) OVER e AS unfit
  FROM placed WINDOW e AS (PARTITION BY doc_id, entry ORDER BY line ROWS UNBOUNDED PRECEDING)),
metas AS (SELECT *, rest AND has_title AND unfit = 0 AND place <= 2 AS meta FROM fits),
spoken AS (SELECT *, rest AND NOT meta AS told, bool_or(rest AND NOT meta AND bullet) OVER (PARTITION BY doc_id, entry) AS signed FROM metas),
starts AS (SELECT *, told AND signed AND (bullet OR count(*) FILTER (told) OVER e = 1) AS begins FROM spoken WINDOW e AS (PARTITION BY doc_id, entry ORDER BY line ROWS UNBOUNDED PRECEDING)),
roles AS (
  SELECT *, CASE WHEN titled THEN 'title' ELSE 'rest' END AS part, CASE WHEN meta THEN 'meta' WHEN items THEN 'item' WHEN rest THEN 'statement' ELSE 'title' END AS role,
    CASE WHEN told THEN CASE WHEN signed THEN count(*) FILTER (begins) OVER (PARTITION BY doc_id, entry ORDER BY line ROWS UNBOUNDED PRECEDING) ELSE 0 END END AS g FROM starts)
"""


def _dates(text: str) -> str:
    a, b = (f"regexp_extract({text}, {_q(_RANGE)}, {k})" for k in (1, 2))
    return f"CASE WHEN {a} <> '' THEN {a} || ' – ' || {b} ELSE regexp_extract({text}, {_q(_SINGLE)}, 1) END"


def _removed(text: str) -> str:
    for pattern in entries._REMOVED:
        text = f"regexp_replace({text}, {_q(pattern)}, '', 'g')"
    return f"trim(regexp_replace({text}, '\\s{{2,}}', ' ', 'g'), {_q(entries.EDGES)})"


_CUT = r"regexp_replace(regexp_replace(told, '([.!?])(\s+)([A-Z(])', '\1\2' || chr(2) || '\3', 'g'), '(?i)(^|[^A-Za-z0-9_])(e\.g|i\.e|etc|vs|approx|no)\.(\s+)' || chr(2), '\1\2.\3', 'g')"
SQL = {
    "entry_roles": _SEGMENTED + 'SELECT doc_id, section, line, entry, part, role, g AS "group" FROM roles',
    "entries_built": _SEGMENTED + f""", gathered AS (
  SELECT doc_id, section, entry, coalesce(string_agg(t, ' ' ORDER BY line) FILTER (titled), '') AS whole, coalesce(string_agg(text, ' ' ORDER BY line) FILTER (rest AND place <= 2), '') AS early,
    coalesce(string_agg(t, ' · ' ORDER BY line) FILTER (meta), '') AS meta, bool_or(plain) AS plain, count(DISTINCT g) FILTER (g > 0) AS n_groups, coalesce(string_agg(t, ' ' ORDER BY line) FILTER (g = 0), '') AS told
  FROM roles GROUP BY ALL),
cut AS (
  SELECT *, {_removed("whole")} AS titled, string_split_regex({_removed("whole")}, {_q(entries.DASH)}) AS parts, trim({_removed("meta")}, ' ·,-–') AS shown,
    len(list_filter(string_split({_CUT}, chr(2)), lambda x: trim(x) <> '')) AS n_sentences FROM gathered),
split AS (
  SELECT *, trim(parts[1], {_q(entries.EDGES)}) AS name, trim(CASE WHEN len(parts) > 1 THEN regexp_replace(titled, {_q("^.*?(?:" + entries.DASH + ")")}, '') ELSE '' END, {_q(entries.EDGES)}) AS tail, CASE WHEN plain AND shown <> '' THEN shown ELSE meta END AS subtitle FROM cut)
SELECT doc_id, section, entry, CASE WHEN name <> '' THEN name ELSE whole END AS title, array_to_string(list_filter(list_transform(string_split_regex(tail, ',\\s*'), lambda x: trim(x)), lambda x: x <> ''), '; ') AS tags,
  coalesce(nullif({_dates("whole")}, ''), nullif({_dates("early")}, ''), nullif({_dates("subtitle")}, ''), '') AS dates, subtitle, n_groups + CASE WHEN told = '' THEN 0 ELSE n_sentences END AS n_statements FROM split""",
    "entry_statements": _SEGMENTED + """SELECT doc_id, section, entry, g AS "group", count(*) AS n_rows, string_agg(t, ' ' ORDER BY line) AS text FROM roles WHERE g > 0 GROUP BY ALL""",
}
