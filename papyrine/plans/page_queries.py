"""Queries on pages of placed pieces: documents' words in fives, set in one column, in two, or in two below a headline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions.text import text_of
from papyrine.operators import pages, views
from papyrine.storage import materialize
from papyrine.tables import table

#: Pieces of a page, and words of a piece.
PIECES, WORDS = 60, 5
#: Documents that a task takes: what it sorts doesn't grow with the table, nor with how the files are cut.
TEXTS_A_TASK = 5_000
#: By doc_id % 3: rows of three pieces that begin further right on every row; two columns; two columns with a headline and heads.
_SET = f"""
SELECT doc_id, i // {PIECES} AS page, i AS piece, text, 612.0 AS width, style = 2 AND j < 3 AS bold,
  CASE WHEN style = 2 AND j = 0 THEN 18.0 WHEN style = 2 AND j < 3 THEN 14.0 ELSE 10.0 END AS size,
  CASE style WHEN 0 THEN 36.0 + 130 * (j % 3) + 40 * (j // 3 % 5) WHEN 1 THEN 36.0 + 280 * (j % 2) ELSE CASE WHEN j = 0 THEN 36.0 ELSE 36.0 + 280 * ((j + 1) % 2) END END AS x0,
  CASE style WHEN 0 THEN 36.0 + 130 * (j % 3) + 40 * (j // 3 % 5) + 120 WHEN 1 THEN 36.0 + 280 * (j % 2) + least(250, 4 * length(text)) ELSE CASE WHEN j = 0 THEN 560.0 ELSE 36.0 + 280 * ((j + 1) % 2) + least(250, 4 * length(text)) END END AS x1,
  CASE style WHEN 0 THEN 40.0 + 12 * (j // 3) + 1.0 * (j % 3) WHEN 1 THEN 60.0 + 20 * (j // 2) + 0.5 * (j % 3) ELSE CASE WHEN j = 0 THEN 20.0 ELSE 60.0 + 14 * ((j - 1) // 2) END END AS y0
FROM cut"""


def _parts(spark: SparkSession, documents: DataFrame) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), documents.count() // TEXTS_A_TASK + 1)


def _placed(spark: SparkSession, sf_dir: str, text: Column | None = None) -> DataFrame:
    """Pieces with regions and rows. text: what stands in a piece, from doc_id, i and text; a piece's own words by default."""
    five = rf"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){{0,{WORDS - 1}}}[^\x20\x09-\x0D]+"
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Dealt by document before they are cut, so a page is gathered where its pieces are.
    tasks = _parts(spark, documents)
    documents = documents.repartition(tasks, "doc_id")
    cut = documents.select("doc_id", F.posexplode(F.regexp_extract_all(text_of(F.col("text")), F.lit(five), F.lit(0))).alias("i", "text"))
    cut = cut.withColumn("text", F.regexp_replace("text", r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))
    cut = cut.select("doc_id", F.col("i").cast("long").alias("i"), (F.col("text") if text is None else text).alias("text"), (F.col("i") % PIECES).alias("j"), (F.col("doc_id") % 3).alias("style"))
    numbers = {c: F.col(c).cast("double") for c in ("x0", "x1", "y0", "size", "width")}
    pieces = spark.sql(_SET.replace("FROM cut", "FROM {cut}").replace("//", "div"), cut=cut).withColumns(numbers).withColumn("y1", F.col("y0") + 10.0)
    return pages.laid(pieces, tasks)


def page_gutters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _placed(spark, sf_dir)
    return placed.groupBy("doc_id", "page").agg(F.max("gutter").alias("gutter"), *(F.sum((F.col("region") == k).cast("long")).alias(f"n_{name}") for k, name in enumerate(("above", "left", "right"))))


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in reading order; texts as md5."""
    rows = pages.rows(_placed(spark, sf_dir))
    return rows.select("doc_id", "page", "line", "x0", "y0", "x1", "y1", F.md5("text").alias("text_md5"), "size", "bold", "first_bold", "is_bullet")


def _views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Views with integrity, and contacts. The second piece is an address, the third a number; every seventh ends in a month, and of every second document in three the last of them are cells."""
    dated = F.when(F.col("i") == 1, F.concat(F.lit("mail"), "doc_id", F.lit("@example.org"))).when(F.col("i") == 2, F.concat(F.lit("+49 30 "), F.lpad((F.col("doc_id") % 9973).cast("string"), 7, "5")))
    dated = dated.when(F.col("i") % 7 == 3, F.concat("text", F.lit(" Mar "), 2000 + F.col("i") % 20)).otherwise(F.col("text"))
    placed = materialize(_placed(spark, sf_dir, dated), "placed")
    dealt = placed.repartition(_parts(spark, table(spark, sf_dir, "documents")), "doc_id")
    read = pages.rows(dealt).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    cells = placed.filter("doc_id % 6 = 0 and piece % 60 >= 50").select("doc_id", "page", F.col("piece").alias("cell"), "text")
    contacts = placed.groupBy("doc_id").agg(F.max(F.when(F.col("piece") == 1, F.col("text"))).alias("email"), F.max(F.when(F.col("piece") == 2, F.col("text"))).alias("phone"))
    return views.integrity(views.view_texts(placed, cells), read), contacts


def parser_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.checked(*_views(spark, sf_dir))


def parser_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.verdicts(parser_views(spark, sf_dir))


QUERIES = {"parser_views": parser_views, "parser_verdicts": parser_verdicts, "page_gutters": page_gutters, "page_rows": page_rows, "layout_flags": lambda s, d: pages.flags(_placed(s, d))}

_PLACED = rf"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
numbered AS (SELECT doc_id, w, unnest(range(0, (len(w) + {WORDS - 1}) // {WORDS})) AS i FROM split),
cut AS (SELECT doc_id, i, array_to_string(w[{WORDS} * i + 1:{WORDS} * i + {WORDS}], ' ') AS text, i % {PIECES} AS j, doc_id % 3 AS style FROM numbered),
pieces AS (SELECT *, y0 + 10 AS y1 FROM (SELECT * REPLACE (x0::DOUBLE AS x0, x1::DOUBLE AS x1, y0::DOUBLE AS y0, size::DOUBLE AS size, width::DOUBLE AS width) FROM ({_SET}))),
tried AS (
  SELECT doc_id, page, g, count(*) AS n, count(*) FILTER (x1 <= g) AS l, count(*) FILTER (x0 >= g) AS r, count(*) FILTER (x0 < g AND g < x1) AS c
  FROM pieces, (SELECT unnest(range(183, 428, 2)) AS g) GROUP BY doc_id, page, g),
best AS (
  SELECT doc_id, page, arg_min(g, (10 * c - least(l, r)) * 1000 + g)::DOUBLE AS gutter FROM tried WHERE n >= 16 AND l >= 8 AND r >= 8 AND c <= greatest(2, 0.06::DOUBLE * n) GROUP BY doc_id, page),
crossed AS (
  SELECT p.*, gutter, coalesce(x0 < gutter AND gutter < x1, false) AS crosses, list_sort(list(size) OVER (PARTITION BY p.doc_id, p.page))[count(*) OVER (PARTITION BY p.doc_id, p.page) // 2 + 1] AS median
  FROM pieces p LEFT JOIN best b ON b.doc_id = p.doc_id AND b.page = p.page),
banded AS (SELECT *, coalesce(max(y1) FILTER (crosses) OVER (PARTITION BY doc_id, page), 0) AS band FROM crossed),
begun AS (SELECT *, coalesce(min(y0) FILTER (NOT crosses AND size >= 1.25 * median AND bold AND y0 >= band - 1) OVER (PARTITION BY doc_id, page) - 1, band) AS start FROM banded),
placed AS (SELECT *, CASE WHEN gutter IS NULL OR y0 < start THEN 0 WHEN x1 <= gutter + 1 THEN 1 ELSE 2 END AS region FROM begun)
"""
SQL = {
    "page_gutters": _PLACED + """SELECT doc_id, page, max(gutter) AS gutter, count(*) FILTER (region = 0) AS n_above, count(*) FILTER (region = 1) AS n_left, count(*) FILTER (region = 2) AS n_right FROM placed GROUP BY doc_id, page""",
    "page_rows": _PLACED + r""", queued AS (SELECT *, (y0 + y1) / 2 AS y, row_number() OVER (PARTITION BY doc_id, page, region ORDER BY round_even((y0 + y1) / 2, 0), x0, piece) AS k FROM placed),
folded AS (
  SELECT doc_id, page, region, k, y AS first, 0::BIGINT AS row FROM queued WHERE k = 1
  UNION ALL
  SELECT q.doc_id, q.page, q.region, q.k, CASE WHEN abs(f.first - q.y) > 2.5 THEN q.y ELSE f.first END, f.row + (abs(f.first - q.y) > 2.5)::INT
  FROM folded f JOIN queued q ON q.doc_id = f.doc_id AND q.page = f.page AND q.region = f.region AND q.k = f.k + 1),
held AS (
  SELECT doc_id, page, region, row, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, '  ' ORDER BY x0, piece) AS joined, arg_max(size, length(text) * 100000 - x0) AS size,
    sum(length(text)) AS n, coalesce(sum(length(text)) FILTER (bold), 0) AS b, arg_min(bold, x0) AS first_bold FROM queued JOIN folded USING (doc_id, page, region, k) GROUP BY ALL),
texts AS (SELECT *, regexp_replace(trim(regexp_replace(joined, '\s+', ' ', 'g')), '\s+([,.;:])', '\1', 'g') AS text FROM held)
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page, region, row) - 1 AS line, x0, y0, x1, y1, md5(text) AS text_md5, size, round(b / n::DOUBLE, 2) AS bold, first_bold,
  regexp_matches(text, '^\s*([•●▪■◦‣⁃►▶➢➤→*·○◆◇❖✓✔➔»▫◾-]\s*|-\s+[A-Za-z(\"“])') AS is_bullet FROM texts""",
    "layout_flags": _PLACED + "SELECT doc_id, count(DISTINCT page) AS pages, bool_or(gutter IS NOT NULL) AS has_columns, CASE WHEN bool_or(gutter IS NOT NULL) THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS order_confidence FROM placed GROUP BY doc_id",
}
