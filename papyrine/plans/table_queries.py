"""Queries on events, orders, labels and documents: timelines, queues, evaluation, matches, rubric."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.functions.text import search_tokens
from papyrine.operators import evaluation, intervals, matching, retrieval, rubric
from papyrine.plans import retrieval_queries
from papyrine.storage import materialize
from papyrine.tables import table


def _event_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours: an event lasts as many as the remainder of its id by 30."""
    start = F.floor(F.unix_seconds(F.col("ts").cast("timestamp_ltz")) / 3600)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), start.alias("start"), (start + F.col("event_id") % 30).alias("end"))


def _order_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = intervals.month_number(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), month.alias("start"), (month + F.col("o_orderkey") % 4).alias("end"))


def job_queue_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten events of each type by time, as a queue would run them."""
    rows = evaluation.at_most(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], 10)
    return rows.select("event_type", "rank", "event_id", "user_id")


def keep_first_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.keep_first(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.at_most(table(spark, sf_dir, "events"), ["user_id"], [F.col("value").desc(), "event_id"], 3)
    return rows.select("user_id", "rank", "event_id", F.round("value", 6).alias("value"))


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by the number in the JSON of props."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def history_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest orders of each nation with customer and nation, and lines if there are any."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    named = orders.join(customers.select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    newest = evaluation.at_most(named, ["n_name"], [F.col("o_orderdate").desc(), "o_orderkey"], 5)
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    return newest.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("n_name", "rank", "o_orderkey", "c_name", F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"))


def weighted_line_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    value = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity") * value) / F.sum("l_quantity"), 4).alias("weighted"), F.round(F.sum(value), 2).alias("value"))


def status_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return counted.select("o_orderpriority", *(F.coalesce(c, F.lit(0).cast("long")).alias(f"status_{c.lower()}") for c in "FOP"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")


def label_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).withColumn("long_enough", (F.col("n_chars") >= 500).cast("int"))
    return evaluation.precision_recall(rows, "long_enough", "quality")


def stratified_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.stratified_sample(table(spark, sf_dir, "labels"), "quality", "doc_id", 0.2).select("doc_id", "quality")


def recall_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the documents that hold a passage word for word BM25 has among its three best.

    Both look at the same postings, so documents are cut into words once.
    """
    held = retrieval_queries.passage_postings(spark, sf_dir)
    expected = retrieval_queries.passage_evidence(spark, sf_dir, held).select("query_id", "chunk_id")
    return retrieval.recall_at(retrieval_queries.bm25_search(spark, sf_dir, held), expected, 3)


def _skills(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pairs of documents and passages that BM25 brings together, their terms as skills, and relations: terms with one beginning."""
    found = materialize(retrieval_queries.bm25_search(spark, sf_dir).select(F.col("chunk_id").alias("left"), F.col("query_id").alias("right")), "skills-pairs")
    have = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("owner"), F.explode(search_tokens(F.col("text"))).alias("skill"))
    have = have.join(found.select(F.col("left").alias("owner")).distinct(), "owner", "left_semi")
    want = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("owner"), F.explode(search_tokens(F.col("text"))).alias("skill"))
    terms = want.select("skill").distinct()
    aliases = terms.filter(F.col("skill").rlike(r"[.-]$")).select(F.col("skill").alias("alias"), F.regexp_replace("skill", r"[.-]+$", "").alias("canonical"))
    wanted, had = matching.normalized(want, aliases), matching.normalized(have, aliases)
    begin = F.substring("skill", 1, 5)
    long_terms = wanted.filter(F.length("skill") >= 6).select("skill", begin.alias("stem")).distinct()
    relations = long_terms.select(F.col("skill").alias("src"), "stem").join(long_terms.select(F.col("skill").alias("dst"), "stem"), "stem").filter("src != dst").select("src", "dst")
    return found, had, wanted, relations


def skill_match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_scores(matching.cascade(*_skills(spark, sf_dir)))


def requirement_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.requirement_verdicts(skill_match_cascade(spark, sf_dir))
    return rows.groupBy("verdict").agg(F.count("*").alias("n"), F.round(100 * F.sum("earned") / F.count("*"), 6).alias("percent"))


def keyword_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, have, want, _ = _skills(spark, sf_dir)
    return matching.keyword_overlap(pairs, have.withColumnRenamed("skill", "word"), want.withColumnRenamed("skill", "word"))


#: Frequent terms of the given texts, standing for a lexicon of skills.
_LEXICON = ["the", "and", "les", "des", "die", "der", "que", "los", "trash", "license", "http"]


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rubric.rule_scores(rubric.document_features(table(spark, sf_dir, "documents"), _LEXICON), 2026)


QUERIES = {
    "interval_union": lambda s, d: intervals.union_length(_event_intervals(s, d)),
    "interval_gaps": lambda s, d: intervals.gaps(_event_intervals(s, d), 6),
    "interval_overlap_pairs": lambda s, d: intervals.overlaps(_event_intervals(s, d), 3),
    "overlap_matrix": lambda s, d: intervals.overlap_matrix(_event_intervals(s, d)),
    "order_months_union": lambda s, d: intervals.union_length(_order_intervals(s, d)),
    "order_gaps": lambda s, d: intervals.gaps(_order_intervals(s, d), 7),
    "job_queue_fifo": job_queue_fifo,
    "keep_first_dedupe": keep_first_event,
    "topk_per_group": top_values,
    "event_props": event_props,
    "history_join": history_join,
    "weighted_line_value": weighted_line_value,
    "status_crosstab": status_crosstab,
    "auc_quality": lambda s, d: evaluation.roc_auc(_labelled(s, d), "n_chars", "quality"),
    "spearman_quality": lambda s, d: evaluation.spearman(_labelled(s, d), "n_chars", "quality"),
    "mean_by_label": lambda s, d: evaluation.mean_by_label(_labelled(s, d), "quality", "n_chars"),
    "label_precision": label_precision,
    "stratified_sample": stratified_labels,
    "recall_report": recall_report,
    "skill_match_cascade": skill_match_cascade,
    "jd_requirement_verdicts": requirement_verdicts,
    "keyword_similarity": keyword_similarity,
    "rubric_rules": _rules,
    "rubric_totals": lambda s, d: rubric.totals(_rules(s, d)),
}

_EVENTS = "WITH v AS (SELECT user_id AS owner, event_id AS id, event_type AS kind, floor(epoch(ts) / 3600)::BIGINT AS s, floor(epoch(ts) / 3600)::BIGINT + event_id % 30 AS e FROM events)"
_ORDERS = "WITH v AS (SELECT o_custkey AS owner, o_orderkey AS id, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS s, year(o_orderdate) * 12 + month(o_orderdate) - 1 + o_orderkey % 4 AS e FROM orders)"
_ISLANDS = """, marked AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY owner ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM v),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY owner ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM marked),
islands AS (SELECT owner, min(s) AS s, max(e) AS e FROM numbered GROUP BY owner, i)
"""
_UNION = "SELECT owner, count(*) AS n_islands, sum(e - s + 1)::BIGINT AS covered FROM islands GROUP BY owner"
_GAPS = """SELECT owner, e + 1 AS gap_from, n - 1 AS gap_to, n - e - 1 AS length FROM (SELECT *, lead(s) OVER (PARTITION BY owner ORDER BY s) AS n FROM islands) WHERE n - e - 1 >= """
_LABELLED = "WITH r AS (SELECT l.*, d.n_chars, d.lang FROM labels l JOIN documents d USING (doc_id)), mids AS (SELECT *, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS ra, rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2 AS rb FROM r) "
_PAIRS = retrieval_queries._BM25.rstrip() + r""", pairs AS (SELECT chunk_id AS l, query_id AS r FROM ranked WHERE rank <= 3),
raw_want AS (SELECT DISTINCT query_id AS r, lower(term) AS skill FROM asked),
aliases AS (SELECT DISTINCT skill AS alias, regexp_replace(skill, '[.-]+$', '') AS canonical FROM raw_want WHERE regexp_matches(skill, '[.-]$')),
want AS (SELECT DISTINCT r, coalesce(canonical, skill) AS skill FROM raw_want LEFT JOIN aliases ON alias = skill),
have AS (SELECT DISTINCT chunk_id AS l, coalesce(canonical, term) AS skill FROM posts LEFT JOIN aliases ON alias = term WHERE chunk_id IN (SELECT l FROM pairs))
"""
_CASCADE = _PAIRS + """, wanted AS (SELECT l, r, skill FROM pairs JOIN want USING (r)),
kinds AS (
  SELECT w.*, CASE WHEN EXISTS (SELECT 1 FROM have h WHERE h.l = w.l AND h.skill = w.skill) THEN 'direct'
    WHEN length(w.skill) >= 6 AND EXISTS (SELECT 1 FROM have h JOIN (SELECT DISTINCT skill FROM want) x ON x.skill = h.skill
      WHERE h.l = w.l AND h.skill <> w.skill AND length(h.skill) >= 6 AND left(h.skill, 5) = left(w.skill, 5)) THEN 'related'
    WHEN EXISTS (SELECT 1 FROM have h WHERE h.l = w.l AND (contains(h.skill, w.skill) OR contains(w.skill, h.skill))) THEN 'partial' ELSE 'missing' END AS kind FROM wanted w),
scores AS (
  SELECT l AS "left", r AS "right", count(*) FILTER (kind = 'direct') AS n_direct, count(*) FILTER (kind = 'related') AS n_related, count(*) FILTER (kind = 'partial') AS n_partial,
    count(*) FILTER (kind = 'missing') AS n_missing, round(20 * sum(CASE kind WHEN 'direct' THEN 1.0 WHEN 'related' THEN 0.6 WHEN 'partial' THEN 0.4 ELSE 0 END::DOUBLE) / count(*), 6) AS score
  FROM kinds GROUP BY l, r)
""".replace("scores AS (\n  SELECT l AS", "matched AS (\n  SELECT l AS")
_LEX = ", ".join(f"'{w}'" for w in _LEXICON)
_STD = ", ".join(f"'{w}'" for w in rubric.STANDARD)
_RULES = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')) AS lines FROM documents),
f AS (
  SELECT doc_id, length(trim(text, ' ')) AS n_chars, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n,
    list_transform(list_filter(lines, lambda x: length(x) BETWEEN 1 AND 40 AND NOT regexp_matches(x, '[0-9@|]')), lambda x: lower(regexp_replace(x, '[^A-Za-z ]', '', 'g'))) AS h,
    lower(regexp_extract(text, '{rubric.EMAIL}')) AS email, regexp_matches(text, '{rubric.PHONE}') AS phone, lines[1] <> '' AS name,
    regexp_extract_all(text, '(^|[^0-9])((19|20)[0-9]{{2}})([^0-9]|$)', 2) AS years,
    len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_+#.-]+')), [{_LEX}])) AS k,
    regexp_extract_all(text, '[a-z]+://[^ \\n]+') AS links, regexp_matches(text, ' \\| ') AS tables FROM t),
g AS (
  SELECT *, len(h) = 0 AS none, 3 - len(list_intersect(['experience', 'education', 'skills'], h)) AS lacking, len(list_intersect(list_distinct(h), [{_STD}])) AS known,
    len(list_distinct(h)) AS distinct_h, len(list_filter(years, lambda y: y::INT > 2026)) AS future, len(list_filter(links, lambda x: NOT regexp_matches(x, '^https?://'))) AS bad FROM f),
rules AS (
  SELECT doc_id, round(greatest(0, 20 * CASE WHEN n_chars < 50 THEN 0 ELSE 1 - (CASE WHEN n < 100 THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN n < 50 THEN 0.2 ELSE 0 END::DOUBLE) END::DOUBLE), 1) AS extractability,
    round(greatest(0, 15 * CASE WHEN none THEN 0.2::DOUBLE ELSE 1 - (0.15::DOUBLE * lacking + CASE WHEN len(h) > distinct_h THEN 0.1 ELSE 0 END::DOUBLE) END), 1) AS sections,
    round(greatest(0, 15 * (1 - CASE WHEN tables THEN 0.2 ELSE 0 END::DOUBLE)), 1) AS formatting,
    round(greatest(0, 10 * (1 - (CASE WHEN name THEN 0 ELSE 0.3 END::DOUBLE + CASE WHEN email = '' THEN 0.3 ELSE 0 END::DOUBLE
      + CASE WHEN regexp_matches(email, 'sexy|hot|cool|420|69') THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN phone THEN 0 ELSE 0.2 END::DOUBLE))), 1) AS contact,
    round(greatest(0, 10 * CASE WHEN none THEN 0 ELSE known / greatest(distinct_h, 1) END), 1) AS headings,
    round(greatest(0, 10 * (1 - (CASE WHEN len(years) = 0 THEN 0.3 ELSE 0 END::DOUBLE + 0.2::DOUBLE * future))), 1) AS dates,
    round(greatest(0, 10 * CASE WHEN k = 0 THEN 0 ELSE 1 - CASE WHEN k < 5 THEN 0.2 ELSE 0 END::DOUBLE END::DOUBLE), 1) AS skills,
    round(greatest(0, 5 * (1 - (CASE WHEN email = '' THEN 0.3 ELSE 0 END::DOUBLE + 0.1::DOUBLE * bad))), 1) AS links,
    round(greatest(0, 5 * (1 - (CASE WHEN none THEN 0.4 ELSE 0 END::DOUBLE + CASE WHEN email = '' AND NOT name THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN lacking >= 2 THEN 0.2 ELSE 0 END::DOUBLE))), 1) AS parsing
  FROM g)
"""
_SHARES = " UNION ALL ".join(f"SELECT doc_id, {k} / {v} AS share, {i} AS i, '{k}' AS rule, {k} AS score FROM rules" for i, (k, v) in enumerate(rubric.MOST.items()))
SQL = {
    "interval_union": _EVENTS + _ISLANDS + _UNION,
    "interval_gaps": _EVENTS + _ISLANDS + _GAPS + "6",
    "interval_overlap_pairs": _EVENTS + "SELECT a.owner, a.id AS id_a, b.id AS id_b, least(a.e, b.e) - greatest(a.s, b.s) + 1 AS shared FROM v a JOIN v b ON a.owner = b.owner AND a.id < b.id WHERE least(a.e, b.e) - greatest(a.s, b.s) + 1 >= 3",
    "overlap_matrix": _EVENTS + "SELECT a.kind AS kind_a, b.kind AS kind_b, sum(least(a.e, b.e) - greatest(a.s, b.s) + 1)::BIGINT AS shared FROM v a JOIN v b ON a.owner = b.owner AND a.id <> b.id WHERE least(a.e, b.e) >= greatest(a.s, b.s) GROUP BY 1, 2",
    "order_months_union": _ORDERS + _ISLANDS + _UNION,
    "order_gaps": _ORDERS + _ISLANDS + _GAPS + "7",
    "job_queue_fifo": "SELECT event_type, rank, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rank FROM events) WHERE rank <= 10",
    "keep_first_dedupe": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1",
    "topk_per_group": "SELECT user_id, rank, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3",
    "event_props": "SELECT json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1",
    "history_join": """
WITH named AS (SELECT n_name, o_orderkey, c_name, row_number() OVER (PARTITION BY n_name ORDER BY o_orderdate DESC, o_orderkey) AS rank
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT n_name, rank, o_orderkey, c_name, coalesce(n, 0) AS n_lines FROM named LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE rank <= 5""",
    "weighted_line_value": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity * l_extendedprice * (1 - l_discount)) / sum(l_quantity), 4) AS weighted, round(sum(l_extendedprice * (1 - l_discount)), 2) AS value FROM lineitem GROUP BY 1, 2",
    "status_crosstab": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS status_f, count(*) FILTER (o_orderstatus = 'O') AS status_o, count(*) FILTER (o_orderstatus = 'P') AS status_p FROM orders GROUP BY 1",
    "auc_quality": _LABELLED + "SELECT p AS n_positive, n AS n_negative, round((r - p * (p + 1) / 2) / (p * n), 6) AS auc FROM (SELECT sum(ra) FILTER (quality = 1) AS r, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n FROM mids)",
    "spearman_quality": _LABELLED + "SELECT count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM mids",
    "mean_by_label": _LABELLED + "SELECT quality, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS sd, min(n_chars) AS least, max(n_chars) AS most, round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.95), 6) AS p95 FROM r GROUP BY quality",
    "label_precision": _LABELLED + """, c AS (SELECT count(*) FILTER (p AND quality = 1) AS tp, count(*) FILTER (p AND quality = 0) AS fp, count(*) FILTER (NOT p AND quality = 1) AS fn, count(*) FILTER (NOT p AND quality = 0) AS tn FROM (SELECT *, n_chars >= 500 AS p FROM r))
SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c""".replace(") , c", "), c"),
    "stratified_sample": "SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels) WHERE r <= round(n * 0.2::DOUBLE)",
    "recall_report": retrieval_queries._BM25 + """, found AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))
SELECT count(*) AS n_queries, round(avg((r.rank IS NOT NULL)::INT::DOUBLE), 6) AS recall FROM found f LEFT JOIN ranked r ON r.query_id = f.query_id AND r.chunk_id = f.chunk_id AND r.rank <= 3""",
    "skill_match_cascade": _CASCADE + "SELECT * FROM matched",
    "jd_requirement_verdicts": _CASCADE + """, judged AS (
  SELECT CASE WHEN n_direct = n_direct + n_related + n_partial + n_missing THEN 'met' WHEN n_direct > 0 THEN 'partial' WHEN n_related > 0 THEN 'transferable' WHEN n_partial > 0 THEN 'partial' ELSE 'missing' END AS verdict FROM matched)
SELECT verdict, count(*) AS n, round(100 * sum(CASE verdict WHEN 'met' THEN 1.0 WHEN 'partial' THEN 0.6 WHEN 'transferable' THEN 0.4 ELSE 0 END::DOUBLE) / count(*), 6) AS percent FROM judged GROUP BY verdict""",
    "keyword_similarity": _PAIRS + """, sizes AS (SELECT l, count(*) AS nl FROM have GROUP BY l), wants AS (SELECT r, count(*) AS nr FROM want GROUP BY r),
shared AS (SELECT p.l, p.r, count(h.skill) AS shared FROM pairs p JOIN want w USING (r) LEFT JOIN have h ON h.l = p.l AND h.skill = w.skill GROUP BY 1, 2)
SELECT l AS "left", r AS "right", shared, round(shared / nr, 6) AS overlap, round(least(1.0::DOUBLE, 5 * shared / (coalesce(nl, 0) + nr - shared)), 6) AS similarity FROM shared LEFT JOIN sizes USING (l) JOIN wants USING (r)""",
    "rubric_rules": _RULES + "SELECT * FROM rules",
    "rubric_totals": _RULES + f"""SELECT doc_id, round(sum(score), 1) AS total, arg_min(rule, share * 1000 + i * 0.000001::DOUBLE) AS weakest FROM ({_SHARES}) GROUP BY doc_id""",
}
