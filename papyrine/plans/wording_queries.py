"""Queries on the wording of statements made from parts, on customers as people, and on splits and mixes of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions.text import text_of, tokens, words
from papyrine.operators import evaluation, rewrites, statements, wording
from papyrine.plans.grading_queries import _GRADED, q
from papyrine.plans.rewrite_queries import _PERTURBED
from papyrine.tables import table

#: Statements of a brand's parts in ten wordings, the same in both dialects.
_BULLETS = """
  SELECT p_brand AS owner, p_partkey AS st, CASE p_partkey % 10 WHEN 0 THEN concat('Developed ', p_name, ', reducing cost by ', p_size, '%') WHEN 1 THEN concat('Responsible for various ', p_type, ' tasks and several more, etc.')
    WHEN 2 THEN concat('Designed ', p_name, ' achieving ', p_size, ' orders, with a focus on ', p_brand, ' quality') WHEN 3 THEN concat('Successfully built several ', p_name, ' systems in order to boost throughput for ', p_size, ' users')
    WHEN 4 THEN concat('I was asked to help and reports were reviewed by ', p_brand) WHEN 5 THEN concat('Led ', p_size, ' people at ', p_brand, ' to top ', p_size) WHEN 6 THEN 'manage the team'
    WHEN 7 THEN concat('Saved $1,', 100 + p_size, ' in costs at -> ', p_size, '% latency') WHEN 8 THEN concat('Raised €', p_size, 'M in funding, with ', p_size, '% recall')
    ELSE concat(p_type, ' ', p_name, ' ', repeat('and much more of it ', p_size % 9)) END AS text FROM {part}"""


def _bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_BULLETS, part=table(spark, sf_dir, "part"))


def bullet_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _bullets(spark, sf_dir).select("st", wording.verb_tier(text).cast("long").alias("tier"), wording.metric_position(text).cast("long").alias("position"), wording.metric_phrase(text).alias("phrase"), text.rlike(wording.PASSIVE).alias("passive"), text.rlike(wording.FIRST_PERSON).alias("first_person"))


def bullet_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bullets(spark, sf_dir).select("st", wording.front_load(F.col("text")).alias("front_loaded"), wording.trim_filler(F.col("text")).alias("trimmed"))
    return rows.filter("front_loaded is not null or trimmed is not null")


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.graded(_bullets(spark, sf_dir))


def bullet_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five findings of each owner that cost most: no action 2.5, vague words 1.2 and .8 for each, too long 5."""
    rows = _graded(spark, sf_dir)
    n = F.size(words(F.col("text")))
    found = F.array(
        F.when(~F.col("has_action"), F.struct(F.lit("no action").alias("title"), F.lit(2.5).alias("points"))), F.when(F.col("n_vague") > 0, F.struct(F.lit("vague").alias("title"), (1.2 + 0.8 * F.col("n_vague")).alias("points"))),
        F.when(n > 34, F.struct(F.lit("long").alias("title"), F.lit(5.0).alias("points"))),
    )
    findings = rows.select("owner", "st", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("owner", "st", "f.title", F.round("f.points", 2).alias("points"))
    return wording.top_fixes(findings, "owner")


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers: orders are posts, lines statements, flags skill categories; sections and pages follow from the key."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.countDistinct("l_returnflag").alias("flags"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.count("*").alias("posts"), F.sum(F.coalesce("lines", F.lit(0))).alias("lines"), F.max(F.coalesce("flags", F.lit(0))).alias("flags"))
    people = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    k = F.col("c_custkey")
    named = {"experience": F.col("posts").isNotNull(), "education": k % 3 != 0, "skills": k % 4 != 0, "summary": k % 5 != 0, "projects": k % 7 == 0}
    sections = F.filter(F.array(*(F.when(v, F.lit(name)) for name, v in named.items())), lambda x: x.isNotNull())
    return people.select(k.alias("owner"), sections.alias("sections"), F.floor(F.coalesce("lines", F.lit(0)) / 20).alias("pages"), (F.col("lines") / F.col("posts")).alias("per_post"), F.coalesce("flags", F.lit(0)).alias("categories"), F.coalesce("lines", F.lit(0)).alias("skills"), (k % 400).alias("summary_chars"))


def person_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wording.scannability(wording.section_balance(_people(spark, sf_dir)))
    total = F.col("balance") + F.col("scannability")
    return rows.select("owner", "balance", "scannability", wording.one_place(total).alias("total"), wording.one_place(100 * total / 25).alias("percent"))


def token_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document under the tokenisers that have no query of their own."""
    text = F.col("text")
    kinds = {"evidence": F.size(tokens(text, "evidence")), "words": F.size(tokens(text, "words")), "long_words": F.size(tokens(text, "long_words")), "manifest": F.size(tokens(text, "manifest")), "threes": F.size(F.array_distinct(F.regexp_extract_all(F.lower(text_of(text)), F.lit("[a-z0-9_]{3,}"), F.lit(0))))}
    return table(spark, sf_dir, "documents").select("doc_id", *(v.cast("long").alias(k) for k, v in kinds.items()), F.md5(F.array_join(F.slice(words(text), 1, 350), " ")).alias("head"))


def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts of each split, and how many of them the training split hasn't."""
    rows = evaluation.group_split(table(spark, sf_dir, "documents"), "doc_id").select("split", F.md5(text_of(F.col("text"))).alias("h")).distinct()
    seen = rows.filter("split = 'train'").select("h", F.lit(1).alias("seen"))
    return rows.join(seen, "h", "left").groupBy("split").agg(F.count("*").alias("n_texts"), F.sum(F.col("seen").isNull().cast("long")).alias("n_unseen"))


def faithful_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perturbed statements that the number gate accepts, of 8 to 40 words and graded no worse than what they came from."""
    rows = rewrites.number_gate(rewrites.perturbed(_bullets(spark, sf_dir)), partners=24).filter("accepted").filter(F.size(words(F.col("rewrite"))).between(8, 40))
    before = _graded(spark, sf_dir).select("st", F.col("grade").alias("before"))
    after = statements.graded(rows.select("st", "kind", F.col("rewrite").alias("text"))).select("st", "kind", "grade")
    return after.join(before, "st").filter("grade <= before").groupBy("kind").agg(F.count("*").alias("n"), F.sum((F.col("grade") < F.col("before")).cast("long")).alias("n_better"))


def agreeing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that a second judge by length repeats, by label."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("verdict"))
    second = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 500).cast("int").alias("verdict"))
    return rewrites.agreeing(labels, second, "doc_id", "verdict").groupBy("verdict").agg(F.count("*").alias("n"))


def sentence_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the running text of each owner's statements: sentences, and how many read as bullets and as requirements."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("st", "text"))), lambda x: x["text"]), " • ")
    rows = statements.training_sentences(_bullets(spark, sf_dir).groupBy("owner").agg(joined.alias("text")), "owner")
    return rows.groupBy("owner").agg(F.count("*").alias("n"), F.sum(statements.is_bullet(F.col("sentence")).cast("long")).alias("n_bullets"), F.sum(statements.is_requirement(F.col("sentence")).cast("long")).alias("n_requirements"), F.max(F.length("sentence")).cast("long").alias("longest"))


_CAPS = {"click": 40, "view": 25, "purchase": 10}


def capped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrites.capped_mix(table(spark, sf_dir, "events"), "event_type", _CAPS, "event_id").select("event_type", "event_id")


QUERIES = {
    "bullet_marks": bullet_marks,
    "bullet_rewrites": bullet_rewrites,
    "bullet_grades": lambda s, d: _graded(s, d).select("st", "has_action", "has_specific", "has_metric", "has_outcome", "n_vague", "grade"),
    "bullet_specificity": lambda s, d: wording.specificity(_graded(s, d), "owner"),
    "bullet_clarity": lambda s, d: wording.clarity(_bullets(s, d), "owner"),
    "bullet_fixes": bullet_fixes,
    "person_scores": person_scores,
    "token_kinds": token_kinds,
    "split_overlap": split_overlap,
    "faithful_rewrites": faithful_rewrites,
    "agreeing_labels": agreeing_labels,
    "capped_events": capped_events,
    "sentence_spans": lambda s, d: statements.sentence_spans(table(s, d, "documents")),
    "sentence_kinds": sentence_kinds,
}

_B = f"WITH b AS ({_BULLETS.format(part='part')})"
_CHAIN = _GRADED[_GRADED.index("\n, tokens AS (") + 1 :].replace("FROM statements)", "FROM b)")
_ALL = _B + _CHAIN
_WORDS = "len(regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+'))"


def _map(values: dict[str, str]) -> str:
    return "map {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in values.items()) + "}"


_FOCUS = "regexp_replace(text, '(?i),?\\s*(with a focus on|focused on)\\s+[^.]*', '', 'g')"
_P = f"CASE WHEN {_WORDS.format('text')} > 34 THEN 1.5 WHEN {_WORDS.format('text')} < 6 THEN 0.5 ELSE 0 END::DOUBLE + CASE WHEN regexp_matches(text, {q(wording.PASSIVE)}) THEN 0.75 ELSE 0 END::DOUBLE + CASE WHEN regexp_matches(text, {q(wording.FIRST_PERSON)}) THEN 0.5 ELSE 0 END::DOUBLE + CASE WHEN lower(regexp_extract(text, '^\\s*([^\\s]+)', 1)) IN ({', '.join(map(q, statements.PRESENT_FORMS))}) THEN 0.5 ELSE 0 END::DOUBLE"
SQL = {
    "bullet_marks": _B + f"""SELECT st, (CASE WHEN regexp_matches(text, {q(wording.HIDING)}) THEN 3 WHEN lower(regexp_extract(text, '[A-Za-z][A-Za-z0-9_-]*')) IN ({', '.join(map(q, wording.STRONG))}) THEN 1 ELSE 2 END)::BIGINT AS tier,
  CASE WHEN m <> '' THEN {_WORDS.format("left(text, instr(text, m) - 1)")} END::BIGINT AS position, regexp_replace(trim(regexp_replace(ph, '^[^A-Za-z0-9$₹€£#]+', ''), ' ,;:().'), '\\s+×', '×', 'g') AS phrase, regexp_matches(text, {q(wording.PASSIVE)}) AS passive, regexp_matches(text, {q(wording.FIRST_PERSON)}) AS first_person
FROM (SELECT *, regexp_extract(text, {q(statements.METRIC)}) AS m, regexp_extract(text, {q(statements.METRIC + statements.MEASURED)}) AS ph FROM b)""",
    "bullet_rewrites": _B + f""", p AS (SELECT *, {_map(wording.GERUNDS)}[lower(regexp_extract(trim(text), {q(wording.LINKED)}, 1))] AS g, {_map(wording.RESULT)}[lower(regexp_extract(trim(text), {q(wording.LINKED)}, 3))] AS l, {_FOCUS} AS f FROM b),
t AS (SELECT *, CASE WHEN f <> text AND rtrim(f) NOT LIKE '%.' THEN regexp_replace(f, '[ ,]+$', '') || '.' ELSE f END AS e FROM p),
s AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(e, '(?i)(^|[^A-Za-z0-9_])(successfully|effectively|various)\\s+', '\\1', 'g'), '(?i)(^|[^A-Za-z0-9_])in order to([^A-Za-z0-9_]|$)', '\\1to\\2', 'g'), '\\s{{2,}}', ' ', 'g')) AS short FROM t),
r AS (SELECT st, CASE WHEN g IS NOT NULL AND l IS NOT NULL THEN l || ' ' || regexp_extract(trim(text), {q(wording.LINKED)}, 4) || ' by ' || g || ' ' || regexp_replace(regexp_extract(trim(text), {q(wording.LINKED)}, 2), ',+$', '') || '.' END AS front_loaded,
  CASE WHEN short <> trim(text) AND length(short) > 20 THEN short END AS trimmed FROM s)
SELECT * FROM r WHERE front_loaded IS NOT NULL OR trimmed IS NOT NULL""",
    "bullet_grades": _ALL + "SELECT st, has_action, has_specific, has_metric, has_outcome, n_vague, grade FROM graded",
    "bullet_specificity": _ALL + """, c AS (SELECT owner, avg(has_specific::INT::DOUBLE) AS s, count(*) FILTER (n_vague > 0) AS n_vague FROM graded GROUP BY owner)
SELECT owner, round(s, 6) AS share, n_vague, round(greatest(0, 15 * s - least(4, 0.6::DOUBLE * n_vague)), 6) AS score FROM c""",
    "bullet_clarity": _B + f"SELECT owner, round(greatest(0, 15 - sum({_P})), 6) AS score, count(*) AS n FROM b GROUP BY owner",
    "bullet_fixes": _ALL + f""", f AS (
  SELECT owner, st, 'no action' AS title, 2.5::DOUBLE AS points FROM graded WHERE NOT has_action UNION ALL SELECT owner, st, 'vague', round(1.2::DOUBLE + 0.8::DOUBLE * n_vague, 2) FROM graded WHERE n_vague > 0
  UNION ALL SELECT owner, st, 'long', 5 FROM graded WHERE {_WORDS.format("text")} > 34),
o AS (SELECT *, row_number() OVER (PARTITION BY owner, st ORDER BY points DESC, title) AS n FROM f),
r AS (SELECT owner, st, title, points, row_number() OVER (PARTITION BY owner ORDER BY points DESC, st) AS rank FROM o WHERE n = 1)
SELECT owner, st, title, points, CASE WHEN points >= 5 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS severity, rank FROM r WHERE rank <= 5""",
    "person_scores": """
WITH l AS (SELECT l_orderkey, count(*) AS lines, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1),
o AS (SELECT o_custkey, count(*) AS posts, sum(coalesce(lines, 0)) AS lines, max(coalesce(flags, 0)) AS flags FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1),
p AS (SELECT c_custkey AS k, posts, coalesce(lines, 0) AS lines, coalesce(flags, 0) AS flags, coalesce(lines, 0) // 20 AS pages, lines / posts AS per FROM customer LEFT JOIN o ON o_custkey = c_custkey),
s AS (
  SELECT k, round(15 * (0.6::DOUBLE * (0.7::DOUBLE * ((posts IS NOT NULL)::INT + (k % 3 <> 0)::INT + (k % 4 <> 0)::INT) / 3 + 0.3::DOUBLE * ((k % 5 <> 0)::INT + (k % 7 = 0)::INT) / 2)
    + 0.4::DOUBLE * CASE WHEN pages <= 0 THEN 0.8 WHEN pages = 1 THEN 1 WHEN pages = 2 THEN 0.9 WHEN pages = 3 THEN 0.6 ELSE 0.3 END::DOUBLE), 6) AS balance,
    round(10 * (0.4::DOUBLE * CASE WHEN per IS NULL OR per < 2 THEN 0.3 WHEN per > 8 THEN 0.5 WHEN per BETWEEN 3 AND 6 THEN 1 ELSE 0.7 END::DOUBLE + 0.3::DOUBLE * CASE WHEN flags >= 2 AND lines > 5 THEN 1 WHEN flags >= 1 THEN 0.7 ELSE 0.3 END::DOUBLE
    + 0.3::DOUBLE * CASE WHEN k % 400 <= 20 THEN 0.4 WHEN k % 400 <= 300 THEN 1 ELSE 0.6 END::DOUBLE), 6) AS scannability FROM p)
SELECT k AS owner, balance, scannability, round(balance + scannability, 1) AS total, round(100 * (balance + scannability) / 25, 1) AS percent FROM s""",
    "token_kinds": """
SELECT doc_id, len(regexp_extract_all(lower(t), '[a-z][a-z0-9+#.-]{2,}'))::BIGINT AS evidence, len(regexp_extract_all(t, '[A-Za-z0-9_]+'))::BIGINT AS words, len(regexp_extract_all(lower(t), '[a-z]{4,}'))::BIGINT AS long_words,
  len(regexp_extract_all(t, '[@A-Za-z0-9][A-Za-z0-9_./@-]*'))::BIGINT AS manifest, len(list_distinct(regexp_extract_all(lower(t), '[a-z0-9_]{3,}')))::BIGINT AS threes,
  md5(array_to_string(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')[1:350], ' ')) AS head FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "split_overlap": """
WITH h AS (SELECT md5(doc_id::VARCHAR) AS m, md5(coalesce(text, '')) AS h FROM documents),
n AS (SELECT h, ((('0x' || left(m, 16))::UBIGINT % 100) * 16 + ('0x' || right(m, 16))::UBIGINT % 100) % 100 AS p FROM h),
s AS (SELECT DISTINCT CASE WHEN p < 5 THEN 'test' WHEN p < 10 THEN 'val' ELSE 'train' END AS split, h FROM n)
SELECT split, count(*) AS n_texts, count(*) FILTER (h NOT IN (SELECT h FROM s WHERE split = 'train')) AS n_unseen FROM s GROUP BY split""",
    "faithful_rewrites": f"WITH s AS ({_BULLETS.format(part='part')}),{_PERTURBED}, b AS (SELECT st, '' AS kind, text FROM s UNION ALL SELECT st, kind, rewrite FROM gated WHERE accepted AND {_WORDS.format('rewrite')} BETWEEN 8 AND 40)"
    + _CHAIN + "SELECT a.kind, count(*) AS n, count(*) FILTER (a.grade < o.grade) AS n_better FROM graded a JOIN graded o ON o.st = a.st AND o.kind = '' WHERE a.kind <> '' AND a.grade <= o.grade GROUP BY a.kind",
    "agreeing_labels": "SELECT quality::INT AS verdict, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE quality = (n_chars >= 500)::INT GROUP BY 1",
    "sentence_spans": f"""
WITH p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])(\\s+)([A-Z(])', '\\1\\2' || chr(2) || '\\3', 'g'), {q(statements.ABBREVIATIONS)}, '\\1\\2.\\3', 'g'), chr(2)) AS p FROM documents),
u AS (SELECT doc_id, unnest(p) AS part, unnest(range(0, len(p))) AS i FROM p)
SELECT doc_id, i, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length(regexp_replace(part, '\\s+$', ''))::BIGINT AS length FROM u""",
    "sentence_kinds": _B + f""", j AS (SELECT owner, string_agg(text, ' • ' ORDER BY st) AS text FROM b GROUP BY owner),
p AS (SELECT owner, unnest(regexp_split_to_array(regexp_replace(regexp_replace(text, {q(statements.GLYPHS)}, '. ', 'g'), '([.!?;])\\s+([A-Z])', '\\1' || chr(2) || '\\2', 'g'), chr(2) || '|\\s{{2,}}')) AS part FROM j),
s AS (SELECT owner, regexp_replace(regexp_replace(part, '\\s+', ' ', 'g'), '^[ .;]+|[ .;]+$', '', 'g') AS t FROM p),
k AS (SELECT *, len(regexp_extract_all(t, '[^\\s]+')) AS n FROM s WHERE t <> '')
SELECT owner, count(*) AS n, count(*) FILTER (n BETWEEN 6 AND 45 AND regexp_matches(t, {q(statements.BULLET_START)}) AND NOT regexp_matches(t, '(?i)@|https?://|(^|[^A-Za-z0-9_])phone([^A-Za-z0-9_]|$)')) AS n_bullets,
  count(*) FILTER (n BETWEEN 4 AND 40 AND regexp_matches(t, {q(statements.REQUIREMENT)})) AS n_requirements, max(length(t)) AS longest FROM k GROUP BY owner""",
    "capped_events": "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR), event_id) AS r FROM events) WHERE r <= CASE event_type WHEN 'click' THEN 40 WHEN 'view' THEN 25 WHEN 'purchase' THEN 10 ELSE 0 END",
}
