"""Queries on what answers say beyond what was asked, and on documents matched with passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions.text import text_of
from papyrine.operators import dimensions, grounding
from papyrine.plans import retrieval_queries
from papyrine.plans.grading_queries import _numbers, q
from papyrine.storage import materialize
from papyrine.tables import table

#: Frequent words of the given texts, standing for names that are everyday words as well.
_EVERYDAY = ["thation", "stion", "thering", "ereing"]


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long words of passages as names of things; with the word after it, a name of two words."""
    words = table(spark, sf_dir, "benchmark").select(F.split(grounding.normal(F.col("text")), " ").alias("w"))
    single = words.select(F.explode("w").alias("x")).filter(F.length("x") >= 7).select(F.col("x").alias("phrase"), F.initcap("x").alias("canonical"))
    double = words.select(F.explode(grounding.phrases(F.array_join("w", " "), 2)).alias("x")).filter("length(x) >= 14 and x like '% %'").select(F.col("x").alias("phrase"), F.col("x").alias("canonical"))
    cut = single.filter("length(phrase) >= 9").select(F.substring("phrase", 1, 8).alias("phrase"), "canonical")
    return single.unionByName(double).unionByName(cut).distinct()


def _generals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("canonical", F.substring(F.lower("canonical"), 1, 5).alias("general")).distinct()


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What assistants said in a conversation against all that others said."""
    turns = table(spark, sf_dir, "conversations")

    def joined(condition: str):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.expr(condition), F.struct("turn", "role", "text")))), lambda x: text_of(x["text"])), "\n")

    return turns.groupBy("conv_id").agg(joined("role = 'assistant'").alias("rewrite"), joined("role <> 'assistant'").alias("ground"))


def key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grounding.key_terms(_said(spark, sf_dir), "conv_id", "rewrite", _names(spark, sf_dir), _EVERYDAY)
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_terms"), F.array_join(F.array_sort(F.collect_set("term")), " ").alias("terms"))


def validated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = materialize(_names(spark, sf_dir), "grounding-names")
    return grounding.validated(materialize(_said(spark, sf_dir), "grounding-said"), "conv_id", names, _generals(spark, sf_dir), _EVERYDAY, partners=24)


def number_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(grounding.number_strings(F.col("text")), " ").alias("numbers"))
    return docs.filter("numbers <> ''")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage with its three best documents. Lines are entries, every third a project, the first the education; words of even length are required."""
    best = retrieval_queries.bm25_search(spark, sf_dir).select(F.col("chunk_id").alias("left"), F.col("query_id").alias("right"))
    lines = F.filter(F.split(text_of(F.col("text")), "\n"), lambda x: F.trim(x) != "")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("left"), text_of(F.col("text")).alias("text"), lines.alias("l"))
    parts = F.filter(F.transform(F.split("text", "[.;,]"), lambda x: F.trim(x)), lambda x: x != "")
    posts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("right"), F.col("text").alias("post"), parts.alias("p"), dimensions.word_set(F.col("text"), 4).alias("s"))
    rows = best.join(docs, "left").join(posts, "right")
    return rows.select(
        "left", "right", "text", F.filter("l", lambda x, i: i % 3 != 2).alias("entries"), F.filter("l", lambda x, i: i % 3 == 2).alias("projects"), F.get("l", F.lit(0)).alias("education"), F.col("p").alias("requirements"), "post",
        F.filter("s", lambda x: F.length(x) % 2 == 0).alias("required"), F.filter("s", lambda x: F.length(x) % 2 == 1).alias("preferred"), F.filter("p", lambda x, i: i % 2 == 1).alias("responsibilities"), F.filter("p", lambda x, i: i == 2).alias("education_requirements"),
    )


QUERIES = {
    "key_terms": key_terms,
    "validated_answers": validated_answers,
    "number_strings": number_strings,
    "match_dimensions": lambda s, d: dimensions.dimension_scores(_pairs(s, d), "left", "right"),
    "match_totals": lambda s, d: dimensions.totals(dimensions.dimension_scores(_pairs(s, d), "left", "right"), "left", "right"),
}


def _normal(text: str) -> str:
    return f"array_to_string(regexp_extract_all(lower({text}), '[a-z0-9_+#]+'), ' ')"


_EVERY = ", ".join(map(q, _EVERYDAY))
_TERMS = rf"""
WITH bw AS (SELECT string_split({_normal("text")}, ' ') AS w FROM benchmark),
single AS (SELECT DISTINCT x AS phrase, upper(left(x, 1)) || substring(x, 2) AS canonical FROM (SELECT unnest(w) AS x FROM bw) WHERE length(x) >= 7),
pairs2 AS (SELECT DISTINCT x AS phrase, x AS canonical FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM bw) WHERE length(x) >= 14),
names AS (SELECT * FROM single UNION SELECT * FROM pairs2 UNION SELECT left(phrase, 8), canonical FROM single WHERE length(phrase) >= 9),
generals AS (SELECT DISTINCT canonical, left(lower(canonical), 5) AS general FROM names),
said AS (
  SELECT conv_id, coalesce(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS rewrite,
    coalesce(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, role, text) FILTER (role <> 'assistant'), '') AS ground FROM conversations GROUP BY conv_id),
raw AS (
  SELECT DISTINCT conv_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(rewrite, '^(\s*)([A-Za-z])', '\1' || chr(1) || '\2'), {q(grounding.AFTER_BREAK)}, '\1' || chr(1) || '\2', 'g'),
    chr(1) || '?(?:[A-Za-z][A-Za-z0-9_+#./-]*[A-Za-z0-9_+#]|[A-Za-z])')) AS t FROM said),
toks AS (SELECT conv_id, replace(t, chr(1), '') AS term, starts_with(t, chr(1)) AS first, {_normal("replace(t, chr(1), '')")} AS phrase FROM raw),
runs AS (SELECT conv_id, side, string_split(n, ' ') AS w FROM (SELECT conv_id, 'r' AS side, {_normal("rewrite")} AS n FROM said UNION ALL SELECT conv_id, 'g', {_normal("ground")} FROM said)),
grams AS (SELECT DISTINCT conv_id, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS phrase FROM runs),
mentioned AS (SELECT DISTINCT conv_id, side, canonical FROM grams JOIN names USING (phrase)),
terms AS (
  SELECT DISTINCT conv_id, term, phrase FROM toks
  WHERE regexp_matches(term, '[A-Z].*[A-Z]|[0-9]') OR substring(term, 2) <> lower(substring(term, 2)) OR (regexp_matches(term, '^[A-Z]') AND NOT first)
    OR (phrase IN (SELECT phrase FROM names) AND length(term) > 2 AND lower(term) NOT IN ({_EVERY}))
  UNION SELECT conv_id, canonical, canonical FROM mentioned WHERE side = 'r' AND contains(canonical, ' '))
"""
_SAME = "abs(n - g) <= greatest(1e-9::DOUBLE, 1e-6::DOUBLE * greatest(abs(n), abs(g)))"
_VALID = _TERMS + rf""",
found AS (SELECT conv_id, {_numbers("rewrite")} AS s, {_numbers("ground")} AS v, ' ' || {_normal("ground")} || ' ' AS g FROM said),
rest AS (SELECT conv_id, s, v, list_filter(s, lambda n: len(list_filter(v, lambda g: {_SAME})) = 0) AS new, list_filter(v, lambda g: g > 0)[1:24] AS top FROM found),
made AS (
  SELECT conv_id, len(new) AS n_new, len(list_filter(new, lambda n: len(list_filter(top, lambda a: len(list_filter(top, lambda b: a > b AND (abs(round((a - b) / a * 100) - n) <= 1
    OR abs((a - b) / a * 100 - n) <= 0.5 OR abs(a / b - n) <= 0.15::DOUBLE OR abs(round(a / b) - n) < 1e-9::DOUBLE))) > 0)) > 0)) AS n_derived FROM rest),
general AS (SELECT DISTINCT conv_id, general AS phrase FROM mentioned JOIN generals USING (canonical) WHERE side = 'g'),
alias AS (SELECT DISTINCT t.conv_id, t.term FROM terms t JOIN names n ON n.phrase = t.phrase JOIN mentioned m ON m.conv_id = t.conv_id AND m.side = 'g' AND m.canonical = n.canonical),
figures AS (
  SELECT t.conv_id, term, t.phrase, f.g, f.v, {_numbers("regexp_replace(term, '[A-Za-z]', ' ', 'g')")} AS inside, CASE WHEN regexp_replace(term, '[0-9.-]+', '', 'g') = '' THEN term ELSE regexp_replace(term, '[0-9.-]+', '', 'g') END AS bare
  FROM terms t JOIN found f USING (conv_id)),
judged AS (
  SELECT f.conv_id, f.term, CASE WHEN f.phrase <> '' AND contains(f.g, ' ' || f.phrase || ' ') THEN 'literal' WHEN a.term IS NOT NULL THEN 'alias' WHEN e.phrase IS NOT NULL THEN 'general'
    WHEN regexp_matches(f.term, '[0-9]') AND len(inside) > 0 AND len(list_filter(inside, lambda n: len(list_filter(f.v, lambda g: {_SAME})) = 0)) = 0 AND {_normal("bare")} <> '' AND contains(f.g, ' ' || {_normal("bare")} || ' ') THEN 'figures' ELSE 'none' END AS how
  FROM figures f LEFT JOIN alias a ON a.conv_id = f.conv_id AND a.term = f.term LEFT JOIN general e ON e.conv_id = f.conv_id AND e.phrase = f.phrase),
counted AS (
  SELECT conv_id, count(*) AS n_terms, count(*) FILTER (how = 'literal') AS n_literal, count(*) FILTER (how = 'alias') AS n_alias, count(*) FILTER (how = 'general') AS n_general,
    coalesce(string_agg(term, ' ' ORDER BY term) FILTER (how = 'none'), '') AS bad_terms FROM judged GROUP BY conv_id)
SELECT m.conv_id, coalesce(n_terms, 0) AS n_terms, coalesce(n_literal, 0) AS n_literal, coalesce(n_alias, 0) AS n_alias, coalesce(n_general, 0) AS n_general, coalesce(bad_terms, '') AS bad_terms,
  n_new - n_derived AS n_bad_numbers, n_derived, n_new = n_derived AND coalesce(bad_terms, '') = '' AS valid FROM made m LEFT JOIN counted USING (conv_id)"""
_W3, _W4 = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9_]{{3,}}'))", "list_distinct(regexp_extract_all(lower({}), '[a-z0-9_]{{4,}}'))"
_CONF = """CASE WHEN list_contains(owned, s) THEN 10 WHEN length(s) >= 6 AND len(list_filter(owned, lambda o: length(o) >= 6 AND left(o, 5) = left(s, 5))) > 0 THEN 6
  WHEN len(list_filter(owned, lambda o: contains(o, s) OR contains(s, o))) > 0 THEN 4 ELSE 0 END"""
_DIMENSIONS = retrieval_queries._BM25.rstrip() + f""", l AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS l, {_W4.format("coalesce(text, '')")} AS owned FROM documents),
b AS (SELECT item_id, text AS post, list_filter(list_transform(regexp_split_to_array(text, '[.;,]'), lambda x: trim(x)), lambda x: x <> '') AS p, {_W4.format("text")} AS s FROM benchmark),
c AS (
  SELECT chunk_id AS "left", query_id AS "right", text, owned, post, p, s, list_filter(l, lambda x, i: i % 3 <> 0) AS entries, list_filter(l, lambda x, i: i % 3 = 0) AS projects, lower(coalesce(l[1], '')) AS edu,
    list_filter(s, lambda x: length(x) % 2 = 0) AS required, list_filter(s, lambda x: length(x) % 2 = 1) AS preferred, list_filter(p, lambda x, i: i % 2 = 0) AS duties, list_filter(p, lambda x, i: i = 3) AS er,
    list_distinct(flatten(list_transform(p, lambda r: {_W3.format("r")}))) AS kw
  FROM ranked JOIN l ON doc_id = chunk_id JOIN b ON item_id = query_id WHERE rank <= 3),
d AS (
  SELECT *, lower(array_to_string(entries, ' ')) AS said, CASE WHEN len(required) > 0 THEN list_sum(list_transform(required, lambda s: {_CONF})) / (10 * len(required)) END AS x1,
    CASE WHEN len(preferred) > 0 THEN list_sum(list_transform(preferred, lambda s: {_CONF})) / (10 * len(preferred)) END AS x2,
    CASE WHEN len(entries) > 0 THEN least(1, 2 * list_sum(list_transform(entries, lambda e: len(list_intersect({_W3.format("e")}, kw)) / greatest(len(kw), 1))) / len(entries)) ELSE 0 END AS x3,
    CASE WHEN len(projects) > 0 THEN least(1, 1.5 * len(list_filter(projects, lambda e: len(list_intersect({_W3.format("e")}, s)) > 0)) / len(projects)) ELSE 0 END AS x4 FROM c),
e AS (
  SELECT *, CASE WHEN len(duties) > 0 THEN len(list_filter(duties, lambda u: len(list_filter({_W4.format("u")}, lambda w: contains(said, w))) >= 0.3::DOUBLE * len({_W4.format("u")}))) / len(duties) END AS x5,
    CASE WHEN len(er) > 0 THEN CASE WHEN edu = '' THEN 0 ELSE len(list_filter(er, lambda u: len(list_filter({_W4.format("u")}, lambda w: contains(edu, w))) > 0)) / len(er) END END AS x6,
    CASE WHEN trim(post) <> '' THEN coalesce(least(1, 5 * len(list_intersect(owned, s)) / nullif(len(list_distinct(list_concat(owned, s))), 0)), 0) END AS x7 FROM d),
f AS (SELECT "left", "right", """ + ", ".join(f"round({w} * x{i}::DOUBLE, 1) AS {k}" for i, (k, w) in enumerate(dimensions.WEIGHTS.items(), 1)) + " FROM e)\n"
SQL = {
    "key_terms": _TERMS + "SELECT conv_id, count(*) AS n_terms, string_agg(DISTINCT term, ' ' ORDER BY term) AS terms FROM terms GROUP BY conv_id",
    "validated_answers": _VALID,
    "number_strings": f"SELECT doc_id, array_to_string(list_transform(v, lambda x: regexp_replace(printf('%.6f', x), '\\.?0+$', '')), ' ') AS numbers FROM (SELECT doc_id, {_numbers('coalesce(text, chr(32))')} AS v FROM documents) WHERE len(v) > 0",
    "match_dimensions": _DIMENSIONS + "SELECT * FROM f",
    "match_totals": _DIMENSIONS + 'SELECT "left", "right", coalesce(round(100 * (' + " + ".join(f"coalesce({k}, 0)" for k in dimensions.WEIGHTS) + ") / nullif(" + " + ".join(f"CASE WHEN {k} IS NOT NULL THEN {v} ELSE 0 END" for k, v in dimensions.WEIGHTS.items()) + ", 0), 1), 0) AS total FROM f",
}
