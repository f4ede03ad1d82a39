"""Queries on statements, lines, answers and numbers of documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions.text import text_of
from papyrine.operators import facts, layout, postings, statements
from papyrine.tables import table

S = statements


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.statements(table(spark, sf_dir, "documents"), "doc_id", "lang", "source")


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.graded(_statements(spark, sf_dir))


def _section():
    """The kind of section that a document's statements count as, from its language."""
    return F.when(F.col("lang") == "en", "experience").when(F.col("lang") == "fr", "projects").when(F.col("lang") == "de", "leadership").otherwise("volunteer")


_WEAK = S.whole(r"responsible for|helped|assisted|worked on|involved in|participated in|was part of|tasked with|familiar with|exposure to|various|etc|several|some|many|a lot of|stuff|things")


def statement_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _graded(spark, sf_dir)
    return rows.select("doc_id", "st", "has_action", "has_specific", "has_metric", "has_outcome", "n_vague", "grade")


def missed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best statements of each source: grade, then document and place."""
    from papyrine.operators.evaluation import at_most

    rows = _graded(spark, sf_dir).filter("grade in ('A', 'B', 'C')")
    return at_most(rows, ["source"], ["grade", "doc_id", "st"], 5).select("source", "doc_id", "st", "grade", "rank")


def answer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", "text")
    return postings.answer_scores(turns, "conv_id", "turn")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(table(spark, sf_dir, "documents"))


def lines(docs: DataFrame) -> DataFrame:
    """Documents' lines on pages of 50, with sizes, boldness and roles that follow from place and length."""
    lines = docs.select("doc_id", F.posexplode(F.split(text_of(F.col("text")), "\n")).alias("line", "text")).withColumn("line", F.col("line").cast("long")).filter(F.btrim("text") != "")
    head = layout.is_heading(F.col("text"))
    return lines.select(
        "doc_id", "line", "text", F.floor(F.col("line") / 50).alias("page"), (36.0 + 18 * (F.length("text") % 4)).alias("x0"), (36.0 + 14 * (F.col("line") % 50)).alias("y0"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"),
        F.when(F.col("line") == 0, 14.0).when(head, 12.0).otherwise(10.0 + 0.5 * (F.length("text") % 2)).alias("size"), F.when(head, 1.0).otherwise(0.0).alias("bold"), F.when(F.col("line") == 0, "title").when(head, "heading").otherwise("statement").alias("role"),
        F.when((F.col("line") > 0) & ~head, F.floor(F.col("line") / 3)).alias("statement"), (F.col("line") % 3).alias("place"),
    )


def line_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.attention(_lines(spark, sf_dir))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.col("seen").cast("long")).alias("n_seen"), F.sum((F.col("hot") > 0).cast("long")).alias("n_read"))


def section_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.sections(_lines(spark, sf_dir))
    return rows.groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of assistant turns against all that was said in the turns of users."""
    turns = table(spark, sf_dir, "conversations")
    said = turns.filter("role = 'assistant'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("answer"))
    asked = turns.filter("role = 'user'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("question"))
    return facts.check_numbers(said.join(asked, "conv_id", "left"), "answer", "question", partners=24).select("conv_id", "n_numbers", "n_grounded", "n_derived", "n_unsupported")


def document_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", facts.numbers(F.col("text")).alias("v"))
    return rows.select("doc_id", F.size("v").cast("long").alias("n_numbers"), F.round(F.coalesce(F.array_max("v"), F.lit(0.0)), 2).alias("largest"))


QUERIES = {
    "statement_grades": statement_grades,
    "grade_crosstab": lambda s, d: S.grade_crosstab(_graded(s, d), "lang"),
    "weighted_impact": lambda s, d: S.weighted_impact(_graded(s, d), "source", _section()),
    "quantified_share": lambda s, d: S.quantified_share(_graded(s, d), "source"),
    "bullet_quality": lambda s, d: S.bullet_quality(_statements(s, d), "doc_id", _WEAK),
    "quantification": lambda s, d: S.quantification(_statements(s, d), "doc_id"),
    "punctuation_consistency": lambda s, d: S.punctuation_consistency(_statements(s, d), "source"),
    "missed_evidence": missed_evidence,
    "answer_labels": answer_labels,
    "body_size": lambda s, d: layout.body_size(_lines(s, d)),
    "section_sizes": section_sizes,
    "line_attention": line_attention,
    "grounded_answers": grounded_answers,
    "document_numbers": document_numbers,
}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_VERBS, _IRREGULAR, _NOT = (", ".join(map(q, x)) for x in (S.PRESENT_FORMS, S.IRREGULAR, S.NOT_ACTIONS))


def _action(w: str) -> str:
    forms = ", ".join(f"CASE WHEN {w} LIKE '%{end}' THEN regexp_replace({w}, '{end}$', '{instead}') END" for end, instead in S.ENDINGS)
    doubled = f"CASE WHEN {w} LIKE '%ed' AND length({w}) > 5 AND {w}[-3] = {w}[-4] THEN left({w}, length({w}) - 3) END"
    return f"(({w} LIKE '%ed' AND length({w}) > 4 AND {w} NOT IN ({_NOT})) OR {w} IN ({_IRREGULAR}) OR len(list_intersect([{w}, {forms}, {doubled}], [{_VERBS}])) > 0)"


_STATEMENTS = r"""
WITH cut AS (
  SELECT doc_id, lang, source, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ ]+([A-Z(])', '\1' || chr(10) || '\2', 'g'), chr(10)) AS parts FROM documents),
numbered AS (SELECT doc_id, lang, source, unnest(parts) AS raw, unnest(range(0, len(parts))) AS st FROM cut),
statements AS (SELECT doc_id, lang, source, st, trim(raw, ' ' || chr(9) || chr(13)) AS text FROM numbered WHERE trim(raw, ' ' || chr(9) || chr(13)) <> '')
"""
_GRADED = _STATEMENTS + f""", tokens AS (SELECT *, regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_.+#%-]*') AS t FROM statements),
opened AS (
  SELECT *, CASE WHEN lower(coalesce(t[1], '')) LIKE '%ly' AND len(t) > 1 THEN lower(t[2]) ELSE lower(coalesce(t[1], '')) END AS w,
    regexp_matches(text, {q(S.METRIC)}) AS has_metric, regexp_matches(text, {q(S.WEAK_OPENERS)}) AS weak, len(regexp_extract_all(text, {q(S.VAGUE)}))::BIGINT AS n_vague FROM tokens),
flagged AS (
  SELECT *, NOT weak AND {_action("w")} AS has_action, has_metric OR regexp_matches(text, {q(S.OUTCOME)}) AS has_outcome,
    has_metric OR len(list_filter(t[2:], lambda x: regexp_matches(x, '^[A-Z][A-Za-z0-9_.+#%-]{{2,}}$|^[A-Za-z]+[0-9]+'))) > 0 AS has_specific FROM opened),
leveled AS (
  SELECT *, CASE WHEN has_action AND has_specific AND has_metric THEN 0 WHEN has_action AND (has_metric OR (has_outcome AND has_specific)) THEN 1
    WHEN has_action AND (has_specific OR has_outcome) THEN 2 ELSE 3 END AS l FROM flagged),
graded AS (SELECT *, chr(65 + CASE WHEN n_vague >= 3 AND l <= 1 THEN l + 1 ELSE l END) AS grade FROM leveled)
"""
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), {q(p)}) THEN {q(k)}" for k, p in postings.KINDS) + " ELSE 'required' END"
_HEADER = "CASE WHEN length(text) < 60 THEN CASE " + " ".join(f"WHEN contains(lower(text), {q(w)}) THEN {q(k)}" for k, w in postings.HEADERS) + " END END"
_HEAD = r"(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) BETWEEN 1 AND 7 AND length(text) <= 60 AND NOT regexp_matches(text, '@|[0-9]{3}|^[ ]*[-*•]|\.$'))"
_LINES = f"""
WITH raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents),
lines AS (
  SELECT *, line // 50 AS page, 36.0::DOUBLE + 18 * (length(text) % 4) AS x0, 36.0::DOUBLE + 14 * (line % 50) AS y0, {_HEAD} AS head,
    CASE WHEN line = 0 THEN 14.0::DOUBLE WHEN {_HEAD} THEN 12.0::DOUBLE ELSE 10.0::DOUBLE + 0.5::DOUBLE * (length(text) % 2) END AS size
  FROM raw WHERE trim(text) <> '')
"""
_CUE = ", ".join(f"list_filter(s, lambda x: regexp_matches(x, {q(c)}))[1] AS {k}_hit" for k, c in postings.CUES.items())
_SCORE = ", ".join(f"CASE WHEN {k}_hit IS NULL THEN 0 {'WHEN regexp_matches(' + k + '_hit, ' + q('[0-9]') + ') THEN 8' if k in ('action', 'result') else ''} ELSE 6 END::BIGINT AS {k}" for k in postings.CUES)


def _numbers(text: str) -> str:
    words = "map {" + ", ".join(f"'{k}': {float(v)}::DOUBLE" for k, v in facts.NUMBER_WORDS.items()) + "}"
    units = "map {" + ", ".join(f"'{k}': {v:.1f}::DOUBLE" for k, v in facts.SUFFIXES.items()) + "}"
    digits = f"list_transform(list_zip(regexp_extract_all({text}, {q(facts.NUMBER)}, 2), regexp_extract_all({text}, {q(facts.NUMBER)}, 6)), lambda p: round(replace(p[1], ',', '')::DOUBLE * coalesce({units}[lower(p[2])], 1), 6))"
    named = f"list_filter(list_transform(regexp_extract_all({text}, '[A-Za-z]+'), lambda w: {words}[lower(w)]), lambda x: x IS NOT NULL)"
    return f"list_sort(list_distinct(list_concat({digits}, {named})))"


SQL = {
    "statement_grades": _GRADED + "SELECT doc_id, st, has_action, has_specific, has_metric, has_outcome, n_vague, grade FROM graded",
    "grade_crosstab": _GRADED + "SELECT lang, " + ", ".join(f"count(*) FILTER (grade = '{g}') AS grade_{g.lower()}" for g in S.GRADE_VALUES) + " FROM graded GROUP BY lang",
    "weighted_impact": _GRADED + """, weighed AS (
  SELECT source, CASE grade WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.75 WHEN 'C' THEN 0.45 ELSE 0.15 END::DOUBLE AS v,
    CASE lang WHEN 'en' THEN 1.6 WHEN 'fr' THEN 1.0 WHEN 'de' THEN 0.6 ELSE 0.4 END::DOUBLE AS w FROM graded)
SELECT source, count(*) AS n, round(20 * sum(w * v) / sum(w), 6) AS impact FROM weighed GROUP BY source""",
    "quantified_share": _GRADED + """SELECT source, count(*) FILTER (green) AS green, count(*) FILTER (has_action AND NOT green) AS amber, round(100 * avg(green::INT::DOUBLE), 6) AS viq
FROM (SELECT *, has_action AND has_specific AND has_metric AND has_outcome AS green FROM graded) GROUP BY source""",
    "bullet_quality": _STATEMENTS + f"""SELECT doc_id, count(*) AS n, round(25 * (0.4::DOUBLE * avg({_action("w")}::INT::DOUBLE) + 0.3::DOUBLE * avg((length(text) BETWEEN 40 AND 200)::INT::DOUBLE)
  + 0.3::DOUBLE * avg((NOT regexp_matches(text, {q(_WEAK)}))::INT::DOUBLE)), 6) AS score FROM (SELECT *, lower(regexp_extract(text, '^([A-Za-z]+)', 1)) AS w FROM statements) GROUP BY doc_id""",
    "quantification": _STATEMENTS + f"""SELECT doc_id, round(s, 6) AS share, round(CASE WHEN s >= 0.5 THEN 20 WHEN s >= 0.3 THEN 14 + 6 * (s - 0.3::DOUBLE) / 0.2::DOUBLE ELSE 14 * s / 0.3::DOUBLE END, 6) AS score
FROM (SELECT doc_id, avg(regexp_matches(text, {q(S.METRIC)})::INT::DOUBLE) AS s FROM statements GROUP BY doc_id)""",
    "punctuation_consistency": _STATEMENTS + """SELECT source, round(greatest(s, 1 - s), 6) AS dominance FROM (SELECT source, avg((text LIKE '%.')::INT::DOUBLE) AS s FROM statements GROUP BY source)""",
    "missed_evidence": _GRADED + """SELECT source, doc_id, st, grade, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY grade, doc_id, st) AS rank FROM graded WHERE grade IN ('A', 'B', 'C')) WHERE rank <= 5""",
    "posting_kinds": f"""
WITH raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents),
lines AS (SELECT doc_id, line, trim(regexp_replace(raw, '^[ \\t]*[0-9.)+*•▪►→◦⁃-]+', ''), ' ' || chr(9) || chr(13)) AS text FROM raw),
headed AS (SELECT *, {_HEADER} AS header FROM lines WHERE length(text) > 10),
placed AS (SELECT *, coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING), 'none') AS section, {_KIND} AS k FROM headed),
kinds AS (
  SELECT doc_id, section, CASE WHEN k = 'required' AND section = 'preferred' THEN 'preferred' WHEN k = 'required' AND section = 'responsibilities' THEN 'responsibility' ELSE k END AS kind
  FROM placed WHERE header IS NULL)
SELECT section, kind, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM kinds GROUP BY section, kind""",
    "seniority_levels": "SELECT coalesce(CASE " + " ".join(f"WHEN contains(lower(coalesce(text, '')), {q(w)}) THEN {q(v)}" for w, v in postings.SENIORITY) + " END, 'none') AS level, count(*) AS n_docs FROM documents GROUP BY 1",
    "answer_labels": f"""
WITH parts AS (
  SELECT conv_id, turn, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\n]+', '\\1' || chr(10), 'g'), chr(10)) AS s FROM conversations WHERE role = 'assistant'),
hits AS (SELECT conv_id, turn, {_CUE} FROM parts),
scored AS (SELECT conv_id, turn, {_SCORE} FROM hits)
SELECT *, round((situation * 15 + task * 15 + action * 35 + result * 35) / 10.0::DOUBLE, 1) AS total FROM scored""",
    "body_size": _LINES + """, sums AS (SELECT doc_id, round(size * 2) AS h, sum(length(text)) AS n, min(line) AS line FROM lines GROUP BY 1, 2)
SELECT doc_id, h / 2 AS body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, line) AS r FROM sums) WHERE r = 1""",
    "heading_styles": _LINES + "SELECT doc_id, size, true AS is_bold, upper(text) = text AS caps, count(*) AS n FROM lines WHERE head GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2",
    "section_sizes": _LINES + """, placed AS (
  SELECT *, coalesce(last_value(CASE WHEN head THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING), -1) AS section FROM lines)
SELECT doc_id, section, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars FROM placed GROUP BY 1, 2""",
    "line_attention": _LINES + r""", mids AS (
  SELECT doc_id, list_sort(list(round(size * 2) / 2))[count(*) // 2 + 1] AS mid FROM lines GROUP BY doc_id),
weighed AS (
  SELECT l.doc_id, line, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n, CASE WHEN line > 0 AND NOT head THEN line // 3 END AS st,
    CASE WHEN line = 0 OR head THEN 1.0::DOUBLE ELSE 0.55::DOUBLE END * exp(-1.6::DOUBLE * y0 / 792) * pow(0.55::DOUBLE, page)
    * (1 - 0.35::DOUBLE * least(1, greatest(0, x0 / 612 - 0.08::DOUBLE) / 0.5)) * (1 + 0.6::DOUBLE * greatest(0, size / mid - 1)) * (1 + 0.3::DOUBLE * head::INT)
    * CASE WHEN regexp_matches(text, '[0-9]+(\.[0-9]+)?[ ]?%|\$[ ]?[0-9]|(^|[^A-Za-z0-9_])[0-9]{2,}([^A-Za-z0-9_]|$)') THEN 1.15::DOUBLE ELSE 1 END
    * CASE WHEN line % 3 >= 2 THEN 0.6::DOUBLE ELSE 1 END AS w
  FROM lines l JOIN mids USING (doc_id)),
read AS (
  SELECT *, 29.6::DOUBLE * w / sum(w) OVER (PARTITION BY doc_id) AS fix, CASE WHEN st IS NULL THEN 1.0::DOUBLE ELSE greatest(0, least(1,
    (8 - coalesce(sum(n) OVER (PARTITION BY doc_id, st ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / greatest(n, 1)::DOUBLE)) END AS hot FROM weighed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (fix >= 0.6 AND hot > 0) AS n_seen, count(*) FILTER (round(hot, 2) > 0) AS n_read FROM read GROUP BY doc_id""",
    "document_numbers": f"SELECT doc_id, len(v)::BIGINT AS n_numbers, round(coalesce(list_max(v), 0), 2) AS largest FROM (SELECT doc_id, {_numbers('coalesce(text, chr(32))')} AS v FROM documents)",
    "grounded_answers": f"""
WITH said AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS a FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
asked AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS b FROM conversations WHERE role = 'user' GROUP BY conv_id),
found AS (SELECT conv_id, {_numbers("coalesce(a, '')")} AS s, {_numbers("coalesce(b, '')")} AS g FROM said LEFT JOIN asked USING (conv_id)),
said_v AS (SELECT conv_id, unnest(s) AS v FROM found), ground_v AS (SELECT conv_id, unnest(g) AS v FROM found),
same AS (SELECT s.conv_id, s.v, bool_or(g.v IS NOT NULL) AS grounded FROM said_v s LEFT JOIN ground_v g ON g.conv_id = s.conv_id AND abs(s.v - g.v) <= greatest(1e-9::DOUBLE, 1e-6::DOUBLE * greatest(abs(s.v), abs(g.v))) GROUP BY 1, 2),
top AS (SELECT conv_id, v FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY v) AS r FROM ground_v WHERE v > 0) WHERE r <= 24),
made AS (
  SELECT DISTINCT s.conv_id, s.v FROM same s JOIN top x USING (conv_id) JOIN top y ON y.conv_id = s.conv_id AND x.v > y.v
  WHERE NOT grounded AND (abs(round((x.v - y.v) / x.v * 100) - s.v) <= 1 OR abs((x.v - y.v) / x.v * 100 - s.v) <= 0.5 OR abs(x.v / y.v - s.v) <= 0.15::DOUBLE OR abs(round(x.v / y.v) - s.v) < 1e-9::DOUBLE))
SELECT f.conv_id, len(s)::BIGINT AS n_numbers, (SELECT count(*) FROM same x WHERE x.conv_id = f.conv_id AND grounded) AS n_grounded,
  (SELECT count(*) FROM made m WHERE m.conv_id = f.conv_id) AS n_derived,
  len(s)::BIGINT - (SELECT count(*) FROM same x WHERE x.conv_id = f.conv_id AND grounded) - (SELECT count(*) FROM made m WHERE m.conv_id = f.conv_id) AS n_unsupported
FROM found f""",
}
