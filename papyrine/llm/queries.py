"""Queries over the given tables, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import chat, divergence, html_text, lexical_trie, license_scan, mixing, ngram_join, packing, quality_classifier, quality_rules, suffix_tree, topk, toxicity
from papyrine.tables import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = d.doc_id
"""


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10).select("query_id", "rank", "vec_id", "score")


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored) WHERE rank <= 10
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    # The texts aren't needed again, so only what the rules look at is written.
    rows = quality_rules.judged(docs, keep=["doc_id"])
    names = {"_q_n_words": "n_words", "_q_chars": "word_chars", "_q_symbols": "n_symbols", "_q_dup_lines": "n_dup_lines", "_q_repeats": "n_repeat_words", "_q_base": "base_failed", "_q_kept": "kept"}
    return rows.select("row.doc_id", *(F.col(k).alias(v) for k, v in names.items()))


OP3_SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce('.' || lang, '') AS lang, coalesce('.' || source, '') AS source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM split) WHERE regexp_matches(l, '[^ 	-
]') GROUP BY doc_id),
grams AS (SELECT doc_id, i, [w[i], w[i+1], w[i+2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3)),
found AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM found) GROUP BY doc_id),
counts AS (
  SELECT s.doc_id, s.lang, s.source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(l.n_lines, 0)::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN lines l USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    1000 * n_symbols // greatest(word_chars, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
    1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 1000 * word_chars // greatest(n_words, 1) AS word_length
  FROM counts),
flat AS (
  SELECT lang, source, ratio, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 5)) << (length(bin(v)) - 5) END AS b
  FROM (SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) AS ratio,
    unnest([symbols, dup_lines, repeats, word_length]) AS v FROM based WHERE NOT base_failed)),
sketches AS (SELECT lang, source, ratio, b, count(*) AS n FROM flat GROUP BY ALL),
levels AS (
  SELECT lang, source, ratio, b, n, 2 AS level FROM sketches
  UNION ALL SELECT lang, NULL, ratio, b, sum(n), 1 FROM sketches GROUP BY lang, ratio, b
  UNION ALL SELECT NULL, NULL, ratio, b, sum(n), 0 FROM sketches GROUP BY ratio, b),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY b) AS upto, sum(n) OVER (PARTITION BY level, lang, source, ratio) AS seen FROM levels),
quartiles AS (
  SELECT level, lang, source, ratio, min(b) FILTER (4 * upto >= seen) AS q1, min(b) FILTER (4 * upto >= 3 * seen) AS q3, max(seen) AS seen
  FROM ranked GROUP BY level, lang, source, ratio),
chosen AS (
  SELECT g.lang, g.source, g.ratio,
    CASE WHEN g.seen >= 50 THEN g.q1 WHEN l.seen >= 50 THEN l.q1 ELSE a.q1 END AS q1,
    CASE WHEN g.seen >= 50 THEN g.q3 WHEN l.seen >= 50 THEN l.q3 ELSE a.q3 END AS q3
  FROM quartiles g JOIN quartiles l ON l.level = 1 AND l.lang = g.lang AND l.ratio = g.ratio
    JOIN quartiles a ON a.level = 0 AND a.ratio = g.ratio WHERE g.level = 2),
fences AS (
  SELECT lang, source,
    max(q3 + 3 * (q3 - q1) + 30) FILTER (ratio = 'symbols') AS symbols_high,
    max(q3 + 3 * (q3 - q1) + 400) FILTER (ratio = 'dup_lines') AS dup_high,
    max(q3 + 3 * (q3 - q1) + 100) FILTER (ratio = 'repeats') AS repeats_high,
    max(q3 + 3 * (q3 - q1) + 1500) FILTER (ratio = 'word_length') AS length_high,
    max(q1 - 3 * (q3 - q1) - 1500) FILTER (ratio = 'word_length') AS length_low
  FROM chosen GROUP BY lang, source)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(NOT base_failed AND symbols <= symbols_high AND dup_lines <= dup_high AND repeats <= repeats_high
    AND word_length BETWEEN length_low AND length_high, false) AS kept
FROM based b LEFT JOIN fences f USING (lang, source)
"""


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


_NOTICES = ", ".join("({}, '{}', '{}')".format(i, x, n.replace("'", "''")) for i, (x, n) in enumerate(license_scan.TEMPLATES))
_GRAMS = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))"
_SPLIT_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP5_SQL = f"""
WITH notices(template, license, notice) AS (VALUES {_NOTICES}),
known AS (
  SELECT template, license, list_distinct({_GRAMS}) AS grams FROM (SELECT template, license, {_SPLIT_WORDS.format("notice")} AS w FROM notices)),
sized AS (SELECT *, len(grams) AS t, (len(grams) + 3) // 4 AS step FROM known),
texts AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT_WORDS.format("text")} AS w FROM documents),
placed AS (
  SELECT r, doc_id, unnest(range(0, len(w) - 4)) AS p, unnest({_GRAMS}) AS g FROM texts WHERE len(w) >= 5),
wanted AS (SELECT license, template, t, step, unnest(grams) AS g FROM sized),
hits AS (
  SELECT DISTINCT r, doc_id, license, template, t, g,
    unnest(range(CASE WHEN p < t + step THEN 0 ELSE (p - (t + step - 1) + step - 1) // step END, p // step + 1)) AS win
  FROM placed JOIN wanted USING (g)),
held AS (
  SELECT r, doc_id, license, template, t, win, count(*) AS common FROM hits GROUP BY ALL HAVING 100 * count(*) >= 80 * t),
once AS (SELECT r, doc_id, license, t, win, max(common) AS common FROM held GROUP BY ALL)
SELECT doc_id, license, count(*) AS n_windows, max(common)::BIGINT AS n_common FROM once GROUP BY doc_id, license
"""


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS cap, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM sources),
levels AS (
  SELECT *, row_number() OVER r AS level,
    sum(source_size) OVER () - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shares
  FROM weighed WINDOW r AS (ORDER BY cap / w, source NULLS LAST)),
cut AS (SELECT level AS l, rest AS t, shares AS s FROM levels WHERE rest * w <= cap * shares ORDER BY level LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN level < l THEN cap::DOUBLE ELSE (w * t)::DOUBLE / s::DOUBLE END AS target FROM levels, cut),
queued AS (
  SELECT d.*, t.source_size, t.target,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
passed AS (
  SELECT doc_id, size, source, key, pass, (pass * source_size + upto)::DOUBLE / target AS finish
  FROM queued, (SELECT unnest([0, 1, 2]) AS pass) WHERE size > 0),
sent AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, source NULLS FIRST, key, doc_id, size, pass ROWS UNBOUNDED PRECEDING) AS upto FROM passed),
taken AS (SELECT doc_id, sum(size) AS taken FROM sent WHERE upto <= (SELECT sum(size) FROM sized) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken FROM queued q LEFT JOIN taken t USING (doc_id)
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A conversation whose texts hold what other templates use as control strings.
ODD_CONVERSATION = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.createDataFrame(ODD_CONVERSATION, "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    back = chat.read_back(chat.chat_examples(turns))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    trained = F.array_join("replies", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"), "formatted_chars",
    )


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
numbered AS (
  SELECT *, row_number() OVER w AS i, length(role || text) + len(regexp_extract_all(role || text, '[\\<]')) + 20 AS chars,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM numbered)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""


#: The tokenizers file of op9 and the pipeline; executors read it at this path.
TOKENIZER = "word_bpe_49k.json"


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_trie.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = rf"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
totals AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS l FROM words),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
held AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM words)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, totals GROUP BY term, n_docs),
scores AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // l))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term), totals GROUP BY item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0) WHERE rank <= 50
"""


def op12_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
held AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM held GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang) USING (lang)),
counts AS (SELECT lang, source, term, count(*) AS n FROM held JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL) USING (lang, source)),
prices AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (t.n + 5 * l.v) AS p, 1 + (1000000000 * (k.n + 5)) // (l.n + 5 * l.v) AS q
  FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f, 0)::BIGINT AS value FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM prices x JOIN prices y USING (lang, term) GROUP BY ALL) d
    ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM prices WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts) WHERE part = 'pair' OR rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_exact_top_k": op2_exact_top_k,
        "op3_quality_rules": op3_quality_rules,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_license_scan": op5_license_scan,
        "op6_mixing_sources": op6_mixing_sources,
        "op7_toxicity": op7_toxicity,
        "op8_chat_formatting": op8_chat_formatting,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_html_extraction": op10_html_extraction,
        "op11_ranked_search": op11_ranked_search,
        "op12_suffix_tree_scores": op12_suffix_tree_scores,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": OP1_SQL,
        "op2_exact_top_k": OP2_SQL,
        "op3_quality_rules": OP3_SQL,
        "op5_license_scan": OP5_SQL,
        "op6_mixing_sources": OP6_SQL,
        "op8_chat_formatting": OP8_SQL,
        "op11_ranked_search": OP11_SQL,
        "op13_source_divergence": OP13_SQL,
    }
