"""Which role a document is for: weighted keyword counts by field, ranked roles by BM25 over fields, and its level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import text_of

# How much a field's words count, and how sure a ranked role is.
FIELD_WEIGHTS = {"summary": 3, "titles": 3, "statements": 2, "skills": 1}
K1, B, SURER, LEAST_SURE, UNKNOWN_SURE = 1.2, 0.75, 1.5, 0.5, 0.75
LONGEST = 3


def _words(column: Column) -> Column:
    return F.regexp_extract_all(F.lower(text_of(column)), F.lit("[a-z0-9_+#]+"), F.lit(0))


def phrases(fields: DataFrame, families: DataFrame) -> DataFrame:
    """doc_id, field, family, n: how often phrases of families stand in fields, as runs of whole words.

    fields: doc_id, field, text; families: family, keyword (of up to LONGEST words). Runs are cut from the texts and joined
    with the keywords, so texts aren't searched once for each keyword.
    """
    keys = families.select("family", F.array_join(_words(F.col("keyword")), " ").alias("phrase")).filter("phrase <> ''").distinct()
    words = fields.select("doc_id", "field", F.explode(_runs(F.col("text"))).alias("phrase"))
    counts = words.join(keys.select("phrase").distinct(), "phrase", "left_semi").groupBy("doc_id", "field", "phrase").agg(F.count("*").alias("n"))
    return counts.join(keys, "phrase").groupBy("doc_id", "field", "family").agg(F.sum("n").alias("n"))


def _runs(text: Column) -> Column:
    """All runs of one to LONGEST words of a text, made from neighbouring arrays rather than slices."""
    def of(words: Column) -> Column:
        runs = [words]
        for k in range(1, LONGEST):
            n = F.greatest(F.size(words) - k, F.lit(0))
            runs.append(F.zip_with(F.slice(runs[-1], F.lit(1), n), F.slice(words, k + 1, n), lambda a, b: F.concat(a, F.lit(" "), b)))
        return F.concat(*runs)

    return F.flatten(F.transform(F.array(_words(text)), of))  # the lambda keeps the words from being looked for again


def role_scores(fields: DataFrame, families: DataFrame) -> DataFrame:
    """doc_id, family, score: counts by the weights of fields; fields that aren't listed (as a raw text) count nothing here."""
    weight = F.coalesce(*(F.when(F.col("field") == k, F.lit(v)) for k, v in FIELD_WEIGHTS.items()), F.lit(0))
    return phrases(fields, families).groupBy("doc_id", "family").agg(F.sum(weight * F.col("n")).alias("score"), F.sum(F.when(F.col("field") == "raw", F.col("n")).otherwise(0)).alias("raw"))


def inferred_roles(docs: DataFrame, fields: DataFrame, families: DataFrame) -> DataFrame:
    """doc_id, family, score, from_raw of each of docs: the family with most, by the raw text if no field has any, else null.

    Of equal families the one with the smaller place counts; families: family, keyword, place.
    """
    places = families.groupBy("family").agg(F.min("place").alias("place"))
    scored = role_scores(fields, families).join(places, "family")
    best = scored.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("place")).alias("p"), "family")).alias("a"), F.max(F.struct("raw", (-F.col("place")).alias("p"), "family")).alias("b"))
    named = best.select("doc_id", F.when(F.col("a.score") > 0, F.col("a.family")).when(F.col("b.raw") > 0, F.col("b.family")).alias("family"), F.greatest("a.score", F.when(F.col("a.score") > 0, 0).otherwise(F.col("b.raw"))).alias("score"), (F.col("a.score") == 0).alias("from_raw"))
    return docs.select("doc_id").join(named, "doc_id", "left").select("doc_id", "family", F.coalesce("score", F.lit(0).cast("long")).alias("score"), F.coalesce("from_raw", F.lit(True)).alias("from_raw"))


def ranked_roles(profiles: DataFrame, roles: DataFrame, weights: dict[str, float], k: int = 3) -> DataFrame:
    """doc_id, role, rank, bm25f, confidence: the k roles whose fields fit a profile best.

    profiles: doc_id, text; roles: role, field, text. Frequencies in fields are divided by the field's length against its
    mean, weighed and summed before they saturate (BM25 over fields). Confidence is SURER times the share of the profile's
    best score, within LEAST_SURE and 1.
    """
    terms = roles.select("role", "field", F.explode(_words(F.col("text"))).alias("term"))
    lengths = terms.groupBy("role", "field").agg(F.count("*").alias("n"))
    means = lengths.groupBy("field").agg(F.avg("n").alias("mean"))
    weight = F.coalesce(*(F.when(F.col("field") == f, F.lit(float(w))) for f, w in weights.items()), F.lit(0.0))
    norm = 1 - B + B * F.col("n") / F.col("mean")
    parts = terms.groupBy("role", "field", "term").agg(F.count("*").alias("tf")).join(lengths, ["role", "field"]).join(means, "field")
    held = parts.groupBy("role", "term").agg(F.sum(weight * F.col("tf") / norm).alias("tf"))
    total = roles.select("role").distinct().agg(F.count("*").alias("roles"))
    df = held.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select("term", F.log(1 + (F.col("roles") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weighed = held.join(df, "term").select("role", "term", (F.col("idf") * F.col("tf") / (K1 + F.col("tf"))).alias("part"))
    asked = profiles.select("doc_id", F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
    scores = asked.join(weighed, "term").groupBy("doc_id", "role").agg(F.round(F.sum("part"), 6).alias("bm25f"))
    order = Window.partitionBy("doc_id").orderBy(F.col("bm25f").desc(), "role")
    best = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    share = F.col("bm25f") / F.max("bm25f").over(Window.partitionBy("doc_id"))
    sure = F.when(share.isNull(), UNKNOWN_SURE).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(LEAST_SURE), SURER * share)))
    return best.select("doc_id", "role", F.col("rank").cast("long").alias("rank"), "bm25f", F.round(sure, 4).alias("confidence"))


def levels(dated: DataFrame, now: int) -> DataFrame:
    """owner, studying, n_posts, level of dated entries (of timelines.dated): entry for who studies or had no post of their own.

    Who studies has education that is present, expected or ends after now; a post in part time is none of their own.
    """
    study = (F.col("section") == "education") & (F.col("present") | F.col("expected") | F.coalesce(F.col("end") > now, F.lit(False)))
    post = (F.col("section") == "experience") & ~F.col("part_time")
    rows = dated.groupBy("owner").agg(F.bool_or(study).alias("studying"), F.sum(post.cast("long")).alias("n_posts"))
    return rows.withColumn("level", F.when(F.col("studying") | (F.col("n_posts") == 0), "entry").otherwise("mid_senior"))
