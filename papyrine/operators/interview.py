"""Practice interviews: a plan of questions from a document's claims, evidence for a question, and scores of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import text_of
from papyrine.operators import facts
from papyrine.operators.postings import PART_WEIGHTS

# Kinds of sections that are asked about, the order of grades, how many claims are kept and asked, how many of
# the others, and what a part scores at most if its quote isn't in the answer.
KINDS = ["experience", "projects", "publications", "leadership"]
GRADES = "ABCD"
KEPT, CLAIMS, REQUIREMENTS, VALUES, UNQUOTED = 8, 3, 2, 2, 3.0
LEAST_NUMBER = 2


def _first(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).filter(F.col("n") <= n).withColumn("n", F.col("n").cast("long"))


def claims(statements: DataFrame, n: int = KEPT) -> DataFrame:
    """doc_id, id, text, n: the strongest claims first, by grade, then those with figures, then their order.

    statements: doc_id, kind, id, ord, text, grade (or null), has_metric.
    """
    rank = F.coalesce(F.nullif(F.instr(F.lit(GRADES), F.coalesce("grade", F.lit("?"))), F.lit(0)), F.lit(len(GRADES) + 1))
    own = statements.filter(F.col("kind").isin(KINDS))
    return _first(own, n, rank, (~F.coalesce("has_metric", F.lit(False))).cast("int"), F.col("ord")).select("doc_id", "id", "text", "n")


def plan(strongest: DataFrame, requirements: DataFrame, values: DataFrame, signals: DataFrame, people: DataFrame) -> DataFrame:
    """doc_id, round, n, probes, why: questions in three rounds, on claims, on requirements, on values.

    strongest: of claims(); requirements, values, signals: doc_id, text, ord; people: doc_id. Culture signals fill the third
    round up to VALUES questions; a round without any has a general one.
    """
    def numbered(rows: DataFrame, number: int, probes: str, why: str) -> DataFrame:
        return rows.select("doc_id", F.lit(number).cast("long").alias("round"), "n", F.col(probes).cast("string").alias("probes"), F.lit(why).alias("why"))

    one = numbered(strongest.filter(F.col("n") <= CLAIMS), 1, "id", "claim")
    two = numbered(_first(requirements, REQUIREMENTS, F.col("ord")), 2, "text", "requirement")
    both = values.select("doc_id", "text", F.lit(0).alias("o"), "ord").unionByName(signals.select("doc_id", "text", F.lit(1).alias("o"), "ord"))
    third = _first(both, VALUES, F.col("o"), F.col("ord"))
    three = third.select("doc_id", F.lit(3).cast("long").alias("round"), "n", F.col("text").cast("string").alias("probes"), F.when(F.col("o") == 0, "value").otherwise("signal").alias("why"))
    rest = people.select("doc_id").join(third.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(3).cast("long").alias("round"), F.lit(1).cast("long").alias("n"), F.lit("general").alias("probes"), F.lit("general").alias("why"))
    return one.unionByName(two).unionByName(three).unionByName(rest)


def evidence(questions: DataFrame, statements: DataFrame, n: int = 4) -> DataFrame:
    """doc_id, question, place, text: the statements of the entry that a question probes, else the n that share most words.

    questions: doc_id, question, probes, text; statements: doc_id, entry, id, ord, text. Words have four letters or more;
    of equals the text that comes later in order is first. Statements without a shared word never stand for one.
    """
    asked = questions.alias("q")
    probed = asked.join(statements.select("doc_id", F.col("id").cast("string").alias("probes"), "entry"), ["doc_id", "probes"]).select("doc_id", "question", "entry")
    whole = probed.join(statements, ["doc_id", "entry"]).select("doc_id", "question", F.row_number().over(Window.partitionBy("doc_id", "question").orderBy("ord")).cast("long").alias("place"), "text")

    def words(rows: DataFrame, *keep: str) -> DataFrame:
        return rows.select(*keep, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_of(F.col("text"))), F.lit("[a-z]{4,}"), F.lit(0)))).alias("word"))

    others = questions.join(probed.select("doc_id", "question").distinct(), ["doc_id", "question"], "left_anti")
    shared = words(others, "doc_id", "question").join(words(statements, "doc_id", "id"), ["doc_id", "word"]).groupBy("doc_id", "question", "id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc_id", "question").orderBy(F.col("n").desc(), F.col("text").desc(), "id")
    best = shared.join(statements.select("doc_id", "id", "text"), ["doc_id", "id"]).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    return whole.unionByName(best.select("doc_id", "question", F.col("place").cast("long").alias("place"), "text"))


def _normal(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text_of(text), r"\s+", " ")))


def final_scores(answers: DataFrame, labels: DataFrame, ground: DataFrame) -> DataFrame:
    """session_id, question_id, overall, unverified (array): answers scored by labelled parts whose quotes are looked for.

    answers: session_id, question_id, answer; labels: session_id, question_id, part, present, quote, score; ground:
    session_id, question_id, text (evidence, any number of rows). A part that is present with a quote that the answer
    doesn't have scores UNQUOTED at most. unverified are the answer's numbers of LEAST_NUMBER or more that no evidence has.
    """
    keys = ["session_id", "question_id"]
    parts = parts_scored(answers, labels)
    weight = F.coalesce(*(F.when(F.col("part") == k, F.lit(v)) for k, v in PART_WEIGHTS.items()), F.lit(0))
    totals = parts.groupBy(*keys).agg(F.round(F.sum(weight * F.col("score")) / 10, 1).alias("overall"))
    known = ground.select(*keys, F.explode(facts.numbers(F.col("text"))).alias("v")).distinct()
    said = answers.select(*keys, F.explode(F.array_distinct(facts.numbers(F.col("answer")))).alias("v")).filter(F.col("v") >= LEAST_NUMBER)
    lost = said.join(known, [*keys, "v"], "left_anti").groupBy(*keys).agg(F.array_sort(F.collect_set("v")).alias("unverified"))
    out = answers.select(*keys).join(totals, keys, "left").join(lost, keys, "left")
    return out.select(*keys, F.coalesce("overall", F.lit(0.0)).alias("overall"), F.coalesce("unverified", F.array().cast("array<double>")).alias("unverified"))


def parts_scored(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """session_id, question_id, part, present, verified, score of labels against their answers."""
    keys = ["session_id", "question_id"]
    rows = labels.join(answers.select(*keys, "answer"), keys)
    score = F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(F.col("score").cast("double"), F.lit(0.0))))
    quote = _normal(F.col("quote"))
    verified = (quote == "") | F.contains(_normal(F.col("answer")), quote)
    rows = rows.withColumns({"_score": score, "verified": verified})
    present = F.coalesce("present", F.lit(False)) & (F.col("_score") > 0)
    return rows.select(*keys, "part", present.alias("present"), "verified", F.when(present & ~F.col("verified"), F.least(F.lit(UNQUOTED), F.col("_score"))).otherwise(F.col("_score")).alias("score"))
