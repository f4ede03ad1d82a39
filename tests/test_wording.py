"""Pinned phrases of figures, and sections that stand too early."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from papyrine.operators import postings, reports, statements, wording


@pytest.mark.parametrize(
    "text, phrase, position",
    [
        ("Saved $1,200 in costs", "$1,200", 1), ("Raised $5M in funding", "$5M", 1), ("Cut it -> 86% lower latency", "86%", 3), ("Reached 99.5% accuracy", "99.5% accuracy", 1), ("Ran for €3.5k.", "€3.5k", 2),
        ("Served 1,000+ users daily", "1,000+ users", 1), ("Led 12 people.", "12 people", 1), ("Made it 3x faster", "3x faster", 2), ("came top 5 of all", "top 5", 1), ("won 2nd place", "2nd place", 1), ("did it twice", "twice", 2), ("Wrote code", "", None),
    ],
)
def test_phrases(spark, text, phrase, position):
    row = spark.createDataFrame([(text,)], "t string").select(wording.metric_phrase(F.col("t")).alias("p"), wording.metric_position(F.col("t")).alias("n"), F.col("t").rlike(statements.METRIC).alias("m")).first()
    assert tuple(row) == (phrase, position, phrase != "")


def test_whole_patterns(spark):
    said = {"seamlessly done": (True, False), "cutting costs": (False, True), "a lot of it, etc.": (True, False), "many": (True, False), "lowering it": (False, True), "cuttings": (False, False), "employee of the year": (False, True)}
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", F.col("t").rlike(statements.VAGUE), F.col("t").rlike(statements.OUTCOME)).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == said
    cues = {"The issue was old": "situation", "I had to go": "task", "I wrote it": "action", "It reduced 5 %": "result"}
    for text, name in cues.items():
        hit = spark.createDataFrame([(text,)], "t string").select(*(F.col("t").rlike(c).alias(k) for k, c in postings.CUES.items())).first().asDict()
        assert [k for k, v in hit.items() if v] == [name]


def test_sections_that_can_wait(spark):
    rows = [(1, 0, "summary"), (1, 1, "interests"), (1, 2, "projects"), (1, 3, "languages"), (2, 0, "references"), (3, 0, None), (3, 1, "skills")]
    got = reports.interrupting(spark.createDataFrame(rows, "doc_id long, section long, kind string")).collect()
    assert [tuple(r) for r in got] == [(1, 1, "interests", 1.5)]


def test_inflected_words_are_those_with_a_listed_base_form(spark):
    verbs = ["plan", "carry", "use", "lead", "fix", "go", "fine-tune"]
    words = [*verbs, *(v + e for v in verbs for e in ("s", "es", "ed", "d", "ing")), "carries", "carried", "planned", "used", "goed", "fixxed", "plannedx", "usees", "planed", "carryed", "gooed", "leadded", "s", "ed", "es", ""]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.arrays_overlap(statements.base_forms(F.col("w")), F.array(*map(F.lit, verbs))).alias("a"), F.col("w").isin(statements.inflected(verbs)).alias("b")).collect()
    assert [(r.w, r.a) for r in rows] == [(r.w, r.b) for r in rows] and sum(r.a for r in rows) > 20


def test_totals_of_decimals_round_their_halves_up(spark):
    rows = spark.createDataFrame([(7.35, 8.2), (6.3, 8.2), (7.34, 8.2)], "a double, b double").select(wording.one_place(F.col("a") + F.col("b")).alias("x")).collect()
    assert [r.x for r in rows] == [15.6, 14.5, 15.5]
