"""First looks, visual order, merged findings and the corpus report on small cases."""

from __future__ import annotations

from papyrine.operators import impressions, statements


def test_skim_strengths_and_first_impression(spark):
    told = spark.createDataFrame([(1, 1, "Cut costs by 40% with a new plan for all of the teams", "Shop"), (1, 3, "Wrote one two three four five six seven eight $5M", "Shop"), (1, 5, "cut costs by 40%", "Shop"), (1, 7, None, "x")], "doc_id long, ord long, text string, entry string")
    titles = spark.createDataFrame([(1, 0, "Shop"), (2, 0, None)], "doc_id long, ord long, text string")
    skim = impressions.skim_text(titles, told)
    assert {r.doc_id: r.text for r in skim.collect()} == {1: "Shop\nCut costs by 40% with a new plan\nWrote one two three four five six seven\ncut costs by 40%\n", 2: ""}
    strong = impressions.strengths(told, skim)
    assert [(r.place, r.label, r.visible) for r in strong.orderBy("place").collect()] == [(1, "40% — Shop", True), (2, "$5M — Shop", False)]
    people = spark.createDataFrame([(1, "A data engineer at work", "data", "data"), (2, None, None, "data"), (3, "x " * 14 + "engineer", "a", None)], "doc_id long, summary string, skim_role string, full_role string")
    got = {r.doc_id: (r.says_who, r.n_strong, r.n_visible, r.score) for r in impressions.first_impression(people, strong).collect()}
    assert got == {1: (True, 2, 1, 16.0), 2: (False, 0, 0, 2.0), 3: (False, 0, 0, 0.0)}


def test_visual_order(spark):
    sections = [(1, 0, "summary", 12.0, 3), (1, 1, "interests", 12.0, 9), (1, 2, "skills", 13.0, 2), (2, 0, "skills", None, 1), (2, 1, "languages", 12.0, 9)]
    people = spark.createDataFrame([(1, "entry", 2), (2, "senior", 3), (3, "entry", 1)], "doc_id long, level string, pages long")
    rows = impressions.visual_order(people, spark.createDataFrame(sections, "doc_id long, section long, kind string, size double, lines long"))
    assert {r.doc_id: tuple(r)[1:] for r in rows.collect()} == {1: (2, 9, 1, 10 - 2 - 3 - 1.5), 2: (1, 9, 0, 8.5), 3: (0, 0, 0, 10.0)}


def test_insights_keep_the_more_severe_of_a_title(spark):
    rows = [(1, "ats", 1, "No Skills section (also missing: summary)", "medium", 2.0), (1, "rri", 2, "no skills section", "high", 1.0), (1, "rri", 3, "Other", "odd", 9.0), (1, "rri", 4, "Third", "high", 1.04), (2, "q", 1, None, None, None)]
    got = impressions.insights(spark.createDataFrame(rows, "doc_id long, source string, ord long, title string, severity string, points double")).orderBy("doc_id", "place").collect()
    assert [(r.doc_id, r.place, r.source, r.title) for r in got] == [(1, 1, "rri", "no skills section"), (1, 2, "rri", "Third"), (1, 3, "rri", "Other"), (2, 1, "q", None)]


def test_corpus_report(spark):
    docs = spark.createDataFrame([(1, "Built Spark3 jobs for 40 users.\nHelped with things\nLed it")], "doc_id long, text string")
    row = impressions.corpus_report(statements.graded(statements.statements(docs, "doc_id"))).first()
    assert (row.n, row.grade_a, row.n_metrics, row.best.split()[0], row.n_words) == (3, 1, 1, "0", 11)
