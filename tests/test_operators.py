from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from papyrine.functions import text
from papyrine.operators import evaluation, facts, intervals, layout, matching, postings, retrieval, rubric, statements, textstats


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("word", "n"), [("the", 1), ("simple", 2), ("engineered", 4), ("optimization", 5), ("table", 2), ("made", 1), ("rhythm", 1)])
def test_syllables(spark, word, n):
    assert one(spark, text.syllables, word) == n


def test_grade_of_plain_sentences(spark):
    rows = spark.createDataFrame([(1, "The cat sat on the mat. The dog ran to the park."), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.fk_grade for r in textstats.flesch_kincaid(rows).collect()}
    assert 0 <= got[1] <= 20 and got[2] == got[3] == 0


def test_group_percent_is_the_128_bit_remainder(spark):
    import hashlib

    for value in ("a", "group-17", "é"):
        assert one(spark, text.group_percent, value) == int(hashlib.md5(value.encode()).hexdigest(), 16) % 100


def test_chunks(spark):
    words = " ".join(map(str, range(10)))
    assert one(spark, lambda c: text.word_chunks(c, 6, 2), words) == ["0 1 2 3 4 5", "4 5 6 7 8 9"]
    assert one(spark, lambda c: text.word_chunks(c, 20, 2), words) == [words]
    assert one(spark, lambda c: text.word_chunks(c, 6, 2), None) == []


@pytest.mark.parametrize(("line", "grade"), [
    ("Reduced latency by 40% for Kafka consumers", "A"), ("Built dashboards that improved accuracy of Tableau reports", "B"), ("Designed Postgres schemas", "C"),
    ("Responsible for various things", "D"), ("Quickly improved throughput of Redis by 3x", "A"), ("The team", "D"),
])
def test_statement_grades(spark, line, grade):
    rows = spark.createDataFrame([(1, line)], "doc_id long, text string")
    assert statements.graded(statements.statements(rows, "doc_id")).first().grade == grade


@pytest.mark.parametrize(("word", "action"), [("tested", True), ("planned", True), ("carries", False), ("improves", True), ("based", False), ("speed", False), ("led", True), ("table", False)])
def test_action_words(spark, word, action):
    assert one(spark, lambda c: statements.is_action(c, ["test", "plan", "improve", "carry"] if action else []), word) is action


def test_numbers(spark):
    assert one(spark, facts.numbers, "$5M, 10k, three, 2.5x, ResNet-50") == [2.5, 3.0, 50.0, 10000.0, 5000000.0]
    assert one(spark, facts.numbers, "12345678901234 and 0.12345678901, not ResNet50 or v1.2.3") == [0.123457, 12345678901234.0]
    rows = spark.createDataFrame([("cut by 86 %", "from 850 to 120"), ("cut by 60 %", "from 850 to 120"), ("850 left", "from 850 to 120")], "a string, b string")
    got = facts.check_numbers(rows, "a", "b").select("n_grounded", "n_derived", "n_unsupported").collect()
    assert [tuple(r) for r in got] == [(0, 1, 0), (0, 0, 1), (1, 0, 0)]


def test_postings(spark):
    lines = "Requirements\n- Bachelor's degree in anything\n- AWS certified is fine\nNice to have\n- Knows our tools very well\nDuties\n- Talks to people every day\n"
    rows = spark.createDataFrame([(1, lines)], "doc_id long, text string")
    got = [(r.section, r.kind) for r in postings.posting_lines(rows).orderBy("line").collect()]
    assert got == [("requirements", "education"), ("requirements", "certification"), ("preferred", "preferred"), ("preferred", "preferred")]  # "Duties" is too short to be kept
    assert one(spark, postings.seniority, "Our internal tools, Senior role") == "intern"
    assert one(spark, postings.seniority, "Senior engineer") == "senior"
    answers = spark.createDataFrame([(1, "When the site was slow. I had to fix it. I built a cache. It cut load by 30%.")], "doc_id long, text string")
    assert postings.answer_scores(answers, "doc_id").first().asDict() == {"doc_id": 1, "situation": 6, "task": 6, "action": 6, "result": 8, "total": 67.0}


def test_intervals(spark):
    rows = spark.createDataFrame([("a", 1, 0, 5), ("a", 2, 4, 8), ("a", 3, 9, 9), ("a", 4, 200, 210), ("b", 5, 3, 3)], "owner string, id long, start long, end long")
    assert {(r.owner, r.n_islands, r.covered) for r in intervals.union_length(rows).collect()} == {("a", 2, 21), ("b", 1, 1)}
    assert [tuple(r) for r in intervals.gaps(rows, 5).collect()] == [("a", 10, 199, 190)]
    assert [tuple(r) for r in intervals.overlaps(rows, 1).collect()] == [("a", 1, 2, 2)]
    months = spark.createDataFrame([(datetime.date(2024, 6, 3),)], "d date").select(intervals.month_number(F.col("d")).alias("m")).first().m
    assert months == 2024 * 12 + 5


def test_evaluation(spark):
    rows = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 1), (3, 0.8, 0), (4, 0.1, 0)], "id long, s double, y int")
    assert evaluation.roc_auc(rows, "s", "y").first().auc == 0.875
    assert evaluation.roc_auc(rows.filter("y = 1"), "s", "y").first().auc is None
    assert evaluation.spearman(rows, "s", "y").first().n == 4
    assert evaluation.group_split(rows, "id").count() == 4
    assert evaluation.stratified_sample(rows, "y", "id", 0.5).groupBy("y").count().count() == 2


def test_quantiles_and_samples_in_blocks(spark):
    import hashlib

    import numpy as np

    rng = np.random.default_rng(1)
    values = {"a": rng.normal(0, 1, 501).round(2), "b": np.array([3.0] * 50 + [4.0]), "c": np.array([7.0])}
    rows = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None)], "label string, x double")
    got = {r.label: (r.low, r.mid, r.high) for r in evaluation.quantiles(rows, ["label"], "x", {"low": 0.05, "mid": 0.5, "high": 0.95}).collect()}
    for k, v in values.items():
        assert got[k] == pytest.approx(tuple(np.quantile(v, [0.05, 0.5, 0.95])))
    many = spark.range(20_000).withColumn("y", F.col("id") % 2)
    for label in (0, 1):
        ids = sorted(range(label, 20_000, 2), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))[:3333]
        assert sorted(r.id for r in evaluation.stratified_sample(many.filter(f"y = {label}"), "y", "id", 0.3333).collect()) == sorted(ids)


def test_retrieval_ranks_the_right_chunk_first(spark):
    chunks = spark.createDataFrame([(1, "rust belongs here"), (2, "python data pipelines"), (3, "python python")], "chunk_id long, text string")
    asked = spark.createDataFrame([(9, "data pipelines in python")], "query_id long, text string")
    best = retrieval.top_k(retrieval.bm25(chunks, asked), "bm25", 2).orderBy("rank").collect()
    assert [r.chunk_id for r in best] == [2, 3]


def test_cascade(spark):
    pairs = spark.createDataFrame([(1, 2)], "left long, right long")
    have = spark.createDataFrame([(1, "python"), (1, "mysql"), (1, "react native")], "owner long, skill string")
    want = spark.createDataFrame([(2, "python"), (2, "postgresql"), (2, "react"), (2, "rust")], "owner long, skill string")
    relations = spark.createDataFrame([("postgresql", "mysql")], "src string, dst string")
    got = {r.skill: (r.kind, r.confidence) for r in matching.cascade(pairs, have, want, relations).collect()}
    assert got == {"python": ("direct", 1.0), "postgresql": ("related", 0.6), "react": ("partial", 0.4), "rust": ("missing", 0.0)}
    aliases = spark.createDataFrame([("k8s", "Kubernetes")], "alias string, canonical string")
    skills = spark.createDataFrame([(1, "K8s"), (1, "kubernetes "), (1, "Go")], "owner long, skill string")
    assert {r.skill for r in matching.normalized(skills, aliases).collect()} == {"kubernetes", "go"}


def test_findings_are_ranked_once_per_title(spark):
    rows = spark.createDataFrame([(1, "low", 1.0, "A", 1), (1, "high", 5.0, "b", 2), (1, "medium", 9.0, "B", 3), (1, "high", 6.0, "c", 4)], "owner long, severity string, points double, title string, ord int")
    assert [r.title for r in matching.first_findings(rows, 2).orderBy("rank").collect()] == ["c", "b"]


def test_attention_shares_the_budget(spark):
    rows = [(1, i, 0, 36.0, 20.0 * i, 612.0, 792.0, 14.0 if i == 0 else 10.0, 0.0, "title" if i == 0 else "statement", None if i == 0 else i // 3, i % 3, "nine plain words " * 3) for i in range(20)]
    lines = spark.createDataFrame(rows, "doc_id long, line long, page int, x0 double, y0 double, width double, height double, size double, bold double, role string, statement int, place int, text string")
    got = layout.attention(lines).toPandas().sort_values("line")
    assert abs(got.fixations.sum() - 29.6) < 0.2 and got.weight.iloc[0] == 1.0 and got.seen.iloc[0]


def test_rubric_is_within_its_maxima(spark):
    docs = spark.createDataFrame([(1, "Ann Lee\nann@x.org +1 555 010 9999\nExperience\nEducation\nSkills\n" + "python sql " * 80 + "2020"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in rubric.rule_scores(rubric.document_features(docs, ["python", "sql"]), 2026).collect()}
    assert all(0 <= rows[i][k] <= v for i in rows for k, v in rubric.MOST.items())
    got = {r.doc_id: r.total for r in rubric.totals(rubric.rule_scores(rubric.document_features(docs, ["python", "sql"]), 2026)).collect()}
    assert sum(rubric.MOST.values()) == 100 and got[1] > 80 > got[2] == got[3]


def test_extractability(spark):
    rows = spark.createDataFrame([(1, "word " * 200), (2, "short"), (3, "word " * 60)], "doc_id long, text string")
    assert {r.doc_id: r.score for r in textstats.text_extractability(rows).collect()} == {1: 20.0, 2: 0.0, 3: 14.0}
