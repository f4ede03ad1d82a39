"""Dates, timelines, grounded rewrites and match dimensions with pinned values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from papyrine.operators import dimensions, grounding, timelines

NOW = 2026 * 12 + 10


@pytest.mark.parametrize(("text", "spans"), [
    ("Summer 2024", [(2024 * 12 + 5, 2024 * 12 + 7)]), ("06/2022 - 03/2023", [(2022 * 12 + 5,) * 2, (2023 * 12 + 2,) * 2]), ("Winter 2020", [(2020 * 12 + 11, 2021 * 12 + 1)]),
    ("Jan '21 – Sept. 2022", [(2021 * 12,) * 2, (2022 * 12 + 8,) * 2]), ("2020-2022", [(2020 * 12, 2020 * 12 + 11), (2022 * 12, 2022 * 12 + 11)]), ("no date", []), (None, []),
])
def test_date_spans(spark, text, spans):
    row = spark.createDataFrame([(text,)], "t string").select(timelines.date_spans(F.col("t")).alias("x")).first()
    assert [tuple(x) for x in row.x] == spans


def test_seven_entries(spark):
    entries = [
        ("r", 1, "experience", "Software Engineer, Acme", "Jan 2025 – Present"), ("r", 2, "experience", "Backend Engineer, Beta", "Jun 2024 – Mar 2025"), ("r", 3, "experience", "Software Engineering Intern, Gamma", "May 2023 – Aug 2023"),
        ("r", 4, "experience", "Developer, Delta", "Aug 2022 – Jun 2022"), ("r", 5, "experience", "Consultant, Epsilon", ""), ("r", 6, "projects", "Key-value store", "Dec 2026 – Feb 2027"), ("r", 7, "education", "Degree", "2020 – Expected May 2026"),
        ("y", 8, "experience", "Engineer, A", "2020 - 2022"), ("y", 9, "experience", "Engineer, B", "2022 - 2024"),
    ]
    rows = timelines.dated(spark.createDataFrame(entries, "owner string, id long, section string, title string, dates string"), NOW)
    claims = spark.createDataFrame([("r", "Backend engineer with 5+ years of experience building APIs.")], "owner string, t string").select("owner", timelines.years_claimed(F.col("t")).alias("claimed"))
    found = {(r.owner, r.finding, r.id, r.other) for r in timelines.timeline(rows, claims, NOW).collect()}
    assert {("r", "end_before_start", 4, None), ("r", "overlap", 1, 2), ("r", "future", 6, None), ("r", "undated", 5, None)} <= found
    assert any(k == "years_claim" for _, k, _, _ in found) and not any(k == "overlap" and 3 in (a, b) for _, k, a, b in found)
    assert not [x for x in found if x[0] == "y"]
    labels = spark.createDataFrame([(27,), (7,)], "m long").select(timelines.months_label(F.col("m")).alias("x")).collect()
    assert [r.x for r in labels] == ["2 yr 3 mo", "7 mo"]


def test_rewrites_are_gated(spark):
    names = spark.createDataFrame([("postgres", "PostgreSQL"), ("postgresql", "PostgreSQL"), ("kafka", "Kafka"), ("spring boot", "Spring Boot"), ("express", "Express")], "phrase string, canonical string")
    generals = spark.createDataFrame([("PostgreSQL", "relational database"), ("PostgreSQL", "database")], "canonical string, general string")
    base = "Cut query time from 850 ms to 120 ms on postgres with ResNet-50 for 40 users"
    pairs = [
        (1, "Reduced query time by 86% on PostgreSQL", True), (2, "Reduced query time by 60% on PostgreSQL", False), (3, "Tuned kafka consumers", False), (4, "Tuned a postgres database for 40 users", True),
        (5, "Worked at Google on query time", False), (6, "Built Spring Boot services", False), (7, "We express query time in ms. Query time fell", True), (8, "Used ResNet-50", True), (9, "Used ResNet-101", False), (10, "Cut AWS costs", False),
    ]
    rows = spark.createDataFrame([(i, x, base) for i, x, _ in pairs], "id long, rewrite string, ground string")
    got = {r.id: r for r in grounding.validated(rows, "id", names, generals, ["express"]).collect()}
    assert {i: got[i].valid for i, _, _ in pairs} == {i: v for i, _, v in pairs}
    assert got[1].n_derived == 1 and got[1].n_alias == 1 and got[6].bad_terms == "Boot Spring Spring Boot"
    assert spark.createDataFrame([("5M and 2.50",)], "t string").select(grounding.number_strings(F.col("t")).alias("x")).first().x == ["2.5", "5000000"]


def test_dimensions_and_their_total(spark):
    pair = ("l", "r", "python mysql docker kubernetes", ["built python services", "ran docker"], ["python tool"], "BSc computing", ["python", "kuber"], [], ["python services in docker"], ["run docker daily"], ["computing degree"], "python docker")
    schema = "left string, right string, text string, entries array<string>, projects array<string>, education string, required array<string>, preferred array<string>, requirements array<string>, responsibilities array<string>, education_requirements array<string>, post string"
    scores = dimensions.dimension_scores(spark.createDataFrame([pair], schema), "left", "right")
    row = scores.first()
    assert (row.required, row.preferred, row.experience, row.projects, row.education, row.semantic) == (14.0, None, 5.0, 5.0, 5.0, 55.0)
    total = dimensions.totals(scores, "left", "right").first().total
    assert total == pytest.approx(round(100 * (14 + 5 + 5 + row.responsibilities + 5 + 55) / 95, 1)) and sum(dimensions.WEIGHTS.values()) == 100
