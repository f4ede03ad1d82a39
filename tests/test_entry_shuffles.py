"""Entries are told apart in one sort of a section and built where they are; dates are found where they were."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from papyrine.operators import entries


def _found(text):
    a, b = (F.regexp_extract(text, entries.RANGE, k) for k in (1, 2))
    return F.when(a != "", F.concat(a, F.lit(" – "), b)).otherwise(F.regexp_extract(text, entries.SINGLE, 1))


def test_one_shuffle_and_no_join(spark, capsys):
    rows = spark.createDataFrame([(1, 0, "experience", i, t, 36.0 + 12 * (t[0] == "•"), 10.0, 0.0, False) for i, t in enumerate(["A 2019", "• b", "• c", "D", "• e"])], "doc_id long, section long, kind string, line long, text string, x0 double, size double, bold double, first_bold boolean")
    built = entries.built(entries.roles(entries.segmented(rows)))
    built.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and plan.count("- Sort [") == 2
    assert [tuple(r)[2:] for r in built.orderBy("entry").collect()] == [(0, "A", "", "2019", "", 2), (1, "D", "", "", "", 1)]


def test_the_middle_bullet_is_the_upper_one(spark):
    def rows(doc: int, edges: list) -> list[tuple]:
        body = [(doc, 0, "experience", i, "• b", float(x), 10.0, 0.0, False) for i, x in enumerate(edges)]
        return [*body, (doc, 0, "experience", 99, "Next", 44.0, 10.0, 0.0, False)]

    frame = spark.createDataFrame([*rows(1, [40, 40, 49, 49]), *rows(2, [40, 40, 40, 49]), *rows(3, [49, 40, 49])], "doc_id long, section long, kind string, line long, text string, x0 double, size double, bold double, first_bold boolean")
    last = {r.doc_id: r.part for r in entries.segmented(frame).filter("line = 99").collect()}
    assert last == {1: "title", 2: "rest", 3: "title"}


def test_dates_are_the_same(spark):
    rng = random.Random(3)
    parts = ["Jan", "march ", "Sept. ", "2019", "1999", " ", "20", "05/2020", " – ", "-", " to ", "Present", "now", "(", ")", ",", "x", "é", "12345", "\n"]
    frame = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(9)),) for _ in range(4000)], "t string")
    removed = F.col("t")
    for pattern in entries._REMOVED:
        removed = F.regexp_replace(removed, pattern, "")
    removed = F.btrim(F.regexp_replace(removed, r"\s{2,}", " "), F.lit(entries.EDGES))
    rows = frame.select(_found(F.col("t")).alias("a"), entries.find_dates(F.col("t")).alias("b"), removed.alias("c"), entries.remove_dates(F.col("t")).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in rows) and sum("–" in r.a for r in rows) > 100
