"""Intervals without a start or an end come last, as in SQL, and equal intervals are one island."""

from __future__ import annotations

from papyrine.operators import intervals


def test_islands_of_intervals_without_ends(spark):
    spans = [("a", 5, None), ("a", 5, 7), ("a", None, None), ("a", 9, 9), ("a", None, None), ("a", 8, 8), ("b", 1, 2), ("b", 1, 2), ("b", 9, 9), ("b", None, None)]
    rows = spark.createDataFrame(spans, "owner string, start long, end long")
    got = sorted((tuple(r) for r in intervals.islands(rows).collect()), key=str)
    assert got == [("a", 5, 9), ("a", None, None), ("a", None, None), ("b", 1, 2), ("b", 9, 9), ("b", None, None)]
    assert {(r.owner, r.n_islands, r.covered) for r in intervals.union_length(rows).collect()} == {("a", 3, 5), ("b", 3, 3)}
    assert [tuple(r) for r in intervals.gaps(rows, 1).collect()] == [("b", 3, 8, 6)]
