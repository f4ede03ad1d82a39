"""A norm is chosen once for a role, family and level."""

from __future__ import annotations

from papyrine.operators import norms


def test_norm_is_chosen_by_what_people_share(spark):
    held = spark.createDataFrame([("a-1", "a", "mid", 0, ["x"], [], [], []), ("a-2", "a", "senior", 1, ["y"], [], [], [])], "role string, family string, level string, place long, expected_sections array<string>, typical_tools array<string>, expected_metrics array<string>, anti_patterns array<string>")
    people = spark.createDataFrame([(1, "a-1", "a", "mid"), (None, "a-1", "a", "mid"), (2, "a-1", "a", "senior"), (3, None, "a", "senior"), (4, "b", "b", "mid")], "doc_id long, role string, family string, level string")
    got = sorted((r.doc_id or 0, r.fit, r.norm_role) for r in norms.chosen(people, held).collect())
    assert got == [(0, 0, "a-1"), (1, 0, "a-1"), (2, 1, "a-1"), (3, 2, "a-2"), (4, 3, None)]
