"""More rows are more tasks where entries are told apart."""

from __future__ import annotations

from papyrine.plans import entry_queries


def test_tasks_grow_with_rows(spark, monkeypatch):
    rows = spark.range(1000)
    assert entry_queries._parts(spark, rows) == 4
    monkeypatch.setattr(entry_queries, "ROWS_A_TASK", 100)
    assert entry_queries._parts(spark, rows) == 11
