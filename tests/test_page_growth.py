"""Pages are gathered once, where their pieces are; more documents are more tasks."""

from __future__ import annotations

from papyrine.operators import pages
from papyrine.plans import page_queries

SCHEMA = "doc_id long, page long, piece long, x0 double, y0 double, x1 double, y1 double, text string, size double, bold boolean, width double"


def _documents(spark, folder) -> str:
    spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(400 + i))) for i in range(6)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_rows_need_no_second_look_at_documents(spark, tmp_path, capsys):
    rows = page_queries.page_rows(spark, _documents(spark, tmp_path))
    rows.explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
    assert rows.groupBy("doc_id").count().count() == 6


def test_tasks_grow_with_documents(spark, monkeypatch):
    assert page_queries._parts(spark, spark.range(1000)) == 4
    monkeypatch.setattr(page_queries, "TEXTS_A_TASK", 100)
    assert page_queries._parts(spark, spark.range(1000)) == 11


def test_missing_places_and_repeated_ids(spark):
    column = [(1, 0, i, 36.0 + 280 * (i % 2), 60.0 + 12 * (i // 2), 230.0 + 280 * (i % 2), 70.0 + 12 * (i // 2), f"t{i}", 10.0, False, 612.0) for i in range(20)]
    odd = [(1, 0, 20, None, 60.0, None, 70.0, "nowhere", None, None, None), (1, 1, 0, 36.0, None, 50.0, None, None, 10.0, True, 612.0), (2, 0, 0, 36.0, 60.0, 50.0, 70.0, "a", 10.0, False, 612.0), (2, 0, 0, 60.0, 60.0, 70.0, 70.0, "b", 10.0, False, 612.0)]
    frame = spark.createDataFrame(column + odd, SCHEMA)
    assert [tuple(r) for r in pages.gutters(frame).collect()] == [(1, 0, 231.0, 0)]
    placed = {(r.doc_id, r.page, r.text): (r.region, r.row) for r in pages.in_rows(pages.regions(frame)).collect()}
    assert placed == {(r.doc_id, r.page, r.text): (r.region, r.row) for r in pages.laid(frame).collect()}
    assert placed[1, 0, "nowhere"] == (2, 0) and placed[1, 0, "t18"] == (1, 9) and placed[1, 0, "t19"] == (2, 9) and placed[1, 1, None] == (0, 0)
    assert pages.in_rows(pages.regions(frame)).count() == len(column + odd)
