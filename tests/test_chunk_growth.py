"""What a task holds of passages and chunks is bounded, and a vector of another length leaves the others alone."""

from __future__ import annotations

from papyrine.operators import semantic


def test_slices_are_small_and_odd_vectors_alone(spark, monkeypatch):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, embedding array<double>")
    chunks = spark.createDataFrame([(7, i, [1.0, float(i)]) for i in range(5)] + [(8, 9, [1.0, 0.0, 0.0]), (8, 10, None)], "owner long, chunk_id long, embedding array<double>").coalesce(1)
    whole = sorted(semantic.best_chunks(queries, chunks, 2).collect())
    assert [tuple(r)[:4] for r in whole if r.query_id == 1] == [(1, 7, 0, 1.0), (1, 7, 1, 0.707107), (1, 8, 9, 0.0), (1, 8, 10, 0.0)]
    monkeypatch.setattr(semantic, "PAIRS", 4)
    assert sorted(semantic.best_chunks(queries, chunks, 2).collect()) == whole
