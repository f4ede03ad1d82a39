"""Recall looks at documents' words once; holders of passages are found by their rarest terms."""

from __future__ import annotations

import random

from papyrine.operators import retrieval
from papyrine.plans import table_queries


def test_documents_are_cut_into_words_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"one two three four five six n{i}") for i in range(8)] + [(9, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "two three four five six n3"), (2, "one two three"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    calls, plain = [], retrieval.postings
    monkeypatch.setattr(retrieval, "postings", lambda *a: calls.append(a) or plain(*a))
    assert tuple(table_queries.recall_report(spark, str(tmp_path)).first()) == (9, round(4 / 9, 6))
    assert len(calls) == 1


def test_holders_by_rarest_terms(spark):
    rng = random.Random(5)
    words = ["the", "a", "b.", "c", "d", "e", "f", "g", "hh", "İx", "j-k", "l"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(120)] + [(500, None)]
    passages = [(i, texts[i][1][rng.randrange(20) :][: rng.choice([1, 3, 9, 25])]) for i in range(60)] + [(70, "nowhere to be found at all"), (71, "d e f unheard g hh c"), (72, "")]
    got = {(r.query_id, r.chunk_id) for r in retrieval.holders(spark.createDataFrame(texts, "chunk_id long, text string"), spark.createDataFrame(passages, "query_id long, text string")).collect()}
    assert got == {(q, c) for q, p in passages for c, t in texts if t is not None and p in t}
