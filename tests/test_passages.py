"""Queries with benchmark passages against brute force on a small fixture."""

from __future__ import annotations

import collections
import math
import random
import re

import pytest

from papyrine.functions.text import SEARCH_STOP
from papyrine.operators import retrieval
from papyrine.plans import retrieval_queries, table_queries


def terms(text):
    return [t for t in re.findall(r"[a-z0-9_+#.-]+", text.lower()) if t not in SEARCH_STOP]


def scores(docs, asked):
    tf = {i: collections.Counter(terms(x)) for i, x in docs.items()}
    mean = sum(sum(c.values()) for c in tf.values()) / len(tf)
    df = collections.Counter(t for c in tf.values() for t in c)
    out = {}
    for q, x in asked.items():
        for i, c in tf.items():
            parts = [n * math.log(1 + (len(tf) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for t, n in collections.Counter(terms(x)).items() if c[t]]
            if parts:
                out[q, i] = sum(parts)
    return out


@pytest.fixture(scope="module")
def passages(spark, tmp_path_factory):
    """Passages of 20 to 40 words; one document shares only the last words of each."""
    rng = random.Random(4)
    vocabulary = [f"{rng.choice(['plain', 'stone', 'river'])}{i}" for i in range(400)]
    asked = {q: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(20, 41))) for q in range(8)}
    docs = {i: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))) for i in range(60)}
    docs |= {100 + q: "only " + " ".join(x.split()[14:]) for q, x in asked.items()}
    docs |= {200 + 10 * q + k: f"before {x} after {k}" for q, x in asked.items() for k in range(q)}
    folder = tmp_path_factory.mktemp("passages")
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(asked.items()), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, asked


def test_whole_passages_are_searched(spark, passages):
    folder, docs, asked = passages
    want = scores(docs, asked)
    got = {(r.query_id, r.chunk_id): r.bm25 for r in retrieval_queries.bm25_scores(spark, folder).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)
    first = {r.query_id: r.chunk_id for r in retrieval_queries.bm25_search(spark, folder).filter("rank = 1").collect()}
    assert first[0] == 100  # nothing but the document with the later words is near


def test_every_term_of_a_passage_is_wanted(spark, passages):
    folder, _, asked = passages
    rows = table_queries.skill_match_cascade(spark, folder).collect()
    assert rows and all(r.n_direct + r.n_related + r.n_partial + r.n_missing == len({t.rstrip(".-") for t in terms(asked[r.right])}) for r in rows)


def test_every_holder_is_evidence_and_expected(spark, passages):
    folder, docs, asked = passages
    holders = {(q, i) for q, x in asked.items() for i, y in docs.items() if x in y}
    assert max(collections.Counter(q for q, _ in holders).values()) > 3
    rows = retrieval_queries.passage_evidence(spark, folder).collect()
    assert {(r.query_id, r.chunk_id) for r in rows} == holders and len(rows) == len(holders)
    want, best = scores(docs, asked), set()
    for q in asked:
        best |= set(sorted((k for k in want if k[0] == q), key=lambda k: (-round(want[k], 6), k[1]))[:3])
    report = table_queries.recall_report(spark, folder).first()
    assert (report.n_queries, report.recall) == (len(holders), round(len(holders & best) / len(holders), 6))


def test_passages_are_held_at_any_place(spark):
    from papyrine.operators.retrieval import holders

    docs = {1: "xconcat sat.x", 2: "the of", 3: "Of the end", 4: "a cat sat", 5: None, 6: "", 7: "one two three"}
    asked = {1: "cat sat.", 2: "the of", 3: "two", 4: "One two", 5: "e tw"}
    chunks = spark.createDataFrame(list(docs.items()), "chunk_id long, text string")
    items = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    assert {tuple(r) for r in holders(chunks, items).collect()} == {(q, i) for q, x in asked.items() for i, y in docs.items() if y and x in y}


def test_pairs_are_made_where_the_postings_are(spark):
    chunks = spark.createDataFrame([(1, "red cat sat red"), (2, "blue cat"), (3, None), (4, "grey")], "chunk_id long, text string")
    asked = spark.createDataFrame([(7, "red cat"), (8, "cat"), (9, "none")], "query_id long, text string")
    held = retrieval.postings(chunks, retrieval.query_terms(asked)).collect()
    assert sorted((r.chunk_id, r.term or "", r.tf, r.dl) for r in held) == [(1, "", 1, 4), (1, "cat", 1, 4), (1, "red", 2, 4), (2, "", 1, 2), (2, "cat", 1, 2), (3, "", 1, 0), (4, "", 1, 1)]
    scores = retrieval.lexical_scores(chunks, asked)
    assert sorted((r.query_id, r.chunk_id, r.overlap) for r in scores.collect()) == [(7, 1, 1.0), (7, 2, 0.5), (8, 1, 1.0), (8, 2, 1.0)]
    plan = scores._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert re.search(r"hashpartitioning\(chunk_id", plan) and not re.search(r"hashpartitioning\(query_id#\d+L, chunk_id", plan)


def test_all_collections_are_searched_at_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(retrieval, "fused_ranks", lambda *a, f=retrieval.fused_ranks, **k: calls.append(1) or f(*a, **k))
    assert retrieval_queries.passage_context(spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1
