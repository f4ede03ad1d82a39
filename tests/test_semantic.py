"""Best chunks, calibrated scores, ranks of whole lists, pools and contexts against plain versions."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from papyrine.operators import retrieval, semantic


def vectors(seed: int, n: int, width: int = 6) -> dict[int, list[float]]:
    rng = random.Random(seed)
    return {i: [rng.gauss(0, 1) for _ in range(width)] for i in range(n)}


def unit(v):
    v = np.array(v)
    return v / np.sqrt((v * v).sum())


def test_best_chunks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(semantic, "ASKED", 4)
    monkeypatch.setattr(semantic, "SLICE", 16)
    asked, held = vectors(1, 10), vectors(2, 90)
    held |= {90: held[3], 91: [0.0] * 6}
    chunks = spark.createDataFrame([(k % 7, k, v) for k, v in held.items()] + [(0, 200, None), (None, 201, held[1])], "owner long, chunk_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame(list(asked.items()), "query_id long, embedding array<double>")
    for k in (1, 3):
        want = []
        for q, a in asked.items():
            for owner in range(7):
                own = sorted((-round(float(unit(a) @ unit(v)) if any(v) else 0.0, 6), c) for c, v in held.items() if c % 7 == owner)
                want += [(q, owner, c, -s + 0.0, rank) for rank, (s, c) in enumerate(sorted(own + ([(-0.0, 200)] if owner == 0 else []))[:k], 1)]
        got = sorted(tuple(r) for r in semantic.best_chunks(queries, chunks, k).collect())
        assert got == sorted(want)
    same = spark.createDataFrame(list(held.items()), "chunk_id long, embedding array<double>")
    near = semantic.nearest(same.withColumnRenamed("chunk_id", "query_id").filter("query_id < 5"), same, 2).collect()
    assert all(r.query_id != r.chunk_id for r in near) and {(r.query_id, r.chunk_id) for r in near} >= {(3, 90)}
    assert semantic.best_chunks(queries.filter("false"), chunks).count() == 0


def test_scores_without_requirements_or_chunks(spark):
    whole = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.9), (2, 1, 0.1)], "right long, owner long, cosine double")
    best = spark.createDataFrame([(7, 1, 5, 0.7, 1), (8, 1, 6, 0.3, 1)], "query_id long, owner long, chunk_id long, cosine double, rank long")
    asked = spark.createDataFrame([(7, 1), (8, 1)], "query_id long, right long")
    ends = spark.createDataFrame([(0.2, 0.8)], "low double, high double")
    got = {(r.right, r.owner): (r.whole, r.covered, r.n_asked, r.score) for r in semantic.semantic_scores(whole, best, asked, ends).collect()}
    assert got == {(1, 1): (0.5, 1, 2, 27.5), (1, 2): (1.0, 0, 0, 55.0), (2, 1): (0.0, 0, 0, 0.0)}
    cal = spark.range(1).select(*(semantic.calibrated(F.lit(x), semantic.LOW, semantic.HIGH) for x in (0.5, 0.558, 0.7245, 0.95))).first()
    assert [round(x, 6) for x in cal] == [0.0, 0.0, 0.5, 1.0]
    assert semantic.related(best).select("similarity", "confidence").collect() == [(0.7, 0.56)]


def test_ranks_and_pools_match_whole_lists(spark):
    rng = random.Random(3)
    lists = [{(q, c): round(rng.choice([rng.random(), 0.5]), 3) for q in range(4) for c in rng.sample(range(400), 250)} for _ in range(2)]
    lists[0] |= {(9, c): 1.0 + c for c in range(3)}
    lists[1] |= {(9, c): 0.5 - c / 1000 for c in range(200)}
    a, b = (spark.createDataFrame([(q, c, s) for (q, c), s in x.items()], f"query_id long, chunk_id long, {n} double") for x, n in zip(lists, ("bm25", "cosine"), strict=True))
    places = []
    for x in lists:
        places.append({})
        for q in {q for q, _ in x}:
            places[-1] |= {(q, c): i for i, (_, c) in enumerate(sorted((-s, c) for (p, c), s in x.items() if p == q), 1)}
    wanted = spark.createDataFrame([(q, c) for q in range(4) for c in range(0, 400, 17)], "query_id long, chunk_id long")
    got = {(r.query_id, r.chunk_id): r["rank"] for r in retrieval.ranks(a, "bm25", wanted).collect()}
    assert got == {k: v for k, v in places[0].items() if k[0] < 4 and k[1] % 17 == 0}
    fused = {k: sum(1 / (60 + p[k]) for p in places if k in p) for k in {*lists[0], *lists[1]}}
    k = 3
    want = []
    for q in {q for q, _ in fused}:
        best = max((s for (p, _), s in lists[0].items() if p == q), default=1)
        pool = sorted((-round(f, 9), c) for (p, c), f in fused.items() if p == q and (lists[0].get((p, c), 0) > 0 or lists[1].get((p, c), 0) >= 0.45))[:20]
        scored = [(c, i, round(0.65 * lists[1].get((q, c), 0) + 0.35 * lists[0].get((q, c), 0) / best, 4)) for i, (_, c) in enumerate(pool, 1)]
        want += [(q, c, i, s, r) for r, (c, i, s) in enumerate([x for x in scored if x[2] >= 0.1][:k], 1)]
    rows = sorted(tuple(r) for r in retrieval.hybrid(a, b, k).collect())
    assert [(r[0], r[1], r[2], r[4]) for r in rows] == sorted((w[0], w[1], w[2], w[4]) for w in want) and np.allclose([r[3] for r in rows], [w[3] for w in sorted(want)], atol=1e-4)
    plain = retrieval.reciprocal_rank_fusion(a, b, "bm25", "cosine", 5).collect()
    assert {(r.query_id, r.chunk_id) for r in plain if r.query_id == 1} == {(1, c) for _, c in sorted((-round(f, 9), c) for (q, c), f in fused.items() if q == 1)[:5]}


def test_contexts_take_each_chunk_once(spark):
    hits = [spark.createDataFrame(x, "query_id long, chunk_id long, rank long") for x in ([(1, 4, 1), (1, 2, 2), (1, 9, 3)], [(1, 4, 1), (2, 9, 1)], [(1, 7, 1)])]
    chunks = spark.createDataFrame([(2, "two"), (4, "four"), (7, None), (9, "nine")], "chunk_id long, text string")
    got = {r.query_id: (r.n_hits, r.context) for r in retrieval.assembled([(hits[0], 2), (hits[1], 1), (hits[2], 1)], chunks).collect()}
    assert got == {1: (3, "[4] four\n[2] two\n[7] "), 2: (1, "[9] nine")}


def test_cosines_are_counted_in_tasks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(300)] + [(300, [0.0] * 5), (301, None), (302, [1.0, None, 0.0, 0.0, 0.0]), (303, [1.0])]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    asked = vectors.filter("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    counts = semantic.cosine_counts(asked, vectors)
    pairs = retrieval.cosine_pairs(vectors, asked).filter("cosine is not null").groupBy("cosine").count()
    assert sorted((round(r.cosine, 6), r.n) for r in counts.collect()) == sorted((round(r.cosine + 0.0, 6), r["count"]) for r in pairs.collect())
    assert "Join" not in counts._jdf.queryExecution().executedPlan().toString()
