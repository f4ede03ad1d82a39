"""Ranked search, suffix tree scores and source distances against plain versions."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from papyrine.llm import divergence, lexical_trie, suffix_tree
from papyrine.llm.terms import LETTERS, PIECE, WORDY, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTER = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def made(seed: int, n: int, words: int = 30, size: int = 40) -> list[tuple]:
    """doc_id, text, lang, source with copies, odd characters, empty and null texts and repeated ids."""
    rng = random.Random(seed)
    bag = [f"w{i}" for i in range(words)] + ["Äpfel", "É", "x_y", "A1b", "don't", "naïve-é"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(bag[: rng.choice([5, len(bag)])]) for _ in range(rng.randrange(size)))
        rows.append((i, rng.choice([text, text, text.title(), rows[rng.randrange(len(rows))][1] if rows else text]), rng.choice(["a", "b", None]), rng.choice(["s1", "s2", "s3", None])))
    return [*rows, (n, None, "a", "s1"), (n + 1, "", None, "only"), (n + 1, "w1 w2", "b", "s2"), (None, "w1 w2 w3", "a", "s2"), (n + 2, " -- ", "c", "s9")]


SCHEMA = "doc_id long, text string, lang string, source string"


def test_terms_are_those_of_the_pattern():
    text = "Ab-c 12 é x\tÄ_Z" + "y" * 10
    for table, pattern in ((WORDY, TERM), (LETTERS, LETTER)):
        for t in (text, "", None, "-", "x" * (PIECE + 5) + " b", ("ab, " * (PIECE // 2)) + "Z"):
            assert [w.decode() for part in terms(t, table) for w in part] == pattern.findall(lowered(t))


def search_by_hand(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    held = [(d, Counter(ws), len(ws)) for d, text, *_ in docs if (ws := TERM.findall(lowered(text)))]
    n_docs, length = len(held), sum(n for *_, n in held)
    out, asked = [], defaultdict(set)
    for item, text in items:
        asked[item] |= set(TERM.findall(lowered(text)))
    for item, ts in asked.items():
        scored = []
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c, _ in held) + 1))) for t in ts}
        for d, c, n in held:
            m = 50 + (50 * n * n_docs) // length
            if (score := sum(weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)) > 0:
                scored.append((-score, d is None, d))
        for rank, (score, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.append((item, rank, d, -score))
    return sorted(out, key=repr)


@pytest.mark.parametrize("leaf, deep, cells", [(32, 200, 1 << 23), (2, 200, 1 << 10), (3, 2, 1 << 12)])
def test_search_matches_brute_force(spark, monkeypatch, leaf, deep, cells):
    for name, value in (("LEAF", leaf), ("DEEP", deep), ("CELLS", cells)):
        monkeypatch.setattr(lexical_trie, name, value)
    docs = made(1, 400)
    items = [(1, "w1 W2 w2 äpfel"), (2, "w9 w11 É w20 w21"), (3, "zz"), (4, None), (5, ""), (5, "w3"), (None, "w4 A1B"), (7, " ".join(f"w{i}" for i in range(30)))]
    rows = spark.createDataFrame(docs, SCHEMA).repartition(3).withColumns({c: F.lit("z") for c in ("item_id", "n", "ids", "rank", "part", "score")})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "term": F.lit("w1")})
    got = sorted(map(tuple, lexical_trie.search(rows, asked, 7).collect()), key=repr)
    assert got == search_by_hand(docs, items, 7)
    monkeypatch.setattr(lexical_trie, "AT_ONCE", 9)  # several passes over the documents
    assert sorted(map(tuple, lexical_trie.search(rows, asked, 7).collect()), key=repr) == got
    assert lexical_trie.search(rows.filter("false"), asked).count() == lexical_trie.search(rows, asked.filter("false")).count() == 0


def test_nodes_bound_what_is_below_and_are_left_when_they_cannot_qualify():
    rng = np.random.default_rng(0)
    vectors = [(np.sort(rng.choice(20, rng.integers(1, 8), replace=False)), None) for _ in range(300)]
    vectors = [(v, rng.integers(1, 9, len(v))) for v, _ in vectors] + [(np.arange(k + 1), np.ones(k + 1, np.int64)) for k in range(20) for _ in range(3)]
    m = rng.integers(50, 200, len(vectors))
    trie = lexical_trie.Trie(list(range(len(vectors))), m, vectors, 20)
    weight = rng.integers(1, 5000, 20)
    bounds = (lexical_trie.saturated(trie.top, trie.least[:, None]) * weight).sum(axis=1)
    exact = (trie.parts.astype(np.int64) * weight).sum(axis=1)
    covered = []
    for node, (lo, hi, children) in enumerate(trie.nodes):
        assert exact[lo:hi].max() <= bounds[node]
        assert not children or (trie.nodes[children[0]][0], trie.nodes[children[-1]][1]) == (lo, hi)
        covered += [] if children else range(lo, hi)
    assert sorted(covered) == list(range(len(vectors))) and len(trie.nodes) > 8


def tree_by_hand(texts: list[str], asked: list[str], context_share: float, symbol_share: float, gain: float, depth: int = 3):
    """(tokens, base, score) of each asked text, and the contexts that stay, by dictionaries."""
    lines = [[*WORD.findall(lowered(t)), None] for t in texts]
    count = Counter(w for line in lines for w in line)
    total, distinct = sum(count.values()), len(count)
    least_context, least = max(2, math.ceil(context_share * total)), max(2, math.ceil(symbol_share * total))

    def root(w):
        return (count[w] + 0.1) / (total + 0.1 * (distinct + 1))

    after: dict[tuple, Counter] = defaultdict(Counter)
    for line in lines:
        for i, w in enumerate(line):
            for k in range(1, min(depth, i) + 1):
                after[tuple(line[i - k : i])][w] += 1
    often = {s for s in after if (count[s[0]] if len(s) == 1 else after[s[:-1]][s[-1]]) >= least_context}
    own = {s: {w: n for w, n in after[s].items() if n >= least} for s in often}

    def left(s):
        return len(own[s]) + sum(after[s].values()) - sum(own[s].values()), sum(after[s].values()) + len(own[s])

    def p(s, w):
        if not s:
            return root(w)
        rest, whole = left(s)
        return ((own[s].get(w, 0)) + rest * p(s[1:], w)) / whole

    stay = set()
    for s in often:
        rest, whole = left(s)
        gained = sum(n * math.log(((n - 1 + rest * p(s[1:], w)) / (whole - 1)) / p(s[1:], w)) for w, n in own[s].items())
        if others := sum(after[s].values()) - sum(own[s].values()):
            gained += others * math.log(max(rest - 1, 1) / max(whole - 1, 1))
        if own[s] and gained > gain * len(own[s]):
            stay |= {s[i:] for i in range(len(s))}
    out = []
    for text in asked:
        line = [*WORD.findall(lowered(text)), None]
        score = 0.0
        for i, w in enumerate(line):
            state = next((s for k in range(min(depth, i), 0, -1) if (s := tuple(line[i - k : i])) in stay), ())
            score += math.log10(p(state, w))
        out.append((len(line), sum(count[w] > 0 for w in line), total, sum(math.log10(root(w)) for w in line), score))
    return out, stay


@pytest.mark.parametrize("context_share, symbol_share", [(1e-5, 1e-6), (0.0006, 0.0003), (0.001, 0.0005)])
def test_suffix_tree_matches_dictionaries(spark, context_share, symbol_share):
    docs = made(3, 500)
    rows = spark.createDataFrame(docs, SCHEMA).repartition(4).withColumns({c: F.lit("z") for c in ("word", "row", "n", "held_out", "rare", "base")})
    got = suffix_tree.score_texts(rows, context_share=context_share, symbol_share=symbol_share).collect()
    learnt = [t or "" for d, t, *_ in docs if d is not None and zlib.crc32(str(d).encode()) % 10]
    want, stay = tree_by_hand(learnt, [t or "" for _, t, *_ in docs], context_share, symbol_share, 1.0)
    assert {len(s) for s in stay} == {1, 2, 3}
    expect = sorted(((d, d is not None and zlib.crc32(str(d).encode()) % 10 == 0, *x) for (d, *_), x in zip(docs, want, strict=True)), key=repr)
    found = sorted((tuple(r) for r in got), key=repr)
    assert [r[:5] for r in found] == [r[:5] for r in expect]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in expect], rtol=1e-9, atol=1e-6)


def test_held_out_texts_are_told_better_than_by_single_words(spark):
    rng = random.Random(2)
    after = {i: [rng.randrange(40) for _ in range(3)] for i in range(40)}
    rows = []
    for i in range(400):
        line = [rng.randrange(40)]
        for _ in range(30):
            line.append(rng.choice(after[line[-1]]))
        rows.append((i, " ".join(f"w{w}" for w in line)))
    got = suffix_tree.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out").collect()
    assert len(got) > 20 and all(r.score > 0.6 * r.base_score for r in got)


def test_suffix_tree_of_nothing(spark):
    rows = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    got = sorted(suffix_tree.score_texts(rows).collect(), key=lambda r: r.n_tokens)
    assert [tuple(r) for r in got] == [(None, False, 1, 0, 0, 0.0, 0.0), (None, False, 3, 0, 0, 0.0, 0.0)]
    assert suffix_tree.score_texts(rows.filter("false")).count() == 0
    one = suffix_tree.score_texts(spark.createDataFrame([(1, "a")], "doc_id long, text string")).first()
    assert (one.n_tokens, one.n_known, one.train_tokens) == (2, 2, 2) and math.isclose(one.score, 2 * math.log10(1.1 / 2.3), abs_tol=1e-8)
    with pytest.raises(ValueError):
        suffix_tree.score_texts(rows, symbol_share=1e-9)


def test_distributions_sum_to_one():
    ids = np.array([0, 1, 0, 1, 0, 2, 0, 1, -1, 0, 1, 2])
    keys = suffix_tree.contexts_at(ids, np.array([0, 6, 12]), 2)
    assert keys.tolist() == [-1, -1, 1, 1 << 20, 1, 1 << 20, -1, -1, 1, -1, -1, 1]
    base = np.log10(np.array([0.5, 0.25, 0.125]))
    sizes = pa.table({"context": [0, 1], "n": [10, 4]})
    entries = pa.table({"context": [0, 0, 1], "word": pa.array([1, 2, 0], pa.int32()), "n": [6, 2, 4]})
    level = suffix_tree._level(sizes, entries, None, base, 1, 0.0)
    own = {(int(k) >> 20, int(k) & 0xFFFFF): p for k, p in zip(level.keys, level.p, strict=True)}
    for context in (0, 1):
        seen = [w for c, w in own if c == context]
        assert math.isclose(sum(own[context, w] for w in seen) + level.left[context] * (1 - sum(10 ** base[w] for w in seen)), 1)


def distances_by_hand(docs: list[tuple], least: int, top: int) -> list[tuple]:
    count, held, groups = Counter(), Counter(), set()
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = LETTER.findall(lowered(text))
        count.update((lang, source, t) for t in found)
        held.update((lang, t) for t in set(found))
    out = []
    for lang in {lang for lang, _ in groups}:
        kept = [t for (x, t), n in held.items() if x == lang and n >= least]
        v, sources = len(kept), [s for x, s in groups if x == lang]

        def priced(counts):
            n = sum(counts.values())
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * v) for t in kept}

        own = {s: Counter({t: count[lang, s, t] for t in kept}) for s in sources}
        p, q = {s: priced(own[s]) for s in sources}, priced(sum((Counter(o) for o in own.values()), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            over = [(p[s][t] - q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", pairs), ("term", sorted(over, key=lambda r: (-r[0], r[1].encode()))[:top])):
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1].encode())), 1)]
    return sorted(out)


def test_distances_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES", 50)
    docs = made(5, 900) + [(5000 + i, f"w{i} only", "b", f"t{i}") for i in range(8)]
    rows = spark.createDataFrame(docs, SCHEMA).repartition(3).withColumns({c: F.lit("z") for c in ("term", "n", "block", "tile", "v", "part", "value", "rank")})
    want = distances_by_hand(docs, 30, 5)
    for block, tile in ((1024, 16), (4, 2), (7, 1)):
        monkeypatch.setattr(divergence, "BLOCK", block)
        monkeypatch.setattr(divergence, "TILE", tile)
        assert sorted(map(tuple, divergence.audit(rows, 5).collect())) == want
    assert divergence.audit(rows.filter("false")).count() == 0


def test_large_counts_are_exact():
    ns = np.array([0, 3, 40_000_000_000_000], np.int64)
    assert divergence.prices(ns, 40_000_000_000_003, 3).tolist() == [1 + 10**9 * (n + 5) // (40_000_000_000_003 + 15) for n in ns.tolist()]
    none = np.zeros(0, np.int32), np.zeros(0, np.int64), 7
    assert divergence.distance(none, none) == (0, 0)
    assert divergence.distance(none, (np.array([1, 4]), np.array([9, 3]), 2)) == (6, 2)


def test_sources_are_paired_alike_in_every_block():
    columns = {"source": ["b", "a", "c"], "tile": [0, 0, 0], "total": [4, 6, 9], "v": [2, 2, 2], "ids": [[1], [1, 2], [2]], "ns": [[4], [1, 5], [9]]}
    key = tuple(pa.scalar(k) for k in ("en", 0, 0, 0))
    table = pa.table(columns)
    one, other = (divergence._merged(key, t).to_pylist() for t in (table, table.take([2, 0, 1])))
    in_order = [sorted(rows, key=lambda r: (r["a"], r["b"])) for rows in (one, other)]
    assert in_order[0] == in_order[1] and [(r["a"], r["b"]) for r in in_order[0]] == [("a", "b"), ("a", "c"), ("b", "c")]
