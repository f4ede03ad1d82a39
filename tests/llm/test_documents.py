"""Operators on documents against brute force, and their edge cases."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pytest

from pyspark.sql.functions import lit as F_lit

from papyrine.llm import components, license_scan, mixing, ngram_join, packing, quality_classifier, quality_rules, textbytes, toxicity
from papyrine.llm.labelled import labelled_sample

WORDS = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, kept int"


def frame(spark, texts, parts=3):
    rows = [(i, x, "en", f"s{i % 3}" if i % 7 else None, "clash", 1) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def shingles(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def linked(sets):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = collections.defaultdict(list)
    for i, x in enumerate(sets):
        for y in x:
            index[y].append(i)
    for i, x in enumerate(sets):
        for j, k in collections.Counter(j for y in x for j in index[y] if j > i).items():
            if 100 * k >= 80 * (len(x) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def edited(rng, words, n, vocabulary):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.5:
            words[i] = rng.choice(vocabulary)
        elif kind < 0.75 and len(words) > 1:
            del words[i]
        else:
            words.insert(i, rng.choice(vocabulary))
    return words


@pytest.mark.parametrize(("seed", "hot"), [(1, 24), (2, 3)])
def test_ngram_components_match_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    if seed == 2:  # as if there were very many sets, so that all that is spread over tasks is spread here
        for module, limits in ((ngram_join, {"SAMPLED": 1, "MANY_PAIRS": 3, "CELL": 4}), (components, {"MANY": 2})):
            for name, value in limits.items():
                monkeypatch.setattr(module, name, value)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(1500)]
    docs = []
    for _ in range(80):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 7, 8, 9, 12, 18, 30, 60]))]
        docs += [edited(rng, base, rng.choice([0, 0, 1, 2, 3]), vocabulary) for _ in range(rng.choice([1, 3, 8]))]
    base, passage = ([rng.choice(vocabulary) for _ in range(n)] for n in (150, 50))
    docs += [edited(rng, base, rng.choice([1, 2, 3, 4, 5, 6]), vocabulary) for _ in range(80)]
    docs += [passage + [rng.choice(vocabulary) for _ in range(rng.choice([5, 10, 20, 80]))] for _ in range(120)]
    rng.shuffle(docs)
    texts = [" ".join(w) for w in docs] + [None, "", " \n", "ONE two", "one\tTWO", "Äß x", "äß x"]
    sets = [shingles(x) for x in texts]
    got = ngram_join.ngram_components(frame(spark, texts)).toPandas().sort_values("doc_id")
    assert got.n_shingles.tolist() == [len(x) for x in sets]
    assert got.component_id.tolist() == linked(sets)


def test_ngram_links_at_the_threshold(spark, monkeypatch):
    """Pairs alone with each other, as similar as just links them; HOT is high, as if there were few sets."""
    monkeypatch.setattr(ngram_join, "HOT", 10_000)
    rng = random.Random(7)
    texts = []
    for n in [5] * 500 + [6] * 100 + [7] * 100 + list(range(8, 26)) * 12:
        words = [f"v{rng.getrandbits(48)}" for _ in range(n + 4 + n // 4)]
        texts += [" ".join(words[: n + 4]), " ".join(words)]
    got = ngram_join.ngram_components(frame(spark, texts)).toPandas().sort_values("doc_id")
    assert got.component_id.tolist() == linked([shingles(x) for x in texts]) == [i - i % 2 for i in range(len(texts))]


def test_ngram_components_of_nothing(spark):
    assert ngram_join.ngram_components(frame(spark, ["x"]).filter("false")).count() == 0
    assert ngram_join.ngram_components(frame(spark, [None, ""])).count() == 2


def test_one_of_each_keeps_columns_and_one_row(spark):
    texts = ["a b c d e f g", "A b c d e f g", "other words stand here alone now", None]
    docs = frame(spark, texts)
    kept = ngram_join.one_of_each(docs.union(docs))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def test_shingle_sets_use_words_of_any_length():
    import pyarrow as pa

    texts = ["", None, "a", "x" * 5000, "a b\nc\x0bd e f", "é " * 9]
    sizes = [len(h) for h in textbytes.shingle_sets(pa.array(texts))]
    assert sizes == [len(shingles(x)) for x in texts]


def counts(text):
    w = WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def judged(docs):
    return quality_rules.judged(docs).select("row.*", *quality_rules._KEPT, "_q_kept").toPandas().set_index("doc_id").sort_index()


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(0)
    good = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()) + str(rng.randrange(99)) for _ in range(120)) for _ in range(60)]
    odd = [None, "", "a b a b a b a", "x " * 30, "line one here\nline one here\n\n \nline", "#" * 50 + " " + good[0].replace(" ", "## "), "a b c " * 40, "é ü\tß\n" * 3]
    texts = good + odd
    rows = judged(frame(spark, texts))
    got = rows[["_q_n_words", "_q_chars", "_q_symbols", "_q_dup_lines", "_q_repeats"]].values.tolist()
    assert got == [list(counts(x)) for x in texts]
    kept = rows["_q_kept"].tolist()
    assert all(kept[:60])
    assert not any(kept[60:])
    assert quality_rules.judged(frame(spark, ["x"]).filter("false")).count() == 0


def test_lines_keep_their_outer_white_space(spark):
    texts = [" a b\na b", "a b\na b ", "x\r\nx\r\n", "\tx\nx\n\tx", "\n\nx\ny\nx\n ", " \n ", "a b\na b"]
    rows = judged(frame(spark, texts))
    got = rows[["_q_n_words", "_q_chars", "_q_symbols", "_q_dup_lines", "_q_repeats"]].values.tolist()
    assert got == [list(counts(x)) for x in texts]
    assert rows["_q_dup_lines"].tolist() == [0, 0, 1, 1, 1, 0, 1]


def test_stages_keep_columns_of_any_name(spark):
    """Columns named as those that the stages add, repeated rows, nulls and an empty table."""
    words = [" ".join(f"w{(i * 7 + j * j) % 997}" for j in range(60 + i % 3)) for i in range(40)]
    names = ["times", "_size", "size", "_d", "_n", "_copy", "_again", "_q_words", "_q_kept", "_row", "row", "cls", "rep", "copy", "one", "nth"]
    extra = {c: F_lit(k).alias(c) for k, c in enumerate(names)}
    docs = frame(spark, [*words, None, ""]).drop("n_words", "kept").withColumns(extra)
    twice = docs.union(docs)
    good = quality_rules.keep_good(twice)
    assert good.columns == docs.columns and good.count() == 80
    one = ngram_join.one_of_each(twice)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == list(range(42))
    times = {r.doc_id: r.times for r in mixing.mix_sources(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and collections.Counter(r.doc_id for r in mixed.collect()) == {k: n for k, n in times.items() if n}
    assert {tuple(r[c] for c in names) for r in mixed.collect()} == {tuple(range(len(names)))}
    assert mixing.mixed_documents(twice).count() == sum(r.times for r in mixing.mix_sources(twice).collect())
    for stage in (quality_rules.keep_good, ngram_join.one_of_each, mixing.mixed_documents):
        assert stage(docs.filter("false")).count() == 0


def plain_mix(rows):
    """How often each of rows (doc_id, source, size) is taken, by (doc_id, source, size); targets and sizes by source."""
    import hashlib

    sizes = collections.defaultdict(int)
    for _, source, n in rows:
        sizes[source] += n
    weights = dict(zip(sorted(sizes, key=lambda x: (x is None, x)), [1, 2, 3] * 99, strict=False))
    target, left, free = {}, sum(sizes.values()), set(sizes)
    while True:
        share = left / sum(weights[x] for x in free)
        full = [x for x in free if share * weights[x] > 3 * sizes[x]]
        if not full:
            break
        for x in full:
            target[x] = 3 * sizes[x]
            left -= 3 * sizes[x]
            free.remove(x)
    target |= {x: weights[x] * left / sum(weights[y] for y in free) for x in free}

    def key(i):
        return hashlib.md5(str(i).encode()).hexdigest()

    queue, upto = [], collections.defaultdict(int)
    for i, source, n in sorted(rows, key=lambda r: (key(r[0]), r[0], r[2])):
        upto[source] += n
        if n:
            queue += [((p * sizes[source] + upto[source]) / target[source], "" if source is None else f".{source}", key(i), i, n, p, source) for p in range(3)]
    taken, sent = collections.Counter(), 0
    for _, _, _, i, n, _, source in sorted(queue, key=lambda x: x[:6]):
        sent += n
        if sent > sum(sizes.values()):
            break
        taken[i, source, n] += 1
    return taken, target, sizes


def test_mix_takes_as_plain_queueing_does(spark):
    """Many sources, some of one document, sizes and finish times that tie, repeated ids."""
    rng = random.Random(2)
    rows = [(i % 90, " ".join("w" * rng.choice([1, 1, 2, 5])), rng.choice([f"s{k}" for k in range(9)] + [None]), "en") for i in range(300)]
    rows += [(1000, "w " * 9, "only", "en"), (1001, None, "none", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.mix_sources(docs).collect()
    taken, target, sizes = plain_mix([(i, source, len((text or "").split())) for i, text, source, _ in rows])
    assert all(abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source] for r in got)
    found = collections.Counter()
    for r in got:
        found[r.doc_id, r.source, r.size] += r.times
    assert +found == taken


def test_mix_reaches_targets(spark):
    texts = [("w " * (1 + i % 50)).strip() for i in range(400)] + [None, ""]
    docs = frame(spark, texts)
    rows = mixing.mix_sources(docs).toPandas()
    assert len(rows) == 402 and rows.times.between(0, 3).all() and (rows.times[rows["size"] == 0] == 0).all()
    total = rows["size"].sum()
    by = rows.assign(source=rows.source.fillna("~"), taken=rows["size"] * rows.times).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert abs(by.target.sum() - total) < 1e-6 and (by.target <= 3 * by["size"] + 1e-9).all()
    assert ((by.taken - by.target).abs() <= 51).all()
    assert by.taken.sum() <= total
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == rows.times.sum()
    twice = mixing.mixed_documents(docs.union(docs))
    assert twice.count() == mixing.mix_sources(docs.union(docs)).toPandas().times.sum()
    assert mixing.mix_sources(docs.filter("false")).count() == 0


TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_pieces_and_packs(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(3)
    texts = [None, "", "Ⅷ á <|endoftext|>x İ ½ ª", "x\x1cy 'LL don't <|ENDOFTEXT|>"]
    texts += [" ".join(rng.choice(["Hello,", "wörld!!", "tokens", "abc123", "naïve", "x" * 40]) for _ in range(rng.choice([3, 60, 500, 6000]))) for _ in range(40)]
    texts.append(texts[-1])
    rows = packing.pack_documents(frame(spark, texts), TOKENIZER).toPandas()
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = rows[rows.doc_id == i].sort_values("piece")
        assert own.start.tolist() == list(range(0, len(ids), 4096))
        assert own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + 4096].tobytes()) for a in own.start]
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 4096
    assert packing.pack_documents(frame(spark, ["x"]).filter("false"), TOKENIZER).count() == 0


def test_plans_place_every_piece_once():
    rng = np.random.default_rng(1)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(np.clip(rng.lognormal(6.5, 1, 30_000), 1, 4096).astype(int), return_counts=True), strict=True)}
    runs, sequences = packing.plan_packs(histogram)
    placed, used = collections.Counter(), collections.Counter()
    for length, first, count, sequence, _ in runs:
        assert first == placed[length]
        placed[length] += count
        for s in range(sequence, sequence + count):
            used[s] += length
    assert placed == histogram and max(used.values()) <= 4096 and len(used) == sequences
    assert sequences <= 1.01 * sum(k * v for k, v in histogram.items()) / 4096 + 1
    assert packing.plan_packs({}) == ([], 0) and packing.plan_packs({4096: 3})[1] == 3


def test_plans_need_no_more_sequences_than_best_fit():
    rng = np.random.default_rng(2)
    uniform = {n: 50 for n in range(1, 4097)}
    bimodal = {n: int(rng.integers(40)) for n in range(100, 400)} | {n: int(rng.integers(9)) for n in range(2500, 3600)}
    normal = collections.Counter(np.clip(rng.lognormal(6.2, 0.8, 20_000), 1, 4096).astype(int).tolist())
    for histogram in (uniform, bimodal, dict(normal), {2048: 7, 1: 3}, {5: 1}):
        rows, repeats = packing.fitted_repeats(histogram, packing.CAPACITY, packing.CLASSES, packing.DEPTH)
        alone = packing.place(histogram, rows, np.zeros(len(rows), np.int64), packing.CAPACITY, packing.CLASSES)[1]
        assert -(-sum(n * c for n, c in histogram.items()) // 4096) <= packing.plan_packs(histogram)[1] <= alone
    assert packing.plan_packs(uniform)[1] == 102_425


@pytest.mark.parametrize("places", [26, 60, 12])
def test_repeats_of_very_long_texts_are_exact(spark, monkeypatch, places):
    """Whether few bits of a hash are left to sort by, so that foreign windows stand between equal ones, or a text has more words than places."""
    monkeypatch.setattr(quality_rules, "_POSITIONS", places)
    rng = np.random.default_rng(3)
    for n, words in ((300_000, 70_000), (5_000, 40)):
        ids = rng.integers(words, size=n)
        grams = ids[:-2] * words * words + ids[1:-1] * words + ids[2:]
        _, which, seen = np.unique(grams, return_inverse=True, return_counts=True)
        covered = np.zeros(n, bool)
        at = np.flatnonzero(seen[which] > 1)
        for k in range(3):
            covered[at + k] = True
        docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in ids), "a", "b")], "doc_id long, text string, lang string, source string")
        row = quality_rules.judged(docs).first()
        assert (row._q_n_words, row._q_repeats) == (n, int(covered.sum()))


def test_licenses_are_found_whole_and_nearly_whole(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    long = "permission is hereby granted, free of charge, to any person obtaining a copy of THIS software and associated documentation files"
    filler = " ".join(f"word{i}" for i in range(300))
    texts = [None, "", "short", f"{filler} {notice} {filler}", f"{filler} {long}", f"{long.replace('software', 'thing')} {filler}", filler, f"{notice}\n{notice}"]
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(frame(spark, texts)).collect()}
    assert {d for d, x in got if x == "MIT"} >= {3, 4, 7} and not {d for d, _ in got} & {0, 1, 2, 6}
    none = spark.createDataFrame([], "license string, notice string")
    assert license_scan.scan_licenses(frame(spark, texts), none).count() == 0
    assert license_scan.scan_licenses(frame(spark, texts), spark.createDataFrame([(None, None), ("x", "too short")], "license string, notice string")).count() == 0
    assert license_scan.scan_licenses(frame(spark, texts).filter("false")).count() == 0


def license_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower()) if w]


def licenses_by_brute_force(texts, templates):
    """(row, licence): windows that hold 80% of a template, and the most shingles of one; every window is looked at."""
    out = {}
    for row, text in enumerate(texts):
        w = license_words(text)
        h = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        found = {}
        for name, notice in templates:
            v = license_words(notice)
            known = {tuple(v[i : i + 5]) for i in range(len(v) - 4)}
            t, step = len(known), -(-len(known) // 4)
            for start in range(0, len(h), step) if t else ():
                common = len(known & set(h[start : start + t + step]))
                if 100 * common >= 80 * t:
                    found[name, t, start] = max(found.get((name, t, start), 0), common)
        for (name, _, _), common in found.items():
            n, most = out.get((row, name), (0, 0))
            out[row, name] = n + 1, max(most, common)
    return out


@pytest.mark.parametrize("at_once", [2_000, 0])
def test_bands_recall_all_that_brute_force_finds(spark, monkeypatch, at_once):
    """Passages whole, with words changed, at the edge of 80%, repeated rows, long texts, odd and clashing columns."""
    monkeypatch.setattr(license_scan, "TEMPLATES_AT_ONCE", at_once)
    monkeypatch.setattr(license_scan, "PIECE", 64)
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(400)]
    templates = [(f"L{i % 7}", " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 6, 9, 14, 30, 80])))) for i in range(15)]
    texts = [None, "", " ... "]
    for _ in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 400]))]
        for _ in range(rng.choice([0, 1, 2, 5])):
            passage = license_words(rng.choice(templates)[1])
            passage = edited(rng, passage, rng.choice([0, 0, 1, 1, 2, 3]), vocabulary) if len(passage) > 6 else passage
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        texts.append(" ".join(words).upper() if rng.random() < 0.2 else ", ".join(words))
    texts.append(" ".join(rng.choice(templates)[1] for _ in range(200)))
    docs = frame(spark, texts).withColumnsRenamed({"lang": "license", "source": "shingle", "n_words": "h", "kept": "at"})
    table = spark.createDataFrame(templates, "license string, notice string")
    wanted = licenses_by_brute_force(texts, templates)
    got = {(r.doc_id, r.license): (r.n_windows, r.n_common) for r in license_scan.scan_licenses(docs, table).collect()}
    assert len(wanted) > 150 and got == wanted  # a recall of 1; 0.9 would do
    twice = {(r.doc_id, r.license): r.n_windows for r in license_scan.scan_licenses(docs.union(docs), table).collect()}
    assert twice == {k: 2 * n for k, (n, _) in wanted.items()}


def labelled(spark, rng):
    clean = [" ".join(rng.choice(["sun", "moon", "river", "stone", "field", "cloud"]) + str(rng.randrange(40)) for _ in range(rng.randrange(30, 200))) for _ in range(500)]
    toxic = rng.sample(range(500), 120)
    bad = rng.sample([i for i in range(500) if i not in toxic], 120)
    texts = list(clean)
    for i in toxic:
        w = texts[i].split()
        for _ in range(3):
            w.insert(rng.randrange(len(w)), rng.choice(["dolt", "Nitwit,", "rotter!"]))
        texts[i] = " ".join(w)
    for i in bad:
        texts[i] = texts[i].replace(" ", "%% ").upper()
    docs = frame(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, int(i not in bad), int(i in toxic)) for i in range(500)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_classifiers_on_held_out_documents(spark):
    docs, labels = labelled(spark, random.Random(5))
    for scored, label in ((toxicity.classify_toxicity(docs, labels), "toxic"), (quality_classifier.classify_quality(docs, labels), "quality")):
        rows = scored.toPandas()
        assert len(rows) == 502 and rows.score.between(0, 1).all()
        held = rows[rows.held_out].merge(labels.toPandas(), on="doc_id")
        assert len(held) > 50 and (held.predicted == held[label]).mean() > 0.97
    clean = toxicity.drop_toxic(docs, labels)
    assert clean.columns == docs.columns and 360 < clean.count() < 400
    none = labels.filter("false")
    assert toxicity.classify_toxicity(docs, none).count() == 502
    assert quality_classifier.classify_quality(docs, none).select("score").distinct().count() == 1


def test_pairwise_weights_match_a_plain_minimum():
    """The fitted weights leave no slope in the loss over the same pairs, and a plain descent gets to the same loss."""
    rng = np.random.default_rng(4)
    y = (rng.random(80) < 0.6).astype(int)
    x = rng.normal(0, 1, (80, 3)) + y[:, None] * np.array([0.8, -0.5, 0.0])
    model = quality_classifier.fit(x, y, 0.4, pairs=300, ridge=0.01)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    again = np.random.default_rng(0)
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -8, 8)
    pairs = list(zip(again.choice(good, 300), again.choice(bad, 300), strict=True))

    def loss(w):
        return sum(np.log1p(np.exp(-(z[i] - z[j]) @ w)) for i, j in pairs) / 300 + 0.005 * w @ w

    w, step = np.zeros(3), 1e-5
    for _ in range(400):
        w = w - 0.5 * np.array([(loss(w + step * e) - loss(w - step * e)) / (2 * step) for e in np.eye(3)])
    assert np.allclose(w, model.weights, atol=2e-3) and loss(model.weights) <= loss(w) + 1e-9
    order = np.sort(model.raw(x))
    assert order[0] < model.threshold < order[-1] and model.score(x[good]).mean() > model.score(x[bad]).mean()


def test_quality_learns_from_every_labelled_document(spark, monkeypatch):
    """Mean, threshold and weights are those of all labelled documents, in one part or in many with a rare label in each."""
    docs, labels = labelled(spark, random.Random(9))
    found = quality_classifier.quality_features(docs).localCheckpoint()
    rows = found.join(labels, "doc_id").toPandas()
    x, y = np.array(rows.x.tolist()), rows.quality.to_numpy()
    models = []
    for per_part, least in ((8192, 64), (50, 64), (50, 1)):
        monkeypatch.setattr(quality_classifier, "PER_PART", per_part)
        monkeypatch.setattr(quality_classifier, "LEAST", least)
        models.append(quality_classifier.learn_quality(found, labels, F_lit(False)))
        model = models[-1]
        assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-6))
        order = np.sort(model.raw(x))
        bad = int((y == 0).sum())
        assert np.isclose(model.threshold, order[bad - 1 : bad + 1].mean()) and ((model.score(x) >= quality_classifier.CUT) == y).mean() > 0.97
    # The weights leave no slope in the loss over the pairs of the one part.
    held = found.join(labels, "doc_id").selectExpr("xxhash64(doc_id) AS at", "doc_id", "quality AS y", "x").orderBy("at").toPandas()
    sums = quality_classifier._paired(held.y.to_numpy(), None, np.array(held.x.tolist()), models[0].mean, models[0].scale, models[0].weights)
    assert sums[-1] == 16 * (y == 1).sum() and np.allclose(sums[: x.shape[1]] / sums[-1] + 1e-3 * models[0].weights, 0, atol=1e-6)


def votes_of(rng, y, rates):
    return np.column_stack([rng.random(len(y)) < np.where(y == 1, a, b) for a, b in rates]).astype(float)


def test_label_model_finds_accuracies_from_votes_alone():
    rng = np.random.default_rng(0)
    y = (rng.random(6000) < 0.25).astype(int)
    rates = [(0.7, 0.05), (0.6, 0.02), (0.5, 0.05), (0.65, 0.1), (0.1, 0.1), (0.4, 0.01)]
    said = votes_of(rng, y, rates)
    one = said[:, :1]
    echoed = np.column_stack([one] * 5 + [said[:, 1:]])  # one cue in six spellings
    told = toxicity.label_model(echoed, y.mean())
    assert told.group[0] == told.group[4] and len(set(told.group.tolist())) == len(rates)
    assert np.abs(told.speaks.T[:, ::-1] - np.array(rates)).max() < 0.05
    assert np.allclose(told.posterior, toxicity.label_model(said, y.mean()).posterior, atol=0.02)
    wrong = (told.posterior > 0.5) != y
    assert 0 < wrong.mean() < 0.1  # votes differ from labels, and so do the posteriors


def test_label_model_matches_plain_expectation_maximisation():
    rng = np.random.default_rng(3)
    y = (rng.random(120) < 0.3).astype(int)
    said = votes_of(rng, y, [(0.8, 0.1), (0.7, 0.2), (0.6, 0.1), (0.5, 0.05)])
    prior, rows = 0.3, said.tolist()
    most = sorted((sum(r) for r in rows), reverse=True)[round(prior * len(rows)) - 1]
    p = [0.9 if sum(r) >= most else 0.05 for r in rows]
    overall = [sum(r[k] for r in rows) / len(rows) for k in range(4)]
    for _ in range(100):
        def rate(weights, k):
            return (sum(w * r[k] for w, r in zip(weights, rows, strict=True)) + overall[k]) / (sum(weights) + 1)

        yes, no = ([rate(w, k) for k in range(4)] for w in (p, [1 - x for x in p]))
        new = []
        for r in rows:
            a, b = prior, 1 - prior
            for k in range(4):
                a *= yes[k] if r[k] else 1 - yes[k]
                b *= no[k] if r[k] else 1 - no[k]
            new.append(a / (a + b))
        moved, p = max(abs(x - z) for x, z in zip(p, new, strict=True)), new
        if moved < 1e-4:
            break
    assert np.allclose(toxicity.label_model(said, prior).posterior, p, atol=1e-6)


def test_toxicity_ranks_by_label_when_only_neighbours_tell(spark):
    rng = random.Random(8)
    words, left, right = ([f"{k}{i}" for i in range(n)] for k, n in (("w", 60), ("left", 3), ("right", 3)))
    docs, labels = [], []
    for d in range(900):
        text, toxic = rng.choices(words, k=40), int(rng.random() < 0.2)
        a, b = rng.choice(left), rng.choice(right)
        text = [*text[:9], *((a, b) if toxic else (a, *text[9:20], b)), *text[20:]]
        docs.append((d, " ".join(text)))
        labels.append((d, toxic))
    rows = toxicity.classify_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).toPandas()
    rows["toxic"] = rows.doc_id.map(dict(labels))
    held = rows[rows.held_out]
    yes, no = (held.score[held.toxic == y].to_numpy() for y in (1, 0))
    assert (yes[:, None] > no[None, :]).mean() > 0.95


def test_labels_keep_the_label_model_from_parting_documents_otherwise():
    rng = np.random.default_rng(2)
    topic, y = ((rng.random(4000) < p).astype(int) for p in (0.2, 0.2))
    said = np.column_stack([votes_of(rng, topic, [(0.8, 0.05), (0.7, 0.04), (0.75, 0.1)]), votes_of(rng, y, [(0.6, 0.05), (0.5, 0.02)])])
    told = toxicity.label_model(said, 0.2, known=y)
    assert ((told.posterior > 0.5) == y).mean() > 0.95


def test_classifiers_on_odd_tables(spark):
    """Repeated rows, very long texts, clashing columns, conflicting labels and empty tables."""
    docs, labels = labelled(spark, random.Random(6))
    odd = spark.createDataFrame([(900, "dolt " * 40_000, "en", None, "c", 1), (901, "stone " * 200_000, "en", None, "c", 1), (None, "sun", None, None, None, None)], SCHEMA)
    renamed = {"lang": "score", "source": "held_out", "n_words": "y", "kept": "predicted"}
    many = docs.union(docs).union(docs).union(odd).withColumnsRenamed(renamed)
    both = labels.union(labels.selectExpr("doc_id", "quality", "0 AS toxic")).withColumn("text", F_lit("x"))
    for classify in (toxicity.classify_toxicity, quality_classifier.classify_quality):
        rows = classify(many, both).toPandas()
        assert len(rows) == 3 * 502 + 3 and rows.score.between(0, 1).all()
        assert rows.groupby("doc_id").score.nunique().max() == 1
        assert rows[rows.doc_id.isna()].held_out.isna().all()
        assert classify(docs.filter("false"), labels).count() == 0
    toxic = toxicity.classify_toxicity(many, both).toPandas().set_index("doc_id").score
    assert toxic[900] > 0.5 > toxic[901]
    sample = labelled_sample(docs.union(docs), labels, "toxic", F_lit(False), 50)
    assert sample.count() == 100 == sample.select("doc_id").distinct().count()


def plain_verdicts(rows):
    """Which of rows (doc_id, text, lang, source) the rules keep, from counts, rounded values and quartiles in plain Python."""
    limits = {"symbols": (30, None), "dup_lines": (400, None), "repeats": (100, None), "length": (1500, 1500)}
    seen, ratios = collections.defaultdict(list), {}
    for k, (_, text, lang, source) in enumerate(rows):
        n, chars, symbols, dup, repeats = counts(text)
        if n < 50 or 100 * repeats > 50 * n:
            continue
        lines = sum(1 for x in (text or "").split("\n") if WORDS.search(x))
        ratios[k] = {"symbols": 1000 * symbols // max(chars, 1), "dup_lines": 1000 * dup // max(lines, 1), "repeats": 1000 * repeats // n, "length": 1000 * chars // n}
        for name, v in ratios[k].items():
            v = v if v < 64 else v >> (v.bit_length() - 5) << (v.bit_length() - 5)
            for group in ((lang, source), (lang,), ()):
                seen[group, name].append(v)

    def fence(k, name):
        _, _, lang, source = rows[k]
        own = next(seen[g, name] for g in ((lang, source), (lang,), ()) if len(seen[g, name]) >= 50 or g == ())
        own = sorted(own)
        q1, q3 = (own[-(-part * len(own) // 4) - 1] for part in (1, 3))
        above, below = limits[name]
        return (q1 - 3 * (q3 - q1) - below if below is not None else 0), q3 + 3 * (q3 - q1) + above

    return {k for k, r in ratios.items() if all(fence(k, name)[0] <= v <= fence(k, name)[1] for name, v in r.items())}


def test_pipeline_matches_plain_python(spark, tmp_path):
    """All stages on a table with nulls, empty texts, repeated rows, copies and a clashing column; no labels, so none is toxic."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = random.Random(12)
    vocabulary = [f"{rng.choice(['stone', 'river', 'light', 'cloud'])}{i}" for i in range(900)]
    texts = []
    for _ in range(70):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([60, 120, 300]))]
        texts += [" ".join(words), *(" ".join(edited(rng, words, 2, vocabulary)) for _ in range(rng.choice([0, 0, 1, 3])))]
    texts += [None, "", "too short", "a b c " * 60, "## " * 40 + texts[0], "\n".join(["the same line again and again"] * 30), "word " * 9000]
    rows = [(i, x, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None])) for i, x in enumerate(texts)]
    rows += rows[:5]
    schema = "doc_id long, text string, lang string, source string"
    spark.createDataFrame(rows, schema).selectExpr("*", "7 AS times").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    kept = [rows[k] for k in sorted(plain_verdicts(rows))]
    label = linked([shingles(r[1]) for r in kept])
    least = {c: min(kept[k][0] for k, d in enumerate(label) if d == c) for c in set(label)}
    once = list({r[0]: r for k, r in enumerate(kept) if r[0] == least[label[k]]}.values())
    taken, _, _ = plain_mix([(i, source, len(WORDS.findall(text))) for i, text, _, source in once])
    tokenizer, wanted = Tokenizer.from_file(TOKENIZER), collections.Counter()
    for i, text, _, source in once:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for piece, a in enumerate(range(0, len(ids), 4096)):
            n = taken[i, source, len(WORDS.findall(text))]
            if n:
                wanted[i, piece, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())] += n
    assert len(once) < len(kept) < len(rows) and got == wanted
    empty = tmp_path / "none"
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
