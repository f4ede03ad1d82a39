"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, and a linear classifier.

Voters are words and beginnings of words that toxic documents of the training sample have far more often than others,
each with the count from which it speaks, pairs of neighbouring words that do, and a few patterns. Labels choose the
voters and give the share of toxic documents, and the label of a document is itself a voter and the starting point: votes
alone can settle on any other way of parting the documents. Voters whose votes correlate strongly are one voter with many
spellings, and of each the rates at which it speaks for toxic and for other documents are estimated by expectation
maximisation. A logistic classifier on counts and rates of the voters' cues learns the posteriors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.labelled import crc_remainder, labelled_sample
from papyrine.llm.textbytes import _LOWER, mix, slices, utf8, word_hashes, word_spans

#: Labelled documents of each label that are learned from, at most.
PER_CLASS = 4000
#: Cues at most.
CUES = 400
#: Bytes of word beginnings that can be cues.
BEGINNINGS = (4, 5, 6, 7, 8)
LEAST_DOCS, LEAST_LOG_ODDS = 4, 1.6
_POWERS = np.cumprod(np.full(16, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _cue_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the words, trimmed of punctuation, of their beginnings and of each with the next (0: none); each document's words; pattern values."""
    starts, ends, first = word_spans(data, offsets)
    full_starts, full_ends = starts, ends
    starts, ends = starts.copy(), ends.copy()
    for _ in range(4):
        ends -= (ends - starts > 1) & _PUNCTUATION[data[ends - 1]]
        starts += (ends - starts > 1) & _PUNCTUATION[data[starts]]
    found = [word_hashes(data, starts, ends)] if len(starts) else [np.zeros(0, np.uint64)]
    total = np.zeros(len(starts), np.uint64)
    for k in range(max(BEGINNINGS)):
        total = total + (_LOWER[data[np.minimum(starts + k, len(data) - 1)]] + np.uint64(1)) * _POWERS[k]
        if k + 1 in BEGINNINGS:
            found.append(np.where(ends - starts >= k + 1, mix(total ^ np.uint64(k + 1)), np.uint64(0)))
    pairs = np.zeros(len(starts), np.uint64)
    pairs[:-1] = mix(found[0][:-1] * np.uint64(3) + found[0][1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    last = first[1:] - 1
    pairs[last[last >= 0]] = 0  # a document's last word has no next one
    found.append(pairs)
    words = np.maximum(1, np.diff(first))

    def share(member: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(member)))[first]) / words

    if len(starts):
        shout = (data[starts] >= 65) & (data[starts] <= 90) & (data[ends - 1] >= 65) & (data[ends - 1] <= 90) & (ends - starts > 2)
        bang = data[full_ends - 1] == 33
        ends_odd = full_ends - ends >= 2
        patterns = np.stack([share(shout), share(bang), share(ends_odd)], axis=1)
    else:
        patterns = np.zeros((len(words), 3))
    return found, first, patterns


def _counts(column: pa.Array, cues: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of each cue in each document, number of words, pattern values. cues: sorted hashes."""
    tables = []
    light = np.zeros(1 << 16, bool)
    light[(cues & np.uint64(0xFFFF)).astype(np.int64)] = True
    for part in slices(column):
        data, offsets = utf8(column.slice(*part))
        found, first, patterns = _cue_hashes(data, offsets)
        n = len(offsets) - 1
        counts = np.zeros(n * len(cues), np.int64)
        of_doc = np.repeat(np.arange(n), np.diff(first))
        for h in found if len(cues) else []:
            some = np.flatnonzero(light[(h & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(cues, h[some]), len(cues) - 1)
            hit = cues[at] == h[some]
            counts += np.bincount(of_doc[some[hit]] * len(cues) + at[hit], minlength=len(counts))
        tables.append((counts.reshape(n, len(cues)), np.diff(first), patterns))
    if not tables:
        return np.zeros((0, len(cues)), np.int64), np.zeros(0, np.int64), np.zeros((0, 3))
    return tuple(np.concatenate(x) for x in zip(*tables, strict=True))


def _cue_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that have a cue, and the sum of these documents' hashes, by cue, over each batch."""
    for batch in batches:
        y, key = batch.column(2).to_numpy(), mix(batch.column(0).to_numpy().astype(np.int64).view(np.uint64))
        seen: list[tuple[np.ndarray, ...]] = []
        row = 0
        for part in slices(batch.column(1)):
            data, offsets = utf8(batch.column(1).slice(*part))
            found, first, _ = _cue_hashes(data, offsets)
            for d in range(len(offsets) - 1):
                own = np.unique(np.concatenate([h[first[d] : first[d + 1]] for h in found]))
                own = own[own != 0]
                seen.append((own, np.full(len(own), y[row]), np.full(len(own), key[row] >> np.uint64(24))))
                row += 1
        if seen:
            cue, toxic, docs = (np.concatenate([x[c] for x in seen]) for c in range(3))
            cues, which = np.unique(cue, return_inverse=True)
            held = np.zeros(len(cues), np.int64)
            np.add.at(held, which, docs.astype(np.int64))
            columns = [cues.view(np.int64), np.bincount(which, toxic, len(cues)).astype(np.int64), np.bincount(which, 1 - toxic, len(cues)).astype(np.int64), held]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["cue", "toxic", "other", "held"])


def _sample_batches(batches: Iterator[pa.RecordBatch], cues: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, words, patterns = _counts(batch.column(1), cues)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(words), pa.array(list(counts.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(patterns), pa.list_(pa.float64()))], ["doc_id", "y", "words", "counts", "patterns"])


def votes(counts: np.ndarray, patterns: np.ndarray, least: np.ndarray, pattern_limits: np.ndarray) -> np.ndarray:
    """1 where a voter speaks for toxic."""
    return np.concatenate((counts >= least, patterns > pattern_limits), axis=1).astype(float)


#: Voters with at least this correlation count as one.
SAME = 0.8


@dataclass(frozen=True)
class LabelModel:
    """What the votes alone tell. group: the joint voter of each voter; speaks: rates of speaking for other and toxic documents."""

    correlation: np.ndarray
    group: np.ndarray
    speaks: np.ndarray
    posterior: np.ndarray

    def accuracies(self, prior: float) -> np.ndarray:
        """The share of documents about which each joint voter is right."""
        return (1 - prior) * (1 - self.speaks[0]) + prior * self.speaks[1]


def joint_voters(correlation: np.ndarray, least: float = SAME) -> np.ndarray:
    """For each voter the number of its group: voters linked by correlations of at least least, directly or over others."""
    group = np.arange(len(correlation))
    near = (correlation >= least) | np.eye(len(correlation), dtype=bool)
    while True:
        new = np.where(near, group, len(group)).min(axis=1, initial=len(group)) if len(group) else group
        if (new == group).all():
            return np.unique(group, return_inverse=True)[1]
        group = new


def label_model(said: np.ndarray, prior: float, steps: int = 100, known: np.ndarray | None = None) -> LabelModel:
    """Rates of the joint voters and posterior probabilities of the label 1, from votes (document by voter) and its share.

    A joint voter speaks where half of its voters do. Documents with the most speaking voters, as many as prior says, are
    the first guess; rates and posteriors are then re-estimated in turn until they settle. Rates are drawn towards a
    voter's overall rate by one document's weight. Labels, if known, are the first guess instead and one voter more, which
    joins no other.
    """
    n = len(said)
    apart = said - said.mean(axis=0)
    spread = np.sqrt((apart**2).mean(axis=0))
    correlation = (apart.T @ apart / max(1, n)) / np.maximum(np.outer(spread, spread), 1e-12)
    group = joint_voters(correlation)
    member = np.eye(group.max(initial=-1) + 1)[group]
    votes = (2 * (said @ member) >= member.sum(axis=0)).astype(float)
    if known is None:
        spoken = votes.sum(axis=1)
        enough = max(1.0, np.sort(spoken)[::-1][min(n - 1, max(0, round(prior * n) - 1))])
        posterior = np.where(spoken >= enough, 0.9, 0.05)
    else:
        votes = np.column_stack((votes, known))
        posterior = np.where(known == 1, 0.9, 0.05)
    overall = votes.mean(axis=0)
    for _ in range(steps):
        speaks = np.stack([np.clip((p @ votes + overall) / (p.sum() + 1), 1e-4, 1 - 1e-4) for p in (1 - posterior, posterior)])
        z = np.log(prior / (1 - prior)) + votes @ np.log(speaks[1] / speaks[0]) + (1 - votes) @ np.log((1 - speaks[1]) / (1 - speaks[0]))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        moved = np.abs(new - posterior).max()
        posterior = new
        if moved < 1e-4:
            break
    return LabelModel(correlation, group, speaks, posterior)


def _inputs(counts: np.ndarray, words: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """Of each cue: whether and how often it occurs, and its rate per 100 words; of all cues: the sums; the patterns."""
    rate = np.minimum(100 * counts / np.maximum(1, words)[:, None], 10)
    total = counts.sum(axis=1, keepdims=True)
    return np.concatenate((np.minimum(counts, 1), np.log1p(counts), rate, np.log1p(total), np.minimum(100 * total / np.maximum(1, words)[:, None], 100) / 10, patterns), axis=1)


@dataclass(frozen=True)
class Model:
    cues: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        parts = []
        for a, n in slices(column):
            z = _inputs(*_counts(column.slice(a, n), self.cues)) @ self.weights + self.bias
            parts.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.concatenate(parts) if parts else np.zeros(0)


def fit_linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 2e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier of soft targets, by accelerated gradients."""
    scale = np.sqrt((weight[:, None] * x**2).sum(axis=0) / weight.sum()) + 0.05
    z = np.column_stack((x / scale, np.ones(len(x))))
    p = weight / weight.sum()
    v = np.ones(z.shape[1])
    for _ in range(20):
        v = z.T @ (p * (z @ v))
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * np.linalg.norm(z.T @ (p * (z @ v))) * 1.05 + ridge)
    keep = np.append(np.full(x.shape[1], ridge), 0.0)
    w = y = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(steps):
        g = z.T @ (p * (1 / (1 + np.exp(-np.clip(z @ y, -30, 30))) - target)) + keep * y
        new, s = y - rate * g, (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, w, t = new + (t - 1) / s * (new - w), new, s
    return w[:-1] / scale, float(w[-1])


def learn_toxicity(docs: DataFrame, labels: DataFrame, held_out, per_class: int = PER_CLASS) -> Model:
    """A model of documents for which held_out doesn't hold; labels.toxic chooses the voters and tells the share of toxic ones."""
    sample = labelled_sample(docs, labels, "toxic", held_out, per_class)
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(5), -2.0 if not sizes.get(1) else 2.0)
    share = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out).agg(F.avg("toxic")).first()[0]
    found = sample.mapInArrow(_cue_batches, "cue long, toxic long, other long, held long").groupBy("cue").agg(*(F.sum(c).alias(c) for c in ("toxic", "other", "held")))
    odds = F.log((F.col("toxic") + 0.5) / (sizes[1] - F.col("toxic") + 0.5)) - F.log((F.col("other") + 0.5) / (sizes[0] - F.col("other") + 0.5))
    best = found.filter(F.col("toxic") >= LEAST_DOCS).withColumn("odds", odds).filter(F.col("odds") >= LEAST_LOG_ODDS)
    # Spellings that the same documents have say the same: one of them is enough, so that rarer cues have room.
    best = best.groupBy("toxic", "other", "held", "odds").agg(F.min("cue").alias("cue"))
    best = best.orderBy((F.col("odds") * F.sqrt(F.col("toxic"))).desc(), "cue").limit(CUES).collect()
    cues = np.sort(np.array([r["cue"] for r in best], np.int64).view(np.uint64))

    # At most 2 * per_class rows of CUES counts come to the driver.
    rows = sample.mapInArrow(lambda b: _sample_batches(b, cues), "doc_id long, y int, words long, counts array<int>, patterns array<double>").toArrow()
    y, words = rows.column("y").to_numpy(), rows.column("words").to_numpy()
    counts = rows.column("counts").combine_chunks().flatten().to_numpy().reshape(len(y), len(cues)).astype(np.int64)
    patterns = rows.column("patterns").combine_chunks().flatten().to_numpy().reshape(len(y), 3)
    order = np.lexsort((counts.sum(axis=1), words, y, rows.column("doc_id").to_numpy()))
    y, words, counts, patterns = y[order], words[order], counts[order], patterns[order]

    # The sample was drawn by label, so its documents weigh by how rarely their label was drawn.
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    least = np.ones(len(cues), np.int64)
    for k in range(len(cues)):  # the count from which a cue tells most
        gains = [((counts[y == 1, k] >= n).mean() - (counts[y == 0, k] >= n).mean(), -n) for n in (1, 2, 3)]
        least[k] = -max(gains)[1]
    said = votes(counts, patterns, least, np.quantile(patterns, 0.98, axis=0))
    told = label_model(said, float(np.clip(y.mean(), 0.01, 0.99)), known=y)
    weights, bias = fit_linear(_inputs(counts, words, patterns), told.posterior, weight)
    return Model(cues, weights, bias)


def _score_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1)))], ["doc_id", "score"])


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return chosen.mapInArrow(lambda b: _score_batches(b, model), "doc_id long, score double")


#: The labels that are learned from: those of documents whose remainder isn't 0.
FOLDS = 5


def classify_toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); other columns are ignored.

    Labels count where crc32 of the doc_id's text modulo FOLDS isn't 0. Rows without a doc_id have a null held_out.
    Null and empty texts have no cues and get the score of that. Without labels of both kinds all scores are alike.
    """
    held_out = crc_remainder(FOLDS) == 0
    scored = score_toxicity(docs, learn_toxicity(docs, labels, held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def _clean_batches(batches: Iterator[pa.RecordBatch], model: Model, at: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(model.score(batch.column(at).cast(pa.string())) < least))


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all columns, that score below least. Learns as classify_toxicity does, from the same fold."""
    model = learn_toxicity(docs, labels, crc_remainder(FOLDS) == 0)
    at = docs.columns.index("text")
    return docs.mapInArrow(lambda b: _clean_batches(b, model, at, least), docs.schema)
