"""A quality score learned from preference pairs by the Bradley-Terry model.

For a pair of a good and a bad document the model says that the good one wins with probability
1 / (1 + exp(-w . (x_good - x_bad))). w minimises the logistic loss over pairs in which every labelled document stands; the
threshold is the quantile of all labelled documents' scores at the share of bad ones. Labelled documents are dealt to parts by
a hash; tasks add up the slope and the curve of the loss over a part's pairs, and the driver sees these sums alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.labelled import crc_remainder
from papyrine.llm.textbytes import SPACES, slices, utf8, word_hashes, word_spans
from papyrine.operators.evaluation import quantiles
from papyrine.storage import materialize

#: Labelled documents of a part on average, and parts at most.
PER_PART, PARTS = 8192, 1024
#: Documents of the other label that each document of the more frequent one is paired with, at least; a part gets all of the
#: rarer label if there are fewer than LEAST a part.
RIVALS, LEAST = 16, 64
PAIRS = 40_000
#: The score that the threshold quantile is mapped to.
CUT = 0.7
_KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256), "pipe": b"|", "bang": b"!", "symbol": b"#*$%&<>@^~=+\\/_`{}[]",
    "stop": b".?;:", "comma": b",", "quote": b"\"'()", "line": b"\n",
}
FEATURES = [*_KINDS, "space", "log_words", "word_length", "word_spread", "short", "long", "distinct", "dup_grams", "dup_lines", "line_words", "empty"]


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text: shares of kinds of bytes, words' lengths, and repeats in the whole text."""
    rows = [_features(column.slice(*part)) for part in slices(column)]
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


def _features(column: pa.Array) -> np.ndarray:
    data, offsets = utf8(column)
    starts, ends, first = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    n = len(offsets) - 1
    size = np.maximum(1, np.diff(offsets))
    out = np.zeros((n, len(FEATURES)))
    for k, kind in enumerate([*_KINDS.values(), np.flatnonzero(SPACES)]):
        member = np.zeros(256, np.int64)
        member[list(kind)] = 1
        total = np.concatenate(([0], np.cumsum(member[data])))
        out[:, k] = np.diff(total[offsets]) / size
    k = len(_KINDS) + 1
    lengths = (ends - starts).astype(float)
    words = np.diff(first)
    some = np.maximum(1, words)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0.0], np.cumsum(values)))[first]) / some

    out[:, k] = np.log1p(words)
    out[:, k + 1] = mean(lengths)
    out[:, k + 2] = np.sqrt(np.maximum(0, mean(lengths**2) - out[:, k + 1] ** 2))
    out[:, k + 3] = mean(lengths <= 3)
    out[:, k + 4] = mean(lengths >= 14)
    grams = hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[2:] * np.uint64(0xC2B2AE3D27D4EB4F) if len(hashes) > 2 else hashes[:0]
    raw = data.tobytes()
    for d in range(n):
        a, b = first[d], first[d + 1]
        if b > a:
            out[d, k + 5] = len(np.unique(hashes[a:b])) / (b - a)
            if b - a > 2:
                g = grams[a : b - 2]
                out[d, k + 6] = 1 - len(np.unique(g)) / len(g)
            lines = [x for x in raw[offsets[d] : offsets[d + 1]].split(b"\n") if x.strip()]
            out[d, k + 7] = 1 - len(set(lines)) / len(lines)
            out[d, k + 8] = np.log1p((b - a) / len(lines))
    out[:, k + 9] = words == 0
    return out


@dataclass(frozen=True)
class Model:
    """score = logistic(logit(CUT) + slope * (w . standardised features - threshold))."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.log(CUT / (1 - CUT)) + self.slope * (self.raw(x) - self.threshold)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, bad_share: float, pairs: int = PAIRS, ridge: float = 1e-3, steps: int = 25) -> Model:
    """Newton steps on the loss over pairs drawn with a fixed seed. Without documents of both labels every score is CUT."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    width = x.shape[1]
    if not len(good) or not len(bad):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(0)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = _minimum(lambda w: _slope(diff, w), width, ridge, steps)
    raw = z @ w
    weight = np.where(y == 0, bad_share / len(bad), (1 - bad_share) / len(good))
    order = np.argsort(raw)
    at = int(np.searchsorted(np.cumsum(weight[order]), bad_share))
    threshold = float(raw[order[max(0, at - 1) : at + 1]].mean())
    gap = np.median(raw[good]) - np.median(raw[bad])
    return Model(mean, scale, w, threshold, float(8 / max(gap, 1e-6)))


def _slope(diff: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Slope and, flat, curve of the loss summed over pairs' differences, and their number."""
    p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
    return np.concatenate((diff.T @ (p - 1), ((diff * (p * (1 - p))[:, None]).T @ diff).ravel(), [len(diff)]))


def _minimum(sums: Callable[[np.ndarray], np.ndarray], width: int, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Newton steps on the mean loss; sums: of _slope."""
    w = np.zeros(width)
    for _ in range(steps):
        found = sums(w)
        gradient = found[:width] / found[-1] + ridge * w
        curve = found[width:-1].reshape(width, width) / found[-1] + ridge * np.eye(width)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column(2))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], ["doc_id", "h", "x"])


def quality_features(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), x (FEATURES) of every row; null texts are empty ones."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(_feature_batches, "doc_id long, h long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _packed(rows: pa.Table) -> pa.Table:
    """A part's documents as one row, in the same order whatever order they came in."""
    rows = rows.combine_chunks().sort_by([("at", "ascending"), ("doc_id", "ascending")])

    def whole(column: pa.Array, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column.cast(kind))

    y, own, x = (rows[c].combine_chunks() for c in ("y", "own", "x"))
    return pa.table({"part": rows["part"].slice(0, 1).combine_chunks(), "y": whole(y, pa.int32()), "own": whole(own, pa.bool_()), "x": whole(x.flatten(), pa.float64())})


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """part, y, own, x of packed rows."""
    for batch in batches:
        for k in range(batch.num_rows):
            y, own, x = (batch.column(c).slice(k, 1).flatten() for c in (1, 2, 3))
            yield batch.column(0)[k].as_py(), y.to_numpy(), own.to_numpy(zero_copy_only=False), x.to_numpy().reshape(-1, len(FEATURES))


def _summed(packed: DataFrame, of: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum over parts of what of(y, own, x) gives. Parts are added in order, so that reruns agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, *held in _parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([of(*held)], pa.list_(pa.float64()))], ["part", "v"])

    # A few hundred numbers of each part, at most PARTS, come to the driver.
    rows = packed.mapInArrow(run, "part int, v array<double>").toArrow().sort_by("part")
    return np.sum([np.array(v) for v in rows["v"].to_pylist()], axis=0)


def _paired(y: np.ndarray, own: np.ndarray, x: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> np.ndarray:
    """_slope over a part's pairs: each document of the more frequent label with RIVALS of the other, one after the other."""
    z = np.clip((x - mean) / scale, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    many, few = (good, bad) if len(good) >= len(bad) else (bad, good)
    total = np.zeros(len(w) * (len(w) + 1) + 1)
    if len(few):
        rivals = max(RIVALS, -(-len(few) // len(many)))
        sign = 1 if many is good else -1
        for t in range(rivals):
            total += _slope(sign * (z[many] - z[few[(np.arange(len(many)) * rivals + t) % len(few)]]), w)
    return total


def _deal(rows: DataFrame, n_bad: int, n_good: int) -> DataFrame:
    """part, y, own, x: labelled documents in parts, one row a part; own is false for what stands in other parts as well."""
    parts = min(PARTS, max(1, (n_bad + n_good) // PER_PART))
    home = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(parts)).cast("int")
    rare = int(n_good < n_bad)
    everywhere = F.sequence(F.lit(0), F.lit(parts - 1)) if min(n_bad, n_good) < LEAST * parts else F.array("home")
    dealt = rows.withColumn("home", home).withColumn("part", F.explode(F.when(F.col("y") == rare, everywhere).otherwise(F.array("home"))))
    dealt = dealt.select("part", "doc_id", F.xxhash64("doc_id").alias("at"), "y", (F.col("part") == F.col("home")).alias("own"), "x")
    return materialize(dealt.groupBy("part").applyInArrow(_packed, "part int, y array<int>, own array<boolean>, x array<double>"), "quality-parts")


def learn_quality(found: DataFrame, labels: DataFrame, held_out) -> Model:
    """A model from labels.quality of all documents for which held_out doesn't hold; found: of quality_features.

    Of conflicting labels of a document the greatest counts, of its repeated rows the text that is least by hash.
    """
    width = len(FEATURES)
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    rows = materialize(found.join(known, "doc_id").groupBy("doc_id", "y").agg(F.min_by("x", "h").alias("x")), "quality-labelled")
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0)
    n = sizes[0] + sizes[1]
    packed = _deal(rows, sizes[0], sizes[1])
    mean = _summed(packed, lambda y, own, x: x[own].sum(axis=0)) / n
    scale = np.maximum(np.sqrt(_summed(packed, lambda y, own, x: ((x[own] - mean) ** 2).sum(axis=0)) / n), 1e-6)
    w = _minimum(lambda w: _summed(packed, lambda y, own, x: _paired(y, own, x, mean, scale, w)), width)
    plain = Model(mean, scale, w, 0.0, 1.0)

    def raws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, y, own, x in _parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(y[own]), pa.array(plain.raw(x[own]))], ["y", "raw"])

    raw = materialize(packed.mapInArrow(raws, "y int, raw double"), "quality-raw")
    # Halfway between the scores that part as many documents as there are bad ones.
    threshold = quantiles(raw.withColumn("all", F.lit(1)), ["all"], "raw", {"cut": (sizes[0] - 0.5) / (n - 1)}).first()["cut"]
    middle = {r.y: r.mid for r in quantiles(raw, ["y"], "raw", {"mid": 0.5}).collect()}
    return Model(mean, scale, w, threshold, float(8 / max(middle[1] - middle[0], 1e-6)))


def score_quality(found: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row of quality_features; empty texts have features of their own and a score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], ["doc_id", "score"])

    return found.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); other columns are ignored.

    Labels count where crc32 of the doc_id's text modulo 4 isn't 2. Rows without a doc_id have a null held_out.
    Without any labels the score is CUT for all. Repeated rows are scored alike.
    """
    held_out = crc_remainder(4) == 2
    found = materialize(quality_features(docs), "quality-features")
    scored = score_quality(found, learn_quality(found, labels, held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
