"""Log probabilities of texts by a probabilistic suffix tree that is learnt from the documents.

Words are hashed to 64 bits and counted over all training documents. Contexts are words, pairs and triples of words that
make up a share of all tokens (CONTEXT_SHARE); their next words are counted level by level, again over all training
documents, and those that make up SYMBOL_SHARE of all tokens get probabilities of their own. The rest of a context's mass
goes to its suffix's distribution, as does one count for each of its words (Witten and Bell); at the root stands the
smoothed share of a word in all tokens. A context stays in the tree if its distribution diverges from that of its suffix:
if the logarithmic likelihood of its next words, each taken out of the counts in turn, is higher by GAIN nats a word than
under the suffix. Suffixes of contexts that stay also stay. A token is scored in its longest suffix state.

As thresholds are shares of all tokens, a level has at most 1 / CONTEXT_SHARE contexts and 1 / SYMBOL_SHARE entries at any
size of the input; that bounds what every task is sent. Counts of words have no such bound: words under SYMBOL_SHARE are
joined by their hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm.labelled import crc_remainder
from papyrine.llm.textbytes import slices, utf8, word_hashes, word_spans
from papyrine.storage import materialize

#: Least shares of all training tokens: of a context, and of a word or of a word in a context.
CONTEXT_SHARE, SYMBOL_SHARE = 1e-5, 1e-6
#: Words of the longest context. Three numbers of 20 bits fit into a long.
DEPTH, BITS = 3, 20
#: Nats a word of a context by which it must beat its suffix.
GAIN = 1.0
#: Added to every count at the root.
ADDED = 0.1
#: Logarithms are summed as whole parts of this, so that sums don't depend on their order.
UNIT = 1_000_000_000
#: The token at the end of every text.
END = np.uint64(0x5851F42D4C957F2D)
#: Keys that a task gathers before it counts them.
GATHERED = 1 << 22


@dataclass
class Level:
    """Contexts of one length, sorted, the share that each leaves to its suffix, its entries' probabilities, and which stay."""

    contexts: np.ndarray
    left: np.ndarray
    keys: np.ndarray  # place of the context << BITS | next word, sorted
    p: np.ndarray
    stays: np.ndarray


@dataclass
class Tree:
    """Frequent words by hash with their base logarithms, and by length contexts, logs of what they leave, entries, their logs."""

    words: np.ndarray
    base: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def base_log(c: int, tokens: int, distinct: int) -> float:
    return math.log10((c + ADDED) / (tokens + ADDED * (distinct + 1)))


def score_texts(docs: DataFrame, modulus: int = 10, depth: int = DEPTH, context_share: float = CONTEXT_SHARE, symbol_share: float = SYMBOL_SHARE, gain: float = GAIN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    Null and empty texts have one token, the end. Rows with a null doc_id have no remainder: they aren't held out and
    nothing is learnt from them. Repeated rows count and are scored as often as they occur. If there is nothing to learn
    from, every token has a log probability of 0. Other columns are ignored; no rows give none.
    """
    held_out = F.coalesce(crc_remainder(modulus) == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = rows.filter(crc_remainder(modulus) != 0).select("text")
    counts = materialize(training.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "suffix-words")
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tree = learn(training, counts, tokens, distinct, depth, context_share, symbol_share, gain)
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    scored = rows.withColumn("held_out", held_out).mapInArrow(_score(shared), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base long, score long, rare array<long>, times array<int>")
    scored = materialize(scored, "suffix-scores")
    part = F.round(F.log10((F.coalesce("n", F.lit(0)) + ADDED) / F.lit(tokens + ADDED * (distinct + 1))) * UNIT).cast("long")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(counts.filter(F.col("n") < _least(symbol_share, tokens)), "word", "left")
    sums = found.groupBy("row").agg(F.sum(F.col("times") * part).alias("part"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"))
    whole = scored.drop("rare", "times").join(sums, "row", "left")

    def total(name: str) -> Column:
        return ((F.col(name) + F.coalesce("part", F.lit(0))) / F.lit(float(UNIT))).alias(name if name == "score" else f"{name}_score")

    if not tokens:
        return scored.select("doc_id", "held_out", "n_tokens", F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    known = (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known")
    return whole.select("doc_id", "held_out", "n_tokens", known, F.lit(tokens).cast("long").alias("train_tokens"), total("base"), total("score"))


def _least(share: float, tokens: int) -> int:
    return max(2, math.ceil(share * tokens))


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a column, an end after each text, and where each text begins (n + 1 values)."""
    data, offsets = utf8(column)
    starts, ends, first = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return np.insert(hashes, first[1:], END), first + np.arange(len(first))


def _counted(parts: list[np.ndarray], schema: list[str], split):
    """A batch of the distinct keys of the parts with their numbers."""
    keys, n = np.unique(np.concatenate(parts), return_counts=True)
    return pa.RecordBatch.from_arrays([*map(pa.array, split(keys)), pa.array(n)], schema)


def _gathered(batches, keys_of, schema, split):
    parts, size = [], 0
    for batch in batches:
        for part in slices(batch.column(0)):
            got = keys_of(batch.column(0).slice(*part))
            parts.append(got)
            size += len(got)
            if size >= GATHERED:
                yield _counted(parts, schema, split)
                parts, size = [], 0
    if parts:
        yield _counted(parts, schema, split)


def _count_words(batches):
    return _gathered(batches, lambda column: _tokens(column)[0].view(np.int64), ["word", "n"], lambda keys: [keys])


def frequent(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of words that occur least times or more: no more than a share of all tokens allows."""
    got = counts.filter(F.col("n") >= least).toArrow()
    words, n = (got.column(c).to_numpy() for c in ("word", "n"))
    order = np.argsort(words.view(np.uint64))
    return words.view(np.uint64)[order], n[order]


def symbols(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The number of each token's word among the frequent ones, -1 for others."""
    if not len(words):
        return np.full(len(hashes), -1, np.int64)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return np.where(words[at] == hashes, at, -1)


def contexts_at(ids: np.ndarray, begins: np.ndarray, length: int) -> np.ndarray:
    """For each token the key of the length tokens before it in its text, -1 where these are fewer or not all frequent."""
    keys = np.zeros(len(ids), np.int64)
    place = np.arange(len(ids)) - np.repeat(begins[:-1], np.diff(begins))
    good = place >= length
    for back in range(length, 0, -1):
        before = np.roll(ids, back)
        good &= before >= 0
        keys = keys << BITS | before
    return np.where(good, keys, -1)


def learn(training: DataFrame, counts: DataFrame, tokens: int, distinct: int, depth: int, context_share: float, symbol_share: float, gain: float) -> Tree:
    """The tree. Counting is over all training texts; what comes here is bounded by the shares."""
    if symbol_share * (1 << BITS) < 1 or context_share < symbol_share or depth * BITS > 60:
        raise ValueError("contexts must be numbered in 60 bits, and their words be frequent")
    if not tokens:
        return Tree(np.zeros(0, np.uint64), np.zeros(0), [])
    words, n = frequent(counts, _least(symbol_share, tokens))
    base = np.log10((n + ADDED) / (tokens + ADDED * (distinct + 1)))
    least_context, least_entry = _least(context_share, tokens), _least(symbol_share, tokens)
    contexts = np.flatnonzero((n >= least_context) & (words != END))
    levels: list[Level] = []
    for length in range(1, depth + 1):
        if not len(contexts):
            break
        events = training.mapInArrow(_count_next(words, contexts, length), "context long, word int, n long")
        events = materialize(events.groupBy("context", "word").agg(F.sum("n").alias("n")), f"suffix-level{length}")
        sizes = events.groupBy("context").agg(F.sum("n").alias("n")).toArrow()  # a row for each context
        entries = events.filter((F.col("n") >= least_entry) & (F.col("word") >= 0)).toArrow()
        levels.append(_level(sizes, entries, levels[-1] if levels else None, base, length, gain))
        context, word, n = (entries.column(c).to_numpy() for c in ("context", "word", "n"))
        more = (n >= least_context) & (words[word] != END)
        contexts = np.sort(context[more] << BITS | word[more])
    return Tree(words, np.rint(base * UNIT).astype(np.int64), _closed(levels))


def _count_next(words: np.ndarray, contexts: np.ndarray, length: int):
    def keys_of(column):
        hashes, begins = _tokens(column)
        ids = symbols(hashes, words)
        keys = contexts_at(ids, begins, length)
        at = np.minimum(np.searchsorted(contexts, keys), len(contexts) - 1)
        good = contexts[at] == keys
        return at[good] << (BITS + 1) | (ids[good] + 1)

    mask = (1 << (BITS + 1)) - 1
    return lambda batches: _gathered(batches, keys_of, ["context", "word", "n"], lambda k: [contexts[k >> (BITS + 1)], ((k & mask) - 1).astype(np.int32)])


def _level(sizes: pa.Table, entries: pa.Table, parents: Level | None, base: np.ndarray, length: int, gain: float) -> Level:
    """Distributions of the contexts of one length, smoothed by their suffixes', and which of them diverge from these."""
    order = np.argsort(sizes.column("context").to_numpy())
    contexts, total = (sizes.column(c).to_numpy()[order] for c in ("context", "n"))
    place = np.searchsorted(contexts, entries.column("context").to_numpy())
    word, n = entries.column("word").to_numpy().astype(np.int64), entries.column("n").to_numpy()
    order = np.argsort(place << BITS | word)
    place, word, n = place[order], word[order], n[order]
    if parents is None:
        under = 10 ** base[word]
    else:
        above = np.searchsorted(parents.contexts, _suffix(contexts[place], length))
        under = parents.p[np.searchsorted(parents.keys, above << BITS | word)]
    kinds = np.bincount(place, minlength=len(contexts))
    kept = np.bincount(place, weights=n, minlength=len(contexts))
    left, whole = kinds + total - kept, total + kinds
    p = (n + left[place] * under) / whole[place]
    # The same with the occurrence itself taken out, against the suffix.
    without = (n - 1 + left[place] * under) / (whole[place] - 1)
    gained = np.bincount(place, weights=n * np.log(without / under), minlength=len(contexts))
    others = total - kept
    rest = np.where(others > 0, others * np.log(np.maximum(left - 1, 1) / np.maximum(whole - 1, 1)), 0)
    return Level(contexts, left / whole, place << BITS | word, p, (kinds > 0) & (gained + rest > gain * kinds))


def _suffix(contexts: np.ndarray, length: int) -> np.ndarray:
    return contexts & ((1 << (BITS * (length - 1))) - 1)


def _closed(levels: list[Level]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The contexts that stay and all their suffixes, with whole parts of UNIT as logarithms."""
    for length in range(len(levels), 1, -1):
        level, above = levels[length - 1], levels[length - 2]
        above.stays[np.searchsorted(above.contexts, _suffix(level.contexts[level.stays], length))] = True
    out = []
    for level in levels:
        moved = np.cumsum(level.stays) - 1
        place = level.keys >> BITS
        good = level.stays[place]
        keys = moved[place[good]] << BITS | (level.keys[good] & ((1 << BITS) - 1))
        out.append((level.contexts[level.stays], _units(level.left[level.stays]), keys, _units(level.p[good])))
    return out


def _units(p: np.ndarray) -> np.ndarray:
    return np.rint(np.log10(p) * UNIT).astype(np.int64)


def state_logs(tree: Tree, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Base logs and logs in the longest suffix state of each token; the base part of words that aren't frequent is left out."""
    base = np.where(ids >= 0, tree.base[ids], 0) if len(tree.base) else np.zeros(len(ids), np.int64)
    logs = base
    for length, (contexts, left, keys, entry) in enumerate(tree.levels, 1):
        if not len(contexts):
            break
        key = contexts_at(ids, begins, length)
        at = np.minimum(np.searchsorted(contexts, key), len(contexts) - 1)
        here = contexts[at] == key
        wanted = at << BITS | np.maximum(ids, 0)
        found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = here & (ids >= 0) & (keys[found] == wanted)
        logs = np.where(hit, entry[found], np.where(here, logs + left[at], logs))
    return base, logs


def _score(shared):
    """For mapInArrow: sums of logs by row, and the words that aren't frequent, which are joined later."""

    def run(batches):
        from pyspark import TaskContext

        tree, row = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, size in slices(batch.column("text")):
                hashes, begins = _tokens(batch.column("text").slice(a, size))
                ids = symbols(hashes, tree.words)
                base, logs = state_logs(tree, ids, begins)
                sums = [np.add.reduceat(x, begins[:-1]) for x in ((ids >= 0).astype(np.int64), base, logs)]
                other = np.flatnonzero(ids < 0)
                text = np.searchsorted(begins, other, side="right") - 1
                pairs = np.stack([text, hashes[other].view(np.int64)], axis=1)
                order = np.lexsort((pairs[:, 1], pairs[:, 0]))
                pairs = pairs[order]
                first = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))[: len(pairs)])
                times = np.diff(first, append=len(pairs))
                offsets = np.searchsorted(pairs[first, 0], np.arange(size + 1))
                columns = [
                    pa.array(np.arange(row, row + size)), batch.column("doc_id").slice(a, size), batch.column("held_out").slice(a, size), pa.array(np.diff(begins)), *map(pa.array, sums),
                    pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(pairs[first, 1])), pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(times.astype(np.int32))),
                ]
                row += size
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "times"])

    return run
