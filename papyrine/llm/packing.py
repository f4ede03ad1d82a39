"""Best-fit packing of tokenized documents by patterns of lengths.

The histogram of piece lengths is all that planning needs. Lengths are put into classes of equal width; patterns of
up to DEPTH classes that fill a sequence are enumerated; non-negative least squares fits how often each pattern
repeats; counts are rounded, and kept to what there is. A pattern's least part is left open: the pieces that remain go,
longest first, into the best-fitting gaps of those sequences and then into new ones. As classes are coarser than lengths,
taking all fitted repeats can leave gaps that no piece fills; so the share of them that is taken is the one that needs the
fewest sequences, and best fit alone (no share) is among those that are tried. The plan is a list of runs of equal
placements, whose number depends on the capacity and not on the number of documents. Pieces find theirs by their rank among
the pieces of their length.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.blocks import running_sums
from papyrine.llm.textbytes import slices, utf8, word_hashes, word_spans
from papyrine.storage import materialize

CAPACITY = 4096
END_ID = 1
CLASSES = 48
DEPTH = 5
#: Shares of the fitted repeats that are tried; of those that need the fewest sequences the largest is taken.
SHARES = (1.0, 0.75, 0.5, 0.25, 0.1, 0.0)
#: Pieces of one length that are put in order together, about.
BLOCK_PIECES = 20_000
#: Words, and parts of words, whose ids a Python worker remembers.
REMEMBERED, REMEMBERED_PARTS = 600_000, 50_000


def _byte_letters() -> dict[int, str]:
    """Characters that stand for the bytes of letters in a byte-level vocabulary: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    stand = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
    return {c: "".join(stand[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


_LETTERS = "a-zß-öø-ÿ"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*").fullmatch


class WordIds:
    """Token ids by word, for tokenizers that drop white space and never join words across it.

    Words of printable ASCII and Latin-1 letters are split as the tokenizer's pattern does and sent to its BPE model
    directly; all others go through the whole tokenizer. Remembered words are told apart by a 64-bit hash.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bytes_of = _byte_letters()
        self.forget()

    def forget(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.pieces: dict[str, list[int]] = {}

    def _encode(self, word: str) -> list[int]:
        if "<|" in word or not _PLAIN(word):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        if len(self.pieces) > REMEMBERED_PARTS:
            self.pieces = {}
        ids: list[int] = []
        for piece in _PIECES.findall(word.lower()):
            got = self.pieces.get(piece)
            if got is None:
                got = self.pieces[piece] = [t.id for t in self.tokenizer.model.tokenize(piece.translate(self.bytes_of))]
            ids += got
        return ids

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and the number of ids of each word."""
        if len(self.hashes) > REMEMBERED:
            self.forget()
        distinct, first, which = np.unique(word_hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            ids = [self._encode(raw[a:b].decode("utf-8", "replace")) for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(counts) - counts))
            slots = len(self.counts) + np.arange(len(new))
            self.counts = np.concatenate((self.counts, counts))
            self.flat = np.concatenate((self.flat, np.fromiter((x for y in ids for x in y), np.uint32, int(counts.sum()))))
            self.hashes, self.slots = np.insert(self.hashes, at[new], distinct[new]), np.insert(self.slots, at[new], slots)
            at = np.searchsorted(self.hashes, distinct)
        slot = self.slots[at][which]
        counts = self.counts[slot]
        before = np.cumsum(counts) - counts
        return self.flat[np.repeat(self.starts[slot] - before, counts) + np.arange(int(counts.sum()))], counts


@functools.cache
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _piece_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    words = _word_ids(path)
    for batch in batches:
        for a, n in slices(batch.column(1)):
            part = batch.slice(a, n)
            data, offsets = utf8(part.column(1))
            starts, ends, first = word_spans(data, offsets)
            ids, counts = words.of(data, starts, ends) if len(starts) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            bounds = np.concatenate(([0], np.cumsum(counts)))[first]
            ids = np.insert(ids, bounds[1:], END_ID).astype("<u4")
            bounds = bounds + np.arange(len(bounds))
            lengths = np.diff(bounds)
            pieces = -(-lengths // capacity)
            row = np.repeat(np.arange(n), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, lengths[row] - start)
            begin = bounds[:-1][row] + start
            crc = np.fromiter((zlib.crc32(ids[x:y]) for x, y in zip(begin.tolist(), (begin + length).tolist(), strict=True)), np.int64, len(row))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def patterns(classes: int, depth: int) -> np.ndarray:
    """Rows of counts per class (class k at index k - 1): all multisets of up to depth classes that sum to classes."""
    found: list[list[int]] = []

    def extend(chosen: list[int], left: int, most: int) -> None:
        if left == 0:
            found.append(chosen)
        elif len(chosen) < depth:
            for k in range(min(left, most), 0, -1):
                if k * (depth - len(chosen)) < left:
                    break
                extend([*chosen, k], left - k, k)

    extend([], classes, classes)
    rows = np.zeros((len(found), classes), np.int64)
    for i, chosen in enumerate(found):
        for k in chosen:
            rows[i, k - 1] += 1
    return rows


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, weights: np.ndarray, steps: int = 300) -> np.ndarray:
    """x >= 0 that brings weights * (a x - b) near 0, by accelerated projected gradients."""
    wa, wb = a * weights[:, None], b * weights
    v = np.ones(a.shape[1])
    for _ in range(30):
        v = wa.T @ (wa @ v)
        v /= np.linalg.norm(v)
    rate = 1 / max(1e-12, 1.02 * np.linalg.norm(wa.T @ (wa @ v)))
    x = np.full(a.shape[1], 0.0)
    y, t = x, 1.0
    for _ in range(steps):
        z = np.maximum(0, y - rate * (wa.T @ (wa @ y - wb)))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if (y - z) @ (z - x) > 0:
            s, y = 1.0, z
        else:
            y = z + (t - 1) / s * (z - x)
        x, t = z, s
    return x


def plan_packs(histogram: dict[int, int], capacity: int = CAPACITY, classes: int = CLASSES, depth: int = DEPTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, offset), and the number of sequences.

    The pieces of a length with ranks from first rank on, count of them, go to as many consecutive sequences, at offset.
    There are never more sequences than best fit makes of the same pieces.
    """
    rows, repeats = fitted_repeats(histogram, capacity, classes, depth)
    best: tuple[list[tuple[int, int, int, int, int]], int] | None = None
    least = -(-sum(n * c for n, c in histogram.items()) // capacity)
    for share in SHARES:
        plan = place(histogram, rows, np.floor(share * repeats + 0.5).astype(np.int64), capacity, classes)
        if best is None or plan[1] < best[1]:
            best = plan
        if best[1] == least:
            break
    return best


def fitted_repeats(histogram: dict[int, int], capacity: int, classes: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The patterns, and how often each is to be repeated to use up the pieces of every class."""
    width = -(-capacity // classes)
    available = np.zeros(classes, np.int64)
    for n, c in histogram.items():
        available[-(-n // width) - 1] += c
    rows = patterns(classes, depth)
    if not available.sum():
        return rows, np.zeros(len(rows))
    weights = np.where(np.arange(1, classes + 1) * 16 <= classes, 0.1, 1.0) / np.sqrt(1 + available)
    return rows, nonnegative_least_squares(rows.T.astype(float), available.astype(float), weights)


def place(histogram: dict[int, int], rows: np.ndarray, repeat: np.ndarray, capacity: int, classes: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The plan that takes each pattern as often as repeat says, as far as pieces go, and best fit for the others."""
    left = {n: c for n, c in histogram.items() if c}
    width = -(-capacity // classes)
    used: dict[int, int] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # by free space: first sequence and count
    sequences = 0

    def take(length: int, count: int, sequence: int, offset: int) -> None:
        first = used.get(length, 0)
        runs.append((length, first, count, sequence, offset))
        used[length] = first + count
        left[length] -= count

    queue: dict[int, list[int]] = {}
    for n in sorted(left):
        queue.setdefault(-(-n // width), []).append(n)
    available = np.array([sum(left[n] for n in queue.get(k + 1, [])) for k in range(classes)], np.int64)
    if available.sum():
        for i in np.argsort(-repeat, kind="stable"):
            if repeat[i] <= 0:
                break
            parts = np.flatnonzero(rows[i])
            n = int(min(repeat[i], (available[parts] // rows[i][parts]).min()))
            if n <= 0:
                continue
            available[parts] -= n * rows[i][parts]
            sequence, open_runs = sequences, [(sequences, n, 0)]
            sequences += n
            chosen = np.repeat(parts + 1, rows[i][parts])[::-1]
            if len(chosen) > 1:  # the least part is chosen below, by its exact length
                available[chosen[-1] - 1] += n
                chosen = chosen[:-1]
            for k in chosen:
                placed, lengths = [], queue[int(k)]
                for first, count, offset in open_runs:
                    while count:
                        while not left[lengths[-1]]:
                            lengths.pop()
                        m = min(count, left[lengths[-1]])
                        take(lengths[-1], m, first, offset)
                        placed.append((first, m, offset + lengths[-1]))
                        first, count = first + m, count - m
                open_runs = placed
            for first, count, offset in open_runs:
                gaps.setdefault(capacity - offset, []).append((first, count))
    free = np.zeros(capacity + 1, bool)
    free[[g for g in gaps]] = True
    for n in sorted((n for n, c in left.items() if c), reverse=True):
        while left[n]:
            fits = np.flatnonzero(free[n:])
            if not len(fits):
                per = capacity // n
                opened, rest = divmod(left[n], per)
                for m, each in ((opened, per), (1 if rest else 0, rest)):
                    if m:
                        for j in range(each):
                            take(n, m, sequences, j * n)
                        gaps.setdefault(capacity - each * n, []).append((sequences, m))
                        free[capacity - each * n] = True
                        sequences += m
                break
            gap = n + int(fits[0])
            first, count = gaps[gap].pop()
            m = min(count, left[n])
            take(n, m, first, capacity - gap)
            gaps.setdefault(gap - n, []).append((first, m))
            free[gap - n] = True
            if m < count:
                gaps[gap].append((first + m, count - m))
            if not gaps[gap]:
                free[gap] = False
    return runs, sequences


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; the last id of a document is END_ID.

    tokenizer is the path of a tokenizers JSON file that each executor can read.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(lambda b: _piece_batches(b, tokenizer, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of docs.

    Null and empty texts are one piece of one id. Documents of more than capacity ids are cut into full pieces and a
    rest. Repeated rows are packed as often as they occur. Without rows the result is empty. Other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, tokenizer, capacity), "packing-pieces")
    # At most capacity rows come to the driver, whatever the input.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan_packs(histogram, capacity)
    # The number of runs is bounded by the capacity and the patterns, not by the documents: a broadcast is safe. Each
    # length's ranks are cut into buckets, about as many as it has runs, and a piece looks at the runs of its bucket only.
    of_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, *run in runs:
        of_length.setdefault(length, []).append(tuple(run))
    shapes, placing = [], []
    for length, own in of_length.items():
        wide = -(-histogram[length] // len(own))
        shapes.append((length, -(-histogram[length] // BLOCK_PIECES), wide))
        placing += [(length, bucket, *run) for run in own for bucket in range(run[0] // wide, (run[0] + run[1] - 1) // wide + 1)]
    shape = F.broadcast(spark.createDataFrame(shapes, "length long, blocks long, wide long"))
    plan = F.broadcast(spark.createDataFrame(placing, "length long, bucket long, first long, count long, sequence long, offset long"))
    ranked = pieces.join(shape, "length").withColumns({"_block": F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("blocks")), "_one": F.lit(1)})
    ranked = running_sums(ranked, ["length"], "_block", ["doc_id", "piece", "ids_crc32"], "_one", "_rank").withColumn("_rank", F.col("_rank") - 1)
    placed = ranked.withColumn("bucket", F.floor(F.col("_rank") / F.col("wide"))).join(plan, ["length", "bucket"]).filter("_rank >= first and _rank < first + count")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("_rank") - F.col("first")).alias("sequence_id"), "offset")
