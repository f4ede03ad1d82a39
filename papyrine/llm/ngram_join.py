"""N-gram Jaccard join by universe partitioning and the pigeonhole principle.

Two word-shingle sets r, s with Jaccard similarity t or more differ in at most
H(r, s) = floor((1 - t) / (1 + t) * (|r| + |s|)) elements. Sizes fall into bands. In a band the universe of
hashes is cut into m segments, and segment i is given an allocation v_i: 1 (its subset must be equal) or 2 (its
subset may differ by one element, found through one-deletion neighbours). If the allocations sum to V, similar
sets collect at least V - H(r, s) units of agreement over the segments, where a segment gives max(0, v_i - difference).
m and the number of segments with v = 2 are chosen per band by cost; V exceeds the least possible sum by some slack.
Signatures of empty subsets (of sets whose slack allows it), and those shared by more than HOT sets, get v = 0: they are counted as possible
agreement (z) instead of being joined, also where only one set of a pair skips them. Pairs that only skipped signatures could connect have z above the slack; such
sets are first each compared with the most central set of their signatures. Those that then still share a skipped
signature with another component are joined on their rarest shingles (prefix filtering), which loses no pair either.

All candidate pairs are verified on the whole sets. Sets are compared as 64-bit hashes of shingles.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.components import connected_components
from papyrine.llm.textbytes import mix, shingle_sets, slices
from papyrine.storage import materialize

#: Sets in a group with a common signature of which all pairs are compared at once.
HOT = 24
#: One set in so many is looked at to find signatures that very many sets share; sets of these are spread over SALTS tasks.
SAMPLED, SALTS = 64, 64
#: Very frequent signatures that are known to the tasks, at most; the less frequent ones meet in one task each.
SPREAD = 100_000
#: Sets with a common rare shingle that are compared in one cell.
CELL = 256
#: Least and next sizes of bands have about this ratio.
BAND_RATIO = 1.4
#: Cost of a segment with at most one element, in signatures.
WEAK_COST = 8.0
#: Up to this many ids of documents whose sets are needed are broadcast (8 MB); more are joined by a shuffle of texts.
BROADCAST_IDS = 1_000_000
_EXACT, _NEAR, _DELETED = 0, 1, 2


class Bands:
    """Size bands and their allocations for the threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self._plans: list[tuple[int, int, int, int]] = []  # least size, largest size, segments, segments with v = 2

    def differing(self, total):
        """H for the sum of two sizes; works for Columns' ints, ints and arrays."""
        return (self.den - self.num) * total // (self.den + self.num)

    def _grow(self, size: int) -> None:
        while not self._plans or self._plans[-1][1] < size:
            low = self._plans[-1][1] + 1 if self._plans else 1
            high = max(low, int(low * BAND_RATIO) - 1)
            needed = self.differing(2 * high) + 1
            total = needed if high <= 4 else needed + 1 + high // 24
            best = None
            for doubled in range(total // 2 + 1):
                m = total - doubled
                if doubled > m:
                    break
                k = high / m
                cost = m + doubled * k + WEAK_COST * m * np.exp(-k) * (1 + k) * (high > 4)
                if best is None or cost < best[0]:
                    best = (cost, m, doubled)
            self._plans.append((low, high, best[1], best[2]))

    def of(self, size: int) -> int:
        self._grow(size)
        lo, hi = 0, len(self._plans) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if self._plans[mid][1] >= size:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def plan(self, band: int) -> tuple[int, int, int, int]:
        while len(self._plans) <= band:
            self._grow(self._plans[-1][1] + 1 if self._plans else 1)
        return self._plans[band]

    def slack(self, size: int, band: int) -> int:
        """Units that may be skipped of a set without losing a pair: those beyond what any partner in the band needs."""
        _, high, m, doubled = self.plan(band)
        return m + doubled - 1 - self.differing(size + min(high, size * self.den // self.num))

    def joined_by(self, size: int) -> range:
        """Bands in which sets of this size meet sets as large or larger."""
        home = self.of(size)
        return range(home, self.of(size * self.den // self.num) + 1)


@functools.cache
def _bands(num: int, den: int) -> Bands:
    return Bands(num, den)


def _set_keys(h: np.ndarray) -> tuple[int, int]:
    n = np.uint64(len(h))
    a = mix(np.atleast_1d(mix(h).sum(dtype=np.uint64) + n))[0]
    b = mix(np.atleast_1d(mix(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) ^ a))[0]
    return int(a.view(np.int64)), int(b.view(np.int64))


def _class_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(len(h), *_set_keys(h)) for h in shingle_sets(batch.column(1), width)]
        n, a, b = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(a), pa.array(b)], ["doc_id", "n", "cls", "cls2"])


def _band_salt(band: int) -> np.ndarray:
    return np.array([band], np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _signatures(h: np.ndarray, band: int, bands: Bands) -> tuple[np.ndarray, np.ndarray, int]:
    """Signatures, their kinds, and the allocation of the empty segments: negative if they have signatures, not skipped."""
    _, _, m, doubled = bands.plan(band)
    segment = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    at = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    own = segment[at]
    mixed = mix(h)
    total, count = np.add.reduceat(mixed, at), np.diff(at, append=len(h))
    salt = mix(own + _band_salt(band))
    kinds = np.where(own < doubled, _NEAR, _EXACT)
    sigs = [mix((total + count.astype(np.uint64)) ^ salt)]
    near = int(np.searchsorted(own, np.uint64(doubled)))
    if near:
        stop = at[near] if near < len(at) else len(h)
        part = np.repeat(np.arange(near), count[:near])
        left = count[:near][part] - 1
        some = left > 0
        sigs.append(mix(((total[part] - mixed[:stop] + left.astype(np.uint64)) ^ salt[part])[some]))
        kinds = np.concatenate((kinds, np.full(int(some.sum()), _DELETED)))
    # Empty subsets, and the empty neighbours of subsets of one element, are skipped if the slack allows it.
    empty = m - len(own) + doubled - near + (int((~some).sum()) if near else 0)
    if empty > bands.slack(len(h), band):
        absent = np.setdiff1d(np.arange(m, dtype=np.uint64), own)
        sigs.append(mix(mix(absent + _band_salt(band))))
        kinds = np.concatenate((kinds, np.where(absent < doubled, _NEAR, _EXACT)))
        if near:
            sigs.append(mix(salt[part][~some]))
            kinds = np.concatenate((kinds, np.full(int((~some).sum()), _DELETED)))
        empty = -empty
    return np.concatenate(sigs), kinds, empty


def _signature_batches(batches: Iterator[pa.RecordBatch], width: int, num: int, den: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of sig, cls, n, z, tag (4 * band + kind, negative if not the set's own band) and salt, once per set and task.

    salt is -1, but for frequent signatures (sorted) a number that spreads their sets.
    """
    bands, seen = _bands(num, den), set()

    def table(parts: list[tuple]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        salt = np.full(len(columns[0]), -1)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, columns[0]), len(frequent) - 1)
            salt = np.where(frequent[at] == columns[0], columns[1] % SALTS, -1)
        return _columns([*columns, salt], "sig cls n z tag salt")

    for batch in batches:
        out: list[tuple] = []
        size = 0
        for h in shingle_sets(batch.column(0), width):
            if not len(h):
                continue
            cls = _set_keys(h)[0]
            if cls in seen:
                continue
            if len(seen) < 1_000_000:  # beyond that, repeated rows only meet after the shuffle
                seen.add(cls)
            for k, band in enumerate(bands.joined_by(len(h))):
                sigs, kinds, empty = _signatures(h, band, bands)
                tags = kinds + 4 * (band + 1)
                out.append((sigs.view(np.int64), np.full(len(sigs), cls), np.full(len(sigs), len(h)), np.full(len(sigs), empty), -tags if k else tags))
                size += len(sigs)
            if size > 50_000:
                yield table(out)
                out, size = [], 0
        if out:
            yield table(out)


def _columns(columns: list[np.ndarray], names: str) -> pa.RecordBatch:
    kinds = {"n": np.int32, "z": np.int32, "tag": np.int16, "salt": np.int16}
    return pa.RecordBatch.from_arrays([pa.array(c.astype(kinds.get(k, np.int64))) for k, c in zip(names.split(), columns, strict=True)], names.split())


_PAIR_NAMES = "hot sig a b na nb za zb band units"


def _group_batches(batches: Iterator[pa.RecordBatch], num: int, den: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Pairs of small groups and members of hot groups, from rows sorted by sig and cls. Groups with a salt are hot.

    Only the last group of a batch is carried over, and of a hot group only its first rows, so memory is bounded.
    """
    carry: list[np.ndarray] | None = None
    hot_sig: int | None = None  # the group that is known to be hot and goes on

    def members(cols: list[np.ndarray], rows: np.ndarray) -> tuple:
        sig, cls, n, z, tag = (c[rows] for c in cols[:5])
        kind = np.abs(tag) % 4
        one = np.zeros(len(sig), np.int64)
        return one + 1, sig, cls, one, n, one, z, one, np.abs(tag) // 4 - 1, np.where(kind == _NEAR, 2, 1)

    def groups(cols: list[np.ndarray], final: bool) -> tuple[list[tuple], list[np.ndarray] | None]:
        nonlocal hot_sig
        sig, cls = cols[0], cols[1]
        if len(sig) == 0:
            return [], None
        fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1]) | (np.abs(cols[4][1:]) % 4 != np.abs(cols[4][:-1]) % 4)))
        cols = [c[fresh] for c in cols]
        sig = cols[0]
        at = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        size = np.diff(at, append=len(sig))
        rest, out = None, []
        is_hot = (size > hot) | (cols[5][at] >= 0)
        if hot_sig is not None and sig[0] == hot_sig:
            is_hot[0] = True
        last = at[-1]
        if not final:
            if is_hot[-1]:
                hot_sig = int(sig[last])
            else:
                rest = [c[last:] for c in cols]
                size, at, is_hot = size[:-1], at[:-1], is_hot[:-1]
        if is_hot.any():
            out.append(members(cols, np.flatnonzero(np.repeat(is_hot, size))))
        for c in np.unique(size[(size > 1) & ~is_hot]):
            rows = at[(size == c) & ~is_hot][:, None] + np.arange(c)
            i, j = np.triu_indices(int(c), 1)
            x, y = rows[:, i].ravel(), rows[:, j].ravel()
            tx, ty = cols[4][x], cols[4][y]
            kx, ky = np.abs(tx) % 4, np.abs(ty) % 4
            nx, ny = cols[2][x].astype(np.int64), cols[2][y].astype(np.int64)
            ok = ((kx != _DELETED) | (ky != _DELETED)) & ((tx > 0) | (ty > 0)) & (cols[1][x] != cols[1][y]) & (num * np.maximum(nx, ny) <= den * np.minimum(nx, ny))
            x, y, kx, ky = x[ok], y[ok], kx[ok], ky[ok]
            swap = cols[1][x] > cols[1][y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            units = np.where((kx == _NEAR) & (ky == _NEAR), 2, 1)
            out.append((np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), cols[1][x], cols[1][y], cols[2][x], cols[2][y], cols[3][x], cols[3][y], np.abs(cols[4][x]) // 4 - 1, units))
        return out, rest

    def table(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        parts = [p for p in parts if len(p[0])]
        if parts:
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            kinds = [pa.int16(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int16(), pa.int16()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], _PAIR_NAMES.split())

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if carry is not None:
            cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
        out, carry = groups(cols, False)
        yield from table(out)
    if carry is not None:
        out, _ = groups(carry, True)
        yield from table(out)


def _set_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch.column(0)):
            sets = list(shingle_sets(batch.column(0).slice(*part), width))
            keys = pa.array([_set_keys(h)[0] for h in sets], pa.int64())
            offsets = np.concatenate(([0], np.cumsum([len(h) for h in sets]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], ["cls", "h"])


def shingle_classes(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n (size of the shingle set), and cls, cls2: two 64-bit hashes of the set."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda b: _class_batches(b, width), "doc_id long, n long, cls long, cls2 long")


def ngram_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable over links of Jaccard num / den or more.

    docs needs doc_id and text; other columns are ignored. Null and wordless texts have an empty set, which links
    with nothing, not even another empty set. Texts with fewer than width words have one shingle. Equal sets link,
    so repeated rows of a doc_id give repeated rows with the same component. Rows without a doc_id keep their
    row, take part as copies and links, and have the component of the others or null.
    """
    spark = docs.sparkSession
    bands = _bands(num, den)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    of_docs = materialize(shingle_classes(text, width), "ngram-classes")
    classes = materialize(of_docs.filter("n > 0").groupBy("cls", "cls2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")).filter("rep is not null"), "ngram-reps")

    texts = text.filter(F.col("text").isNotNull())
    signed, nothing = "sig long, cls long, n int, z int, tag short, salt short", np.zeros(0, np.int64)
    # A signature that more than HOT sets of the sample share is shared by more than HOT sets; so its sets need not meet.
    sample = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(lambda b: _signature_batches(b, width, num, den, nothing), signed)
    many = sample.groupBy("sig", "cls").count().groupBy("sig").agg(F.count("*").alias("sets")).filter(F.col("sets") > HOT)
    frequent = np.sort(np.array([r["sig"] for r in many.orderBy(F.col("sets").desc(), "sig").limit(SPREAD).collect()], np.int64))
    rows = texts.select("text").mapInArrow(lambda b: _signature_batches(b, width, num, den, frequent), signed)
    found = rows.repartition("sig", "salt").sortWithinPartitions("sig", "salt", "cls", "tag").mapInArrow(lambda b: _group_batches(b, num, den, HOT), "hot short, sig long, a long, b long, na int, nb int, za int, zb int, band short, units short")
    found = materialize(found, "ngram-found")

    hot = found.filter("hot = 1").select("sig", F.col("a").alias("cls"), F.col("na").alias("n"), F.col("za").alias("z"), "band", "units")
    skipped = materialize(hot.groupBy("cls", "band").agg(F.sum("units").alias("zhot")), "ngram-skipped")
    of_a, of_b = (skipped.select(F.col("cls").alias(x), "band", F.col("zhot").alias(f"h{x}")) for x in "ab")
    pairs = found.filter("hot = 0").groupBy("a", "b", "band").agg(F.sum("units").alias("units"), *(F.first(c).alias(c) for c in ("na", "nb", "za", "zb")))
    pairs = pairs.join(of_a, ["a", "band"], "left").join(of_b, ["b", "band"], "left").fillna(0, ["ha", "hb"])
    plans, tops = _band_columns(bands, found)
    needed = plans - _differing(F.col("na") + F.col("nb"), num, den)
    pairs = pairs.filter(F.col("units") + _unseen_empty(F.col("za"), F.col("zb")) + F.least("ha", "hb") >= needed).select("a", "b")

    # Sets whose skipped allocation exceeds their slack could have links that only hot signatures show, and so could those
    # with signatures of empty subsets (z < 0: more of these than the slack) that partners may have skipped. Each is compared with the most central one of its signatures, the one in most hot groups, if they share enough of these.
    slack = plans - 1 - _differing(F.col("n") + F.least(tops, F.floor(F.col("n") * den / num)), num, den)
    heavy = materialize(hot.join(skipped, ["cls", "band"]).filter((F.col("z") < 0) | (F.col("z") + F.col("zhot") > slack)).select("sig", "cls", "n", "band", "units", "zhot"), "ngram-hot")
    pivots = heavy.groupBy("sig").agg(F.max_by(F.struct("cls", "n"), F.struct("zhot", "cls")).alias("p"))
    salted = heavy.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)))
    spread = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    star = salted.join(spread, ["sig", "salt"]).filter((F.col("cls") != F.col("p.cls")) & (num * F.greatest("n", "p.n") <= den * F.least("n", "p.n")))
    star = star.groupBy("cls", "p", "n", "band").agg(F.sum("units").alias("units"))
    star = star.filter(2 * F.col("units") >= plans - _differing(F.col("n") + F.col("p.n"), num, den))
    star = star.select(F.least("cls", "p.cls").alias("a"), F.greatest("cls", "p.cls").alias("b"))

    # The sets of all documents that are looked at below, made once.
    reps = classes.select("cls", "rep")
    candidates = materialize(_named(pairs.union(star).distinct(), reps), "ngram-candidates")
    heavy = materialize(heavy.select("sig", "cls", "n").distinct().join(reps, "cls"), "ngram-heavy")
    used = candidates.select("src").union(candidates.select("dst")).union(heavy.select("rep")).distinct()
    used = materialize(used.select(F.col("src").alias("doc_id")), "ngram-used")
    if used.count() <= BROADCAST_IDS:
        used = F.broadcast(used)
    repeated = not of_docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    sets = text.join(used, "doc_id", "left_semi").select("text").mapInArrow(lambda b: _set_batches(b, width), "cls long, h array<long>")
    sets = materialize(sets.dropDuplicates(["cls"]) if repeated else sets, "ngram-sets")
    verified = materialize(_verify(candidates, sets, num, den), "ngram-links")
    labels = materialize(connected_components(verified), "ngram-labels")

    # Those that share a skipped signature with another component are joined on their rarest shingles.
    heavy = heavy.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep"))
    mixed = heavy.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("sig")
    spread = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = heavy.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)))
    heavy = materialize(salted.join(spread, ["sig", "salt"], "left_semi").select("cls", "rep", "n", "label").distinct(), "ngram-mixed")
    if not heavy.isEmpty():
        more = _verify(materialize(_named(_rarest_pairs(sets, heavy, num, den), reps), "ngram-more"), sets, num, den)
        labels = materialize(connected_components(verified.union(more)), "ngram-labels2")

    found_labels = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("cls", "cls2", F.coalesce("component", "rep").alias("component"))
    out = of_docs.join(found_labels, ["cls", "cls2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def _named(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of classes a, b with src, dst: their representatives."""
    return pairs.join(reps.select(F.col("cls").alias("a"), F.col("rep").alias("src")), "a").join(reps.select(F.col("cls").alias("b"), F.col("rep").alias("dst")), "b").select("a", "b", "src", "dst")


def _rarest_pairs(sets: DataFrame, heavy: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs a < b of different labels that share one of their rarest shingles, as all similar pairs do.

    With all sets in one order, sets that need o common elements share one among the first |r| - o + 1 of r and the
    first |s| - o + 1 of s. The order is by frequency in these sets, so what many share comes last.
    """
    tokens = materialize(sets.join(heavy, "cls").select("cls", "n", "label", F.explode("h").alias("token")), "ngram-tokens")
    order = Window.partitionBy("cls").orderBy("df", "token")
    ranked = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("df")), "token").withColumn("at", F.row_number().over(order) - 1)
    ranked = ranked.filter((F.col("at") <= F.col("n") - F.ceil(num * F.col("n") / den)) & (F.col("df") > 1)).select("token", "cls", "n", "label", "at")
    ranked = materialize(ranked, "ngram-rarest")
    mixed = ranked.groupBy("token").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    # The sets of a token fall into blocks, and each pair of blocks is a cell of its own, at most CELL by CELL or so.
    mixed = materialize(mixed.select("token", F.ceil(F.col("m") / CELL).cast("long").alias("blocks")), "ngram-common")
    ranked = ranked.join(F.broadcast(mixed) if mixed.count() <= BROADCAST_IDS else mixed, "token")
    own, every = F.pmod(F.xxhash64("cls"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = ranked.select("token", "cls", "n", "label", "at", own.alias("i"), every.alias("j"))
    other = ranked.select("token", *(F.col(c).alias(f"{c}2") for c in ("cls", "n", "label", "at")), own.alias("j"), every.alias("i"))
    common = F.ceil(num * (F.col("n") + F.col("n2")) / (num + den))
    near = (F.col("label") < F.col("label2")) & (F.col("at") <= F.col("n") - common) & (F.col("at2") <= F.col("n2") - common)
    return left.join(other, ["token", "i", "j"]).filter(near).select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b")).distinct()


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, with all columns whatever their names, whose doc_id is the least of their component.

    Of rows that share such a doc_id the first by hash of text, then by their columns, stays. Rows without a doc_id can't
    be named and stay.
    """
    found = ngram_components(docs, width, num, den)
    stay = materialize(found.filter("doc_id is not null and component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("rows")), "ngram-stay")
    ids = F.broadcast(stay.select("doc_id")) if stay.count() <= BROADCAST_IDS else stay.select("doc_id")
    kept = docs.join(ids, "doc_id", "left_semi").select(docs.columns)
    if not stay.filter("rows > 1").isEmpty():
        order = F.struct(F.xxhash64("text"), *(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))
        packed = kept.select("doc_id", order.alias("by"), F.struct("*").alias("row"))
        kept = packed.groupBy("doc_id").agg(F.min_by("row", "by").alias("row")).select("row.*")
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))


def _differing(total, num: int, den: int):
    return F.floor((den - num) * total.cast("long") / (den + num))


def _unseen_empty(za, zb):
    """The most units that two sets agree in by empty subsets without a common signature.

    Each set decides by its own slack whether it skips them, so one can have signatures (negative) where the other has none.
    """
    both = F.when((za >= 0) & (zb >= 0), F.least(za, zb)).when((za < 0) & (zb < 0), 0)
    return both.otherwise(F.least(F.abs(za), F.abs(zb)))


def _band_columns(bands: Bands, found: DataFrame):
    """V and the largest size of the column band. There are few bands: their number grows with the logarithm of the largest set."""
    top = found.agg(F.max("band")).first()[0] or 0
    values = [bands.plan(k) for k in range(top + 1)]
    at = F.col("band").cast("int") + 1
    return F.element_at(F.array(*(F.lit(m + doubled) for _, _, m, doubled in values)), at), F.element_at(F.array(*(F.lit(high) for _, high, _, _ in values)), at)


#: Pairs of one class from which on they are spread over SALTS tasks, each with the class's set.
MANY_PAIRS = 1_000


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """src, dst, ha, hb: the written pairs with the sets of their classes. A class of very many pairs is taken as a."""
    of_a, of_b = (sets.select(F.col("cls").alias(x), F.col("h").alias(f"h{x}")) for x in "ab")
    ends = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select("b")).groupBy("cls").agg(F.count("*").alias("m"))
    many = materialize(ends.filter(F.col("m") > MANY_PAIRS).select("cls"), "ngram-many")
    n = many.count()
    if not n:
        return pairs.join(of_a, "a").join(of_b, "b")
    hot = F.broadcast(many) if n <= BROADCAST_IDS else many
    marked = pairs.join(hot.select(F.col("cls").alias("a"), F.lit(True).alias("hot_a")), "a", "left").join(hot.select(F.col("cls").alias("b"), F.lit(True).alias("hot_b")), "b", "left")
    turned = F.col("hot_b").isNotNull() & F.col("hot_a").isNull()
    spread = F.col("hot_a").isNotNull() | F.col("hot_b").isNotNull()
    marked = marked.select("src", "dst", F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), spread.alias("spread"))
    copies = of_a.join(hot.withColumnRenamed("cls", "a"), "a", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = marked.filter("spread").withColumn("salt", F.pmod(F.xxhash64("src", "dst"), F.lit(SALTS)).cast("int")).join(copies, ["a", "salt"]).drop("salt")
    return marked.filter("not spread").join(of_a, "a").unionByName(salted).join(of_b, "b")


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """src, dst of the written pairs a, b of classes whose whole sets are similar enough."""
    counted = _with_sets(pairs, sets).select("src", "dst", F.size(F.array_intersect("ha", "hb")).alias("common"), (F.size("ha") + F.size("hb")).alias("total"))
    return counted.filter(den * F.col("common") >= num * (F.col("total") - F.col("common"))).select("src", "dst")
