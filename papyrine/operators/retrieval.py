"""Batched retrieval: BM25, cosine search, reciprocal rank fusion and final scores, for a table of queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import search_tokens
from papyrine.storage import materialize

K1, B, RRF_K = 1.5, 0.75, 60
# The least cosine without shared terms, and the part of the score that the cosine has.
NEAR, SEMANTIC_SHARE = 0.45, 0.65
#: Terms of a passage by which chunks that may hold it are found; what they find is then compared with the whole passage.
RAREST = 4


def postings(chunks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """chunk_id, term, tf, dl from chunks(chunk_id, text); with terms (term) only of these, which are sent to all tasks.

    With terms each chunk has one more row, without a term, whose n_words are the words of the chunks of this id.
    """
    tokens = chunks.select("chunk_id", search_tokens(F.col("text")).alias("tokens"))
    held = F.col("tokens") if terms is None else F.concat("tokens", F.array(F.lit(None).cast("string")))
    exploded = tokens.select("chunk_id", F.size("tokens").cast("long").alias("dl"), F.explode(held).alias("term"))
    counts = [F.count("*").alias("tf"), F.first("dl").alias("dl")]
    if terms is None:
        return exploded.groupBy("chunk_id", "term").agg(*counts)
    known = exploded.join(F.broadcast(terms.select("term", F.lit(True).alias("known")).distinct()), "term", "left").filter("known or term is null")
    return known.groupBy("chunk_id", "term").agg(*counts, F.sum("dl").alias("n_words"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf: a repeated query term counts as often as it occurs."""
    return queries.select("query_id", F.explode(search_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _by_chunk(found: DataFrame) -> DataFrame:
    """Postings dealt by chunk, so that what is joined with them by term can be grouped by chunk without another shuffle."""
    return found.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk_id")


def asked_postings(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """postings() of the queries' terms, written once: searches for the same queries can share them."""
    return materialize(postings(chunks, query_terms(queries)), "asked-postings")


def lexical_scores(chunks: DataFrame, queries: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, bm25, overlap of all pairs that share a term. Statistics are of all chunks.

    held: asked_postings() of these chunks and queries, if there are any already.

    overlap: shared distinct terms per distinct term of the query. Texts are cut into words once; only terms of queries are
    kept, so frequent terms that nobody asks for cost nothing, and pairs are made and added up where a chunk's postings are.
    """
    asked = query_terms(queries)
    held = asked_postings(chunks, queries) if held is None else held
    totals = held.filter("term is null").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), (F.sum("n_words") / F.sum("tf")).alias("avgdl")).first()
    found = held.filter("term is not null").select("chunk_id", "term", "tf", "dl")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    weights = df.select("term", F.log(1 + (totals["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    norm = K1 * (1 - B + B * F.col("dl") / F.lit(totals["avgdl"] or 1.0))
    terms = asked.join(weights, "term").join(sizes, "query_id")
    pairs = _by_chunk(found).join(F.broadcast(terms), "term").withColumn("part", F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm))
    return pairs.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("bm25"), F.round(F.count("*") / F.first("n_terms"), 6).alias("overlap"))


def bm25(chunks: DataFrame, queries: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, bm25 of all pairs that share a term."""
    return lexical_scores(chunks, queries, held).select("query_id", "chunk_id", "bm25")


def top_k(scores: DataFrame, score: str, k: int) -> DataFrame:
    """The k rows of each query with the highest scores, ties to the smaller chunk_id, with their rank."""
    best = Window.partitionBy("query_id").orderBy(F.col(score).desc(), "chunk_id")
    # The limit stands on the number itself, so each task keeps its k best before the shuffle.
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def cosine_pairs(vectors: DataFrame, queries: DataFrame, blocks: int = 32) -> DataFrame:
    """query_id, chunk_id, cosine of every query with every other vector.

    The vectors fall into blocks by a hash of their id, and the queries go to each block: a set of queries against all
    rows, as an equi-join on the block.
    """
    left = queries.select("query_id", unit(F.col("embedding")).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = vectors.select("chunk_id", unit(F.col("embedding")).alias("v"), F.pmod(F.hash("chunk_id"), F.lit(blocks)).alias("block"))
    pairs = left.join(right, "block").filter(F.col("query_id") != F.col("chunk_id"))
    return pairs.select("query_id", "chunk_id", F.round(dot(F.col("q"), F.col("v")), 6).alias("cosine"))


def contenders(scores: DataFrame, score: str, n: int) -> DataFrame:
    """query_id, chunk_id of each query's n best by score, ties to the smaller chunk_id."""
    return top_k(scores.select("query_id", "chunk_id", score), score, n).select("query_id", "chunk_id")


def ranks(scores: DataFrame, score: str, wanted: DataFrame) -> DataFrame:
    """query_id, chunk_id, rank in its query's whole list, for the wanted pairs (query_id, chunk_id) that the list has.

    No task puts a whole list in order, and the list isn't shuffled. The wanted rows of a query are sorted into an array, which
    all tasks get; each row of the list finds by halving how many of them stand before it, and the numbers of rows by that
    count, added up, are the ranks. The array is as long as there are wanted rows of a query, so these should be few.
    """
    rows = scores.select("query_id", "chunk_id", F.col(score).alias("s"))
    key = F.struct((-F.col("s")).alias("s"), F.col("chunk_id"))
    marked = rows.join(F.broadcast(wanted.select("query_id", "chunk_id").distinct()), ["query_id", "chunk_id"], "left_semi")
    arrays = materialize(marked.groupBy("query_id").agg(F.sort_array(F.collect_list(key)).alias("held")), "ranks-wanted")
    placed = rows.join(F.broadcast(arrays), "query_id").select("query_id", "held", key.alias("key"), F.lit(0).alias("at"))
    longest = arrays.agg(F.max(F.size("held"))).first()[0] or 0
    for b in reversed(range(longest.bit_length())):
        further = F.get("held", F.col("at") + ((1 << b) - 1)) < F.col("key")
        placed = placed.withColumn("at", F.col("at") + F.when(further, 1 << b).otherwise(0))
    counts = placed.groupBy("query_id", "at").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("query_id").orderBy("at"))
    # Of the rows that have i wanted ones before them, the wanted one itself is the last.
    numbered = arrays.select("query_id", F.posexplode("held").alias("at", "h")).join(counts.select("query_id", "at", upto.alias("rank")), ["query_id", "at"])
    return numbered.select("query_id", F.col("h.chunk_id").alias("chunk_id"), "rank")


def fused_ranks(first: DataFrame, second: DataFrame, score1: str, score2: str, n: int, keep: Column | None = None) -> DataFrame:
    """query_id, chunk_id, rrf, score1, score2, place of each query's n best by reciprocal ranks in two scored lists.

    A chunk that a list doesn't have gets nothing from it. One that stands behind 2 * n + RRF_K in both lists has less than
    each of the first n of one list, so only the others' ranks are worked out, in the whole lists. keep: which chunks count,
    by both scores; all of the first list must, and of the second at least those before any chunk that does only by it.
    """
    far = 2 * n + RRF_K
    wanted = materialize(contenders(first, score1, far).union(contenders(second, score2, far)).distinct(), "fused-contenders")
    both = wanted
    for scores, score, name in ((first, score1, "r1"), (second, score2, "r2")):
        both = both.join(ranks(scores, score, wanted).withColumnRenamed("rank", name), ["query_id", "chunk_id"], "left")
        own = scores.select("query_id", "chunk_id", score).join(F.broadcast(wanted), ["query_id", "chunk_id"], "left_semi")
        both = both.join(own, ["query_id", "chunk_id"], "left")
    fused = (both if keep is None else both.filter(keep)).withColumn("rrf", F.round(sum(F.coalesce(1.0 / (RRF_K + F.col(r)), F.lit(0.0)) for r in ("r1", "r2")), 9))
    return top_k(fused, "rrf", n).select("query_id", "chunk_id", "rrf", score1, score2, F.col("rank").alias("place"))


def reciprocal_rank_fusion(first: DataFrame, second: DataFrame, score1: str, score2: str, k: int) -> DataFrame:
    """query_id, chunk_id, rrf, rank of the k best from two scored lists."""
    return fused_ranks(first, second, score1, score2, k).select("query_id", "chunk_id", "rrf", F.col("place").alias("rank"))


def hybrid(lexical: DataFrame, semantic: DataFrame, k: int, least: float = 0.1) -> DataFrame:
    """query_id, chunk_id, place, score, rank: the k first of the pool by reciprocal ranks whose score is high enough.

    lexical: query_id, chunk_id, bm25; semantic: query_id, chunk_id, cosine. The pool are the first max(4 * k, 20) with a
    bm25 above 0 or a cosine of NEAR or more; the score is SEMANTIC_SHARE of the cosine and the rest of the share of the
    query's best bm25. Scores keep rows or drop them; they don't order them.
    """
    pool = max(4 * k, 20)
    good = fused_ranks(lexical.filter("bm25 > 0"), semantic, "bm25", "cosine", pool, keep=(F.col("bm25") > 0) | (F.col("cosine") >= NEAR))
    best = lexical.groupBy("query_id").agg(F.max("bm25").alias("best"))
    part = F.coalesce(F.try_divide(F.col("bm25"), F.col("best")), F.lit(0.0))
    scored = good.join(best, "query_id", "left").withColumn("score", F.round(SEMANTIC_SHARE * F.coalesce("cosine", F.lit(0.0)) + (1 - SEMANTIC_SHARE) * part, 4)).filter(F.col("score") >= least)
    order = Window.partitionBy("query_id").orderBy("place")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "chunk_id", "place", "score", F.col("rank").cast("long").alias("rank"))


def assembled(parts: list[tuple[DataFrame, int]], chunks: DataFrame) -> DataFrame:
    """query_id, n_hits, context: the first hits of several searches, in their order, each chunk once, as lines `[id] text`.

    parts: results (query_id, chunk_id, rank) with how many of each to take.
    """
    taken = [hits.filter(F.col("rank") <= n).select("query_id", "chunk_id", F.lit(i).alias("part"), "rank") for i, (hits, n) in enumerate(parts)]
    rows = taken[0]
    for more in taken[1:]:
        rows = rows.unionByName(more)
    once = rows.groupBy("query_id", "chunk_id").agg(F.min(F.struct("part", "rank")).alias("at"))
    texts = once.join(chunks.select("chunk_id", "text"), "chunk_id")
    line = F.concat(F.lit("["), F.col("chunk_id").cast("string"), F.lit("] "), F.coalesce("text", F.lit("")))
    lines = texts.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("at", line.alias("line")))).alias("lines"))  # a few hits a query
    return lines.select("query_id", F.size("lines").cast("long").alias("n_hits"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("context"))


def final_scores(scores: DataFrame, k: int, least: float = 0.1) -> DataFrame:
    """Of each query's k best by bm25 the share of the query's best score, four digits, least or more; order stays."""
    best = top_k(scores, "bm25", k).withColumn("best", F.max("bm25").over(Window.partitionBy("query_id")))
    shared = best.withColumn("score", F.round(F.col("bm25") / F.col("best"), 4))
    return shared.filter(F.col("score") >= least).select("query_id", "chunk_id", "rank", "score")


def holders(chunks: DataFrame, passages: DataFrame, blocks: int = 32, held: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id of chunks (chunk_id, text) that contain a passage (query_id, text), at any place of words.

    Terms with both ends inside the passage are terms of every text around it, so only chunks with the RAREST of these are
    looked at. A passage without such a term is looked for in all chunks, in blocks. held: asked_postings() of the chunks
    and of queries with these texts, if there are any already.
    """
    inner = F.regexp_replace(F.lower("text"), r"^[a-z0-9_+#.-]+|[a-z0-9_+#.-]+$", "")
    inside = passages.select("query_id", inner.alias("text"))
    held = (asked_postings(chunks, inside) if held is None else held).filter("term is not null").select("chunk_id", "term")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "term")
    asked = query_terms(inside).join(df, "term", "left").withColumn("at", F.row_number().over(rarest)).filter(F.col("at") <= RAREST).select("query_id", "term")
    asked = materialize(asked, "rarest-terms")
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    named = passages.select("query_id", F.col("text").alias("passage"))
    found = held.join(F.broadcast(asked), "term").groupBy("query_id", "chunk_id").agg(F.count("*").alias("shared"))
    likely = found.join(sizes, "query_id").filter("shared = n_terms").join(named, "query_id").join(chunks, "chunk_id")
    bare = named.join(sizes, "query_id", "left_anti").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    every = chunks.withColumn("block", F.pmod(F.hash("chunk_id"), F.lit(blocks))).join(bare, "block")
    columns = ["query_id", "chunk_id", "passage", "text"]
    return likely.select(columns).unionByName(every.select(columns)).filter(F.contains("text", "passage")).select("query_id", "chunk_id")


def recall_at(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """n_queries and recall: the share of expected (query_id, chunk_id) that are among the k best."""
    hit = expected.join(results.filter(F.col("rank") <= k).select("query_id", "chunk_id", F.lit(1.0).alias("hit")), ["query_id", "chunk_id"], "left")
    return hit.agg(F.count("*").alias("n_queries"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"))


def verified_citations(cited: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Cited pairs that were really retrieved."""
    return cited.join(retrieved, ["query_id", "chunk_id"], "left_semi")
