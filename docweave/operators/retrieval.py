"""Answering a whole table of queries: vector search, keyword search, their union, order and cuts.

queries   (query_id, kb_id, query_text, keywords, vector)
chunks    (chunk_id, document_id, chunk_text, keywords, embedding, is_deleted)
documents (document_id, kb_id, status, name)
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions.text import strip, words
from docweave.operators.numbering import top_per_key
from docweave.session import BROADCAST_ROWS, broadcast_if_small, checkpointed

# Rows per side of one scoring tile.
CHUNK_TILE = 16_384
QUERY_TILE = 1_024
# Words of the chunks of one BM25 tile; its postings are fewer.
WORD_TILE = 2_000_000

# Greetings that need no reranking, and fragments that mark a short query as one.
GREETINGS = [
    "xin chào", "hello", "hi", "chào bạn", "chào em", "chào anh", "chào chị",
    "cảm ơn", "thank you", "thanks", "bye", "tạm biệt",
    "ok", "được rồi", "uhm", "ừm", "good", "tốt",
]
GREETING_PARTS = ["hi", "ok", "bye", "chào", "cảm ơn"]
NO_ANSWER = "Không tìm thấy thông tin phù hợp để trả lời câu hỏi này."


def live_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks that are not deleted, of documents that are live, with base and document name."""
    live = documents.filter("status").select("document_id", "kb_id", F.col("name").alias("document_name"))
    return chunks.filter("not is_deleted").join(live, "document_id")


def _tile_counts(df: DataFrame, tile: int, name: str) -> DataFrame:
    """(kb_id, <name>): tiles of about ``tile`` rows needed for each base."""
    return df.groupBy("kb_id").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(name))


def _own_tile(id_col: str, tiles: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.col(tiles)).cast("int")


def _every_tile(tiles: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(tiles) - 1))


def _places(ids: np.ndarray) -> np.ndarray:
    """The rank of each id among those of a tile; texts rank like their UTF-8 bytes."""
    return np.unique(ids, return_inverse=True)[1]


def _hits(query_id, ids: np.ndarray, **scores: np.ndarray) -> pd.DataFrame:
    """Rows of one query, maybe none; ids are plain objects, as an empty column of numbers is no column of texts."""
    same = pd.Series([query_id] * len(ids), dtype=object)
    return pd.DataFrame({"query_id": same, "chunk_id": pd.Series(list(ids), dtype=object), **scores})


def _matrix(vectors: pd.Series, chosen: np.ndarray) -> np.ndarray:
    return np.stack(vectors.to_numpy()[chosen]).astype(float)


def _score_tile(k: int):
    def run(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return _hits(None, np.zeros(0), distance=np.zeros(0), l2_distance=np.zeros(0))
        dist = np.full((len(asked), len(held)), np.inf)
        l2 = np.full(dist.shape, np.inf)
        wide = [np.array([-1 if v is None else len(v) for v in side]) for side in (asked["vector"], held["embedding"])]
        # Vectors of different lengths, and queries without one, have no distance to each other.
        for width in np.intersect1d(*wide):
            at, ct = np.flatnonzero(wide[0] == width), np.flatnonzero(wide[1] == width)
            if width < 0:
                continue
            q, c = _matrix(asked["vector"], at), _matrix(held["embedding"], ct)
            qn, cn = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
            dots, scale = q @ c.T, np.outer(qn, cn)
            with np.errstate(divide="ignore", invalid="ignore"):
                own = np.where(scale > 0, np.round(1.0 - dots / scale, 9), np.inf)
            dist[np.ix_(at, ct)] = np.where(np.isnan(own), np.inf, own)
            apart = np.round(np.sqrt(np.maximum(qn[:, None] ** 2 + cn[None, :] ** 2 - 2 * dots, 0.0)), 6)
            l2[np.ix_(at, ct)] = np.where(np.isnan(apart), np.inf, apart)
        ids = held["chunk_id"].to_numpy()
        place = _places(ids)
        kept = min(k, len(ids))
        edge = np.partition(dist, kept - 1, axis=1)[:, kept - 1]
        out = []
        for i, query_id in enumerate(asked["query_id"]):
            near = np.flatnonzero(dist[i] <= edge[i])
            best = near[np.lexsort((place[near], l2[i, near], dist[i, near]))][:k]
            out.append(_hits(query_id, ids[best], distance=dist[i, best], l2_distance=l2[i, best]))
        return pd.concat(out)

    return run


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def vector_topk(queries: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, distance, rank): exact nearest chunks of the query's base by cosine, then L2, then id.

    Both sides of a base are cut to tiles; a task multiplies one tile of queries with one tile of chunks and
    gives back ``k`` rows per query, so a base of any size spreads and no pair table exists.  Chunks without
    a vector come last, and only the first ``k`` of a base can matter.  A query without a vector, or with one of another
    length or of zeros, has no distances and gets the lowest ids.  Ids are of any type that can be ordered.
    """
    with_vector = held.filter("embedding is not null").select("kb_id", "chunk_id", "embedding")
    counts = broadcast_if_small(
        _tile_counts(with_vector, CHUNK_TILE, "c_tiles").join(_tile_counts(queries, QUERY_TILE, "q_tiles"), "kb_id")
    )
    c_rows = with_vector.join(counts, "kb_id").select(
        F.col("kb_id").alias("kb"),
        _own_tile("chunk_id", "c_tiles").alias("ct"),
        _every_tile("q_tiles").alias("qt"),
        F.col("chunk_id").alias("chunk_id"),
        F.col("embedding").alias("embedding"),
    )
    q_rows = queries.join(counts, "kb_id").select(
        F.col("kb_id").alias("kb"),
        _every_tile("c_tiles").alias("ct"),
        _own_tile("query_id", "q_tiles").alias("qt"),
        F.col("query_id").alias("query_id"),
        F.col("vector").alias("vector"),
    )
    keys = ["kb", "ct", "qt"]
    scored = (
        q_rows.groupBy(*keys)
        .cogroup(c_rows.groupBy(*keys))
        .applyInPandas(
            _score_tile(k),
            f"query_id {_type(queries, 'query_id')}, chunk_id {_type(held, 'chunk_id')}, distance double, l2_distance double",
        )
    )

    def seen(name):
        return F.when(F.col(name) < float("inf"), F.col(name))

    unscored = top_per_key(held.filter("embedding is null").select("kb_id", "chunk_id"), ["kb_id"], ["chunk_id"], k)
    nothing = F.lit(None).cast("double")
    last = queries.select("query_id", "kb_id").join(unscored, "kb_id").select(
        "query_id", "chunk_id", nothing.alias("distance"), nothing.alias("l2_distance")
    )
    every = scored.withColumn("distance", seen("distance")).withColumn("l2_distance", seen("l2_distance")).unionByName(last)
    order = [F.asc_nulls_last("distance"), F.asc_nulls_last("l2_distance"), F.col("chunk_id")]
    return top_per_key(every, ["query_id"], order, k).drop("l2_distance")


def semantic_search(queries: DataFrame, chunks: DataFrame, documents: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, chunk_id, similarity, rank); a missing distance counts as 1."""
    hits = vector_topk(queries, live_chunks(chunks, documents), k)
    return hits.select(
        "query_id", "chunk_id", F.round(1.0 - F.coalesce("distance", F.lit(1.0)), 9).alias("similarity"), "rank"
    )


def keyword_search(queries: DataFrame, chunks: DataFrame, documents: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, chunk_id, similarity = 0, rank): chunks sharing a keyword, lowest ids first.

    The first ``k`` chunks of a query are among the first ``k`` of each of its keywords, so postings are cut to
    ``k`` per base and keyword before the join; a frequent keyword costs no more than a rare one.  Few keywords that are
    asked for go to all tasks and leave nothing else to be cut; many are joined after the cut.  (The outer explode keeps
    Spark from computing derived keywords a second time in a filter of its own.)
    """
    asked = queries.select("query_id", "kb_id", F.explode_outer("keywords").alias("keyword"))
    held = live_chunks(chunks, documents).select("kb_id", "chunk_id", F.explode_outer("keywords").alias("keyword"))
    key = ["kb_id", "keyword"]
    wanted = checkpointed(asked.select(*key).distinct())
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        postings = top_per_key(held.join(F.broadcast(wanted), key, "left_semi"), key, ["chunk_id"], k, "_n").drop("_n")
    else:
        postings = top_per_key(held, key, ["chunk_id"], k, "_n").drop("_n").join(wanted, key, "left_semi")
    matched = asked.join(postings, ["kb_id", "keyword"]).select("query_id", "chunk_id").distinct()
    return top_per_key(matched, ["query_id"], ["chunk_id"], k).select(
        "query_id", "chunk_id", F.lit(0.0).alias("similarity"), "rank"
    )


def hybrid(semantic: DataFrame, keyword: DataFrame) -> DataFrame:
    """(query_id, chunk_id, similarity, place): semantic rows, then keyword rows with a new chunk."""
    cols = ["query_id", "chunk_id"]
    both = semantic.select(*cols, F.struct(F.lit(0).alias("list"), "rank", "similarity").alias("hit")).unionByName(
        keyword.select(*cols, F.struct(F.lit(1).alias("list"), "rank", "similarity").alias("hit"))
    )
    once = both.groupBy(*cols).agg(F.min("hit").alias("hit"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("hit"))
    return once.select(*cols, F.col("hit.similarity").alias("similarity"), place.alias("place"))


def top_chunks(hits: DataFrame, k: int = 10) -> DataFrame:
    """Best ``k`` by similarity; equal ones keep their place."""
    return top_per_key(hits, ["query_id"], [F.desc("similarity"), F.col("place")], k)


def rerank(hits: DataFrame, k: int = 10, score: str = "rerank_score") -> DataFrame:
    """Best ``k`` by a score column; a missing score comes last, equal ones keep their place."""
    return top_per_key(hits, ["query_id"], [F.desc_nulls_last(score), F.col("place")], k)


def is_greeting(query: Column) -> Column:
    q = strip(F.lower(query))
    part = F.lit(False)
    for p in GREETING_PARTS:
        part = part | q.contains(p)
    return q.isin(GREETINGS) | ((F.length(q) <= 10) & part)


def skip_rerank(df: DataFrame, n: str = "n", query: str = "query_text") -> DataFrame:
    """``skip``: at most 3 candidates, a greeting, or fewer than 5 characters."""
    few = F.col(n) <= 3
    return df.withColumn("skip", few | is_greeting(F.col(query)) | (F.length(strip(F.col(query))) < 5))


def balance_plan(n: Column) -> tuple[Column, Column]:
    """(threads, dropped) for n candidates."""
    odd = (n > 3) & (n % 3 != 0) & (n % 2 != 0)
    threads = (
        F.when(n <= 3, 1)
        .when(n % 3 == 0, 3)
        .when(n % 2 == 0, 2)
        .when((n - 1) % 3 == 0, 3)
        .otherwise(2)
    )
    return threads, F.when(odd, 1).otherwise(0)


def balance_candidates(hits: DataFrame) -> DataFrame:
    """Drop the least similar candidate of a query where the count asks for it; adds n (kept) and threads.

    The remaining candidates of such a query are placed by similarity.  Queries flagged in an optional ``skip``
    column are left alone.
    """
    per_query = W.partitionBy("query_id")
    counted = hits.withColumn("n", F.count(F.lit(1)).over(per_query)).withColumn(
        "by_sim", F.row_number().over(per_query.orderBy(F.desc("similarity"), "place"))
    )
    threads, dropped = balance_plan(F.col("n"))
    if "skip" in hits.columns:
        dropped = F.when(F.col("skip"), 0).otherwise(dropped)
    planned = counted.withColumn("threads", threads).withColumn("dropped", dropped)
    kept = planned.filter(F.col("by_sim") <= F.col("n") - F.col("dropped"))
    place = F.when(F.col("dropped") > 0, F.col("by_sim")).otherwise(F.col("place"))
    return kept.withColumn("place", place).withColumn("n", F.col("n") - F.col("dropped")).drop("by_sim", "dropped")


def batch_size(n: Column) -> Column:
    return F.when(n <= 8, n).when(n <= 16, 8).otherwise(16)


def score_batches(hits: DataFrame) -> DataFrame:
    """0-based scoring ``batch`` of each candidate of a query, in order of place."""
    per_query = W.partitionBy("query_id")
    size = batch_size(F.count(F.lit(1)).over(per_query))
    row = F.row_number().over(per_query.orderBy("place"))
    return hits.withColumn("batch", F.floor((row - 1) / size))


def _scaled(score: str, name: str) -> Column:
    w = W.partitionBy("query_id")
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(0.0).alias(name)


def fuse(semantic: DataFrame, keyword: DataFrame, weight: float = 0.7) -> DataFrame:
    """(query_id, chunk_id, score): weighted sum of both lists' scores, scaled to 0..1 per query.

    A list whose scores are all equal counts 0, and so does a chunk missing from a list.
    """
    a = semantic.select("query_id", "chunk_id", _scaled("similarity", "a"))
    b = keyword.select("query_id", "chunk_id", _scaled("similarity", "b"))
    both = a.join(b, ["query_id", "chunk_id"], "full")
    score = F.coalesce("a", F.lit(0.0)) * weight + F.coalesce("b", F.lit(0.0)) * (1 - weight)
    return both.select("query_id", "chunk_id", score.alias("score"))


def _score_postings(k: int):
    """Best ``k`` chunks of a tile for each of its queries.

    Terms are taken by the highest score that any chunk of the tile gets from them.  Once the k-th chunk so far can't be
    reached by what the remaining terms can add, chunks that hold none of the terms so far are out, and the remaining terms
    are only looked up for those that are still in reach.
    """

    def run(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        nothing = _hits(None, np.zeros(0), similarity=np.zeros(0))
        if asked.empty or held.empty:
            return nothing
        chunk, found = pd.factorize(held["chunk_id"])
        rank = _places(found.to_numpy())
        ids, chunk = found.to_numpy()[np.argsort(rank)], rank[chunk]
        term, words = pd.factorize(held["term"])
        order = np.lexsort((chunk, term))
        chunk, part = chunk[order], held["part"].to_numpy()[order]
        bounds = np.searchsorted(term[order], np.arange(len(words) + 1))
        highest = np.maximum.reduceat(part, bounds[:-1])
        asked = asked.assign(at=pd.Index(words).get_indexer(asked["term"]))
        out = []
        for query_id, rows in asked[asked["at"] >= 0].groupby("query_id", sort=False):
            gains = rows["idf"].to_numpy() * highest[rows["at"]]
            scores, seen, inside = np.zeros(len(ids)), np.zeros(len(ids), bool), None
            by_gain = np.argsort(-gains, kind="stable")
            left = gains.sum() - np.cumsum(gains[by_gain])
            for i, ahead in zip(by_gain, left):
                at, idf = rows["at"].iloc[i], rows["idf"].iloc[i]
                own, add = chunk[bounds[at] : bounds[at + 1]], part[bounds[at] : bounds[at + 1]]
                if inside is not None:
                    own, add = own[inside[own]], add[inside[own]]
                scores[own] += idf * add
                seen[own] = True
                found = np.flatnonzero(seen if inside is None else seen & inside)
                if len(found) >= k:
                    floor = np.partition(scores[found], len(found) - k)[len(found) - k]
                    if floor > ahead + 1e-6:
                        inside = np.zeros(len(ids), bool)
                        inside[found[scores[found] + ahead >= floor - 1e-6]] = True
            found = np.flatnonzero(seen if inside is None else seen & inside)
            rounded = np.round(scores[found], 9)
            best = np.lexsort((found, -rounded))[:k]
            out.append(_hits(query_id, ids[found[best]], similarity=rounded[best]))
        return pd.concat(out) if out else nothing

    return run


def bm25(
    queries: DataFrame, chunks: DataFrame, documents: DataFrame, k: int = 20, k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """(query_id, chunk_id, similarity, rank): BM25 over the live chunks of the query's base.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)).  Postings are cut to the terms that are asked for before anything is counted,
    and counts are partly summed before each exchange.  Chunks of a base are dealt to tiles of at most
    about ``CHUNK_TILE`` chunks and ``WORD_TILE`` words, so a tile's postings don't grow with the input; a task scores one tile of
    queries against one tile of postings and gives back ``k`` rows per query, so queries never meet chunks as rows.
    """

    def terms(col):
        return words(F.lower(col))

    held = live_chunks(chunks, documents).select("kb_id", "chunk_id", terms(F.col("chunk_text")).alias("terms"))
    lengths = held.select("kb_id", "chunk_id", F.size("terms").alias("dl"), "terms")
    c_tiles = F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK_TILE, F.sum("dl") / WORD_TILE)).cast("int")
    bases = lengths.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_dl"), c_tiles.alias("c_tiles"))
    bases = broadcast_if_small(bases.join(_tile_counts(queries, QUERY_TILE, "q_tiles"), "kb_id"))
    asked = queries.select("query_id", "kb_id", F.explode(F.array_distinct(terms(F.col("query_text")))).alias("term"))
    tf = (
        lengths.select("kb_id", "chunk_id", "dl", F.explode_outer("terms").alias("term"))
        .join(asked.select("kb_id", "term").distinct(), ["kb_id", "term"], "left_semi")
        .groupBy("kb_id", "term", "chunk_id", "dl")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    df = tf.groupBy("kb_id", "term").agg(F.count(F.lit(1)).alias("df")).join(bases.select("kb_id", "n"), "kb_id")
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    postings = tf.join(bases, "kb_id").select(
        "kb_id", _own_tile("chunk_id", "c_tiles").alias("ct"), _every_tile("q_tiles").alias("qt"), "term", "chunk_id", part.alias("part")
    )
    weighed = asked.join(df.select("kb_id", "term", idf.alias("idf")), ["kb_id", "term"]).join(bases, "kb_id")
    lists = weighed.select(
        "kb_id", _every_tile("c_tiles").alias("ct"), _own_tile("query_id", "q_tiles").alias("qt"), "query_id", "term", "idf"
    )
    keys = ["kb_id", "ct", "qt"]
    schema = f"query_id {_type(queries, 'query_id')}, chunk_id {_type(chunks, 'chunk_id')}, similarity double"
    scored = lists.groupBy(*keys).cogroup(postings.groupBy(*keys)).applyInPandas(_score_postings(k), schema)
    return top_per_key(scored, ["query_id"], [F.desc("similarity"), F.col("chunk_id")], k)


def naive_hybrid(first: DataFrame, second: DataFrame) -> DataFrame:
    """(query_id, chunk_id, place): one list behind the other, first occurrence of a chunk kept."""
    both = first.select("query_id", "chunk_id", F.lit(0).alias("list"), "rank").unionByName(
        second.select("query_id", "chunk_id", F.lit(1).alias("list"), "rank")
    )
    once = both.groupBy("query_id", "chunk_id").agg(F.min(F.struct("list", "rank")).alias("at"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("at"))
    return once.select("query_id", "chunk_id", place.alias("place"))


def coerce_limit(col: Column, default: int = 10) -> Column:
    """Whole-number text as a number, a number without its fraction, anything else the default."""
    text = strip(col.cast("string"))
    is_number = F.typeof(col).rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
    whole = F.when(is_number, col.try_cast("double").try_cast("long"))
    whole = whole.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("long"))
    return F.coalesce(whole, F.lit(default).cast("long"))


def with_fallback(queries: DataFrame, hits: DataFrame, answer: str = NO_ANSWER) -> DataFrame:
    """(query_id, answer, n_chunks): the fixed answer for queries without a hit, NULL for the others."""
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    joined = queries.select("query_id").join(counts, "query_id", "left")
    return joined.select(
        "query_id",
        F.when(F.col("n_chunks").isNull(), F.lit(answer)).alias("answer"),
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
    )
