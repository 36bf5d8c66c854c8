"""The whole way from a table of queries to the chunks and the context of each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.operators import retrieval as R
from docweave.operators.prompts import build_context


@dataclass(frozen=True)
class RetrievalConfig:
    """The published limits."""

    semantic_limit: int = 20
    keyword_limit: int = 3
    max_chunks: int = 10


def candidates(queries, chunks, documents, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    semantic = R.semantic_search(queries, chunks, documents, cfg.semantic_limit)
    keyword = R.keyword_search(queries, chunks, documents, cfg.keyword_limit)
    return R.hybrid(semantic, keyword)


def retrieve_scored(
    queries: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    cfg: RetrievalConfig = RetrievalConfig(),
    scores: DataFrame | None = None,
) -> DataFrame:
    """(query_id, chunk_id, similarity, rerank_score, rank): hybrid candidates in their final order.

    With ``scores`` (query_id, chunk_id, rerank_score) candidates are reranked, except for queries that need none; those keep
    the order they were found in.  Without scores they are ordered by similarity.  A query may bring its own settings:
    ``max_chunks`` (any value; what is no whole number counts as the default) and ``use_reranker`` (null counts as true; a
    query that says false is ordered by similarity).  A limit of 0 or less leaves no rows.
    """
    found = candidates(queries, chunks, documents, cfg)
    limit = R.coerce_limit(F.col("max_chunks"), cfg.max_chunks) if "max_chunks" in queries.columns else F.lit(cfg.max_chunks)
    wants = F.coalesce("use_reranker", F.lit(True)) if "use_reranker" in queries.columns else F.lit(True)
    own = queries.select("query_id", "query_text", limit.alias("_limit"), wants.alias("_wants"))
    placed = found.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("query_id"))).join(own, "query_id")
    if scores is None:
        ranked = placed.withColumn("rerank_score", F.lit(None).cast("double"))
        order = [F.desc("similarity"), F.col("place")]
    else:
        flagged = R.skip_rerank(placed)
        left_alone = flagged.withColumn("skip", F.col("skip") | ~F.col("_wants")).drop("n", "query_text")
        scored = R.balance_candidates(left_alone).join(scores, ["query_id", "chunk_id"], "left")
        ranked = scored.withColumn("rerank_score", F.when(~F.col("skip"), F.col("rerank_score")))
        order = [F.desc_nulls_last(F.when(F.col("_wants"), F.col("rerank_score")).otherwise(F.col("similarity"))), F.col("place")]
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    cut = ranked.withColumn("rank", rank).filter(F.col("rank") <= F.col("_limit"))
    return cut.select("query_id", "chunk_id", "similarity", "rerank_score", "rank")


def retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    cfg: RetrievalConfig = RetrievalConfig(),
    scores: DataFrame | None = None,
) -> DataFrame:
    """(query_id, chunk_id, similarity, rank) as ``retrieve_scored``."""
    return retrieve_scored(queries, chunks, documents, cfg, scores).select("query_id", "chunk_id", "similarity", "rank")


def result_rows(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Final hits with document_id, document_name, link and chunk_text; a store without links gives null ones."""
    link = F.col("link") if "link" in documents.columns else F.lit(None).cast("string")
    named = documents.select("document_id", F.col("name").alias("document_name"), link.alias("link"))
    held = chunks.select("chunk_id", "document_id", "chunk_text").join(named, "document_id")
    return hits.join(held, "chunk_id").select(*hits.columns, "document_id", "document_name", "link", "chunk_text")


def contexts(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, context) of final hits."""
    named = chunks.select("chunk_id", "document_id", "chunk_text").join(
        documents.select("document_id", F.col("name").alias("document_name")), "document_id"
    )
    return build_context(hits.join(named, "chunk_id"))
