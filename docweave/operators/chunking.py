"""Chunk tables from document tables (doc_id, text) and labelled sentence tables (doc_id, pos, sentence, label)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions import folds
from docweave.functions.text import words
from docweave.operators.similarity import adjacent_similarity, running_groups


def _chunk_rows(df: DataFrame, chunks: Column) -> DataFrame:
    return df.select("doc_id", F.posexplode(chunks).alias("chunk", "text")).withColumn(
        "chunk", F.col("chunk").cast("long")
    )


def split_recursive(df: DataFrame, size: int, separators: list[str] | None = None) -> DataFrame:
    """(doc_id, chunk, text): pieces shorter than ``size``; together they read as the input."""
    return _chunk_rows(df, folds.split_recursive(F.col("text"), size, separators)["piece"])


def recursive_chunks(
    df: DataFrame,
    size: int = 4000,
    overlap: int = 200,
    separators: list[str] | None = None,
    length: Callable[[Column], Column] = F.length,
) -> DataFrame:
    """Split at ever finer separators, then merge neighbours up to ``size`` with ``overlap``."""
    pieces = df.withColumn("pieces", folds.split_recursive(F.col("text"), size, separators, length))
    return _chunk_rows(pieces, folds.merge_splits(F.col("pieces"), size, overlap, length))


def fixed_windows(df: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """Windows of ``size`` words."""
    windows = folds.fixed_windows(words(F.col("text")), size, overlap)
    return _chunk_rows(df, F.transform(windows, lambda w: F.array_join(w, " ")))


def token_count(col: Column, length: Callable[[Column], Column] | None = None) -> Column:
    return length(col) if length else F.size(words(col)).cast("long")


def group_sequential(sentences: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, pos, sentence, label): a new label wherever a sentence is less similar than ``threshold``."""
    if "vector" not in sentences.columns:
        return running_groups(sentences, threshold)
    sims = adjacent_similarity(sentences)
    running = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    breaks = F.when(F.col("sim") < threshold, 1).otherwise(0)
    joined = sentences.repartition("doc_id").join(sims, ["doc_id", "pos"], "left")
    return joined.select("doc_id", "pos", "sentence", F.sum(breaks).over(running).alias("label"))


def on_one_row(labelled: DataFrame, order: str = "pos") -> DataFrame:
    """(doc_id, sentences): the labelled sentences of a document as one ordered array.

    A document comes from one row and goes back to one row; nothing is gathered across documents.
    """
    item = F.struct(F.col(order).alias("place"), "sentence", F.col("label").cast("long").alias("label"))
    return labelled.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("sentences"))


def pack_chunks(labelled: DataFrame, limit: int = 2000, order: str = "pos") -> DataFrame:
    return _chunk_rows(on_one_row(labelled, order), folds.pack(F.col("sentences"), limit))


def split_oversized(labelled: DataFrame, limit: int = 2000) -> DataFrame:
    """(doc_id, chunk, text, part) from runs of equal labels."""
    parts = folds.split_oversized(folds.grouped(F.col("sentences")), limit)
    return on_one_row(labelled).select("doc_id", F.posexplode(parts).alias("chunk", "c")).select(
        "doc_id", F.col("chunk").cast("long").alias("chunk"), "c.text", "c.part"
    )


def _chunk_arrays(chunks: DataFrame) -> DataFrame:
    """Chunk rows (doc_id, chunk, text[, part]) back to one ordered array per document."""
    part = F.col("part") if "part" in chunks.columns else F.lit(False)
    item = F.struct("chunk", "text", part.alias("part"))
    return chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("chunks"))


def merge_small(chunks: DataFrame, minimum: int = 50) -> DataFrame:
    return _chunk_rows(_chunk_arrays(chunks), folds.merge_small(F.col("chunks"), minimum))


def add_overlap(chunks: DataFrame, k: int) -> DataFrame:
    texts = F.transform("chunks", lambda c: c["text"])
    return _chunk_rows(_chunk_arrays(chunks), folds.add_overlap(texts, k))
