"""Sentence, paragraph and token tables of a document table (doc_id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import text as T


def split_sentences(df: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence) as cut, nothing dropped."""
    return df.select("doc_id", F.posexplode(T.raw_sentences(F.col("text"))).alias("pos", "sentence"))


def filter_short(df: DataFrame, minimum: int = 4) -> DataFrame:
    return df.filter(T.is_long_enough(F.col("sentence"), minimum))


def filter_markers(df: DataFrame) -> DataFrame:
    return df.filter(~T.is_marker(F.col("sentence")))


def prepared(df: DataFrame, min_length: int = 4) -> DataFrame:
    """(doc_id, pos, sentence) after length filter, cleaning and marker filter, renumbered from 0."""
    return df.select(
        "doc_id", F.posexplode(T.prepared_sentences(F.col("text"), min_length)).alias("pos", "sentence")
    )


def split_paragraphs(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "paragraph"))
