"""The collection model (documents, chunks, queries, messages, log) read from the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.keywords import keywords
from docweave.functions.vectors import as_double
from docweave.sources.readers import load, load_texts

CHUNKS_PER_DOCUMENT = 4


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """One chunk per stored text, four to a document; some have no embedding yet, toxic ones are deleted."""
    texts = load_texts(spark, d, "documents", "doc_id", "text")
    vectors = load(spark, d, "embeddings").select(
        F.col("vec_id").alias("doc_id"), as_double(F.col("embedding")).alias("embedding"), "label"
    )
    flags = load(spark, d, "labels").select("doc_id", "toxic")
    return (
        texts.join(vectors, "doc_id", "left")
        .join(flags, "doc_id", "left")
        .select(
            F.col("doc_id").alias("chunk_id"),
            F.floor(F.col("doc_id") / CHUNKS_PER_DOCUMENT).alias("document_id"),
            F.col("text").alias("chunk_text"),
            "embedding",
            "label",
            (F.coalesce("toxic", F.lit(0)) == 1).alias("is_deleted"),
        )
    )


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the chunks: base, name and whether they are live."""
    texts = load(spark, d, "documents").select("doc_id", "source")
    flags = load(spark, d, "labels").select("doc_id", "quality")
    key = F.floor(F.col("doc_id") / CHUNKS_PER_DOCUMENT).alias("document_id")
    return (
        texts.join(flags, "doc_id", "left")
        .groupBy(key)
        .agg(
            F.min("source").alias("kb_id"),
            F.bool_and(F.coalesce("quality", F.lit(1)) == 1).alias("status"),
        )
        .withColumn("name", F.concat(F.lit("doc_"), F.col("document_id").cast("string")))
    )


def queries(spark: SparkSession, d: str) -> DataFrame:
    """One query per benchmark item: text, keywords, vector and the base it is asked against."""
    asked = load(spark, d, "benchmark").withColumnRenamed("item_id", "query_id")
    vectors = load(spark, d, "embeddings").select(
        F.col("vec_id").alias("query_id"), as_double(F.col("embedding")).alias("vector")
    )
    home = documents(spark, d).select("document_id", "kb_id")
    return (
        asked.join(vectors, "query_id")
        .withColumn("document_id", F.floor(F.col("query_id") / CHUNKS_PER_DOCUMENT))
        .join(home, "document_id")
        .select(
            "query_id",
            F.col("text").alias("query_text"),
            keywords(F.col("text")).alias("keywords"),
            "vector",
            "kb_id",
            "document_id",
        )
    )
