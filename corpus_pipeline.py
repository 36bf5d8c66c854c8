"""A corpus made ready for training in four stages; each works on all documents that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.lines import rests, with_columns
from docweave.llm.near import near_duplicates
from docweave.llm.packing import pack_documents
from docweave.llm.quality import keep_good
from docweave.session import scratch_path
from docweave.sources.readers import load


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on the labels, takes for good."""
    return keep_good(docs, load(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that resemble an earlier one; a document that is left without any word goes."""
    done = rests(docs)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"\S")
    kept = done.where(~F.coalesce(emptied, F.lit(False)))
    count = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return with_columns(kept, docs.columns, text=F.col("text"), n_chars=count)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: sets of five-word shingles with a similarity of 0.8 or more."""
    later = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in training sequences of 2,048 tokens."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("packing", packing)]

# The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each but the last written as Parquet and read again by the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        target = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(target)
        docs = spark.read.parquet(target)
    return STAGES[-1][1](spark, docs, sf_dir)
