"""Question-answer sets from source records and papers.

Narrative records: n (position in the set), id, document, question, answers.  Paper records: id, title,
abstract, full_text (section_name[], paragraphs[][]), qas (question[], answers[]).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.common import is_json
from docweave.functions.text import strip
from docweave.operators.numbering import numbered

MISSING = "N/A"


def document_key(document_id: Column, own_id: Column, n: Column) -> Column:
    """document.id, else id, else item_<n>."""
    return F.coalesce(document_id.cast("string"), own_id.cast("string"), F.concat(F.lit("item_"), n.cast("string")))


def qa_content(document: Column) -> Column:
    """Content of a record for question answering: summary, else text, else full text."""
    return F.coalesce(document["summary"]["text"], document["text"], document["full_text"])


def qa_fields(df: DataFrame) -> DataFrame:
    """question, answers[] and kind with their fallbacks; the record's other columns stay."""
    texts = F.transform("answers", lambda a: a["text"])
    none = F.expr("cast(array() as array<string>)")
    return df.withColumns(
        {
            "question_text": F.coalesce(F.col("question.text"), F.col("question_plain"), F.lit(MISSING)),
            "answer_texts": F.coalesce(texts, F.when(F.col("answer_plain").isNotNull(), F.array("answer_plain")), none),
            "kind": F.coalesce(F.col("document.kind"), F.lit("unknown")),
        }
    )


def flatten_qa(df: DataFrame) -> DataFrame:
    """(question, ground_truth_answer, relevant_contexts, relevant_chunk_ids, source_document_id, n).

    All questions of a document share the content of its first record and one chunk id made from the document
    id.  The content is found by an aggregation and joined back, so a document with many questions spreads.
    """
    keyed = df.withColumn("source_document_id", F.coalesce(F.col("document.id").cast("string"), F.lit("unknown")))
    content = F.coalesce(qa_content(F.col("document")), F.lit(""))
    first = keyed.groupBy("source_document_id").agg(F.min_by(content, "n").alias("content"))
    none = F.expr("cast(array() as array<string>)")
    chunk_id = F.md5(F.col("source_document_id").cast("binary"))
    answers = F.coalesce(F.get(F.transform("answers", lambda a: a["text"]), F.lit(0)), F.col("answer_plain"), F.lit(""))
    question = F.coalesce(F.col("question.text"), F.col("question_plain"), F.lit(""))
    return (
        keyed.select("source_document_id", "n", question.alias("question"), answers.alias("ground_truth_answer"))
        .join(first, "source_document_id")
        .select(
            "question",
            "ground_truth_answer",
            F.when(F.col("content") != "", F.array("content")).otherwise(none).alias("relevant_contexts"),
            F.array(chunk_id).alias("relevant_chunk_ids"),
            "source_document_id",
            "n",
        )
    )


def first_documents(df: DataFrame, count: int = 5, key: str = "source_document_id") -> DataFrame:
    """All rows of the first ``count`` documents by first appearance."""
    first = df.groupBy(key).agg(F.min("n").alias("_n")).orderBy("_n").limit(count)
    return df.join(first.select(key), key, "left_semi")


def document_stats(df: DataFrame, key: str = "source_document_id") -> DataFrame:
    """Questions, kind and words of each document, taken from its first record."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("qa_count"),
        F.coalesce(F.min_by(F.col("document.kind"), "n"), F.lit("unknown")).alias("kind"),
        F.coalesce(F.min_by(F.col("document.word_count"), "n"), F.lit(0)).cast("long").alias("word_count"),
    )


def document_mapping(df: DataFrame, key: str = "source_document_id", page_size: int = 1000) -> DataFrame:
    """(key, page, questions[], answers[], original_indices[]) in order of appearance.

    The lists of a document come in pages of ``page_size`` entries, so one document never fills a task.
    """
    rows = numbered(df, "n", keys=[key], into="_row").withColumn("page", F.floor((F.col("_row") - 1) / page_size))
    item = F.struct("n", F.col("question_text").alias("q"), F.array_join("answer_texts", " | ").alias("a"))
    pages = rows.groupBy(key, "page").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return pages.select(
        key,
        "page",
        F.col("items.q").alias("questions"),
        F.col("items.a").alias("answers"),
        F.col("items.n").alias("original_indices"),
    )


def explode_paper_qa(df: DataFrame) -> DataFrame:
    """One row per question that has an answer entry: first answer, free form before spans, evidence as contexts."""
    zipped = F.arrays_zip(
        F.col("qas.question").alias("question"),
        F.slice(F.col("qas.answers"), 1, F.size("qas.question")).alias("answers"),
    )
    pairs = df.select("id", F.size("qas.answers").alias("n_answers"), F.posexplode(zipped).alias("i", "qa"))
    best = F.get(F.col("qa.answers.answer"), F.lit(0))
    none = F.expr("cast(array() as array<string>)")
    spans = F.when(F.size(best["extractive_spans"]) > 0, F.array_join(best["extractive_spans"], " "))
    free = F.when(best["free_form_answer"] != "", best["free_form_answer"])
    return pairs.filter(F.col("i") < F.col("n_answers")).select(
        F.col("qa.question").alias("question"),
        F.coalesce(free, spans, F.lit("")).alias("ground_truth_answer"),
        F.coalesce(best["evidence"], none).alias("relevant_contexts"),
        F.array(F.concat(F.lit("qasper_"), F.col("id").cast("string"), F.lit("_"), F.col("i").cast("string"))).alias(
            "relevant_chunk_ids"
        ),
        F.col("id").cast("string").alias("source_document_id"),
    )


def paper_qa_arrays(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("id").cast("string").alias("source_document_id"),
        F.col("qas.question").alias("question"),
        F.col("qas.answers").alias("answers"),
    )


def paper_to_text(df: DataFrame) -> DataFrame:
    """(id, text): title, abstract, then each section heading with its non-blank paragraphs, one per line."""
    sections = F.zip_with(
        F.col("full_text.section_name"),
        F.slice(F.col("full_text.paragraphs"), 1, F.size("full_text.section_name")),
        lambda name, ps: F.concat(
            F.array(name), F.filter(F.coalesce(ps, F.expr("cast(array() as array<string>)")), lambda p: strip(p) != "")
        ),
    )
    lines = F.concat(
        F.array("title", F.lit("Abstract"), "abstract", F.lit("Full Text")), F.flatten(sections)
    )
    return df.select("id", F.array_join(lines, "\n").alias("text"))


def parse_generated_qa(df: DataFrame) -> DataFrame:
    """Questions out of a model's JSON reply with the chunk they came from; replies that are no array are dropped.

    df (chunk_id, document_id, chunk_text, reply)
    """
    schema = "array<struct<question: string, ground_truth_answer: string>>"
    is_array = strip(F.col("reply")).startswith("[") & is_json(F.col("reply"))
    parsed = df.filter(is_array).withColumn("qa", F.explode(F.from_json("reply", schema)))
    return parsed.select(
        F.coalesce("qa.question", F.lit(MISSING)).alias("question"),
        F.coalesce("qa.ground_truth_answer", F.lit(MISSING)).alias("ground_truth_answer"),
        F.array("chunk_text").alias("relevant_contexts"),
        F.array(F.col("chunk_id").cast("string")).alias("relevant_chunk_ids"),
        F.coalesce(F.col("document_id").cast("string"), F.lit("unknown_document")).alias("source_document_id"),
    )


def append_dataset(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def first_n(df: DataFrame, n: int, order: str = "n") -> DataFrame:
    return df.orderBy(order).limit(n)
