"""The evaluation table: every metric of every answered question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators import evaluation as V


def evaluate(answers: DataFrame, retrieved: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """One rounded row per answered question.

    answers   (question_id, question, generated_answer, ground_truth, answer_vector, truth_vector,
               faithfulness_reply, relevancy_reply, context_recall_reply)
    retrieved (question_id, rank, vector), relevant (question_id, rel_id, rel_vector)
    """
    rows = V.answered(answers)
    texts = rows.select(
        F.col("question_id").alias("id"), F.col("generated_answer").alias("answer"), F.col("ground_truth").alias("truth")
    )
    ranking = V.ranking_metrics(rows.select("question_id"), retrieved, relevant, k)
    answer, truth = F.col("generated_answer"), F.col("ground_truth")
    out = rows.join(ranking, "question_id").select(
        *ranking.columns,
        V.judge_score(F.col("faithfulness_reply"), answer).alias("faithfulness_score"),
        V.judge_score(F.col("relevancy_reply"), answer).alias("relevancy_score"),
        F.when(F.col("retrieved_contexts_count") > 0, V.judge_score(F.col("context_recall_reply"), truth))
        .otherwise(0.0)
        .alias("context_recall_score"),
        V.token_overlap(answer, truth).alias("similarity_score"),
        V.rouge_n(answer, truth, 1).alias("rouge_1"),
        V.rouge_n(answer, truth, 2).alias("rouge_2"),
        V.semantic_similarity(F.col("answer_vector"), F.col("truth_vector")).alias("semantic_similarity"),
    )
    for part in (V.bleu(texts), V.rouge_l(texts)):
        out = out.join(part.withColumnRenamed("id", "question_id"), "question_id")
    return V.rounded(out.withColumn("overall_score", V.overall()))
