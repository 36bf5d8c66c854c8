"""Scores of retrieval and of answers, and statistics over result tables.

retrieved (question_id, rank, vector), relevant (question_id, rel_id, rel_vector), questions (question_id).
A question has the few results it asked for and its short list of relevant texts, so pairs stay small.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from docweave.functions.common import let
from docweave.functions.text import normalize_answer, strip, words
from docweave.functions.vectors import cosine

# Columns that are no metrics, the metric groups, and the terms and divisor of the overall score.
NOT_METRICS = ["question_id", "question", "generated_answer", "ground_truth", "retrieved_contexts_count"]
CATEGORIES = {
    "Core Quality": ["faithfulness_score", "relevancy_score", "context_recall_score", "similarity_score"],
    "Retrieval": ["precision_at_k", "recall_at_k", "mrr", "ndcg"],
    "Text Quality": ["bleu", "rouge_1", "rouge_2", "rouge_l"],
    "Semantic": ["semantic_similarity"],
    "Overall": ["overall_score"],
}
OVERALL_TERMS = [
    "faithfulness_score", "relevancy_score", "context_recall_score", "similarity_score",
    "precision_at_k", "recall_at_k", "mrr", "ndcg",
    "bleu", "bleu_1", "bleu_4", "semantic_similarity",
]
OVERALL_DIVISOR = 13


# --- ranking metrics -----------------------------------------------------------------------------------


def scored_pairs(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """(question_id, rank, rel_id, sim) of every retrieved with every relevant text of a question."""
    joined = retrieved.join(relevant, "question_id")
    sim = F.round(F.coalesce(cosine(F.col("vector"), F.col("rel_vector")), F.lit(0.0)), 9)
    return joined.select("question_id", "rank", "rel_id", sim.alias("sim"))


def matches(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(question_id, rank, hit): is any relevant text more similar than ``threshold``?"""
    return pairs.groupBy("question_id", "rank").agg(F.max(F.col("sim") > threshold).alias("hit"))


def _per_question(questions: DataFrame, scored: DataFrame, *names: str) -> DataFrame:
    joined = questions.select("question_id").join(scored, "question_id", "left")
    return joined.select("question_id", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def precision_at_k(questions: DataFrame, pairs: DataFrame, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """Matching results among the first k, divided by k even when fewer came back."""
    hits = matches(pairs, threshold).filter(F.col("hit") & (F.col("rank") <= k))
    return _per_question(
        questions, hits.groupBy("question_id").agg((F.count(F.lit(1)) / k).alias("precision_at_k")), "precision_at_k"
    )


def recall_multi_k(
    questions: DataFrame, pairs: DataFrame, relevant: DataFrame, ks: list[int], threshold: float = 0.2
) -> DataFrame:
    """recall_at_<k> for each k: relevant texts matched by the first k results, over all relevant texts."""
    first_match = pairs.filter(F.col("sim") > threshold).groupBy("question_id", "rel_id").agg(F.min("rank").alias("rank"))
    found = first_match.groupBy("question_id").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"recall_at_{k}") for k in ks]
    )
    totals = relevant.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    shares = totals.join(found, "question_id", "left").select(
        "question_id", *[(F.coalesce(f"recall_at_{k}", F.lit(0)) / F.col("n_relevant")).alias(f"recall_at_{k}") for k in ks]
    )
    return _per_question(questions, shares, *[f"recall_at_{k}" for k in ks])


def recall_at_k(questions: DataFrame, pairs: DataFrame, relevant: DataFrame, k: int = 5, threshold: float = 0.3) -> DataFrame:
    return recall_multi_k(questions, pairs, relevant, [k], threshold).withColumnRenamed(f"recall_at_{k}", "recall_at_k")


def mrr(questions: DataFrame, pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    first = pairs.filter(F.col("sim") > threshold).groupBy("question_id").agg((1.0 / F.min("rank")).alias("mrr"))
    return _per_question(questions, first, "mrr")


def ndcg(
    questions: DataFrame, pairs: DataFrame, relevant: DataFrame, k: int = 5, threshold: float = 0.5, capped: bool = False
) -> DataFrame:
    """Gain of all matching results over that of min(relevant, k) ideal ones; may pass 1 unless ``capped``."""
    gained = (
        matches(pairs, threshold)
        .filter(F.col("hit") & (F.col("rank") <= k))
        .groupBy("question_id")
        .agg(F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    )
    n = relevant.groupBy("question_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    share = F.col("dcg") / ideal
    scored = gained.join(n, "question_id").select(
        "question_id", (F.least(share, F.lit(1.0)) if capped else share).alias("ndcg")
    )
    return _per_question(questions, scored, "ndcg")


def ranking_metrics(questions: DataFrame, retrieved: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """Count of results and all ranking metrics per question, in one pass over the pairs.

    Each pair counts once for its result and once for its relevant text; both sides are then summed together.
    """
    sim = F.round(F.coalesce(cosine(F.col("vector"), F.col("rel_vector")), F.lit(0.0)), 9)
    pairs = retrieved.join(relevant, "question_id", "left").select("question_id", "rank", "rel_id", sim.alias("sim"))
    none = F.lit(None).cast(relevant.schema["rel_id"].dataType)
    result = F.struct(F.lit(0).alias("side"), F.col("rank").cast("long").alias("key"), none.alias("text"))
    text = F.struct(F.lit(1).alias("side"), F.lit(None).cast("long").alias("key"), F.col("rel_id").alias("text"))
    first = F.col("key")
    per_key = (
        pairs.select("question_id", "rank", "sim", F.explode(F.array(result, text)).alias("of"))
        .select("question_id", "rank", "sim", "of.*")
        .groupBy("question_id", "side", "key", "text")
        .agg(
            F.max(F.col("sim") > 0.5).alias("hit"),
            F.min(F.when(F.col("sim") > 0.3, F.col("rank"))).alias("rank_3"),
            F.min(F.when(F.col("sim") > 0.2, F.col("rank"))).alias("rank_2"),
        )
    )
    is_result, is_text = F.col("side") == 0, (F.col("side") == 1) & F.col("text").isNotNull()
    hit = is_result & F.coalesce("hit", F.lit(False))
    hit_at_k = hit & (first <= k)
    n = F.count_if(is_text)
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.col("n"), F.lit(k)), F.lit(1)).cast("int")),
        F.lit(0.0),
        lambda s, i: s + 1.0 / F.log2(i + 1.0),
    )

    def recall(rank, at):
        return F.count_if(is_text & (F.col(rank) <= at))

    sums = per_key.groupBy("question_id").agg(
        F.count_if(is_result).alias("retrieved_contexts_count"),
        n.alias("n"),
        (F.count_if(hit_at_k) / k).alias("precision_at_k"),
        F.min(F.when(hit, first)).alias("first_hit"),
        F.sum(F.when(hit_at_k, 1.0 / F.log2(first + 1.0)).otherwise(0.0)).alias("dcg"),
        recall("rank_3", k).alias("r_k"),
        *[recall("rank_2", i).alias(f"r_{i}") for i in range(1, 6)],
    )

    def share(name):
        return F.when(F.col("n") > 0, F.col(name) / F.col("n"))

    metrics = sums.select(
        "question_id",
        "retrieved_contexts_count",
        "precision_at_k",
        share("r_k").alias("recall_at_k"),
        *[share(f"r_{i}").alias(f"recall_at_{i}") for i in range(1, 6)],
        (1.0 / F.col("first_hit")).alias("mrr"),
        (F.col("dcg") / ideal).alias("ndcg"),
    )
    joined = questions.select("question_id").join(metrics, "question_id", "left")
    return joined.fillna(0, [c for c in metrics.columns if c != "question_id"])


# --- text metrics: rows (id, answer, truth) -------------------------------------------------------------


def answer_words(col: Column) -> Column:
    return words(normalize_answer(col))


def _ngrams(ws: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(ws) - n + 1)
    grams = F.transform(starts, lambda i: F.array_join(F.slice(ws, i, n), " "))
    return F.when(F.size(ws) >= n, grams).otherwise(F.expr("cast(array() as array<string>)"))


def _numbered(grams: Column) -> Column:
    """Sorted n-grams, each with its number among its equals, so that shared ones can be counted as sets."""

    def numbers(s):
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, F.greatest(i - 1, F.lit(0)))))
        return let(
            F.struct(s.alias("s"), starts.alias("at")),
            lambda r: F.flatten(
                F.transform(r["at"], lambda at, j: F.sequence(F.lit(1), F.coalesce(F.get(r["at"], j + 1), F.size(r["s"])) - at))
            ),
        )

    def of(s):
        marked = F.zip_with(s, numbers(s), lambda g, i: F.concat(g, F.lit("\0"), i.cast("string")))
        return F.when(F.size(s) > 0, marked).otherwise(s)

    return let(F.sort_array(grams), of)


def bleu(df: DataFrame, weights: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """(id, <name> ...): sentence BLEU with a brevity penalty, zero counts smoothed to 0.1.

    ``weights`` names the scores, by default bleu, bleu_1 and bleu_4.  Both texts are on one row and are compared there: an
    n-gram counts as often as the answer and the truth both hold it.  A missing text counts as none.
    """
    wanted = weights or {"bleu": (0.25,) * 4, "bleu_1": (1.0, 0.0, 0.0, 0.0), "bleu_4": (0.25,) * 4}

    def ws(col):
        return F.coalesce(answer_words(F.col(col)), F.expr("cast(array() as array<string>)"))

    def matched(n):
        def shared(s):
            return F.size(F.array_intersect(_numbered(_ngrams(s["cand"], n)), _numbered(_ngrams(s["ref"], n))))

        return let(F.struct("cand", "ref"), shared).alias(f"m{n}")

    sized = df.select("id", ws("answer").alias("cand"), ws("truth").alias("ref"))
    counted = sized.select("id", F.size("cand").alias("c"), F.size("ref").alias("r"), *[matched(n) for n in range(1, 5)])

    def precision(n):
        own, total = F.col(f"m{n}"), F.greatest(F.col("c") - (n - 1), F.lit(1))
        return F.when(own == 0, F.lit(0.1)).otherwise(own) / total

    brevity = F.when(F.col("c") > F.col("r"), 1.0).when(F.col("c") == 0, 0.0).otherwise(F.exp(1.0 - F.col("r") / F.col("c")))

    def score(ws):
        logs = reduce(lambda a, b: a + b, [F.lit(float(w)) * F.log(precision(n)) for n, w in enumerate(ws, 1)])
        return F.when(F.col("m1") == 0, 0.0).otherwise(brevity * F.exp(logs))

    return counted.select("id", *[score(ws).alias(name) for name, ws in wanted.items()])


def bleu_n(df: DataFrame) -> DataFrame:
    return bleu(df, {"bleu_1": (1.0, 0.0, 0.0, 0.0), "bleu_4": (0.25,) * 4})


def rouge_n(answer: Column, truth: Column, n: int) -> Column:
    """F of distinct n-grams shared by answer and truth."""

    def score(s):
        shared = F.size(F.array_intersect(s["a"], s["b"]))
        p = F.when(F.size(s["a"]) > 0, shared / F.size(s["a"])).otherwise(0.0)
        r = F.when(F.size(s["b"]) > 0, shared / F.size(s["b"])).otherwise(0.0)
        return 2.0 * (p * r) / (p + r + 1e-8)

    def grams(col):
        return F.array_distinct(let(answer_words(col), lambda ws: _ngrams(ws, n)))

    return let(F.struct(grams(answer).alias("a"), grams(truth).alias("b")), score)


def _lcs_length(a: list, b: list) -> int:
    """Longest common subsequence, one bit per element of ``a``."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    free = full
    for x in b:
        used = free & where.get(x, 0)
        free = ((free + used) | (free - used)) & full
    return len(a) - free.bit_count()


@F.pandas_udf(ST.LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_lcs_length(list(x), list(y)) for x, y in zip(a, b)], index=a.index, dtype="int64")


def rouge_l(df: DataFrame) -> DataFrame:
    """(id, rouge_l): F of the longest common subsequence of words."""
    rows = df.select("id", answer_words(F.col("answer")).alias("a"), answer_words(F.col("truth")).alias("b"))
    scored = rows.select("id", F.size("a").alias("n"), F.size("b").alias("m"), lcs_length("a", "b").alias("lcs"))
    p = F.when(F.col("n") > 0, F.col("lcs") / F.col("n")).otherwise(0.0)
    r = F.when(F.col("m") > 0, F.col("lcs") / F.col("m")).otherwise(0.0)
    return scored.select("id", (2.0 * (p * r) / (p + r + 1e-8)).alias("rouge_l"))


def token_overlap(answer: Column, truth: Column) -> Column:
    """Share of the distinct words of the truth that occur in the answer; 0 when either is empty."""

    def share(s):
        return F.when(F.size(s["b"]) > 0, F.size(F.array_intersect(s["a"], s["b"])) / F.size(s["b"])).otherwise(0.0)

    sets = F.struct(F.array_distinct(answer_words(answer)).alias("a"), F.array_distinct(answer_words(truth)).alias("b"))
    return F.coalesce(let(sets, share), F.lit(0.0))


def semantic_similarity(a: Column, b: Column) -> Column:
    return F.coalesce(cosine(a, b), F.lit(0.0))


def judge_score(reply: Column, *inputs: Column) -> Column:
    """A 0-10 reply as 0..1; 0.5 when it is no number, 0 when an input is blank."""
    text = strip(reply)
    number = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    score = F.when(number.isNull(), 0.5).otherwise(F.least(F.greatest(number / 10.0, F.lit(0.0)), F.lit(1.0)))
    for col in inputs:
        score = F.when(F.coalesce(col, F.lit("")) == "", 0.0).otherwise(score)
    return score


def overall(terms: list[str] | None = None, divisor: int = OVERALL_DIVISOR) -> Column:
    """Sum of twelve terms over thirteen; pass 12 for a true mean."""
    return reduce(lambda a, b: a + b, [F.col(t) for t in (terms or OVERALL_TERMS)]) / divisor


def answered(df: DataFrame, answer: str = "generated_answer") -> DataFrame:
    return df.filter(F.coalesce(answer, F.lit("")) != "")


# --- statistics over result tables ---------------------------------------------------------------------


def numeric_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    """Columns that hold numbers and are no ids, texts or counts."""
    banned = NOT_METRICS if exclude is None else exclude
    return [f.name for f in df.schema.fields if isinstance(f.dataType, ST.NumericType) and f.name not in banned]


def _long(df: DataFrame, metrics: list[str] | None) -> DataFrame:
    cols = metrics or numeric_columns(df)
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    return doubles.unpivot([], cols, "metric", "value").filter("value is not null")


def metric_stats(df: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """(metric, average, std, min, max, count), 4 places, population deviation, sorted by metric."""
    stats = _long(df, metrics).groupBy("metric").agg(
        F.round(F.avg("value"), 4).alias("average"),
        F.round(F.stddev_pop("value"), 4).alias("std"),
        F.round(F.min("value"), 4).alias("min"),
        F.round(F.max("value"), 4).alias("max"),
        F.count(F.lit(1)).alias("count"),
    )
    return stats.orderBy("metric")


def quick_stats(df: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    return metric_stats(df, metrics).drop("std")


def category_summary(stats: DataFrame, categories: dict[str, list[str]] | None = None) -> DataFrame:
    """(category, category_average, metrics_count, best_metric, best_score) from metric statistics."""
    table = CATEGORIES if categories is None else categories
    entries = [(m, c, i) for c, ms in table.items() for i, m in enumerate(ms)]
    where = F.create_map(
        *[x for m, c, i in entries for x in (F.lit(m), F.struct(F.lit(c).alias("category"), F.lit(i).alias("place")))]
    )
    placed = stats.withColumn("at", F.try_element_at(where, F.col("metric"))).filter("at is not null")
    best = F.min(F.struct((-F.col("average")).alias("neg"), F.col("at.place").alias("place"), "metric"))
    return placed.groupBy(F.col("at.category").alias("category")).agg(
        F.round(F.avg("average"), 4).alias("category_average"),
        F.count(F.lit(1)).alias("metrics_count"),
        best["metric"].alias("best_metric"),
        (-best["neg"]).alias("best_score"),
    )


def union_results(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def rounded(df: DataFrame, places: int = 3) -> DataFrame:
    return df.select(
        *[F.round(f.name, places).alias(f.name) if isinstance(f.dataType, ST.DoubleType) else f.name for f in df.schema.fields]
    )
