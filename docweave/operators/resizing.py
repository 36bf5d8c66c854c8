"""Resizing studies: PCA, choice of method, and how well similarities survive."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions.vectors import cosine

# Weights of dimension ratio, budget and meaning, and the score table of the methods
# (ratio score inside its range, ratio score outside, budget score, meaning score; None = as required).
WEIGHTS = (0.5, 0.3, 0.2)
METHODS = {
    "linear": (0.9, 0.3, 0.9, None),
    "dct": (0.8, 0.4, 0.6, 0.9),
    "weighted": (0.9, 0.6, 0.7, 0.95),
    "pca": (0.9, 0.2, 0.9, 0.7),
}


def reduce_pca(df: DataFrame, vector: str, n: int) -> DataFrame:
    """First ``n`` principal components of a vector column, as ``reduced``."""
    rows = df.withColumn("_v", array_to_vector(F.col(vector)))
    model = PCA(k=n, inputCol="_v", outputCol="_r").fit(rows)
    return model.transform(rows).withColumn("reduced", vector_to_array("_r")).drop("_v", "_r")


def choose_method(source: Column, target: Column, meaning: float = 0.8) -> Column:
    """Best-scoring method for growing or shrinking from ``source`` to ``target`` dimensions; first wins ties."""
    ratio = target / source
    inside = {
        "linear": ratio <= 2,
        "dct": (ratio > 2) & (ratio <= 4),
        "weighted": ratio > 4,
        "pca": ratio < 0.5,
    }
    scores = {}
    for name, (good, poor, budget, keeps) in METHODS.items():
        fixed = WEIGHTS[1] * budget + WEIGHTS[2] * (meaning if keeps is None else keeps)
        scores[name] = F.when(inside[name], WEIGHTS[0] * good + fixed).otherwise(WEIGHTS[0] * poor + fixed)
    best = F.greatest(*scores.values())
    out = None
    for name, score in scores.items():
        out = F.when(score == best, name) if out is None else out.when(score == best, name)
    return out


def cosine_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(drift, pairs): mean absolute change of cosine between each vector and the next by id.

    (vec_id, vector) on both sides.  One neighbour per vector keeps the work linear in the table.
    """

    def neighbours(df, name):
        nxt = df.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vector").alias("next"))
        return df.join(nxt, "vec_id").select("vec_id", cosine(F.col("vector"), F.col("next")).alias(name))

    both = neighbours(before, "b").join(neighbours(after, "a"), "vec_id")
    return both.agg(F.avg(F.abs(F.col("b") - F.col("a"))).alias("drift"), F.count(F.lit(1)).alias("pairs"))


def best_per_method(results: DataFrame) -> DataFrame:
    """Best ratio and its preservation for each method of a study (method, ratio, preservation); of equals the least ratio."""
    return results.groupBy("method").agg(
        F.max_by("ratio", F.struct(F.col("preservation"), -F.col("ratio"))).alias("best_ratio"), F.max("preservation").alias("best_preservation")
    )


def method_distribution(decisions: DataFrame) -> DataFrame:
    """How often each method was chosen, and its share of all decisions."""
    counts = decisions.groupBy("method").agg(F.count(F.lit(1)).alias("selections"))
    every_method = W.partitionBy()  # one row per method by now
    return counts.withColumn("share", F.col("selections") / F.sum("selections").over(every_method))
