"""Where callers plug in their own models: embeddings, reranker scores, length functions and methods by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import words
from docweave.functions import keywords as K
from docweave.functions.vectors import GROW
from docweave.operators.clusters import CLUSTERING, OUTLIERS, by_name


def embed(
    df: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text", into: str = "embedding"
) -> DataFrame:
    """Adds a vector per text.  ``make`` loads the model once per task and returns texts -> matrix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            yield batch.assign(**{into: list(np.asarray(model(batch[text].tolist()), dtype=float))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, `{into}` array<double>")


def score_pairs(
    df: DataFrame,
    make: Callable[[], Callable[[list[str], list[str]], np.ndarray]],
    query: str = "query_text",
    text: str = "chunk_text",
) -> DataFrame:
    """Adds rerank_score per (query, text) row; ``make`` loads the model once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            yield batch.assign(rerank_score=np.asarray(model(batch[query].tolist(), batch[text].tolist()), dtype=float))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, `rerank_score` double")


def keyword_method(name: str = "nlp", reply: Column | None = None) -> Callable[[Column], Column]:
    """text -> keywords.  'llm' reads a model's reply when there is one; anything else is the built-in method."""
    if name == "llm" and reply is not None:
        return lambda text: K.parse_keyword_lines(reply)
    return K.keywords


def resize_method(name: str) -> Callable[[Column, int], Column]:
    return by_name(GROW, name)


def clustering_method(name: str) -> Callable[..., DataFrame]:
    return by_name(CLUSTERING, name)


def outlier_method(name: str) -> Callable[[DataFrame], DataFrame]:
    return by_name(OUTLIERS, name)


def word_length(col: Column) -> Column:
    """Length in words, for splitters that count tokens."""
    return F.size(words(col))
