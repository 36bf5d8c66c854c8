"""Text to chunks with keywords, in one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import folds
from docweave.functions.common import let
from docweave.functions.keywords import keywords
from docweave.functions.text import prepared_sentences
from docweave.operators import chunking, clusters
from docweave.operators.similarity import adjacent_similarity


@dataclass(frozen=True)
class ChunkingConfig:
    """The published defaults."""

    threshold: float = 0.3
    min_sentence_length: int = 4
    min_chunk_size: int = 50
    max_chunk_size: int = 2000
    overlap_size: int = 0
    use_clustering: bool = True
    preserve_order: bool = True
    clustering_method: str = "density"
    min_cluster_size: int = 10
    outlier_handling: str = "nearest"


def _with_keywords(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("keywords", keywords(F.col("text")))


Embed = Callable[[DataFrame], DataFrame]


def _as_is(rows: DataFrame) -> DataFrame:
    return rows


def sequential_chunks(df: DataFrame, cfg: ChunkingConfig, embed: Embed = _as_is) -> DataFrame:
    """Neighbouring sentences stay together while they are similar enough.

    The sentence arrays are made once and exchanged once by doc_id; the similarities, the grouping and the folds
    all use that layout.
    """
    prepared = prepared_sentences(F.col("text"), cfg.min_sentence_length).alias("sentences")
    docs = df.filter("doc_id is not null").select("doc_id", prepared).repartition("doc_id")
    # The outer form keeps Spark from testing the array (and making it once more) before the exchange, so that
    # both uses of the exchange stay the same and it runs once.
    rows = docs.select("doc_id", F.posexplode_outer("sentences").alias("pos", "sentence")).filter("pos is not null")
    cuts = (
        adjacent_similarity(embed(rows), laid_out=True)
        .filter(F.col("sim") < cfg.threshold)
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list("pos")).alias("cuts"))
    )

    def groups(s):
        bounds = F.concat(F.array(F.lit(0)), F.coalesce(s["cuts"], F.expr("cast(array() as array<int>)")))

        def sliced(bs):
            return F.transform(
                bs,
                lambda b, i: F.slice(
                    s["sentences"], b + 1, F.coalesce(F.get(bs, i + 1), F.size(s["sentences"])) - b
                ),
            )

        return F.filter(let(bounds, sliced), lambda g: F.size(g) > 0)

    grouped = docs.join(cuts, "doc_id", "left").select(
        "doc_id", let(F.struct("sentences", "cuts"), groups).alias("groups")
    )
    parts = folds.split_oversized(F.col("groups"), cfg.max_chunk_size)
    merged = folds.merge_small(parts, cfg.min_chunk_size)
    return grouped.select("doc_id", F.posexplode(merged).alias("chunk", "text")).withColumn(
        "chunk", F.col("chunk").cast("long")
    )


def clustered_chunks(df: DataFrame, cfg: ChunkingConfig, embed: Embed = _as_is) -> DataFrame:
    """Sentences are clustered, outliers placed, and runs of one cluster packed to chunks."""
    rows = df.select(
        "doc_id", F.posexplode(prepared_sentences(F.col("text"), cfg.min_sentence_length)).alias("pos", "sentence")
    )
    rows = embed(rows)
    method = clusters.by_name(clusters.CLUSTERING, cfg.clustering_method)
    if cfg.clustering_method == "density":
        labelled = method(rows, cfg.threshold, cfg.min_cluster_size)
        labelled = clusters.by_name(clusters.OUTLIERS, cfg.outlier_handling)(labelled)
    else:
        labelled = method(rows, cfg.threshold)
    placed = clusters.order_sentences(labelled, cfg.preserve_order)
    packed = folds.pack(F.col("sentences"), cfg.max_chunk_size)
    one_row = chunking.on_one_row(placed, "place").select("doc_id", packed.alias("packed"))
    parts = F.transform("packed", lambda t: F.struct(t.alias("text"), F.lit(False).alias("part")))
    merged = one_row.select("doc_id", folds.merge_small(parts, cfg.min_chunk_size).alias("merged"))
    final = folds.add_overlap(F.col("merged"), cfg.overlap_size)
    return merged.select("doc_id", F.posexplode(final).alias("chunk", "text")).withColumn(
        "chunk", F.col("chunk").cast("long")
    )


def semantic_chunks(df: DataFrame, cfg: ChunkingConfig = ChunkingConfig(), embed: Embed = _as_is) -> DataFrame:
    """(doc_id, chunk, text, keywords) of a document table.

    Sentences are compared by TF-IDF, or by the column `vector` that `embed` adds to their rows (doc_id, pos, sentence), as
    `hooks.embed` does with a caller's model.
    """
    build = clustered_chunks if cfg.use_clustering else sequential_chunks
    return _with_keywords(build(df, cfg, embed))
