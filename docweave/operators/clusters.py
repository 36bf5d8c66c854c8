"""Clusters of the sentences of a document, and what to do with sentences outside any cluster.

Tables hold (doc_id, pos, sentence) and maybe vector, and labels are integers, -1 for outliers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.operators.components import components as linked_components
from docweave.operators.documents import Batch, Document, by_size, counted, map_documents
from docweave.operators.similarity import (
    are_close,
    close_forest,
    distinct_rows,
    distinct_sentences,
    nearest_member,
    neighbours,
)
from docweave.operators.tiles import lowest_linked
from docweave.session import checkpointed


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, pos, root): connected components, root = lowest position in the component.

    Sentences are linked as (doc_id, pos); the star steps go on until nothing moves, and their rounds grow with the
    logarithm of the component's size, also along chains.
    """
    ends = [F.struct("doc_id", F.col(c).alias("pos")).alias(c) for c in ("a", "b")]
    found = linked_components(edges.select(*ends))
    roots = found.select("node.doc_id", "node.pos", F.col("component.pos").alias("root"))
    joined = nodes.select("doc_id", "pos").join(roots, ["doc_id", "pos"], "left")
    return joined.withColumn("root", F.coalesce("root", "pos"))


def _label_copies(sentences: DataFrame, labels: DataFrame) -> DataFrame:
    """Give every copy of a sentence the label of its first occurrence; the sentences' columns and label."""
    firsts = labels.withColumnRenamed("pos", "first")
    return (
        distinct_sentences(sentences)
        .join(firsts, ["doc_id", "first"])
        .select("doc_id", "pos", "label")
        .join(sentences, ["doc_id", "pos"])
        .select(*sentences.columns, "label")
    )


def _numbered_by_root(roots: DataFrame) -> DataFrame:
    """Roots of a document as labels 0, 1, 2 ... in order of position."""
    return roots.withColumn("label", F.dense_rank().over(W.partitionBy("doc_id").orderBy("root")) - 1)


def _clustered(sentences: DataFrame, label_document, label_larger) -> DataFrame:
    """The sentences with a label: documents that fit one tile where they lie, by ``label_document`` of their distinct
    sentences, larger ones by ``label_larger``, which works on tables."""
    small, large = by_size(counted(sentences))

    def label(doc: Document, batch: Batch):
        return np.arange(doc.start, doc.stop), {"label": label_document(doc.side, doc.sims)[doc.place]}

    found = map_documents(small, label, sentences.columns, "label long")
    larger = checkpointed(large.where("doc_id is not null").select(*sentences.columns))
    if larger.isEmpty():
        return found
    return found.unionByName(label_larger(larger).withColumn("label", F.col("label").cast("long")))


def cluster_threshold(sentences: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Clusters = connected components of the sentences at least ``threshold`` similar."""
    if threshold <= 0:
        raise ValueError("the threshold must be positive")

    def label_document(side, sims):
        return np.unique(lowest_linked(are_close(side, side, sims, threshold)), return_inverse=True)[1]

    def label_larger(larger):
        rows = checkpointed(distinct_rows(larger))
        roots = components(rows.select("doc_id", "pos"), close_forest(rows, threshold))
        return _label_copies(larger, _numbered_by_root(roots).select("doc_id", "pos", "label"))

    return _clustered(sentences, label_document, label_larger)


def cluster_density(
    sentences: DataFrame, threshold: float = 0.3, min_cluster_size: int = 10, min_samples: int | None = None
) -> DataFrame:
    """Density clusters at distance 1 - threshold; smaller than ``min_cluster_size`` counts as outliers.

    A sentence is dense when its ``min_samples``-th nearest other sentence lies within the distance.  Dense
    sentences within the distance of each other are connected; all others get label -1.
    """
    samples = min_samples if min_samples else max(1, min_cluster_size // 2)
    epsilon = 1 - threshold
    close = 1 - epsilon * epsilon / 2
    if close <= 0:
        raise ValueError("the threshold must leave a positive similarity")

    def label_document(side, sims):
        linked = are_close(side, side, sims, close)
        dense = linked @ side.copies + side.copies - 1 >= samples
        lowest = lowest_linked(linked & dense[:, None] & dense[None, :])
        size = np.bincount(lowest[dense], side.copies[dense], len(lowest))
        kept = dense & (size[lowest] >= min_cluster_size)
        labels = np.full(len(lowest), -1)
        labels[kept] = np.unique(lowest[kept], return_inverse=True)[1]
        return labels

    def label_larger(larger):
        rows = checkpointed(distinct_rows(larger))
        firsts = rows.select("doc_id", "pos", "copies")
        near = neighbours(rows, close)
        dense = checkpointed(
            firsts.join(near, ["doc_id", "pos"], "left")
            .filter(F.coalesce("near", F.lit(0)) + F.col("copies") - 1 >= samples)
            .select("doc_id", "pos", "copies")
        )
        links = close_forest(rows.join(dense.select("doc_id", "pos"), ["doc_id", "pos"], "left_semi"), close)
        roots = components(dense, links).join(dense, ["doc_id", "pos"])
        sized = roots.withColumn("size", F.sum("copies").over(W.partitionBy("doc_id", "root")))
        labels = _numbered_by_root(sized.filter(F.col("size") >= min_cluster_size)).select("doc_id", "pos", "label")
        everyone = firsts.select("doc_id", "pos").join(labels, ["doc_id", "pos"], "left")
        return _label_copies(larger, everyone.withColumn("label", F.coalesce("label", F.lit(-1))))

    return _clustered(sentences, label_document, label_larger)


CLUSTERING = {"threshold": cluster_threshold, "density": cluster_density}


def outliers_nearest(labelled: DataFrame) -> DataFrame:
    """Outliers take the label of their most similar labelled sentence; without any, all become cluster 0."""
    small, large = by_size(counted(labelled))
    is_outlier = F.coalesce(F.col("label") == -1, F.lit(False))

    def nearest(doc: Document, batch: Batch):
        outlier = batch.rows["_outlier"].slice(doc.start, doc.stop - doc.start).to_numpy(zero_copy_only=False)
        found, members = np.zeros(len(outlier), np.int64), np.flatnonzero(~outlier)
        if len(members):
            own = batch.rows["_label"].slice(doc.start, doc.stop - doc.start).to_numpy()
            found[outlier] = own[members[np.round(doc.sims[np.ix_(outlier, members)], 9).argmax(axis=1)]]
        return np.arange(doc.start, doc.stop), {"near_label": found}

    extra = {"_outlier": is_outlier, "_label": F.coalesce(F.col("label").cast("long"), F.lit(0))}
    in_place = map_documents(small, nearest, labelled.columns, "near_label long", distinct=False, extra=extra)
    kind = labelled.schema["label"].dataType
    label = F.when(F.col("label") == -1, F.coalesce("near_label", F.lit(0)).cast(kind)).otherwise(F.col("label"))
    larger = large.select(*labelled.columns)
    if larger.isEmpty():
        return in_place.withColumn("label", label).select(*labelled.columns)
    target = larger.select("doc_id", F.col("pos").alias("near_pos"), F.col("label").cast("long").alias("near_label"))
    found = nearest_member(larger).join(target, ["doc_id", "near_pos"]).select("doc_id", "pos", "near_label")
    joined = larger.join(found, ["doc_id", "pos"], "left")
    return in_place.unionByName(joined).withColumn("label", label).select(*labelled.columns)


def outliers_separate(labelled: DataFrame) -> DataFrame:
    """One new label for each outlier, by position, after the highest label."""
    doc = W.partitionBy("doc_id")
    so_far = F.sum(F.when(F.col("label") == -1, 1).otherwise(0)).over(
        doc.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    )
    label = F.when(F.col("label") == -1, F.max("label").over(doc) + so_far).otherwise(F.col("label"))
    return labelled.withColumn("label", label)


def outliers_singleton(labelled: DataFrame) -> DataFrame:
    """One shared label for all outliers, after the highest label."""
    label = F.when(F.col("label") == -1, F.max("label").over(W.partitionBy("doc_id")) + 1).otherwise(F.col("label"))
    return labelled.withColumn("label", label)


OUTLIERS = {"nearest": outliers_nearest, "separate": outliers_separate, "singleton": outliers_singleton}


def by_name(registry: dict, name: str):
    """Look a method up by name; an unknown name is an error."""
    if name not in registry:
        raise ValueError(f"unknown method {name!r}; known: {sorted(registry)}")
    return registry[name]


def cluster_stats(labelled: DataFrame, samples: int = 2) -> DataFrame:
    """Sentences per cluster, clusters in the document, and the first ``samples`` sentences of each cluster."""
    short = F.when(F.length("sentence") > 100, F.concat(F.substring("sentence", 1, 97), F.lit("..."))).otherwise(
        F.col("sentence")
    )
    sizes = labelled.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("sentences"))
    sizes = sizes.withColumn("clusters", F.count(F.lit(1)).over(W.partitionBy("doc_id")))
    first = W.partitionBy("doc_id", "label").orderBy("pos")
    shown = labelled.withColumn("sample", F.row_number().over(first)).filter(F.col("sample") <= samples)
    return shown.join(sizes, ["doc_id", "label"]).select(
        "doc_id", "label", "clusters", "sentences", "sample", short.alias("sentence")
    )


def order_sentences(labelled: DataFrame, preserve: bool = True) -> DataFrame:
    """``place`` of each sentence: its position, or its rank by label and then position."""
    if preserve:
        return labelled.withColumn("place", F.col("pos").cast("long"))
    ranked = F.row_number().over(W.partitionBy("doc_id").orderBy("label", "pos"))
    return labelled.withColumn("place", (ranked - 1).cast("long"))
