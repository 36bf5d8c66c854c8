"""Best-fit packing of documents into training sequences under conflicts of source and duplicate cluster."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_ROWS = 2048
PLACES = "doc_id long, piece int, n_tokens int, source string, cluster string, bin string, bin_offset int, bin_tokens int"


def bits_of(values) -> list[int]:
    """A bitmap for each value with one bit, numbered in order of first appearance; a null has none."""
    numbers = {}
    return [0 if v is None else 1 << numbers.setdefault(v, len(numbers)) for v in values]


def best_fit(lengths, sources, clusters, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, longest first.

    Open bins stand in order of what is left in them.  From the tightest that still holds the item the search goes on to
    the next larger until the bin has neither the item's source nor its cluster; without one a new bin is opened.
    """
    left: list[tuple[int, int]] = []  # (tokens left, bin), ascending
    seen_sources, seen_clusters, used, out = [], [], [], []
    for length, s, c in zip(lengths, bits_of(sources), bits_of(clusters), strict=True):
        at = bisect.bisect_left(left, (length, -1))
        while at < len(left) and (seen_sources[left[at][1]] & s or seen_clusters[left[at][1]] & c):
            at += 1
        if at < len(left):
            rest, number = left.pop(at)
        else:
            rest, number = capacity, len(used)
            seen_sources.append(0)
            seen_clusters.append(0)
            used.append(0)
        out.append((number, used[number]))
        seen_sources[number] |= s
        seen_clusters[number] |= c
        used[number] += length
        if rest > length:
            bisect.insort(left, (rest - length, number))
    return out


def pack_documents(documents: DataFrame, capacity: int = 2048, group_rows: int = GROUP_ROWS, cluster: str | None = None) -> DataFrame:
    """Where each document goes: (doc_id, piece, n_tokens, source, cluster, bin, bin_offset, bin_tokens).

    Tokens are words between white space.  A document longer than ``capacity`` is cut into pieces of that many tokens and
    a rest; full pieces fill a bin each.  Two documents of one source, or of one cluster of equal texts, never share a
    bin; a null source is in conflict with none.  Documents without tokens have one piece of none in no bin (null).
    Rows are dealt by a hash of id and text to groups of about ``group_rows``, packed on their own, so neither a source
    with a third of all rows nor a text with thousands of copies gathers in one task.  Repeated rows are packed each.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")))
    own = F.md5(text) if cluster is None else F.coalesce(F.concat(F.lit("c"), F.col(f"`{cluster}`").cast("string")), F.md5(text))
    sized = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), own.alias("cluster"), words.alias("words"))
    groups = max(1, math.ceil(documents.count() / group_rows))
    dealt = sized.withColumn("deal", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(groups)))
    return dealt.groupBy("deal").applyInPandas(_packer(capacity), PLACES)


def _packer(capacity: int):
    def pack(key, rows):
        rows = rows.sort_values(["doc_id", "cluster", "source"], kind="stable", ignore_index=True)
        counts = np.maximum(1, -(-rows.words.to_numpy() // capacity))
        out = rows.loc[np.repeat(np.arange(len(rows)), counts)].reset_index(drop=True)
        out["piece"] = np.concatenate([np.arange(c) for c in counts]) if len(rows) else []
        out["n_tokens"] = np.minimum(out.words - out.piece * capacity, capacity).astype("int32")
        held = out[out.n_tokens > 0].sort_values("n_tokens", ascending=False, kind="stable")
        sources = [None if x is None or x != x else x for x in held.source]
        places = best_fit(held.n_tokens.tolist(), sources, held.cluster.tolist(), capacity)
        spots = pd.DataFrame(places, index=held.index, columns=["number", "bin_offset"])
        total = held.n_tokens.groupby(spots.number).sum()
        out["bin"] = (f"{key[0]}-" + spots.number.astype(str)).reindex(out.index)
        out["bin"] = out["bin"].astype(object).where(out["bin"].notna(), None)
        out["bin_offset"] = spots.bin_offset.reindex(out.index).astype("Int32")
        out["bin_tokens"] = spots.number.map(total).reindex(out.index).astype("Int32")
        return out[["doc_id", "piece", "n_tokens", "source", "cluster", "bin", "bin_offset", "bin_tokens"]]

    return pack
