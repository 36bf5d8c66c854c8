"""Bitmaps of packing are exact for any number of sources; clusters may be given as a column."""

import collections

import numpy as np

from docweave.llm.packing import best_fit, pack_documents


def plain(lengths, sources, clusters, capacity):
    """The tightest bin without the item's source and cluster; of equal ones the oldest."""
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= n and s not in b["s"] and c not in b["c"]]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"left": capacity, "s": set(), "c": set()})
        out.append((i, capacity - bins[i]["left"]))
        bins[i]["left"] -= n
        bins[i]["s"] |= {s} - {None}
        bins[i]["c"] |= {c} - {None}
    return out


def test_against_plain_best_fit():
    draw = np.random.default_rng(5)
    for sources in (3, 40, 900):
        lengths = np.sort(draw.integers(1, 60, 800))[::-1].tolist()
        own = [None if x == 0 else f"s{x}" for x in draw.integers(0, sources, 800)]
        clusters = [f"c{x}" for x in draw.integers(0, 500, 800)]
        assert best_fit(lengths, own, clusters, 64) == plain(lengths, own, clusters, 64)


def test_many_sources_share_bins(spark):
    rows = [(i, f"source {i}", "a b c d", None if i >= 30 else i // 3) for i in range(512)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, component long")
    packed = pack_documents(docs.withColumn("text", docs.doc_id.cast("string")), capacity=64).collect()
    assert len({r.bin for r in packed}) == 8
    bins = collections.defaultdict(list)
    for r in pack_documents(docs, capacity=64, cluster="component").collect():
        bins[r.bin].append(r.cluster)
    assert all(len(x) == len(set(x)) for x in bins.values())
    assert sorted(x for b in bins.values() for x in b if x.startswith("c")).count("c4") == 3
