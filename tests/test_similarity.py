import re
from collections import Counter
from math import log, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.operators import clusters as G
from docweave.operators import similarity as M
from docweave.operators import tiles

TEXTS = ["red green blue", "red green blue", "green blue sky", "sky high", "!!", "red sky green", "red green blue", "high low", "low"]


def matrix(texts):
    toks = [Counter(re.findall(r"\w\w+", t.lower())) for t in texts]
    names = sorted({t for c in toks for t in c})
    df = {t: sum(t in c for c in toks) for t in names}
    out = np.array([[c[t] * (log((1 + len(texts)) / (1 + df[t])) + 1) for t in names] for c in toks])
    size = np.linalg.norm(out, axis=1, keepdims=True)
    out = np.divide(out, size, out=np.zeros_like(out), where=size > 0)
    return out @ out.T


@pytest.fixture
def sentences(spark):
    rows = [(d, i, t) for d in (1, 2) for i, t in enumerate(TEXTS if d == 1 else TEXTS[:4])]
    return spark.createDataFrame(rows, "doc_id long, pos long, sentence string")


@pytest.fixture(params=[2, 3, 512])
def tile(request, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", request.param)


def test_adjacent(sentences):
    got = {(r["doc_id"], r["pos"]): r["sim"] for r in M.adjacent_similarity(sentences).collect()}
    for doc, texts in ((1, TEXTS), (2, TEXTS[:4])):
        sims = matrix(texts)
        for i in range(1, len(texts)):
            assert got.pop((doc, i)) == pytest.approx(sims[i - 1, i], abs=1e-8)
    assert not got


def test_pairs_of_distinct_sentences(sentences, tile):
    got = {(r["a"], r["b"]): (r["sim"], r["copies_a"], r["copies_b"]) for r in M.sparse_cosine(sentences, 0.1).filter("doc_id = 1").collect()}
    sims = matrix(TEXTS)
    firsts = [i for i, t in enumerate(TEXTS) if TEXTS.index(t) == i]
    want = {(a, b): (sims[a, b], TEXTS.count(TEXTS[a]), TEXTS.count(TEXTS[b])) for a in firsts for b in firsts if a < b and sims[a, b] >= 0.1}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_profile(sentences, tile):
    got = M.similarity_profile(sentences).filter("doc_id = 1").first()
    flat = np.round(matrix(TEXTS).flatten(), 6)
    flat = flat[flat < 0.999]
    want = [flat.min(), flat.max(), flat.mean(), *np.percentile(flat, [25, 50, 75])]
    names = ["sim_min", "sim_max", "sim_mean", "sim_p25", "sim_median", "sim_p75"]
    assert [got[n] for n in names] == pytest.approx(want, abs=1e-6)


def labels(df, doc=1):
    return [r["label"] for r in df.filter(f"doc_id = {doc}").orderBy("pos").collect()]


def with_labels(spark, values):
    rows = [(1, i, t, v) for i, (t, v) in enumerate(zip(TEXTS, values))]
    return spark.createDataFrame(rows, "doc_id long, pos long, sentence string, label long")


def test_outliers(spark, tile):
    given = [0, -1, 1, -1, -1, 2, 2, -1, -1]
    sims = np.round(matrix(TEXTS), 9)
    members = [i for i, v in enumerate(given) if v != -1]
    want = [v if v != -1 else given[members[int(np.argmax(sims[i, members]))]] for i, v in enumerate(given)]
    df = with_labels(spark, given)
    assert labels(G.outliers_nearest(df)) == want
    assert labels(G.outliers_separate(df)) == [0, 3, 1, 4, 5, 2, 2, 6, 7]
    assert labels(G.outliers_singleton(df)) == [0, 3, 1, 3, 3, 2, 2, 3, 3]


def test_all_outliers(spark):
    df = with_labels(spark, [-1] * len(TEXTS))
    assert set(labels(G.outliers_nearest(df))) == {0}
    assert labels(G.outliers_separate(df)) == list(range(len(TEXTS)))
    assert set(labels(G.outliers_singleton(df))) == {0}


def test_components_follow_a_long_chain(spark):
    n = 60
    nodes = spark.createDataFrame([(1, i) for i in range(n)] + [(2, 5)], "doc_id long, pos long")
    chain = [(1, i, i + 1) for i in range(n - 1) if i != 40]
    edges = spark.createDataFrame(chain, "doc_id long, a long, b long")
    got = {(r["doc_id"], r["pos"]): r["root"] for r in G.components(nodes, edges).collect()}
    assert got == {**{(1, i): 0 if i <= 40 else 41 for i in range(n)}, (2, 5): 5}


def test_threshold_clusters(sentences):
    sims = matrix(TEXTS)
    want, todo = {}, list(range(len(TEXTS)))
    while todo:
        group, front = set(), [todo[0]]
        while front:
            i = front.pop()
            if i not in group:
                group.add(i)
                front += [j for j in todo if sims[i, j] >= 0.3]
        for i in group:
            want[i] = len(set(want.values()))if min(group) == i else None
        label = max([v for v in want.values() if v is not None])
        for i in group:
            want[i] = label
        todo = [i for i in todo if i not in group]
    assert labels(G.cluster_threshold(sentences, 0.3)) == [want[i] for i in range(len(TEXTS))]


def test_density_needs_enough_close_sentences(spark):
    same = ["alpha beta gamma rho sigma"] * 6 + ["alpha beta gamma rho sigma delta"] * 5 + ["other words"] * 3 + ["lonely thing"]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(same)], "doc_id long, pos long, sentence string")
    assert labels(G.cluster_density(df, 0.3, 10)) == [0] * 11 + [-1] * 4
    assert set(labels(G.cluster_density(df, 0.3, 12))) == {-1}
    assert sqrt(2 - 2 * 0.755) == pytest.approx(0.7)


def linked(n, m, pairs):
    """Components of rows 0.. and columns n.. under the given pairs."""
    root = list(range(n + m))
    for i, j in pairs:
        a, b = root[i], root[n + j]
        root = [a if r == b else r for r in root]
    return [root.index(r) for r in root]


@pytest.mark.parametrize("share", [0.0, 0.01, 0.1, 0.9, 1.0])
def test_a_tile_gives_back_a_forest(share):
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (40, 30), (7, 60)):
        close = rng.random((n, m)) < share
        i, j = tiles.spanning_pairs(close)
        assert len(i) < n + m and all(close[a, b] for a, b in zip(i, j))
        assert linked(n, m, zip(i, j)) == linked(n, m, zip(*np.nonzero(close)))


def test_edges_of_a_document_of_alike_sentences_stay_few(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 16)
    rows = [("d", i, f"alpha beta gamma delta w{i}x") for i in range(64)]
    df = spark.createDataFrame(rows, "doc_id string, pos int, sentence string")
    links = M.close_forest(M.distinct_rows(df), 0.1).collect()
    assert len(links) <= 10 * 31 and set(labels(G.cluster_threshold(df, 0.1), "'d'")) == {0}
    assert G.cluster_density(df, 0.5, 10).schema["doc_id"].dataType.simpleString() == "string"


VECTORS = [[1.0, 0.0], [1.0, 0.1], None, [0.0, 0.0], [float("nan"), 1.0], [0.0, 2.0], [0.0], [-1.0, 0.0], [1.0, 0.0], [None, 1.0]]


def test_dense_vectors_missing_zero_and_not_finite(spark, tile):
    df = spark.createDataFrame([("a", i, f"s{i % 8}", v) for i, v in enumerate(VECTORS)], "doc_id string, pos long, sentence string, vector array<double>")
    got = {(r["a"], r["b"]): (round(r["sim"], 6), r["copies_a"]) for r in M.pairwise_similarity(df, 0.5).collect()}
    assert got == {(0, 1): (0.995037, 2)}  # 8 reads like 0 and has its vector; 9 reads like 1 and has another
    near = {r["pos"]: r["sim"] for r in M.adjacent_similarity(df).collect()}
    assert near[1] == pytest.approx(0.995037, abs=1e-6) and all(near[i] == 0 for i in (2, 3, 4, 5, 6)) and near[8] == -1
    clusters = labels(G.cluster_threshold(df, 0.9), "'a'")
    assert clusters[0] == clusters[1] == clusters[8] and len(set(clusters)) == 8
    outliers = labels(G.outliers_nearest(df.withColumn("label", F.when(F.col("pos").isin(1, 5), F.col("pos")).otherwise(-1))), "'a'")
    assert outliers[0] == 1 and outliers[5] == 5 and outliers[2] == 1


def test_empty_documents(spark):
    df = spark.createDataFrame([], "doc_id string, pos long, sentence string, vector array<double>")
    assert G.cluster_density(df).collect() == [] and M.pairwise_similarity(df, 0.5).collect() == []
