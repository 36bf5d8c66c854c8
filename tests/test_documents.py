"""Documents that fit one tile are worked through where their sentences lie."""

import numpy as np
import pytest

from docweave.operators import clusters as G
from docweave.operators import similarity as M
from docweave.operators import tiles
from tests.test_oracles import QUERIES, plan_of
from tests.test_similarity import TEXTS, labels, matrix


@pytest.fixture
def sentences(spark):
    rows = [(f"d{d}", i, t) for d in range(5) for i, t in enumerate(TEXTS[: len(TEXTS) - d])]
    return spark.createDataFrame(rows, "doc_id string, pos long, sentence string")


def test_words_never_become_rows_of_an_exchange(sentences):
    for made in (M.tfidf(sentences), M.adjacent_similarity(sentences), M.running_groups(sentences, 0.3)):
        plan = plan_of(made)
        assert "Generate" not in plan and plan.count("+- Exchange (") == 1


def test_small_documents_take_no_star_steps(sentences, monkeypatch):
    def refused(*args):
        raise AssertionError("no tables of links for documents of one tile")

    monkeypatch.setattr(G, "components", refused)
    assert labels(G.cluster_threshold(sentences, 0.3), "'d0'")[0] == 0
    assert len(labels(G.cluster_density(sentences, 0.3, 2), "'d4'")) == 5


@pytest.mark.parametrize("records", [1, 2, 7])
def test_batches_end_inside_documents(spark, sentences, records):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, records)
    try:
        got = {(r["doc_id"], r["pos"]): r["sim"] for r in M.adjacent_similarity(sentences).collect()}
        pairs = {(r["doc_id"], r["a"], r["b"]): r["sim"] for r in M.sparse_cosine(sentences, 0.1).collect()}
    finally:
        spark.conf.set(name, before)
    for d in range(5):
        texts = TEXTS[: len(TEXTS) - d]
        sims = matrix(texts)
        for i in range(1, len(texts)):
            assert got.pop((f"d{d}", i)) == pytest.approx(sims[i - 1, i], abs=1e-8)
        firsts = [i for i, t in enumerate(texts) if texts.index(t) == i]
        for a, b in [(a, b) for a in firsts for b in firsts if a < b and sims[a, b] >= 0.1]:
            assert pairs.pop((f"d{d}", a, b)) == pytest.approx(sims[a, b], abs=1e-8)
    assert not got and not pairs


def test_documents_of_both_sizes(sentences, monkeypatch):
    """Six sentences a tile: some documents go in place, the others in tiles, with the same results."""
    queries = [
        lambda: M.sparse_cosine(sentences, 0.1).collect(),
        lambda: M.similarity_profile(sentences).collect(),
        lambda: G.cluster_threshold(sentences, 0.3).collect(),
        lambda: G.cluster_density(sentences, 0.3, 2).collect(),
        lambda: G.outliers_nearest(sentences.selectExpr("*", "pos % 3 - 1 as label")).collect(),
    ]
    in_place = [sorted(q()) for q in queries]
    monkeypatch.setattr(tiles, "TILE", 6)
    for want, q in zip(in_place, queries):
        for a, b in zip(want, sorted(q()), strict=True):
            assert tuple(a) == pytest.approx(tuple(b), abs=1e-8)


def test_many_words_are_multiplied_in_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    dense = rng.random((2, 6, 40)) * (rng.random((2, 6, 40)) < 0.3)
    sides = []
    for vectors in dense:
        row, word = np.nonzero(vectors)
        sides.append(tiles.Side(np.arange(6), np.ones(6, int), tiles.Words(row, word, vectors[row, word])))
    for width in (1, 7, 4096):
        monkeypatch.setattr(tiles, "WORDS", width)
        assert np.allclose(tiles.similarities(*sides), dense[0] @ dense[1].T)
        assert np.allclose(tiles.similarities(sides[0], sides[0]), dense[0] @ dense[0].T)


@pytest.mark.parametrize("name", ["c7_pairwise_similarity", "c8_similarity_profile", "c11_outliers_nearest"])
def test_sentences_are_cut_once_for_both_sizes(spark, small, name):
    assert "Scan parquet" not in plan_of(QUERIES[name](spark, small))
