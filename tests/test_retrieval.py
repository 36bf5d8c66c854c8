import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.retrieval import QUERIES
from docweave.operators import numbering
from docweave.operators import retrieval as R
from docweave.plans.retrieve import RetrievalConfig, result_rows, retrieve_scored


def test_vector_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK_TILE", 7)
    monkeypatch.setattr(R, "QUERY_TILE", 2)
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(60, 5)).round(2)
    vecs[10] = vecs[11]
    vecs[12] = 0.0
    base = ["hot" if i % 3 else "cold" for i in range(60)]
    held = [(base[i], i, None if i in (5, 40) else vecs[i].tolist()) for i in range(60)]
    asked = [(100 + i, "hot" if i else "cold", rng.normal(size=5).tolist()) for i in range(5)]
    chunks = spark.createDataFrame(held, "kb_id string, chunk_id long, embedding array<double>")
    queries = spark.createDataFrame(asked, "query_id long, kb_id string, vector array<double>")
    for k in (3, 30):
        got = {}
        for r in R.vector_topk(queries, chunks, k).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["chunk_id"])
        for qid, kb, v in asked:
            def order(row):
                if row[2] is None:
                    return (2, 0, 0, row[1])
                a, b = np.array(v), np.array(row[2])
                size = np.linalg.norm(a) * np.linalg.norm(b)
                dist = (0, round(1 - a @ b / size, 9)) if size else (1, 0)
                return (*dist, round(float(np.linalg.norm(a - b)), 6), row[1])

            want = [r[1] for r in sorted((r for r in held if r[0] == kb), key=order)][:k]
            assert got[qid] == want


def test_keyword_search_with_a_hot_keyword(spark):
    chunks = spark.createDataFrame(
        [(i, i, "t", ["hot"] + (["rare"] if i == 90 else []), i == 0) for i in range(100)],
        "chunk_id long, document_id long, chunk_text string, keywords array<string>, is_deleted boolean",
    )
    docs = spark.createDataFrame([(i, "kb", i != 1, "n") for i in range(100)], "document_id long, kb_id string, status boolean, name string")
    queries = spark.createDataFrame([(1, "kb", ["rare", "hot"]), (2, "kb", ["rare"]), (3, "other", ["hot"])], "query_id long, kb_id string, keywords array<string>")
    got = [(r["query_id"], r["chunk_id"]) for r in R.keyword_search(queries, chunks, docs).orderBy("query_id", "rank").collect()]
    assert got == [(1, 2), (1, 3), (1, 4), (2, 90)]


@pytest.mark.parametrize(
    ("query", "n", "skip"),
    [("hello", 10, True), ("Xin ch\u00e0o ", 10, True), ("this", 10, True), ("what is it", 10, False), ("abc", 10, True),
     ("what is the law", 3, True), ("what is the law", 4, False), ("the capital of", 9, False), ("good", 9, True)],
)
def test_skip_rule(spark, query, n, skip):
    df = spark.createDataFrame([(query, n)], "query_text string, n long")
    assert R.skip_rerank(df).first()["skip"] is skip


def test_balance_rule(spark):
    df = spark.createDataFrame([(n,) for n in (1, 3, 4, 5, 6, 7, 8, 9, 11, 13)], "n long")
    threads, dropped = R.balance_plan(F.col("n"))
    got = {r["n"]: (r["t"], r["d"]) for r in df.select("n", threads.alias("t"), dropped.alias("d")).collect()}
    assert got == {1: (1, 0), 3: (1, 0), 4: (2, 0), 5: (2, 1), 6: (3, 0), 7: (3, 1), 8: (2, 0), 9: (3, 0), 11: (2, 1), 13: (3, 1)}


def test_balance_drops_the_least_similar_and_orders_by_similarity(spark):
    hits = spark.createDataFrame([(1, i, s, i + 1) for i, s in enumerate([0.1, 0.9, 0.5, 0.5, 0.7])], "query_id long, chunk_id long, similarity double, place int")
    got = [(r["chunk_id"], r["place"]) for r in R.balance_candidates(hits).orderBy("place").collect()]
    assert got == [(1, 1), (4, 2), (2, 3), (3, 4)]


def test_batch_sizes(spark):
    df = spark.createDataFrame([(n,) for n in (3, 8, 9, 16, 17)], "n long").select(R.batch_size(F.col("n")).alias("s"))
    assert [r["s"] for r in df.collect()] == [3, 8, 8, 8, 16]


def test_rerank_puts_missing_scores_last(spark):
    hits = spark.createDataFrame([(1, 1, None, 1), (1, 2, 0.5, 2), (1, 3, 0.5, 3), (1, 4, -2.0, 4)], "query_id long, chunk_id long, rerank_score double, place int")
    assert [r["chunk_id"] for r in R.rerank(hits, 4).orderBy("rank").collect()] == [2, 3, 4, 1]


def test_limits(spark):
    df = spark.createDataFrame([("5",), (" 7 ",), ("3.7",), ("x",), (None,), ("-2",)], "t string")
    assert [r["x"] for r in df.select(R.coerce_limit(F.col("t")).alias("x")).collect()] == [5, 7, 10, 10, 10, -2]
    numbers = spark.createDataFrame([(5.0,), (3.7,), (None,), (float("nan"),)], "t double")
    assert [r["x"] for r in numbers.select(R.coerce_limit(F.col("t")).alias("x")).collect()] == [5, 3, 10, 10]


def test_constant_lists_fuse_to_zero(spark):
    a = spark.createDataFrame([(1, 1, 0.4), (1, 2, 0.4)], "query_id long, chunk_id long, similarity double")
    b = spark.createDataFrame([(1, 2, 3.0), (1, 3, 1.0)], "query_id long, chunk_id long, similarity double")
    got = {r["chunk_id"]: r["score"] for r in R.fuse(a, b).collect()}
    assert got == {1: 0.0, 2: pytest.approx(0.3), 3: 0.0}


@pytest.mark.parametrize("parts", [7, None])
def test_numbering_a_hot_key_in_slices(spark, parts):
    rows = [("hot", i * 2) for i in range(50)] + [("b", 7), (None, 1), (None, 9)]
    df = spark.createDataFrame(rows, "k string, at long")
    got = {(r["k"], r["at"]): r["row"] for r in numbering.numbered(df, "at", ["k"], parts=parts).collect()}
    assert got == {**{("hot", i * 2): i + 1 for i in range(50)}, ("b", 7): 1, (None, 1): 1, (None, 9): 2}


def test_bm25_tile_equals_plain_sums():
    rng = np.random.default_rng(4)
    held = pd.DataFrame([(f"t{t}", int(c), rng.choice([0.2, 0.5, 1.0, 1.9])) for t in range(12) for c in rng.choice(300, 5 + 20 * t, replace=False)], columns=["term", "chunk_id", "part"])
    idf = {f"t{t}": 6.0 / (1 + t) for t in range(12)} | {"absent": 9.0}
    asked = pd.DataFrame([(q, t, idf[t]) for q in range(30) for t in rng.choice([*idf], rng.integers(1, 9), replace=False)], columns=["query_id", "term", "idf"])
    for k in (1, 3, 20, 500):
        got = R._score_postings(k)(None, asked, held).groupby("query_id")[["chunk_id", "similarity"]].apply(lambda x: [tuple(r) for r in x.to_numpy()])
        for q, rows in asked.groupby("query_id"):
            joined = held.merge(rows, on="term")
            sums = (joined["idf"] * joined["part"]).groupby(joined["chunk_id"]).sum().round(9)
            want = sorted(((c, s) for c, s in sums.items()), key=lambda x: (-x[1], x[0]))[:k]
            assert (list(got[q]) if q in got.index else []) == want


def test_bm25_over_many_tiles(spark, monkeypatch):
    chunks = spark.createDataFrame([(f"c{i:02}", 1, f"alpha {'beta ' * (i % 5)}gamma w{i}", i == 7) for i in range(40)], "chunk_id string, document_id long, chunk_text string, is_deleted boolean")
    docs = spark.createDataFrame([(1, "kb", True, "n")], "document_id long, kb_id string, status boolean, name string")
    queries = spark.createDataFrame([("q1", "kb", "beta w3"), ("q2", "kb", "nothing"), ("q3", "kb", "Alpha beta")], "query_id string, kb_id string, query_text string")
    whole = sorted(tuple(r) for r in R.bm25(queries, chunks, docs, 5).collect())
    monkeypatch.setattr(R, "CHUNK_TILE", 6)
    monkeypatch.setattr(R, "QUERY_TILE", 1)
    assert sorted(tuple(r) for r in R.bm25(queries, chunks, docs, 5).collect()) == whole and len(whole) == 10 and whole[0][:2] == ("q1", "c03")


def test_bm25_tiles_are_cut_by_words(spark, monkeypatch):
    """Long chunks make more tiles, so that no task is given all postings of a base."""
    chunks = spark.createDataFrame([(i, 1, f"alpha beta w{i % 9} " * 5, False) for i in range(60)], "chunk_id long, document_id long, chunk_text string, is_deleted boolean")
    docs = spark.createDataFrame([(1, "kb", True, "n")], "document_id long, kb_id string, status boolean, name string")
    queries = spark.createDataFrame([(1, "kb", "alpha w3"), (2, "kb", "beta w5")], "query_id long, kb_id string, query_text string")
    whole = sorted(tuple(r) for r in R.bm25(queries, chunks, docs, 5).collect())
    plain = R._score_postings

    def bounded(k):
        score = plain(k)

        def run(key, asked, held):
            assert held["chunk_id"].nunique() < 40
            return score(key, asked, held)

        return run

    monkeypatch.setattr(R, "_score_postings", bounded)
    monkeypatch.setattr(R, "WORD_TILE", 200)
    assert sorted(tuple(r) for r in R.bm25(queries, chunks, docs, 5).collect()) == whole and len(whole) == 10


def test_bm25_has_no_aggregate_of_queries_and_chunks(spark, small):
    plan = QUERIES["r10_bm25"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Aggregate" in line and "query_id" in line and "chunk_id" in line]


@pytest.mark.parametrize("limit", [0, 1000])
def test_keywords_are_cut_before_the_first_exchange_of_postings(spark, monkeypatch, limit):
    monkeypatch.setattr(R, "BROADCAST_ROWS", limit)
    chunks = spark.createDataFrame([(i, 1, "t", ["hot"] + (["rare"] if i == 90 else []), False) for i in range(100)], "chunk_id long, document_id long, chunk_text string, keywords array<string>, is_deleted boolean")
    docs = spark.createDataFrame([(1, "kb", True, "n")], "document_id long, kb_id string, status boolean, name string")
    queries = spark.createDataFrame([(1, "kb", ["rare", "hot"]), (2, "kb", ["rare"])], "query_id long, kb_id string, keywords array<string>")
    found = R.keyword_search(queries, chunks, F.broadcast(docs), 3)
    assert [(r["query_id"], r["chunk_id"]) for r in found.orderBy("query_id", "rank").collect()] == [(1, 0), (1, 1), (1, 2), (2, 90)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_queries_without_a_vector_or_of_another_length(spark):
    held = [("kb", f"c{i}", v) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], None, [1.0, 0.0, 0.0], [0.0, 0.0]])]
    chunks = spark.createDataFrame(held, "kb_id string, chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([("none", "kb", None), ("two", "kb", [0.0, 2.0]), ("four", "kb", [1.0] * 4), ("nan", "kb", [float("nan"), 1.0])], "query_id string, kb_id string, vector array<double>")
    got = {}
    for r in R.vector_topk(queries, chunks, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["distance"]))
    blank = [("c0", None), ("c1", None), ("c2", None)]
    assert got == {"none": blank, "four": blank, "nan": blank, "two": [("c1", 0.0), ("c0", 1.0), ("c4", None)]}


def test_requests_with_their_own_settings(spark):
    chunks = spark.createDataFrame([(i, 1, f"t{i}", ["k"], [1.0, i / 10], False) for i in range(6)], "chunk_id long, document_id long, chunk_text string, keywords array<string>, embedding array<double>, is_deleted boolean")
    docs = spark.createDataFrame([(1, "kb", True, "n", "http://x")], "document_id long, kb_id string, status boolean, name string, link string")
    asked = [(1, "2", True), (2, None, False), (3, "0", None), (4, "x", None)]
    queries = spark.createDataFrame([(q, "kb", "what is the law", [], [1.0, 0.0], m, u) for q, m, u in asked], "query_id long, kb_id string, query_text string, keywords array<string>, vector array<double>, max_chunks string, use_reranker boolean")
    scores = spark.createDataFrame([(q, c, float(c)) for q in range(1, 5) for c in range(6)], "query_id long, chunk_id long, rerank_score double")
    hits = retrieve_scored(queries, chunks, docs, RetrievalConfig(max_chunks=4), scores)
    got = {}
    for r in result_rows(hits, chunks, docs).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["rerank_score"]))
        assert (r["document_name"], r["link"], r["chunk_text"]) == ("n", "http://x", f"t{r['chunk_id']}")
    assert got == {1: [(5, 5.0), (4, 4.0)], 2: [(i, None) for i in range(4)], 4: [(i, float(i)) for i in (5, 4, 3, 2)]}


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_numbering_by_times_and_texts_spreads_over_tasks(spark, keys):
    """Sparse values in one key: microseconds over years, and hashed texts."""
    df = spark.range(4000).select(F.when(F.col("id") % 4 > 0, "hot").alias("k"), F.col("id"), F.md5(F.col("id").cast("string")).alias("h"),
                                  F.timestamp_micros(F.pmod(F.xxhash64("id"), F.lit(10**15))).alias("at"))
    for order in ("h", "at"):
        made = numbering.numbered(df, order, keys, parts=8)
        rows = made.collect()
        for key in {r["k"] for r in rows} if keys else {0}:
            own = sorted((r[order], r["row"]) for r in rows if not keys or r["k"] == key)
            assert [n for _, n in own] == list(range(1, len(own) + 1))
        # No task sorts more than about its share of the rows.
        sorted_parts = df.repartitionByRange(8, *keys, order).rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
        assert max(sorted_parts) < 4000 / 8 * 2
