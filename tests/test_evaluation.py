import random
from math import exp, log, log2

import pytest
from pyspark.sql import functions as F

from docweave.operators import evaluation as V


@pytest.fixture(scope="module")
def ranking(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "question_id long")
    axis = {"x": [1.0, 0.0], "y": [0.0, 1.0], "d": [1.0, 1.0]}
    retrieved = spark.createDataFrame(
        [(1, 1, axis["y"]), (1, 2, axis["x"]), (1, 3, axis["x"]), (1, 6, axis["x"]), (2, 1, axis["x"])], "question_id long, rank int, vector array<double>"
    )
    relevant = spark.createDataFrame([(1, 10, axis["x"]), (1, 11, axis["d"]), (3, 12, axis["x"])], "question_id long, rel_id long, rel_vector array<double>")
    return asked, retrieved, relevant


def test_ranking_by_hand(ranking):
    asked, retrieved, relevant = ranking
    got = {r["question_id"]: r.asDict() for r in V.ranking_metrics(asked, retrieved, relevant).collect()}
    # Every result of question 1 is close to the diagonal text, so three of the first five match.
    assert got[1]["precision_at_k"] == pytest.approx(3 / 5)
    assert got[1]["recall_at_k"] == 1.0 and got[1]["recall_at_1"] == 0.5 and got[1]["recall_at_2"] == 1.0
    assert got[1]["mrr"] == 1.0 and got[1]["retrieved_contexts_count"] == 4
    gain = sum(1 / log2(r + 1) for r in (1, 2, 3))
    assert got[1]["ndcg"] == pytest.approx(gain / (1 + 1 / log2(3))) and got[1]["ndcg"] > 1
    assert got[2]["precision_at_k"] == got[2]["recall_at_k"] == got[2]["ndcg"] == 0
    assert got[3]["mrr"] == 0


def test_one_pass_equals_the_single_metrics(ranking):
    asked, retrieved, relevant = ranking
    pairs = V.scored_pairs(retrieved, relevant)
    singles = [
        V.precision_at_k(asked, pairs), V.recall_at_k(asked, pairs, relevant), V.recall_multi_k(asked, pairs, relevant, [1, 2, 3, 4, 5]),
        V.mrr(asked, pairs), V.ndcg(asked, pairs, relevant),
    ]
    out = V.ranking_metrics(asked, retrieved, relevant).orderBy("question_id").collect()
    for df in singles:
        for a, b in zip(out, df.orderBy("question_id").collect()):
            for c in df.columns:
                assert a[c] == pytest.approx(b[c])


def test_capped_ndcg(ranking):
    asked, retrieved, relevant = ranking
    got = V.ndcg(asked, V.scored_pairs(retrieved, relevant), relevant, capped=True)
    assert got.filter("question_id = 1").first()["ndcg"] == 1.0


def test_bleu_by_hand(spark):
    df = spark.createDataFrame([(1, "the cat sat", "The cat, sat down!"), (2, "", "a b"), (3, "x y", "a b")], "id long, answer string, truth string")
    got = {r["id"]: r for r in V.bleu(df).collect()}
    brevity = exp(1 - 4 / 3)
    assert got[1]["bleu_1"] == pytest.approx(brevity)
    assert got[1]["bleu"] == pytest.approx(brevity * exp(0.25 * log(0.1))) and got[1]["bleu_4"] == got[1]["bleu"]
    assert got[2]["bleu"] == 0 and got[3]["bleu"] == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_equals_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert V._lcs_length(a, b) == lcs(a, b)


def test_rouge_and_overlap(spark):
    df = spark.createDataFrame([(1, "a b c d", "a c b d e"), (2, "", "a"), (3, "a", "")], "id long, answer string, truth string")
    a, b = F.col("answer"), F.col("truth")
    got = df.select("id", V.rouge_n(a, b, 1).alias("r1"), V.rouge_n(a, b, 2).alias("r2"), V.token_overlap(a, b).alias("o")).orderBy("id").collect()
    assert got[0]["r1"] == pytest.approx(2 * 1 * 0.8 / 1.8, abs=1e-6) and got[0]["r2"] == 0 and got[0]["o"] == 0.8
    assert [r["r1"] for r in got[1:]] == [0, 0] and [r["o"] for r in got[1:]] == [0, 0]
    rl = V.rouge_l(df).orderBy("id").collect()
    assert rl[0]["rouge_l"] == pytest.approx(2 * 0.75 * 0.6 / 1.35, abs=1e-6) and rl[1]["rouge_l"] == 0


@pytest.mark.parametrize(
    ("reply", "score"),
    [("7", 0.7), ("7.5", 0.75), (" 10 ", 1.0), ("12", 1.0), ("-1", 0.0), ("ERROR", 0.5), ("", 0.5), ("7d", 0.5), ("1e1", 1.0), (None, 0.5)],
)
def test_judge_reply(spark, reply, score):
    df = spark.createDataFrame([(reply, "x", "")], "r string, a string, b string")
    row = df.select(V.judge_score(F.col("r"), F.col("a")).alias("s"), V.judge_score(F.col("r"), F.col("b")).alias("z")).first()
    assert row["s"] == pytest.approx(score) and row["z"] == 0.0


def test_overall_divides_by_thirteen(spark):
    df = spark.createDataFrame([tuple([1.0] * 12)], V.OVERALL_TERMS)
    assert df.select(V.overall().alias("o")).first()["o"] == pytest.approx(12 / 13)
    assert df.select(V.overall(divisor=12).alias("o")).first()["o"] == 1.0


def test_numeric_columns(spark):
    df = spark.createDataFrame([(1, "q", 0.5, 3, True)], "question_id int, question string, mrr double, bleu int, flag boolean")
    assert V.numeric_columns(df) == ["mrr", "bleu"]


def test_bleu_counts_repeated_words_in_the_row(spark):
    rows = [(1, "the the the the", "the cat the mat"), (2, "a b a b a b", "a b a b"), (3, None, "x"), (4, "x", None), (5, "", ""), (5, "x y", "x y")]
    df = V.bleu(spark.createDataFrame(rows, "id long, answer string, truth string"), {"one": (1.0, 0.0, 0.0, 0.0), "two": (0.0, 1.0, 0.0, 0.0)})
    got = sorted((r["id"], round(r["one"], 6), round(r["two"], 6)) for r in df.collect())
    assert got == [(1, 0.5, round(0.1 / 3, 6)), (2, round(4 / 6, 6), 0.6), (3, 0.0, 0.0), (4, 0.0, 0.0), (5, 0.0, 0.0), (5, 1.0, 1.0)]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
