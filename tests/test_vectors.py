import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.functions import vectors as V
from docweave.operators.resizing import choose_method, reduce_pca


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(20)] + [(20, [0.0] * 6), (21, [1.0, 2.0])]
    return spark.createDataFrame(rows, "id long, v array<double>")


def both(df, expr):
    return [(np.array(r["v"]), np.array(r["x"])) for r in df.select("v", expr.alias("x")).collect()]


@pytest.mark.parametrize("method", ["dct", "linear", "redistribute"])
def test_growing_keeps_the_length(table, method):
    for v, x in both(table, V.resize(F.col("v"), 9, method)):
        assert len(x) == 9 and np.linalg.norm(x) == pytest.approx(np.linalg.norm(v))


def test_equal_size_is_unchanged_and_longer_is_cut(table):
    for n in (6, 2):
        for v, x in both(table.filter("id < 20"), V.resize(F.col("v"), n, "linear")):
            assert x.tolist() == v[:n].tolist()


def test_linear_uses_the_fixed_seed(table):
    m = np.random.RandomState(42).normal(0, 1 / np.sqrt(6), (6, 9))
    for i in range(6):
        m[i, i] = 1.0
    for v, x in both(table.filter("id < 20"), V.resize(F.col("v"), 9, "linear")):
        want = v @ m
        assert x == pytest.approx(want * np.linalg.norm(v) / np.linalg.norm(want))


def test_orthogonal_growth_keeps_dot_products(table):
    pairs = both(table.filter("id < 20"), V.project_orthogonal(F.col("v"), 9))
    before, after = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    assert after @ after.T == pytest.approx(before @ before.T)


def test_decay_blocks(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0])], "id long, v array<double>")
    (_, x), = both(df, V.resize(F.col("v"), 5, "decay"))
    raw = np.array([3, 4, 1.5, 2, 0.75])
    assert x == pytest.approx(raw / np.linalg.norm(raw))


def test_pca_components_are_ordered(table):
    rows = reduce_pca(table.filter("id < 20"), "v", 3).select("reduced").collect()
    spread = np.var(np.array([r["reduced"] for r in rows]), axis=0)
    assert spread[0] >= spread[1] >= spread[2]
    centred = np.array([r["reduced"] for r in rows])
    centred -= centred.mean(axis=0)
    cov = centred.T @ centred
    assert cov[0, 1] == pytest.approx(0, abs=1e-8) and cov[1, 2] == pytest.approx(0, abs=1e-8)


def test_unknown_method(table):
    with pytest.raises(ValueError):
        V.resize(F.col("v"), 9, "magic")


def test_missing_vector_has_similarity_zero(spark):
    df = spark.createDataFrame([([1.0, 0.0], None), ([0.0, 0.0], [1.0, 1.0])], "v array<double>, w array<double>")
    assert [r["s"] for r in df.select(V.similarity(F.col("v"), F.col("w")).alias("s")).collect()] == [0.0, 0.0]


def test_method_choice(spark):
    df = spark.createDataFrame([(768, 1536), (768, 2304), (384, 3072), (1536, 384)], "s int, t int")
    assert [r["m"] for r in df.select(choose_method(F.col("s"), F.col("t")).alias("m")).collect()] == ["linear", "dct", "weighted", "linear"]
