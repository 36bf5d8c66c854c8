"""Merkle manifest against a plain computation, on odd rows and on trees of several widths."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from docweave.llm.merkle import document_manifest, folded_root, merkle_manifest, siblings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, leaf string, idx long"
ROWS = [
    (3, "c", "en", "s", 1), (1, "é", "en", None, 1), (2, None, "en", "", None), (2, "x", "en", "s", 4), (2, "x", "en", "s", 4),
    (None, "", None, None, None), (7, "z" * 100_000, None, "s", 100_000), (-5, "", "", "s", 0), (9, "a", "de", "s", 1), (10, "b", "dé", "s", 1),
]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf_of(row):
    i, text, lang, source, n = row
    return h(*[field(x) for x in (i, source, lang, n, text)])


def fold_up(nodes, arity=2):
    """(root, siblings of each node up to the root as (left, right))."""
    paths, spans = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + arity, len(nodes))) for i in range(0, len(nodes), arity)]
        for run in runs:
            for j in run:
                for leaf in spans[j]:
                    paths[leaf].append(("".join(nodes[x] for x in run if x < j), "".join(nodes[x] for x in run if x > j)))
        spans = [[leaf for j in run for leaf in spans[j]] for run in runs]
        nodes = [h(*[nodes[j] for j in run]) for run in runs]
    return (nodes[0] if nodes else None), paths


def manifest(rows, arity=2):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    subs, out = [], []
    for lang in langs:
        held = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        root, paths = fold_up([leaf_of(r) for r in held], arity)
        subs.append(root)
        out.append((held, paths))
    root, tops = fold_up(subs, arity)
    made = []
    for (held, paths), sub, top in zip(out, subs, tops, strict=True):
        for r, path in zip(held, paths, strict=True):
            whole = path + top
            i, text, lang, source, n = r
            struck = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
            at = leaf_of((i, text, lang, source, n + 1)) if struck else leaf_of(r)
            for left, right in whole:
                at = h(left, at, right)
            made.append((i, leaf_of(r), sub, root, h(*[x for step in whole for x in step]), at, at == root))
    return sorted(map(repr, made))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", "l", 5) for r in rows], SCHEMA)


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], [(i, f"t{i}", "en" if i % 3 else f"l{i}", "s", i) for i in range(45)]])
def test_manifest(spark, rows):
    got = document_manifest(frame(spark, rows))
    assert sorted(repr(tuple(r)) for r in got.collect()) == manifest(rows)


def test_empty_table(spark):
    assert document_manifest(frame(spark, [])).collect() == []


@pytest.mark.parametrize("arity", [3, 4])
def test_wider_trees(spark, arity):
    rows = [(i, "t", "en" if i < 30 else f"l{i}", "s", 1) for i in range(37)]
    df = spark.createDataFrame([(r[0], r[2], leaf_of(r)) for r in rows], "at long, group string, leaf string")
    made = merkle_manifest(df, ["at"], arity).select("at", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof"), folded_root(F.col("leaf"), F.col("path")).alias("to"))
    want = manifest(rows, arity)
    got = [(r.at, r.leaf, r.subroot, r.root, r.proof) for r in made.collect()]
    assert sorted(repr(g)[:-1] for g in got) == sorted(w[: w.rindex(", '")] for w in want)
    assert all(r.to == r.root for r in made.collect())
