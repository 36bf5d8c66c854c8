import time

import pytest
from pyspark.sql import functions as F

from docweave.functions import folds
from docweave.operators import chunking as C
from docweave.plans.semantic import ChunkingConfig, semantic_chunks


def rows(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def labelled(spark, *sentences):
    return spark.createDataFrame([(1, i, s, lab) for i, (s, lab) in enumerate(sentences)], "doc_id long, pos long, sentence string, label long")


def texts(df):
    return [r["text"] for r in df.orderBy("doc_id", "chunk").collect()]


def test_split_loses_nothing_and_respects_the_size(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    pieces = C.split_recursive(docs, 120)
    whole = pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "text"))).alias("p"))
    joined = docs.filter("text <> ''").join(whole.select("doc_id", F.array_join("p.text", "").alias("back")), "doc_id", "left")
    assert joined.filter("back is null or back <> text").count() == 0
    # Without a coarser separator a text falls apart into characters, so no piece reaches the size.
    assert pieces.filter(F.length("text") >= 120).count() == 0


def test_first_separator_present_is_used_and_stays_in_front(spark):
    assert texts(C.split_recursive(rows(spark, ["aa\n\n\nbb\ncc"]), 4)) == ["aa", "\n", "\n", "\nbb", "\ncc"]
    assert texts(C.split_recursive(rows(spark, ["aa\n\nbb.cc"]), 9)) == ["aa", "\n\nbb.cc"]


def test_short_text_is_still_cut_at_the_first_separator(spark):
    assert texts(C.split_recursive(rows(spark, ["a.b"]), 100)) == ["a", ".b"]


def test_split_keeps_private_use_characters_and_runs_of_separators(spark):
    assert texts(C.split_recursive(rows(spark, ["a\ue000b\n\n\nc.*d\n\n"]), 8)) == ["a\ue000b", "\n\n\nc.*d", "\n\n"]
    assert texts(C.split_recursive(rows(spark, ["ab.*cd.*ef"]), 5, [".*"])) == ["ab", ".*cd", ".*ef"]


def test_merge_packs_up_to_the_size(spark):
    assert texts(C.recursive_chunks(rows(spark, ["one two three four five"]), 10, 0)) == ["one two", "three", "four five"]


def test_merge_carries_overlap(spark):
    assert texts(C.recursive_chunks(rows(spark, ["aa bb cc dd ee"]), 9, 3)) == ["aa bb cc", "cc dd ee"]


def test_merged_chunks_stay_below_the_size(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    chunks = C.recursive_chunks(docs, 300, 50)
    assert chunks.filter((F.length("text") > 300) | (F.trim("text") == "")).count() == 0
    # Without overlap the chunks hold all visible characters of the text.
    bare = C.recursive_chunks(docs, 300, 0).groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("text", r"[\s\p{Z}]", ""))).alias("n"))
    both = docs.withColumn("m", F.length(F.regexp_replace("text", r"[\s\p{Z}]", ""))).join(bare, "doc_id")
    assert both.filter("n <> m").count() == 0


def test_fixed_windows_stop_at_the_end(spark):
    made = C.fixed_windows(rows(spark, ["a b c d e", "a b c", "", "a b c d"]), 3, 1)
    assert [(r["doc_id"], r["text"]) for r in made.orderBy("doc_id", "chunk").collect()] == [
        (0, "a b c"), (0, "c d e"), (1, "a b c"), (3, "a b c"), (3, "c d"),
    ]


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        C.fixed_windows(rows(spark, ["a"]), 3, 3)


def test_pack_ignores_joining_spaces(spark):
    df = labelled(spark, ("a" * 5, 0), ("b" * 5, 0), ("c", 0), ("d", 1))
    assert texts(C.pack_chunks(df, 10)) == ["aaaaa bbbbb", "c", "d"]


def test_split_pieces_are_exempt_from_merging(spark):
    df = labelled(spark, ("a" * 8, 0), ("bb", 0), ("cc", 1))
    parts = C.split_oversized(df, 9)
    assert [(r["text"], r["part"]) for r in parts.orderBy("chunk").collect()] == [("a" * 8, True), ("bb", True), ("cc", False)]
    assert texts(C.merge_small(parts, 5)) == ["a" * 8, "bb cc"]


def test_first_small_chunk_stays(spark):
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "longer text")], "doc_id long, chunk long, text string")
    assert texts(C.merge_small(chunks, 5)) == ["a b", "longer text"]


def test_overlap_cascades_through_short_chunks(spark):
    chunks = spark.createDataFrame([(1, 0, "a b c"), (1, 1, "d"), (1, 2, "e")], "doc_id long, chunk long, text string")
    assert texts(C.add_overlap(chunks, 2)) == ["a b c", "b c d", "c d e"]
    short = spark.createDataFrame([(1, 0, "a b"), (1, 1, "c")], "doc_id long, chunk long, text string")
    assert texts(C.add_overlap(short, 2)) == ["a b", "c"]


def test_split_points(spark):
    df = spark.createDataFrame([("x\nsplit_after: 3, 7\nsplit_after: 1",), ("split_after: 7, 3",), ("split_after: 1",), ("none",)], ["r"])
    got = [r["p"] for r in df.select(folds.parse_split_points(F.col("r"), F.lit(2)).alias("p")).collect()]
    assert got == [[3, 7], None, None, None]


def test_budget_includes_the_piece_that_crosses(spark):
    df = spark.createDataFrame([(["a b", "c d", "e"],)], "p array<string>")
    w = df.select(folds.budget_window(F.col("p"), F.lit(0), 3).alias("w")).first()["w"]
    assert w["taken"] == 2 and w["text"] == "<|start_chunk_1|>a b<|end_chunk_1|><|start_chunk_2|>c d<|end_chunk_2|>"


def test_semantic_chunks_on_empty_and_single(spark):
    docs = rows(spark, ["", "Only one sentence here.", "1. 2. 3."])
    for clustering in (False, True):
        got = semantic_chunks(docs, ChunkingConfig(use_clustering=clustering)).collect()
        assert [(r["doc_id"], r["text"]) for r in got] == [(1, "Only one sentence here.")]


def test_unknown_method_is_an_error(spark):
    with pytest.raises(ValueError):
        semantic_chunks(rows(spark, ["a b c d."]), ChunkingConfig(clustering_method="nope")).collect()


def test_folds_of_a_very_long_document_stay_linear(spark):
    """64,000 pieces in one row; with a copy of all results at each step these take minutes."""
    n = 64_000
    piece = F.concat(F.lit("some words here "), F.col("i").cast("string"))
    one = spark.range(n).select(F.col("id").alias("i")).groupBy().agg(
        F.sort_array(F.collect_list(F.struct("i", piece.alias("sentence"), F.floor(F.col("i") / 3).alias("label")))).alias("s")
    ).select(F.transform("s", lambda x: F.struct(x["sentence"].alias("sentence"), x["label"].alias("label"))).alias("s")).cache()
    one.count()
    chunks = F.transform("s", lambda x: F.struct(x["sentence"].alias("text"), F.lit(False).alias("part")))
    for fold, size in (
        (folds.grouped(F.col("s")), 21_334), (folds.split_oversized(folds.grouped(F.col("s")), 30), 64_000), (folds.merge_small(chunks, 19), 63_901),
        (folds.pack(F.col("s"), 200), 21_334), (folds.add_overlap(F.transform("s", lambda x: x["sentence"]), 3), 64_000),
    ):
        began = time.time()
        assert one.select(F.size(fold)).first()[0] == size
        assert time.time() - began < 10


def test_folds_at_their_edges(spark):
    given = [("a", 0), ("b", 0), ("c", 1), ("d", 0), ("", 0), ("e e e e", 0)]
    df = spark.createDataFrame([(1, given), (2, given[:1]), (3, [])], "i long, s array<struct<sentence:string,label:long>>")
    chunks = F.transform("s", lambda x: F.struct(x["sentence"].alias("text"), (x["label"] == 1).alias("part")))
    got = {r["i"]: r for r in df.select("i", folds.grouped(F.col("s")).alias("g"), folds.merge_small(chunks, 3).alias("m"),
                                       folds.add_overlap(F.transform("s", lambda x: x["sentence"]), 2).alias("o"), folds.pack(F.col("s"), 2).alias("p")).collect()}
    assert got[1]["g"] == [["a", "b"], ["c"], ["d", "", "e e e e"]] and got[1]["m"] == ["a b", "c d ", "e e e e"]
    assert got[1]["o"] == ["a", "b", "c", "d", "", "e e e e"] and got[1]["p"] == ["a b", "c", "d ", "e e e e"]
    assert got[2]["g"] == [["a"]] and got[2]["m"] == got[2]["o"] == got[2]["p"] == ["a"]
    assert got[3]["g"] == got[3]["m"] == got[3]["o"] == got[3]["p"] == []
