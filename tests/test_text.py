from pyspark.sql import functions as F

from docweave.functions import keywords as K
from docweave.functions import text as T
from docweave.hooks import keyword_method
from docweave.operators.sentences import filter_markers, prepared


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


def test_strip_takes_unicode_spaces(spark):
    assert one(spark, T.strip(F.col("t")), t="\u00a0\u3000 a b\u2009\n") == "a b"


def test_cut_needs_whitespace_behind_the_mark(spark):
    assert one(spark, T.raw_sentences(F.col("t")), t="Pi is 3.14. Yes!  No?x") == ["Pi is 3.14.", "Yes!", "No?x"]


def test_cut_keeps_private_use_characters(spark):
    assert one(spark, T.raw_sentences(F.col("t")), t="a\ue000b. \ue000. . c! ") == ["a\ue000b.", "\ue000.", ".", "c!", ""]


def test_length_is_tested_on_raw_text_and_strictly(spark):
    rows = prepared(spark.createDataFrame([(1, "abcd. abcd.x \u2603\u2603\u2603\u2603\u2603.")], "doc_id long, text string"))
    assert [r["sentence"] for r in rows.orderBy("pos").collect()] == ["abcd.", "abcd.x ."]


def test_cleaning_keeps_listed_characters(spark):
    assert one(spark, T.clean_text(F.col("t")), t=" a\t\nb (c) [d] {e} \u20ac\u00a7 #1 'q' \"r\" ~|` ") == "a b (c) [d] {e}  #1 'q' \"r\" ~|`"


def test_markers(spark):
    hits = ["1.", "1.2.3", " \u0110i\u1ec1u 1.2.", "ARTICLE 4.", "ph\u1ee5 l\u1ee5c 1.", "Section 2. ."]
    misses = ["12", "1. Intro", "Article four.", "Section"]
    df = spark.createDataFrame([(s,) for s in hits + misses], ["s"]).filter(T.is_marker(F.col("s")))
    assert sorted(r["s"] for r in df.collect()) == sorted(hits)


def test_entities_are_replaced_in_order(spark):
    assert one(spark, T.html_to_text(F.col("t")), t="<p>a&amp;lt;b&nbsp;&nbsp;c</p> <b>d</b>") == "a<b c d"


def test_names_over_63_characters_are_dropped(spark):
    df = spark.createDataFrame([("a" * 63,), ("a" * 64,), ("ab",), ("--a..b c--",)], ["n"])
    assert [r["x"] for r in df.select(T.clean_name(F.col("n")).alias("x")).collect()] == ["a" * 63, None, None, "a.bc"]


def test_content_gate(spark):
    df = spark.createDataFrame([(None,), ("  ",), ("a" * 99,), ("a" * 100,)], "t string")
    assert [r["x"] for r in df.select(T.content_gate(F.col("t")).alias("x")).collect()] == ["empty", "empty", "needs_ocr", "ok"]


def test_best_content_order(spark):
    schema = (
        "document struct<summary: struct<text: string>, full_text: string, text: string, story: string, context: string>, "
        "top struct<text: string, story: string, context: string>"
    )
    long_html = "<p>" + "word " * 40 + "</p>"
    rows = [
        ((("s",), "f", "t", None, None), (None, None, None)),
        (((None,), "f", "t", None, None), (None, None, None)),
        (((None,), None, long_html, "story", None), (None, None, None)),
        (((None,), None, "<p>short</p>", "story", None), ("top", None, None)),
        (((None,), None, None, None, "ctx"), (None, None, None)),
        (((None,), None, None, None, None), (None, "st", None)),
        (((None,), None, None, None, None), (None, None, None)),
    ]
    best = spark.createDataFrame(rows, schema).select(T.best_content(F.col("document"), F.col("top")).alias("b"))
    assert [r["b"]["source"] for r in best.collect()] == [
        "summary.text", "full_text", "text (cleaned HTML)", "text (HTML, too short after cleaning)", "context", "story (fallback)", "none",
    ]


def test_keywords_keep_first_appearance(spark):
    got = one(spark, K.keywords(F.col("t")), t="Zebra apple zebra ABC kh\u00f4ng mango " + " ".join(f"word{i:02}" for i in range(20)))
    assert got == ["zebra", "apple", "mango"] + [f"word{i:02}" for i in range(7)]


def test_unknown_keyword_method_is_the_built_in_one(spark):
    assert one(spark, keyword_method("other")(F.col("t")), t="some longer words") == ["some", "longer", "words"]


def test_keyword_reply_drops_header_and_blanks(spark):
    assert one(spark, K.parse_keyword_lines(F.col("t")), t="T\u1eeb kh\u00f3a:\n a b \n\n c") == ["a b", "c"]


def test_headings_of_either_case(spark):
    rows = ["CHƯƠNG 1.", "MỤC 2.1", "PHẦN 3.", "PHỤ LỤC 1.", "ĐIỀU 4.", "điều 4.", "Diều 4.", "Section 2.", "1.2."]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "pos int, sentence string")
    kept = [r.sentence for r in filter_markers(df).collect()]
    assert kept == ["Diều 4."]
