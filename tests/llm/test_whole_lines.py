"""Line dedup of the registered query, down to lines of one word, against brute force."""

import re

from docweave.llm.lines import dedupe_lines
from docweave.llm.queries import QUERIES


def kept(rows):
    """Texts without the lines that resemble an earlier one; only blank lines are exempt."""
    gone, seen = set(), []
    for i, text in sorted(rows):
        for n, line in enumerate(text.split("\n")):
            own = set(re.split(r"\s+", line.lower())) - {""}
            if own and any(len(own & other) * 100 >= 80 * len(own | other) for other in seen):
                gone.add((i, n))
            if own:
                seen.append(own)
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


def test_query_drops_short_copies(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = kept([(r.doc_id, r.text or "") for r in docs.collect()])
    assert {r.doc_id: r.text or "" for r in QUERIES["op2_line_dedup"](spark, small).collect()} == want


def test_short_lines(spark):
    long = "x" * 500
    texts = [
        f"Read more\n\none two three four\n{long}", f"read  more\n \none two three\n{long}", "more read read\none two three four five\n\n",
        "Menu", "menu\none two three five", "Share this\nshare", "this share\nfour three two one",
    ]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.text for r in dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == kept(rows)
    assert got[1] == " \none two three" and got[2] == "\n" and got[6] == ""
