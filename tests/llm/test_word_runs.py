"""Words found and hashed in whole Arrow columns, and what is made of them, against one text at a time."""

import numpy as np
import pyarrow as pa

from docweave.llm import word_runs
from docweave.llm.lines import CARD_TYPES, SLOT_BITS, line_cards, rarity_classes
from docweave.llm.near import RegionHash, words
from docweave.llm.word_runs import WordHashes, flat_text

TEXTS = ["One two\tTHREE", None, "", "no-space-behind", "Next\x0b\x0cÄrger É  x\n", " \n ", "W" * 1500 + " end", "a b\nc\n\nd", "\x1cnot space\x85", "last"]


def hashes_of(text):
    region = RegionHash()
    return [region(w, np.array([0]), np.array([len(w)]))[0] for w in words(text)]


def test_words_of_a_column(monkeypatch):
    for size in (word_runs.SLICE, 8):
        monkeypatch.setattr(word_runs, "SLICE", size)
        for column in (pa.array(TEXTS), pa.array(["cut", *TEXTS, "off"]).slice(1, len(TEXTS))):
            data, offsets = flat_text(column)
            found, _ = WordHashes(fold=True)(data[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0])
            assert found.tolist() == [h for t in TEXTS for h in hashes_of(t)]


def test_cards_are_small_and_count_every_word(spark):
    docs = spark.createDataFrame(list(enumerate(t for t in TEXTS if t is not None)), "doc_id long, text string")
    classes = rarity_classes(docs)
    assert len(classes) == 1 << SLOT_BITS
    # Rows that are shuffled hold half a token for each of their prefixes.
    assert CARD_TYPES["prefix"] == CARD_TYPES["meeting"] == "array<int>"
    got = {(r.doc_id, r.line_no): r.n for r in line_cards(docs, classes, 80).collect()}
    want = {(d, i): len(set(words(x))) for d, t in docs.collect() for i, x in enumerate(t.split("\n")) if words(x)}
    assert got == want
