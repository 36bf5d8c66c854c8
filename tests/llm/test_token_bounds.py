"""Bounds of documents come from select, and words go to the library together without changing their ids."""

import json

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docweave.llm.bpe import read_tokenizer
from docweave.llm.token_files import SAMPLE, EliasFano, read_token_shards, separator_of, word_encoder, write_shard

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DOCUMENTS = 3 * SAMPLE


def read_back(spark, path):
    lengths = [1 + i % 5 for i in range(DOCUMENTS)]
    data = write_shard(list(range(DOCUMENTS)), lengths, np.arange(sum(lengths), dtype="<u4").tobytes())
    row = (0, 0, 0, DOCUMENTS, sum(lengths), bytearray(data))
    schema = "part int, n int, ids_before long, n_docs int, n_ids long, shard binary"
    spark.createDataFrame([row], schema).write.parquet(path)
    rows = sorted(read_token_shards(spark, path).collect(), key=lambda r: r.doc_id)
    ends = np.cumsum(lengths)
    return [(r.start, r.n_tokens) for r in rows] == [(e - n, n) for e, n in zip(ends.tolist(), lengths, strict=True)]


def test_bounds_are_read_by_select(spark, tmp_path, monkeypatch):
    assert read_back(spark, str(tmp_path / "right"))
    made = EliasFano.of.__func__

    def damaged(cls, values):
        held = made(cls, values)
        held.samples = held.samples.copy()
        held.samples[1:2] += 8
        return held

    monkeypatch.setattr(EliasFano, "of", classmethod(damaged))
    assert not read_back(spark, str(tmp_path / "damaged"))


def test_select_stays_between_samples():
    values = np.repeat(np.arange(0, 40_000, 40), 3)
    packed = EliasFano.of(values)
    packed.high = packed.high.copy()
    last = int(packed.samples[2])
    packed.high[(last >> 3) + 1 :] = 0  # nothing behind the next sample is needed
    assert [packed.get(i) for i in range(2 * SAMPLE)] == values[: 2 * SAMPLE].tolist()


def test_words_in_one_text_keep_their_ids():
    library = Tokenizer.from_file(WORD_BPE)
    texts = ["< <| <|start <|startoftext|> oftext|> |> a<|endoftext|>b <|ENDOFTEXT|>", "plain words, only ̸ e ́ क्", "", "x" * 500 + " 'S 's", "plain <|startoftext|>"]
    texts += ["Plain, PLAIN. plain... plain). don't's. it's, 12. 12.5! a.b. ... ,a É, é. naïve? ½. x'S! 'll. '. '.s", "plain; x" + "y" * 99 + "."]
    encode = word_encoder(read_tokenizer(WORD_BPE))
    for _ in range(2):  # the second time from the words that are kept
        for text, ids in zip(texts, encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_separators():
    def file(*tokens, **flags):
        plain = {"normalized": False, "lstrip": False, "rstrip": False, "single_word": False}
        return json.dumps({"added_tokens": [{"content": t, **plain, **flags} for t in tokens]})

    assert separator_of(file("<|a|>", "<b>")) == "<|a|>"
    assert [separator_of(x) for x in (file(), file("<a>", "[b]"), file("<<a>"), file("<a>", lstrip=True))] == [None] * 4


def test_plain_runs_go_to_the_model():
    import tokenizers

    texts = ["Übergrößen übergrößen, zzqx&&& zzqx éàü*** ×÷ a×b ªb º µ ÿŸ Σίσυφος ΣΑΣ İx é́ rock'n'roll ''' '&' _a_ Kzzq# ½! ŒUVRE qzx'"]
    library, sent = Tokenizer.from_file(WORD_BPE), []

    class Watched:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, given, **how):
            sent.extend(given)
            return self.inner.encode_batch_fast(given, **how)

    class Factory:
        from_str = staticmethod(lambda content: Watched(Tokenizer.from_str(content)))

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tokenizers, "Tokenizer", Factory)
        got = word_encoder(read_tokenizer(WORD_BPE))(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert not any(w in s for s in sent for w in ("über", "zzqx", "&&&", "éàü", "kzzq", "qzx")) and any("rock" in s for s in sent)
