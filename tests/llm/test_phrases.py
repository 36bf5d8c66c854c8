"""Phrase mining against a plain count, with fingerprints that collide, short slices and odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docweave.llm import phrases as P


def plain(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lowered):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    often = {g: c for g, c in f.items() if c >= least}
    out = []
    for (lang, ws), a in often.items():
        if len(ws) < 2:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        inside = any(
            lang == other and len(v) > len(ws) and c >= a and any(v[i : i + len(ws)] == ws for i in range(len(v) - len(ws) + 1))
            for (other, v), c in often.items()
        )
        if not inside:
            out.append((lang, -score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]], n[lang]))
    ranked, seen = [], Counter()
    for lang, s, a, phrase, x, y, total in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, x, y, total, -s))
    return ranked


def corpus():
    draw = random.Random(3)
    words = ["the", "New", "york", "of", "a\u00e9", "\x1cx", "\u00a0", "z"]
    rows = [(" ".join(draw.choices(words, k=draw.randint(0, 30))) + draw.choice([".", "\n", "\t", "\r\n", " ;"]) + "new York city  hall", draw.choice(["en", "de", None, "und", ""])) for _ in range(120)]
    return rows + [(None, "en"), ("", "en"), ("...", None), ("the the the the the the the the", "en"), ("x" * 5000, "en"), ("new york " * 40, "de")] + [("same text here again", "fr")] * 9


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, 1, "w") for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string, n long, words string")


@pytest.fixture(params=["whole", "short slices", "colliding"])
def setting(request, monkeypatch):
    if request.param == "short slices":
        monkeypatch.setattr(P, "TEXT_SLICE", 40)
        monkeypatch.setattr(P, "WINDOW_SLICE", 7)
    if request.param == "colliding":
        monkeypatch.setattr(P.Windows, "prints", lambda self, k: np.zeros(max(0, len(self.ids) - k + 1), np.uint64))
        monkeypatch.setattr(P.Sieve, "passes", lambda self, prints: np.ones(len(prints), bool))


def test_parts_in_one_process(setting):
    """The pieces that run inside tasks, over all texts, give the counts of all windows."""
    rows = [(t, x) for t, x in corpus() if x == "en" and t]
    names, flat = {}, []
    for t, _ in rows:
        for part in P.cut_long(t.encode()):
            ids, _, found = P.to_ids([part], b"en", 0)
            names |= {i: w for w, (i, _) in found.items()}
            flat.append(ids[:-1])
        flat.append(np.zeros(1, np.uint64))
    got = Counter()
    for _, ids, own in P.slices(np.concatenate(flat)):
        windows = P.Windows(ids)
        for k in (2, 3, 5):
            at = np.flatnonzero(windows.whole(k)[:own])
            if len(at):
                first, n = P.verified_groups(windows.prints(k)[at], ids, at, k)
                for row, m in zip([ids[i : i + k].tolist() for i in first], n.tolist(), strict=True):
                    got[b" ".join(names[i] for i in row).decode()] += m
    want = Counter()
    for text, _ in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
            ws = re.findall(r"[^ \t]+", piece)
            for k in (2, 3, 5):
                want.update(" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1))
    assert got == want


@pytest.mark.parametrize(("least", "top"), [(8, 2000), (5, 3)])
def test_mining(spark, least, top):
    got = P.mine_phrases(frame(spark, corpus()), least, top).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain(corpus(), least, top))


def test_empty_table(spark):
    assert P.mine_phrases(frame(spark, []), 2).collect() == []
    assert P.mine_phrases(frame(spark, [("a b", None)]), 2).collect() == []


def test_another_seed_gives_other_ids():
    ids = P.to_ids([b"york hall"], b"en", 0)[2], P.to_ids([b"york hall"], b"en", 1)[2]
    assert ids[0][b"york"][0] != ids[0][b"hall"][0] and ids[0][b"york"][0] != ids[1][b"york"][0]


def test_sieve_never_stops_its_own(spark):
    draw = np.random.default_rng(1)
    pairs = draw.integers(1, 1 << 62, (3000, 2)).astype(np.uint64)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "w0 long, w1 long")
    sieve = P.Sieve.of(df, ["w0", "w1"])
    own = np.array([P.Windows(row).prints(2)[0] for row in pairs])
    assert sieve.passes(own).all() and sieve.passes(draw.integers(1, 1 << 62, 20_000).astype(np.uint64)).mean() < 0.01


def test_counts_leave_in_small_batches():
    class Every:
        value = type("Sieve", (), {"passes": staticmethod(lambda prints: np.ones(len(prints), bool))})

    ids = np.arange(1, 300_001, dtype=np.uint64)
    ids[-1] = 0
    batch = pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary())], ["ids"])
    made = list(P._count_windows(2, Every)(iter([batch])))
    assert sum(len(b) for b in made) == 299_998 and max(len(b) for b in made) <= 1 << 16
    assert sorted(x for b in made for x in b.column("w0").to_pylist()) == list(range(1, 299_999))
