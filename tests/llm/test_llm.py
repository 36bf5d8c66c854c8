"""Operators for training text against brute force, the tokenizers library and round trips, and on odd inputs."""

import collections
import hashlib
import html as entities
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docweave.llm.bpe import Bpe, encode_and_decode, read_tokenizer
from docweave.llm.components import components
from docweave.llm.fingerprints import fingerprint_documents
from docweave.llm.html import blocks_of, extract_pages, features, labelled_blocks, main_text, train_tree
from docweave.llm.kdtree import exact_top_k
from docweave.llm.lines import dedupe_lines, without_repeated_lines
from docweave.llm.lm import score_documents
from docweave.llm.near import RegionHash, near_duplicates, parities, shingle_hashes, words
from docweave.llm.packing import best_fit, pack_documents
from docweave.llm.quality import OrdinalModel, grade_documents, grader, train_quality
from docweave.llm.token_files import EliasFano, Shard, read_token_shards, write_shard, write_token_shards
from docweave.session import scratch_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ODD_TEXTS = [
    "", "a <|endoftext|>b ΣΑΣ", " \x1c!\x1d! x\x85y z é ́a İx ǅ ½ ² Ⅷ 12'S don't'll <|startoftext|>", "日本語 😀 ​ ﻿",
    "x" * 3000, "a b᠎c\n\n\te", "\U0001d400 ᾳ ᾼ Ꭰ ꭰ Ა ა",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, kept string, h string, line string"


def odd_documents(spark):
    """Nulls in any column, empty, blank and long texts, repeated rows and columns whose names operators use as well."""
    long = " ".join(f"w{i % 3000}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "one two three four five six"), (6, "one two three four five six")]
    rows += [(6, "one two three four five six"), (None, "one two three four five six"), (7, "x"), (8, "x y"), (9, long + " end")]
    return spark.createDataFrame([(i, t, None, None, None, None, "k", "h", "l") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def test_fingerprints(spark, docs):
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprint_documents(docs).collect()}
    assert len(got) == len(texts)
    for (i, text), (_, following) in zip(texts, [*texts[1:], texts[0]], strict=True):
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
    by_text = collections.defaultdict(set)
    for i, text in texts:
        by_text[text].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert np.mean([r.near_edited for r in got.values()]) > 10 * np.mean([r.near_next for r in got.values()])


def test_fingerprints_follow_the_order_of_words(spark):
    text = [f"w{i}" for i in range(400)]
    turned = text[200:] + text[:200]
    df = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(turned)), (3, " ".join(text))], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint_documents(df).collect()}
    assert got[1].fingerprint == got[3].fingerprint and got[3].near_next == got[2].near_next < 0.9
    same = spark.createDataFrame([(5, "a b a b a b a b")], "doc_id long, text string")
    assert fingerprint_documents(same).first().near_next == 1.0


def kept_lines(rows):
    gone, seen = set(), []
    for i, text in sorted(rows):
        for n, line in enumerate(text.split("\n")):
            own = set(re.split(r"\s+", line.lower())) - {""}
            if own:
                if any(len(own & other) * 100 >= 80 * len(own | other) for other in seen):
                    gone.add((i, n))
                seen.append(own)
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


def test_line_dedup(spark, docs):
    some = docs.where("doc_id < 60")
    want = kept_lines([(r.doc_id, r.text) for r in some.collect()])
    assert {r.doc_id: r.text for r in dedupe_lines(some).collect()} == want


def test_line_dedup_of_a_family(spark):
    base = [f"w{i}" for i in range(20)]
    rows = [(i, " ".join(base[: i % 20] + [f"x{i}"] + base[i % 20 + 1 :]) + "\nshort line") for i in range(60)]
    got = {r.doc_id: r.text for r in dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == kept_lines(rows) and [t.endswith("short line") for t in got.values()].count(True) == 1


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    graded = grader(docs, train_quality(docs, labels.where(~held)))
    rows = docs.join(labels.where(held), "doc_id").select("quality", "toxic", graded("text")["p_good"].alias("p")).collect()
    good = [r.p for r in rows if r.quality == 1 and not r.toxic]
    bad = [r.p for r in rows if r.toxic or not r.quality]
    assert np.mean(np.array(good) >= 0.4) > 0.9 and np.mean(good) > np.mean(bad) + 0.3


def test_ordinal_model():
    rng = np.random.default_rng(1)
    slots = [np.unique(np.append(rng.integers(10, 200, 20), g)).astype(np.int32) for g in (0, 1, 2) for _ in range(50)]
    model = OrdinalModel.fit(slots, np.repeat([0, 1, 2], 50))
    assert model.thresholds[0] < model.thresholds[1]
    assert np.mean([(model.tails(s) > 0.5).sum() == g for s, g in zip(slots, np.repeat([0, 1, 2], 50), strict=True)]) > 0.95
    assert OrdinalModel.fit([], np.zeros(0, int)).tails(slots[0])[1] > 0.99


def test_top_k(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = df.collect()
    ids = np.array([r.vec_id for r in rows])
    whole = np.floor(64 * np.array([r.embedding for r in rows], float)).astype(int)
    want = []
    for i in np.flatnonzero(ids % 20 == 0):
        scores = whole @ whole[i]
        best = [j for j in np.lexsort((ids, -scores)) if j != i][:20]
        want += [(int(ids[i]), n + 1, int(ids[j]), int(scores[j])) for n, j in enumerate(best)]
    got = exact_top_k(df, F.col("vec_id") % 20 == 0, shard_rows=64).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [None, 1.0]), (None, [1.0, 1.0]), (4, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [])]
    rows += [(0, [1.0, 2.0]), (20, [1e9, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit("x"))
    got = sorted(map(tuple, exact_top_k(df, F.col("vec_id") % 20 == 0, k=2, shard_rows=2).collect()))
    big = 64 * 64 * 10**9 + 64 * 128
    assert got == [(0, 1, 20, big), (0, 2, 4, 64 * 64 + 128 * 128), (20, 1, 0, big), (20, 2, 4, big)]
    assert exact_top_k(df.where("false"), F.col("vec_id") >= 0).collect() == []


def test_bpe(spark, docs):
    library, own = Tokenizer.from_file(WORD_BPE), Bpe(read_tokenizer(WORD_BPE))
    for text in [*ODD_TEXTS, *[r.text for r in docs.limit(40).collect()]]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_elias_fano():
    rng = np.random.default_rng(2)
    for values in ([], [0], [5], [0] * 700 + [10**12] + [10**12 + 5] * 9, np.sort(rng.integers(0, 10**6, 3000)).tolist()):
        packed = EliasFano.read(memoryview(EliasFano.of(values).to_bytes()), 0)[0]
        assert packed.all().tolist() == list(values)
        assert all(packed.get(i) == v for i, v in enumerate(values) if i % 7 == 0 or i > 690)


def test_shard():
    ids = np.arange(10, dtype="<u4") * 9000
    shard = Shard(write_shard([None, -(2**62), 2**62], [3, 0, 7], ids.tobytes()))
    assert shard.doc_ids == [None, -(2**62), 2**62]
    assert [shard.document(i).tolist() for i in range(3)] == [ids[:3].tolist(), [], ids[3:].tolist()]


def test_token_shards(spark, docs):
    library, path = Tokenizer.from_file(WORD_BPE), scratch_path(spark, "shards")
    write_token_shards(docs, path, WORD_BPE)
    got = {r.doc_id: tuple(r)[1:] for r in read_token_shards(spark, path).collect()}
    start = 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 2]
        assert got[r.doc_id] == (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)


def test_page_text(spark, small):
    tree, (x, y) = train_tree(), labelled_blocks()
    assert (tree.predict(x) == y).all()
    pages = spark.read.parquet(f"{small}/pages.parquet")
    for r in extract_pages(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in parts]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_odd_pages(spark):
    tree = train_tree()
    page = "<nav><a href=x>Home</a></nav><article><p>A &amp; B&nbsp;c<br>d<p>Of.<form>-<input></form></article><aside>no</aside><footer>x"
    assert main_text(page, tree) == "A & B c d\nOf."
    assert main_text("", tree) == "" and blocks_of("<!-- a <p>b") == [] and features([]).shape[0] == 0
    assert blocks_of("<div><b>x</div></b></p></p>y<p hidden>z</p>")[0]["text"] == "x"
    df = spark.createDataFrame([(1, None, None), (None, "u", "<p"), (3, "u", "<script>" + "a" * 10000)], "page_id long, url string, html string")
    assert [r.text for r in extract_pages(df).collect()] == ["", "", ""]


def test_best_fit_search():
    # The tightest bin has the item's source, so the next larger is taken; then one has its cluster, so a new one opens.
    places = best_fit([8, 7, 2, 2, 1], ["a", "b", "a", "b", "c"], ["1", "2", "3", "4", "4"], 10)
    assert places == [(0, 0), (1, 0), (1, 7), (0, 8), (1, 9)]


def test_packing(spark, docs):
    rows = pack_documents(docs, capacity=256, group_rows=64).collect()
    counts = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    found, bins = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        found[r.doc_id] += r.n_tokens
        if r.bin:
            bins[r.bin].append(r)
    assert found == counts
    for held in bins.values():
        assert sum(r.n_tokens for r in held) == held[0].bin_tokens <= 256
        assert len({r.source for r in held}) == len(held) == len({r.cluster for r in held})
        at = 0
        for r in sorted(held, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens


def linked(rows, k):
    sets = {}
    for i, text in rows:
        found = (text or "").encode().lower().split()
        n = min(k, len(found))
        sets[i] = {tuple(found[j : j + n]) for j in range(len(found) - n + 1)} if found else set()
    name = {i: i for i in sets}

    def top(i):
        while name[i] != i:
            i = name[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and top(a) != top(b):
                x, y = sorted((top(a), top(b)))
                name[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def test_near_duplicates(spark, docs):
    base = [f"v{i}" for i in range(120)]
    family = [(10_000 + i, " ".join(base[: i * 4] + [f"y{i}"] + base[i * 4 + 1 :])) for i in range(25)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + family
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == linked(rows, 4)


def test_near_duplicates_at_the_threshold(spark):
    """A family whose members' similarities lie on both sides of the threshold."""
    draw = np.random.default_rng(3)
    rows = []
    for i in range(160):
        text = [f"v{j}" for j in range(150)]
        for at in draw.choice(150, draw.integers(0, 7), replace=False):
            text[at] = f"y{i}-{at}"
        rows.append((i, " ".join(text)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    want = linked(rows, 4)
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
    assert 10 < len({top for _, top, _ in want.values()}) < 150


@pytest.mark.parametrize("size", [0, 1, 20, 300, 5000])
def test_parities_never_differ_more_than_sets(size):
    draw = np.random.default_rng(size)
    for own in (0, 1, 7, 200):
        both, one, other = (draw.integers(0, 1 << 63, n).astype(np.uint64) for n in (size, own, own // 2))
        x, y = parities(np.concatenate([both, one])), parities(np.concatenate([both, other]))
        differ = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        assert differ <= own + own // 2 and (differ + own + own // 2) % 2 == 0


def test_shingles_stand_alike_anywhere():
    region = RegionHash()
    text = words(" ".join(f"W{i}" for i in range(40_000)) + " " + "z" * 5000)
    whole = shingle_hashes(text, 4, region)
    assert len(whole) == len(text) - 3
    assert set(shingle_hashes(text[20_000:20_010], 4, region)) <= set(whole)
    assert len(shingle_hashes(text[:2], 4, region)) == 1 and len(shingle_hashes([], 4, region)) == 0


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(1, 200)] + [(0, 200), (500, 501), (501, 500), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


@pytest.mark.parametrize("head", [0, 50, 1 << 17])
def test_language_model(spark, docs, monkeypatch, head):
    monkeypatch.setattr("docweave.llm.lm.HEAD_WORDS", head)
    texts = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = collections.Counter(w for i, t in texts.items() if not held[i] for w in t)
    n = sum(counts.values())
    whole = math.log10(n + 0.5 * (len(counts) + 1))
    got = {r.doc_id: r for r in score_documents(docs).collect()}
    for i, t in texts.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(w in counts for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10(counts[w] + 0.5) - whole for w in t))
    if head == 1 << 17:
        assert sum(r.score - r.base_score for r in got.values()) > 0


OPERATORS = {
    "fingerprints": fingerprint_documents,
    "lines": dedupe_lines,
    "grades": lambda df: grade_documents(df, df.select("doc_id", F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic"))),
    "bpe": lambda df: encode_and_decode(df, WORD_BPE),
    "packing": pack_documents,
    "near": near_duplicates,
    "lm": score_documents,
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_documents(spark, name):
    df = odd_documents(spark)
    rows = OPERATORS[name](df).collect()
    assert len({(r.doc_id, getattr(r, "piece", 0)) for r in rows}) >= 10
    if name != "packing":
        assert len(rows) == df.count()
    assert OPERATORS[name](df.where("false")).collect() == []


def test_odd_token_shards(spark):
    path = scratch_path(spark, "odd-shards")
    write_token_shards(odd_documents(spark), path, WORD_BPE)
    rows = sorted(read_token_shards(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9]
    empty = scratch_path(spark, "no-shards")
    write_token_shards(odd_documents(spark).where("false"), empty, WORD_BPE)
    assert read_token_shards(spark, empty).collect() == []


def test_pipeline(spark, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, small)
    lined = corpus_pipeline.lines(spark, good, small)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    want = {i: t for i, t in kept_lines(rows).items() if t == dict(rows)[i] or t.strip()}
    assert {r.doc_id: r.text for r in lined.collect()} == want
    assert lined.columns == docs.columns and all(r.n_chars == len(r.text) for r in lined.collect())
    kept = {r.doc_id for r in corpus_pipeline.near(spark, lined, small).collect()}
    assert kept == {i for i, (_, _, keep) in linked(list(want.items()), 5).items() if keep}
    packed = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in packed} == kept


def test_line_dedup_keeps_columns_of_any_name(spark):
    names = ["_id", "_lines", "_removed", "_gone", "row", "gone", "n_removed", "a.b"]
    df = spark.createDataFrame([(1, "a b c", *names), (2, "a b c\nd", *names), (None, None, *names)], ["doc_id", "text", *names])
    got = sorted(tuple(r) for r in without_repeated_lines(df).collect() if r.doc_id)
    assert got == [(1, "a b c", *names), (2, "d", *names)]
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    lined = corpus_pipeline.lines(spark, df.withColumn("n_chars", F.lit(9).cast("long")), "")
    assert {(r.doc_id, r.text, r.n_chars, r["_removed"]) for r in lined.collect()} == {(1, "a b c", 9, "_removed"), (2, "d", 1, "_removed"), (None, None, 9, "_removed")}


def test_columns_stay(spark):
    df = odd_documents(spark)
    assert set(df.columns) <= set(without_repeated_lines(df).columns)
