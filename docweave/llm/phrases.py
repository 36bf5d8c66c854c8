"""Phrases whose words occur together more often than apart: fingerprints of all n-grams, exact counts of the frequent ones."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import release_shuffles, stored, worker_memory

LONGEST = 5
# Bytes that are in no UTF-8 text stand for the end of a piece and of a document.
PIECE, DOCUMENT = b"\xff", b"\xfe"
# Pieces end at the marks and at line breaks, words at space and tab as well.
MARKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", PIECE * 10 + b" ")
WORD_END = re.compile(rb"[\t-\r .,;:!?]")
# Bytes of text that are cut to words at a time, and words whose windows are hashed at a time.
TEXT_SLICE = 1 << 21
WINDOW_SLICE = 1 << 18
# Distinct words, and windows, that a task holds before it passes their counts on, and rows that it passes on at once.
HELD_WORDS = 250_000
HELD_WINDOWS = 3 << 18
SENT_ROWS = 1 << 16
# Windows are counted in so many parts by their first word, so that not all of a length lie on disk at once.
WINDOW_BLOCKS = 2
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
# A sieve holds 32 bits for each frequent phrase, 16 MB at the most; a larger set only makes it pass more windows.
SIEVE_LEAST, SIEVE_MOST = 12, 27
SIEVE_HASHES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))

ID_SCHEMA = "ids binary, id long, lang string, word string, n long"
ARROW_IDS = pa.schema(
    [("ids", pa.binary()), ("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]
)


def cut_long(text: bytes) -> list[bytes]:
    """A text in parts of bounded size, cut where a word ends; a single word is never cut."""
    parts, start = [], 0
    while len(text) - start > TEXT_SLICE:
        end = WORD_END.search(text, start + TEXT_SLICE)
        if not end:
            break
        parts.append(text[start : end.start()])
        start = end.start()
    return [*parts, text[start:]]


def to_ids(texts: list[bytes], lang: bytes, seed: int) -> tuple[np.ndarray, np.ndarray, dict[bytes, tuple[int, int]]]:
    """(ids, ends, words) of texts of one language: the ids of all words in order with 0 at the end of a piece or text, where
    each text ends in ids, and id and count of every distinct word.  Ids depend on the language."""
    joined = DOCUMENT.join(texts) + DOCUMENT
    marked = joined.lower().translate(MARKS).replace(PIECE, b" \xff ").replace(DOCUMENT, b" \xfe ")
    encoded = pa.array(marked.split(), pa.binary()).dictionary_encode()
    codes, words = encoded.indices.to_numpy(), encoded.dictionary.to_pylist()
    own = xxhash.xxh3_64_intdigest(lang, seed)
    ids = np.array([0 if w in (PIECE, DOCUMENT) else xxhash.xxh3_64_intdigest(w, own) or 1 for w in words], np.uint64)
    seen = np.bincount(codes, minlength=len(words))
    counted = {w: (i, n) for w, i, n in zip(words, ids.tolist(), seen.tolist(), strict=True) if i}
    return ids[codes], np.flatnonzero(codes == words.index(DOCUMENT)) + 1, counted


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in ARROW_IDS], schema=ARROW_IDS)


def _texts_to_ids(seed: int):
    """Arrow batches (lang, text) to rows of the ids of each text and rows (id, lang, word, n) of words."""

    def groups(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text").cast(pa.binary())
        for lang in dict.fromkeys(langs):
            held, size = [], 0
            for i in (i for i, x in enumerate(langs) if x == lang):
                text = texts[i].as_py()
                if size and size + len(text) > TEXT_SLICE:
                    yield lang, held
                    held, size = [], 0
                held.append(text)
                size += len(text)
            yield lang, held

    def count_rows(counts: dict[str, dict[bytes, tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            if words:
                own, n = zip(*words.values(), strict=True)
                texts = pa.array([w.decode() for w in words], pa.string())
                yield _batch(id=_signed(own), lang=pa.array([lang] * len(words), pa.string()), word=texts, n=pa.array(n, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[bytes, tuple[int, int]]] = {}
        for batch in batches:
            for lang, held in groups(batch):
                if len(held) == 1:
                    made = [to_ids([part], lang.encode(), seed) for part in cut_long(held[0])]
                    # The end of a part that is not the last is no end of a piece.
                    rows = [np.concatenate([*(ids[:-1] for ids, _, _ in made), np.zeros(1, np.uint64)])]
                    found = [words for _, _, words in made]
                else:
                    ids, ends, words = to_ids(held, lang.encode(), seed)
                    rows, found = np.split(ids, ends[:-1]), [words]
                kept = [x.tobytes() for x in rows if x.any()]
                if kept:
                    yield _batch(ids=pa.array(kept, pa.binary()))
                own = counts.setdefault(lang, {})
                for words in found:
                    for w, (i, n) in words.items():
                        own[w] = (i, n + own[w][1]) if w in own else (i, n)
                # What a worker has freed is given back at once, as two of them share an executor's memory.
                made = rows = found = kept = ids = words = None
                pa.default_memory_pool().release_unused()
                if sum(map(len, counts.values())) > HELD_WORDS:
                    yield from count_rows(counts)
                    counts = {}
        yield from count_rows(counts)

    return run


def powers(base: np.uint64) -> np.ndarray:
    """base^0, base^1, .. for the longest stretch; a worker makes them once."""
    held = worker_memory("phrase-powers")
    if int(base) not in held:
        out = np.full(WINDOW_SLICE + LONGEST, base)
        out[0] = 1
        held[int(base)] = np.cumprod(out, dtype=np.uint64)
    return held[int(base)]


class Windows:
    """Rabin-Karp fingerprints of all windows of a run of word ids, from prefix polynomials in wrapping 64-bit numbers."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * powers(BASE)[: len(ids)], dtype=np.uint64)])
        self.breaks = np.concatenate([np.zeros(1, np.int32), np.cumsum(ids == 0, dtype=np.int32)])

    def prints(self, k: int) -> np.ndarray:
        """The fingerprint of the k words from each start that leaves as many."""
        n = max(0, len(self.ids) - k + 1)
        return (self.sums[k : k + n] - self.sums[:n]) * powers(BASE_INVERSE)[:n]

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words from each such start hold no end of a piece."""
        n = max(0, len(self.ids) - k + 1)
        return self.breaks[k : k + n] == self.breaks[:n]


def slices(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
    """(start, ids, own): stretches with the words that windows of their last starts need; the first `own` starts are theirs."""
    for start in range(0, len(ids), WINDOW_SLICE):
        yield start, ids[start : start + WINDOW_SLICE + LONGEST - 1], min(WINDOW_SLICE, len(ids) - start)


def verified_groups(prints: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first occurrence, count) of each distinct window of k ids among those that start at `at`.

    Occurrences are sorted by fingerprint and every one is compared with its neighbour, word by word; groups in which
    windows differ under one fingerprint are told apart by the ids themselves.
    """
    order = np.argsort(prints, kind="stable")
    prints, at = prints[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = prints[1:] != prints[:-1]
    del order, prints
    differs = np.zeros(len(at), bool)
    for j in range(k):
        word = ids[at + j]
        differs[1:] |= word[1:] != word[:-1]
    starts = np.flatnonzero(new)
    first, n = at[starts], np.diff(np.append(starts, len(at)))
    if not (differs & ~new).any():
        return first, n
    group = np.cumsum(new) - 1
    bad = np.unique(group[differs & ~new])
    mixed = at[np.isin(group, bad)]
    rows = np.lib.stride_tricks.sliding_window_view(ids, k)[mixed]
    _, again, m = np.unique(rows, axis=0, return_index=True, return_counts=True)
    return np.concatenate([np.delete(first, bad), mixed[again]]), np.concatenate([np.delete(n, bad), m])


class Sieve:
    """A bounded bit table of the fingerprints of frequent phrases; it may pass others, never stops one of them."""

    def __init__(self, table: np.ndarray, bits: int):
        self.table, self.bits = table, bits

    @staticmethod
    def _places(prints: np.ndarray, bits: int) -> list[np.ndarray]:
        return [(prints * m) >> np.uint64(64 - bits) for m in SIEVE_HASHES]

    def passes(self, prints: np.ndarray) -> np.ndarray:
        out = np.ones(len(prints), bool)
        for at in self._places(prints, self.bits):
            out &= (self.table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out

    @classmethod
    def of(cls, phrases: DataFrame, columns: list[str]) -> Sieve:
        """Built in the tasks from the phrases' ids; only the words of the bit table come to the driver."""
        bits = int(np.clip(np.ceil(np.log2(32 * max(1, phrases.count()))), SIEVE_LEAST, SIEVE_MOST))

        def marks(batches):
            for batch in batches:
                ids = np.stack([c.to_numpy().view(np.uint64) for c in batch.columns], axis=1)
                prints = (ids * powers(BASE)[: len(columns)]).sum(axis=1, dtype=np.uint64)
                at = np.unique(np.concatenate(cls._places(prints, bits)))
                word, first = np.unique(at >> np.uint64(6), return_index=True)
                if len(at):
                    held = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                    yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(held.view(np.int64))], ["word", "held"])

        marked = phrases.select(*columns).mapInArrow(marks, "word long, held long")
        found = marked.groupBy("word").agg(F.bit_or("held").alias("held")).toArrow()
        table = np.zeros(1 << (bits - 6), np.uint64)
        table[found.column("word").to_numpy()] = found.column("held").to_numpy().view(np.uint64)
        return cls(table, bits)


def flat_ids(column: pa.Array) -> np.ndarray:
    """All ids of a binary column behind each other, without a copy."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(np.uint64)


def _columns(k: int) -> list[str]:
    return [f"w{i}" for i in range(k)]


def _summed(prints: list[np.ndarray], ids: np.ndarray, at: list[np.ndarray], k: int) -> Iterator[pa.RecordBatch]:
    """The distinct windows with their counts, by first word, as neighbours with equal columns take less room; in batches of
    bounded size, as both sides hold each batch whole."""
    joined = [np.concatenate(parts) for parts in (prints, at)]
    # The slices' own parts go before the groups are sorted.
    prints.clear()
    at.clear()
    first, n = verified_groups(joined.pop(0), ids, joined.pop(), k)
    order = np.argsort(ids[first], kind="stable")
    first, n = first[order], n[order].astype(np.int64)
    for start in range(0, len(first), SENT_ROWS):
        own = slice(start, start + SENT_ROWS)
        words = [_signed(ids[first[own] + j]) for j in range(k)]
        yield pa.RecordBatch.from_arrays([*words, pa.array(n[own])], [*_columns(k), "n"])


def _count_windows(k: int, sieve, block: int | None = None):
    """Arrow batches of ids to (w0 .. , n): the k-word windows of which both shorter ones pass the sieve, summed in the task.

    Only windows whose first word is of the block are taken, if one is given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = flat_ids(batch.column("ids"))
            prints, places, size = [], [], 0
            for start, ids, own in slices(flat):
                windows = Windows(ids)
                shorter = windows.whole(k - 1)
                shorter[shorter] = sieve.value.passes(windows.prints(k - 1)[shorter])
                at = np.flatnonzero(windows.whole(k)[:own] & (shorter[:-1] & shorter[1:])[:own])
                at = at if block is None else at[ids[at] % np.uint64(WINDOW_BLOCKS) == block]
                prints.append(windows.prints(k)[at])
                places.append((at + start).astype(np.int32))
                size += len(at)
                del windows, shorter, at
                if size >= HELD_WINDOWS:
                    yield from _summed(prints, flat, places, k)
                    prints, places, size = [], [], 0
            if size:
                yield from _summed(prints, flat, places, k)
            flat = ids = batch = None
            pa.default_memory_pool().release_unused()

    return run


def frequent_phrases(documents: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, words, totals) of a table with lang and text: phrases of 2 to 5 words (words array of ids, a) and words
    (id, lang, word, n) that occur at least `least` times in a language, and totals (lang, n) of all words.

    Texts are cut once; each becomes a row of word ids, and words are counted by their text, so that an id stands for one
    word of one language (should two share one, all begins again with other ids).  Length by length, every window gets a
    fingerprint from prefix polynomials.  Windows of which both shorter ones can be frequent, by a bit table of bounded size,
    are grouped by fingerprint in the task and checked against the words at the group's first occurrence; the shuffle sums
    what that occurrence points to, the words' ids, so that no collision of fingerprints can add to a count.
    """
    spark = documents.sparkSession
    texts = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    for seed in count():
        held = stored(texts.mapInArrow(_texts_to_ids(seed), ID_SCHEMA), "phrase-ids")
        words = stored(held.where("id is not null").groupBy("id", "lang", "word").agg(F.sum("n").alias("n")), "phrase-words")
        if words.groupBy("id").count().where("count > 1").isEmpty():
            break
    release_shuffles(spark)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least)
    rows = held.where("id is null").select("ids")
    shorter, phrases = Sieve.of(frequent, ["id"]), []
    for k in range(2, LONGEST + 1):
        sieve = spark.sparkContext.broadcast(shorter)
        schema = ", ".join(f"{c} long" for c in [*_columns(k), "n"])
        parts = []
        for block in range(WINDOW_BLOCKS):
            counted = rows.mapInArrow(_count_windows(k, sieve, block), schema).groupBy(*_columns(k)).agg(F.sum("n").alias("a"))
            parts.append(stored(counted.where(F.col("a") >= least), f"phrases-{k}"))
            release_shuffles(spark)
        level = reduce(DataFrame.union, parts)
        phrases.append(level.select(F.array(*_columns(k)).alias("words"), "a"))
        if k < LONGEST:
            shorter = Sieve.of(level, _columns(k))
    return reduce(DataFrame.union, phrases), frequent, totals


def _cut_scores(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """Phrases with lang, n and the lowest of their cuts' scores, its l and r; exact in decimals of 38 digits."""
    known = phrases.select(F.col("words").alias("part"), F.col("a").alias("f")).union(words.select(F.array("id"), "n"))
    own = words.select(F.col("id").alias("_head"), "lang")
    placed = phrases.withColumn("_head", F.col("words")[0]).join(own, "_head").drop("_head").join(totals, "lang")
    cuts = placed.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    left, right = F.slice("words", F.lit(1), F.col("k")), F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))
    halves = cuts.withColumn("_left", left).withColumn("_right", right)
    halves = halves.join(known.select(F.col("part").alias("_left"), F.col("f").alias("l")), "_left")
    halves = halves.join(known.select(F.col("part").alias("_right"), F.col("f").alias("r")), "_right")
    score = F.expr("(cast(1000 * a as decimal(18,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(19,0)))")
    cut = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return halves.groupBy("lang", "words", "a", "n").agg(cut)


def _without_contained(scored: DataFrame, phrases: DataFrame) -> DataFrame:
    """Phrases without those inside a longer one that occurs as often."""
    spans = F.expr(
        "flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m))))"
    )
    longer = phrases.where(F.size("words") > 2).select(F.explode(F.array_distinct(spans)).alias("words"), F.col("a").alias("_longer"))
    most = longer.groupBy("words").agg(F.max("_longer").alias("_longer"))
    return scored.join(most, "words", "left").where(F.col("_longer").isNull() | (F.col("_longer") < F.col("a"))).drop("_longer")


def mine_phrases(documents: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """Each language's `top` phrases of 2 to 5 words by score, then a, then text: lang, rank, phrase, a, l, r, n, score.

    a counts the phrase, n all words of the language, l and r the parts of the cut with the lowest
    score floor(1000 a n / (l r)); of equal ones that with the shortest first part counts.  A phrase goes if a longer
    candidate contains it and occurs as often.

    A null lang counts as 'und', a null text as empty; empty texts have no words.  Texts of any length are read whole.  Rows
    that repeat count each time; extra columns are not read; an empty table gives an empty result.  Occurrences are summed
    in the tasks before any shuffle, so a phrase on a third of all rows costs no more than another.
    """
    phrases, words, totals = frequent_phrases(documents, least)
    kept = _without_contained(_cut_scores(phrases, words, totals), phrases)
    spelled = kept.select("words", F.posexplode("words").alias("at", "id")).join(words.select("id", "word"), "id")
    texts = spelled.groupBy("words").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("parts"))
    named = kept.join(texts, "words").withColumn("phrase", F.array_join("parts.word", " "))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select(
        "lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )
