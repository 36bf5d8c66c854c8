"""Removal of repeated and nearly repeated lines by an exact set-similarity join, found by column functions from cards of all lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.llm.common import let, release_shuffles
from docweave.llm.near import _mix
from docweave.llm.phrases import BASE, Sieve
from docweave.llm.word_runs import WordHashes, flat_text, runs
from docweave.session import checkpointed

PERCENT = 80
TOKEN_BITS = 57
TOKEN = (1 << TOKEN_BITS) - 1
# Tokens are counted in so many slots by hash; a slot's count is never less than its tokens' own.
SLOT_BITS = 20
SLOT_BLOCK = 1 << 12
MAP_LONGS = 3
JOIN_BLOCKS = 4
# A line's candidates are compared in rounds up to these ranks, then all others.
ROUNDS = (1, 16)
KEY_SEEDS = {"key": np.uint64(0x2545F4914F6CDD1D), "key2": np.uint64(0x9E6C63D0876A9A47)}
# Constants that turn the order of token hashes about; a line's least tokens in these orders are its meeting points.
TURNS = (0x0123456789ABCDEF & TOKEN, 0x0F1E2D3C4B5A6978 & TOKEN, 0x1A2B3C4D5E6F7081 & TOKEN)

BITS = [f"b{i}" for i in range(MAP_LONGS)]
PLACE = ("doc_id", "line_no")
CARD_TYPES = {"key": "long", "key2": "long", "doc_id": "long", "line_no": "int", "n": "int"}
CARD_TYPES |= dict.fromkeys(BITS, "long") | {"prefix": "array<int>", "meeting": "array<int>"}
CARD = list(CARD_TYPES)


def _tokens(line: Column) -> Column:
    """Distinct hashes of the line's words, in lower case, between white space."""
    words = F.filter(F.split(F.lower(line), r"\s+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(TOKEN))))


def _lowered(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))


def rarity_classes(documents: DataFrame) -> np.ndarray:
    """For each slot the logarithm of how many words of all texts fall in it: as many as there are slots, however large the corpus."""

    def run(batches):
        hashed, counts = WordHashes(fold=False), np.zeros(1 << SLOT_BITS, np.int64)
        held, size = [], 0
        for batch in batches:
            data, offsets = flat_text(batch.column(0))
            for i, j in runs(offsets):
                found, _ = hashed(data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i])
                held.append((found & np.uint64(len(counts) - 1)).astype(np.int32))
                size += len(found)
                if size >= len(counts):
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        blocks = counts.reshape(-1, SLOT_BLOCK)
        own = np.flatnonzero(blocks.any(axis=1))
        cells = [pa.array(own, pa.int32()), pa.array([blocks[i].tobytes() for i in own], pa.binary())]
        yield pa.RecordBatch.from_arrays(cells, ["block", "counts"])

    def levels(key, rows):
        counts = np.sum([np.frombuffer(x, np.int64) for x in rows["counts"]], axis=0)
        return pd.DataFrame({"block": [key[0]], "levels": [np.log2(counts + 1).astype(np.uint8).tobytes()]})

    # One row of a task in a group, and one row of a group in the end.
    counted = _lowered(documents).select("text").mapInArrow(run, "block int, counts binary")
    classes = np.zeros(((1 << SLOT_BITS) // SLOT_BLOCK, SLOT_BLOCK), np.uint8)
    for row in counted.groupBy("block").applyInPandas(levels, "block int, levels binary").collect():
        classes[row.block] = np.frombuffer(row.levels, np.uint8)
    return classes.ravel()


def _may_differ(n, percent: int):
    """Whether a set of n tokens can resemble any set but its equal: with one token more it must still be similar."""
    return n * 100 >= (n + 1) * percent


def _line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, number, start) of every line of the texts, in order."""
    breaks = np.flatnonzero(data[offsets[0] : offsets[-1]] == 10) + offsets[0]
    docs = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    return docs, np.arange(len(docs)) - np.searchsorted(docs, docs), starts


class LineSets:
    """Cards of lines, from the hashes of their words and the line that each word is in, which ascends."""

    def __init__(self, classes: np.ndarray, percent: int):
        self.classes, self.percent = classes.astype(np.uint64) << np.uint64(TOKEN_BITS), percent

    def __call__(self, hashes: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        """The lines that hold a word, and for each its size, keys, bitmaps, prefix and meeting points."""
        ranked = self.classes[hashes & np.uint64(len(self.classes) - 1)] | (hashes & np.uint64(TOKEN))
        order = np.argsort(ranked)
        order = order[np.argsort(line[order].astype(np.min_scalar_type(int(line[-1]))), kind="stable")]
        ranked, line = ranked[order], line[order]
        new = np.ones(len(ranked), bool)
        new[1:] = (ranked[1:] != ranked[:-1]) | (line[1:] != line[:-1])
        tokens, line = ranked[new] & np.uint64(TOKEN), line[new]
        starts = np.flatnonzero(np.diff(line, prepend=-1))
        n = np.diff(np.append(starts, len(line)))
        out = {k: np.add.reduceat(_mix(tokens ^ seed), starts).view(np.int64) for k, seed in KEY_SEEDS.items()}
        maps = (tokens >> np.uint64(6)) % np.uint64(1024) % np.uint64(MAP_LONGS)
        bits = np.uint64(1) << (tokens & np.uint64(63))
        for i in range(MAP_LONGS):
            own = np.where(maps == np.uint64(i), bits, np.uint64(0))
            out[f"b{i}"] = np.bitwise_xor.reduceat(own, starts).view(np.int64)
        # Only equal sets resemble the shortest ones, and those meet by their keys.
        differ = _may_differ(n, self.percent)
        # How many of n tokens, rarest first, two lines of the asked similarity can't all differ in.
        size = np.where(differ, n - (n * self.percent + 99) // 100 + 1, 0)
        ahead = np.arange(len(tokens)) - np.repeat(starts, n) < np.repeat(size, n)
        points = np.stack([np.minimum.reduceat(tokens ^ np.uint64(t), starts) for t in TURNS], axis=1)
        arrays = {k: pa.array(x) for k, x in out.items()} | {"n": pa.array(n, pa.int32())}
        return line[starts], arrays | {"prefix": _lists(tokens[ahead], size), "meeting": _lists(points[differ].ravel(), differ * len(TURNS))}


def _lists(tokens: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Lists of tokens' lower halves: tokens only bring lines together that are compared whole, so they may rarely agree by chance."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.astype(np.uint32).view(np.int32)))


def line_cards(documents: DataFrame, classes: np.ndarray, percent: int) -> DataFrame:
    """A row for each line that holds a word: its place, size, bitmaps, prefix and meeting points, and keys of its set of words."""
    held = documents.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        hashed, sets = WordHashes(fold=False), LineSets(held.value, percent)
        for batch in batches:
            names = batch.column(0).to_numpy()
            data, offsets = flat_text(batch.column(1))
            docs, numbers, starts = _line_bounds(data, offsets)
            bounds = np.append(starts, offsets[-1])
            for i, j in runs(bounds):
                found, places = hashed(data[bounds[i] : bounds[j]], starts[i:j] - bounds[i])
                if len(found):
                    line = np.searchsorted(starts[i:j], places + bounds[i], "right") - 1
                    own, cards = sets(found, line)
                    cards |= {"doc_id": pa.array(names[docs[i + own]], pa.int64()), "line_no": pa.array(numbers[i + own], pa.int32())}
                    yield pa.RecordBatch.from_arrays([cards[c] for c in CARD], CARD)

    schema = ", ".join(f"{c} {t}" for c, t in CARD_TYPES.items())
    return _lowered(documents).mapInArrow(run, schema)


def _differing(a: str, b: str) -> Column:
    """Bits that differ between the lines' bitmaps, each the parity of its tokens: one line has a token there alone."""
    return sum((F.bit_count(F.col(f"{a}.b{i}").bitwiseXOR(F.col(f"{b}.b{i}"))) for i in range(MAP_LONGS)), F.lit(0))


def _enough(a: str, b: str, percent: int) -> Column:
    """Length filter, and the bitmaps' bound on the overlap."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    lengths = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    # overlap >= percent / (100 + percent) * (na + nb), and overlap <= (na + nb - differing) / 2
    return lengths & ((na + nb - _differing(a, b)) * (100 + percent) >= (na + nb) * (2 * percent))


def _earlier(a: str, b: str) -> Column:
    """Whether line b stands before line a: in a document with a smaller id, or above it."""
    return (F.col(f"{b}.doc_id") < F.col(f"{a}.doc_id")) | (
        (F.col(f"{b}.doc_id") == F.col(f"{a}.doc_id")) & (F.col(f"{b}.line_no") < F.col(f"{a}.line_no"))
    )


def _lines_at(documents: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of the lines at the places, and rarely of others: a bit table of bounded size stands for the places."""
    spark = documents.sparkSession
    sieve = spark.sparkContext.broadcast(Sieve.of(places.select("doc_id", F.col("line_no").cast("long")), [*PLACE]))

    def run(batches):
        for batch in batches:
            names = batch.column(0).to_numpy()
            data, offsets = flat_text(batch.column(1))
            docs, numbers, starts = _line_bounds(data, offsets)
            prints = names[docs].view(np.uint64) + numbers.astype(np.uint64) * BASE
            ends = np.append(starts[1:] - (docs[1:] == docs[:-1]), offsets[-1])
            own = np.flatnonzero(sieve.value.passes(prints))
            lines = [data[a:b].tobytes() for a, b in zip(starts[own], ends[own], strict=True)]
            cells = [pa.array(names[docs[own]], pa.int64()), pa.array(numbers[own], pa.int32()), pa.array(lines, pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, ["doc_id", "line_no", "line"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, line_no int, line binary").withColumn("line", F.col("line").cast("string"))


def _whole_sets(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, line_no, tokens) of the lines in the pairs, from the whole texts."""
    places = checkpointed(pairs.select(*PLACE).union(pairs.select("other_id", "other_no")).distinct())
    asked = _lines_at(documents, places).join(places, [*PLACE], "left_semi")
    return checkpointed(asked.select(*PLACE, _tokens(F.col("line")).alias("tokens")))


def _similar(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The later lines (doc_id, line_no) of the pairs whose whole token sets are similar enough."""
    other = sets.select(F.col("doc_id").alias("other_id"), F.col("line_no").alias("other_no"), F.col("tokens").alias("others"))
    both = pairs.join(sets, ["doc_id", "line_no"]).join(other, ["other_id", "other_no"])
    common = F.size(F.array_intersect("tokens", "others"))
    union = F.size("tokens") + F.size("others") - common
    return checkpointed(both.where(common * 100 >= union * percent).select("doc_id", "line_no").distinct())


def _best_first(documents: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The later lines of the pairs that are similar enough.

    Each line is compared with its most alike candidates (least `unlike`) first, then with the next ones.  Only lines that
    these don't decide are compared with all their others, so most of a family's pairs are never compared.
    """
    order = W.partitionBy("doc_id", "line_no").orderBy("unlike", "other_id", "other_no")
    ranked = checkpointed(pairs.withColumn("rank", F.row_number().over(order)).drop("unlike"))
    sets = _whole_sets(documents, pairs)
    found = None
    for least, most in zip((0, *ROUNDS), (*ROUNDS, None), strict=True):
        asked = ranked.where(F.col("rank") > least)
        asked = asked if most is None else asked.where(F.col("rank") <= most)
        asked = asked if found is None else asked.join(found, ["doc_id", "line_no"], "left_anti")
        now = _similar(sets, asked.drop("rank"), percent)
        found = now if found is None else found.union(now)
        release_shuffles(documents.sparkSession)
    return found


PAIR = ("a.doc_id", "a.line_no", "b.doc_id as other_id", "b.line_no as other_no")


def _copies(cards: DataFrame, sets: DataFrame) -> DataFrame:
    """Places of the lines whose set of words another line had first."""
    several = sets.where("copies > 1").select("key", "key2", F.col("line.doc_id").alias("first_id"), F.col("line.line_no").alias("first_no"))
    places = cards.select("key", "key2", *PLACE)
    later = (F.col("doc_id") != F.col("first_id")) | (F.col("line_no") != F.col("first_no"))
    return places.join(several, ["key", "key2"]).where(later).select("doc_id", "line_no")


def _meetings(lines: DataFrame, percent: int) -> DataFrame:
    """Pairs of a line and the first line at one of its meeting points."""
    met = lines.select("doc_id", "line_no", "n", *BITS, F.posexplode("meeting").alias("turn", "token"))
    first = F.min(F.struct("doc_id", "line_no", "n", *BITS)).alias("f")
    hubs = met.groupBy("turn", "token").agg(first, F.count("*").alias("c")).where("c > 1").select("turn", "token", "f.*")
    tried = met.alias("a").join(hubs.alias("b"), ["turn", "token"]).where(_earlier("a", "b") & _enough("a", "b", percent))
    return tried.selectExpr(*PAIR).distinct()


def _flagged(lines: DataFrame, near: DataFrame) -> DataFrame:
    """The lines' cards with found, 1 for lines found already."""
    joined = lines.join(near.withColumn("found", F.lit(1)), [*PLACE], "left")
    return joined.select(*PLACE, "n", *BITS, F.coalesce("found", F.lit(0)).alias("found"), "prefix")


def _overlaps(flagged: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs of a line not found yet and an earlier one that share a token of their prefixes and pass the filters.

    Only tokens of one block by their hash are taken, so the postings of all never lie on disk at once.
    """
    posted = flagged.select(*PLACE, "n", *BITS, "found", F.posexplode("prefix").alias("at", "token"))
    posted = posted.where(F.pmod(F.col("token"), F.lit(JOIN_BLOCKS)) == block)
    a, b = posted.alias("a"), posted.alias("b")
    # The tokens before the shared one are unlike unless shared as well, so this one and the rest bound the overlap.
    left = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) + F.least("a.at", "b.at")
    position = left * (100 + percent) >= (F.col("a.n") + F.col("b.n")) * percent
    # Only lines that are not found yet are looked up.  The condition names the flags of both sides, as then both read the
    # same columns and share one exchange.
    open_ = F.col("a.found") <= F.least(F.col("b.found"), F.lit(0))
    match = (F.col("a.token") == F.col("b.token")) & open_ & _earlier("a", "b") & position & _enough("a", "b", percent)
    unlike = (_differing("a", "b") * 1000 / (F.col("a.n") + F.col("b.n"))).cast("int").alias("unlike")
    return a.join(b, match).select(*[F.expr(c) for c in PAIR], unlike).distinct()


def repeated_lines(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, line_no) of the lines that an earlier line resembles: Jaccard of word sets of percent / 100 or more.

    Only blank lines are never listed.  Earlier is by doc_id, then line number from 0.  Lines of one word set are joined
    first by digests.  The others' tokens are ordered by rarity; lines meet on tokens of their prefixes under the length,
    position and bitmap filters, and what remains is compared whole, the most alike pair of each line first.  Before that
    join each line is compared with the first line of its meeting points, and lines found there only serve as earlier ones:
    so families of thousands of variants don't meet in all pairs.
    """
    spark = documents.sparkSession
    usable = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    cards = checkpointed(line_cards(usable, rarity_classes(usable), percent))
    line = F.struct(*[c for c in CARD if c not in KEY_SEEDS])
    sets = checkpointed(cards.groupBy(*KEY_SEEDS).agg(F.min(line).alias("line"), F.count("*").alias("copies")))
    release_shuffles(spark)
    copies = checkpointed(_copies(cards, sets))
    # What is left in a variable keeps its files: the cards have served.
    del cards
    release_shuffles(spark)
    lines = sets.select("line.*").where(_may_differ(F.col("n"), percent))
    pairs = checkpointed(_meetings(lines, percent))
    release_shuffles(spark)
    near = _similar(_whole_sets(usable, pairs), pairs, percent)
    release_shuffles(spark)
    flagged = checkpointed(_flagged(lines, near))
    pairs = None
    # The flagged cards take the place of the others.
    del sets, lines
    release_shuffles(spark)
    for block in range(JOIN_BLOCKS):
        found = checkpointed(_overlaps(flagged, percent, block))
        pairs = found if pairs is None else pairs.union(found)
        release_shuffles(spark)
    pairs = checkpointed(pairs.distinct())
    # The cards of the distinct lines have served as well.
    del flagged, found
    release_shuffles(spark)
    far = _best_first(usable, pairs, percent)
    return copies.union(near).union(far)


def rests(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(row, text, n_lines, n_removed): each document as a struct, its text without repeated lines, and counts.

    A null text stays null and a null doc_id keeps its text.  Rows with one doc_id lose the same lines, so repeated rows
    stay alike; which lines go is decided as if each row's lines were the document's.  Of equal lines the first by doc_id
    and line number stays.  Columns of any name are carried in the struct; an empty table gives an empty result.
    """
    gone = repeated_lines(documents, percent).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    # All steps' tables but the lists of lines have served before the texts are joined.
    release_shuffles(documents.sparkSession)
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    joined = rows.join(gone, F.col("row.doc_id").cast("long") == F.col("doc_id"), "left")
    own = F.col("row.text").cast("string")
    lines = F.split(own, "\n")

    def rest(all_lines):
        places = F.sequence(F.lit(0), F.size(all_lines) - 1)
        return F.array_join(F.transform(F.array_except(places, "gone"), lambda i: F.get(all_lines, i)), "\n")

    text = F.when(F.col("gone").isNull() | own.isNull(), own).otherwise(let(lines, rest))
    n_lines, n_removed = F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size("gone"), F.lit(0))
    return joined.select("row", text.alias("text"), n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"))


def with_columns(done: DataFrame, columns: list[str], **changed) -> DataFrame:
    """The documents' own columns again, those named in `changed` with their new values."""
    return done.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def without_repeated_lines(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents with their columns, their texts without the lines that resemble an earlier one."""
    return with_columns(rests(documents, percent), documents.columns, text=F.col("text"))


def dedupe_lines(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) of every document; a null text has no lines."""
    return rests(documents.select("doc_id", "text"), percent).select("row.doc_id", "n_lines", "n_removed", "text")
