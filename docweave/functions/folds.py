"""Folds over the sentences of one document.

A document is one row, so its sentences travel as an array on that row and the sequential rules of chunk
building run as array expressions: no shuffle, and no group larger than the row itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.common import append, empty, let
from docweave.functions.text import strip, words

STRINGS = "array<string>"


# --- recursive split and merge -------------------------------------------------------------------------

SEPARATORS = ["\n\n", "\n", ".", "?", "!", " ", ""]


def split_recursive(
    text: Column,
    size: int,
    separators: list[str] | None = None,
    length: Callable[[Column], Column] = F.length,
) -> Column:
    """Pieces of a text as array<struct<piece, open, start>>.

    Each pass cuts the pieces that are still too long at one more separator, which stays at the front of the
    following piece.  ``open`` marks pieces of at least ``size`` and ``start`` the first piece of a run of
    siblings that may be merged.
    """
    seps = SEPARATORS if separators is None else separators

    def piece(p, is_open, start):
        return F.struct(p.alias("piece"), is_open.alias("open"), start.alias("start"))

    def cut(p: Column, sep: str) -> Column:
        parts = F.split(p, re.escape(sep))
        if sep != "":
            parts = F.transform(parts, lambda x, i: F.when(i > 0, F.concat(F.lit(sep), x)).otherwise(x))

        def mark(ps):
            def one(x, i):
                is_long = length(x) >= size
                return piece(x, is_long, (i == 0) | is_long | (length(F.get(ps, i - 1)) >= size))

            return F.transform(ps, one)

        return let(F.filter(parts, lambda x: x != ""), mark)

    def cut_open(sep: str):
        def one(p):
            found = F.lit(True) if sep == "" else p["piece"].contains(sep)
            return F.when(p["open"] & found, cut(p["piece"], sep)).otherwise(F.array(p))

        return one

    pieces = F.array(piece(text, F.lit(True), F.lit(True)))
    for sep in seps:
        pieces = F.flatten(F.transform(pieces, cut_open(sep)))
    return F.when(text != "", pieces).otherwise(F.slice(pieces, 1, 0))


def merge_splits(
    pieces: Column,
    size: int,
    overlap: int = 0,
    length: Callable[[Column], Column] = F.length,
) -> Column:
    """Join pieces to chunks of at most ``size``, carrying up to ``overlap`` over from chunk to chunk.

    ``pieces`` is an array<struct<piece, open, start>>; a new run begins at every ``start``.
    """

    def close(docs, cur):
        text = strip(F.array_join(cur, ""))
        return F.when((F.size(cur) > 0) & (text != ""), append(docs, text)).otherwise(docs)

    def step(acc, p):
        n = length(p["piece"])
        begun = F.struct(
            F.when(p["start"], close(acc["docs"], acc["cur"])).otherwise(acc["docs"]).alias("docs"),
            F.when(p["start"], F.slice(acc["cur"], 1, 0)).otherwise(acc["cur"]).alias("cur"),
            F.when(p["start"], F.lit(0)).otherwise(acc["total"]).alias("total"),
        )

        def drop_left(run):
            return F.aggregate(
                run["cur"],
                F.struct(run["total"].alias("total"), F.lit(0).alias("gone")),
                lambda a, x: F.when(
                    (a["total"] > overlap) | ((a["total"] + n > size) & (a["total"] > 0)),
                    F.struct((a["total"] - length(x)).alias("total"), (a["gone"] + 1).alias("gone")),
                ).otherwise(a),
            )

        def after_full(run):
            return let(
                drop_left(run),
                lambda left: F.struct(
                    close(run["docs"], run["cur"]).alias("docs"),
                    append(
                        F.slice(run["cur"], left["gone"] + 1, F.greatest(F.size(run["cur"]), F.lit(1))), p["piece"]
                    ).alias("cur"),
                    (left["total"] + n).alias("total"),
                ),
            )

        def extended(run):
            return F.struct(
                run["docs"].alias("docs"),
                append(run["cur"], p["piece"]).alias("cur"),
                (run["total"] + n).alias("total"),
            )

        return let(begun, lambda run: F.when(run["total"] + n > size, after_full(run)).otherwise(extended(run)))

    start = F.struct(empty(STRINGS).alias("docs"), empty(STRINGS).alias("cur"), F.lit(0).alias("total"))
    return F.aggregate(pieces, start, step, lambda a: close(a["docs"], a["cur"]))


# --- fixed windows -------------------------------------------------------------------------------------


def fixed_windows(items: Column, size: int, overlap: int = 0) -> Column:
    """Windows of ``size`` items that share ``overlap`` with the one before, as array<array<...>>."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the window")
    step = size - overlap

    def cut(xs):
        n = F.size(xs)
        count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
        windows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(xs, i * step + 1, size))
        return F.filter(windows, lambda w: F.size(w) > 0)

    return let(items, cut)


# --- packing labelled sentences ------------------------------------------------------------------------


def _blocks(items: Column) -> Column:
    """An array in about sqrt(n) slices of as many items."""

    def cut(xs):
        width = F.greatest(F.ceil(F.sqrt(F.size(xs).cast("double"))).cast("int"), F.lit(1))
        return F.transform(
            F.sequence(F.lit(0), F.size(xs) - 1, width), lambda at: F.slice(xs, at + 1, width)
        )

    return let(items, lambda xs: F.when(F.size(xs) > 0, cut(xs)).otherwise(F.transform(xs, lambda x: F.array(x))))


def pack(sentences: Column, limit: int = 2000) -> Column:
    """Chunk texts from an ordered array<struct<sentence, label>>.

    A new chunk begins when the label changes or when the sentence lengths (joining spaces not counted)
    would pass ``limit``.  Chunks are gathered in slices of sqrt(n) sentences, so that no step copies all that is done.
    """

    def flush(acc):
        return F.when(F.size(acc["cur"]) > 0, append(acc["done"], F.array_join(acc["cur"], " "))).otherwise(acc["done"])

    def step(acc, s):
        n = F.length(s["sentence"])
        new = (F.size(acc["cur"]) > 0) & ((s["label"] != acc["label"]) | (acc["len"] + n > limit))
        return F.struct(
            F.when(new, flush(acc)).otherwise(acc["done"]).alias("done"),
            F.when(new, F.array(s["sentence"])).otherwise(append(acc["cur"], s["sentence"])).alias("cur"),
            F.when(new | (F.size(acc["cur"]) == 0), s["label"].cast("long")).otherwise(acc["label"]).alias("label"),
            F.when(new, n).otherwise(acc["len"] + n).alias("len"),
        )

    state = ("cur", "label", "len")

    def block(acc, part):
        begun = F.struct(empty(STRINGS).alias("done"), *[acc[c].alias(c) for c in state])
        return let(
            F.aggregate(part, begun, step),
            lambda end: F.struct(append(acc["all"], end["done"]).alias("all"), *[end[c].alias(c) for c in state]),
        )

    start = F.struct(
        empty("array<array<string>>").alias("all"),
        empty(STRINGS).alias("cur"),
        F.lit(0).cast("long").alias("label"),
        F.lit(0).alias("len"),
    )

    def last(acc):
        rest = F.when(F.size(acc["cur"]) > 0, F.array(F.array_join(acc["cur"], " "))).otherwise(empty(STRINGS))
        return F.concat(F.flatten(acc["all"]), rest)

    return F.aggregate(_blocks(sentences), start, block, last)


def _runs(items: Column, starts: Callable[[Column, Column], Column]) -> Column:
    """array<array<item>>: ``items`` cut before each place i for which ``starts(items, i)`` holds, in one pass and one slice
    a run; place 0 always starts a run."""

    def cut(xs):
        places = F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: (i == 0) | starts(xs, i))
        runs = let(
            F.struct(xs.alias("xs"), places.alias("at")),
            lambda r: F.transform(
                r["at"], lambda at, j: F.slice(r["xs"], at + 1, F.coalesce(F.get(r["at"], j + 1), F.size(r["xs"])) - at)
            ),
        )
        return F.when(F.size(xs) > 0, runs).otherwise(F.transform(xs, lambda x: F.array(x)))

    return let(items, cut)


def grouped(sentences: Column) -> Column:
    """array<struct<sentence, label>> -> array<array<string>>: runs of equal labels."""
    runs = _runs(sentences, lambda xs, i: ~F.get(xs, i)["label"].eqNullSafe(F.get(xs, i - 1)["label"]))
    return F.transform(runs, lambda run: F.transform(run, lambda s: s["sentence"]))


def split_oversized(groups: Column, limit: int = 2000) -> Column:
    """array<struct<text, part>>: groups longer than ``limit`` (joined) with several sentences are packed again.

    ``part`` is true for pieces of such a group; they are exempt from merging small chunks.
    """

    def one(group):
        whole = F.array_join(group, " ")
        too_long = (F.length(whole) > limit) & (F.size(group) > 1)
        labelled = F.transform(group, lambda s: F.struct(s.alias("sentence"), F.lit(0).alias("label")))
        return F.when(
            too_long,
            F.transform(pack(labelled, limit), lambda t: F.struct(t.alias("text"), F.lit(True).alias("part"))),
        ).otherwise(F.array(F.struct(whole.alias("text"), F.lit(False).alias("part"))))

    return F.flatten(F.transform(groups, one))


def merge_small(chunks: Column, minimum: int = 50) -> Column:
    """Append chunks shorter than ``minimum`` to the one before; ``chunks`` is array<struct<text, part>>.

    Whether a chunk is appended depends on itself alone, so the runs that become one chunk are cut out and joined once.
    """
    runs = _runs(chunks, lambda xs, i: (F.length(F.get(xs, i)["text"]) >= minimum) | F.get(xs, i)["part"])
    return F.transform(runs, lambda run: F.array_join(F.transform(run, lambda c: c["text"]), " ", ""))


def add_overlap(chunks: Column, k: int) -> Column:
    """Put the last ``k`` words of a chunk (its own prefix included) before the next, if it has more than ``k``.

    Only the chunk before is looked at.  Results are gathered in slices of sqrt(n) chunks, so that no step copies all that
    is done.
    """
    if k <= 0:
        return chunks

    def prefixed(before, c):
        def after(prev):
            tail = F.array_join(F.slice(prev, F.size(prev) - k + 1, k), " ")
            return F.when(F.size(prev) > k, F.concat(tail, F.lit(" "), c)).otherwise(c)

        return let(words(F.coalesce(before, F.lit(""))), after)

    def step(acc, c):
        return let(prefixed(acc["last"], c), lambda text: F.struct(text.alias("last"), append(acc["out"], text).alias("out")))

    def block(acc, chunk_block):
        begun = F.struct(acc["last"].alias("last"), empty(STRINGS).alias("out"))
        return let(
            F.aggregate(chunk_block, begun, step),
            lambda done: F.struct(done["last"].alias("last"), append(acc["out"], done["out"]).alias("out")),
        )

    start = F.struct(F.lit(None).cast("string").alias("last"), empty("array<array<string>>").alias("out"))
    return F.aggregate(_blocks(chunks), start, block, lambda acc: F.flatten(acc["out"]))


# --- split points --------------------------------------------------------------------------------------


def parse_split_points(reply: Column, current: Column) -> Column:
    """Numbers of the first line holding 'split_after:'; NULL unless ascending and none below ``current``."""
    line = F.get(F.filter(F.split(reply, "\n"), lambda s: s.contains("split_after:")), F.lit(0))
    numbers = F.transform(F.regexp_extract_all(line, F.lit("([0-9]+)"), F.lit(1)), lambda s: s.try_cast("long"))
    valid = (F.array_sort(numbers) == numbers) & F.forall(numbers, lambda n: n >= current)
    return F.when(line.isNotNull() & valid, numbers)


def regroup(pieces: Column, points: Column) -> Column:
    """Join pieces (one space) and cut after the 1-based piece numbers in ``points``."""

    def step(acc, p):
        closes = F.array_contains(points, (acc["i"] + 1).cast("long"))
        cur = F.concat(acc["cur"], p, F.lit(" "))
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(closes, append(acc["done"], strip(cur))).otherwise(acc["done"]).alias("done"),
            F.when(closes, F.lit("")).otherwise(cur).alias("cur"),
        )

    start = F.struct(F.lit(0).alias("i"), empty(STRINGS).alias("done"), F.lit("").alias("cur"))
    return F.aggregate(
        pieces,
        start,
        step,
        lambda a: F.when(a["cur"] != "", append(a["done"], strip(a["cur"]))).otherwise(a["done"]),
    )


def budget_window(pieces: Column, first: Column, budget: int = 800, length: Callable[[Column], Column] | None = None) -> Column:
    """Tagged pieces from 0-based ``first`` on, up to and including the one that passes the token budget."""
    count = length or (lambda c: F.size(words(c)))
    tail = F.slice(pieces, first + 1, F.greatest(F.size(pieces) - first, F.lit(0)))

    def step(acc, p):
        number = (first + acc["i"] + 1).cast("string")
        tagged = F.concat(F.lit("<|start_chunk_"), number, F.lit("|>"), p, F.lit("<|end_chunk_"), number, F.lit("|>"))
        return F.when(acc["used"] > budget, acc).otherwise(
            F.struct(
                (acc["i"] + 1).alias("i"),
                (acc["used"] + count(p)).alias("used"),
                F.concat(acc["text"], tagged).alias("text"),
            )
        )

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("used"), F.lit("").alias("text"))
    return F.aggregate(tail, start, step, lambda a: F.struct(a["text"].alias("text"), a["i"].alias("taken")))


def budget_windows(pieces: Column, budget: int = 800, length: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<first, taken, text>>: ``budget_window`` again and again, each from where the one before ended.

    Windows go on until the document ends; a window that would hold only the last piece is not made, so a document of one
    piece has none.  Callers with a model's split points start each window there instead, with ``budget_window``.
    """
    count = length or (lambda c: F.size(words(c)))

    def step(acc, p):
        n = count(p)
        full = acc["used"] > budget
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(full, n).otherwise(acc["used"] + n).alias("used"),
            F.when(full, append(acc["starts"], acc["i"])).otherwise(acc["starts"]).alias("starts"),
        )

    def tagged(p, number):
        n = number.cast("string")
        return F.concat(F.lit("<|start_chunk_"), n, F.lit("|>"), p, F.lit("<|end_chunk_"), n, F.lit("|>"))

    def windows(s):
        def one(first, j):
            taken = F.coalesce(F.get(s["starts"], j + 1), F.size(s["pieces"])) - first
            parts = F.transform(F.slice(s["pieces"], first + 1, taken), lambda p, i: tagged(p, first + i + 1))
            return F.struct(first.alias("first"), taken.alias("taken"), F.array_join(parts, "").alias("text"))

        return F.transform(F.filter(s["starts"], lambda first: first < F.size(s["pieces"]) - 1), one)

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("used"), F.array(F.lit(0)).alias("starts"))
    starts = F.aggregate(pieces, start, step, lambda acc: acc["starts"])
    return let(F.struct(pieces.alias("pieces"), starts.alias("starts")), windows)
