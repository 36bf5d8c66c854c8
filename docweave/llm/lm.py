"""Language-model scores of documents: counts, and a hashed maximum-entropy model over word classes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import release_shuffles
from docweave.llm.near import RegionHash
from docweave.llm.word_runs import WordHashes, flat_text, runs
from docweave.session import checkpointed

# Words whose counts every task holds: the most frequent, at most this many.
HEAD_WORDS = 1 << 17
HEAD_CLASSES = 28
TAIL_CLASSES = 4
BUCKET_BITS = 13
BATCH_TOKENS = 8192
BUFFER_TOKENS = 1 << 21
BLOCK_ROWS = 128
FAN_IN = 32
RATE = 0.2
# Tokens whose classes are weighed at a time, so that their rows stay in a core's cache.
AT_ONCE = 1024
ODDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class Tokens:
    """Hashes of texts' words, after each text one end; words hold no white space, so a line feed stands for the end."""

    def __init__(self):
        self.hashed = WordHashes(fold=True)
        self.end = RegionHash()(b"\n", np.array([0]), np.array([1]))

    def __call__(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hashes, sizes) of some texts after the others: all their tokens, and how many each has."""
        data, offsets = flat_text(column)
        for i, j in runs(offsets):
            bounds = offsets[i : j + 1] - offsets[i]
            found, places = self.hashed(data[offsets[i] : offsets[j]], bounds[:-1])
            ends = np.searchsorted(places, bounds[1:])
            yield np.insert(found, ends, self.end[0]), np.diff(ends, prepend=0) + 1


def contexts(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Feature numbers of each token: the word before it, the one before that, the third before, and the last two together."""
    at = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    before = np.concatenate([np.zeros(3, np.uint64), hashes])
    # Nothing stands before a text's first token.
    one, two, three = (before[3 - k : 3 - k + len(hashes)] * (at >= k) for k in (1, 2, 3))
    mixed = [one * ODDS[0], two * ODDS[1], three * ODDS[2], (one * ODDS[3]) ^ ((two + np.uint64(1)) * ODDS[4])]
    return np.stack([(((x ^ (x >> np.uint64(29))) * ODDS[0]) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16) for x in mixed])


class Classes:
    """Word classes: runs of frequent words of about equal mass, and the other words dealt to a few by hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tail_mass: np.ndarray):
        order = np.lexsort((hashes, -counts))
        mass = counts[order] + 0.5
        shares = (np.cumsum(mass) - mass / 2) / mass.sum() if len(mass) else mass
        _, numbers = np.unique(np.minimum((shares * HEAD_CLASSES).astype(int), HEAD_CLASSES - 1), return_inverse=True)
        by_hash = np.argsort(hashes[order])
        self.hashes, self.counts = hashes[order][by_hash], counts[order][by_hash]
        self.numbers = numbers[by_hash] + TAIL_CLASSES
        # The words that training doesn't hold count as one more word in each class of the tail.
        self.mass = np.concatenate([tail_mass + 0.5, np.bincount(numbers, weights=mass)]) if len(mass) else tail_mass + 0.5
        self.prior = np.log(self.mass / self.mass.sum()).astype(np.float32)

    @classmethod
    def held(cls, state: dict) -> Classes:
        """The classes as they were, from the attributes that were sent to a task."""
        made = cls.__new__(cls)
        made.__dict__.update(state)
        return made

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, place among the frequent words or -1) of each token."""
        if not len(self.hashes):
            return (hashes % np.uint64(TAIL_CLASSES)).astype(np.int64), np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        return np.where(known, self.numbers[at], (hashes % np.uint64(TAIL_CLASSES)).astype(np.int64)), np.where(known, at, -1)


def log_softmax(weights: np.ndarray, prior: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Logarithms of the shares of all classes for each token, a few tokens at a time."""
    out = np.empty((features.shape[1], len(prior)), np.float32)
    for at in range(0, len(out), AT_ONCE):
        z = out[at : at + AT_ONCE]
        rows = features[:, at : at + AT_ONCE]
        np.take(weights, rows[0], axis=0, out=z, mode="clip")
        for row in rows[1:]:
            z += weights.take(row, axis=0, mode="clip")
        z += prior
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return out


class Trainer:
    """Gradient steps over batches of tokens, each weight row with a rate that falls with its gradients so far."""

    def __init__(self, prior: np.ndarray):
        self.prior = prior
        self.weights = np.zeros((1 << BUCKET_BITS, len(prior)), np.float32)
        self.squares = np.full((1 << BUCKET_BITS, 1), 1.0, np.float32)
        self.seen = np.zeros(1 << BUCKET_BITS, np.int64)

    def step(self, features: np.ndarray, classes: np.ndarray):
        error = np.exp(log_softmax(self.weights, self.prior, features))
        error[np.arange(len(classes)), classes] -= 1
        for column in features:
            order = np.argsort(column, kind="stable")
            ordered = column[order]
            starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            rows, many = ordered[starts], np.diff(np.append(starts, len(ordered)))
            gradient = np.add.reduceat(error[order], starts, axis=0)
            self.squares[rows] += (gradient * gradient).mean(axis=1, keepdims=True)
            self.weights[rows] -= RATE * gradient / np.sqrt(self.squares[rows])
            self.seen[rows] += many


def in_training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 1, F.lit(True))


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, c): occurrences of each token in the texts, summed in the tasks before the shuffle."""

    def run(batches):
        tokens, held, size = Tokens(), [], 0

        def counted():
            found, many = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(found), 100_000):
                part = [pa.array(found[at : at + 100_000].view(np.int64)), pa.array(many[at : at + 100_000].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(part, ["h", "c"])

        for batch in batches:
            for hashes, _ in tokens(batch.column(0)):
                held.append(hashes)
                size += len(hashes)
                if size >= BUFFER_TOKENS:
                    yield from counted()
                    held, size = [], 0
        if held:
            yield from counted()

    return texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words above a count that at most ``most`` words reach; counts are told apart to about a twentieth."""
    level = F.floor(F.log2("c") * 16).cast("long")
    many = {r.level: r.n for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    total, least = 0, max(many, default=0) + 1
    for step in sorted(many, reverse=True):
        total += many[step]
        if total > most:
            break
        least = step
    return counts.where(level >= least)


def train(texts: DataFrame, classes) -> np.ndarray:
    """Weights of the class model: each task takes gradient steps over its own texts, then the tasks' rows are averaged.

    A row weighs by how often its task saw it.  The sums go up a tree of bounded groups, so no task holds all of them.
    """

    def run(batches):
        known, tokens = Classes.held(classes.value), Tokens()
        trainer = Trainer(known.prior)
        features, targets, size = [], [], 0

        def steps():
            f, t = np.concatenate(features, axis=1), np.concatenate(targets)
            for at in range(0, len(t), BATCH_TOKENS):
                trainer.step(f[:, at : at + BATCH_TOKENS], t[at : at + BATCH_TOKENS])

        for batch in batches:
            for hashes, sizes in tokens(batch.column(0)):
                f, t, start = contexts(hashes, sizes), known(hashes)[0], 0
                for end in np.cumsum(sizes).tolist():
                    size += end - start
                    features.append(f[:, start:end])
                    targets.append(t[start:end])
                    start = end
                    if size >= BATCH_TOKENS:
                        steps()
                        features, targets, size = [], [], 0
        if size:
            steps()
        part = TaskContext.get().partitionId()
        for block in range(0, 1 << BUCKET_BITS, BLOCK_ROWS):
            rows = slice(block, block + BLOCK_ROWS)
            seen = trainer.seen[rows].astype(np.float64)
            if seen.any():
                sums = (trainer.weights[rows] * seen[:, None]).astype(np.float64).tobytes()
                cells = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([sums], pa.binary()), pa.array([seen.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, ["part", "block", "sums", "seen"])

    schema = "part int, block int, sums binary, seen binary"
    partial = checkpointed(texts.mapInArrow(run, schema))

    def added(key, rows):
        total = [np.sum([np.frombuffer(x) for x in rows[c]], axis=0).tobytes() for c in ("sums", "seen")]
        return pd.DataFrame({"part": [key[1]], "block": [key[0]], "sums": [total[0]], "seen": [total[1]]})

    last = partial.agg(F.max("part")).first()[0] or 0
    while last:
        grouped = partial.withColumn("up", (F.col("part") / FAN_IN).cast("int")).groupBy("block", "up")
        partial, last = checkpointed(grouped.applyInPandas(added, schema)), last // FAN_IN
    weights = np.zeros((1 << BUCKET_BITS, len(classes.value["prior"])), np.float32)
    for row in partial.collect():  # at most one row for each block of weights
        seen = np.frombuffer(row.seen)[:, None]
        weights[row.block : row.block + BLOCK_ROWS] = np.frombuffer(row.sums).reshape(len(seen), -1) / np.maximum(seen, 1)
    return weights


def score_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Training texts are those whose crc32(doc_id as text) mod 5 is not 1; a null id counts as one of them.  Tokens are the
    words between ASCII white space with A-Z in lower case, then one end.  base_score sums the log10 shares of tokens with
    one half added to each count.  The model gives P(class | context) * P(word | class): a softmax over word classes from
    hashed features of the three words before, and the shares of words in their class.  Untrained it equals the base.

    Every task holds the counts of the most frequent words (at most 131,072); other words, with their counts in each
    document, meet the whole table of counts in a join.  Without training texts N and V are 0 and all words are unknown.
    Null texts are empty and have the end alone; repeated rows are scored each; other columns are not read.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = texts.where(in_training(F.col("doc_id"))).select("text")
    counts = checkpointed(word_counts(training))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = frequent(counts, HEAD_WORDS)
    table = head.toPandas()
    tail = counts.join(F.broadcast(head.select("h")), "h", "left_anti")
    # Hashes are unsigned where classes are dealt; the lower bits of both are the same.
    dealt = F.col("h").bitwiseAND(F.lit(TAIL_CLASSES - 1))
    masses = {r.k: r.m for r in tail.groupBy(dealt.alias("k")).agg(F.sum(F.col("c") + 0.5).alias("m")).collect()}
    tail_mass = np.array([masses.get(i, 0.0) for i in range(TAIL_CLASSES)])
    known = Classes(table.h.to_numpy(np.int64).view(np.uint64), table.c.to_numpy(np.int64), tail_mass)
    classes = spark.sparkContext.broadcast(known.__dict__)
    weights = spark.sparkContext.broadcast(train(training, classes))
    release_shuffles(spark)
    whole = math.log10(n + 0.5 * (v + 1))

    def run(batches):
        known, w, tokens = Classes.held(classes.value), weights.value, Tokens()
        shares = np.log10(known.mass)
        logs = np.log10(known.counts + 0.5)
        part, row = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            at = 0
            for hashes, sizes in tokens(batch.column(1)):
                numbers, places = known(hashes)
                features, gains = contexts(hashes, sizes), np.empty(len(hashes))
                for i in range(0, len(hashes), BATCH_TOKENS):
                    own = numbers[i : i + BATCH_TOKENS]
                    found = log_softmax(w, known.prior, features[:, i : i + BATCH_TOKENS])
                    gains[i : i + BATCH_TOKENS] = found[np.arange(len(own)), own] / math.log(10) - shares[own]
                starts = np.cumsum(sizes) - sizes
                text = np.repeat(np.arange(len(sizes)), sizes)
                here = places >= 0
                head_log = np.where(here, logs[np.maximum(places, 0)], 0.0) if len(logs) else np.zeros(len(hashes))
                # Other words of each text, with how often they occur there.
                order = np.lexsort((hashes[~here], text[~here]))
                rare, owner = hashes[~here][order], text[~here][order]
                first = np.flatnonzero(np.append(True, (rare[1:] != rare[:-1]) | (owner[1:] != owner[:-1]))[: len(rare)])
                ends = pa.array(np.searchsorted(owner[first], np.arange(len(sizes) + 1)).astype(np.int32))
                lists = (rare[first].view(np.int64), np.diff(np.append(first, len(rare))))
                columns = [
                    batch.column(0).slice(at, len(sizes)),
                    pa.array(part + row + np.arange(len(sizes))),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.add.reduceat(here.astype(np.int64), starts)),
                    *[pa.array(np.add.reduceat(x, starts)) for x in (head_log, gains)],
                    *[pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in lists],
                ]
                at, row = at + len(sizes), row + len(sizes)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_tokens", "head_known", "head_log", "gain", "rare", "times"])

    schema = "doc_id long, row long, n_tokens long, head_known long, head_log double, gain double, rare array<long>, times array<long>"
    scored = checkpointed(texts.mapInArrow(run, schema))
    release_shuffles(spark)
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("t"))
    found = rare.join(counts, "h", "left").groupBy("row").agg(
        F.sum(F.col("t") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_log"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("t")).otherwise(0)).alias("rare_known"),
    )
    base = F.col("head_log") + F.coalesce("rare_log", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        "doc_id",
        (~in_training(F.col("doc_id"))).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (base - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (base + F.col("gain")).alias("score"),
    )
