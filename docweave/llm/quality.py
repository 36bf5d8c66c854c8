"""Quality grades of documents by an ordinal regression on hashed text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Grades: 0 toxic, 1 poor, 2 good.
GRADES = 3
SLOT_BITS = 18
SAMPLE_ROWS = 8_000
ROUNDS = 100
PENALTY = 1.0
KEEP_AT = 0.4
PIECES = re.compile(r"[^\W\d_]+|[^\w\s]+")
KNOWN_PIECES = 200_000


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) >> (32 - SLOT_BITS)


class Features:
    """Slots of a text: its distinct words and runs of signs, and its shape in steps (capitals, signs, repetition)."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        pieces = PIECES.findall(text)
        distinct = {p.lower() for p in pieces}
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
        slots = []
        for piece in distinct:
            slot = self.known.get(piece)
            if slot is None:
                slot = self.known[piece] = _slot(piece)
            slots.append(slot)
        words = [p for p in pieces if p[0].isalpha()]
        many = max(1, len(words))
        shape = {
            "capitals": sum(w.isupper() and len(w) > 1 for w in words) / many,
            "signs": (len(pieces) - len(words)) / many,
            "distinct": len({w.lower() for w in words}) / many,
            "length": sum(map(len, words)) / many / 10,
            "size": min(1.0, len(words) / 200),
        }
        slots += [_slot(f"\0{name}:{min(10, int(share * 10))}") for name, share in shape.items()]
        return np.unique(np.array(slots, np.int32))


def minimized(loss, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Minimum of a smooth function that gives (value, gradient), by L-BFGS with halved steps."""
    value, gradient = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, used = gradient.copy(), []
        for s, y in reversed(pairs):
            share = s @ q / (s @ y)
            q -= share * y
            used.append(share)
        if pairs:
            q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, y), share in zip(pairs, reversed(used), strict=True):
            q += (share - y @ q / (s @ y)) * s
        step, slope = 1.0, gradient @ q
        while step > 1e-10:
            new_value, new_gradient = loss(x - step * q)
            if new_value <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * q, new_gradient - gradient
        if s @ y > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y)]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        x, value, gradient = x + s, new_value, new_gradient
        if done:
            break
    return x


class OrdinalModel:
    """Cumulative links: P(grade >= j) = sigmoid(weights . slots - threshold j), one weight vector, rising thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, slots: list[np.ndarray], grades: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> OrdinalModel:
        """Most likely weights under a squared penalty, by limited-memory quasi-Newton steps over all rows.

        Thresholds are a first one and positive gaps, so they stay in order.  Without rows every text gets the best grade.
        """
        size = 1 << SLOT_BITS
        if not len(grades):
            return cls(np.zeros(size), np.full(GRADES - 1, -30.0))
        rows = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
        columns = np.concatenate(slots)
        at = np.arange(len(slots))
        above = (grades[:, None] >= np.arange(1, GRADES)).mean(axis=0).clip(1e-3, 1 - 1e-3)
        start = -np.log(above / (1 - above))
        x = np.concatenate([np.zeros(size), [start[0]], np.log(np.maximum(np.diff(start), 0.1))])

        def loss(x):
            gaps = np.exp(x[size + 1 :])
            thresholds = x[size] + np.concatenate([[0], np.cumsum(gaps)])
            score = np.bincount(rows, weights=x[columns], minlength=len(slots))
            tails = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds, -60, 60)))
            # P(grade = g) is P(grade >= g) - P(grade >= g + 1), with 1 and 0 at the ends.
            padded = np.concatenate([np.ones((len(slots), 1)), tails, np.zeros((len(slots), 1))], axis=1)
            slopes = padded * (1 - padded)
            mass = np.maximum(padded[at, grades] - padded[at, grades + 1], 1e-12)
            upper, lower = slopes[at, grades] / mass, slopes[at, grades + 1] / mass
            moves = np.zeros((len(slots), GRADES + 1))
            moves[at, grades] += upper
            moves[at, grades + 1] -= lower
            inner = moves[:, 1:GRADES].sum(axis=0)
            out = np.empty_like(x)
            out[:size] = np.bincount(columns, weights=(lower - upper)[rows], minlength=size) + penalty * x[:size]
            out[size] = inner.sum()
            out[size + 1 :] = np.cumsum(inner[::-1])[::-1][1:] * gaps
            return -np.log(mass).sum() + penalty / 2 * (x[:size] ** 2).sum(), out

        x = minimized(loss, x, rounds)
        return cls(x[:size].astype(np.float32), x[size] + np.concatenate([[0], np.cumsum(np.exp(x[size + 1 :]))]))

    def tails(self, slots: np.ndarray) -> np.ndarray:
        score = float(self.weights[slots].sum(dtype=np.float64))
        return 1 / (1 + np.exp(-np.clip(score - self.thresholds, -60, 60)))


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for a toxic document, else 1 for a poor and 2 for a good one; the least of several labels.

    Labels without an id or a quality take no part; an unknown toxicity counts as none.
    """
    grade = F.when(F.coalesce("toxic", F.lit(0)) != 0, 0).when(F.col("quality") == 0, 1).otherwise(2)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))


def train_quality(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit on the labelled documents; of more than ``sample_rows`` labels those with the smallest hashed ids are taken."""
    grades = grades_of(labels)
    # Labels without a document leave room for others, so ids are matched before the sample is taken.
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    sample = grades.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(frames):
        features = Features()
        for frame in frames:
            frame["slots"] = [features(t).tobytes() for t in frame.text]
            yield frame[["doc_id", "grade", "slots"]]

    chosen = texts.join(F.broadcast(sample), "doc_id").mapInPandas(run, "doc_id long, grade int, slots binary")
    rows = chosen.toPandas().drop_duplicates("doc_id").sort_values("doc_id")
    return OrdinalModel.fit([np.frombuffer(s, np.int32) for s in rows.slots], rows.grade.to_numpy(np.int64))


def grader(documents: DataFrame, model: OrdinalModel):
    """A column function: struct (expected_grade, p_not_toxic, p_good) of a text, whole; null counts as empty."""
    held = documents.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    @F.pandas_udf("expected_grade double, p_not_toxic double, p_good double")
    def graded(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features, known = Features(), OrdinalModel(*held.value)
        for part in parts:
            tails = np.array([known.tails(features(t)) for t in part]).reshape(-1, GRADES - 1)
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "p_not_toxic": tails[:, 0], "p_good": tails[:, 1]})

    return graded


def grade_documents(documents: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, expected_grade, p_not_toxic, p_good, kept) of every whole text; kept from P(good) of ``keep_at`` on."""
    graded = grader(documents, train_quality(documents, labels))
    scored = documents.select(F.col("doc_id").cast("long").alias("doc_id"), graded(F.col("text")).alias("g"))
    return scored.select("doc_id", "g.*", (F.col("g.p_good") >= keep_at).alias("kept"))


def keep_good(documents: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The documents whose probability of being good is ``keep_at`` or more, with all their columns."""
    graded = grader(documents, train_quality(documents, labels))
    return documents.where(graded(F.col("text"))["p_good"] >= keep_at)
