"""Exact top-k by inner product with a KD-tree in every shard of the vectors."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import checkpointed

SHARD_ROWS = 1024
LEAF_ROWS = 256
BLOCK_QUERIES = 256
RUN_SHARDS = 16
# Sums up to this size are exact in doubles, and so may go through a matrix product of doubles.
EXACT = 2**53
INDEX = "shard long, n int, width int, ids binary, points binary, lows binary, highs binary, spans binary, least binary"
HITS = "query_id long, vec_id long, score long"
BLOCKS = "block long, n int, width int, ids binary, homes binary, points binary, kth binary, kth_id binary"


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers; vectors of unequal length are compared as if the shorter went on with zeros."""
    w = min(a.shape[1], b.shape[1])
    a, b = a[:, :w], b[:, :w]
    if a.size and b.size and int(np.abs(a).max()) * int(np.abs(b).max()) * max(w, 1) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Tree:
    """Nodes over rows [start, end) of ``points``, each with the tight box of its rows and its least id.

    A node is split at the median of the widest side of its box; children follow in the list of nodes, -1 for none.
    """

    def __init__(self, ids, points, lows, highs, spans, least):
        self.ids, self.points, self.lows, self.highs, self.spans, self.least = ids, points, lows, highs, spans, least

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF_ROWS) -> Tree:
        order = np.arange(len(ids))
        lows, highs, spans, least = [], [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            rows = order[start:end]
            low, high = points[rows].min(axis=0), points[rows].max(axis=0)
            node = len(spans)
            lows.append(low)
            highs.append(high)
            least.append(ids[rows].min())
            spans.append([start, end, -1, -1])
            if parent >= 0:
                spans[parent][2 + side] = node
            if end - start > leaf:
                dim = int(np.argmax(high - low)) if len(low) else 0
                half = (end - start) // 2
                order[start:end] = rows[np.argpartition(points[rows, dim], half)] if len(low) else rows
                todo += [(start, start + half, node, 0), (start + half, end, node, 1)]
        return cls(ids[order], points[order], np.array(lows), np.array(highs), np.array(spans, np.int64), np.array(least, np.int64))

    def search(self, queries: np.ndarray, query_ids, k: int, kth, kth_id, kept: list):
        """Add to ``kept``, a heap of hits for each query, those here that can still beat its k-th hit known so far.

        Every node's bound is the largest product that its box allows.  A query opens nodes by falling bound and stops at
        the first that its k-th hit beats; hits are ordered by score, equal scores by smaller id.
        """
        bounds = product(np.maximum(queries, 0), self.highs) + product(np.minimum(queries, 0), self.lows)
        for row, own in enumerate(query_ids):
            q, best = queries[row : row + 1], kept[row]  # heap of (score, -id), the worst on top
            limit = (int(kth[row]), -int(kth_id[row]))
            if len(best) == k:
                limit = max(limit, best[0])
            heap = [(-int(bounds[row, 0]), int(self.least[0]), 0)]
            while heap:
                bound, first, node = heapq.heappop(heap)
                if (-bound, -first) < limit:
                    if -bound < limit[0]:
                        break
                    continue
                start, end, left, right = self.spans[node]
                if left >= 0:
                    for child in (left, right):
                        heapq.heappush(heap, (-int(bounds[row, child]), int(self.least[child]), int(child)))
                    continue
                scores = product(q, self.points[start:end])[0]
                for i in np.flatnonzero(scores >= limit[0]):
                    hit = (int(scores[i]), -int(self.ids[start + i]))
                    if hit < limit or -hit[1] == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, hit)
                    elif hit > best[0]:
                        heapq.heapreplace(best, hit)
                    if len(best) == k and best[0] > limit:
                        limit = best[0]


NO_LIMIT = np.iinfo(np.int64).min


def _matrix(vectors) -> np.ndarray:
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, v): floor(scale * component) as longs.  Rows with a null id, a null vector, or null or non-finite
    components take no part; of rows with the same id the one with the smallest vector does."""
    v = F.col(vector_col).cast("array<double>")
    unusable = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = df.where(F.col(id_col).isNotNull() & v.isNotNull() & ~unusable)
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def exact_top_k(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    scale: float = 64.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with all other rows.

    ``is_query`` is a condition on vec_id.  Ids are dealt by hash to shards of about ``shard_rows`` rows, so equal vectors
    spread; each shard's tree is one row of a checkpointed index.  A query first searches the shard that it lies in.  Its
    k-th hit goes with it to the other shards, where blocks of queries meet one shard at a time.
    Empty vectors score 0; a table with one usable vector gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    usable = checkpointed(whole_vectors(vectors, id_col, vector_col, scale))
    shards = max(1, math.ceil(usable.count() / shard_rows))
    placed = usable.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))

    def build(key, rows):
        tree = Tree.build(rows.vec_id.to_numpy(np.int64), _matrix(list(rows.v)))
        names = ("ids", "points", "lows", "highs", "spans", "least")
        data = [[getattr(tree, n).astype("<i8").tobytes()] for n in names]
        return pd.DataFrame({"shard": [key[0]], "n": [len(rows)], "width": [tree.points.shape[1]], **dict(zip(names, data, strict=True))})

    index = checkpointed(placed.groupBy("shard").applyInPandas(build, INDEX))
    queries = placed.where(is_query)

    def tree_of(row) -> Tree:
        n, w = int(row.n), int(row.width)
        arrays = {c: np.frombuffer(getattr(row, c), "<i8") for c in ("ids", "points", "lows", "highs", "spans", "least")}
        nodes = len(arrays["least"])
        return Tree(
            arrays["ids"],
            arrays["points"].reshape(n, w),
            arrays["lows"].reshape(nodes, w),
            arrays["highs"].reshape(nodes, w),
            arrays["spans"].reshape(nodes, 4),
            arrays["least"],
        )

    def hits(ids, kept):
        counts = [len(x) for x in kept]
        return pd.DataFrame(
            {
                "query_id": np.repeat(np.asarray(ids, np.int64), counts),
                "vec_id": np.array([-i for x in kept for _, i in x], np.int64),
                "score": np.array([s for x in kept for s, _ in x], np.int64),
            }
        )

    def at_home(key, asked, stored):
        if not len(asked) or not len(stored):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        ids = asked.vec_id.to_numpy(np.int64)
        none, kept = np.full(len(ids), NO_LIMIT), [[] for _ in ids]
        tree_of(stored.iloc[0]).search(_matrix(list(asked.v)), ids, k, none, np.zeros(len(ids), np.int64), kept)
        return hits(ids, kept)

    home = checkpointed(queries.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(at_home, HITS))

    # The k-th hit so far: fewer than k hits set no limit.
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i"))))
    limits = home.groupBy("query_id").agg(F.get(ordered, F.lit(k - 1)).alias("last"))
    blocks = max(1, math.ceil(queries.count() / BLOCK_QUERIES))
    asked = queries.join(limits, queries.vec_id == limits.query_id, "left").select(
        F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).alias("block"),
        "vec_id",
        "v",
        "shard",
        F.coalesce(-F.col("last.s"), F.lit(NO_LIMIT)).alias("kth"),
        F.coalesce(F.col("last.i"), F.lit(0)).alias("kth_id"),
    )

    def pack(key, rows):
        points = _matrix(list(rows.v))
        cells = {"ids": rows.vec_id, "homes": rows["shard"], "kth": rows.kth, "kth_id": rows.kth_id}
        return pd.DataFrame(
            {"block": [key[0]], "n": [len(rows)], "width": [points.shape[1]], "points": [points.astype("<i8").tobytes()]}
            | {c: [x.to_numpy("<i8").tobytes()] for c, x in cells.items()}
        )[["block", "n", "width", "ids", "homes", "points", "kth", "kth_id"]]

    packed = asked.groupBy("block").applyInPandas(pack, BLOCKS)
    sent = packed.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
        F.struct("block", "n", "width", "ids", "homes", "points", "kth", "kth_id").alias("q"),
    )
    tiles = sent.join(index.withColumnRenamed("n", "rows").withColumnRenamed("width", "dims"), "shard")
    # A block goes through a run of shards in one task, which hands its k-th hits from each to the next.
    run = (F.col("shard") / RUN_SHARDS).cast("long")
    runs = tiles.withColumn("run", run).repartition("run", "q.block").sortWithinPartitions("run", "q.block", "shard")
    flat = runs.select(
        "run", F.col("q.block").alias("block"), "shard", F.col("rows").alias("n"), F.col("dims").alias("width"), "ids", "points", "lows", "highs", "spans", "least",
        *[F.col(f"q.{c}").alias(f"q_{c}") for c in ("n", "width", "ids", "homes", "points", "kth", "kth_id")],
    )

    def elsewhere(frames):
        at, ids, kept = None, [], []
        for frame in frames:
            for row in frame.itertuples():
                if at != (row.run, row.block):
                    if len(ids):
                        yield hits(ids, kept)
                    at, ids = (row.run, row.block), np.frombuffer(row.q_ids, "<i8")
                    kept = [[] for _ in ids]
                away = np.flatnonzero(np.frombuffer(row.q_homes, "<i8") != row.shard)
                points = np.frombuffer(row.q_points, "<i8").reshape(row.q_n, row.q_width)[away]
                kth, kth_id = (np.frombuffer(x, "<i8")[away] for x in (row.q_kth, row.q_kth_id))
                tree_of(row).search(points, ids[away], k, kth, kth_id, [kept[i] for i in away])
        if len(ids):
            yield hits(ids, kept)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = home.union(flat.mapInPandas(elsewhere, HITS)).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
