"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import json
import math
import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.session import scratch_path


def let(value: Column, body) -> Column:
    """Name a value inside a column expression, so that it is computed once a row."""
    return F.transform(F.array(value), body).getItem(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def long_array(values) -> Column:
    """A constant array of longs; a literal of any length that the optimizer folds once."""
    return F.from_json(F.lit(json.dumps([int(v) for v in values])), "array<bigint>")


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it again: computed once, and no lineage behind it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps: it acts when the driver's garbage goes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Ranges:
    """Ranges of one long column with about equally many rows: range k holds the values above bound k-1 up to bound k.

    The bounds are values of the column itself (approximate quantiles); nulls count to the first range.
    """

    def __init__(self, df: DataFrame, column: str, count: int):
        shares = [i / count for i in range(1, count + 1)]
        found = df.agg(F.percentile_approx(F.col(column), shares, max(10_000, 20 * count)).alias("q")).first().q
        self.bounds = sorted(set(found or []))
        self.step = max(1, math.isqrt(len(self.bounds)))

    def number(self, value: Column) -> Column:
        if not self.bounds:
            return F.lit(0)
        chunks = [self.bounds[i : i + self.step] for i in range(0, len(self.bounds), self.step)]
        tops = long_array(c[-1] for c in chunks)
        inner = F.from_json(F.lit(json.dumps(chunks)), "array<array<bigint>>")

        def below(edges, v):
            return F.size(F.filter(edges, lambda b: b < v))

        found = let(value, lambda v: let(below(tops, v), lambda i: i * self.step + below(F.get(inner, i), v)))
        return F.when(value.isNull(), 0).otherwise(found)

    def is_top(self, value: Column, number: Column) -> Column:
        """Whether a value is the bound of its own range."""
        if not self.bounds:
            return F.lit(True)
        chunks = long_array(self.bounds)
        return F.coalesce(value == F.get(chunks, number), F.lit(False))


def worker_memory(name: str) -> dict:
    """A dict that a Python worker keeps from one task to the next; only for what may be lost at any time."""
    module = sys.modules.setdefault("docweave_worker_memory", types.ModuleType("docweave_worker_memory"))
    return vars(module).setdefault(name, {})
