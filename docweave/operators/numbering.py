"""Row numbers and running positions that stay parallel when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.session import checkpointed


def numbered(df: DataFrame, order: str, keys: list[str] | None = None, into: str = "row", parts: int | None = None) -> DataFrame:
    """1-based row number by a column of any type that can be ordered within ``keys``; nulls first.

    The rows are dealt to ranges of keys and order column and sorted there, so a key with most of the rows spreads over many
    tasks however its values lie.  The sorted rows are held, as another run may cut the ranges elsewhere; a table of the
    rows of each key and range, summed up along the ranges, gives each its start.  ``parts`` sets the number of ranges.
    """
    keys = keys or []
    by = [F.col(c) for c in [*keys, order]]
    dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    held = checkpointed(dealt.sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    ranged = held.withColumn("_range", F.shiftright("_at", 33))
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    for k in [*keys, "_range"]:
        starts = starts.withColumnRenamed(k, f"_s_{k}")
    same = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in [*keys, "_range"]]
    out = ranged.join(starts, same)
    return out.withColumn(into, F.col("_at") - F.col("_first") + F.col("_before") + 1).select(*df.columns, into)


def top_per_key(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each key.  Spark cuts to ``k`` before the shuffle as well, so hot keys stay small."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
