"""How far resizing moves the cosines between vectors, estimated over seeded random pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions.vectors import cosine
from docweave.operators.numbering import numbered
from docweave.session import checkpointed

BLOCK = 1024


def paired(vectors: DataFrame, partners: int, seed: int, block: int = BLOCK) -> DataFrame:
    """The rows with a column `partners`: the rows after each in a seeded random circle, as structs of its columns.

    ``vectors`` has a column vec_id.  Rows are put in order of md5("seed:vec_id"), so the pairs are random but the same in
    any layout.  The circle is cut to blocks; each block also takes the first rows of the next, so a vector is copied to
    two blocks at most in a block's first rows and to one otherwise, whatever the number of partners.  A row has fewer
    partners than asked only where the table has no more other rows.
    """
    columns = vectors.columns
    if not 0 < partners <= block:
        raise ValueError(f"partners must lie between 1 and {block}")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")))
    placed = checkpointed(numbered(vectors.withColumn("_key", key), "_key", into="_place").drop("_key"))
    n = placed.count()
    reach = min(partners, max(n - 1, 0))
    if reach == 0:
        return vectors.withColumn("partners", F.array().cast(placed.select(F.array(F.struct(*columns)).alias("x")).schema["x"].dataType))
    at = F.col("_place") - 1
    # A guest stands behind its block's own rows; the circle's first rows stand behind its last ones.
    turns = F.array(F.struct(at.alias("at"), F.lit(True).alias("own")), F.struct(at.alias("at"), F.lit(False).alias("own")), F.struct((at + n).alias("at"), F.lit(False).alias("own")))
    stands = placed.select(*columns, F.explode(turns).alias("_s")).select(*columns, "_s.at", "_s.own")
    first = F.greatest(F.col("at") - reach, F.lit(0))
    last = F.least(F.col("at") - 1, F.lit(n - 1))
    hosts = F.filter(
        F.sequence(F.floor(first / block), F.floor(last / block)), lambda b: (b != F.floor(F.col("at") / block)) | (F.col("at") >= n)
    )
    blocks = F.when(F.col("own"), F.array(F.floor(F.col("at") / block))).when((first <= last) & (F.col("at") > 0), hosts)
    dealt = stands.select(*columns, "at", "own", F.explode(blocks).alias("block"))
    order = W.partitionBy("block").orderBy("at")
    following = F.array(*[F.lead(F.struct(*columns), i).over(order) for i in range(1, reach + 1)])
    return dealt.withColumn("partners", following).where("own").select(*columns, "partners")


def sampled_drift(before: DataFrame, after: DataFrame, partners: int = 4, seed: int = 0) -> DataFrame:
    """(drift, error, pairs): mean absolute change of cosine over random pairs of vectors, and how far off it may be.

    (vec_id, vector) on both sides; ids of one side alone take no part, nor do pairs with a missing or zero vector.  Each
    vector meets ``partners`` others (`paired`), so the work is linear in the table.  ``error`` is twice the deviation of
    the vectors' own means over the root of their number: not less than the standard error of ``drift`` as an estimate of
    the mean over all pairs, on average, as each pair is shared by two vectors.  Null without pairs, for one vector as well.
    """
    both = before.select("vec_id", F.col("vector").alias("b")).join(after.select("vec_id", F.col("vector").alias("a")), "vec_id")
    met = paired(both, partners, seed).select(
        F.transform("partners", lambda p: F.abs(cosine(F.col("b"), p["b"]) - cosine(F.col("a"), p["a"]))).alias("changes")
    )
    known = met.select(F.filter("changes", lambda c: c.isNotNull()).alias("c")).where(F.size("c") > 0)
    total = F.aggregate("c", F.lit(0.0), lambda s, x: s + x)
    rows = known.select(total.alias("total"), F.size("c").alias("n"))
    return rows.agg(
        (F.sum("total") / F.sum("n")).alias("drift"),
        (2 * F.stddev_samp(F.col("total") / F.col("n")) / F.sqrt(F.count(F.lit(1)))).alias("error"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("pairs"),
    )
