"""A Merkle manifest of a table: one tree for each group of rows, and one over the groups' roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import stored

# Rows of one partition are numbered below this bit by monotonically_increasing_id.
ROW_BITS = 33


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal sha256 of the parts, one behind the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its UTF-8 byte count in front, so that no two rows read alike; '-' for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with `n`, the rows of their tree, and `idx`, their place in it, by the given columns after `tree`.

    Rows are range-partitioned and sorted; a table of the row counts of each tree and partition gives each its start, so no
    task sees a whole tree.
    """
    by = [F.col(c).asc_nulls_first() for c in ["tree", *order]]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    held = stored(dealt, name).withColumn("_part", F.shiftright("_at", ROW_BITS))
    parts = held.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("tree")
    before = F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(
        "tree", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(tree).alias("n")
    )
    placed = held.join(starts, ["tree", "_part"]).withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before"))
    return placed.drop("_at", "_part", "_first", "_before")


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (tree, n, idx, h) with the digests left and right of each in its run, as texts `before` and `after`.

    Every other place of a run is looked up by a join of the level with itself on the computed index of the sibling.
    """
    run, slot = F.floor(F.col("idx") / arity), F.col("idx") % arity
    out, found = nodes, []
    for shift in range(1, arity):
        there = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else run * arity + (slot + shift) % arity
        held = nodes.select("tree", F.col("idx").alias("_there"), F.col("h").alias(f"_h{shift}"))
        out = out.withColumn("_there", there).join(held, ["tree", "_there"], "left").drop("_there")
        found.append((shift, F.col(f"_h{shift}")))

    def side(left: bool) -> Column:
        # The slot that a shift leads to lies to the left exactly where it wraps around.
        wraps = [(shift, slot + shift >= arity, h) for shift, h in found]
        chosen = [F.when(w if left else ~w, F.coalesce(h, F.lit(""))).otherwise("") for _, w, h in wraps]
        return F.concat(*chosen)

    return out.select("tree", "n", "idx", "h", side(True).alias("before"), side(False).alias("after"))


def _grow(nodes: DataFrame, arity: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees from the leaves up, as (tree, n, idx, h, before, after), and the roots (tree, h, height)."""
    levels, roots = [], []
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while largest:
        single = nodes.where("n = 1").select("tree", "h", F.lit(len(levels)).alias("height"))
        roots.append(single)
        if largest == 1:
            break
        levels.append(stored(_with_siblings(nodes.where("n > 1"), arity), f"{name}-{len(levels)}"))
        nodes = (
            levels[-1]
            .where(F.col("idx") % arity == 0)
            .select(
                "tree",
                F.ceil(F.col("n") / arity).alias("n"),
                F.floor(F.col("idx") / arity).alias("idx"),
                digest(F.col("before"), F.col("h"), F.col("after")).alias("h"),
            )
        )
        largest = -(-largest // arity)
    if not roots:
        return [], nodes.select("tree", "h", F.lit(0).alias("height"))
    every = roots[0]
    for r in roots[1:]:
        every = every.union(r)
    return levels, stored(every, f"{name}-roots")


def _paths(levels: list[DataFrame], roots: DataFrame, carried: list[str], arity: int, name: str) -> DataFrame:
    """(tree, idx, *carried, path) of every leaf, from the roots (tree, height, *carried, path) down.

    A path lists, from the leaf up, the siblings of each level as 'left.right,'; that of the root is kept at its end.
    """

    def at(height: int) -> DataFrame:
        return roots.where(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("idx"), *carried, "path")

    heights = {r.height for r in roots.select("height").distinct().collect()}  # at most 64
    above = at(len(levels))
    for height in reversed(range(len(levels))):
        up = above.withColumnRenamed("idx", "_run").withColumnRenamed("path", "_up")
        here = levels[height].withColumn("_run", F.floor(F.col("idx") / arity)).join(up, ["tree", "_run"])
        step = F.concat(F.col("before"), F.lit("."), F.col("after"), F.lit(","), F.col("_up"))
        above = here.select("tree", "idx", *carried, step.alias("path"))
        if height in heights:
            above = above.union(at(height))
        if height and height % 8 == 0:
            above = stored(above, f"{name}-paths-{height}")
    return above


def merkle_manifest(rows: DataFrame, order: list[str], arity: int = 2) -> DataFrame:
    """Adds subroot, root and path to rows that have columns `group` (string or null), `leaf` and those of `order`.

    Per group, leaves ascend by `order`, then by leaf (equal rows are leaves of their own; which is which makes no
    difference).  While a tree has several nodes, each run of `arity` becomes the digest of its digests; the last run may be
    shorter, even one.  The groups' roots, null first and then in byte order, are the leaves of one more tree, whose root is
    the table's.  A lone leaf is its own root.  Null order values come first.

    Every level joins its nodes to themselves on the index of the sibling; keys are (tree, index), one row each, so a group
    that holds a third of all rows is spread like any other, and levels are written and read again.  Paths are added from
    the top down and hold one entry 'left.right,' for each level.  An empty table gives an empty result.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit(""))
    leaves = _numbered(stored(rows.withColumn("tree", tree), "merkle-leaves"), [*order, "leaf"], "merkle-sorted")
    leaves = stored(leaves, "merkle-placed")
    levels, subroots = _grow(leaves.select("tree", "n", "idx", F.col("leaf").alias("h")), arity, "merkle-level")
    tops = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group_tree"), "h", "height")
    placed = stored(_numbered(tops, ["group_tree"], "merkle-tops-sorted"), "merkle-tops")
    top_levels, top_root = _grow(placed.select("tree", "n", "idx", "h"), arity, "merkle-top")
    start = top_root.select("tree", "height", F.col("h").alias("root"), F.lit("").alias("path"))
    top_paths = _paths(top_levels, start, ["root"], arity, "merkle-top")
    groups = placed.select("idx", "group_tree", F.col("h").alias("subroot"), "height").join(top_paths.drop("tree"), "idx")
    heads = stored(groups.select(F.col("group_tree").alias("tree"), "height", "subroot", "root", "path"), "merkle-heads")
    paths = _paths(levels, heads, ["subroot", "root"], arity, "merkle")
    return leaves.join(paths, ["tree", "idx"]).drop("tree", "idx", "n")


def siblings(path: Column) -> Column:
    """All siblings on a path, level by level up to the root, left to right."""
    return F.translate(path, ".,", "")


def folded_root(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    steps = F.filter(F.split(path, ","), lambda s: s != "")
    return F.aggregate(
        steps, leaf, lambda h, s: digest(F.substring_index(s, ".", 1), h, F.substring_index(s, ".", -1))
    )


def document_manifest(documents: DataFrame) -> DataFrame:
    """Leaf, subroot, root and proof digest of every row of `documents`, and whether a tampered copy still verifies.

    Tampering adds 1 to n_chars where 7 divides the crc32 of the doc_id's decimal text; a null n_chars stays, and a row
    without doc_id is left alone.  Nulls in any column are written as '-' and differ from empty texts; texts of any length
    are hashed whole.  Rows that repeat are leaves of their own, extra columns are not read, an empty table gives no rows.
    """

    def leaf(n_chars: Column) -> Column:
        return digest(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(n_chars), field(F.col("text")))

    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    one_more = F.col("n_chars").cast("decimal(20,0)") + 1
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").alias("group"),
        leaf(F.col("n_chars")).alias("leaf"),
        F.when(struck, leaf(one_more)).alias("tampered"),
    )
    made = merkle_manifest(rows, ["doc_id"])
    folded = made.withColumn("folded_root", folded_root(F.coalesce("tampered", "leaf"), F.col("path")))
    return folded.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
