"""Records of JSON files of any size, array files included, read by byte ranges in many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _depth(text: Column) -> Column:
    opened = F.length(text) - F.length(F.translate(text, "{[", ""))
    return opened - (F.length(text) - F.length(F.translate(text, "}]", "")))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The files cut behind each closing brace: (path, block, place, piece, quotes, out, inn, array).

    ``block`` is the start of the byte range that a task reads and ``place`` the order in it.  ``out`` and ``inn`` are how
    much deeper the nesting is behind the piece if it began outside or inside a string; a brace inside a string is none.
    """
    read = spark.read.option("lineSep", "}").text(path)
    raw = read.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("piece"),
    )
    bare = F.regexp_replace("piece", r"(?s)\\.", "")
    quotes = F.length(bare) - F.length(F.translate(bare, '"', ""))
    odd = quotes % 2 == 1

    def change(inside: bool) -> Column:
        text = F.concat(F.lit('"'), bare) if inside else bare
        closes = F.when(odd != F.lit(inside), 0).otherwise(1)
        return (_depth(F.regexp_replace(text, r'"[^"]*("|\z)', "")) - closes).cast("long")

    return raw.select(
        "*",
        quotes.cast("long").alias("quotes"),
        change(False).alias("out"),
        change(True).alias("inn"),
        ((F.col("block") == 0) & F.col("piece").rlike(r"^[\s\x{FEFF}]*\[")).alias("array"),
    )


def _before(df: DataFrame) -> DataFrame:
    """The pieces with the number of quotes before them in their block."""
    earlier = Window.partitionBy("path", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("quoted", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)))


def _placed(pieces: DataFrame, bases: DataFrame) -> DataFrame:
    """The pieces with ``ends``: whether an object of the top level ends with them."""
    so_far = Window.partitionBy("path", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    quoted = F.col("quoted") + F.col("base_quotes")
    closed = (quoted + F.col("quotes")) % 2 == 0
    change = F.when(quoted % 2 == 1, F.col("inn")).otherwise(F.col("out"))
    depth = F.col("base_depth") + F.sum(change).over(so_far)
    return _before(pieces.join(bases, ["path", "block"])).withColumn("ends", closed & (depth == F.col("top")))


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, record): the text of every object of the top level, in array files or one after another in lines.

    A file is read by byte ranges.  Quotes and braces are counted in each range, the counts of a file's ranges (a row each)
    are summed in order, and so every range knows whether it begins in a string and how deep.  The pieces of an object
    that lies over several ranges are put together by its number; no task holds more than a range or an object.  An array
    is taken to hold objects; what else stands between them, an object cut off by the end of its file, and files without
    objects give no rows.
    """
    pieces = _pieces(spark, path)
    inside = F.col("quoted") % 2 == 1
    totals = _before(pieces).groupBy("path", "block").agg(
        F.sum("quotes").alias("quotes"),
        F.sum(F.when(inside, F.col("inn")).otherwise(F.col("out"))).alias("out"),
        F.sum(F.when(inside, F.col("out")).otherwise(F.col("inn"))).alias("inn"),
        F.max("array").alias("array"),
    )
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    in_string = F.coalesce(F.sum("quotes").over(earlier), F.lit(0))
    told = totals.withColumn("base_quotes", in_string)
    change = F.when(F.col("base_quotes") % 2 == 1, F.col("inn")).otherwise(F.col("out"))
    bases = told.select(
        "path",
        "block",
        "base_quotes",
        F.coalesce(F.sum(change).over(earlier), F.lit(0)).alias("base_depth"),
        F.max("array").over(whole).cast("int").alias("top"),
    )
    placed = _placed(pieces, bases)
    ended = placed.groupBy("path", "block").agg(F.sum(F.col("ends").cast("long")).alias("n"))
    numbers = ended.select("path", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base_ends"))
    in_block = Window.partitionBy("path", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    number = F.col("base_ends") + F.coalesce(F.sum(F.col("ends").cast("long")).over(in_block), F.lit(0))
    numbered = placed.join(numbers, ["path", "block"]).withColumn("number", number)
    parts = F.array_sort(F.collect_list(F.struct("block", "place", "piece")))
    joined = F.concat(F.array_join(F.transform(parts, lambda p: p["piece"]), "}"), F.lit("}"))
    grouped = numbered.groupBy("path", "number").agg(joined.alias("record"), F.max("ends").alias("whole"))
    return grouped.where("whole").select("path", F.regexp_replace("record", r"^[^{]*", "").alias("record"))
