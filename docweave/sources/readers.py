"""Reading stored tables, text files, tabular files and JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docweave.sources.json_arrays import json_objects


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input out to all cores before heavy work per row.

    An input with at least as many splits as cores, as any large one, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def load_texts(spark: SparkSession, directory: str, name: str, *cols: str) -> DataFrame:
    """A stored table of texts, only the given columns, spread over the cores."""
    df = load(spark, directory, name)
    return spread(df.select(*cols) if cols else df)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): UTF-8 where the bytes are valid UTF-8, Latin-1 otherwise."""
    raw = spark.read.format("binaryFile").load(path)
    as_text = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode("content", "ISO-8859-1"))
    return raw.select("path", text.alias("text"))


def table_to_text(df: DataFrame, cols: list[str] | None = None, sep: str = " ") -> DataFrame:
    """One line of text per row; a missing value reads NaN."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("NaN")) for c in (cols or df.columns)]
    return df.withColumn("line", F.concat_ws(sep, *parts))


def read_csv_as_text(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    return table_to_text(spark.read.csv(path, header=True), sep=sep)


def read_json_records(
    spark: SparkSession, path: str, schema: StructType | str | None = None, lines: bool = False
) -> DataFrame:
    """Records of JSON array files, or of files with one record per ``lines``; '@' and '-' leave the names.

    Array files are read by byte ranges, so one large file is the work of many tasks (see ``json_objects``).  A record
    that is no valid JSON has nulls.  Without a schema all records are read once more to find it.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if lines:
        df = reader.json(path)
    else:
        records = json_objects(spark, path).select("record")
        if schema is None:
            schema = reader.json(records.rdd.map(lambda r: r.record)).schema
        df = records.select(F.from_json("record", schema).alias("r")).select("r.*")
    return df.toDF(*[c.replace("@", "_at_").replace("-", "_") for c in df.columns])
