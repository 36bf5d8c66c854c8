"""Writing chunks, embedding rows and results."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.numbering import numbered


def write_chunks(df: DataFrame, path: str, config_id: str | None = None) -> None:
    """Append (document_id, chunk_text, keywords) rows with an empty embedding."""
    out = df.select(
        "document_id",
        "chunk_text",
        "keywords",
        F.lit(None).cast("array<double>").alias("embedding"),
        F.lit(config_id).cast("string").alias("config_id"),
    )
    out.write.mode("append").parquet(path)


def write_results(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Results as JSON lines or as CSV with a header."""
    if fmt == "json":
        df.write.mode("overwrite").json(path)
    elif fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown result format {fmt!r}; known: csv, json")


def write_json_arrays(df: DataFrame, path: str) -> None:
    """Results as files that hold one JSON array each, NULL fields kept; a task streams its rows into one file."""

    def run(batches):
        first = True
        for batch in batches:
            lines = [f"{'[' if first and not i else ','}{r}" for i, r in enumerate(batch.column(0).to_pylist())]
            first = first and not lines
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], ["value"])

    records = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    records.mapInArrow(run, "value string").write.mode("overwrite").text(path)


def pack_metadata(df: DataFrame, cols: list[str] | None = None, with_id: bool = False) -> DataFrame:
    """The chosen columns of each row as one JSON text, NULL fields kept."""
    packed = F.to_json(F.struct(*(cols or df.columns)), {"ignoreNullFields": "false"})
    out = df.withColumn("metadata", packed)
    return out.withColumn("id", F.uuid()) if with_id else out


def assign_batches(df: DataFrame, size: int, order: str, keys: list[str] | None = None) -> DataFrame:
    """0-based batch number: consecutive rows by ``order``, ``size`` to a batch, per ``keys``."""
    rows = numbered(df, order, keys=keys, into="_row")
    return rows.withColumn("batch", F.floor((F.col("_row") - 1) / size)).drop("_row")
